"""A training corpus from raw documents: five stages, each written as Parquet and read again.

toxicity -> near duplicates -> repeated passages -> benchmark passages -> token ids

Defined results: a null or empty text is not toxic, is kept by the near-duplicate stage (of one id only
once) and comes out with no ids; rows with null ids, and rows that repeat an id with other texts, are
documents of their own; of equal rows one stays; an empty table gives no rows; other columns, whatever
their names, are passed through up to the last stage, which has ``lang`` and ``source`` if there are any;
a long text is one document.
"""

from __future__ import annotations

import functools

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridloom.llm.bpe import build_lexicon, encode_decode
from gridloom.llm.decontaminate import drop_contaminated
from gridloom.llm.fingerprint_index import drop_folder
from gridloom.llm.near_dedup import near_duplicates
from gridloom.llm.queries import learnable, shared_folder, table, tokenizer_path
from gridloom.llm.substring_dedup import remove_repeated_passages
from gridloom.llm.toxicity import fit, score_texts

#: Documents with at least this probability of being toxic are rejected.
MOST_TOXIC = 0.7
#: Column of the near-duplicate stage that tells rows apart.
ROW = "__row"


def passing_through(stage):
    """The stage over columns under names of their own, so that none meets a name that an operator gives a result."""

    @functools.wraps(stage)
    def run(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        names = {c: f"__column_{i}" for i, c in enumerate(docs.columns) if c not in ("doc_id", "text", "n_chars")}
        out = stage(spark, docs.withColumnsRenamed(names), sf_dir)
        return out.withColumnsRenamed({new: old for old, new in names.items()}).select(*[f"`{c}`" for c in docs.columns])

    return run


@passing_through
def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejects toxic documents; the model never sees the labels of held-out rows."""
    model = fit(docs.select("doc_id", "text"), learnable(table(spark, sf_dir, "labels")), shared_folder(spark, "stage-toxicity"))
    return score_texts(docs, model).where(F.col("score") < MOST_TOXIC).select(*docs.columns)


@passing_through
def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one row of each group: that with the smallest id, null ids last.  A row repeated, or with a null id,
    is a member like any other; rows without words are linked with nothing, but of one id only one stays."""
    folder = shared_folder(spark, "stage-near")
    # the rows' keys are written, so that all that follows sees the same
    docs.withColumn(ROW, F.monotonically_increasing_id()).write.option("compression", "zstd").parquet(f"{folder}/rows")
    rows = spark.read.parquet(f"{folder}/rows")
    judged = near_duplicates(rows.select(F.col(ROW).alias("doc_id"), "text"), f"{folder}/work").withColumnRenamed("doc_id", ROW)
    empty_twice = F.when((F.col("n_shingles") == 0) & F.col("doc_id").isNotNull(), F.col("doc_id"))
    named = judged.join(rows.select(ROW, "doc_id"), ROW).select(ROW, "doc_id", empty_twice.alias("of_id"), F.when(empty_twice.isNull(), F.col("component_id")).alias("of_set"))
    named.write.parquet(f"{folder}/named")
    named = spark.read.parquet(f"{folder}/named")
    drop_folder(spark, f"{folder}/work")  # what was found out is in ``named``
    first = named.groupBy("of_id", "of_set").agg(F.min(F.struct(F.col("doc_id").isNull().alias("unnamed"), "doc_id", ROW)).alias("first")).select(F.col(f"first.{ROW}").alias(ROW))
    gone = named.select(ROW).join(first, ROW, "left_anti")
    return rows.join(gone, ROW, "left_anti").select(*docs.columns)


@passing_through
def cut_repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Takes passages that occur more than once out of the texts, each with the white space behind it; lines, paragraphs and
    indentation of what is kept stay as they are.  ``n_chars`` follows the text."""
    cut = remove_repeated_passages(docs, layout=True, folder=shared_folder(spark, "stage-passages"))
    changed = F.col("n_removed") > 0
    text = F.when(changed, F.col("kept_text")).otherwise(F.col("text"))
    out = cut.withColumn("text", text)
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.when(changed, F.length("text")).otherwise(F.col("n_chars")).cast(docs.schema["n_chars"].dataType))
    return out.select(*docs.columns)


@passing_through
def drop_benchmark_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejects documents that overlap with a benchmark item."""
    return drop_contaminated(docs, table(spark, sf_dir, "benchmark"))


def token_ids(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of what is left, and the hash of what they decode to."""
    path = tokenizer_path()
    more = [c for c in ("lang", "source") if c in docs.columns]
    coded = encode_decode(docs.select("doc_id", "text", *more), path, build_lexicon(docs, path))
    return coded.select("doc_id", *more, F.size("ids").cast("long").alias("n_tokens"), "ids", F.sha2(F.col("decoded_text"), 256).alias("decoded_sha256"))


STAGES = [
    ("toxicity", drop_toxic),
    ("near duplicates", drop_near_copies),
    ("substring dedup", cut_repeated_passages),
    ("decontamination", drop_benchmark_passages),
    ("BPE", token_ids),
]

#: No SQL: repeated passages and byte-pair merges aren't expressible; tests hold run() against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = shared_folder(spark, "pipeline")
    docs = table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{k}")
        docs = spark.read.parquet(f"{folder}/{k}")
    return docs
