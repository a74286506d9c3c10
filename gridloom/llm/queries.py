"""The registered queries of the text operators: thin callers with production parameters."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import scratch


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .decontaminate import find_overlaps

    return find_overlaps(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op2_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .license_scan import scan_licenses

    found = scan_licenses(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select("doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score")


def op4_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .substring_dedup import remove_repeated_passages

    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return remove_repeated_passages(docs, folder=shared_folder(spark, "passages")).select("doc_id", "n_words", "n_removed", F.sha2(F.col("kept_text"), 256).alias("kept_sha256"))


def op5_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .suffix_dedup import remove_repeated_strings

    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    cut = remove_repeated_strings(docs)
    # a cut may fall into a character: kept_text has U+FFFD for its rest, the hash is that of the bytes
    return cut.select("doc_id", "n_bytes", "n_removed", F.size("spans").cast("long").alias("n_spans"), F.sha2(F.col("kept"), 256).alias("kept_sha256"), F.make_valid_utf8(F.col("kept").cast("string")).alias("kept_text"))


def shared_folder(spark: SparkSession, name: str) -> str:
    """A new folder below the one that driver and executors share."""
    root = spark.conf.get("spark.checkpoint.dir", "") or spark.sparkContext.getConf().get("spark.checkpoint.dir", "")
    if not root and (given := spark.sparkContext._jsc.sc().getCheckpointDir()).isDefined():
        root = given.get()
    if not root:
        return scratch(spark, name)  # an error unless the session is one of one machine, as in tests
    return f"{root.rstrip('/')}/{name}-{uuid.uuid4().hex[:12]}"


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def op3_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .bpe import build_lexicon, encode_decode

    docs, path = table(spark, sf_dir, "documents").select("doc_id", "text"), tokenizer_path()
    coded = encode_decode(docs, path, build_lexicon(docs, path))
    ids = F.array_join(F.col("ids").cast("array<string>"), ",")
    return coded.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), F.sha2(ids, 256).alias("ids_sha256"), F.sha2(F.col("decoded_text"), 256).alias("decoded_sha256"))


def op6_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .topk import EVERY, exact_top_k

    vectors = table(spark, sf_dir, "embeddings")
    return exact_top_k(vectors, vectors.where(F.col("vec_id") % EVERY == 0))


def op7_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .near_dedup import near_duplicates

    return near_duplicates(table(spark, sf_dir, "documents").select("doc_id", "text"), shared_folder(spark, "near-dedup"))


def op8_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .url_filter import judge_urls

    return judge_urls(table(spark, sf_dir, "pages"), table(spark, sf_dir, "labels")).select("page_id", "host", "path", "rule", "verdict")


def learnable(labels: DataFrame) -> DataFrame:
    """Labels that may be learnt from: those of held-out rows are not."""
    from .toxicity import held_out

    return labels.where(~held_out()).select("doc_id", "toxic")


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .toxicity import fit, held_out, score_texts

    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = fit(docs, learnable(table(spark, sf_dir, "labels")), shared_folder(spark, "toxicity"))
    scored = score_texts(docs, model)
    return scored.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= 0.7).cast("int").alias("predicted"))


def op10_token_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .token_store import document_sums, write_store

    path = shared_folder(spark, "token-store")
    write_store(table(spark, sf_dir, "documents").select("doc_id", "text"), path, tokenizer_path())
    return document_sums(spark, path).select("doc_id", "start", "n_tokens", F.col("crc").alias("ids_crc32"))


def op11_backoff_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .backoff_lm import score_texts

    scored = score_texts(table(spark, sf_dir, "documents"), shared_folder(spark, "backoff-lm"))
    return scored.withColumns({c: F.round(c, 6) for c in ("base_score", "score")})


def op12_centroids(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .centroids import cluster_vectors

    return cluster_vectors(table(spark, sf_dir, "embeddings"), shared_folder(spark, "centroids"))


def op13_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .resampling import resample

    drawn = resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), shared_folder(spark, "resampling"))
    return drawn.select("doc_id", "n_features", "weight", "score", "rank")


QUERIES = {f.__name__: f for f in (op1_decontaminate, op2_license_scan, op3_bpe, op4_substring_dedup, op5_suffix_array_dedup, op6_topk, op7_near_dedup, op8_url_filter, op9_toxicity, op10_token_store, op11_backoff_lm, op12_centroids, op13_resampling)}


def _oracles() -> dict[str, str]:
    from .oracles import BACKOFF, CENTROIDS, NEAR, REPEATS, RESAMPLING, TOPK
    from .url_filter import oracle_sql

    return {
        "op4_substring_dedup": REPEATS, "op6_topk": TOPK, "op7_near_dedup": NEAR, "op8_url_filter": oracle_sql(),
        "op11_backoff_lm": BACKOFF, "op12_centroids": CENTROIDS, "op13_resampling": RESAMPLING,
    }


ORACLE_SQL = _oracles()
