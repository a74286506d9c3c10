"""Resampling towards a target distribution by importance weights of hashed features.

Features are runs of consecutive words; a feature's bucket is the CRC-32 of its bytes modulo ``buckets``.

1. **Streams.**  Texts are turned once into packed streams of uint16 buckets with the documents' offsets, about a
   MiB of text in each, and written.  All that follows reads two bytes a feature and never the text.
2. **Sort and count.**  Each stream is sorted and run-length encoded; runs are merged within a task, and by bucket
   over all tasks.
3. **Gather.**  A bucket's gain compares its share in the target with that in the corpus.  A document's weight is
   ``np.add.reduceat`` over the gains gathered by its stream.
4. **Draw.**  A Gumbel number drawn by a hash of the id is added; the highest scores are a sample without
   replacement.  Scores are sorted by range partitions; a row's rank is its place in its partition
   plus the sizes of those before, so nothing is ranked in one task.

Defined results: a null or empty text has no features, weight 0, and is never drawn; a null id is drawn by the hash of
an empty one and comes after all ids of its score; repeated rows are ranked one after the other; no target or no
corpus counts as zero counts; other columns aren't read; a long text is one document; an empty table gives no rows.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .batches import small_batches
from .decontaminate import BREAKS
from .packed import binaries, raw
from .textcore import LOWER, joined_bytes, slices, word_bounds

BUCKETS, RUNS, LEAST_WORDS, PERCENT, SEED = 10_000, 1, 20, 10, 2024
#: Longer features are hashed one by one, not side by side.
LONG_FEATURE = 64
#: Rows that a range of scores holds, at most about.
RANGE_ROWS = 1 << 20
STREAMS = "ids array<{0}>, words array<int>, features array<int>, stream binary"


def _crc_table() -> np.ndarray:
    """CRC-32 of each byte, by its definition (reflected polynomial EDB88320)."""
    t = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        t = np.where(t & 1, (t >> np.uint32(1)) ^ np.uint32(0xEDB88320), t >> np.uint32(1))
    return t


_TABLE = _crc_table()


def crc32s(body: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """CRC-32 of each ``body[start:end]``; a byte of all of them at a time, longest first."""
    size = end - start
    order = np.argsort(-size, kind="stable")
    order = order[size[order] <= LONG_FEATURE]
    out = np.zeros(len(start), np.uint32)
    state = np.full(len(order), 0xFFFFFFFF, np.uint32)
    at, length = start[order], size[order]
    for j in range(int(length[0]) if len(order) else 0):
        n = int(np.searchsorted(-length, -j, "left"))  # those longer than j
        state[:n] = _TABLE[(state[:n] ^ body[at[:n] + j]) & np.uint32(255)] ^ (state[:n] >> np.uint32(8))
    out[order] = ~state
    for i in np.flatnonzero(size > LONG_FEATURE).tolist():
        out[i] = zlib.crc32(body[start[i] : end[i]])
    return out


def bucket_stream(column: pa.Array, buckets: int, runs: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(words of each document, features of each document, their buckets document by document)."""
    buf, bounds = joined_bytes(column)
    start, end, in_words = word_bounds(LOWER[buf], bounds, BREAKS)
    size = end - start
    # words end to end with one space behind each, so that a run of words is a range of bytes
    last = np.cumsum(size + 1) - 1
    first = last - size
    body = np.full(int(last[-1]) + 1 if len(last) else 0, 0x20, np.uint8)
    body[np.repeat(first - np.concatenate([[0], np.cumsum(size)[:-1]]), size) + np.arange(size.sum())] = LOWER[buf][np.repeat(start - np.concatenate([[0], np.cumsum(size)[:-1]]), size) + np.arange(size.sum())]
    n = np.diff(in_words)
    room = np.repeat(in_words[1:], n) - np.arange(len(first))
    doc = np.repeat(np.arange(len(n)), n)
    of, made = [], []
    for k in range(1, runs + 1):
        at = np.flatnonzero(room >= k)
        of.append(doc[at])
        made.append((crc32s(body, first[at], last[at + k - 1]) % np.uint32(buckets)).astype(np.uint16))
    of, made = np.concatenate(of), np.concatenate(made)
    return n, np.bincount(of, minlength=len(n)), made[np.argsort(of, kind="stable")] if runs > 1 else made


def write_streams(docs: DataFrame, path: str, id: str, text: str, buckets: int, runs: int) -> DataFrame:
    kind = docs.schema[id].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b in slices(batch, text):
                part = batch.slice(a, b - a)
                words, features, stream = bucket_stream(part.column(1), buckets, runs)
                whole = pa.array([0, b - a], pa.int32())
                lists = [pa.ListArray.from_arrays(whole, x) for x in (part.column(0), pa.array(words, pa.int32()), pa.array(features, pa.int32()))]
                yield pa.RecordBatch.from_arrays([*lists, binaries(stream, np.array([0, 2 * len(stream)]))], ["ids", "words", "features", "stream"])

    schema = STREAMS.format(kind)
    small_batches(docs).select(f"`{id}`", f"`{text}`").mapInArrow(run, schema).write.parquet(path)
    return docs.sparkSession.read.schema(schema).parquet(path)


def bucket_counts(streams: DataFrame, buckets: int) -> np.ndarray:
    """How many features each bucket has over all streams."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(buckets, np.int64)
        for batch in batches:
            data, bounds = raw(batch.column(0))
            for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist()):
                ordered = np.sort(data[a:b].view("<u2"))
                edge = np.flatnonzero(np.concatenate([[True], ordered[1:] != ordered[:-1]])) if len(ordered) else np.zeros(0, np.int64)
                total[ordered[edge]] += np.diff(np.concatenate([edge, [len(ordered)]]))
        found = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(found, pa.int32()), pa.array(total[found])], ["bucket", "n"])

    out = np.zeros(buckets, np.int64)
    for r in streams.select("stream").mapInArrow(run, "bucket int, n long").groupBy("bucket").agg(F.sum("n").alias("n")).collect():  # a row a bucket
        out[r.bucket] = r.n
    return out


def gains(corpus: np.ndarray, target: np.ndarray) -> np.ndarray:
    """floor(1000 * ln of the smoothed target share over the smoothed corpus share)."""
    s, t, n = int(corpus.sum()), int(target.sum()), len(corpus)
    return np.array([math.floor(1000 * math.log((b + 1) * (s + n) / ((a + 1) * (t + n)))) for a, b in zip(corpus.tolist(), target.tolist())], np.int64)


def _gumbel(seed: int):
    h = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))), 256), 1, 8), 16, 10).cast("double")
    return F.floor(-1000 * F.log(-F.log((h + 0.5) / F.lit(4294967296.0)))).cast("long")


def resample(docs: DataFrame, target: DataFrame, folder: str, id: str = "doc_id", text: str = "text", buckets: int = BUCKETS, runs: int = RUNS, least_words: int = LEAST_WORDS, percent: int = PERCENT, seed: int = SEED) -> DataFrame:
    """(doc_id, n_words, n_features, weight, score, rank) of every row; ``rank`` is null for rows that aren't drawn.
    ``target`` has a column ``text``; ``folder`` is new and shared."""
    if not 0 < buckets <= 1 << 16:
        raise ValueError("buckets are numbered in 16 bits")
    spark = docs.sparkSession
    kind = docs.schema[id].dataType.simpleString()
    streams = write_streams(docs, f"{folder}/corpus", id, text, buckets, runs)
    wanted = write_streams(target.select(F.lit(None).cast("long").alias("doc_id"), F.col("text")), f"{folder}/target", "doc_id", "text", buckets, runs)
    gain = gains(bucket_counts(streams, buckets), bucket_counts(wanted, buckets))

    def weigh(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place = TaskContext.get().partitionId() << 40
        for batch in batches:
            data, bounds = raw(batch.column(3))
            ids, words, features = (batch.column(i).flatten() for i in range(3))
            n = features.to_numpy()
            value = gain[np.ascontiguousarray(data[bounds[0] : bounds[-1]]).view("<u2")]
            weight = np.zeros(len(n), np.int64)
            some = np.flatnonzero(n)
            if len(some):
                weight[some] = np.add.reduceat(value, (np.cumsum(n, dtype=np.int64) - n)[some])
            columns = [ids, words.cast(pa.int64()), features.cast(pa.int64()), pa.array(weight), pa.array(place + np.arange(len(n)))]
            place += len(n)
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "n_words", "n_features", "weight", "place"])

    fields = f"doc_id {kind}, n_words long, n_features long, weight long, place long"
    streams.mapInArrow(weigh, fields).withColumn("score", F.col("weight") + _gumbel(seed)).withColumn("fit", F.col("n_words") >= least_words).write.parquet(f"{folder}/scored")
    scored = spark.read.schema(f"{fields}, score long, fit boolean").parquet(f"{folder}/scored")
    size = scored.agg(F.count("*").alias("rows"), F.count_if("fit").alias("fit")).first()
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), math.ceil(size.rows / RANGE_ROWS))
    order = [F.desc("fit"), F.desc("score"), F.asc_nulls_last("doc_id"), F.asc("place")]

    def number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, at = TaskContext.get().partitionId(), 0
        for batch in batches:
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(np.full(batch.num_rows, part, np.int32)), pa.array(np.arange(at + 1, at + 1 + batch.num_rows))], [*batch.schema.names, "part", "inside"])
            at += batch.num_rows

    scored.repartitionByRange(parts, *order).sortWithinPartitions(*order).mapInArrow(number, f"{fields}, score long, fit boolean, part int, inside long").write.parquet(f"{folder}/ranked")
    ranked = spark.read.schema(f"{fields}, score long, fit boolean, part int, inside long").parquet(f"{folder}/ranked")
    before, sizes = 0, []
    for r in ranked.groupBy("part").agg(F.count("*").alias("n")).orderBy("part").collect():  # a row a range
        sizes.append((r.part, before))
        before += r.n
    starts = F.broadcast(spark.createDataFrame(sizes, "part int, before long"))  # as many rows as ranges
    rank = F.col("before") + F.col("inside")
    drawn = F.col("fit") & (rank <= percent * size.fit // 100)
    return ranked.join(starts, "part", "left").select("doc_id", "n_words", "n_features", "weight", "score", F.when(drawn, rank).alias("rank"))
