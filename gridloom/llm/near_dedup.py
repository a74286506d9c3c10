"""MinHash near-duplicates with odd sketches.

A document's set is its distinct shingles of five words (``[^\\x20\\x09-\\x0D]+``, A-Z
lower-cased), or its whole word sequence if it has fewer words.  Documents with
one set are a *class*, represented by its smallest id; only classes go on.

* MinHash samples are cut into bands; classes that share a band are candidates.
* The samples are also folded into an *odd sketch*, a bitmap in which each sample
  flips one bit.  The bits in which two sketches differ estimate the similarity,
  most precisely where it is high, and drop the candidates that are far off.
* What is left is confirmed on the full sets: 100 * common >= 75 * together.

A band's classes aren't paired with each other.  First each is compared with
the smallest class of a band of its; confirmed links give components.  Then, in each band,
the classes outside of its largest component are compared with all of the band that lie in
other components, each pair in the first band that it shares: by their sketches, then, what is left,
on their full sets, on the spot; of the pairs that are similar enough only
the most similar one of two components is sent on.  So every candidate pair is confirmed,
refuted, or inside one component already.  A band is cut into chunks of bounded rows and
bytes, and a task gets two of them.  What stays quadratic is a band of many classes of which no
component holds most.

Defined results: a null or empty text has an empty set, is linked with nothing
and is kept; rows with a null id are linked with nothing and kept; rows that
repeat an id are judged by their own text each (a component's id is the smallest id of its
rows, so a row is kept if its own id is that one); a text of fewer words than a shingle is one
shingle; a long text is one set like any other; other columns aren't read; an empty table
gives no rows.  Component links live in files of a shared folder, never on the driver.
"""

from __future__ import annotations

import hashlib
import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .batches import give_back, small_batches, tidy
from .textcore import LOWER, U64, WORD_POWERS, joined_bytes, mix, prefix_hash, range_hash, slices, word_bounds, word_hashes

SHINGLE, LEAST_SHARE = 5, (75, 100)
#: At a similarity of 0.75 a pair shares a band with probability 1 - (1 - 0.75**4)**28, all but 3 in 100,000.
BANDS, ROWS = 28, 4
#: Bits of an odd sketch, and the estimate below which a candidate is dropped: six standard errors off.
SKETCH_BITS, LEAST_ESTIMATE = 512, 0.5
#: Classes of one band, and bytes of their sets, that are compared by one task with as many others, and
#: shingles compared at a time.
CHUNK, CHUNK_BYTES, COLUMNS = 1024, 16 << 20, 2048
#: Rows of a group after which its memory is given back.
BULKY = 256
_N = BANDS * ROWS
_DRAWN = np.frombuffer(hashlib.shake_256(b"minhash").digest(8 * _N), "<u4").reshape(2, _N)
_TIMES, _PLUS = _DRAWN[0] | np.uint32(1), _DRAWN[1]


def shingle_sets(column: pa.Array) -> list[np.ndarray]:
    """The set of each text as ascending 64-bit hashes."""
    buf, bounds = joined_bytes(column)
    buf = LOWER[buf]
    start, end, in_words = word_bounds(buf, bounds)
    words = word_hashes(buf, start, end)
    h = prefix_hash(words, WORD_POWERS)
    size = np.diff(in_words)
    lo = np.arange(len(words))
    room = np.repeat(in_words[1:], size) - lo
    first = lo == np.repeat(in_words[:-1], size)
    at = np.flatnonzero((room >= SHINGLE) | (first & (room < SHINGLE)))
    hashes = mix(range_hash(h, at, at + np.minimum(room[at], SHINGLE), WORD_POWERS))
    edge = np.searchsorted(at, in_words)
    return [np.unique(hashes[a:b]) for a, b in zip(edge[:-1].tolist(), edge[1:].tolist())]


def minhashes(sets: list[np.ndarray]) -> np.ndarray:
    """(sample, set); sets aren't empty."""
    x = (np.concatenate(sets) >> U64(32)).astype(np.uint32)
    begin = np.cumsum([0, *[len(s) for s in sets[:-1]]])
    out = np.empty((_N, len(sets)), np.uint32)
    for i in range(_N):
        v = x * _TIMES[i] + _PLUS[i]
        v ^= v >> np.uint32(15)
        np.minimum.reduceat(v, begin, out=out[i])
    return out


def band_keys(samples: np.ndarray) -> np.ndarray:
    """(set, band) keys; a key also tells the band."""
    out = np.empty((samples.shape[1], BANDS), U64)
    for b in range(BANDS):
        h = np.full(samples.shape[1], b + 1, U64)
        for row in samples[b * ROWS : (b + 1) * ROWS]:
            h = mix(h * U64(0x9E3779B97F4A7C15) + row)
        out[:, b] = h
    return out


def odd_sketches(samples: np.ndarray) -> np.ndarray:
    """(set, 64-bit word) bitmaps in which each sample flips one bit."""
    out = np.zeros((samples.shape[1], SKETCH_BITS // 64), U64)
    each = np.arange(samples.shape[1])
    for i, row in enumerate(samples):
        bit = mix(row + (U64(i + 1) << U64(32))) % U64(SKETCH_BITS)
        out[each, (bit >> U64(6)).astype(np.int64)] ^= U64(1) << (bit & U64(63))
    return out


def estimate(differing: np.ndarray) -> np.ndarray:
    """Similarity by the number of bits in which two sketches differ."""
    rest = np.maximum(1 - 2 * differing / SKETCH_BITS, 1e-9)
    return 1 + SKETCH_BITS / (4 * _N) * np.log(rest)


def alike(sketch_a: np.ndarray, n_a: np.ndarray, sketch_b: np.ndarray, n_b: np.ndarray) -> np.ndarray:
    """Whether sizes and sketches allow a link."""
    differing = np.bitwise_count(sketch_a ^ sketch_b).sum(axis=-1, dtype=np.int64)
    part, whole = LEAST_SHARE
    return (whole * np.minimum(n_a, n_b) >= part * np.maximum(n_a, n_b)) & (estimate(differing) >= LEAST_ESTIMATE)


SIGNATURES = "doc_id long, n_shingles long, set_key binary, bands array<long>, sketch binary"


def signatures(docs: DataFrame, doc_id: str, text: str) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b in slices(batch, "text"):
                part = batch.slice(a, b - a)
                sets = shingle_sets(part.column(1))
                some = [i for i, s in enumerate(sets) if len(s)]
                bands, sketch = [None] * len(sets), [None] * len(sets)
                if some:
                    samples = minhashes([sets[i] for i in some])
                    for i, keys, bits in zip(some, band_keys(samples).view(np.int64), odd_sketches(samples)):
                        bands[i], sketch[i] = keys, bits.tobytes()
                yield pa.RecordBatch.from_arrays([
                    part.column(0),
                    pa.array([len(s) for s in sets], pa.int64()),
                    pa.array([hashlib.blake2b(s.tobytes(), digest_size=16).digest() if len(s) else None for s in sets], pa.binary()),
                    pa.array(bands, pa.list_(pa.int64())),
                    pa.array(sketch, pa.binary()),
                ], ["doc_id", "n_shingles", "set_key", "bands", "sketch"])

    return docs.select(F.col(f"`{doc_id}`").cast("long").alias("doc_id"), F.col(f"`{text}`").alias("text")).mapInArrow(tidy(run), SIGNATURES)


def _saved(df: DataFrame, path: str) -> DataFrame:
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def confirm(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The pairs (a, b) whose full sets are similar enough; ``sets`` has (id, shingles)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for x, y in zip(batch.column(2), batch.column(3)):
                p, q = (np.frombuffer(v.as_buffer(), "<u8") for v in (x, y))
                common = len(p) + len(q) - len(np.union1d(p, q))
                keep.append(LEAST_SHARE[1] * common >= LEAST_SHARE[0] * (len(p) + len(q) - common))
            mask = pa.array(keep, pa.bool_())
            yield pa.RecordBatch.from_arrays([batch.column(0).filter(mask), batch.column(1).filter(mask)], ["a", "b"])

    left = sets.select(F.col("id").alias("a"), F.col("shingles").alias("of_a"))
    right = sets.select(F.col("id").alias("b"), F.col("shingles").alias("of_b"))
    return pairs.join(right, "b").join(left, "a").select("a", "b", "of_a", "of_b").mapInArrow(tidy(run), "a long, b long")


def components(links: DataFrame, folder: str) -> DataFrame:
    """(id, component) of every id in a link: the smallest id that can be reached.

    Each round takes the smallest label of the neighbours, then the label of that label, so the
    distance that a label travels doubles; rounds end when no label changes.
    """
    both = links.select("a", "b").unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
    edges = _saved(both.distinct(), f"{folder}/edges")
    label = _saved(edges.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("label")).withColumnRenamed("a", "id"), f"{folder}/label-0")
    for k in itertools.count(1):
        near = edges.join(label, edges["b"] == label["id"]).groupBy("a").agg(F.min("label").alias("near"))
        step = label.join(near, label["id"] == near["a"]).select("id", "label", F.least("label", "near").alias("low"))
        upper = label.select(F.col("id").alias("low"), F.col("label").alias("above"))
        moved = step.join(upper, "low", "left").select("id", F.least("low", F.coalesce("above", "low")).alias("label"), F.col("label").alias("old"))
        moved = _saved(moved.select("id", "label", (F.col("label") != F.col("old")).alias("changed")), f"{folder}/label-{k}")
        label = moved.select("id", "label")
        if not moved.where("changed").limit(1).count():
            break
    return label.select("id", F.col("label").alias("component"))


def near_duplicates(docs: DataFrame, folder: str, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) of every row; ``folder`` is new and shared."""
    small_batches(docs)
    signed = _saved(signatures(docs, doc_id, text), f"{folder}/signatures")
    # a class is named by a number of its own: an id that repeats with other texts can be the smallest of several
    classes = signed.where("doc_id is not null and set_key is not null").groupBy("set_key").agg(F.min("doc_id").alias("first"))
    classes = _saved(classes.withColumn("id", F.monotonically_increasing_id()), f"{folder}/classes")
    one = signed.withColumnRenamed("doc_id", "first").join(classes, ["set_key", "first"]).dropDuplicates(["set_key", "first"])
    one = _saved(one.select("id", "first", F.col("n_shingles").alias("n"), "bands", "sketch"), f"{folder}/one")
    banded = one.select("id", "first", F.explode("bands").alias("band"))
    # a band's leader is the class with the smallest document: copies tend to come after what they were made from
    buckets = banded.groupBy("band").agg(F.min(F.struct("first", "id")).alias("leader"), F.count("*").alias("size")).where("size > 1").select("band", "leader")
    members = _saved(banded.join(buckets, "band").select("band", "id", "leader"), f"{folder}/members")
    first = _saved(_leader_pairs(members, one), f"{folder}/pairs-1")
    sets = _saved(_full_sets(docs, members, classes, doc_id, text), f"{folder}/sets")
    links = _saved(confirm(first, sets), f"{folder}/links-1")
    parts = components(links, f"{folder}/components-1")
    more = _saved(_cross_links(members, one, sets, parts), f"{folder}/links-2")
    if more.limit(1).count():
        parts = components(links.unionByName(more), f"{folder}/components-2")
    named = classes.join(parts, "id", "left").select("set_key", "first", F.coalesce("component", "id").alias("part"))
    lowest = named.groupBy("part").agg(F.min("first").alias("component"))
    out = signed.select("doc_id", "n_shingles", "set_key").join(named.join(lowest, "part").select("set_key", "component"), "set_key", "left")
    part = F.when(F.col("doc_id").isNotNull(), F.coalesce("component", "doc_id"))
    return out.select("doc_id", "n_shingles", part.alias("component_id"), F.coalesce(F.col("doc_id") == part, F.lit(True)).alias("kept"))


def _sketched(pairs: DataFrame, one: DataFrame) -> DataFrame:
    """The pairs (a, b) that sizes and sketches allow."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            bits = [np.frombuffer(b"".join(batch.column(i).to_pylist()), U64).reshape(batch.num_rows, -1) for i in (4, 5)]
            mask = pa.array(alike(bits[0], batch.column(2).to_numpy(), bits[1], batch.column(3).to_numpy()))
            yield pa.RecordBatch.from_arrays([batch.column(0).filter(mask), batch.column(1).filter(mask)], ["a", "b"])

    a = one.select(F.col("id").alias("a"), F.col("n").alias("n_a"), F.col("sketch").alias("s_a"))
    b = one.select(F.col("id").alias("b"), F.col("n").alias("n_b"), F.col("sketch").alias("s_b"))
    return pairs.join(b, "b").join(a, "a").select("a", "b", "n_a", "n_b", "s_a", "s_b").mapInArrow(tidy(run), "a long, b long")


def _leader_pairs(members: DataFrame, one: DataFrame) -> DataFrame:
    """Each class with the smallest leader that its sketch resembles."""
    pairs = members.where("id <> leader.id").select(F.col("leader.id").alias("a"), F.col("id").alias("b")).distinct()
    order = one.select(F.col("id").alias("a"), F.col("first").alias("order"))
    return _sketched(pairs, one).join(order, "a").groupBy("b").agg(F.min(F.struct("order", "a")).alias("best")).select("best.a", "b")


def _full_sets(docs: DataFrame, members: DataFrame, classes: DataFrame, doc_id: str, text: str) -> DataFrame:
    """(id, shingles as bytes) of the classes that share a band with another."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b in slices(batch, "text"):
                sets = shingle_sets(batch.column(0).slice(a, b - a))
                keys = [hashlib.blake2b(s.tobytes(), digest_size=16).digest() for s in sets]
                yield pa.RecordBatch.from_arrays([pa.array(keys, pa.binary()), pa.array([s.tobytes() for s in sets], pa.binary())], ["set_key", "shingles"])

    wanted = classes.join(members.select("id").distinct(), "id", "left_semi")
    texts = docs.select(F.col(f"`{doc_id}`").cast("long").alias("first"), F.col(f"`{text}`").alias("text"))
    # by merge at every size: a broadcast that only few classes allow would make another plan of a small table
    found = texts.join(wanted.select("first").distinct().hint("merge"), "first", "left_semi").select("text").mapInArrow(tidy(run), "set_key binary, shingles binary")
    return found.dropDuplicates(["set_key"]).join(wanted.select("set_key", "id"), "set_key").select("id", "shingles")


def _cross_links(members: DataFrame, one: DataFrame, sets: DataFrame, parts: DataFrame) -> DataFrame:
    """Links between components that share a band; all pairs of its classes are compared where they lie, and a task
    sends no more links than join its components.

    The classes of a band's largest component are only compared with the others.  A band of many classes is cut
    into chunks, and a task gets two of it, so no task grows with a band.
    """
    named = members.join(parts, "id", "left").select("band", "id", F.coalesce("component", "id").alias("part")).join(one.select("id", "n"), "id")
    sized = named.groupBy("band", "part").agg(F.count("*").alias("rows"), F.sum("n").alias("n"))
    bands = sized.groupBy("band").agg(F.count("*").alias("parts"), F.sum("rows").alias("all"), F.sum("n").alias("all_n"), F.max(F.struct("rows", "n", "part")).alias("top")).where("parts > 1")
    chunks = lambda rows, n: F.greatest(F.ceil(rows / CHUNK), F.ceil(8 * n / CHUNK_BYTES), F.lit(1)).cast("int")
    small = (F.col("all") <= CHUNK) & (8 * F.col("all_n") <= CHUNK_BYTES)  # one task compares it all
    mixed = bands.select("band", small.alias("small"), F.col("top.part").alias("main"), chunks(F.col("top.rows"), F.col("top.n")).alias("inner"), chunks(F.col("all") - F.col("top.rows"), F.col("all_n") - F.col("top.n")).alias("outer"))
    # chunks of the others are numbered from 0, those of the largest component behind them
    rows = named.join(mixed, "band").withColumn("main", F.col("part") == F.col("main"))
    spread = F.xxhash64("id")
    rows = rows.withColumn("chunk", F.when(F.col("small"), 0).when(F.col("main"), F.col("outer") + F.pmod(spread, F.col("inner"))).otherwise(F.pmod(spread, F.col("outer"))).cast("int"))
    every = F.when(F.col("small"), 1).otherwise(F.col("outer") + F.when(F.col("main"), 0).otherwise(F.col("inner")))
    rows = rows.withColumn("other", F.explode(F.sequence(F.lit(0), every - 1)))
    rows = rows.select("band", F.least("chunk", "other").alias("x"), F.greatest("chunk", "other").alias("y"), "chunk", "id", "part", "n")
    rows = rows.join(one.select("id", "sketch", "bands"), "id")
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.schema)

    def still_open(table: pa.Table) -> tuple[list[np.ndarray], tuple]:
        """For each class, the classes of other components that its sketch allows a link with and that share no earlier band."""
        part, n, chunk = (table.column(c).to_numpy() for c in ("part", "n", "chunk"))
        across = table.column("x")[0].as_py() != table.column("y")[0].as_py()
        band = table.column("band")[0].as_py()
        bits = np.frombuffer(b"".join(table.column("sketch").to_pylist()), U64).reshape(len(part), -1)
        keys = table.column("bands").combine_chunks().flatten().to_numpy().reshape(len(part), -1)
        found = []
        for i in range(len(part)):
            j = np.flatnonzero((part != part[i]) & alike(bits[i], n[i], bits, n) & ((chunk != chunk[i]) if across else True))
            first = (keys[j] == keys[i]).argmax(axis=1)
            found.append(j[keys[i][first] == band])
        return found, (part, n)

    def sketched(table: pa.Table) -> pa.Table:
        table = table.combine_chunks()
        return table.filter(pa.array([len(j) > 0 for j in still_open(table)[0]], pa.bool_()))

    def run(table: pa.Table) -> pa.Table:
        table = table.combine_chunks()
        ids, full = table.column("id").to_numpy(), table.column("shingles").to_pylist()
        open_, (part, n) = still_open(table)
        a, b = [], []
        if any(len(j) for j in open_):
            common = _common([np.frombuffer(x, "<u8") for x in full])
            joined = np.unique(part, return_inverse=True)[1]  # what the links so far join
            for i, j in enumerate(open_):
                j = j[joined[j] != joined[i]]
                both = common[i, j]
                j = j[LEAST_SHARE[1] * both >= LEAST_SHARE[0] * (n[i] + n[j] - both)]
                while len(j):
                    a.append(min(ids[i], ids[j[0]]))
                    b.append(max(ids[i], ids[j[0]]))
                    joined[joined == joined[j[0]]] = joined[i]
                    j = j[joined[j] != joined[i]]
        if len(part) > BULKY:
            give_back()
        return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})

    keys = ["band", "x", "y"]
    left = rows.groupBy(*keys).applyInArrow(lambda t: sketched(t), schema)
    return left.join(sets, "id").groupBy(*keys).applyInArrow(lambda t: run(t), "a long, b long").distinct()


def _common(sets: list[np.ndarray]) -> np.ndarray:
    """Sizes of all common parts, by products of 0/1 rows over the shingles that two sets at least have."""
    values, at, count = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    row = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    shared = count > 1
    column = np.cumsum(shared) - 1
    keep = shared[at]
    row, at = row[keep], column[at[keep]]
    out = np.zeros((len(sets), len(sets)), np.float32)
    order = np.argsort(at, kind="stable")
    row, at = row[order], at[order]
    for lo in range(0, int(shared.sum()), COLUMNS):
        i, j = np.searchsorted(at, (lo, lo + COLUMNS))
        block = np.zeros((len(sets), COLUMNS), np.float32)
        block[row[i:j], at[i:j] - lo] = 1
        out += block @ block.T
    return out.astype(np.int64)
