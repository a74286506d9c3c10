"""Content-addressed store of token-id streams.

Ids are cut into chunks where a rolling hash of the last ids has its low bits
zero, so equal passages give equal chunks wherever they stand.  A chunk's name
is a hash of its ids; a chunk is stored once.  A document is a *recipe*: the
names and lengths of its chunks.  The folder holds

* ``content/kind=0/``: packs; a body is ``TIDS``, a count, an index of (name,
  ids, bytes) and the compressed little-endian ids;
* ``content/kind=1/``: recipes as they came; ``recipes/``: the same as (part,
  row, doc_id, n_tokens, names), ascending by id within and across parts;
* ``manifest/``: for each 4096 recipes of a part their totals and their hash (of
  id, number of tokens and names), which are the leaves of a Merkle tree; ``root/``: its root.

Reading verifies every chunk against its name and every part of the recipes
against the manifest before it returns anything made from them; ``read_documents`` puts the
ids together again and holds their number against the recipe.

Defined results: a null or empty text is the end id alone; equal rows have a
recipe each and share chunks; null ids come first; ties of an id are ordered by
their chunks' names; a long text is many chunks; only id and text are read, so other columns
can't clash; an empty table makes an empty store; a missing chunk is an error.  Parts are as
many as the session's shuffle partitions at least, and more for more text.
"""

from __future__ import annotations

import hashlib
import math
import os
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .batches import small_batches
from .bpe import _UNSAFE_RE2, CACHED_CHARS, CACHED_WORDS, ENCODED_BYTES, byte_letters, cut_words
from .textcore import WORD_POWERS, U64, joined_bytes, mix, prefix_hash, range_hash, slices

END_ID = 0
#: Rolling hash: ids it looks at, bits that must be zero (so 2**bits ids a chunk on average), longest chunk.
ROLL, CUT_BITS, LONGEST = 16, 11, 1 << 15
PACK_BYTES, NAME = 1 << 20, 16
#: Bytes of text in a part, at most about; parts are as many as shuffle partitions at least.
PART_BYTES = 256 << 20
#: What Spark says of a table whose size it can't tell is more than this.
UNKNOWN_BYTES = 1 << 60
_MAGIC = b"TIDS"
#: A chunk in a recipe: its name and its number of ids.
_ENTRY = np.dtype([("name", f"V{NAME}"), ("n", "<u4")])


# -- ids --------------------------------------------------------------------
def slice_words(texts: pa.Array) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """(distinct words, the word at each place, bounds of the texts in places).  Texts are cut at spaces, and those whose cuts depend on
    more than the space one by one."""
    texts = pc.fill_null(texts.cast(pa.string()), "")
    parts = pc.split_pattern(texts, " ")
    odd = np.flatnonzero(pc.match_substring_regex(texts, _UNSAFE_RE2).to_numpy(zero_copy_only=False))
    if len(odd):
        pieces, at = [], 0
        for i in odd.tolist():
            pieces += [parts.slice(at, i - at), pa.array([cut_words(texts[i].as_py())], parts.type)]
            at = i + 1
        parts = pa.concat_arrays([*pieces, parts.slice(at)])
    bounds = np.concatenate([[0], np.cumsum(pc.list_value_length(parts).to_numpy())]).astype(np.int64)
    coded = parts.flatten().dictionary_encode()
    return coded.dictionary, coded.indices.to_numpy().astype(np.int64), bounds


class WordTable:
    """Words and their ids, as Arrow and NumPy arrays: a look-up is one call for many words, by the words themselves.

    What is known lies in two generations: a full young one becomes the old one, and a word that is met again moves back to
    the young one.  So memory is bounded and frequent words stay.
    """

    def __init__(self, size: int = CACHED_WORDS):
        self.size = size
        self.young = self.old = Coded.none()

    def ids_of(self, words: pa.Array, ask) -> "Coded":
        """``words`` (distinct) with their ids; ``ask`` makes those of words that aren't known."""
        place = pc.index_in(words, value_set=self.young.words).fill_null(-1).to_numpy(zero_copy_only=False)
        missing = np.flatnonzero(place < 0)
        rest = words.take(pa.array(missing))
        again = pc.index_in(rest, value_set=self.old.words).fill_null(-1).to_numpy(zero_copy_only=False)
        back, new = missing[again >= 0], missing[again < 0]
        moved, made = self.old.take(again[again >= 0]), ask(words.take(pa.array(new)))
        found = Coded.joined([self.young.take(place[place >= 0]), moved, made])
        order = np.empty(len(words), np.int64)
        order[np.concatenate([np.flatnonzero(place >= 0), back, new])] = np.arange(len(words))
        short = np.flatnonzero(pc.binary_length(made.words).to_numpy(zero_copy_only=False) <= CACHED_CHARS)
        self.young = Coded.joined([self.young, moved, made.take(short)])
        if len(self.young.words) > self.size:
            self.old, self.young = self.young, Coded.none()
        return found.take(order)


class Coded:
    """Words and ids: those of word ``i`` are ``ids[bounds[i]:bounds[i + 1]]``."""

    def __init__(self, words: pa.Array, ids: np.ndarray, bounds: np.ndarray):
        self.words, self.ids, self.bounds = words, ids, bounds

    @classmethod
    def none(cls) -> "Coded":
        return cls(pa.array([], pa.string()), np.zeros(0, np.int32), np.zeros(1, np.int64))

    @classmethod
    def joined(cls, parts: list["Coded"]) -> "Coded":
        sizes = np.concatenate([np.diff(p.bounds) for p in parts])
        return cls(pa.concat_arrays([p.words for p in parts]), np.concatenate([p.ids for p in parts]), np.concatenate([[0], np.cumsum(sizes)]))

    def take(self, at: np.ndarray) -> "Coded":
        return Coded(self.words.take(pa.array(at, pa.int64())), *self.picked(at))

    def picked(self, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of the words at ``at``, end to end, and their bounds."""
        size = np.diff(self.bounds)[at]
        bounds = np.concatenate([[0], np.cumsum(size)])
        return self.ids[np.arange(bounds[-1]) + np.repeat(self.bounds[at] - bounds[:-1], size)], bounds


class LibraryEncoder:
    """Ids of whole texts by the tokenizers library, asked once for each word that is new to the worker.

    Words end where no token can cross (see ``bpe``), so a text's ids are its words' ids in order.
    """

    _made: dict = {}

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        size = self.tokenizer.get_vocab_size()
        special = {i: t.content for i, t in self.tokenizer.get_added_tokens_decoder().items()}
        letters = byte_letters()
        count = lambda i: len(special[i].encode()) if i in special else sum(c in letters for c in self.tokenizer.id_to_token(i))
        #: bytes that each token stands for
        self.bytes = np.array([count(i) for i in range(size)], np.int64)
        self.table = WordTable()

    @classmethod
    def of(cls, path: str) -> "LibraryEncoder":
        if path not in cls._made:
            os.environ["TOKENIZERS_PARALLELISM"] = "false"  # the executor's cores are Spark's
            cls._made[path] = cls(path)
        return cls._made[path]

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts, bounds): ``ids[bounds[i]:bounds[i + 1]]`` are those of text ``i``.  No object is made of a word."""
        words, index, bounds = slice_words(texts)
        begins, place = np.unique(index[bounds[:-1]], return_inverse=True)  # the only words without a space in front
        spaced = self.table.ids_of(words, self._ask)
        plain = self._alone(words.take(pa.array(begins)))
        index = index.copy()
        index[bounds[:-1]] = len(words) + place
        ids, ends = Coded.joined([spaced, plain]).picked(index)
        return ids, ends[bounds]

    def _ask(self, words: pa.Array) -> Coded:
        """The library's ids of words with a space in front.  Of those that neither begin nor end with white space many
        are asked for together, as one text: none of its tokens crosses their ends, so byte counts tell the words apart."""
        together = joinable(words)
        joined, alone = np.flatnonzero(together), np.flatnonzero(~together)
        parts = [self._alone(words.take(pa.array(alone)), " ")]
        for a in range(0, len(joined), JOINED_WORDS):
            some = words.take(pa.array(joined[a : a + JOINED_WORDS]))
            text = pc.binary_join(pa.ListArray.from_arrays(pa.array([0, len(some)], pa.int32()), some), " ")[0].as_py()
            ids = np.array(self.tokenizer.encode_batch_fast([" " + text], add_special_tokens=False)[0].ids, np.int32)
            size = pc.binary_length(some).to_numpy(zero_copy_only=False).astype(np.int64) + 1
            ends = np.searchsorted(np.cumsum(self.bytes[ids]), np.cumsum(size)) + 1
            parts.append(Coded(some, ids, np.concatenate([[0], ends])))
        order = np.empty(len(words), np.int64)
        order[np.concatenate([alone, joined])] = np.arange(len(words))
        return Coded.joined(parts).take(order)

    def _alone(self, words: pa.Array, front: str = "") -> Coded:
        found = self.tokenizer.encode_batch_fast([front + w for w in words.to_pylist()], add_special_tokens=False)
        sizes = [len(x) for x in found]
        return Coded(words, np.array([i for x in found for i in x.ids], np.int32), np.concatenate([[0], np.cumsum(sizes)]).astype(np.int64))


#: Words that the library is asked for at a time.
JOINED_WORDS = 4096
#: ASCII characters that print and aren't a space.
_GRAPHIC = np.array([0x20 < b < 0x7F for b in range(256)])


def joinable(words: pa.Array) -> np.ndarray:
    """Which words (a space goes in front of each) begin and end with a printable character that isn't white space."""
    body, bounds = joined_bytes(words)
    size = np.diff(bounds)
    out = np.zeros(len(words), bool)
    some = np.flatnonzero(size > 0)
    if not len(some):
        return out
    first, last = body[bounds[:-1][some]], body[bounds[1:][some] - 1]
    high = np.maximum.reduceat(body, bounds[:-1][some])
    plain = high < 0x80
    out[some] = plain & _GRAPHIC[first] & _GRAPHIC[last]
    odd = some[~plain]
    for i, w in zip(odd.tolist(), words.take(pa.array(odd)).to_pylist()):
        out[i] = w[0] > " " and w[0].isprintable() and w[-1] != " " and w[-1].isprintable()
    return out


# -- chunks -----------------------------------------------------------------
def chunk_ends(ids: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Where chunks end (exclusive): at cuts of the rolling hash, at ends of documents, or by length."""
    n = len(ids)
    h = prefix_hash(mix(ids.astype(U64) + U64(1)), WORD_POWERS)
    at = np.arange(ROLL, n + 1)
    cut = at[mix(range_hash(h, at - ROLL, at, WORD_POWERS)) >> U64(64 - CUT_BITS) == 0] if n >= ROLL else at[:0]
    first = np.repeat(bounds[:-1], np.diff(bounds))
    cut = cut[(cut - first[cut - 1]) >= ROLL]  # the hash must not look across a document's start
    ends = np.union1d(cut, bounds[1:][np.diff(bounds) > 0])
    long = np.flatnonzero(np.diff(np.concatenate([[0], ends])) > LONGEST)
    if len(long):
        starts = np.concatenate([[0], ends])[long]
        ends = np.union1d(ends, np.concatenate([np.arange(s + LONGEST, e, LONGEST) for s, e in zip(starts, ends[long])]))
    return ends


def name_of(body: bytes) -> bytes:
    return hashlib.blake2b(body, digest_size=NAME).digest()


def pack(chunks: list[tuple[bytes, bytes]]) -> bytes:
    """The body of a pack, of (name, compressed ids with their count in front)."""
    index = b"".join(n + struct.pack("<II", struct.unpack_from("<I", c)[0], len(c) - 4) for n, c in chunks)
    return _MAGIC + struct.pack("<I", len(chunks)) + index + b"".join(c[4:] for _, c in chunks)


def unpack(body: bytes) -> Iterator[tuple[bytes, np.ndarray]]:
    """(name, ids) of each chunk, verified against its name."""
    if body[:4] != _MAGIC:
        raise ValueError("not a pack of token ids")
    (count,), step = struct.unpack_from("<I", body, 4), NAME + 8
    at, inflate = 8 + count * step, zstandard.ZstdDecompressor()
    for k in range(count):
        name = body[8 + k * step : 8 + k * step + NAME]
        n, size = struct.unpack_from("<II", body, 8 + k * step + NAME)
        ids = _narrow(inflate.decompress(body[at : at + size], max_output_size=5 * n), n)
        if name_of(ids.tobytes()) != name:
            raise ValueError("a chunk doesn't match its name")
        at += size
        yield name, ids


def _widen(ids: np.ndarray) -> bytes:
    """Two bytes an id where that is enough."""
    return ids.astype("<u2").tobytes() if not len(ids) or ids.max() < 1 << 16 else ids.astype("<u4").tobytes()


def _narrow(body: bytes, n: int) -> np.ndarray:
    return np.frombuffer(body, "<u2" if len(body) == 2 * n else "<u4").astype("<u4")


# -- writing ----------------------------------------------------------------
STAGE_SCHEMA = "kind int, doc_id long, n_tokens long, names binary, name binary, body binary"


def _stage(docs: DataFrame, tokenizer: str, doc_id: str, text: str) -> DataFrame:
    """Chunks (kind 0) and recipes (kind 1) of each document, from one encoding of it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = LibraryEncoder.of(tokenizer)
        squeeze = zstandard.ZstdCompressor(level=1)
        sent: set[bytes] = set()
        for batch in batches:
            for a, b in slices(batch, "text", ENCODED_BYTES):
                part = batch.slice(a, b - a)
                ids, bounds = encoder.encode(part.column(1))
                # the end id after each document
                ids = np.insert(ids, bounds[1:], END_ID).astype("<u4")
                bounds = bounds + np.arange(len(bounds))
                flat = ids.tobytes()
                ends = chunk_ends(ids, bounds)
                if len(sent) > 500_000:
                    sent.clear()
                names, new_names, bodies = [], [], []
                for s, e in zip(np.concatenate([[0], ends[:-1]]).tolist(), ends.tolist()):
                    name = name_of(flat[4 * s : 4 * e])
                    names.append(name)
                    if name not in sent:
                        sent.add(name)
                        new_names.append(name)
                        bodies.append(struct.pack("<I", e - s) + squeeze.compress(_widen(ids[s:e])))
                sizes = np.diff(np.concatenate([[0], ends])).astype("<u4")
                cut = np.searchsorted(ends, bounds[1:], "right")
                before = np.concatenate([[0], cut[:-1]])
                recipes = [b"".join(names[i] + sizes[i].tobytes() for i in range(x, y)) for x, y in zip(before.tolist(), cut.tolist())]
                k, n = len(new_names), part.num_rows
                null = lambda m, kind: pa.nulls(m, kind)
                yield pa.RecordBatch.from_arrays([
                    pa.array([0] * k + [1] * n, pa.int32()),
                    pa.concat_arrays([null(k, pa.int64()), part.column(0)]),
                    pa.concat_arrays([null(k, pa.int64()), pa.array(np.diff(bounds), pa.int64())]),
                    pa.concat_arrays([null(k, pa.binary()), pa.array(recipes, pa.binary())]),
                    pa.concat_arrays([pa.array(new_names, pa.binary()), null(n, pa.binary())]),
                    pa.concat_arrays([pa.array(bodies, pa.binary()), null(n, pa.binary())]),
                ], ["kind", "doc_id", "n_tokens", "names", "name", "body"])

    return small_batches(docs).select(F.col(f"`{doc_id}`").cast("long").alias("doc_id"), F.col(f"`{text}`").alias("text")).mapInArrow(run, STAGE_SCHEMA)


def _packs(stage: DataFrame, parts: int) -> DataFrame:
    """Packs (kind 0) and recipes (kind 1).  Equal names lie side by side in a partition and are written once."""
    # a name is a hash, and a task sends it once; recipes are spread by id and content
    place = F.when(F.col("kind") == 0, F.xxhash64("name")).otherwise(F.xxhash64("doc_id", "names"))
    sorted_ = stage.withColumn("place", place).repartition(parts, "place").drop("place").sortWithinPartitions("kind", "name")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, held, size = b"", [], 0
        names = ["kind", "doc_id", "n_tokens", "names", "body"]

        def packed() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([0], pa.int32()), pa.nulls(1, pa.int64()), pa.nulls(1, pa.int64()), pa.nulls(1, pa.binary()), pa.array([pack(held)], pa.binary())], names)

        for batch in batches:
            chunk = batch.filter(pc.equal(batch.column(0), 0))
            for name, body in zip(chunk.column(4).to_pylist(), chunk.column(5).to_pylist()):
                if name == last:
                    continue
                last = name
                held.append((name, body))
                size += len(body)
                if size >= PACK_BYTES:
                    yield packed()
                    held, size = [], 0
            recipe = batch.filter(pc.equal(batch.column(0), 1))
            if recipe.num_rows:
                yield pa.RecordBatch.from_arrays([*[recipe.column(i) for i in (0, 1, 2, 3)], pa.nulls(recipe.num_rows, pa.binary())], names)
        if held:
            yield packed()

    return sorted_.mapInArrow(run, "kind int, doc_id long, n_tokens long, names binary, body binary")


def write_store(docs: DataFrame, path: str, tokenizer: str, doc_id: str = "doc_id", text: str = "text") -> None:
    """Writes the store of ``docs`` under ``path``, which must not exist yet."""
    spark = docs.sparkSession
    # what Spark takes the table for, by its files: a look at the texts would cost as much as a part of the work
    size = int(docs._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())
    parts = max(8, int(spark.conf.get("spark.sql.shuffle.partitions")), math.ceil(size / PART_BYTES) if size < UNKNOWN_BYTES else 0)
    _packs(_stage(docs, tokenizer, doc_id, text), parts).write.option("compression", "none").partitionBy("kind").parquet(f"{path}/content")
    recipes = _content(spark, path, 1).select("doc_id", "n_tokens", "names")
    recipes = recipes.repartitionByRange(parts, F.col("doc_id").asc_nulls_first(), "names").sortWithinPartitions(F.col("doc_id").asc_nulls_first(), "names")
    numbered = recipes.withColumn("part", F.spark_partition_id()).withColumn("row", F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1)))
    numbered.write.option("compression", "none").parquet(f"{path}/recipes")
    _leaves(spark.read.parquet(f"{path}/recipes")).write.parquet(f"{path}/manifest")
    spark.createDataFrame([(merkle_root(spark.read.parquet(f"{path}/manifest")),)], "root string").coalesce(1).write.parquet(f"{path}/root")


def _content(spark: SparkSession, path: str, kind: int) -> DataFrame:
    return spark.read.schema("doc_id long, n_tokens long, names binary, body binary, kind int").parquet(f"{path}/content").where(F.col("kind") == kind)


def _leaves(recipes: DataFrame) -> DataFrame:
    """A part's totals and the hash of its recipes in order."""
    line = F.sha2(F.concat(F.coalesce(F.col("doc_id").cast("string"), F.lit("null")).cast("binary"), F.concat(F.lit(":"), F.col("n_tokens").cast("string"), F.lit(":")).cast("binary"), F.col("names")), 256)
    summed = recipes.select("part", "row", "doc_id", "n_tokens", line.alias("line"))
    # rows of a part lie in one file: what is hashed is 64 letters a document, in blocks of rows
    block = summed.groupBy("part", F.shiftright("row", 12).alias("block")).agg(
        F.sha2(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("row", "line"))), lambda x: x["line"]), ""), 256).alias("leaf"),
        F.sum("n_tokens").alias("n_tokens"), F.count("*").alias("n_docs"), F.min("doc_id").alias("first_doc"), F.max("doc_id").alias("last_doc"))
    return block


def merkle_root(manifest: DataFrame) -> str:
    """The root over the parts' hashes, each the hash of the part's leaves in order; parts are few."""
    parts = manifest.groupBy("part").agg(F.sha2(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("block", "leaf"))), lambda x: x["leaf"]), ""), 256).alias("leaf"))
    level = [bytes.fromhex(r.leaf) for r in parts.orderBy("part").select("leaf").collect()] or [hashlib.sha256(b"").digest()]
    while len(level) > 1:
        level = [hashlib.sha256(b"".join(level[i : i + 2])).digest() for i in range(0, len(level), 2)]
    return level[0].hex()


# -- reading ----------------------------------------------------------------
def read_chunks(spark: SparkSession, path: str) -> DataFrame:
    """(name, n, ids as bytes) of every chunk, verified."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for body in batch.column(0):
                rows = [(n, len(x), x.tobytes()) for n, x in unpack(body.as_py())]
                yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.binary()), pa.array([r[1] for r in rows], pa.int64()), pa.array([r[2] for r in rows], pa.binary())], ["name", "n", "ids"])

    return _content(spark, path, 0).select("body").mapInArrow(run, "name binary, n long, ids binary")


def chunk_sums(spark: SparkSession, path: str) -> DataFrame:
    """(name, crc32 of its ids) of every chunk, verified; the ids stay where they were read."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for body in batch.column(0):
                rows = [(n, zlib.crc32(x.tobytes())) for n, x in unpack(body.as_py())]
                yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.binary()), pa.array([r[1] for r in rows], pa.int64())], ["name", "crc"])

    return _content(spark, path, 0).select("body").mapInArrow(run, "name binary, crc long")


def read_recipes(spark: SparkSession, path: str) -> DataFrame:
    """(part, row, doc_id, start, n_tokens, names), after the recipes were held against the manifest."""
    recipes = spark.read.parquet(f"{path}/recipes")
    manifest = spark.read.parquet(f"{path}/manifest")
    if spark.read.parquet(f"{path}/root").first()[0] != merkle_root(manifest):
        raise ValueError("the manifest doesn't match its root")
    again = _leaves(recipes).select("part", "block", F.col("leaf").alias("leaf_now"))
    odd = manifest.join(again, ["part", "block"], "full").where("leaf is distinct from leaf_now").limit(1).count()
    if odd:
        raise ValueError("recipes don't match the manifest")
    blocks = manifest.groupBy("part", "block").agg(F.sum("n_tokens").alias("tokens"))
    # two levels of running sums: over blocks of a part, and over parts, of which there are few
    per_part = blocks.groupBy("part").agg(F.sum("tokens").alias("tokens"))
    part_start = per_part.select("part", (F.sum("tokens").over(Window.orderBy("part")) - F.col("tokens")).alias("part_start"))
    block_start = blocks.select("part", "block", (F.sum("tokens").over(Window.partitionBy("part").orderBy("block")) - F.col("tokens")).alias("block_start"))
    in_block = Window.partitionBy("part", "block").orderBy("row")
    rows = recipes.withColumn("block", F.shiftright("row", 12)).withColumn("before", F.sum("n_tokens").over(in_block) - F.col("n_tokens"))
    rows = rows.join(block_start, ["part", "block"]).join(part_start, "part")
    return rows.select("part", "row", "doc_id", (F.col("part_start") + F.col("block_start") + F.col("before")).alias("start"), "n_tokens", "names")


def read_documents(spark: SparkSession, path: str) -> DataFrame:
    """(part, row, doc_id, start, n_tokens, ids as little-endian bytes): every document, put together from its chunks."""

    def entries(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names = [np.frombuffer(x, _ENTRY) for x in batch.column(2).to_pylist()]
            count = np.array([len(x) for x in names], np.int64)
            pick = pa.array(np.repeat(np.arange(len(count)), count))
            place = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pick), batch.column(1).take(pick), pa.array(place), pa.array([x.tobytes() for n in names for x in n["name"]], pa.binary())], ["part", "row", "place", "name"])

    recipes = read_recipes(spark, path)
    used = recipes.select("part", "row", "names").mapInArrow(entries, "part int, row long, place long, name binary")
    found = used.join(read_chunks(spark, path), "name", "left").groupBy("part", "row").agg(F.array_sort(F.collect_list(F.struct("place", "ids"))).alias("all"), F.count("*").alias("chunks"))
    body = F.aggregate("all", F.lit(b""), lambda a, x: F.concat(a, x["ids"]))
    whole = recipes.drop("names").join(found.select("part", "row", body.alias("ids")), ["part", "row"])
    broken = F.raise_error(F.lit("a document isn't as long as its recipe says"))
    return whole.withColumn("ids", F.when(F.octet_length("ids") == 4 * F.col("n_tokens"), F.col("ids")).otherwise(broken.cast("binary")))


# -- checksums of documents from those of chunks ------------------------------
_POLY = 0xEDB88320


def _times(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Product of bit-reflected polynomials modulo the CRC-32 polynomial."""
    out = np.zeros(len(a), np.uint64)
    b = b.copy()
    for k in range(31, -1, -1):
        out ^= np.where((a >> U64(k)) & U64(1) > 0, b, U64(0))
        b = np.where(b & U64(1) > 0, (b >> U64(1)) ^ U64(_POLY), b >> U64(1))
    return out


def shifted(crc: np.ndarray, tail: np.ndarray) -> np.ndarray:
    """What a chunk's CRC-32 adds to that of a stream in which ``tail`` bytes follow the chunk.

    The CRC-32 of a concatenation is the exclusive or of these terms.
    """
    x = crc.astype(np.uint64)
    power = np.array([1 << 23], np.uint64)  # x**8, reflected
    tail = tail.astype(np.uint64)
    while len(tail) and tail.any():
        odd = np.flatnonzero(tail & U64(1))
        x[odd] = _times(x[odd], np.repeat(power, len(odd)))
        power = _times(power, power)
        tail = tail >> U64(1)
    return x


def document_sums(spark: SparkSession, path: str) -> DataFrame:
    """(part, row, doc_id, start, n_tokens, crc): what the files hold of each document."""

    def entries(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names = [np.frombuffer(x, _ENTRY) for x in batch.column(3).to_pylist()]
            count = np.array([len(x) for x in names], np.int64)
            if not count.sum():
                continue
            whole = np.concatenate(names)
            n = whole["n"].astype(np.int64)
            last = np.repeat(np.cumsum(count), count) - 1
            tail = np.cumsum(n)[last] - np.cumsum(n)
            pick = pa.array(np.repeat(np.arange(len(count)), count))
            out = [batch.column(i).take(pick) for i in (0, 1)]
            yield pa.RecordBatch.from_arrays([*out, pa.array([x.tobytes() for x in whole["name"]], pa.binary()), pa.array(4 * tail, pa.int64())], ["part", "row", "name", "tail"])

    def terms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.column(2).null_count:
                raise ValueError("a recipe names a chunk that isn't there")
            x = shifted(batch.column(2).to_numpy(), batch.column(3).to_numpy())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(x.astype(np.int64), pa.int64())], ["part", "row", "term"])

    recipes = read_recipes(spark, path)
    used = spark.read.parquet(f"{path}/recipes").select("part", "row", "doc_id", "names").mapInArrow(entries, "part int, row long, name binary, tail long")
    joined = used.join(chunk_sums(spark, path), "name", "left").select("part", "row", "crc", "tail")
    sums = joined.mapInArrow(terms, "part int, row long, term long").groupBy("part", "row").agg(F.expr("bit_xor(term)").alias("crc"))
    return recipes.drop("names").join(sums, ["part", "row"])
