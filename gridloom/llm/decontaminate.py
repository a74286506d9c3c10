"""Benchmark decontamination by spaced seeds.

A seed is a mask over consecutive words of which only the marked positions are
hashed, so a substituted word under an unmarked position doesn't hide a match.
Benchmark items are hashed at every position with every mask; documents are
hashed the same way, and a document's position whose hash an item has is a hit.
A hit fixes a diagonal (position in the document minus position in the item);
along it the words are compared one by one (by 64-bit hashes of them), and of all
segments that are long and similar enough the one with most equal words (then the
shortest, then the first) is the overlap.

The six masks hit every segment of 10 equal words among 14 or fewer, whatever the
places of the others.  Where words repeat, hits are counted before they are spelled
out: a document and an item with more hits than a few for each diagonal are compared
along all their diagonals, so work grows with the product of their lengths at most.

Documents aren't shuffled: the items' hashes go to the documents, in blocks of
a bounded number of seeds, whatever the size of the benchmark.

Defined results: one row for each document row and item that overlap, with the
best overlap; equal rows give equal results each, and so do equal items; an item of
fewer words than an overlap needs overlaps if all its words stand in succession; null
or empty texts, and items or texts of fewer words than the narrowest mask is wide (7),
overlap with nothing; null ids are passed through; of the documents only id and text
are read, so other columns can't clash; a long text is compared as a whole; empty
tables give no rows.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .batches import small_batches
from .textcore import LOWER, U64, joined_bytes, member, mix, slices, word_bounds, word_hashes

#: Fixed masks: 1 is hashed, 0 is ignored.
MASKS = ("1101011", "1110000011", "10100010011", "11001000011", "110110001", "1001111")
#: An overlap has at least so many equal words, and this share of equal words.
LEAST_EQUAL, LEAST_SHARE = 10, 0.7
#: Seeds that are sent to executors at a time (16 bytes each).
BLOCK_SEEDS = 1 << 22
#: Hits of a document and an item for each of their diagonals beyond which all diagonals are compared.
HITS_EACH = 4
#: Words that are compared at a time.
STEP_WORDS = 1 << 20
#: Bytes that aren't part of a word: ASCII but for digits and letters.
BREAKS = np.array([b < 0x30 or 0x39 < b < 0x41 or 0x5A < b < 0x61 or 0x7A < b < 0x80 for b in range(256)])
_FACTORS = np.array([pow(0xD1342543DE82EF95, k + 1, 1 << 64) for k in range(64)], U64)


def words_of(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words, A-Z lower-cased, and the documents' bounds in words."""
    buf, bounds = joined_bytes(column)
    buf = LOWER[buf]
    start, end, in_words = word_bounds(buf, bounds, BREAKS)
    return word_hashes(buf, start, end), in_words


def seeds(words: np.ndarray, room: np.ndarray, mask: str, number: int) -> tuple[np.ndarray, np.ndarray]:
    """Positions with room for the mask, and their hashes."""
    n = len(words) - len(mask) + 1
    if n <= 0:
        return np.zeros(0, np.int64), np.zeros(0, U64)
    h = np.full(n, number + 1, U64)
    for k, bit in enumerate(mask):
        if bit == "1":
            h += words[k : k + n] * _FACTORS[k]
    at = np.flatnonzero(room[:n] >= len(mask))
    return at, mix(h[at])


class Benchmark:
    """Items' words and sorted seeds."""

    def __init__(self, ids: list, texts: list):
        self.ids = ids
        self.words, self.bounds = words_of(pa.array(texts, pa.string()))
        room = np.repeat(self.bounds[1:], np.diff(self.bounds)) - np.arange(len(self.words))
        found = [seeds(self.words, room, m, k) for k, m in enumerate(MASKS)]
        at, h = (np.concatenate(x) for x in zip(*found))
        item = np.repeat(np.arange(len(ids)), np.diff(self.bounds))
        order = np.lexsort((at, item[at], h))
        self.seeds, self.at, self.item = h[order], at[order], item[at[order]]
        #: groups of equal seeds of one item: first entry of each and, in the end, their number
        self.group = _edges(self.seeds, self.item)


def _edges(*columns: np.ndarray) -> np.ndarray:
    """Where a run of equal rows begins, and the number of rows."""
    n = len(columns[0])
    new = np.ones(n + 1, bool)
    new[1:n] = np.logical_or.reduce([c[1:] != c[:-1] for c in columns]) if n > 1 else False
    return np.flatnonzero(new) if n else np.zeros(1, np.int64)


def _spread(size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rows repeated by their size, and the place of each among its copies."""
    row = np.repeat(np.arange(len(size)), size)
    return row, np.arange(len(row)) - np.repeat(np.cumsum(size) - size, size)


def best_segment(equal: np.ndarray, least_equal: int, least_share: float) -> tuple[int, int] | None:
    """Begin and end of the segment with most equal words among those with at least ``least_equal`` of them and
    the share ``least_share``; of such segments the shortest, then the first.  None if no segment is enough."""
    share = Fraction(str(least_share))
    # a segment has the share if its score isn't negative; whole numbers, so the limit itself is exact
    score = np.concatenate([[0], np.cumsum(np.where(equal, share.denominator - share.numerator, -share.numerator))])
    count = np.concatenate([[0], np.cumsum(equal)])
    place = np.flatnonzero(equal)
    if not len(place):
        return None
    end = place + 1
    # the first begin whose score isn't above that of the end, moved on to an equal word
    begin = np.searchsorted(-np.minimum.accumulate(score), -score[end], "left")
    n_equal = count[end] - count[begin]
    good = np.flatnonzero(n_equal >= max(1, least_equal))
    if not len(good):
        return None
    begin = place[count[begin[good]]]
    k = np.lexsort((begin, end[good] - begin, -n_equal[good]))[0]
    return int(begin[k]), int(end[good][k])


def diagonals(words: np.ndarray, bounds: np.ndarray, bench: Benchmark, least: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(document, item, shift) of all diagonals that have to be compared, each once."""
    doc_of = np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))
    room = bounds[1:][doc_of] - np.arange(len(words))
    found = []
    for k, mask in enumerate(MASKS):
        at, h = seeds(words, room, mask, k)
        hit = np.flatnonzero(member(h, bench.seeds))
        found.append((at[hit], h[hit]))
    at, h = (np.concatenate(x) for x in zip(*found))
    none = np.zeros(0, np.int64)
    if not len(at):
        return none, none, none
    doc = doc_of[at]
    order = np.lexsort((at, doc, h))
    at, h, doc = at[order], h[order], doc[order]
    mine = _edges(h, doc)
    size, theirs = np.diff(mine), np.diff(bench.group)
    # a document's equal seeds meet those of each item as groups
    seed = bench.seeds[bench.group[:-1]]
    lo, hi = np.searchsorted(seed, h[mine[:-1]], "left"), np.searchsorted(seed, h[mine[:-1]], "right")
    a, k = _spread(hi - lo)
    b = lo[a] + k
    d, i = doc[mine[a]], bench.item[bench.group[b]]
    pair, which = np.unique(d * len(bench.ids) + i, return_inverse=True)
    d_of, i_of = pair // len(bench.ids), pair % len(bench.ids)
    n, m = np.diff(bounds)[d_of], np.diff(bench.bounds)[i_of]
    hits = np.bincount(which, size[a] * theirs[b])
    many = hits > HITS_EACH * (n + m)
    few = np.flatnonzero(~many[which])
    row, k = _spread(size[a[few]] * theirs[b[few]])
    x, y = a[few][row], b[few][row]
    p, q = mine[x] + k // theirs[y], bench.group[y] + k % theirs[y]
    shift = (at[p] - bounds[doc[p]]) - (bench.at[q] - bench.bounds[bench.item[q]])
    width = int((n + m).max()) + 1
    key = [np.unique(which[few][row] * (2 * width) + shift + width)]
    whole = np.flatnonzero(many)
    need = np.minimum(np.minimum(n, m), least)[whole]  # a diagonal of fewer words can't hold an overlap
    row, k = _spread(np.maximum(n[whole] + m[whole] - 2 * need + 1, 0))
    key.append(whole[row] * (2 * width) + (need - m[whole])[row] + k + width)
    key = np.concatenate(key)
    pair = key // (2 * width)
    return d_of[pair], i_of[pair], key % (2 * width) - width


def overlaps(words: np.ndarray, bounds: np.ndarray, bench: Benchmark, least_equal: int, least_share: float) -> list[tuple]:
    """(document, item, equal words, compared words, first word in document, first word in item)."""
    doc, item, shift = diagonals(words, bounds, bench, least_equal)
    lo = np.maximum(0, -shift)
    size = np.minimum(np.diff(bench.bounds)[item], np.diff(bounds)[doc] - shift) - lo
    need = np.minimum(least_equal, np.diff(bench.bounds)[item])
    in_doc, in_item = bounds[doc] + shift + lo, bench.bounds[item] + lo
    best: dict[tuple, tuple] = {}
    upto = np.cumsum(size)
    first = 0
    while first < len(size):
        last = max(first + 1, int(np.searchsorted(upto, upto[first] - size[first] + STEP_WORDS, "right")))
        row, k = _spread(size[first:last])
        equal = words[in_doc[first:last][row] + k] == bench.words[in_item[first:last][row] + k]
        edge = np.concatenate([[0], np.cumsum(size[first:last])])
        count = np.concatenate([[0], np.cumsum(equal)])[edge]
        for j in np.flatnonzero(np.diff(count) >= need[first:last]).tolist():
            r = first + j
            if segment := best_segment(equal[edge[j] : edge[j + 1]], int(need[r]), least_share):
                begin, end = segment
                got = (int(equal[edge[j] + begin : edge[j] + end].sum()), end - begin, int(lo[r] + begin + shift[r]), int(lo[r] + begin))
                key = (int(doc[r]), int(item[r]))
                if key not in best or (-got[0], *got[1:]) < (-best[key][0], *best[key][1:]):
                    best[key] = got
        first = last
    return [(*key, *row) for key, row in sorted(best.items())]


def _blocks(benchmark: DataFrame, item_id: str, text: str) -> Iterator[Benchmark]:
    """The benchmark in blocks of about BLOCK_SEEDS seeds at most."""
    items = benchmark.select(F.col(f"`{item_id}`").cast("long").alias("id"), F.coalesce(F.col(f"`{text}`"), F.lit("")).alias("text"))
    letters = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n = max(1, math.ceil(letters / 2 * len(MASKS) / BLOCK_SEEDS))  # a word has two bytes at least, with its space
    for k in range(n):
        part = items.where(F.pmod(F.xxhash64("id", "text"), F.lit(n)) == k) if n > 1 else items
        rows = part.collect()
        if rows:
            yield Benchmark([r.id for r in rows], [r.text for r in rows])


def find_overlaps(docs: DataFrame, benchmark: DataFrame, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "text", least_equal: int = LEAST_EQUAL, least_share: float = LEAST_SHARE) -> DataFrame:
    """(doc_id, item_id, n_equal, n_compared, doc_word, item_word, share) of all overlaps."""
    schema = "doc_id long, item_id long, n_equal long, n_compared long, doc_word long, item_word long, share double"
    narrow = small_batches(docs).select(F.col(f"`{doc_id}`").cast("long").alias("doc_id"), F.col(f"`{text}`").alias("text"))
    out = docs.sparkSession.createDataFrame([], schema)
    for bench in _blocks(benchmark, item_id, item_text):
        shared = docs.sparkSession.sparkContext.broadcast(bench)

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            bench = shared.value
            for batch in batches:
                for a, b in slices(batch, "text"):
                    part = batch.slice(a, b - a)
                    rows = overlaps(*words_of(part.column(1)), bench, least_equal, least_share)
                    col = list(zip(*rows)) if rows else [()] * 6
                    yield pa.RecordBatch.from_arrays([
                        part.column(0).take(pa.array(col[0], pa.int64())),
                        pa.array([bench.ids[i] for i in col[1]], pa.int64()),
                        *[pa.array(c, pa.int64()) for c in col[2:]],
                        pa.array([m / n for m, n in zip(col[2], col[3])], pa.float64()),
                    ], ["doc_id", "item_id", "n_equal", "n_compared", "doc_word", "item_word", "share"])

        out = out.unionByName(narrow.mapInArrow(run, schema))
    return out


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, text: str = "text", item_id: str = "item_id", item_text: str = "text", least_equal: int = LEAST_EQUAL, least_share: float = LEAST_SHARE) -> DataFrame:
    """``docs`` without the rows that overlap with an item; all columns as they are."""
    small_batches(docs)
    for bench in _blocks(benchmark, item_id, item_text):
        shared = docs.sparkSession.sparkContext.broadcast(bench)

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for a, b in slices(batch, text):
                    part = batch.slice(a, b - a)
                    column = part.column(part.schema.get_field_index(text))
                    bad = {r[0] for r in overlaps(*words_of(column), shared.value, least_equal, least_share)}
                    yield part.filter(pa.array([i not in bad for i in range(part.num_rows)], pa.bool_())) if bad else part

        docs = docs.mapInArrow(run, docs.schema)
    return docs
