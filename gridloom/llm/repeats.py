"""Which windows of fixed width start more than once in a corpus.

Both removal operators (words, bytes) ask the same question; only the symbols,
the width and the way equal windows are found differ.  Rows are dealt to
*blocks* by their place, so rows that are alike don't pile up in one; a block is the unit of
Python work, and a partition holds many of them.

1. **Pieces.**  Every window holds the least of its gram hashes.  Consecutive
   windows whose least gram stands at the same place make a piece of text, one for about ``w / 2``
   windows.  Windows can be equal only if their pieces have the same gram, and
   inside a repeat the pieces themselves are equal: then all their windows are
   repeated and none needs a look-up.
2. **Windows.**  Where a gram stands in different pieces, near the ends of
   repeats, each of these pieces is spelled out as windows, by one block only.
3. **Marking.**  Each block gets back which of its pieces and windows are repeated.

Python sends a piece or window once for each block, whatever the number of copies, so a
passage in a third of all documents weighs one entry a block.  Pieces count as equal only if
the hash of their gram and a BLAKE2 digest of their symbols agree.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .batches import small_batches
from .textcore import NO_GRAM, U64, member, mix, prefix_hash, range_hash, room, slices, sliding

BLOCK = "__block"
BLOCK_BYTES = 2 << 20
LEAST_BLOCKS = 16
#: Bytes of text that a partition holds, at most about: many blocks.
PARTITION_BYTES = 1 << 30
RUN_SCHEMA = "part int, block int, run binary"
#: value: 63 bits of hash, then one bit that says "more than once in this block".
RUN = np.dtype([("value", "<u8"), ("check", "<u8")])
#: A piece: its gram (and such a bit), and the hash of its text.
PIECE = np.dtype([("value", "<u8"), ("check", "<u8")])
#: What a block is told of a piece: that it is repeated, that the block has to spell it out.
TOLD_PIECE = np.dtype([("value", "<u8"), ("check", "<u8"), ("flags", "<u1")])
REPEATED, SPELL = 1, 2
ONE = U64(1)


def in_blocks(docs: DataFrame, text: str) -> tuple[DataFrame, int]:
    """``docs`` with a block number, dealt out by it; rows that are alike spread over the blocks."""
    small_batches(docs)
    total = docs.agg(F.sum(F.octet_length(F.col(f"`{text}`")))).first()[0] or 0
    n = max(LEAST_BLOCKS, math.ceil(total / BLOCK_BYTES))
    parts = min(n, max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), math.ceil(total / PARTITION_BYTES)))
    return docs.withColumn(BLOCK, F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(n)).cast("int")).repartition(parts, BLOCK), n


def digests(body: bytes, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
    """64 bits of the BLAKE2 digests of ``body[begin[i]:end[i]]``."""
    blake = hashlib.blake2b
    return np.frombuffer(b"".join([blake(body[i:j], digest_size=8).digest() for i, j in zip(begin.tolist(), end.tolist())]), "<u8").astype(U64)


@dataclass(frozen=True)
class Windows:
    """Windows of ``width`` symbols.  ``symbols`` makes of an Arrow slice (values, bounds, hash powers, bytes,
    first byte of each symbol, byte behind it)."""

    text: str
    width: int
    gram: int
    symbols: Callable
    group: Callable | None = None  # (slice state, starts) -> RUN array of the distinct windows at these starts
    find: Callable | None = None  # runs of one value range -> for each run, which of its entries are repeated

    # -- one slice of a block ------------------------------------------------
    def state(self, part: pa.Table) -> dict:
        values, bounds, powers, body, first, last = self.symbols(part.column(self.text))
        return {"values": values, "bounds": bounds, "powers": powers, "hash": prefix_hash(values, powers), "room": room(bounds), "body": body, "first": first, "last": last}

    def pieces(self, s: dict, known: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """First and last window (exclusive) of each piece, and its PIECE entry; only those whose gram is
        ``known``, if that is given (ascending)."""
        n, k = len(s["values"]), self.gram
        g = np.full(n, NO_GRAM, U64)
        at = np.flatnonzero(s["room"] >= k)
        g[at] = mix(range_hash(s["hash"], at, at + k, s["powers"])) & ~ONE
        # the place of the leftmost least gram: its high bits, then its place, are minimised together
        bits = U64(max(1, n.bit_length()))
        key = np.full(n, NO_GRAM, U64)
        key[at] = (g[at] >> bits << bits) | at.astype(U64)
        least = (sliding(np.minimum, key, self.width - k + 1, NO_GRAM) & ((ONE << bits) - ONE)).astype(np.int64)
        full = np.zeros(n + 2, bool)
        full[1:-1] = s["room"] >= self.width
        change = np.ones(n + 1, bool)
        change[1:-1] = least[1:] != least[:-1]
        lo = np.flatnonzero(full[1:] & (change | ~full[:-1]))
        hi = np.flatnonzero(full[:-1] & (change | ~full[1:]))
        value = g[least[lo]]
        if known is not None:
            some = member(value, known)
            lo, hi, value = lo[some], hi[some], value[some]
        out = np.empty(len(lo), PIECE)
        out["value"], out["check"] = value, self.digest(s, lo, hi - 1 + self.width)
        return lo, hi, out

    def digest(self, s: dict, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
        """Of the bytes of symbols ``lo`` to ``hi`` (exclusive)."""
        return digests(s["body"], s["first"][lo], s["last"][hi - 1])

    def prints(self, s: dict, at: np.ndarray) -> np.ndarray:
        """RUN entries of the windows at ``at``, in that order."""
        out = np.empty(len(at), RUN)
        out["value"] = self.window_hashes(s, at) & ~ONE
        out["check"] = self.digest(s, at, at + self.width)
        return out

    def window_hashes(self, s: dict, at: np.ndarray) -> np.ndarray:
        return mix(range_hash(s["hash"], at, at + self.width, s["powers"]))

    # -- the passes ----------------------------------------------------------
    def mark(self, docs: DataFrame, finish: Callable, schema: str) -> DataFrame:
        """``finish(slice table, state, repeated starts)`` yields the rows of ``schema``."""
        docs, n = in_blocks(docs, self.text)
        parts = n
        whole = self

        def pieces(table: pa.Table) -> pa.Table:
            run = merged([merged([whole.pieces(s)[2]], PIECE) for s, _ in whole.walk(table)], PIECE)
            return cut(run, int(table.column(BLOCK)[0].as_py()), parts)

        def windows(key: tuple, left: pa.Table, right: pa.Table) -> pa.Table:
            spell = told_pieces(right, lambda flags: flags & SPELL > 0)
            out = []
            for s, _ in whole.walk(left) if len(spell) else ():
                lo, hi, piece = whole.pieces(s, spell["value"])
                hit = in_run(piece, spell)
                out.append(whole.group(whole, s, spans(lo[hit], hi[hit])))
            return cut(merged(out), int(left.column(BLOCK)[0].as_py()) if left.num_rows else 0, parts)

        def last(key: tuple, left: pa.Table, right: pa.Table) -> pa.Table:
            known = told_pieces(right, lambda flags: flags & REPEATED > 0)
            spelt = told_pieces(right, lambda flags: flags == SPELL)
            hits = told_windows(right)
            told_of = np.unique(np.concatenate([known["value"], spelt["value"]]))
            done = []
            for s, part in whole.walk(left):
                starts = np.zeros(0, np.int64)
                if len(known) or len(hits):
                    lo, hi, piece = whole.pieces(s, told_of)
                    hit, look = in_run(piece, known), in_run(piece, spelt)
                    at = spans(lo[look], hi[look])
                    starts = np.sort(np.concatenate([spans(lo[hit], hi[hit]), at[in_run(whole.prints(s, at), hits)]]))
                done.append(finish(part, s, starts))
            return pa.concat_tables(done) if done else empty

        empty = pa.schema(_arrow(schema)).empty_table()
        by_block = docs.groupBy(BLOCK)
        first = by_block.applyInArrow(pieces, RUN_SCHEMA).groupBy("part").applyInArrow(lambda t: answer_pieces(t), TOLD_SCHEMA)
        second = by_block.cogroup(first.groupBy("block")).applyInArrow(windows, RUN_SCHEMA).groupBy("part").applyInArrow(lambda t: answer_windows(t, whole.find), TOLD_SCHEMA)
        return by_block.cogroup(first.unionByName(second).groupBy("block")).applyInArrow(last, schema)

    def walk(self, table: pa.Table) -> Iterator[tuple[dict, pa.Table]]:
        for a, b in slices(table, self.text):
            part = table.slice(a, b - a)
            yield self.state(part), part


def _runs(table: pa.Table, kind: np.dtype) -> tuple[list[int], list[np.ndarray]]:
    return table.column("block").to_pylist(), [np.frombuffer(x, kind) for x in table.column("run").to_pylist()]


def answer_pieces(table: pa.Table) -> pa.Table:
    """Tells each block which of its pieces in this value range are repeated or have to be spelled out."""
    blocks, runs = _runs(table, PIECE)
    x = np.concatenate(runs)
    whose = np.repeat(np.arange(len(runs)), [len(r) for r in runs])
    order = np.lexsort((whose, x["check"], x["value"] >> ONE))
    x, whose = x[order], whose[order]
    fresh = ~same_as_before(x)
    first = np.flatnonzero(fresh)
    gram = x["value"][first] >> ONE
    new_gram = np.append(True, gram[1:] != gram[:-1])
    pieces_of_gram = np.diff(np.append(np.flatnonzero(new_gram), len(first)))
    varied = np.repeat(pieces_of_gram > 1, pieces_of_gram)
    count = np.diff(np.append(first, len(x)))
    many = (count > 1) | (np.bitwise_or.reduceat(x["value"] & ONE, first) > 0)
    flags = np.repeat(many * REPEATED, count).astype(np.uint8)
    flags[first[varied]] |= SPELL
    out = np.empty(len(x), TOLD_PIECE)
    out["value"], out["check"], out["flags"] = x["value"] & ~ONE, x["check"], flags
    keep = np.flatnonzero(flags)
    keep = keep[np.argsort(whose[keep], kind="stable")]
    edge = np.searchsorted(whose[keep], np.arange(len(runs) + 1))
    return _told([(b, PIECES_TOLD, out[keep[i:j]].tobytes()) for b, i, j in zip(blocks, edge[:-1], edge[1:], strict=True) if j > i])


def answer_windows(table: pa.Table, find: Callable) -> pa.Table:
    """Tells each block which windows of its run in this value range occur more than once."""
    blocks, runs = _runs(table, RUN)
    rows = []
    for block, run, hit in zip(blocks, runs, find(runs), strict=True):
        if hit.any():
            found = run[hit]
            found["value"] &= ~ONE
            rows.append((block, WINDOWS_TOLD, found.tobytes()))
    return _told(rows)


PIECES_TOLD, WINDOWS_TOLD = 0, 1
TOLD_SCHEMA = "block int, kind int, told binary"


def _told(rows: list) -> pa.Table:
    return pa.table({
        "block": pa.array([r[0] for r in rows], pa.int32()),
        "kind": pa.array([r[1] for r in rows], pa.int32()),
        "told": pa.array([r[2] for r in rows], pa.binary()),
    })


def told(table: pa.Table, kind: int, entry: np.dtype) -> np.ndarray:
    got = [np.frombuffer(t, entry) for k, t in zip(table.column("kind").to_pylist(), table.column("told").to_pylist(), strict=True) if k == kind]
    return np.concatenate(got) if got else np.zeros(0, entry)


def told_pieces(table: pa.Table, which: Callable) -> np.ndarray:
    x = told(table, PIECES_TOLD, TOLD_PIECE)
    x = x[which(x["flags"])]
    return x[np.lexsort((x["check"], x["value"]))]


def told_windows(table: pa.Table) -> np.ndarray:
    x = told(table, WINDOWS_TOLD, RUN)
    return x[np.lexsort((x["check"], x["value"]))]


def spans(lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
    """All numbers of the ranges ``lo[i]:hi[i]``."""
    size = hi - lo
    if not len(size):
        return np.zeros(0, np.int64)
    return np.arange(size.sum()) + np.repeat(lo - (np.cumsum(size) - size), size)


def _arrow(schema: str) -> list:
    from pyspark.sql.pandas.types import to_arrow_type
    from pyspark.sql.types import StructType

    return [pa.field(f.name, to_arrow_type(f.dataType)) for f in StructType.fromDDL(schema)]


def part_edges(run: np.ndarray, parts: int) -> np.ndarray:
    return np.searchsorted(run["value"] >> U64(40), (np.arange(parts + 1, dtype=U64) << U64(24)) // U64(parts))


def cut(run: np.ndarray, block: int, parts: int) -> pa.Table:
    """One row for each value range of a sorted run."""
    edges = part_edges(run, parts)
    some = np.flatnonzero(np.diff(edges))
    return pa.table({
        "part": pa.array(some, pa.int32()),
        "block": pa.array(np.full(len(some), block), pa.int32()),
        "run": pa.array([run[edges[i] : edges[i + 1]].tobytes() for i in some], pa.binary()),
    })


def merged(runs: list[np.ndarray], kind: np.dtype = RUN) -> np.ndarray:
    """One sorted run of distinct entries; the low bit is set where an entry occurs more than once."""
    runs = [r for r in runs if len(r)]
    if not runs:
        return np.zeros(0, kind)
    x = np.concatenate(runs)
    x = x[np.lexsort((x["check"], x["value"] >> ONE))]
    return distinct(x)


def repeated(runs: list[np.ndarray]) -> list[np.ndarray]:
    """For each sorted run, which of its entries occur more than once in all of them."""
    whole = merged(runs)
    many = whole[(whole["value"] & ONE) > 0].copy()
    many["value"] &= ~ONE
    out = []
    for run in runs:
        bare = run.copy()
        bare["value"] &= ~ONE
        out.append(in_run(bare, many))
    return out


def same_as_before(x: np.ndarray) -> np.ndarray:
    same = np.zeros(len(x), bool)
    same[1:] = ((x["value"][1:] ^ x["value"][:-1]) <= 1) & (x["check"][1:] == x["check"][:-1])
    return same


def distinct(x: np.ndarray) -> np.ndarray:
    if not len(x):
        return x
    first = np.flatnonzero(~same_as_before(x))
    many = np.bitwise_or.reduceat(x["value"] & ONE, first) | (np.diff(np.append(first, len(x))) > 1).astype(U64)
    out = x[first].copy()
    out["value"] = (out["value"] & ~ONE) | many
    return out


def in_run(x: np.ndarray, run: np.ndarray) -> np.ndarray:
    """Which entries are in a sorted run: both hashes must agree."""
    values = run["value"] & ~ONE
    out = np.zeros(len(x), bool)
    at = np.flatnonzero(member(x["value"], values))
    value, check = x["value"][at], x["check"][at]
    lo, end = np.searchsorted(values, value, "left"), np.searchsorted(values, value, "right")
    hi = end.copy()
    while (open_ := np.flatnonzero(lo < hi)).size:  # entries of one value stand by their check
        mid = (lo[open_] + hi[open_]) >> 1
        below = run["check"][mid] < check[open_]
        lo[open_] = np.where(below, mid + 1, lo[open_])
        hi[open_] = np.where(below, hi[open_], mid)
    ok = np.flatnonzero(lo < end)
    out[at[ok]] = run["check"][lo[ok]] == check[ok]
    return out


def covered(starts: np.ndarray, width: int, n: int) -> np.ndarray:
    """Which of ``n`` symbols lie in a window that begins at one of the ascending ``starts``."""
    edge = np.zeros(n + 1, np.int32)
    if len(starts):
        far = np.append(np.diff(starts) > width, True)
        begin = starts[np.append(True, far[:-1])]
        np.add.at(edge, begin, 1)
        np.add.at(edge, starts[far] + width, -1)
    return np.cumsum(edge[:n]) > 0
