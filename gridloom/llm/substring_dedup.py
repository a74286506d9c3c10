"""Removal of word passages that occur more than once (log-structured fingerprint index).

A window is ``width`` consecutive words (``[^\\x20\\x09-\\x0D]+``, unchanged) of one
document.  Each word covered by a window that also starts anywhere else, in the
same document, another one, or one of an index's history, is removed.  Windows are judged on
the input, so the result doesn't depend on an order of documents.

A table goes through a ``FingerprintIndex``.  Its documents are put in blocks and the blocks in batches; each batch's pieces
are added to an index of the table's own as a sorted run, and runs are merged level by level.  Then every block is judged
by the totals: its pieces are joined with those that are repeated.  Where a gram stands in different pieces, one block spells the
windows of each.  An index of earlier tables (``index``) is merged with the totals; ``ingest`` adds a table to it for the next one.

Defined results: a null or empty text has no words and comes back as an empty
text; a text of fewer words than ``width`` is kept whole; equal rows count as
separate documents (both lose what they share); null ids and all other columns are passed
through, but for columns with the names of results, which are replaced; a long text is cut by no bound but its own; an empty table gives no rows.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from itertools import compress

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import scratch
from . import repeats
from .batches import give_back, small_batches, tidy
from .fingerprint_index import ENTRIES, HISTORY, LASTING, SPELLED, FingerprintIndex, bucketed, most_buckets, told_pieces, told_windows
from .repeats import BLOCK, ONE, PIECE, Windows, covered, in_run, merged, spans
from .textcore import U64, WORD_POWERS, joined_bytes, slices, word_bounds, word_hashes

WIDTH, GRAM = 35, 16
#: Batches that a table is cut into, and bytes of text in a bucket of blocks, at most about.
BATCHES, BUCKET_BYTES, LEAST_BUCKETS = 8, 16 << 20, 16
TASK, BATCH = "__task", "__batch"
_WORD = re.compile(rb"[^\x20\x09-\x0D]+")


def without(raw: bytes, cut: list[tuple[int, int]]) -> bytes:
    """``raw`` without runs of words (first, last).  A run goes with the white space behind it; if that holds line ends, a run that
    begins its line goes with them and its own indentation, another leaves them.  All else stays as it is."""
    words = [m.span() for m in _WORD.finditer(raw)]
    out, at = [], 0
    for first, last in cut:
        begin, end = words[first][0], words[last][1]
        before = raw.rfind(b"\n", words[first - 1][1] if first else 0, begin) + 1
        until = words[last + 1][0] if last + 1 < len(words) else len(raw)
        behind = raw.rfind(b"\n", end, until) + 1
        if not behind:
            end = until
        elif before or not first:
            begin, end = before, behind
        out.append(raw[at:begin])
        at = end
    return b"".join([*out, raw[at:]])


def word_symbols(column: pa.ChunkedArray) -> tuple:
    """Words, and a body in which they are joined by one space."""
    buf, bounds = joined_bytes(column)
    start, end, in_words = word_bounds(buf, bounds)
    last = np.cumsum(end - start + 1) - 1
    first = last - (end - start)
    body = np.full(int(last[-1]) + 1 if len(last) else 0, 0x20, np.uint8)
    body[spans(first, last)] = buf[spans(start, end)]
    return word_hashes(buf, start, end), in_words, WORD_POWERS, body.tobytes(), first, last


def _signed(x: np.ndarray) -> pa.Array:
    return pa.array(np.ascontiguousarray(x).view(np.int64))


def _entry(table: pa.Table, value: str, check: str) -> np.ndarray:
    """Rows as ascending PIECE entries."""
    out = np.empty(table.num_rows, PIECE)
    out["value"] = table.column(value).to_numpy().view(U64) << ONE
    out["check"] = table.column(check).to_numpy().view(U64)
    return out[np.lexsort((out["check"], out["value"]))]


def _windows_of(windows: Windows, s: dict, lo: np.ndarray, hi: np.ndarray, piece: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts of the windows of pieces, and their PIECE entries: the gram, and the window's hash as check."""
    at = spans(lo, hi)
    out = np.empty(len(at), PIECE)
    out["value"], out["check"] = np.repeat(piece["value"], hi - lo), windows.window_hashes(s, at)
    return at, out


def in_batches(docs: DataFrame, text: str, folder: str) -> tuple[DataFrame, int]:
    """``docs`` with the number of a block (a slice of what a task reads), stored by batch and in buckets of the task, and the number of
    buckets.  A task writes one file; blocks are grouped without an exchange."""
    size = small_batches(docs).agg(F.sum(F.octet_length(F.col(f"`{text}`")))).first()[0] or 0
    buckets = min(max(LEAST_BUCKETS, math.ceil(size / BUCKET_BYTES)), most_buckets(docs.sparkSession))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, number = TaskContext.get().partitionId(), 0
        for batch in batches:
            for a, b in slices(batch, text, repeats.BLOCK_BYTES):
                part = batch.slice(a, b - a)
                full = lambda x, t, n=b - a: pa.array(np.full(n, x), t)
                yield pa.RecordBatch.from_arrays([*part.columns, full(task << 32 | number, pa.int64()), full(task, pa.int32()), full(task % BATCHES, pa.int32())], [*part.schema.names, BLOCK, TASK, BATCH])
                number += 1

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema)
    made = docs.mapInArrow(tidy(run), f"{fields}, {BLOCK} long, {TASK} int, {BATCH} int")
    stored = bucketed(made, TASK, buckets, folder, by=BATCH)
    return stored, buckets


def remove_repeated_passages(docs: DataFrame, text: str = "text", width: int = WIDTH, gram: int = GRAM, index: FingerprintIndex | None = None, layout: bool = False, folder: str | None = None) -> DataFrame:
    """All columns of ``docs``, with ``kept_text`` (kept words joined by one space; with ``layout``, the text as it is without the
    removed words), ``n_words``, ``n_removed`` and ``spans`` (first and last removed word of each maximal run) added.
    ``folder`` is new and shared: blocks, runs and what blocks are told are kept there until the result has been used."""
    spark = docs.sparkSession
    folder = folder or scratch(spark, "passages")
    index = index or FingerprintIndex(spark)
    names = [c for c in docs.columns if c not in ("kept_text", "n_words", "n_removed", "spans")]
    columns = [f"c{i}" for i in range(len(names))]
    plain = docs.select(*[F.col(f"`{c}`").alias(new) for c, new in zip(names, columns)])
    text = columns[names.index(text)]
    windows = Windows(text, width, min(gram, width), word_symbols)
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in plain.schema)

    def pieces(table: pa.Table) -> pa.Table:
        run = merged([merged([windows.pieces(s)[2]], PIECE) for s, _ in windows.walk(table)], PIECE)
        give_back()
        return pa.table({"gram": _signed(run["value"] >> ONE), "digest": _signed(run["check"]), "n": _signed(U64(1) + (run["value"] & ONE)), "who": _block(table, len(run))})

    def spell(key: tuple, left: pa.Table, right: pa.Table) -> pa.Table:
        told, out = _entry(right, "gram", "digest"), []
        for s, _ in windows.walk(left) if len(told) else ():
            lo, hi, piece = windows.pieces(s, told["value"])
            hit = in_run(piece, told)
            out.append(_windows_of(windows, s, lo[hit], hi[hit], piece[hit])[1])
        run = merged(out, PIECE)
        return pa.table({"block": _block(left, len(run)), "gram": _signed(run["value"] >> ONE), "window": _signed(run["check"]), "n": _signed(U64(1) + (run["value"] & ONE))})

    def last(key: tuple, left: pa.Table, right: pa.Table) -> pa.Table:
        kind = right.column("kind").to_numpy()
        known, open_, hits = (_entry(right.take(pa.array(np.flatnonzero(kind == k))), "gram", "check") for k in range(3))
        told_of = np.unique(np.concatenate([known["value"], open_["value"]]))
        done = []
        for s, part in windows.walk(left):
            starts = np.zeros(0, np.int64)
            if len(known) or len(hits):
                lo, hi, piece = windows.pieces(s, told_of)
                hit, look = in_run(piece, known), in_run(piece, open_)
                at, entry = _windows_of(windows, s, lo[look], hi[look], piece[look])
                starts = np.sort(np.concatenate([spans(lo[hit], hi[hit]), at[in_run(entry, hits)]]))
            done.append(finish(part, s, starts))
        give_back()
        return pa.concat_tables(done) if done else left.slice(0, 0).select(columns)

    def finish(part: pa.Table, s: dict, starts: np.ndarray) -> pa.Table:
        bounds = s["bounds"]
        gone = covered(starts, width, len(s["values"]))
        removed = np.diff(np.concatenate([[0], np.cumsum(gone)])[bounds])
        kept, cut = [], []
        for i, value in enumerate(part.column(text).to_pylist()):
            raw, mask = value.encode() if value else b"", gone[bounds[i] : bounds[i + 1]]
            runs = [(a, b - 1) for a, b in np.flatnonzero(np.diff(np.concatenate([[False], mask, [False]]))).reshape(-1, 2).tolist()] if removed[i] else []
            cut.append([{"first": a, "last": b} for a, b in runs])
            if layout:
                kept.append((without(raw, runs) if runs else raw).decode())
            else:
                words = raw.split()
                kept.append(b" ".join(compress(words, ~mask) if runs else words).decode())
        out = part.select(columns)
        out = out.append_column("kept_text", pa.array(kept, pa.string()))
        out = out.append_column("n_words", pa.array(np.diff(bounds), pa.int64())).append_column("n_removed", pa.array(removed, pa.int64()))
        return out.append_column("spans", pa.array(cut, pa.list_(pa.struct([("first", pa.int64()), ("last", pa.int64())]))))

    stored, buckets = in_batches(plain, text, f"{folder}/blocks")
    # pieces take about a sixth of their text
    own = FingerprintIndex(spark, f"{folder}/index", buckets=max(8, buckets // 4), lasting=False)
    for b in sorted(r[0] for r in stored.select(BATCH).distinct().collect()):
        own.add(stored.where(F.col(BATCH) == b).groupBy(TASK, BLOCK).applyInArrow(pieces, ENTRIES))
    by_block = stored.groupBy(TASK, BLOCK)
    of_task = F.shiftright("block", 32).cast("int").alias(TASK)
    found = told_pieces(own, index) if own.runs else spark.createDataFrame([], "block long, gram long, digest long, repeated boolean, spell boolean")
    told = bucketed(found.select("*", of_task).repartition(buckets, TASK), TASK, buckets, f"{folder}/told")
    own.drop()  # all that was asked of it is stored
    by_block.cogroup(told.where("spell").groupBy(TASK, "block")).applyInArrow(spell, SPELLED).write.option("compression", "zstd").parquet(f"{folder}/spelled")
    hits = told_windows(spark.read.schema(SPELLED).parquet(f"{folder}/spelled"), told, index).select("*", of_task)
    # kind 0: a repeated piece; 1: one whose windows have to be looked up; 2: a repeated window
    news = told.selectExpr("block", TASK, "gram", "digest as check", "if(repeated, 0, 1) as kind").unionByName(hits.selectExpr("block", TASK, "gram", "window as check", "2 as kind"))
    out = by_block.cogroup(news.groupBy(TASK, "block")).applyInArrow(last, f"{fields}, kept_text string, n_words long, n_removed long, spans array<struct<first:long,last:long>>")
    return out.toDF(*names, "kept_text", "n_words", "n_removed", "spans")


def _block(table: pa.Table, n: int) -> pa.Array:
    return pa.array(np.full(n, table.column(BLOCK)[0].as_py() if table.num_rows else 0), pa.int64())


def ingest(docs: DataFrame, index: FingerprintIndex, text: str = "text", width: int = WIDTH, gram: int = GRAM) -> None:
    """Adds all windows of ``docs`` to the index' history; their text isn't kept."""
    windows = Windows(text, width, min(gram, width), word_symbols)

    def entries(batches):
        for batch in batches:
            for s, _ in windows.walk(batch):
                lo, hi, piece = windows.pieces(s)
                at, entry = _windows_of(windows, s, lo, hi, piece)
                edges = np.concatenate([[0], np.cumsum(hi - lo)])
                spelled = pa.ListArray.from_arrays(pa.array(edges, pa.int32()), _signed(entry["check"]))
                ones = np.ones(len(lo), np.int64)
                yield pa.RecordBatch.from_arrays([_signed(piece["value"] >> ONE), _signed(piece["check"]), pa.array(ones), pa.array(HISTORY * ones), spelled], ["gram", "digest", "n", "who", "windows"])

    index.add(small_batches(docs).select(f"`{text}`").mapInArrow(entries, LASTING))
