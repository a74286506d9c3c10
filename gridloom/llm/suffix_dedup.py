"""Removal of byte strings that occur more than once (hash-compared suffix sort).

Texts are UTF-8 bytes.  Each byte covered by a ``width``-byte string of one
document that also starts anywhere else is removed.  Within a slice the
candidate suffixes are put in order by a mergesort that compares two suffixes
by their common extension: a binary search over prefix polynomial hashes, so a
comparison takes about log2(width) steps.  Neighbours with a common extension of
``width`` bytes are compared byte by byte before they count as one string.  The order decides
inside a slice; the distinct strings of slices and blocks are then matched by value range, where
a polynomial hash and a BLAKE2 digest of the bytes must agree.

Defined results: null is an empty text; a text shorter than ``width`` bytes is
kept whole; equal rows count as separate documents; null ids and other columns are passed
through, but for the text and columns with the names of results, which are replaced; a long
text is cut by no bound but its own; an empty table gives no rows; kept bytes may cut a
character, so they come back as binary.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .repeats import BLOCK, RUN, U64, Windows, covered, merged, repeated
from .textcore import BYTE_CODES, BYTE_POWERS, joined_bytes

WIDTH, GRAM = 400, 272
_HEAD = 24


def byte_symbols(column: pa.ChunkedArray) -> tuple:
    buf, bounds = joined_bytes(column)
    at = np.arange(len(buf) + 1)
    return BYTE_CODES[buf], bounds, BYTE_POWERS, buf.tobytes(), at[:-1], at[1:]


def common_extension(h: np.ndarray, x: np.ndarray, y: np.ndarray, width: int) -> np.ndarray:
    """Length of the longest common prefix, ``width`` at most, of the suffixes at ``x`` and ``y``."""
    _, down = BYTE_POWERS.upto(len(h))
    lo, hi = np.zeros(len(x), np.int64), np.full(len(x), width, np.int64)
    hx, hy, dx, dy = h[x], h[y], down[x], down[y]
    while (lo < hi).any():
        mid = (lo + hi + 1) >> 1
        same = (h[x + mid] - hx) * dx == (h[y + mid] - hy) * dy
        lo, hi = np.where(same, mid, lo), np.where(same, hi, mid - 1)
    return lo


def before(s: dict, x: np.ndarray, y: np.ndarray, width: int, ties: np.ndarray) -> np.ndarray:
    """Whether suffix ``x`` comes before suffix ``y``; ``ties`` decides equal ones."""
    n = common_extension(s["hash"], x, y, width)
    part = n < width
    i, j = x[part] + n[part], y[part] + n[part]
    out = ties.copy()
    out[part] = s["buf"][i] < s["buf"][j]
    return out


def suffix_order(s: dict, at: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """``at`` in suffix order (first ``width`` bytes), and whether each equals the one before.

    Heads of a few bytes split the suffixes into groups; groups of more than one are merge-sorted
    bottom up, every element finding its place in the neighbouring run by binary search.
    """
    buf = s["buf"]
    head = np.zeros((len(at), _HEAD), np.uint8)
    n = min(_HEAD, width)
    head[:, :n] = np.lib.stride_tricks.sliding_window_view(buf, n)[at]
    keys = head.view(">u8").astype(U64)
    order = np.lexsort((keys[:, 2], keys[:, 1], keys[:, 0]))
    at, keys = at[order], keys[order]
    tie = np.zeros(len(at), bool)
    tie[1:] = (keys[1:] == keys[:-1]).all(axis=1)
    first = np.flatnonzero(~tie)
    size = np.diff(np.append(first, len(at)))
    big = np.flatnonzero(size > 1)
    where = np.flatnonzero(np.repeat(size > 1, size))
    x = at[where]
    group = np.repeat(np.arange(len(big)), size[big])
    base = np.repeat(np.cumsum(size[big]) - size[big], size[big])
    ends = base + np.repeat(size[big], size[big])
    length = 1
    while len(x) and length < size[big].max():
        live = np.flatnonzero(ends - base > length)
        i = live - base[live]
        run = i // (2 * length) * (2 * length)
        left = i - run < length
        lo = np.where(left, base[live] + run + length, base[live] + run)
        hi = np.minimum(np.where(left, lo + length, lo + length), ends[live])
        lo = np.minimum(lo, hi)
        begin = lo.copy()
        while (open_ := np.flatnonzero(lo < hi)).size:
            mid = (lo[open_] + hi[open_]) >> 1
            # an element of the left run goes before equal ones of the right run
            goes = before(s, x[mid], x[live[open_]], width, ~left[open_])
            lo[open_] = np.where(goes, mid + 1, lo[open_])
            hi[open_] = np.where(goes, hi[open_], mid)
        own = np.where(left, i - run, i - run - length)
        new = x.copy()
        new[base[live] + run + own + (lo - begin)] = x[live]
        x = new
        length *= 2
    at = at.copy()
    at[where] = x
    same = np.zeros(len(at), bool)
    pair = where[1:][group[1:] == group[:-1]] if len(where) else where
    full = pair[common_extension(s["hash"], at[pair - 1], at[pair], width) == width]
    rows = np.lib.stride_tricks.sliding_window_view(buf, width) if len(full) else None
    for k in range(0, len(full), 4096):  # the hashes agree: compare the bytes themselves
        f = full[k : k + 4096]
        same[f] = (rows[at[f - 1]] == rows[at[f]]).all(axis=1)
    return at, same


def suffix_run(windows: Windows, s: dict, at: np.ndarray) -> np.ndarray:
    """One entry for each distinct string at ``at``, from neighbours in suffix order."""
    if not len(at):
        return np.zeros(0, RUN)
    at, same = suffix_order(s, at, windows.width)
    first = np.flatnonzero(~same)
    run = windows.prints(s, at[first])
    run["value"] |= (np.diff(np.append(first, len(at))) > 1).astype(U64)
    return merged([run])


class ByteWindows(Windows):
    def state(self, part: pa.Table) -> dict:
        s = super().state(part)
        s["buf"] = np.frombuffer(s["body"], np.uint8)
        return s


def remove_repeated_strings(docs: DataFrame, text: str = "text", width: int = WIDTH, gram: int = GRAM) -> DataFrame:
    """All columns of ``docs`` but the text, with ``kept`` (binary), ``n_bytes``, ``n_removed`` and
    ``spans`` (begin and end byte of each maximal removed run) added."""
    windows = ByteWindows(text, width, min(gram, width), byte_symbols, suffix_run, repeated)
    columns = [c for c in docs.columns if c not in (BLOCK, text, "kept", "n_bytes", "n_removed", "spans")]
    fields = "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in docs.schema if f.name in columns)

    def finish(part: pa.Table, s: dict, starts: np.ndarray) -> pa.Table:
        bounds, buf = s["bounds"], s["buf"]
        gone = covered(starts, width, len(buf))
        removed = np.diff(np.concatenate([[0], np.cumsum(gone)])[bounds])
        kept, spans = [], []
        for i in range(len(bounds) - 1):
            body = buf[bounds[i] : bounds[i + 1]]
            if removed[i]:
                mask = gone[bounds[i] : bounds[i + 1]]
                body = body[~mask]
                edge = np.flatnonzero(np.diff(np.concatenate([[False], mask, [False]])))
                spans.append([{"begin": int(a), "end": int(b)} for a, b in edge.reshape(-1, 2)])
            else:
                spans.append([])
            kept.append(body.tobytes())
        out = part.select(columns).append_column("kept", pa.array(kept, pa.binary()))
        out = out.append_column("n_bytes", pa.array(np.diff(bounds), pa.int64())).append_column("n_removed", pa.array(removed, pa.int64()))
        return out.append_column("spans", pa.array(spans, pa.list_(pa.struct([("begin", pa.int64()), ("end", pa.int64())]))))

    return windows.mark(docs.select(*[f"`{c}`" for c in [*columns, text]]), finish, f"{fields}kept binary, n_bytes long, n_removed long, spans array<struct<begin:long,end:long>>")
