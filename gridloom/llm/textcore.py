"""Vectorised text primitives shared by the text operators.

Everything here works on one Arrow slice at a time: the UTF-8 bytes of many
documents lie end to end in one ``uint8`` array, ``bounds[i]:bounds[i + 1]`` is
document ``i``, and nothing ever looks across a bound.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

U64 = np.uint64
#: Bytes of text that are hashed at a time; keeps the temporary arrays in cache.
SLICE_BYTES = 1 << 20
NO_GRAM = U64(0xFFFFFFFFFFFFFFFF)


def _odd(name: str) -> int:
    return int.from_bytes(hashlib.sha256(name.encode()).digest()[:8], "little") | 1


class _Powers:
    """Powers of an odd base and of its inverse modulo 2**64, grown on demand."""

    def __init__(self, name: str):
        self.base = _odd(name)
        self.up = self.down = np.ones(1, U64)

    def upto(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) < n:
            size = max(n, 1 << 16)
            for attr, b in (("up", self.base), ("down", pow(self.base, -1, 1 << 64))):
                a = np.full(size, b, U64)
                a[0] = 1
                setattr(self, attr, np.multiply.accumulate(a))
        return self.up[:n], self.down[:n]


BYTE_POWERS, WORD_POWERS = _Powers("byte"), _Powers("word")
BYTE_CODES = np.frombuffer(hashlib.shake_256(b"byte codes").digest(2048), "<u8").astype(U64) | U64(1)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit values (splitmix finaliser)."""
    x = x ^ (x >> U64(30))
    x *= U64(0xBF58476D1CE4E5B9)
    x ^= x >> U64(27)
    x *= U64(0x94D049BB133111EB)
    x ^= x >> U64(31)
    return x


def prefix_hash(symbols: np.ndarray, powers: _Powers) -> np.ndarray:
    """``h[j] - h[i]`` is the polynomial hash of ``symbols[i:j]`` shifted by ``i``."""
    up, _ = powers.upto(len(symbols) + 1)
    out = np.zeros(len(symbols) + 1, U64)
    np.cumsum(symbols * up[:-1], out=out[1:])
    return out


def range_hash(h: np.ndarray, lo: np.ndarray, hi: np.ndarray, powers: _Powers) -> np.ndarray:
    _, down = powers.upto(len(h))
    return (h[hi] - h[lo]) * down[lo]


def slices(table: pa.Table | pa.RecordBatch, text: str, limit: int = SLICE_BYTES) -> Iterator[tuple[int, int]]:
    """Row ranges whose texts hold about ``limit`` bytes; one row at least."""
    n = table.num_rows
    if not n:
        return
    size = pc.fill_null(pc.binary_length(table.column(text)), 0)
    ends = np.cumsum(size.to_numpy(zero_copy_only=False) if isinstance(size, pa.Array) else size.to_numpy())
    at = 0
    while at < n:
        base = ends[at - 1] if at else 0
        to = max(at + 1, int(np.searchsorted(ends, base + limit, "right")))
        yield at, to
        at = to


def joined_bytes(column: pa.ChunkedArray | pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all texts end to end, and their bounds; a null is an empty text."""
    parts, sizes = [], []
    for chunk in column.chunks if isinstance(column, pa.ChunkedArray) else [column]:
        raw = pc.fill_null(chunk.cast(pa.large_binary()), b"")
        off = np.frombuffer(raw.buffers()[1], "<i8", len(raw) + 1, raw.offset * 8)
        data = raw.buffers()[2]
        body = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
        parts.append(body[off[0] : off[-1]])
        sizes.append(np.diff(off))
    sizes = np.concatenate(sizes) if sizes else np.zeros(0, np.int64)
    return (np.concatenate(parts) if len(parts) != 1 else parts[0]) if parts else np.zeros(0, np.uint8), np.concatenate([[0], np.cumsum(sizes)]).astype(np.int64)


#: ASCII white space that ends a word, bytes 20 and 09 to 0D.
BLANK = np.zeros(256, bool)
BLANK[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
#: Lower-cases A-Z and leaves every other byte as it is.
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def word_bounds(buf: np.ndarray, bounds: np.ndarray, breaks: np.ndarray = BLANK) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end byte of every word, and the bounds of each document in words."""
    inside = ~breaks[buf]
    cut = np.zeros(len(buf) + 1, bool)
    cut[bounds] = True
    before = np.zeros(len(buf) + 1, bool)
    before[1:] = inside
    after = np.zeros(len(buf) + 1, bool)
    after[:-1] = inside
    start = np.flatnonzero(after & (cut | ~before))
    end = np.flatnonzero(before & (cut | ~after))
    return start, end, np.searchsorted(start, bounds)


def word_hashes(buf: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    return mix(range_hash(prefix_hash(BYTE_CODES[buf], BYTE_POWERS), start, end, BYTE_POWERS))


def owner(bounds: np.ndarray) -> np.ndarray:
    """The document of each symbol."""
    return np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))


def room(bounds: np.ndarray) -> np.ndarray:
    """For each symbol, how many symbols its document still has from there on."""
    return np.repeat(bounds[1:], np.diff(bounds)) - np.arange(bounds[-1])


def sliding(op: np.ufunc, x: np.ndarray, width: int, fill) -> np.ndarray:
    """``op`` over ``x[i:i + width]``, by running values of aligned blocks."""
    n = len(x)
    pad = np.full(-(-n // width) * width + width, fill, x.dtype)
    pad[:n] = x
    grid = pad.reshape(-1, width)
    left = op.accumulate(grid, axis=1).ravel()
    right = op.accumulate(grid[:, ::-1], axis=1)[:, ::-1].ravel()
    return op(right[:n], left[width - 1 : n + width - 1])


def member(values: np.ndarray, sorted_set: np.ndarray) -> np.ndarray:
    """Which values are in an ascending set; a bit table answers most of them."""
    if not len(sorted_set) or not len(values):
        return np.zeros(len(values), bool)
    bits = U64(max(10, min(24, int(len(sorted_set)).bit_length() + 3)))
    table = np.zeros(1 << int(bits), bool)
    table[sorted_set >> (U64(64) - bits)] = True
    at = np.flatnonzero(table[values >> (U64(64) - bits)])
    out = np.zeros(len(values), bool)
    found = np.searchsorted(sorted_set, values[at])
    found[found == len(sorted_set)] = 0
    out[at] = sorted_set[found] == values[at]
    return out
