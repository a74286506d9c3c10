"""Integers as bytes, and bytes as Arrow columns without a copy of each value."""

from __future__ import annotations

import numpy as np
import pyarrow as pa

#: What stands for a larger number.
LARGE = 255


def pack(values: np.ndarray) -> bytes:
    """Non-negative integers, most of them small: their number, a byte for each, and behind these, in order, eight bytes for each large one."""
    small = np.minimum(values, LARGE).astype(np.uint8)
    return len(small).to_bytes(4, "little") + small.tobytes() + values[small == LARGE].astype("<u8").tobytes()


def unpack(data: bytes) -> np.ndarray:
    n = int.from_bytes(memoryview(data)[:4], "little")
    out = np.frombuffer(data, np.uint8, n, 4).astype(np.int64)
    out[out == LARGE] = np.frombuffer(data, "<u8", offset=4 + n)
    return out


def raw(column: pa.ChunkedArray | pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a binary column end to end, and their bounds."""
    from .textcore import joined_bytes

    return joined_bytes(column)


def binaries(data: np.ndarray, bounds: np.ndarray) -> pa.Array:
    """A binary column over ``data``: value ``i`` is ``data[bounds[i]:bounds[i + 1]]``."""
    body = np.ascontiguousarray(data).view(np.uint8)
    return pa.Array.from_buffers(pa.large_binary(), len(bounds) - 1, [None, pa.py_buffer(np.ascontiguousarray(bounds, np.int64)), pa.py_buffer(body)]).cast(pa.binary())
