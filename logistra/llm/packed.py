"""Whole numbers as bytes: 7 bits a byte, the low ones first; a number's last byte is below 128."""

from __future__ import annotations

import numpy as np
import pyarrow as pa


def pack(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of ``values`` (none negative), and the byte offset of each value and of the end."""
    values = np.asarray(values, dtype=np.int64)
    sizes = np.ones(len(values), dtype=np.int64)
    most = int(values.max()) if len(values) else 0
    for bits in range(7, most.bit_length(), 7):
        sizes += values >> bits > 0
    offsets = np.append(0, np.cumsum(sizes))
    out = np.zeros(offsets[-1], dtype=np.uint8)
    at, left = offsets[:-1], values
    while len(at):
        more = left >> 7 > 0
        out[at] = (left & 127) | (more.astype(np.int64) << 7)
        at, left = at[more] + 1, left[more] >> 7
    return out, offsets


def unpack(data: bytes) -> np.ndarray:
    """The values that ``pack`` made these bytes of."""
    found = np.frombuffer(data, dtype=np.uint8)
    starts = np.append(0, np.flatnonzero(found < 128) + 1)
    out = (found[starts[:-1]] & 127).astype(np.int64)
    place = np.flatnonzero(found[starts[:-1]] > 127)
    byte = 1
    while len(place):
        now = found[starts[place] + byte]
        out[place] |= (now & 127).astype(np.int64) << (7 * byte)
        place, byte = place[now > 127], byte + 1
    return out


def binary(data: np.ndarray, offsets: np.ndarray) -> pa.Array:
    """Binary column of runs of ``data`` (uint8)."""
    bounds = pa.py_buffer(np.ascontiguousarray(offsets, dtype=np.int32))
    return pa.Array.from_buffers(pa.binary(), len(offsets) - 1, [None, bounds, pa.py_buffer(data)])


def packed(values: np.ndarray, cuts: np.ndarray) -> pa.Array:
    """Binary column of the packed runs of ``values`` between ``cuts``."""
    data, offsets = pack(values)
    return binary(data, offsets[cuts])


def plain(values: np.ndarray, cuts: np.ndarray) -> pa.Array:
    """Binary column of the runs of ``values`` between ``cuts``, as they are."""
    return binary(np.ascontiguousarray(values).view(np.uint8), cuts * values.itemsize)


def joined(column: pa.ChunkedArray) -> bytes:
    """The bytes of all rows of a binary column."""
    return b"".join(column.to_pylist())


def lengths(column: pa.ChunkedArray) -> np.ndarray:
    """Number of values in each row of a packed column."""
    return np.array([(np.frombuffer(x, dtype=np.uint8) < 128).sum() for x in column.to_pylist()], dtype=np.int64)
