"""Words and shingles of Arrow text columns, as numpy arrays of hashes.

Whole texts are read; a chunk is a run of whole documents, so memory follows
the chunk size or the longest single text.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa

# Bytes of text worked on at a time; a longer single text is a chunk of its own.
CHUNK = 1 << 20

_BASE = np.uint64(0x9E3779B97F4A7C15)
_BASE_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_powers: list[np.ndarray] = []


class Words(NamedTuple):
    """Words of a chunk of documents: documents ``first`` to ``first + len(offsets) - 2``."""

    first: int
    raw: np.ndarray  # bytes of the chunk
    bounds: np.ndarray  # byte offsets of the documents
    starts: np.ndarray  # byte offset of each word
    ends: np.ndarray
    offsets: np.ndarray  # word offsets of the documents
    hashes: np.ndarray


def _power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    if not _powers or len(_powers[0]) <= n:
        size = max(n + 1, 4096 if not _powers else 2 * len(_powers[0]))
        _powers[:] = [
            np.cumprod(np.concatenate([[np.uint64(1)], np.full(size - 1, b)]), dtype=np.uint64)
            for b in (_BASE, _BASE_INVERSE)
        ]
    return _powers[0], _powers[1]


def mix(h: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def byte_table(lower: bool = True, letters_only: bool = False) -> np.ndarray:
    """Byte to byte, 0 for what separates words. NUL, which texts can hold, becomes 1.

    Separators are space and the controls tab to carriage return. With
    ``letters_only`` all ASCII but letters and digits separates; bytes of other
    characters belong to words.
    """
    table = np.arange(256, dtype=np.uint8)
    table[0] = 1
    if lower:
        table[65:91] += 32
    table[[0x20, *range(0x09, 0x0E)]] = 0
    if letters_only:
        keep = np.zeros(256, dtype=bool)
        keep[48:58] = keep[65:91] = keep[97:123] = keep[128:] = True
        table[~keep] = 0
    return table


def buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of a text column; nulls are empty."""
    column = column.cast(pa.large_string()).fill_null("")
    _, offsets, data = column.buffers()
    bounds = np.frombuffer(offsets, dtype=np.int64)[column.offset : column.offset + len(column) + 1]
    raw = np.frombuffer(data, dtype=np.uint8) if data else np.zeros(0, dtype=np.uint8)
    return raw, bounds


def chunks(bounds: np.ndarray) -> Iterator[tuple[int, int]]:
    """Runs of documents of at most CHUNK bytes, or of one document."""
    first, n = 0, len(bounds) - 1
    while first < n:
        last = int(np.searchsorted(bounds, bounds[first] + CHUNK, side="right")) - 1
        last = min(n, max(first + 1, last))
        yield first, last
        first = last


def words(column: pa.Array, table: np.ndarray) -> Iterator[Words]:
    """The words of every text, hashed byte by byte after ``table``."""
    raw, bounds = buffers(column)
    for first, last in chunks(bounds):
        offsets = bounds[first : last + 1] - bounds[first]
        text = raw[bounds[first] : bounds[last]]
        long = len(text) > 2 * CHUNK
        yield _long(first, text, table) if long else _split(first, text, table, offsets)


def _long(first: int, raw: np.ndarray, table: np.ndarray) -> Words:
    """The words of one long text, read in pieces that end where words do."""
    parts, at = [], 0
    while at < len(raw):
        end = min(at + CHUNK, len(raw))
        # A piece ends before a separator; a word longer than a piece is one piece.
        while end < len(raw) and (gaps := np.flatnonzero(table[raw[at:end]] == 0)).size == 0:
            end = min(end + CHUNK, len(raw))
        if end < len(raw):
            end = at + int(gaps[-1]) + 1
        piece = _split(first, raw[at:end], table, np.array([0, end - at]))
        parts.append((piece.starts + at, piece.ends + at, piece.hashes))
        at = end
    starts, ends, hashes = (np.concatenate(p) for p in zip(*parts, strict=True))
    return Words(first, raw, np.array([0, len(raw)]), starts, ends, np.array([0, len(starts)]), hashes)


def _split(first: int, raw: np.ndarray, table: np.ndarray, bounds: np.ndarray) -> Words:
    data, n = table[raw], len(raw)
    inside = np.zeros(n + 2, dtype=bool)
    inside[1:-1] = data != 0
    begin = inside[1:-1] & ~inside[:-2]
    end = inside[1:-1] & ~inside[2:]
    edges = bounds[1:-1]
    at = edges[edges < n]
    begin[at] |= inside[at + 1]
    before = edges[edges > 0] - 1
    end[before] |= inside[before + 1]
    starts, ends = np.flatnonzero(begin), np.flatnonzero(end) + 1
    powers, inverses = _power_tables(n)
    sums = np.zeros(n + 1, dtype=np.uint64)
    np.cumsum(data * powers[:n], out=sums[1:])
    hashes = mix((sums[ends] - sums[starts]) * inverses[starts])
    return Words(first, raw, bounds, starts, ends, np.searchsorted(starts, bounds), hashes)


def shingles(hashes: np.ndarray, k: int) -> np.ndarray:
    """Hashes of the runs of k word hashes; fewer words make one run, none make none."""
    n = len(hashes)
    if n == 0:
        return hashes
    width = min(k, n)
    total = np.zeros(n - width + 1, dtype=np.uint64)
    for j in range(width):
        total = mix(total + hashes[j : n - width + 1 + j] + np.uint64(width))
    return total


def alone(hashes: np.ndarray) -> np.ndarray:
    """Each word as the shingle of a text of that word alone."""
    return mix(hashes + np.uint64(1))
