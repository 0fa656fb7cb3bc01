"""Vectorised words and hashes over Arrow string columns.

A word is a run of bytes other than 0x20 and 0x09-0x0D, which in UTF-8 is the
pattern ``[^\\x20\\x09-\\x0D]+``.  Everything works on the column's byte buffer,
so no Python string is made per word.  Hashes are 64-bit and need no seed from
the process, so every executor computes the same ones.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa

BLOCK_BYTES = 2 << 20
_U = np.uint64


class Words(NamedTuple):
    """Words of consecutive rows: byte spans, hashes and each row's first word (one more entry at the end)."""

    start: np.ndarray
    end: np.ndarray
    hash: np.ndarray
    first: np.ndarray

    @property
    def count(self) -> np.ndarray:
        return np.diff(self.first)

    @property
    def row(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.first) - 1), self.count)


def mix(h: np.ndarray) -> np.ndarray:
    """Finaliser of a 64-bit hash (public-domain splitmix constants)."""
    h = (h ^ (h >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> _U(27))) * _U(0x94D049BB133111EB)
    return h ^ (h >> _U(31))


def buffers(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes and row offsets (n + 1) of a string column; null rows are empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_string()).fill_null("")
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = column.buffers()
    offsets = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def blocks(offsets: np.ndarray, size: int = BLOCK_BYTES) -> Iterator[tuple[int, int]]:
    """Row ranges of at most ``size`` bytes, or of one longer row."""
    low, n = 0, len(offsets) - 1
    while low < n:
        high = max(low + 1, int(np.searchsorted(offsets, offsets[low] + size, "right")) - 1)
        yield low, min(high, n)
        low = high


def _powers(n: int, base: int) -> np.ndarray:
    out = np.full(max(n, 1), _U(base))
    out[0] = 1
    return np.cumprod(out, dtype=np.uint64)


def byte_kinds(between: bytes) -> np.ndarray:
    """A table of byte kinds: 0 for the bytes ``between`` words, 1 for all others."""
    table = np.ones(256, np.uint8)
    table[list(between)] = 0
    return table


SPACES = byte_kinds(bytes([0x20, *range(0x09, 0x0E)]))


def split_words(data: np.ndarray, offsets: np.ndarray, kinds: np.ndarray = SPACES) -> Words:
    """Words of the rows of one block: runs of bytes of one kind; bytes of kind 0 stand between words."""
    n, rows = len(data), len(offsets) - 1
    kind = kinds[data]
    inside = kind != 0
    begins = inside.copy()
    ends = inside.copy()
    if n:
        other = kind[1:] != kind[:-1]
        begins[1:] &= other
        ends[:-1] &= other
        cut = offsets[:-1][(offsets[:-1] < n) & (offsets[:-1] > 0)]
        begins[cut] = inside[cut]
        ends[cut - 1] = inside[cut - 1]
    start = np.flatnonzero(begins)
    end = np.flatnonzero(ends) + 1
    first = np.searchsorted(start, offsets).astype(np.int64)
    first[-1] = len(start)
    if not len(start):
        return Words(start, end, np.zeros(0, np.uint64), np.zeros(rows + 1, np.int64))
    number = np.cumsum(begins) - 1
    place = np.arange(n) - start[np.maximum(number, 0)]
    power = _powers(int((end - start).max()), 0x100000001B3)
    value = np.zeros(n, np.uint64)
    value[inside] = (data[inside].astype(np.uint64) + _U(1)) * power[place[inside]]
    return Words(start, end, mix(np.add.reduceat(value, start)), first)


def window_hashes(h: np.ndarray, size: int, base: int = 0x9E3779B97F4A7C15) -> np.ndarray:
    """Hash of every ``size`` consecutive entries of ``h`` (shorter by size - 1), for any size in linear time; ``base`` is odd."""
    n = len(h)
    if n < size:
        return np.zeros(0, np.uint64)
    power, inverse = _powers(n, base), _powers(n, pow(base, -1, 1 << 64))
    total = np.zeros(n + 1, np.uint64)
    np.cumsum(h * power, out=total[1:])
    return mix((total[size:] - total[: n - size + 1]) * inverse[: n - size + 1])


def windows_inside(words: Words, size: int) -> np.ndarray:
    """Which of the block's windows of ``size`` words lie in one row."""
    n = len(words.start)
    if n < size:
        return np.zeros(0, bool)
    row = words.row
    return row[: n - size + 1] == row[size - 1 :]


def signed(h: np.ndarray) -> np.ndarray:
    return h.view(np.int64)


def word_strings(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> pa.Array:
    """The byte spans of a block as a string column."""
    size = end - start
    offsets = np.append(0, np.cumsum(size)).astype(np.int64)
    at = np.arange(offsets[-1]) + np.repeat(start - offsets[:-1], size)
    return pa.LargeStringArray.from_buffers(len(size), pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(data[at]))).cast(pa.string())


def lower_ascii(data: np.ndarray) -> np.ndarray:
    """A copy of the bytes with A-Z lower-cased."""
    table = np.arange(256, dtype=np.uint8)
    table[0x41:0x5B] += 0x20
    return table[data]
