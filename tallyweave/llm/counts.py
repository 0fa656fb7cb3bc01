"""Counts of 64-bit names: summed in tasks of bounded memory, and fixed-size filters of the frequent ones.

A name is the hash of what it stands for, so every task gives the same thing the
same name without a lookup.  ``NameFilter`` has a fixed number of bits, whatever
the number of names: it only keeps tasks from emitting what can't count in the
end, and exact counts and joins follow, so a filter that is full costs time, not
results.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyweave.llm.words import mix

_U = np.uint64
#: Bits of a filter: 8 MB to broadcast, at most.
FILTER_BITS = 1 << 26
#: Bits of one aggregated piece of a filter, fixed by ``bitmap_construct_agg``.
PIECE_BITS = 1 << 15
#: Names that a task holds before it sums them.
HELD = 1 << 21


class NameFilter:
    """Bits of names modulo the number of bits; never false for a name that was put in."""

    def __init__(self, bits: np.ndarray):
        self.bits = bits

    def __contains__(self, name: int) -> bool:
        return bool(self.has(np.array([name], _U))[0])

    def has(self, names: np.ndarray) -> np.ndarray:
        at = names & _U(len(self.bits) * 8 - 1)
        return (self.bits[(at >> _U(3)).astype(np.int64)] >> (at & _U(7)).astype(np.uint8)) & 1 == 1


def name_filter(names: DataFrame, column: str, bits: int = FILTER_BITS) -> NameFilter:
    """The filter of a bigint column; the bits are set by Spark in pieces of 4 KB, of which the driver gets ``bits / 32768`` at most."""
    at = F.col(column).bitwiseAND(bits - 1)
    pieces = names.where(F.col(column).isNotNull()).groupBy(F.shiftright(at, 15).alias("piece")).agg(F.bitmap_construct_agg(at.bitwiseAND(PIECE_BITS - 1)).alias("bits"))
    out = np.zeros(bits // 8, np.uint8)
    size = PIECE_BITS // 8
    for piece, part in pieces.collect():
        out[piece * size : (piece + 1) * size] = np.frombuffer(part, np.uint8)[: len(out)]
    return NameFilter(out)


def pair_names(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """The name of an ordered pair of names."""
    return mix(mix(left + _U(0x9E3779B97F4A7C15)) ^ right)


class PairSums:
    """Numbers of pairs of names, held up to a limit and then summed and given out."""

    def __init__(self, held: int = HELD):
        self.held, self.size, self.parts = held, 0, []

    def add(self, left: np.ndarray, right: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        self.parts.append((left, right))
        self.size += len(left)
        if self.size >= self.held:
            yield from self.rest()

    def rest(self) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """(left, right, number) of what is held."""
        if self.size:
            left, right = (np.concatenate([p[i] for p in self.parts]) for i in (0, 1))
            self.parts, self.size = [], 0
            _, first, number = np.unique(pair_names(left, right), return_index=True, return_counts=True)
            yield left[first], right[first], number
