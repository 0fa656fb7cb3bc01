"""Draws by counter: each depends on its key alone, so results don't depend on order, partitions or retries.

``uniform`` stays in the JVM, for a draw or a few a row.  Where a row needs
hundreds of draws, it gets one ``base`` there, and ``numbers`` makes the others
from the base and the number of a stream, in arrays.  Both can be stated in SQL.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

_U = np.uint64
#: Bits of ``uniform`` and of the numbers that are compared with limits.
BITS = 52
NUMBER_BITS = 53
#: The step between streams and the two factors of the mixing function.  Fixed values (public-domain splitmix64).
STEP, FIRST_FACTOR, SECOND_FACTOR = 0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB


def _digits(key: tuple, digits: int) -> Column:
    parts = [(F.col(k) if isinstance(k, str) else k if isinstance(k, Column) else F.lit(k)).cast("string") for k in key]
    return F.conv(F.substring(F.md5(F.concat_ws(":", *parts).cast("binary")), 1, digits), 16, 10).cast("bigint")


def uniform(*key: Column | str | int) -> Column:
    """A draw in [0, 1) for the key: the first 13 hex digits of the md5 of its parts, joined by colons, over 2^52.

    Parts are columns, names of columns or numbers: a seed, a stream, numbers.
    Null parts are left out.
    """
    return _digits(key, 13) / F.lit(float(1 << BITS))


def base(*key: Column | str | int) -> Column:
    """A bigint of 60 bits for the key, from which ``numbers`` goes on."""
    return _digits(key, 15)


def numbers(bases: np.ndarray, streams: np.ndarray) -> np.ndarray:
    """Draws of 53 bits: a row for each base, a column for each stream."""
    h = bases.astype(_U)[:, None] + (streams.astype(_U) + _U(1))[None, :] * _U(STEP)
    h = (h ^ (h >> _U(30))) * _U(FIRST_FACTOR)
    h = (h ^ (h >> _U(27))) * _U(SECOND_FACTOR)
    return (h ^ (h >> _U(31))) >> _U(64 - NUMBER_BITS)


def poisson_limits(rate: float = 1.0) -> list[int]:
    """Limits of 53-bit draws: the Poisson number is how many of them are at or below the draw."""
    total, term, out = 0.0, math.exp(-rate), []
    for k in range(1, 40):
        total += term
        if (limit := int(total * (1 << NUMBER_BITS))) >= 1 << NUMBER_BITS or term < 2.0**-NUMBER_BITS:
            break
        out.append(limit)
        term *= rate / k
    return out
