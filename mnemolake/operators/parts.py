"""Dealing out whole numbers: the same part of a number in Spark and in numpy, and arrays of numbers as short byte strings."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

_PRIME, _STEP = (1 << 31) - 1, 48271


def part_of(name: str, parts: int) -> Column:
    """The part, from 0, of a column of whole numbers."""
    mixed = F.pmod(F.pmod(F.col(name).cast("long"), F.lit(_PRIME)) * _STEP, F.lit(_PRIME))
    return F.pmod(mixed, F.lit(parts)).cast("int")


def parts_of(x: np.ndarray, parts: int) -> np.ndarray:
    return x % _PRIME * _STEP % _PRIME % parts


def thin(x: np.ndarray) -> bytes:
    """Whole numbers as steps from one to the next, in the narrowest type; few bytes where they ascend."""
    x = np.ascontiguousarray(x, np.int64)
    step = np.diff(x)  # wraps round where it overflows, and so does the sum
    for size in (1, 2, 4):
        if not len(step) or (step.min() >= -(1 << 8 * size - 1) and step.max() < 1 << 8 * size - 1):
            break
    else:
        size = 8
    return bytes([size]) + x[:1].tobytes() + step.astype(f"i{size}").tobytes()


def thick(b: bytes) -> np.ndarray:
    if len(b) < 9:
        return np.zeros(0, np.int64)
    return np.cumsum(np.concatenate([np.frombuffer(b, np.int64, 1, 1), np.frombuffer(b, f"i{b[0]}", -1, 9).astype(np.int64)]))
