"""A set of 64-bit numbers in a bit map of bounded size, for tasks to leave out most of what is not wanted."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# 8 MB; beyond a few million numbers the map gets fuller and lets more through, which costs time only.
MOST_BITS = 1 << 26


def bitset(df: DataFrame, column: str) -> np.ndarray:
    """The map of all numbers in a column; nulls are not regarded."""
    numbers = df.where(F.col(column).isNotNull()).select(F.col(column).alias("x"))
    bits = min(MOST_BITS, max(1 << 16, 1 << (16 * numbers.count()).bit_length()))
    words = (numbers.selectExpr(f"pmod(x, {bits}L) AS place")
             .groupBy(F.expr("shiftright(place, 6)").alias("w")).agg(F.expr("bit_or(shiftleft(1L, cast(place % 64 AS int)))").alias("b")))
    out = np.zeros(bits // 64, dtype=np.uint64)
    for r in words.toLocalIterator():
        out[r["w"]] = r["b"] & 0xFFFFFFFFFFFFFFFF
    return out


def may_hold(bits: np.ndarray, numbers: np.ndarray) -> np.ndarray:
    """False for what is surely not in the set."""
    place = numbers.view(np.uint64) & np.uint64(len(bits) * 64 - 1)
    return (bits[(place >> np.uint64(6)).astype(np.int64)] >> (place & np.uint64(63))) & np.uint64(1) == 1
