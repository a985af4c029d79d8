"""Exact sums of integers of any size across tasks, and vectors of whole numbers.

A number travels as limbs to the base 2^32, as many as it needs, the last one signed. Spark adds up the limbs of each
place as longs, which leaves room for 2^31 addends, and the sums are put together again.
"""

from __future__ import annotations

from collections.abc import Iterable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SMALL = 1 << 24    # below this, sums of thousands of squares of differences fit 64 bits


def limbs(value: int) -> list[int]:
    """``value`` as numbers to the base 2^32, the least first and the last one signed."""
    out = []
    while not -2**31 <= value < 2**31:
        out.append(value & 0xFFFFFFFF)
        value >>= 32
    return [*out, value]


def totals(df: DataFrame, keys: list[str], column: str = "limbs") -> dict[tuple, int]:
    """The exact sums of ``df``'s numbers by ``keys``; Spark adds up each place."""
    placed = df.select(*keys, F.posexplode(column).alias("_place", "_limb"))
    out: dict[tuple, int] = {}
    for row in placed.groupBy(*keys, "_place").agg(F.sum("_limb").alias("_limb")).collect():
        key = tuple(row[k] for k in keys)
        out[key] = out.get(key, 0) + (row["_limb"] << (32 * row["_place"]))
    return out


def usable(vector: Column) -> Column:
    """True for a vector that isn't NULL and holds neither NULL nor non-finite components."""
    x = vector.cast("array<double>")
    bad = F.exists(x, lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf")))
    return ~F.coalesce(bad, F.lit(True))


def floors(column: pa.Array, dim: int, scale: int, shift: int = 0) -> np.ndarray:
    """floor(scale * x) + shift of a batch of vectors of length ``dim``: 64-bit where all are small, else Python's integers."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    with np.errstate(over="ignore"):
        scaled = np.floor(column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), dim) * float(scale))
    if scaled.size and not np.isfinite(scaled).all():  # the product left the range of doubles, its operand didn't
        exact = [(n * scale) // d for n, d in (float(v).as_integer_ratio() for v in column.flatten().to_pylist())]
        return np.array(exact, object).reshape(len(column), dim) + shift
    if np.abs(scaled).max(initial=0) + abs(shift) < SMALL:
        return scaled.astype(np.int64) + shift
    return np.array([int(v) for v in scaled.ravel()], object).reshape(len(column), dim) + shift


def longs(values: Iterable[int]) -> pa.Array:
    """A long each; NULL for what 64 bits can't hold."""
    return pa.array([int(v) if -2**63 <= v < 2**63 else None for v in values], pa.int64())
