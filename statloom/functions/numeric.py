"""Integer, decimal and counter arithmetic with explicit zero and NULL rules."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def whole_div(n: Column, d: Column | int) -> Column:
    """Truncating integer division; NULL instead of an error when the divisor is 0."""
    d = F.lit(d) if isinstance(d, int) else F.nullif(d, F.lit(0))
    return F.call_function("div", n, d)


def pages_to_mb(pages: Column) -> Column:
    """8 KiB pages to whole megabytes."""
    return whole_div(pages, 128)


def quotient(n: Column, d: Column, digits: int) -> Column:
    """Exact decimal ``n / d`` rounded half up to ``digits``; NULL when ``d`` is 0 or NULL."""
    n = n.cast("decimal(20,0)")
    d = F.nullif(d, F.lit(0)).cast("decimal(20,0)")
    return F.round(n / d, digits).cast(f"decimal(24,{digits})")


def percent(part: Column, whole: Column, digits: int) -> Column:
    """``100 * part / whole`` in exact decimal arithmetic; NULL when ``whole`` is 0 or NULL."""
    return quotient(part.cast("decimal(18,0)") * 100, whole, digits)


def counter_delta(previous: Column, current: Column) -> Column:
    """Growth of a cumulative counter; a restart (counter went down) counts as 0 and NULL stays NULL."""
    return F.when(previous > current, F.lit(0)).otherwise(current - previous).cast("bigint")


def growth_only(previous: Column, current: Column) -> Column:
    """Growth of a cumulative counter where anything but real growth, NULL included, counts as 0."""
    return F.when(current > previous, current - previous).otherwise(F.lit(0)).cast("bigint")
