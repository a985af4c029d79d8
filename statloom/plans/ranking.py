"""Ranking that never needs one whole group in one task."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T


def top_n(df: DataFrame, n: int, order: Sequence[Column], per: Sequence[str] = ()) -> DataFrame:
    """The first ``n`` rows of ``order``, overall or per group.

    Overall it is a distributed top-k. Per group Spark keeps only the first ``n`` rows of each group on every
    task before the shuffle, so a hot group arrives as a few short lists. ``order`` should be total.
    """
    if not per:
        return df.orderBy(*order).limit(n)
    return (df.withColumn("_rank", F.row_number().over(W.partitionBy(*per).orderBy(*order)))
            .filter(F.col("_rank") <= n).drop("_rank"))


def _block(df: DataFrame, at: str, unit: str, width: int) -> Column:
    """Coarse, order-preserving block of ``at``: a calendar unit for times, ``width`` values for numbers."""
    if isinstance(df.schema[at].dataType, T.NumericType):
        return F.floor(F.col(at) / width)
    return F.date_trunc(unit, F.col(at))


def number_times(
    df: DataFrame, per: Sequence[str], at: str, name: str, newest_first: bool = False,
    unit: str = "day", width: int = 4096,
) -> DataFrame:
    """Distinct ``(per, at)`` with ``name`` counting 1, 2, 3 … within ``per``, as an exact two-level rank.

    Distinct times are numbered inside blocks of one calendar ``unit``; a running total of the block counts gives
    each block its offset. Only distinct times are numbered and only block counts are accumulated, so what one task
    holds is bounded by the clock and not by how many rows, or how many times, a group has.
    """
    def directed(column: str) -> Column:
        return F.col(column).desc() if newest_first else F.col(column).asc()

    # NULLs go before the distinct, so that both uses of the times have the same plan and share one shuffle.
    known = reduce(and_, [F.col(c).isNotNull() for c in (*per, at, "_block")])
    times = df.select(*per, at, _block(df, at, unit, width).alias("_block")).filter(known).distinct()
    in_block = W.partitionBy(*per, "_block").orderBy(directed(at))
    blocks_before = W.partitionBy(*per).orderBy(directed("_block")).rowsBetween(W.unboundedPreceding, -1)
    offsets = (times.groupBy(*per, "_block").agg(F.count(F.lit(1)).alias("_times"))
               .select(*per, "_block", F.coalesce(F.sum("_times").over(blocks_before), F.lit(0)).alias("_before")))
    return (times.withColumn("_in_block", F.row_number().over(in_block))
            .join(offsets, [*per, "_block"])
            .select(*per, at, (F.col("_before") + F.col("_in_block")).cast("bigint").alias(name)))


def dense_rank_newest_first(df: DataFrame, per: Sequence[str], at: str, name: str = "rank_no") -> DataFrame:
    """Add ``name``: the dense rank of the time ``at`` within ``per``, newest first. Rows without a time are dropped."""
    return df.join(number_times(df, per, at, name, newest_first=True, unit="minute"), [*per, at])
