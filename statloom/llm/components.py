"""Connected components of links between nodes, by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from statloom.llm.work import stored


def _large_star(links: DataFrame) -> DataFrame:
    """Every node ties its larger neighbours to the smallest of its neighbours and itself."""
    both = links.unionAll(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.min("b").alias("_least")).withColumn("_least", F.least("a", "_least"))
    return (both.filter("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("_least").alias("b"))
            .distinct())


def _small_star(links: DataFrame) -> DataFrame:
    """Every node ties its smaller neighbours and itself to the smallest of them."""
    least = links.groupBy("a").agg(F.min("b").alias("_least"))
    others = (links.join(least, "a").filter("b > _least").select(F.col("b").alias("a"), F.col("_least").alias("b")))
    return others.unionAll(least.select("a", F.col("_least").alias("b"))).distinct()


def components(links: DataFrame, limit: int = 50) -> DataFrame:
    """``node, root`` for every node of ``links`` (``a, b``, with ``a != b``); a root is its component's smallest node.

    Each round is a few joins and grouped minima on stored links, whose number never grows; the rounds grow with the
    logarithm of the longest path. No component is gathered anywhere. Without links the result is empty.
    """
    pairs = stored(links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "links")
    state = None
    for _ in range(limit):
        now = pairs.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("a", "b")), F.sum(F.xxhash64("b", "a") % 1_000_003)).first()
        if now == state or not now[0]:
            break
        state = now
        pairs = stored(_small_star(_large_star(pairs)), "links")
    else:
        raise RuntimeError(f"components did not settle in {limit} rounds")
    roots = pairs.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct()
    return pairs.select(F.col("a").alias("node"), F.col("b").alias("root")).unionAll(roots)
