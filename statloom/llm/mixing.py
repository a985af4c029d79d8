"""Mixing sources to target weights by weighted fair queueing.

Every source queues its documents in a shuffled order, a second time after the first if its target needs repeats. A
queued copy has a virtual finish time, the source's words up to its end divided by the source's target. All copies
are merged by finish time and cut where their words reach the budget, so each source gets its share at any cut.

No source, however large, is ordered by one task: running sums go over hash buckets of the shuffled order, about the
square root of the rows in number and in size, and the cut is found from sums per slice of finish time.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from statloom.llm.text import WORD
from statloom.llm.work import stored

FARTHEST = 4  # finish times beyond this multiple of a source's target never enter the mix


@dataclass(frozen=True)
class MixPlan:
    """``weights`` repeat over the sources in code point order (NULL last); ``share`` is the budget as a part of all
    words; ``most`` bounds a target as a multiple of its source's words, and so how often a document repeats."""

    weights: tuple[int, ...] = (3, 1, 2)
    share: float = 1.5
    most: int = 2
    seed: str = "mix"


def _sized(docs: DataFrame, plan: MixPlan, buckets: int, keep: list[Column]) -> DataFrame:
    order = F.md5(F.concat(F.lit(f"{plan.seed}/"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))))
    slot = F.conv(F.substring("_order", 1, 8), 16, 10).cast("bigint")
    named = F.col("source").cast("string")
    return (docs.select(*keep, F.col("doc_id").alias("_doc"),
                        F.when(named.isNull(), F.lit("n")).otherwise(F.concat(F.lit("s"), named)).alias("_source"),
                        F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("bigint").alias("_size"),
                        order.alias("_order"))
            .withColumn("_bucket", F.shiftright(slot * buckets, 32)))


def source_targets(sizes: DataFrame, plan: MixPlan) -> DataFrame:
    """``_source, source_size, target`` of every source, from rows of ``_source, _size``.

    The budget is dealt out by weight; what a source can't take goes to the others by weight. In the order of the
    words a source can take per weight, the level (budget left per weight left) only rises while sources are full,
    so the first source above it fixes the level for all that follow.
    """
    every = W.partitionBy()
    by_name = W.orderBy(F.col("_source").startswith("n"), "_source")
    fill = W.orderBy("_ratio", "_rank").rowsBetween(W.unboundedPreceding, -1)
    weights = F.array(*[F.lit(int(w)) for w in plan.weights])
    ranked = (sizes.groupBy("_source").agg(F.sum("_size").cast("bigint").alias("source_size"))
              .withColumn("_rank", F.row_number().over(by_name))
              .withColumn("_weight", F.element_at(weights, (F.col("_rank") - 1) % len(plan.weights) + 1))
              .withColumn("_most", F.col("source_size").cast("double") * plan.most)
              .withColumn("_ratio", F.col("_most") / F.col("_weight"))
              .withColumn("_budget", F.sum("source_size").over(every).cast("double") * plan.share))
    levelled = (ranked
                .withColumn("_full", F.coalesce(F.sum("_most").over(fill), F.lit(0.0)))
                .withColumn("_used", F.coalesce(F.sum("_weight").over(fill), F.lit(0)))
                .withColumn("_level", (F.col("_budget") - F.col("_full"))
                            / (F.sum("_weight").over(every) - F.col("_used"))))
    first_above = F.min(F.when(F.col("_ratio") > F.col("_level"), F.struct("_ratio", "_rank", "_level")))
    return (levelled.withColumn("_fixed", first_above.over(every)["_level"])
            .select("_source", "source_size",
                    F.least("_most", F.coalesce(F.col("_weight") * F.col("_fixed"), "_most")).alias("target")))


def _queued(sized: DataFrame, sums: DataFrame, targets: DataFrame) -> DataFrame:
    """Every document with ``_end``, the words of its source's queue up to its own end, and its source's target."""
    before = W.partitionBy("_source").orderBy("_bucket").rowsBetween(W.unboundedPreceding, -1)
    starts = (sums.withColumn("_before", F.coalesce(F.sum("_size").over(before), F.lit(0)))
              .drop("_size").join(targets, "_source"))
    inside = W.partitionBy("_source", "_bucket").orderBy("_order", "_doc", "_size").rowsBetween(
        W.unboundedPreceding, W.currentRow)
    return (sized.withColumn("_inside", F.sum("_size").over(inside)).join(starts, ["_source", "_bucket"])
            .withColumn("_end", F.col("_before") + F.col("_inside")))


def _finish(turn: Column | int) -> Column:
    turn = turn if isinstance(turn, Column) else F.lit(turn)
    return F.try_divide((F.col("_end") + turn * F.col("source_size")).cast("double"), "target")


def _cut(queued: DataFrame, plan: MixPlan, slices: int, budget: float) -> tuple[float, str] | None:
    """The last (finish time, source) that fits the budget; a source has one copy at most at any finish time."""
    copies = (queued.filter("_size > 0 and target > 0")
              .select("_source", "_size", F.explode(F.array(*[_finish(t) for t in range(plan.most)])).alias("_time"))
              .filter(F.col("_time") <= FARTHEST)
              .withColumn("_slice", F.floor(F.col("_time") * slices)))
    running = W.orderBy("_slice").rowsBetween(W.unboundedPreceding, W.currentRow)
    last = (copies.groupBy("_slice").agg(F.sum("_size").alias("_words"))
            .withColumn("_upto", F.sum("_words").over(running))
            .agg(F.min(F.when(F.col("_upto") > budget, F.struct("_slice", "_upto", "_words"))).alias("at"))
            .first()["at"])
    if last is None:
        return math.inf, ""
    room = budget - (last["_upto"] - last["_words"])
    upto = W.orderBy("_time", "_source").rowsBetween(W.unboundedPreceding, W.currentRow)
    inside = (copies.filter(F.col("_slice") == last["_slice"]).withColumn("_upto", F.sum("_size").over(upto))
              .filter(F.col("_upto") <= room).agg(F.max(F.struct("_time", "_source")).alias("at")).first()["at"])
    return (inside["_time"], inside["_source"]) if inside else (last["_slice"] / slices, "")


def _planned(docs: DataFrame, plan: MixPlan, keep: list[Column]) -> tuple[DataFrame, list[Column]]:
    """Documents in their queues, and for each turn a condition that the mix takes this copy."""
    spark = docs.sparkSession
    buckets = max(1, math.isqrt(docs.count()))
    slim = stored(_sized(docs, plan, buckets, []), "mix-sizes")
    sums = stored(slim.groupBy("_source", "_bucket").agg(F.sum("_size").alias("_size")), "mix-buckets")
    targets = spark.createDataFrame(  # one row per source
        source_targets(sums, plan).collect(), "_source string, source_size bigint, target double")
    budget = plan.share * (sums.agg(F.sum("_size")).first()[0] or 0)
    time, source = _cut(_queued(slim, sums, targets), plan, buckets, budget)
    chosen = slim if not keep else _sized(docs, plan, buckets, keep)
    takes = [(F.col("_size") > 0) & (F.col("target") > 0) & (_finish(t) <= FARTHEST)
             & (F.struct(_finish(t), F.col("_source")) <= F.struct(F.lit(float(time)), F.lit(source)))
             for t in range(plan.most)]
    return _queued(chosen, sums, targets), takes


def mix_takes(docs: DataFrame, plan: MixPlan = MixPlan()) -> DataFrame:
    """One row per row of ``docs`` (doc_id, text, source): ``doc_id, size, source_size, target, taken``.

    ``size`` counts words; ``taken`` is the words of all copies in the mix. NULL or empty texts have size 0 and are
    never taken; NULL is a source of its own; a NULL doc_id is shuffled like an empty one; repeated rows are separate
    documents next to each other; without rows the result is empty. Other columns are ignored.
    """
    queued, takes = _planned(docs, plan, [])
    copies = sum((F.coalesce(t, F.lit(False)).cast("bigint") for t in takes), F.lit(0).cast("bigint"))
    return queued.select(F.col("_doc").alias("doc_id"), F.col("_size").alias("size"), "source_size", "target",
                         (F.col("_size") * copies).alias("taken"))


def mix(docs: DataFrame, plan: MixPlan = MixPlan(), ordered: bool = True) -> DataFrame:
    """The mix itself: the columns of ``docs``, a row per copy, by default in the merged order of finish times.

    Rows and cases as in ``mix_takes``. ``ordered`` sorts by range partitions over the whole mix.
    """
    queued, takes = _planned(docs, plan, [F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row")])
    times = F.array(*[F.when(t, _finish(n)) for n, t in enumerate(takes)])
    copies = queued.select("_row", "_source", F.explode(F.filter(times, lambda x: x.isNotNull())).alias("_time"))
    if ordered:
        copies = copies.orderBy("_time", "_source")
    return copies.select("_row.*")
