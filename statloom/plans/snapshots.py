"""Pair every snapshot row with the same key in the *immediately preceding* snapshot of its server.

A plain per-key ``lag`` is wrong: after a missed poll it would bridge the gap. Snapshots are therefore numbered
per server, and a pair counts only when the numbers are consecutive.

Scale: numbering works on the distinct poll times, not on the rows. The lag itself runs in chunks of consecutive
polls, the last poll of a chunk being carried into the next one, so even a key that holds a large part of all
rows is spread over many tasks. The fact table is shuffled once for the lag; the numbering is joined back by
broadcast when it is small and by sort-merge (with adaptive skew splitting) when it is not.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from statloom.functions import whole_div
from statloom.plans.ranking import number_times

CHUNK_POLLS = 4096


def previous_name(counter: str) -> str:
    return f"prev_{counter}"


def number_snapshots(polls: DataFrame, scope: Sequence[str], at: str = "collect_date") -> DataFrame:
    """Distinct ``(scope, at)`` with ``snapshot_no`` counting 1, 2, 3 … in time order per scope.

    ``polls`` may be the snapshots themselves or, better, a registry of polls: a poll that returned no rows at
    all is only visible in a registry.
    """
    return number_times(polls, scope, at, "snapshot_no")


def pair_with_previous(
    snapshots: DataFrame,
    scope: Sequence[str],
    keys: Sequence[str],
    counters: Sequence[str],
    at: str = "collect_date",
    polls: DataFrame | None = None,
    chunk_polls: int = CHUNK_POLLS,
) -> DataFrame:
    """Rows that also existed in the preceding snapshot, each with ``prev_<counter>`` columns added.

    A key's first appearance and its first row after a missed poll give no row. ``(scope, keys, at)`` must be
    unique. If ``snapshots`` already has a ``snapshot_no`` column it is used as it is.
    """
    carried = list(snapshots.columns)
    if "snapshot_no" in carried:
        numbered = snapshots
    else:
        registry = number_snapshots(polls if polls is not None else snapshots, scope, at)
        numbered = snapshots.join(registry, [*scope, at])

    own_chunk = whole_div(F.col("snapshot_no"), chunk_polls)
    closes_chunk = F.col("snapshot_no") % chunk_polls == chunk_polls - 1
    in_chunks = numbered.withColumn(
        "_chunk", F.explode(F.when(closes_chunk, F.array(own_chunk, own_chunk + 1)).otherwise(F.array(own_chunk))))

    by_number = W.partitionBy(*scope, *keys, "_chunk").orderBy("snapshot_no")
    looked_back = in_chunks.withColumns({
        "_prev_no": F.lag("snapshot_no").over(by_number),
        **{previous_name(c): F.lag(c).over(by_number) for c in counters},
    })
    return (looked_back
            .filter((F.col("_prev_no") == F.col("snapshot_no") - 1) & (F.col("_chunk") == own_chunk))
            .select(*carried, *[previous_name(c) for c in counters]))
