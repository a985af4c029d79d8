"""The three monitoring solutions end to end: stored snapshots → deltas → stored history → purge.

Each run is a pure function of the stored snapshots and replaces the days it computes, those left without rows
included, so it can be repeated after a failure. Snapshots and histories are Parquet folders partitioned by day, as
written by ``sources.history``. Beside the history a run keeps a registry of the polls it has computed, with the names
of their day's files. The next one reads the days whose files differ, goes on from the first day with a poll that is new,
changed or gone, late ones included, and reads the snapshots from a few days before it and the days of every server's last
poll before it, however old. ``recompute`` does all days again, as after a change of thresholds. Polls that are missing
at the start of the oldest stored day, or before it, have been purged and change nothing.

A poll that found nothing leaves no snapshot. ``polls``, another folder partitioned by day with ``server_name`` and
``collect_date``, lists such polls, or all: one between two snapshots breaks their pair, also if it is listed late.
"""

from __future__ import annotations

import hashlib
import re
from collections import defaultdict
from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from statloom.operators import counters, waits
from statloom.plans.ranking import number_times
from statloom.sources.history import BATCH, DAY, day_folders, purge_history, read_history, replace_range, stored_days, write_history

# Days before the first computed one that are read in any case.
DAYS_BEFORE = 7
POLL = ("server_name", "collect_date")
REGISTRY = "_state/polls"  # within a history; readers skip it
_FOLDER = re.compile(rf"/{DAY}=(\d{{4,}}-\d\d-\d\d)/")


def _needed(spark: SparkSession, snapshots: str, first: str, older: Sequence[str] = ()) -> Column:
    """The days to read for computing those from ``first`` on."""
    before = max((day for day in stored_days(spark, snapshots) if day < first), default=first)
    since = F.least(F.lit(before).cast("date"), F.date_sub(F.lit(first).cast("date"), DAYS_BEFORE))
    wanted = F.col("dt") >= since
    if older:
        wanted = wanted | F.col("dt").isin([F.lit(day).cast("date") for day in older])
    return wanted


def snapshots_from(spark: SparkSession, snapshots: str, first: str, older: Sequence[str] = ()) -> DataFrame:
    """The stored snapshots needed to compute the days from ``first`` on; of older folders only ``older`` are read."""
    stored = read_history(spark, snapshots)
    recent = stored.filter(_needed(spark, snapshots, first, older))
    return recent.select([c for c in stored.columns if c not in ("dt", "batch_id")])


def _signatures(*stored: DataFrame) -> dict[str, str]:
    """Per day a digest of the names of its files; a file that is written again has another name."""
    files = defaultdict(list)
    for name in (name for df in stored for name in df.inputFiles()):
        if found := _FOLDER.search(name):
            files[found[1]].append(name)
    return {day: hashlib.md5("\n".join(sorted(names)).encode()).hexdigest() for day, names in files.items()}


def _polls(stored: DataFrame, listed: DataFrame | None, days: Sequence[str], prepare: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """The polls of ``days``: server, time, number of rows and a digest of them; those that are only listed have none."""
    columns = [c for c in stored.columns if c not in (DAY, BATCH)]
    on_days = F.col(DAY).isin([F.lit(day).cast("date") for day in days])
    found = (prepare(stored.filter(on_days).select(columns)).groupBy(*POLL)
             .agg(F.count(F.lit(1)).alias("n"), F.bit_xor(F.xxhash64(*columns)).alias("content")))
    if listed is None:
        return found
    empty = listed.filter(on_days).select(*POLL, F.lit(0).cast("bigint").alias("n"), F.lit(0).cast("bigint").alias("content"))
    return found.unionByName(empty).groupBy(*POLL).agg(F.sum("n").alias("n"), F.bit_xor("content").alias("content"))


def _run(spark: SparkSession, snapshots: str, history: str, as_of, keep: str, compute: Callable[[DataFrame, DataFrame | None], DataFrame],
         recompute: bool, poll_list: str | None, prepare: Callable[[DataFrame], DataFrame] = lambda df: df) -> None:
    """``prepare`` leaves the rows that make up the polls which ``compute`` pairs."""
    polled, listed = stored_days(spark, snapshots), None
    if polled:
        if poll_list and (listed_days := stored_days(spark, poll_list)):
            listed, polled = read_history(spark, poll_list), sorted({*polled, *listed_days})
        path = f"{history.rstrip('/')}/{REGISTRY}"
        stored = read_history(spark, snapshots)
        signatures, known = _signatures(stored, *([] if listed is None else [listed])), {}
        registered = stored_days(spark, path)
        registry = read_history(spark, path) if registered else None
        if registered:
            known = {str(r[DAY]): r["files"] for r in registry.select(DAY, "files").distinct().collect()}
        differ = [day for day in signatures if recompute or known.get(day) != signatures[day]]
        gone = [day for day in registered if day not in signatures]
        polls, first, older = _polls(stored, listed, differ, prepare), None, []
        if recompute or not registered:
            first = polled[0]
        elif differ or gone:
            before = registry.filter(F.col(DAY).isin([F.lit(day).cast("date") for day in differ + gone])).select(polls.columns)
            missing = before.subtract(polls).filter(F.to_date("collect_date") > F.lit(polled[0]).cast("date"))
            day = polls.subtract(before).union(missing).agg(F.min(F.to_date("collect_date"))).first()[0]
            first = day and str(day)
        if first:
            if registered:
                last = registry.filter(F.col(DAY) < F.lit(first).cast("date")).groupBy("server_name").agg(F.max(DAY).alias(DAY))
                older = sorted(str(r[DAY]) for r in last.select(DAY).distinct().collect())
            rows, numbered = prepare(snapshots_from(spark, snapshots, first, older)), None
            if listed is not None:
                numbered = rows.select(*POLL).union(listed.filter(_needed(spark, snapshots, first, older)).select(*POLL))
            result = compute(rows, numbered)
            replace_range(result, history, (first, max(polled[-1], *registered, first)))
        if differ or gone:  # a day that is not in the registry is computed again
            fs, folders = day_folders(spark, path)
            for day, folder in folders:
                if day in differ or day in gone:
                    fs.delete(folder, True)
            names = spark.createDataFrame([(day, signatures[day]) for day in differ], "day string, files string")
            dated = polls.withColumn("day", F.to_date("collect_date"))
            write_history(dated.join(names.select(F.col("day").cast("date"), "files"), "day").drop("day"), path)
    purge_history(spark, history, as_of, keep)


def run_io_solution(spark: SparkSession, snapshots: str, history: str, as_of,
                    keep: str = counters.IO_HISTORY_KEEP, recompute: bool = False, polls: str | None = None) -> None:
    """IO counters: deltas of every poll, kept for a month. Read the result with ``io_readable``."""
    _run(spark, snapshots, history, as_of, keep, counters.io_counter_delta, recompute, polls)


def run_io_alert_solution(spark: SparkSession, snapshots: str, history: str, as_of,
                          keep: str = counters.ALERT_HISTORY_KEEP, recompute: bool = False,
                          polls: str | None = None, **thresholds: int) -> None:
    """IO alerts: only intervals that reach a threshold (``read_ms``, ``write_ms``, ``reads``, ``writes``)."""
    _run(spark, snapshots, history, as_of, keep, lambda df, known: counters.io_threshold_alert(df, polls=known, **thresholds),
         recompute, polls)


def run_wait_solution(spark: SparkSession, snapshots: str, history: str, as_of,
                      keep: str = counters.WAIT_HISTORY_KEEP, recompute: bool = False, polls: str | None = None) -> None:
    """Waits: deltas of the waits that matter. Read the result with ``wait_top_n`` or ``wait_category_rollup``."""
    _run(spark, snapshots, history, as_of, keep, waits.wait_delta, recompute, polls, waits.wait_snapshot_filter)


def number_new_polls(spark: SparkSession, path: str, polls: DataFrame) -> None:
    """Add the polls of ``polls`` (``server_name``, ``collect_date``) to the numbered registry at ``path``, a history.

    Only polls newer than the last one of their server are numbered, going on from its number; those stored keep theirs, so
    adding the same polls again changes nothing. A poll that comes after a newer one of its server gets no number, as a
    stream would drop its rows as late. A stream joins the registry for its ``snapshot_no``; a poll without rows takes a
    number too, and so breaks the pair around it.
    """
    new = polls.select(*POLL).filter(F.col("server_name").isNotNull() & F.col("collect_date").isNotNull())
    if stored_days(spark, path):
        last = read_history(spark, path).groupBy("server_name").agg(
            F.max("collect_date").alias("_last"), F.max("snapshot_no").alias("_no"))
        new = (new.join(last, "server_name", "left")
               .filter(F.col("_last").isNull() | (F.col("collect_date") > F.col("_last"))))
    else:
        new = new.withColumn("_no", F.lit(0))
    offsets = new.groupBy("server_name").agg(F.coalesce(F.max("_no"), F.lit(0)).alias("_before"))
    numbered = number_times(new.select(*POLL), ("server_name",), "collect_date", "snapshot_no").join(offsets, "server_name")
    write_history(numbered.select(*POLL, (F.col("snapshot_no") + F.col("_before")).cast("bigint").alias("snapshot_no")), path)
