"""Append-only histories stored as Parquet partitioned by day (``dt``)."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DateType, LongType, StructField, StructType

from statloom.operators.counters import IO_HISTORY_KEEP, retention_cutoff
from statloom.sources import compaction, manifest
from statloom.sources.manifest import BATCH, DAY

TIME_TEXT = "yyyy-MM-dd HH:mm:ss.SSSSSS"
_DAY_NAME = re.compile(r"\d{4,}-\d\d-\d\d")


def write_history(
    df: DataFrame, path: str, at: str = "collect_date", batch_id: int | None = None, replace_days: bool = False,
) -> None:
    """Append ``df`` to the history at ``path``, one folder per day.

    Rows are rebalanced by day first: small days end up in one file and adaptive execution splits a day that is
    too large for one. With ``batch_id`` the write is repeatable: a batch that is run again replaces its own files.
    With ``replace_days`` the days present in ``df`` are replaced as a whole; ``replace_range`` does so for days that
    have no rows any more too. Rows without a time go to a folder of their own, which no purge looks at.
    """
    dated = df.withColumn(DAY, F.to_date(at)).hint("rebalance", DAY)
    if batch_id is not None:
        dated = dated.withColumn(BATCH, F.lit(batch_id))
    folders = [DAY] if batch_id is None else [DAY, BATCH]
    if batch_id is None and not replace_days:
        dated.write.mode("append").partitionBy(*folders).parquet(path)
    else:
        (dated.write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
         .partitionBy(*folders).parquet(path))


def write_routed(df: DataFrame, path: str, route: str, at: str, batch_id: int) -> None:
    """Append a batch to several histories at once: rows go to ``path``/``route``=their value, by day and batch in there.

    One write serves all, so ``df`` is computed once. A batch that is run again replaces its own files.
    """
    dated = df.withColumns({DAY: F.to_date(at), BATCH: F.lit(batch_id)}).hint("rebalance", route, DAY)
    (dated.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(route, DAY, BATCH).parquet(path))


def read_route(spark: SparkSession, path: str, value: str, schema: StructType, route: str | None = None) -> DataFrame:
    """The rows that ``write_routed`` put under ``value``; none if it never wrote any. ``schema`` has no partition columns."""
    root = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    fs = root.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    names = [s.getPath() for s in fs.listStatus(root) if s.isDirectory()] if fs.exists(root) else []
    found = [p.toString() for p in names if p.getName().split("=", 1)[-1] == value and (route is None or p.getName() == f"{route}={value}")]
    whole = StructType([*schema.fields, StructField(DAY, DateType()), StructField(BATCH, LongType())])
    if len(found) == 1 and (state := manifest.load(spark, found[0])).days:
        return manifest.resolved(spark, found[0], state).select(*[F.col(f.name).cast(f.dataType) for f in whole])
    return spark.read.schema(whole).parquet(*found) if found else spark.createDataFrame([], whole)


def newest_of_batch(spark: SparkSession, path: str, batch_id: int, at: str = "collect_date") -> str | None:
    """The latest ``at`` that a batch has written, as text; only the newest of its days is read. None without any."""
    fs, days = day_folders(spark, path)
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs
    for _, folder in sorted(days, key=lambda d: d[0], reverse=True):
        own = hadoop.Path(folder, f"{BATCH}={batch_id}")
        if fs.exists(own):
            return spark.read.parquet(own.toString()).agg(F.date_format(F.max(at), TIME_TEXT).alias("at")).first()["at"]
    return None


def replace_range(df: DataFrame, path: str, days: tuple[str, str], at: str = "collect_date") -> None:
    """Make ``df`` the content of all days from the first to the last of ``days``, those without rows included.

    Rows of ``df`` outside that range are not written. The days with rows are replaced first; a run that stops before
    the emptied ones are dropped is made good by running it again. ``df`` is computed once: a day was written if it has
    files that were not there before. Compacted days in the range are plain folders again.
    """
    spark, (first, last) = df.sparkSession, days
    inside = df.filter(F.to_date(at).between(F.lit(first).cast("date"), F.lit(last).cast("date")))

    def in_range():
        fs, folders = day_folders(spark, path)
        return fs, {day: (folder, frozenset(s.getPath().getName() for s in fs.listStatus(folder)))
                    for day, folder in folders if first <= day <= last}

    _, before = in_range()
    write_history(inside, path, at, replace_days=True)
    fs, after = in_range()
    for day, (folder, names) in after.items():
        if day in before and before[day][1] == names:
            fs.delete(folder, True)
    state = manifest.load(spark, path.rstrip("/"))
    if any(first <= day <= last for day in state.days):
        manifest.commit(spark, path.rstrip("/"), state, {d: entry for d, entry in state.days.items() if not first <= d <= last})


def read_history(spark: SparkSession, path: str) -> DataFrame:
    """The history at ``path``, compacted days from their manifest; filter on ``dt`` to read only some days."""
    root = path.rstrip("/")
    state = manifest.load(spark, root)
    return manifest.resolved(spark, root, state) if state.days else spark.read.parquet(path)


def day_folders(spark: SparkSession, path: str):
    """The day folders of a history, as (date text, Hadoop path), with their file system; not those of compacted rows."""
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs
    root = hadoop.Path(path)
    fs = root.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    folders = [s.getPath() for s in fs.listStatus(root) if s.isDirectory()] if fs.exists(root) else []
    marked = [(p.getName(), p) for p in folders if p.getName().startswith(f"{DAY}=")]
    named = [(name.split("=", 1)[1], p) for name, p in marked]
    return fs, [(day, p) for day, p in named if _DAY_NAME.fullmatch(day)]  # rows without a time have no place in time


def stored_days(spark: SparkSession, path: str) -> list[str]:
    """The days of a history in order, from the names of its folders and its manifest."""
    return sorted({day for day, _ in day_folders(spark, path)[1]} | set(manifest.load(spark, path.rstrip("/")).days))


def newest_time(spark: SparkSession, path: str, at: str = "collect_date") -> str | None:
    """The latest ``at`` in a history, as text; only the newest day is read."""
    days = stored_days(spark, path)
    if not days:
        return None
    newest_day = read_history(spark, path).filter(F.col(DAY) == F.lit(days[-1]).cast("date"))
    return newest_day.agg(F.date_format(F.max(at), TIME_TEXT).alias("at")).first()["at"]


def purge_history(
    spark: SparkSession, path: str, as_of, keep: str = IO_HISTORY_KEEP, at: str = "collect_date",
) -> int:
    """Delete rows older than ``keep`` before ``as_of``; returns how many days were dropped whole.

    Days before the cutoff are dropped as folders without reading them; only the day of the cutoff is rewritten,
    into a hidden folder that is swapped in when it is complete. A purge that was interrupted is finished by the
    next one, wherever it stopped: once the old day has been set aside, whatever stands in its place is newer and is
    kept, together with the staged rows. Purging twice changes nothing. Where days have been compacted, a new manifest
    takes out all that goes in one step, before any folder is deleted, and the day of the cutoff gets a new version.
    """
    cutoff = retention_cutoff(as_of, keep)
    boundary = spark.range(1).select(F.date_format(cutoff, "yyyy-MM-dd").alias("day")).first()["day"]
    root = path.rstrip("/")
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs
    fs, days = day_folders(spark, root)

    def swap_in(day: str) -> None:
        staged, replaced = hadoop.Path(f"{root}/_purge_{day}"), hadoop.Path(f"{root}/_purged_{day}")
        target, kept = hadoop.Path(f"{root}/{DAY}={day}"), hadoop.Path(f"{root}/_purge_{day}/{DAY}={day}")
        if not fs.exists(replaced) and fs.exists(target):
            fs.rename(target, replaced)
        if fs.exists(kept):
            merge(kept, target)
        fs.delete(staged, True)  # before what tells that the old day was set aside
        fs.delete(replaced, True)

    def merge(source, target) -> None:
        """Move ``source`` to ``target``, file by file where that exists; files have names of their own."""
        if not fs.exists(target):
            fs.rename(source, target)
            return
        for status in fs.listStatus(source):
            name = status.getPath().getName()
            if status.isDirectory():
                merge(status.getPath(), hadoop.Path(target, name))
            else:
                fs.rename(status.getPath(), hadoop.Path(target, name))

    names = ([s.getPath().getName() for s in fs.listStatus(hadoop.Path(root))] if fs.exists(hadoop.Path(root)) else [])
    for name in names:
        if name.startswith("_purged_"):  # the old day is out of the way, so its rows were staged completely
            if f"_purge_{name[8:]}" in names:
                swap_in(name[8:])
            else:
                fs.delete(hadoop.Path(f"{root}/{name}"), True)

    state = manifest.load(spark, root)
    if state.days:
        return _purge_compacted(spark, root, state, cutoff, boundary, at)
    dropped = 0
    for day, folder in days:
        if day < boundary:
            fs.delete(folder, True)
            dropped += 1
    if any(day == boundary for day, _ in days):
        on_day = read_history(spark, root).filter(F.col(DAY) == F.lit(boundary).cast("date"))
        if not on_day.filter(F.col(at) < cutoff).isEmpty():
            inside = [c for c in (DAY, BATCH) if c in on_day.columns]
            (on_day.filter(F.col(at) >= cutoff).write.mode("overwrite").partitionBy(*inside)
             .parquet(f"{root}/_purge_{boundary}"))
            swap_in(boundary)
    return dropped


def _purge_compacted(spark: SparkSession, root: str, state: manifest.Manifest, cutoff, boundary: str, at: str) -> int:
    fs, folders = day_folders(spark, root)
    _, hadoop_path = manifest.file_system(spark, root)
    old = {day for day in stored_days(spark, root) if day < boundary}
    left = {day: entry for day, entry in state.days.items() if day not in old}
    if boundary in left or any(day == boundary for day, _ in folders):
        on_day = manifest.resolved(spark, root, state, [boundary])
        if not on_day.filter(F.col(at) < cutoff).isEmpty():
            left[boundary] = compaction.rewritten(spark, root, state, boundary, at, keep=F.col(at) >= cutoff)
    if left != state.days:
        manifest.commit(spark, root, state, left)
    for day in old:
        fs.delete(hadoop_path(f"{root}/{DAY}={day}"), True)
        fs.delete(hadoop_path(f"{root}/{manifest.CLOSED}/{DAY}={day}"), True)
    return len(old)
