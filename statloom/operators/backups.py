"""Backup and job history."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from statloom.contracts import DATABASE, check
from statloom.functions import clock_text, like_any_case, seconds_between, whole_div
from statloom.functions.numeric import quotient
from statloom.plans.ranking import top_n

BYTES_PER_MB = 1024 * 1024


def _size_mb(kind: str) -> Column:
    return quotient(F.col("compressed_backup_size"), F.lit(BYTES_PER_MB), 2).cast(kind)


def backup_history(
    backupset: DataFrame, media: DataFrame, database: str | None = None, limit: int = 100,
) -> DataFrame:
    """The newest ``limit`` backups of one database, or of every database, with their devices, size and duration.

    The seconds of ``hours_minutes`` are the real seconds of the minute; the original query prints the last
    two digits of the seconds of the hour. The join comes before the limit because a backup may have several devices.
    """
    check(backupset, "backupset")
    check(media, "backup_media")
    rows = backupset if database is None else backupset.filter(F.col("database_name") == database)
    seconds = seconds_between(F.col("backup_start_date"), F.col("backup_finish_date"))
    devices = media.select("server_name", "media_set_id", "logical_device_name", "physical_device_name")
    report = (rows.join(devices, ["server_name", "media_set_id"])
              .select("server_name", "media_set_id", "database_name", "type", "backup_finish_date",
                      _size_mb("decimal(18,2)").alias("compressed_backup_size_mb"),
                      "logical_device_name", "physical_device_name",
                      seconds.alias("duration_sec"), clock_text(seconds).alias("hours_minutes")))
    return top_n(report, limit, [F.col("backup_finish_date").desc_nulls_last(), F.col("server_name"),
                                 F.col("media_set_id"), F.col("physical_device_name")], per=DATABASE)


def _long_duration(start: Column, finish: Column) -> Column:
    """``Nd hh:mm:ss:mmm`` between two times."""
    millis = whole_div(F.unix_micros(finish.cast("timestamp")) - F.unix_micros(start.cast("timestamp")), 1000)
    seconds = whole_div(millis, 1000)
    return F.format_string(
        "%dd %02d:%02d:%02d:%03d", whole_div(seconds, 86_400), whole_div(seconds % 86_400, 3600),
        whole_div(seconds % 3600, 60), seconds % 60, millis % 1000)


def backup_last_n(backupset: DataFrame, databases: Sequence[str] | None = None, n: int = 10) -> DataFrame:
    """The last ``n`` backups per database and type, newest first."""
    check(backupset, "backupset")
    rows = backupset if databases is None else backupset.filter(F.col("database_name").isin(list(databases)))
    newest = [F.col("backup_start_date").desc_nulls_last(), F.col("backup_finish_date").desc_nulls_last(),
              F.col("media_set_id")]
    start, finish = F.col("backup_start_date"), F.col("backup_finish_date")
    return (top_n(rows, n, newest, per=(*DATABASE, "type"))
            .select(*DATABASE, "type", "media_set_id", "backup_start_date", "backup_finish_date",
                    seconds_between(start, finish).alias("duration_sec"),
                    _long_duration(start, finish).alias("duration"),
                    _size_mb("decimal(10,2)").alias("compressed_backup_size_mb"))
            .orderBy(finish.desc_nulls_last(), *DATABASE, "type", "media_set_id"))


def job_inventory(jobs: DataFrame, history: DataFrame, hidden: str = "DBA%") -> DataFrame:
    """Jobs with last run date and average run time; names LIKE ``hidden`` are left out.

    Run times come as HHMMSS integers and are decoded to seconds before averaging (the original query averages the
    encoded integers). The average is a whole number of seconds. History is reduced per job before the join.
    """
    check(jobs, "jobs")
    check(history, "job_history")
    encoded = F.col("run_duration")
    seconds = (whole_div(encoded, 10_000) * 3600 + whole_div(encoded % 10_000, 100) * 60 + encoded % 100).cast("bigint")
    runs = (history.groupBy("server_name", "job_id")
            .agg(F.max("run_date").alias("last_run_date"),
                 F.sum(seconds).alias("_total"), F.count(seconds).alias("_runs")))
    return (jobs.filter(~like_any_case(F.col("name"), hidden))
            .join(runs, ["server_name", "job_id"], "left")
            .select("server_name", F.col("name").alias("job_name"), "date_created", "enabled", "last_run_date",
                    whole_div(F.col("_total"), F.col("_runs")).alias("avg_run_duration_sec"))
            .orderBy("server_name", "job_name"))
