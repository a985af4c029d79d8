"""Database, table and index statistics: hit ratios, dead tuples, low-use indexes."""

from __future__ import annotations

from functools import reduce
from operator import add

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from statloom.contracts import DATABASE, check
from statloom.functions import percent, seconds_between, size_pretty, whole_div
from statloom.functions.times import as_timestamp

# Marks of the total rows, scan limit of a rarely used index, dead share that warns, warning text.
TOTAL_ROW = "all"
SIMPLE_TOTAL_ROW = "-ALL-"
LOW_USE_SCANS = 100
DEAD_TUPLE_RATIO = 0.2
VACUUM_WARNING = "WARNING - VACCUM Frequency could be low"

TABLE_IO_BLOCKS = ("heap", "idx", "toast", "tidx")


def _hit_percent(hit: Column, read: Column) -> Column:
    return percent(hit, hit + read, 2)


def database_stats(stats: DataFrame, as_of) -> DataFrame:
    """Size, hit ratio, seconds since the counters were reset, temporary files, conflicts and deadlocks.

    The hit ratio is NULL unless something was read from disk.
    """
    check(stats, "database_stats")
    hit, read = F.col("blks_hit"), F.col("blks_read")
    return stats.select(
        *DATABASE, size_pretty(F.col("size_bytes")).alias("size"),
        F.when(read > 0, _hit_percent(hit, read)).alias("hit_ratio"),
        seconds_between(F.col("stats_reset"), as_timestamp(as_of)).alias("stat_uptime_sec"),
        "temp_files", size_pretty(F.col("temp_bytes")).alias("temp_size"), "conflicts", "deadlocks")


def database_hit_ratio(stats: DataFrame, databases: DataFrame) -> DataFrame:
    """Blocks read and hit per known database with the hit ratio; NULL without traffic."""
    check(stats, "database_stats")
    known = databases.select(*DATABASE).distinct()
    return (stats.join(known, list(DATABASE), "left_semi")
            .select(*DATABASE, "blks_read", "blks_hit",
                    _hit_percent(F.col("blks_hit"), F.col("blks_read")).alias("blks_hit_ratio")))


def global_hit_ratio(table_io: DataFrame) -> DataFrame:
    """Heap blocks read and hit over all user tables of a database, with the hit ratio."""
    check(table_io, "table_io")
    return (table_io.groupBy(*DATABASE)
            .agg(F.sum("heap_blks_read").alias("heap_read"), F.sum("heap_blks_hit").alias("heap_hit"))
            .withColumn("hit_ratio", _hit_percent(F.col("heap_hit"), F.col("heap_read"))))


def _blocks(table_io: DataFrame, kind: str) -> Column:
    """Blocks of one kind over heap, index and TOAST; kinds that were not exported and NULLs count 0."""
    names = [f"{part}_blks_{kind}" for part in TABLE_IO_BLOCKS]
    return reduce(add, [F.coalesce(F.col(n), F.lit(0)) for n in names if n in table_io.columns])


def table_hit_ratio(table_io: DataFrame) -> DataFrame:
    """Disk and cache share per table plus one ``all`` row per database on top; tables without traffic are dropped.

    The table rows are a narrow projection of the scan; only the total is aggregated.
    """
    check(table_io, "table_io")
    rows = table_io.select(*DATABASE, F.lit(1).alias("_order"), F.col("relname").alias("table_name"),
                           _blocks(table_io, "read").cast("bigint").alias("disk_hits"),
                           _blocks(table_io, "hit").cast("bigint").alias("_cache"))
    total = (rows.groupBy(*DATABASE).agg(F.sum("disk_hits").alias("disk_hits"), F.sum("_cache").alias("_cache"))
             .select(*DATABASE, F.lit(0).alias("_order"), F.lit(TOTAL_ROW).alias("table_name"), "disk_hits", "_cache"))
    both = F.col("disk_hits") + F.col("_cache")
    return (total.unionByName(rows).filter(both > 0)
            .orderBy(*DATABASE, "_order", F.col("disk_hits").desc(), "table_name")
            .select(*DATABASE, "table_name", "disk_hits",
                    percent(F.col("disk_hits"), both, 2).alias("percent_disk_hits"),
                    percent(F.col("_cache"), both, 2).alias("percent_cache_hits"), both.alias("total_hits")))


def table_hit_ratio_simple(table_io: DataFrame) -> DataFrame:
    """Heap and index hit ratios per table, the ``-ALL-`` row of each database first.

    Only the index blocks are guarded: a table with unknown heap blocks has an unknown total and counts for nothing
    in the overall heap figures.
    """
    check(table_io, "table_io")

    def optional(name: str) -> Column:
        return F.coalesce(F.col(name), F.lit(0))

    figures = ["from_disk", "from_cache", "index_from_disk", "index_from_cache"]
    rows = table_io.select(
        *DATABASE, F.lit(1).alias("_order"), "schemaname", "relname",
        (F.col("heap_blks_read") + optional("idx_blks_read")).alias("from_disk"),
        (F.col("heap_blks_hit") + optional("idx_blks_hit")).alias("from_cache"),
        optional("idx_blks_read").alias("index_from_disk"), optional("idx_blks_hit").alias("index_from_cache"))
    mark = F.lit(SIMPLE_TOTAL_ROW)
    total = (rows.groupBy(*DATABASE).agg(*[F.sum(c).alias(c) for c in figures])
             .select(*DATABASE, F.lit(0).alias("_order"), mark.alias("schemaname"), mark.alias("relname"), *figures))
    report = total.unionByName(rows).withColumns({
        "cache_hit_ratio": _hit_percent(F.col("from_cache"), F.col("from_disk")),
        "index_hit_ratio": _hit_percent(F.col("index_from_cache"), F.col("index_from_disk"))})
    return (report.orderBy(*DATABASE, "_order", F.col("cache_hit_ratio").desc_nulls_last(), "schemaname", "relname")
            .select(*DATABASE, "schemaname", "relname", "from_disk", "from_cache", "cache_hit_ratio",
                    "index_hit_ratio"))


def dead_tuple_ratio(tables: DataFrame) -> DataFrame:
    """Dead share of all tuples in whole percent, with a warning from 20 % of live plus dead on, worst first."""
    check(tables, "table_tuples")
    live, dead = F.col("n_live_tup"), F.col("n_dead_tup")
    both = live + dead
    warn = (live > 0) & (dead >= DEAD_TUPLE_RATIO * both)
    return (tables.select(
        *DATABASE, "schemaname", "relname", "n_live_tup", "n_dead_tup",
        F.when(both > 0, whole_div(dead * 100, both)).alias("vacuum_ratio"),
        F.when(warn, F.lit(VACUUM_WARNING)).alias("vacuum_warning"), "last_vacuum", "last_autovacuum")
        .orderBy(F.col("vacuum_ratio").desc_nulls_last(), *DATABASE, "schemaname", "relname"))


def low_use_indexes(index_scans: DataFrame, max_scans: int = LOW_USE_SCANS) -> DataFrame:
    """Indexes scanned at most ``max_scans`` times, least used first, then largest."""
    check(index_scans, "index_scans")
    return (index_scans.filter(F.col("idx_scan") <= max_scans)
            .select(*DATABASE, "schemaname", "relname", "indexrelname", "idx_scan", "idx_tup_read", "idx_tup_fetch",
                    "size_bytes", size_pretty(F.col("size_bytes")).alias("size"))
            .orderBy("idx_scan", F.col("size_bytes").desc_nulls_last(), *DATABASE, "schemaname", "indexrelname"))


def read_throughput(stats: DataFrame) -> DataFrame:
    """Blocks read per millisecond of read time, per database; NULL when no time was spent."""
    check(stats, "database_stats")
    time = F.sum("blk_read_time")
    return stats.groupBy(*DATABASE).agg(
        F.when(time > 0, F.sum("blks_read").cast("double") / F.nullif(time, F.lit(0.0))).alias("blocks_per_ms"))

