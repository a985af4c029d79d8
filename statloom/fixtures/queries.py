"""One registered query per operator, over the adapter views."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from statloom.contracts import SERVER
from statloom.fixtures.inputs import Inputs
from statloom.operators import (
    backups,
    bloat,
    cache,
    columns,
    counters,
    events,
    indexes,
    inventory,
    relations,
    replicas,
    sessions,
    statistics,
    storage,
    waits,
)
from statloom.plans.snapshots import number_snapshots
from statloom.session import SETTINGS, STATE_STORE
from statloom.sources.compaction import compact_history
from statloom.sources.history import read_history, write_history
from statloom.sources.shared import shared_dir
from statloom.sources.event_files import read_event_files, stream_event_files as event_file_stream
from statloom.sources.tables import stream_event_documents, stream_table
from statloom.streaming import jobs

ENRICH_AS_OF = "2024-06-30 12:00:00"
PURGE_AS_OF = "2001-10-31 00:00:00"
PURGE_KEEP = "18 months"
LATENCY_AS_OF = "2024-01-03 04:05:06"
SESSIONS_AS_OF = "2024-02-01 00:00:00"
STATS_AS_OF = "2024-01-01 00:00:00"
SHARED_BUFFERS = 20_000
SLOW_US = 500_000

Query = Callable[[Inputs], DataFrame]
QUERIES: dict[str, Query] = {}


def register(query: Query) -> Query:
    QUERIES[query.__name__] = query
    return query


def plain(df: DataFrame) -> DataFrame:
    """Decimals as bigint (scale 0) or double, so that both engines of the check print them alike."""
    def simple(field: T.StructField):
        if isinstance(field.dataType, T.DecimalType):
            return F.col(field.name).cast("bigint" if field.dataType.scale == 0 else "double").alias(field.name)
        return F.col(field.name)
    return df.select([simple(f) for f in df.schema.fields])


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    def bind(query: Query):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            spark.conf.set("spark.sql.session.timeZone", "UTC")
            return plain(query(Inputs(spark, sf_dir)))
        return run
    return {name: bind(query) for name, query in QUERIES.items()}


# ---------------------------------------------------------------------------------------------- counters and waits

@register
def io_snapshot_enrich(i: Inputs) -> DataFrame:
    return counters.io_snapshot_enrich(i.vfs, i.files, ENRICH_AS_OF)


@register
def io_counter_delta(i: Inputs) -> DataFrame:
    return counters.io_counter_delta(i.io_snapshots)


@register
def io_threshold_alert(i: Inputs) -> DataFrame:
    return counters.io_threshold_alert(i.io_snapshots)


@register
def io_threshold_alert_job(i: Inputs) -> DataFrame:
    return counters.io_threshold_alert(i.io_snapshots, read_ms=50, write_ms=10, reads=100, writes=200)


@register
def io_readable(i: Inputs) -> DataFrame:
    return counters.io_readable(counters.io_counter_delta(i.io_snapshots))


@register
def retention_purge(i: Inputs) -> DataFrame:
    return counters.retention_purge(i.io_snapshots, PURGE_AS_OF, PURGE_KEEP)


@register
def wait_snapshot_filter(i: Inputs) -> DataFrame:
    return waits.wait_snapshot_filter(i.wait_snapshots)


def _wait_history(i: Inputs) -> DataFrame:
    return waits.wait_delta(waits.wait_snapshot_filter(i.wait_snapshots))


@register
def wait_delta(i: Inputs) -> DataFrame:
    return _wait_history(i)


@register
def wait_top_n(i: Inputs) -> DataFrame:
    return waits.wait_top_n(_wait_history(i), 10)


@register
def wait_categorize(i: Inputs) -> DataFrame:
    return waits.wait_categorize(i.wait_snapshots)


@register
def wait_category_rollup(i: Inputs) -> DataFrame:
    return waits.wait_category_rollup(_wait_history(i))


# --------------------------------------------------------------------------------------------------------- events

@register
def slow_event_filter(i: Inputs) -> DataFrame:
    return events.slow_event_filter(i.captured_events, SLOW_US)


@register
def event_shred(i: Inputs) -> DataFrame:
    return events.event_shred(i.event_documents())


@register
def event_rejects(i: Inputs) -> DataFrame:
    return events.event_rejects(i.event_documents(dealt=True)).groupBy("object_name").agg(F.count(F.lit(1)).alias("rejects"))


FILE_DOCUMENTS = 40_000  # of some 1.6 kB: a compressed file is read by one task


def _packed_text(documents: DataFrame, folder: str) -> None:
    """Add documents to a folder in compressed files, a twentieth of their size or so."""
    (documents.select("event_xml").write.mode("append").option("compression", "gzip")
     .option("maxRecordsPerFile", FILE_DOCUMENTS).text(folder))


def _add_event_files(documents: DataFrame, folder: str) -> None:
    """Most documents in rolled-over files, compressed, and some in plain ones, which are read by ranges of bytes."""
    plain = F.col("event_id") % 16 < 2  # even and odd ones
    documents.filter(plain).select("event_xml").write.mode("append").text(folder)
    _packed_text(documents.filter(~plain), folder)


def _event_folder(i: Inputs, name: str) -> str:
    folder = shared_dir(i.spark, name)
    _add_event_files(i.event_documents(dealt=True), folder)
    return folder


@register
def event_files(i: Inputs) -> DataFrame:
    """Captured documents written as files, read back by ranges of bytes (or whole, where compressed), shredded."""
    return events.event_shred(read_event_files(i.spark, _event_folder(i, "event-files")))


@register
def event_file_rejects(i: Inputs) -> DataFrame:
    rejects = events.event_rejects(read_event_files(i.spark, _event_folder(i, "event-file-rejects")))
    name = F.regexp_extract("event_xml", "^<event name=['\"]([a-z_]+)", 1)
    return rejects.groupBy(name.alias("object_name")).agg(F.count(F.lit(1)).alias("rejects"))


@register
def failover_events(i: Inputs) -> DataFrame:
    return events.failover_events(i.event_documents())


@register
def autogrowth_events(i: Inputs) -> DataFrame:
    return events.autogrowth_events(i.trace, i.trace_databases)


@register
def trace_by_host(i: Inputs) -> DataFrame:
    return events.trace_by_host(i.trace, "host3")


# ---------------------------------------------------------------------------------------------------- replication

@register
def replica_status(i: Inputs) -> DataFrame:
    return replicas.replica_status(i.replica_states, i.cluster_databases, i.groups, i.replicas)


@register
def replica_latency(i: Inputs) -> DataFrame:
    return replicas.replica_latency(i.replica_states, LATENCY_AS_OF)


@register
def group_mode(i: Inputs) -> DataFrame:
    return replicas.group_mode(i.groups, i.replicas, i.group_states)


@register
def replica_dashboard(i: Inputs) -> DataFrame:
    return replicas.replica_dashboard(i.groups, i.replicas, i.cluster_states, i.replica_states, i.replica_roles)


@register
def last_log_backup(i: Inputs) -> DataFrame:
    return replicas.last_log_backup(i.databases, i.backupset, i.grouped_databases)


# ------------------------------------------------------------------------------------- backups, jobs and inventory

@register
def backup_history(i: Inputs) -> DataFrame:
    return backups.backup_history(i.backupset, i.backup_media)


@register
def backup_last_n(i: Inputs) -> DataFrame:
    return backups.backup_last_n(i.backupset)


@register
def database_inventory(i: Inputs) -> DataFrame:
    return inventory.database_inventory(i.database_files, i.databases)


@register
def job_inventory(i: Inputs) -> DataFrame:
    return backups.job_inventory(i.jobs, i.job_history)


@register
def permission_report(i: Inputs) -> DataFrame:
    return inventory.permission_report(i.permissions, i.principals, i.tables_catalog, i.schemas)


@register
def role_members(i: Inputs) -> DataFrame:
    return inventory.role_members(i.role_members, i.principals)


# --------------------------------------------------------------------------------------- storage, columns, indexes

@register
def biggest_tables(i: Inputs) -> DataFrame:
    return storage.biggest_tables(i.tables_catalog, i.partitions, i.allocation_units, min_mb=100)


@register
def table_columns(i: Inputs) -> DataFrame:
    return columns.table_columns(i.columns, i.types, i.tables_catalog)


@register
def column_type_search(i: Inputs) -> DataFrame:
    return columns.column_type_search(i.columns, i.types, i.tables_catalog, "%reservation%")


@register
def partition_key_ordinals(i: Inputs) -> DataFrame:
    return indexes.partition_key_ordinals(i.tables_catalog, i.indexes, i.index_columns, i.columns, i.types,
                                          i.partition_schemes, i.partition_functions, i.filegroups)


@register
def table_size(i: Inputs) -> DataFrame:
    return storage.table_size(i.partition_stats, i.internal_tables, i.tables_catalog)


@register
def table_size_limit(i: Inputs) -> DataFrame:
    return storage.table_size_limit(i.partition_stats, i.internal_tables, i.tables_catalog, i.columns, min_mb=10)


def _fingerprints(i: Inputs, column_ids: bool = False) -> DataFrame:
    return indexes.index_fingerprint(i.indexes, i.index_columns, i.columns, i.tables_catalog, i.partitions,
                                     i.allocation_units, column_ids)


@register
def index_fingerprint(i: Inputs) -> DataFrame:
    return _fingerprints(i)


@register
def duplicate_indexes(i: Inputs) -> DataFrame:
    return indexes.duplicate_indexes(_fingerprints(i))


@register
def duplicate_indexes_prefix(i: Inputs) -> DataFrame:
    return indexes.duplicate_indexes(_fingerprints(i, column_ids=True), mode="prefix")


@register
def duplicate_indexes_keys(i: Inputs) -> DataFrame:
    return indexes.duplicate_indexes_keys(_fingerprints(i))


@register
def index_detail(i: Inputs) -> DataFrame:
    return indexes.index_detail(i.indexes, i.index_columns, i.columns, i.tables_catalog, i.partitions,
                                i.allocation_units)


@register
def nonclustered_pk(i: Inputs) -> DataFrame:
    return indexes.nonclustered_pk(i.indexes, i.tables_catalog, i.partitions, i.allocation_units)


@register
def unused_indexes(i: Inputs) -> DataFrame:
    return indexes.unused_indexes(i.indexes, i.index_usage, i.index_columns, i.columns, i.tables_catalog,
                                  i.partitions, i.allocation_units)


@register
def index_columns_search(i: Inputs) -> DataFrame:
    return indexes.index_columns_search(i.indexes, i.index_columns, i.columns, i.types, i.tables_catalog,
                                        "%reservation_%")


@register
def index_usage_search(i: Inputs) -> DataFrame:
    return indexes.index_usage_search(i.indexes, i.index_usage, i.tables_catalog, "%RESERVATION%")


@register
def index_columns_outer(i: Inputs) -> DataFrame:
    return indexes.index_columns_outer(i.indexes, i.index_columns, i.columns, i.tables_catalog)


@register
def index_definition(i: Inputs) -> DataFrame:
    return indexes.index_definition(
        i.tables_catalog, i.indexes, i.index_columns, i.columns, i.index_usage, i.partitions, i.partition_stats,
        i.partition_schemes, i.partition_functions, i.filegroups)


@register
def file_space(i: Inputs) -> DataFrame:
    return storage.file_space(i.files)


# --------------------------------------------------------------------------------------------------- buffer cache

@register
def cache_by_relation(i: Inputs) -> DataFrame:
    return cache.cache_by_relation(i.buffer_pages, i.relations, SHARED_BUFFERS)


@register
def cache_by_relation_nonempty(i: Inputs) -> DataFrame:
    return cache.cache_by_relation(i.buffer_pages, i.relations, SHARED_BUFFERS, nonempty_only=True)


@register
def cache_usage_count(i: Inputs) -> DataFrame:
    return cache.cache_usage_count(i.buffer_pages, i.relations)


@register
def cache_top_relations(i: Inputs) -> DataFrame:
    return cache.cache_top_relations(i.buffer_pages, i.relations)


@register
def cache_usage_dirty(i: Inputs) -> DataFrame:
    return cache.cache_usage_dirty(i.buffer_pages)


@register
def cache_by_database(i: Inputs) -> DataFrame:
    return cache.cache_by_database(i.buffer_pages, SHARED_BUFFERS)


@register
def cache_by_database_ratio(i: Inputs) -> DataFrame:
    return cache.cache_by_database_ratio(i.buffer_pages, i.database_sizes, SHARED_BUFFERS)


@register
def cache_share_total(i: Inputs) -> DataFrame:
    return cache.cache_share_total(i.buffer_pages, i.relations, i.database_sizes, SHARED_BUFFERS)


@register
def cache_share_window(i: Inputs) -> DataFrame:
    return cache.cache_share_window(i.buffer_pages, i.relations, i.database_sizes, SHARED_BUFFERS)


# ---------------------------------------------------------------------------------- sizes, bloat, sessions, ratios

@register
def tablespace_sizes(i: Inputs) -> DataFrame:
    return relations.tablespace_sizes(i.tablespaces)


@register
def schema_privileges(i: Inputs) -> DataFrame:
    return relations.schema_privileges(i.namespaces)


@register
def capture_status(i: Inputs) -> DataFrame:
    return events.capture_status(i.capture_sessions, i.capture_targets, "queries")


@register
def relation_disk_usage(i: Inputs) -> DataFrame:
    return relations.relation_disk_usage(i.relations)


@register
def relation_size_split(i: Inputs) -> DataFrame:
    return relations.relation_size_split(i.relations)


@register
def database_size(i: Inputs) -> DataFrame:
    return relations.database_size(i.database_sizes)


@register
def size_pretty(i: Inputs) -> DataFrame:
    return relations.pretty_sizes(i.relations)


@register
def table_row_counts(i: Inputs) -> DataFrame:
    return relations.table_row_counts(i.tables())


@register
def index_bloat(i: Inputs) -> DataFrame:
    return bloat.index_bloat(i.index_pages, i.column_stats)


@register
def table_bloat(i: Inputs) -> DataFrame:
    return bloat.table_bloat(i.column_stats, i.table_pages, i.index_pages)


@register
def statement_top(i: Inputs) -> DataFrame:
    return sessions.statement_top(i.statements)


@register
def lock_activity(i: Inputs) -> DataFrame:
    return sessions.lock_activity(i.locks, i.relations, i.sessions, own_pid=17)


@register
def lock_activity_inner(i: Inputs) -> DataFrame:
    return sessions.lock_activity(i.locks, i.relations, i.sessions, own_pid=17, how="inner")


@register
def session_counts(i: Inputs) -> DataFrame:
    return sessions.session_count_summary(i.sessions)


@register
def connection_headroom(i: Inputs) -> DataFrame:
    return sessions.connection_headroom(i.sessions, i.settings, i.connection_limits)


@register
def long_sessions(i: Inputs) -> DataFrame:
    return sessions.long_sessions(i.sessions, SESSIONS_AS_OF, own_pid=17)


@register
def database_stats(i: Inputs) -> DataFrame:
    return statistics.database_stats(i.database_stats, STATS_AS_OF)


@register
def database_hit_ratio(i: Inputs) -> DataFrame:
    return statistics.database_hit_ratio(i.database_stats, i.stat_databases)


@register
def global_hit_ratio(i: Inputs) -> DataFrame:
    return statistics.global_hit_ratio(i.table_io)


@register
def table_hit_ratio(i: Inputs) -> DataFrame:
    return statistics.table_hit_ratio(i.table_io)


@register
def table_hit_ratio_simple(i: Inputs) -> DataFrame:
    return statistics.table_hit_ratio_simple(i.table_io)


@register
def dead_tuple_ratio(i: Inputs) -> DataFrame:
    return statistics.dead_tuple_ratio(i.table_io)


@register
def low_use_indexes(i: Inputs) -> DataFrame:
    return statistics.low_use_indexes(i.index_scans)


@register
def read_throughput(i: Inputs) -> DataFrame:
    return statistics.read_throughput(i.database_stats)


# ------------------------------------------------------------------------------------------------------ streaming

def _written(i: Inputs, df: DataFrame, path: str) -> DataFrame:
    """``df`` from files, where it is used several times."""
    df.write.parquet(path)
    return i.spark.read.schema(df.schema).parquet(path)


def _staged(i: Inputs, snapshots: DataFrame, folder: str) -> DataFrame:
    """Numbered snapshots, computed once."""
    given = _written(i, snapshots, f"{folder}-given")
    return _written(i, given.join(number_snapshots(given, SERVER), [*SERVER, "collect_date"]), f"{folder}-staged")


def _numbered_stream(i: Inputs, snapshots: DataFrame, folder: str) -> DataFrame:
    """Numbered snapshots as a stream of files: the early polls were written first, the later ones after them."""
    i.spark.conf.set(STATE_STORE, SETTINGS[STATE_STORE])  # these queries run in any session
    staged = _staged(i, snapshots, folder)
    for part, wanted in (("early", F.col("snapshot_no") <= 15), ("later", F.col("snapshot_no") > 15)):
        staged.filter(wanted).write.parquet(f"{folder}/{part}")
    files_per_batch = max(4, len(staged.inputFiles()))
    return stream_table(i.spark, f"{folder}/*", staged, files_per_batch)


def _stream_result(i: Inputs, stream: DataFrame, folder: str) -> DataFrame:
    jobs.run_to_parquet(stream, f"{folder}-out", f"{folder}-checkpoint")
    return i.spark.read.schema(stream.schema).parquet(f"{folder}-out")


@register
def stream_counter_delta(i: Inputs) -> DataFrame:
    folder = shared_dir(i.spark, "stream-delta")
    return _stream_result(i, jobs.stream_counter_delta(_numbered_stream(i, i.io_snapshots, folder)), folder)


@register
def stream_threshold_alert(i: Inputs) -> DataFrame:
    folder = shared_dir(i.spark, "stream-alert")
    return _stream_result(i, jobs.stream_threshold_alert(_numbered_stream(i, i.io_snapshots, folder)), folder)


@register
def stream_wait_delta(i: Inputs) -> DataFrame:
    folder = shared_dir(i.spark, "stream-waits")
    snapshots = waits.wait_snapshot_filter(i.wait_snapshots)
    return _stream_result(i, jobs.stream_wait_delta(_numbered_stream(i, snapshots, folder)), folder)


@register
def stream_slow_events(i: Inputs) -> DataFrame:
    folder = shared_dir(i.spark, "stream-events")
    lines = F.replace("event_xml", F.lit("\n"), F.lit("&#10;"))  # a text source has one document in a line
    _packed_text(i.event_documents(dealt=True).select(lines.alias("event_xml")), folder)
    stream = jobs.stream_slow_events(stream_event_documents(i.spark, folder), SLOW_US)
    return _stream_result(i, stream, folder)


@register
def stream_retention(i: Inputs) -> DataFrame:
    folder = shared_dir(i.spark, "stream-retention")
    stream = _numbered_stream(i, i.io_snapshots, folder).drop("snapshot_no")
    jobs.stream_with_retention(stream, f"{folder}-out", f"{folder}-checkpoint", PURGE_KEEP).awaitTermination()
    return read_history(i.spark, f"{folder}-out").drop("dt", "batch_id")


@register
def history_compaction(i: Inputs) -> DataFrame:
    """Snapshots that arrive in parts, their days compacted after the second and, with late rows, after the third."""
    folder = shared_dir(i.spark, "history-compaction")
    given = _written(i, i.io_snapshots, f"{folder}-given")
    parts = given.withColumn("part", F.pmod(F.xxhash64("server_name", "collect_date"), F.lit(3)))
    last = str(given.agg(F.to_date(F.max("collect_date"))).first()[0])
    for part in range(3):
        write_history(parts.filter(F.col("part") == part).drop("part"), folder)
        if part:
            compact_history(i.spark, folder, last)
    return read_history(i.spark, folder).drop("dt")


LATE_POLL = 7


def _routed_counters(i: Inputs, folder: str) -> DataFrame:
    """Runs the stream twice: over the early polls but one, then over that one and the later polls. Returns the snapshots."""
    i.spark.conf.set(STATE_STORE, SETTINGS[STATE_STORE])
    staged = _staged(i, i.io_snapshots, folder)
    early = (F.col("snapshot_no") <= 15) & (F.col("snapshot_no") != LATE_POLL)
    for part, wanted in (("early", early), ("later", ~early)):
        staged.filter(wanted).write.parquet(f"{folder}/{part}")
        jobs.stream_counters_routed(stream_table(i.spark, f"{folder}/*", staged), f"{folder}-out", f"{folder}-checkpoint").awaitTermination()
    return staged


@register
def stream_late_snapshots(i: Inputs) -> DataFrame:
    folder = shared_dir(i.spark, "stream-late")
    staged = _routed_counters(i, folder)
    return jobs.routed_late(i.spark, f"{folder}-out", staged)


@register
def stream_deltas_routed(i: Inputs) -> DataFrame:
    folder = shared_dir(i.spark, "stream-routed")
    staged = _routed_counters(i, folder)
    return jobs.routed_deltas(i.spark, f"{folder}-out", staged)


def _routed_events(i: Inputs, folder: str) -> DataFrame:
    lines = F.replace("event_xml", F.lit("\n"), F.lit("&#10;"))  # a text source has one document in a line
    _packed_text(i.event_documents(dealt=True).select(lines.alias("event_xml")), folder)
    documents = stream_event_documents(i.spark, folder)
    jobs.stream_events_routed(documents, f"{folder}-out", f"{folder}-checkpoint", SLOW_US).awaitTermination()
    return documents


@register
def stream_events_routed(i: Inputs) -> DataFrame:
    folder = shared_dir(i.spark, "stream-events-routed")
    return jobs.routed_events(i.spark, f"{folder}-out", _routed_events(i, folder))


@register
def stream_event_rejects(i: Inputs) -> DataFrame:
    folder = shared_dir(i.spark, "stream-rejects")
    rejects = jobs.routed_rejects(i.spark, f"{folder}-out", _routed_events(i, folder))
    name = F.regexp_extract("event_xml", "^<event name=['\"]([a-z_]+)", 1)
    return rejects.groupBy(name.alias("object_name")).agg(F.count(F.lit(1)).alias("rejects"))


@register
def stream_event_files(i: Inputs) -> DataFrame:
    """Slow events of event files; more files arrive between two runs, and the second goes on from the first's offsets."""
    folder = shared_dir(i.spark, "stream-event-files")
    documents = i.event_documents(dealt=True).withColumn("early", F.col("event_id") % 2 == 0)
    for early in (True, False):
        _add_event_files(documents.filter(F.col("early") == early), folder)
        slow = jobs.stream_slow_events(event_file_stream(i.spark, folder), SLOW_US)
        jobs.run_to_parquet(slow, f"{folder}-out", f"{folder}-checkpoint")
    return i.spark.read.parquet(f"{folder}-out")
