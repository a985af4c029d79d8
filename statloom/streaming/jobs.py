"""Streaming jobs: counter deltas, threshold alerts, slow events, retention after every batch."""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from statloom.contracts import SERVER
from statloom.operators import counters, events, waits
from statloom.sources.compaction import compact_history
from statloom.sources.history import newest_of_batch, newest_time, purge_history, read_route, write_history, write_routed
from statloom.streaming.lookback import LATE, PAIRED
from statloom.streaming.pairing import pair_stream

EVENT, REJECT = "event", "reject"


def stream_io_pairs(snapshots: DataFrame) -> DataFrame:
    """IO snapshots with status and previous counters; filter on ``status`` to count late rows."""
    return pair_stream(snapshots, SERVER, counters.IO_KEYS, counters.IO_COUNTERS)


def stream_counter_delta(snapshots: DataFrame) -> DataFrame:
    """``io_counter_delta`` on a stream of numbered snapshots; late snapshots are dropped."""
    paired = stream_io_pairs(snapshots).filter((F.col("status") == PAIRED) & counters.has_io_activity())
    return counters.with_io_deltas(paired).drop("status", "snapshot_no")


def stream_threshold_alert(
    snapshots: DataFrame, read_ms: int = 25, write_ms: int = 50, reads: int = 100, writes: int = 200,
) -> DataFrame:
    """``io_threshold_alert`` on a stream of numbered snapshots."""
    alerts = stream_io_pairs(snapshots).filter(
        (F.col("status") == PAIRED) & counters.crosses_io_threshold(read_ms, write_ms, reads, writes))
    return counters.with_io_deltas(alerts).drop("status", "snapshot_no")


def stream_wait_delta(snapshots: DataFrame) -> DataFrame:
    """``wait_delta`` on a stream of numbered, already filtered wait snapshots.

    The cumulative task count and maximum ride along in the state like counters.
    """
    carried = (*waits.WAIT_DELTA_COUNTERS, "waiting_tasks_count", "max_wait_time_ms")
    paired = pair_stream(snapshots, SERVER, ("wait_type",), carried).filter(F.col("status") == PAIRED)
    return waits.with_wait_deltas(paired).drop(
        "status", "snapshot_no", "prev_waiting_tasks_count", "prev_max_wait_time_ms")


def late_snapshots(snapshots: DataFrame) -> DataFrame:
    """The rows ``stream_counter_delta`` drops because a newer snapshot of their key was already seen."""
    return stream_io_pairs(snapshots).filter(F.col("status") == LATE)


def stream_slow_events(documents: DataFrame, min_us: int = events.SLOW_MICROSECONDS) -> DataFrame:
    """Slow events of a stream (or batch) of event documents, shredded into typed columns.

    The capture type is the event name in the document. No state and no shuffle.
    """
    captured = events.parse_events(documents).withColumns({
        "object_name": F.col("_name"),
        "duration": events.event_field("data", "duration", "bigint"),
        "transaction_state": events.event_field("data", "transaction_state", "int")})
    return events.shred_parsed(events.slow_event_filter(captured, min_us))


def run_to_parquet(stream: DataFrame, path: str, checkpoint: str) -> None:
    """Process everything that has arrived, append it to ``path`` and stop. Progress survives in ``checkpoint``."""
    query = (stream.writeStream.format("parquet").outputMode("append").option("path", path)
             .option("checkpointLocation", checkpoint).trigger(availableNow=True).start())
    query.awaitTermination()


def stream_with_retention(
    stream: DataFrame, path: str, checkpoint: str, keep: str = counters.IO_HISTORY_KEEP,
    at: str = "collect_date", available_now: bool = True, compact: bool = False,
) -> StreamingQuery:
    """Append every batch to the day-partitioned history at ``path`` and purge it when a new day begins.

    With ``compact`` the days before the new one are compacted then, too, those with late rows again.

    The purge is driven by the newest event time, not by the wall clock. After a start the history itself is read for
    it, after that only the newest day that a batch has written. A batch that is repeated after a failure replaces its own
    files, so nothing is stored twice. A batch without rows, or with rows without a time only, moves nothing.
    """
    spark: SparkSession = stream.sparkSession

    times: dict[str, str | None] = {"newest": None, "purged": None}

    def append_and_purge(batch: DataFrame, batch_id: int) -> None:
        known = times["newest"] if times["newest"] is not None else newest_time(spark, path, at)
        write_history(batch, path, at, batch_id)
        newest = max((t for t in (known, newest_of_batch(spark, path, batch_id, at)) if t is not None), default=None)
        times["newest"] = newest
        if newest is not None and newest[:10] != times["purged"]:
            purge_history(spark, path, newest, keep, at)
            if compact:
                compact_history(spark, path, newest[:10], at)
            times["purged"] = newest[:10]

    return _started(stream, append_and_purge, checkpoint, available_now)


ADAPTIVE = "spark.sql.adaptive.enabled"


@contextmanager
def _adaptive(spark: SparkSession, wanted: str) -> Iterator[None]:
    """Streams with state run without adaptive execution, where Spark drops the hint to rebalance by day and every task would
    write a file for every day. What is done with a batch has no state any more, so it gets the setting of the caller's session."""
    before = spark.conf.get(ADAPTIVE)
    spark.conf.set(ADAPTIVE, wanted)
    try:
        yield
    finally:
        spark.conf.set(ADAPTIVE, before)


def _started(stream: DataFrame, each_batch, checkpoint: str, available_now: bool) -> StreamingQuery:
    wanted = stream.sparkSession.conf.get(ADAPTIVE)

    def run(batch: DataFrame, batch_id: int) -> None:
        with _adaptive(batch.sparkSession, wanted):
            each_batch(batch, batch_id)

    writer = stream.writeStream.foreachBatch(run).outputMode("append").option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer).start()


def stream_counters_routed(snapshots: DataFrame, path: str, checkpoint: str, available_now: bool = True) -> StreamingQuery:
    """``stream_counter_delta`` into the history ``paired`` below ``path``, late snapshots into ``late`` beside it.

    One stateful query and one write per batch serve both: the status of a row is the name of its folder. A repeated
    batch replaces its own files in each. Read them with ``routed_deltas`` and ``routed_late``; ``late_counts`` counts.
    """
    pairs = stream_io_pairs(snapshots)
    wanted = (F.col("status") == LATE) | ((F.col("status") == PAIRED) & counters.has_io_activity())
    return _started(pairs.filter(wanted), lambda batch, batch_id: write_routed(batch, path, "status", "collect_date", batch_id),
                    checkpoint, available_now)


def routed_deltas(spark: SparkSession, path: str, schema: DataFrame) -> DataFrame:
    """The deltas stored by ``stream_counters_routed``; ``schema`` is the stream of snapshots it was given."""
    stored = read_route(spark, path, PAIRED, stream_io_pairs(schema).drop("status").schema)
    return counters.with_io_deltas(stored).drop("snapshot_no", "dt", "batch_id")


def routed_late(spark: SparkSession, path: str, schema: DataFrame) -> DataFrame:
    """The late snapshots stored by ``stream_counters_routed``, as they came."""
    stored = read_route(spark, path, LATE, stream_io_pairs(schema).drop("status").schema)
    return stored.select(*[c for c in stored.columns if not c.startswith("prev_") and c not in ("dt", "batch_id")])


def late_counts(late: DataFrame) -> DataFrame:
    """``server_name, day, late_rows, late_polls`` of late snapshots."""
    return (late.groupBy(*SERVER, F.to_date("collect_date").alias("day"))
            .agg(F.count(F.lit(1)).alias("late_rows"), F.countDistinct("snapshot_no").alias("late_polls")))


def stream_events_routed(documents: DataFrame, path: str, checkpoint: str, min_us: int = events.SLOW_MICROSECONDS,
                         available_now: bool = True) -> StreamingQuery:
    """Slow events below ``path``/route=event, documents that aren't well-formed events below route=reject.

    A document is parsed once, and a batch is written once. Well-formed documents that are not slow, or come from an
    excluded client, are in neither. A repeated batch replaces its own files. Read with ``routed_events``, ``routed_rejects``.
    """
    return _started(routed_event_rows(documents, min_us), lambda batch, batch_id: write_routed(batch, path, "route", "timestamp", batch_id),
                    checkpoint, available_now)


def routed_event_rows(documents: DataFrame, min_us: int = events.SLOW_MICROSECONDS) -> DataFrame:
    """``route``, the typed columns of slow events and, for rejects alone, the document as ``event_xml``."""
    given = documents.filter(F.col("event_xml").isNotNull())
    parsed = events.parse_events(given).withColumns({
        "duration": events.event_field("data", "duration", "bigint"),
        "transaction_state": events.event_field("data", "transaction_state", "int")})
    slow = events.slow_event_condition(F.col("_name"), F.col("duration"), F.col("transaction_state"), min_us)
    route = F.when(~events.well_formed(), REJECT).when(slow & events.client_wanted(), EVENT)
    shred = events.shredded_columns()
    names = [F.when(F.col("route") == EVENT, c).alias(n) for n, c in shred.items()]
    return (parsed.withColumn("route", route).filter("route is not null")
            .select("route", *names, F.when(F.col("route") == REJECT, F.col("event_xml")).alias("event_xml")))


def routed_events(spark: SparkSession, path: str, schema: DataFrame) -> DataFrame:
    """The slow events stored by ``stream_events_routed``; ``schema`` is the stream of documents it was given."""
    return read_route(spark, path, EVENT, routed_event_rows(schema).drop("route").schema).drop("event_xml", "dt", "batch_id")


def routed_rejects(spark: SparkSession, path: str, schema: DataFrame) -> DataFrame:
    """The rejected documents stored by ``stream_events_routed``, unchanged."""
    return read_route(spark, path, REJECT, routed_event_rows(schema).drop("route").schema).select("event_xml")
