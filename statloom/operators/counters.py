"""IO counter telemetry: enrichment, reset-safe deltas, threshold alerts, readable rates, retention."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from statloom.contracts import SERVER, check
from statloom.functions import counter_delta, whole_div
from statloom.functions.times import as_timestamp
from statloom.plans.snapshots import pair_with_previous, previous_name

IO_KEYS = ("database_id", "file_id")
IO_COUNTERS = (
    "num_of_reads", "num_of_bytes_read", "io_stall_read_ms",
    "num_of_writes", "num_of_bytes_written", "io_stall_write_ms",
    "io_stall_ms",
)
BYTES_PER_MB = 1024 * 1024


def io_snapshot_enrich(vfs: DataFrame, files: DataFrame, as_of) -> DataFrame:
    """One poll of file counters with file attributes, drive letter and ``collect_date`` = ``as_of``.

    Files without counters and counters without a file are dropped.
    """
    check(vfs, "virtual_file_stats")
    check(files, "files")
    named = files.select(
        *SERVER, *IO_KEYS, "database_name", "file_name", "type_desc",
        F.upper(F.left(F.col("physical_name"), F.lit(1))).alias("drive"))
    return (vfs.join(named, [*SERVER, *IO_KEYS])
            .select(*SERVER, *IO_KEYS, "database_name", "file_name", "type_desc", "drive", *IO_COUNTERS,
                    as_timestamp(as_of).alias("collect_date")))


def with_io_deltas(paired: DataFrame) -> DataFrame:
    """Replace each counter of a paired row by its growth; every counter is clamped at 0 on its own."""
    deltas = {c: counter_delta(F.col(previous_name(c)), F.col(c)) for c in IO_COUNTERS}
    return paired.withColumns(deltas).drop(*[previous_name(c) for c in IO_COUNTERS])


def has_io_activity() -> Column:
    """Cumulative reads + writes above zero: idle files that were ever used still report zero deltas."""
    return F.col("num_of_reads") + F.col("num_of_writes") > 0


def crosses_io_threshold(read_ms: int, write_ms: int, reads: int, writes: int) -> Column:
    """Any raw (unclamped) growth of a paired row at or above its threshold."""
    limits = {"io_stall_read_ms": read_ms, "num_of_reads": reads,
              "io_stall_write_ms": write_ms, "num_of_writes": writes}
    hit = F.lit(False)
    for counter, limit in limits.items():
        hit = hit | (F.col(counter) - F.col(previous_name(counter)) >= limit)
    return hit


def io_pairs(snapshots: DataFrame, polls: DataFrame | None = None) -> DataFrame:
    check(snapshots, "io_snapshots")
    return pair_with_previous(snapshots, SERVER, IO_KEYS, IO_COUNTERS, polls=polls)


def io_counter_delta(snapshots: DataFrame, polls: DataFrame | None = None) -> DataFrame:
    """Growth of the seven IO counters per file since the immediately preceding snapshot of its server."""
    return with_io_deltas(io_pairs(snapshots, polls).filter(has_io_activity()))


def io_threshold_alert(
    snapshots: DataFrame,
    read_ms: int = 25,
    write_ms: int = 50,
    reads: int = 100,
    writes: int = 200,
    polls: DataFrame | None = None,
) -> DataFrame:
    """The same deltas, kept only where at least one raw difference reaches its threshold.

    The test uses unclamped differences and there is no activity filter.
    """
    return with_io_deltas(io_pairs(snapshots, polls).filter(crosses_io_threshold(read_ms, write_ms, reads, writes)))


def _per_operation(amount: Column, operations: Column) -> Column:
    return F.when(operations > 0, whole_div(amount, operations)).otherwise(F.lit(0)).cast("bigint")


def _mb_per_second(size: Column, stall_ms: Column) -> Column:
    # Bytes are cut to whole megabytes first; only then does the division turn decimal.
    megabytes = whole_div(size, BYTES_PER_MB).cast("decimal(19,0)")
    rate = megabytes * 1000 / F.nullif(stall_ms, F.lit(0)).cast("decimal(19,0)")
    return F.when(stall_ms > 0, F.round(rate, 2)).otherwise(F.lit(0)).cast("decimal(18,2)")


def io_readable(deltas: DataFrame) -> DataFrame:
    """Average bytes, average latency and MB/s for reads, writes and both; 0 where the divisor is not positive."""
    c = {name: F.col(name) for name in IO_COUNTERS}
    operations = c["num_of_reads"] + c["num_of_writes"]
    moved = c["num_of_bytes_read"] + c["num_of_bytes_written"]
    return deltas.withColumns({
        "avg_bytes_by_read": _per_operation(c["num_of_bytes_read"], c["num_of_reads"]),
        "avg_read_latency_ms": _per_operation(c["io_stall_read_ms"], c["num_of_reads"]),
        "read_mb_sec": _mb_per_second(c["num_of_bytes_read"], c["io_stall_read_ms"]),
        "avg_bytes_by_write": _per_operation(c["num_of_bytes_written"], c["num_of_writes"]),
        "avg_write_latency_ms": _per_operation(c["io_stall_write_ms"], c["num_of_writes"]),
        "write_mb_sec": _mb_per_second(c["num_of_bytes_written"], c["io_stall_write_ms"]),
        "avg_bytes_by_io": _per_operation(moved, operations),
        "avg_latency_ms": _per_operation(c["io_stall_ms"], operations),
        "io_mb_sec": _mb_per_second(moved, c["io_stall_ms"]),
    })


# How long each history is kept.
IO_HISTORY_KEEP = "1 month"
ALERT_HISTORY_KEEP = "30 days"
WAIT_HISTORY_KEEP = "30 days"


def retention_cutoff(as_of, keep: str) -> Column:
    """The oldest ``collect_date`` that survives; calendar months are counted as such (31 March → 29 February)."""
    return as_timestamp(as_of) - F.expr(f"interval {keep}")


def retention_purge(history: DataFrame, as_of, keep: str = IO_HISTORY_KEEP) -> DataFrame:
    """Rows not older than ``keep`` before ``as_of``. For stored histories see ``sources.history.purge_history``."""
    return history.filter(F.col("collect_date") >= retention_cutoff(as_of, keep))
