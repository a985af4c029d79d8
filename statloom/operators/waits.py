"""Wait statistics: benign-wait filter, deltas, top waits, categories."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from statloom.contracts import SERVER, check
from statloom.functions import growth_only, like_any_case
from statloom.functions.text import in_any_case
from statloom.plans.ranking import top_n
from statloom.plans.snapshots import pair_with_previous, previous_name

# Wait types that say nothing about load.
BENIGN_WAITS = (
    "BROKER_EVENTHANDLER", "BROKER_RECEIVE_WAITFOR", "BROKER_TASK_STOP", "BROKER_TO_FLUSH", "BROKER_TRANSMITTER",
    "CHECKPOINT_QUEUE", "CHKPT", "CLR_AUTO_EVENT", "CLR_MANUAL_EVENT", "CLR_SEMAPHORE", "CXCONSUMER",
    "DBMIRROR_DBM_EVENT", "DBMIRROR_EVENTS_QUEUE", "DBMIRROR_WORKER_QUEUE", "DBMIRRORING_CMD", "DIRTY_PAGE_POLL",
    "DISPATCHER_QUEUE_SEMAPHORE", "EXECSYNC", "FSAGENT", "FT_IFTS_SCHEDULER_IDLE_WAIT", "FT_IFTSHC_MUTEX",
    "HADR_CLUSAPI_CALL", "HADR_FILESTREAM_IOMGR_IOCOMPLETION", "HADR_LOGCAPTURE_WAIT", "HADR_NOTIFICATION_DEQUEUE",
    "HADR_TIMER_TASK", "HADR_WORK_QUEUE", "KSOURCE_WAKEUP", "LAZYWRITER_SLEEP", "LOGMGR_QUEUE",
    "MEMORY_ALLOCATION_EXT", "ONDEMAND_TASK_QUEUE", "PARALLEL_REDO_DRAIN_WORKER", "PARALLEL_REDO_LOG_CACHE",
    "PARALLEL_REDO_TRAN_LIST", "PARALLEL_REDO_WORKER_SYNC", "PARALLEL_REDO_WORKER_WAIT_WORK",
    "PREEMPTIVE_XE_GETTARGETSTATE", "PWAIT_ALL_COMPONENTS_INITIALIZED", "PWAIT_DIRECTLOGCONSUMER_GETNEXT",
    "QDS_PERSIST_TASK_MAIN_LOOP_SLEEP", "QDS_ASYNC_QUEUE", "QDS_CLEANUP_STALE_QUERIES_TASK_MAIN_LOOP_SLEEP",
    "QDS_SHUTDOWN_QUEUE", "REDO_THREAD_PENDING_WORK", "REQUEST_FOR_DEADLOCK_SEARCH", "RESOURCE_QUEUE",
    "SERVER_IDLE_CHECK", "SLEEP_BPOOL_FLUSH", "SLEEP_DBSTARTUP", "SLEEP_DCOMSTARTUP", "SLEEP_MASTERDBREADY",
    "SLEEP_MASTERMDREADY", "SLEEP_MASTERUPGRADED", "SLEEP_MSDBSTARTUP", "SLEEP_SYSTEMTASK", "SLEEP_TASK",
    "SLEEP_TEMPDBSTARTUP", "SNI_HTTP_ACCEPT", "SP_SERVER_DIAGNOSTICS_SLEEP", "SQLTRACE_BUFFER_FLUSH",
    "SQLTRACE_INCREMENTAL_FLUSH_SLEEP", "SQLTRACE_WAIT_ENTRIES", "WAIT_FOR_RESULTS", "WAITFOR",
    "WAITFOR_TASKSHUTDOWN", "WAIT_XTP_RECOVERY", "WAIT_XTP_HOST_WAIT", "WAIT_XTP_OFFLINE_CKPT_NEW_LOG",
    "WAIT_XTP_CKPT_CLOSE", "XE_DISPATCHER_JOIN", "XE_DISPATCHER_WAIT", "XE_TIMER_EVENT",
)

# Category rows that exist whether or not the wait type was seen.
CATEGORY_LITERALS = (
    ("Unknown", "Unknown"),
    ("Cpu", "SOS_SCHEDULER_YIELD"),
    ("Worker Thread", "THREADPOOL"),
    ("Compilation", "RESOURCE_SEMAPHORE_QUERY_COMPILE"),
)

# Category, LIKE patterns, exact names, exact names excluded from the patterns.
CATEGORY_RULES = (
    ("Lock", ("LCK_M%",), (), ()),
    ("Latch", ("LATCH_%",), (), ()),
    ("Buffer Latch", ("PAGELATCH_%",), (), ()),
    ("Buffer IO", ("PAGEIOLATCH_%",), (), ()),
    ("CLR", ("CLR%", "SQLCLR%"), (), ()),
    ("Mirroring", ("DBMIRROR%",), (), ()),
    ("Transaction", ("XACT%", "DTC%", "TRAN_MARKLATCH_%", "MSQL_XACT_%", "TRANSACTION_MUTEX"), (), ()),
    ("Idle", ("SLEEP_%", "LAZYWRITER_SLEEP"),
     ("SQLTRACE_BUFFER_FLUSH", "SQLTRACE_INCREMENTAL_FLUSH_SLEEP", "SQLTRACE_WAIT_ENTRIES",
      "FT_IFTS_SCHEDULER_IDLE_WAIT", "XE_DISPATCHER_WAIT", "REQUEST_FOR_DEADLOCK_SEARCH", "LOGMGR_QUEUE",
      "ONDEMAND_TASK_QUEUE", "CHECKPOINT_QUEUE", "XE_TIMER_EVENT"), ()),
    ("Preemptive", ("PREEMPTIVE_%",), (), ()),
    ("Service Broker", ("BROKER_%",), (), ("BROKER_RECEIVE_WAITFOR",)),
    ("Tran Log IO", (),
     ("LOGMGR", "LOGBUFFER", "LOGMGR_RESERVE_APPEND", "LOGMGR_FLUSH", "LOGMGR_PMM_LOG", "CHKPT", "WRITELOG"), ()),
    ("Network IO", (),
     ("ASYNC_NETWORK_IO", "NET_WAITFOR_PACKET", "PROXY_NETWORK_IO", "EXTERNAL_SCRIPT_NETWORK_IOF"), ()),
    ("Parallelism", ("HT%", "BMP%", "BP%"), ("CXPACKET", "EXCHANGE"), ()),
    ("Memory", (),
     ("RESOURCE_SEMAPHORE", "CMEMTHREAD", "CMEMPARTITIONED", "EE_PMOLOCK", "MEMORY_ALLOCATION_EXT",
      "RESERVED_MEMORY_ALLOCATION_EXT", "MEMORY_GRANT_UPDATE"), ()),
    ("User Wait", (), ("WAITFOR", "WAIT_FOR_RESULTS", "BROKER_RECEIVE_WAITFOR"), ()),
    ("Tracing", (),
     ("TRACEWRITE", "SQLTRACE_LOCK", "SQLTRACE_FILE_BUFFER", "SQLTRACE_FILE_WRITE_IO_COMPLETION",
      "SQLTRACE_FILE_READ_IO_COMPLETION", "SQLTRACE_PENDING_BUFFER_WRITERS", "SQLTRACE_SHUTDOWN", "QUERY_TRACEOUT",
      "TRACE_EVTNOTIFF"), ()),
    ("Full Text Search", (),
     ("FT_RESTART_CRAWL", "FULLTEXT GATHERER, MSSEARCH", "FT_METADATA_MUTEX", "FT_IFTSHC_MUTEX", "FT_IFTSISM_MUTEX",
      "FT_IFTS_RWLOCK", "FT_COMPROWSET_RWLOCK", "FT_MASTER_MERGE", "FT_PROPERTYLIST_CACHE",
      "FT_MASTER_MERGE_COORDINATOR", "PWAIT_RESOURCE_SEMAPHORE_FT_PARALLEL_QUERY_SYNC"), ()),
    ("Other Disk IO", (),
     ("ASYNC_IO_COMPLETION", "IO_COMPLETION", "BACKUPIO", "WRITE_COMPLETION", "IO_QUEUE_LIMIT", "IO_RETRY"), ()),
    ("Replication", ("SE_REPL_%", "REPL_%", "HADR_%", "PWAIT_HADR_%"),
     ("REPLICA_WRITES", "FCB_REPLICA_WRITE", "FCB_REPLICA_READ", "PWAIT_HADRSIM"),
     ("HADR_THROTTLE_LOG_RATE_GOVERNOR",)),
    ("Log Rate Governor", (),
     ("LOG_RATE_GOVERNOR", "POOL_LOG_RATE_GOVERNOR", "HADR_THROTTLE_LOG_RATE_GOVERNOR",
      "INSTANCE_LOG_RATE_GOVERNOR"), ()),
)

WAIT_DELTA_COUNTERS = ("wait_time_ms", "signal_wait_time_ms")


def wait_snapshot_filter(raw: DataFrame) -> DataFrame:
    """Drop benign waits and waits nobody has waited on. A map-only set lookup, no join."""
    check(raw, "wait_snapshots")
    benign = in_any_case(F.col("wait_type"), BENIGN_WAITS)
    return raw.filter(~benign & (F.col("waiting_tasks_count") > 0))


def with_wait_deltas(paired: DataFrame) -> DataFrame:
    deltas = {c: growth_only(F.col(previous_name(c)), F.col(c)) for c in WAIT_DELTA_COUNTERS}
    return paired.withColumns(deltas).drop(*[previous_name(c) for c in WAIT_DELTA_COUNTERS])


def wait_delta(snapshots: DataFrame, polls: DataFrame | None = None) -> DataFrame:
    """Growth of total and signal wait time since the preceding snapshot.

    The task count and the maximum stay cumulative. NULL, a restart or no growth all give 0.
    """
    check(snapshots, "wait_snapshots")
    return with_wait_deltas(pair_with_previous(snapshots, SERVER, ("wait_type",), WAIT_DELTA_COUNTERS, polls=polls))


def wait_top_n(history: DataFrame, n: int = 10) -> DataFrame:
    """The ``n`` largest waits of every snapshot. Ties break on the wait type, to make the result repeatable."""
    return top_n(history, n, [F.col("wait_time_ms").desc_nulls_last(), F.col("wait_type")],
                 per=(*SERVER, "collect_date"))


def _matches(wait_type: Column, patterns, names, excluded) -> Column:
    hit = F.lit(False)
    for pattern in patterns:
        hit = hit | like_any_case(wait_type, pattern)
    if excluded:
        hit = hit & ~in_any_case(wait_type, excluded)
    return hit | in_any_case(wait_type, names) if names else hit


def rule_categories(wait_type: Column) -> Column:
    """Array of the rule categories a wait type falls into; empty when none matches, several when rules overlap."""
    return F.array_compact(F.array(*[
        F.when(_matches(wait_type, patterns, names, excluded), F.lit(category))
        for category, patterns, names, excluded in CATEGORY_RULES]))


def wait_categorize(waits: DataFrame) -> DataFrame:
    """``(wait_category, wait_type)`` for every distinct wait type, plus the four literal rows.

    A type matching two rules gives two rows; a type matching none gives no row.
    """
    literals = waits.sparkSession.createDataFrame(list(CATEGORY_LITERALS), "wait_category string, wait_type string")
    matched = (waits.select("wait_type").distinct()
               .select(F.explode(rule_categories(F.col("wait_type"))).alias("wait_category"), "wait_type"))
    return literals.unionByName(matched)


def wait_category_rollup(history: DataFrame, categories: DataFrame | None = None) -> DataFrame:
    """Wait time per category and snapshot; types without a category count as ``Unknown``.

    Without ``categories`` the rules are applied in the scan itself, so the only shuffle is the aggregation. With
    a mapping table of one's own, it is joined on the wait type, ignoring case, after the history has been summed.
    """
    if categories is None:
        literal = F.create_map(*[F.lit(x) for category, name in CATEGORY_LITERALS[1:] for x in (name, category)])
        names = rule_categories(F.col("wait_type"))
        fixed = F.try_element_at(literal, F.upper(F.col("wait_type")))
        all_names = F.when(fixed.isNotNull(), F.array_append(names, fixed)).otherwise(names)
        tagged = history.withColumn(
            "wait_category",
            F.explode(F.when(F.size(all_names) > 0, all_names).otherwise(F.array(F.lit("Unknown")))))
    else:
        mapping = categories.select("wait_category", F.upper("wait_type").alias("_type")).distinct()
        tagged = (history.withColumn("_type", F.upper("wait_type")).join(mapping, "_type", "left")
                  .withColumn("wait_category", F.coalesce("wait_category", F.lit("Unknown"))))
    return (tagged.groupBy(*SERVER, "collect_date", "wait_category")
            .agg(F.sum("wait_time_ms").alias("wait_time_ms"), F.sum("signal_wait_time_ms").alias("signal_wait_time_ms")))
