"""Event logs and traces: slow-event filter, XML shredding, failovers, file growth."""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from statloom.contracts import DATABASE, check
from statloom.functions import whole_div
from statloom.plans.ranking import dense_rank_newest_first

# Capture types and thresholds.
COMPLETED_EVENTS = ("rpc_completed", "sp_statement_completed", "sql_batch_completed", "sql_statement_completed")
TRANSACTION_EVENT = "sql_transaction"
OPEN_TRANSACTION_STATES = (1, 2)
SLOW_MICROSECONDS = 500_000
FAILOVER_ERROR = 1480
AUTOGROWTH_CLASSES = (92, 95)
PAGE_MB = Decimal("0.0078125")
EXCLUDED_CLIENT = "Microsoft SQL Server Management Studio - Transact-SQL IntelliSense"

STAMP_PATTERN = """<event[^>]*?\\stimestamp\\s*=\\s*["']([^"']*)["']"""
EVENT_SCHEMA = """
    _name string, _timestamp string,
    data array<struct<_name: string, value: string>>,
    action array<struct<_name: string, value: string>>,
    _malformed string
"""

# Output column, section of the document, type. ``timestamp`` and ``event_name`` are attributes.
SHREDDED_FIELDS = (
    ("sql_text", "action", "string"),
    ("statement", "data", "string"),
    ("cpu_time", "data", "bigint"),
    ("duration", "data", "bigint"),
    ("logical_reads", "data", "bigint"),
    ("physical_reads", "data", "bigint"),
    ("writes", "data", "bigint"),
    ("row_count", "data", "bigint"),
    ("object_name", "data", "string"),
    ("username", "action", "string"),
    ("database_name", "action", "string"),
    ("client_app_name", "action", "string"),
    ("client_hostname", "action", "string"),
    ("query_hash", "action", "string"),
    ("plan_handle", "action", "string"),
    ("session_id", "action", "int"),
    ("transaction_id", "action", "bigint"),
    ("event_sequence", "action", "bigint"),
)


def slow_event_filter(events: DataFrame, min_us: int = SLOW_MICROSECONDS) -> DataFrame:
    """Completed statements, batches and calls, and committed or rolled-back transactions, of at least ``min_us``.

    Works unchanged on a streaming DataFrame; the predicates reach the Parquet scan.
    """
    check(events, "captured_events")
    return events.filter(slow_event_condition(F.col("object_name"), F.col("duration"), F.col("transaction_state"), min_us))


def slow_event_condition(name: Column, duration: Column, state: Column, min_us: int = SLOW_MICROSECONDS) -> Column:
    """The condition of ``slow_event_filter`` on given columns."""
    wanted = name.isin(*COMPLETED_EVENTS) | ((name == TRANSACTION_EVENT) & state.isin(*OPEN_TRANSACTION_STATES))
    return (duration >= min_us) & wanted


def parse_event(xml: Column) -> Column:
    """An event document as a struct; missing nodes are NULL, and blanks around values are kept.

    A malformed document comes back whole in ``_malformed``, whatever could be read of it before the fault.
    """
    return F.from_xml(xml, EVENT_SCHEMA, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_malformed",
                                          "ignoreSurroundingSpaces": "false"})


def well_formed() -> Column:
    """Parsed events that were read to their end and have a name; ``event_rejects`` has all others."""
    return F.col("_malformed").isNull() & F.col("_name").isNotNull()


def event_field(section: str, name: str, kind: str = "string") -> Column:
    """The first ``value`` called ``name`` in a section of a parsed event, NULL when absent or not of that type."""
    nodes = F.col(section)
    first = F.get(nodes["value"], F.array_position(nodes["_name"], name).cast("int") - 1)
    return first if kind == "string" else first.try_cast(kind)


def parse_events(events: DataFrame) -> DataFrame:
    """Add the parts of the parsed document as columns ``_name``, ``_timestamp``, ``_malformed``, ``data``, ``action``.

    The parse sits in a generator, which later filters cannot be pushed through, so a document is parsed only once.
    """
    return events.select("*", F.inline(F.array(parse_event(F.col("event_xml")))))


def shred_parsed(parsed: DataFrame, excluded_client: str = EXCLUDED_CLIENT) -> DataFrame:
    """The twenty typed columns of parsed events, unordered; runs on streams too."""
    return parsed.select(
        *[c.alias(name) for name, c in shredded_columns().items()], "_malformed", F.col("_name"),
    ).filter(well_formed() & (F.col("client_app_name") != excluded_client)).drop("_malformed", "_name")


def shredded_columns() -> dict[str, Column]:
    """The typed columns of parsed events by name."""
    return {"timestamp": F.col("_timestamp").try_cast("timestamp"), "event_name": F.col("_name"),
            **{name: event_field(section, name, kind) for name, section, kind in SHREDDED_FIELDS}}


def client_wanted(excluded_client: str = EXCLUDED_CLIENT) -> Column:
    """Parsed events with a client name other than the excluded one."""
    return event_field("action", "client_app_name") != excluded_client


def event_shred(events: DataFrame, excluded_client: str = EXCLUDED_CLIENT, ordered: bool = True) -> DataFrame:
    """Twenty typed columns per event document, oldest first.

    Events of ``excluded_client`` and events without a client name are dropped. Malformed documents give no row here;
    ``event_rejects`` returns them. For the order, the unparsed documents are range-partitioned on the time stamp
    found in their text, and sorted after parsing: the sampling pass of the range partitioning never parses, and
    the text hash as second key splits a time stamp shared by very many events. ``ordered=False`` saves the shuffle.
    """
    if not ordered:
        return shred_parsed(parse_events(events), excluded_client)
    stamp = F.regexp_extract("event_xml", STAMP_PATTERN, 1).try_cast("timestamp")
    ranged = events.repartitionByRange(stamp, F.xxhash64("event_xml"))
    return (shred_parsed(parse_events(ranged), excluded_client)
            .sortWithinPartitions(F.col("timestamp").asc_nulls_first(), "event_sequence"))


def event_rejects(events: DataFrame) -> DataFrame:
    """Documents that are not well-formed events, unchanged, to be counted and written aside.

    Every document is emitted by ``event_shred``, left out there by its client, or returned here.
    """
    parsed = events.filter(F.col("event_xml").isNotNull()).select("*", F.inline(F.array(parse_event(F.col("event_xml")))))
    return parsed.filter(~well_formed()).select(*events.columns)


def capture_status(sessions: DataFrame, targets: DataFrame, session: str | None = None) -> DataFrame:
    """Capture sessions (or one, by name) with each of their targets: buffers in whole megabytes, dropped events.

    A count of dropped events or buffers tells that the log of the session is incomplete.
    """
    check(sessions, "capture_sessions")
    check(targets, "capture_targets")
    chosen = sessions if session is None else sessions.filter(F.col("name") == session)
    into = targets.select("server_name", F.col("event_session_address").alias("address"), "target_name", "target_data")
    return (chosen.join(into, ["server_name", "address"])
            .select("server_name", "name", whole_div(F.col("total_buffer_size"), 1024 * 1024).alias("total_buffer_size_mb"),
                    "buffer_policy_desc", "target_name", "target_data", "flag_desc", "dropped_event_count",
                    "dropped_buffer_count", "session_source"))


def failover_events(events: DataFrame) -> DataFrame:
    """Availability-group failovers: reported errors with the failover number. Other types are never parsed."""
    check(events, "event_documents")
    return (parse_events(events.filter(F.col("object_name") == "error_reported"))
            .select(F.col("_timestamp").try_cast("timestamp").alias("timestamp"),
                    event_field("data", "error_number", "int").alias("error_number"),
                    event_field("data", "message").alias("message"), "_malformed", "_name")
            .filter(well_formed() & (F.col("error_number") == FAILOVER_ERROR)).drop("_malformed", "_name"))


def autogrowth_events(trace: DataFrame, databases: DataFrame) -> DataFrame:
    """File growth and shrink events after the creation of their database, newest first, with a banding flag.

    ``band`` alternates 1, 0, 1 … over the distinct start times of a database. ``databases`` carries the database
    name as ``name``; a database unknown there gives no rows.
    """
    check(trace, "trace")
    created = databases.select("server_name", F.col("name").alias("database_name"), "create_date")
    grown = (trace.filter(F.col("event_class").between(*AUTOGROWTH_CLASSES))
             .join(created, list(DATABASE))
             .filter(F.col("create_date") < F.col("end_time")))
    return (dense_rank_newest_first(grown, DATABASE, "start_time", "_band_no")
            .select((F.col("_band_no") % 2).alias("band"), F.col("event_class").cast("int").alias("event_class"),
                    *DATABASE, "file_name", whole_div(F.col("duration"), 1000).alias("duration_ms"),
                    "start_time", "end_time",
                    (F.col("integer_data").cast("decimal(18,0)") * F.lit(PAGE_MB)).alias("change_in_size_mb"))
            .orderBy(F.col("start_time").desc_nulls_last(), *DATABASE, "file_name"))


def trace_by_host(trace: DataFrame, host: str | None = None) -> DataFrame:
    """Trace rows of one host (or all), with whole seconds and whole megabytes read added in front."""
    check(trace, "trace")
    rows = trace if host is None else trace.filter(F.col("host_name") == host)
    return rows.select(whole_div(F.col("duration"), 1_000_000).alias("duration_sec"),
                       whole_div(F.col("reads") * 8, 1024).alias("reads_mb"), *trace.columns)
