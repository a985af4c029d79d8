"""Statements, locks, sessions and connection limits."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from statloom.contracts import DATABASE, SERVER, check
from statloom.functions import seconds_between
from statloom.functions.times import as_timestamp
from statloom.plans.ranking import top_n


def statement_top(statements: DataFrame, n: int = 100) -> DataFrame:
    """The ``n`` statements of every server with the most total time, in minutes; averages in milliseconds."""
    check(statements, "statements")
    total, calls = F.col("total_time"), F.col("calls")
    top = top_n(statements, n, [total.desc_nulls_last(), F.col("query")], per=SERVER)
    return top.select(*SERVER, (total / 1000 / 60).alias("total_min"),
                      (total / F.nullif(calls, F.lit(0))).alias("avg_ms"), "stddev_time", "calls", "query")


def _without(df: DataFrame, own_pid: int | DataFrame | None) -> DataFrame:
    """Leave out the exporter's own session: one pid, or a table ``(server_name, pid)`` for a fleet."""
    if own_pid is None:
        return df
    if isinstance(own_pid, DataFrame):
        return df.join(own_pid.select(*SERVER, "pid"), [*SERVER, "pid"], "left_anti")
    return df.filter(F.col("pid") != own_pid)


def lock_activity(
    locks: DataFrame, relations: DataFrame, sessions: DataFrame, own_pid: int | DataFrame | None = None,
    how: str = "left",
) -> DataFrame:
    """Locks with the relation and the statement of their session.

    ``how='left'`` keeps locks whose session is gone, ``how='inner'`` drops them. Sessions are matched by server and
    process id.
    """
    check(locks, "locks")
    check(relations, "relations")
    check(sessions, "sessions")
    if how not in ("left", "inner"):
        raise ValueError(f"how must be 'left' or 'inner', not {how!r}")
    names = relations.select(*DATABASE, F.col("relfilenode").cast("bigint").alias("_relation"), "nspname", "relname")
    # Most locks are not on a relation: negative stand-ins, which no relation has, keep them out of one partition.
    no_relation = -1 - F.pmod(F.xxhash64("pid", "virtualtransaction"), F.lit(4096))
    running = sessions.select(*SERVER, "pid", F.date_trunc("second", "query_start").alias("query_start"),
                              F.substring("query", 1, 60).alias("query"))
    return (_without(locks, own_pid)
            .withColumn("_relation", F.coalesce(F.col("relation").cast("bigint"), no_relation))
            .join(names, [*DATABASE, "_relation"], "left")
            .join(running, [*SERVER, "pid"], how)
            .select(*DATABASE, "pid", "locktype", "virtualtransaction", "transactionid", "nspname", "relname", "mode",
                    "granted", "query_start", "query")
            .orderBy("server_name", "virtualtransaction", "pid"))


def session_counts(sessions: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Sessions per server: in total, ``by=('database_name',)`` or ``by=('state',)``."""
    check(sessions, "sessions")
    return sessions.groupBy(*SERVER, *by).agg(F.count(F.lit(1)).alias("sessions"))


def session_count_summary(sessions: DataFrame) -> DataFrame:
    """All three counts in one pass: rows of kind ``total``, ``database`` and ``state``, the value in ``name``.

    Sessions are first counted per (server, database, state), so the grouping sets expand counts, not sessions.
    """
    check(sessions, "sessions")
    cells = sessions.groupBy(*SERVER, "database_name", "state").agg(F.count(F.lit(1)).alias("_n"))
    sets = cells.groupingSets(
        [[F.col("server_name")], [F.col("server_name"), F.col("database_name")],
         [F.col("server_name"), F.col("state")]],
        F.col("server_name"), F.col("database_name"), F.col("state"))
    level = F.grouping_id()
    return (sets.agg(level.alias("_level"), F.sum("_n").alias("sessions"))
            .select(*SERVER,
                    F.when(F.col("_level") == 3, "total").when(F.col("_level") == 1, "database").otherwise("state")
                    .alias("kind"),
                    F.when(F.col("_level") == 1, F.col("database_name"))
                    .when(F.col("_level") == 2, F.col("state")).alias("name"), "sessions"))


def connection_headroom(sessions: DataFrame, settings: DataFrame, limits: DataFrame) -> DataFrame:
    """Sessions of every database against its own limit and the limit of its server.

    ``settings`` holds the ``max_connections`` row of each server; ``limits.datconnlimit`` is −1 for no limit, which
    gives NULL headroom. Databases without sessions count 0.
    """
    check(sessions, "sessions")
    maximum = (settings.filter(F.col("name") == "max_connections")
               .select(*SERVER, F.col("setting").cast("bigint").alias("max_connections")))
    per_database = session_counts(sessions, ("database_name",))
    per_server = per_database.groupBy(*SERVER).agg(F.sum("sessions").alias("server_sessions"))
    used = F.coalesce("sessions", F.lit(0))
    server_used = F.coalesce("server_sessions", F.lit(0))
    return (limits.select(*DATABASE, "datconnlimit")
            .join(per_database, list(DATABASE), "left")
            .join(per_server, list(SERVER), "left")
            .join(maximum, list(SERVER), "left")
            .select(*DATABASE, used.alias("sessions"), "datconnlimit",
                    F.when(F.col("datconnlimit") >= 0, F.col("datconnlimit") - used).alias("database_headroom"),
                    "max_connections", (F.col("max_connections") - server_used).alias("server_headroom")))


def long_sessions(sessions: DataFrame, as_of, own_pid: int | DataFrame | None = None) -> DataFrame:
    """Sessions that are not idle, with the age of their statement at ``as_of``, newest first.

    The statement is cut to its first 49 characters.
    """
    check(sessions, "sessions")
    return (_without(sessions, own_pid).filter(F.col("state") != "idle")
            .select(*DATABASE, "pid", seconds_between(F.col("query_start"), as_timestamp(as_of)).alias("age_sec"),
                    "usename", F.substring("query", 1, 49).alias("query"), "state", "query_start")
            .orderBy(F.col("query_start").desc_nulls_last(), "server_name", "pid"))
