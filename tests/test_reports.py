"""Hand cases of replication, backup, storage, cache and statistics reports."""

import pytest
from pyspark.sql import functions as F

from statloom.functions import clock_text, percent, quote_name, seconds_between, size_pretty, whole_div
from statloom.operators import bloat, cache, indexes, replicas, sessions, statistics, storage

STATE = ("server_name string, group_id int, group_database_id int, replica_id int, database_id int, "
         "last_commit_time timestamp, redo_queue_size bigint, redo_rate bigint, last_redone_time timestamp, "
         "log_send_queue_size bigint, synchronization_health_desc string, synchronization_state_desc string")


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


@pytest.mark.parametrize("size, text", [
    (0, "0 bytes"), (10239, "10239 bytes"), (10240, "10 kB"), (10240 + 511, "10 kB"), (10240 + 512, "11 kB"),
    (10 * 1024 ** 2 - 513, "10239 kB"), (10 * 1024 ** 2 - 512, "10 MB"), (10 * 1024 ** 3, "10 GB"),
    (10 * 1024 ** 4, "10 TB"), (99 * 1024 ** 5, "101376 TB"), (-20480, "-20 kB"), (None, None)])
def test_size_pretty(spark, size, text):
    assert one(spark, size_pretty(F.lit(size).cast("bigint"))) == text


def test_second_boundaries_are_counted(spark):
    start, end = F.lit("2024-01-01 00:00:00.9").cast("timestamp"), F.lit("2024-01-01 00:00:01.1").cast("timestamp")
    assert one(spark, seconds_between(start, end)) == 1


def test_small_functions(spark):
    assert one(spark, whole_div(F.lit(7), F.lit(0))) is None
    assert one(spark, whole_div(F.lit(-7), 2)) == -3
    assert one(spark, clock_text(F.lit(360061))) == "100:01:01"
    assert one(spark, quote_name(F.lit("a]b"))) == "[a]]b]"
    assert str(one(spark, percent(F.lit(1), F.lit(8), 1))) == "12.5"
    assert str(one(spark, percent(F.lit(1), F.lit(800), 2))) == "0.13"
    assert one(spark, percent(F.lit(1), F.lit(0), 1)) is None


def test_latency_with_zero_and_null_redo_rate(frame):
    rows = [("s", 1, 1, n, 5, "2024-01-01 00:00:00", 1000, rate, "2024-01-01", 0, "H", "S")
            for n, rate in enumerate((10, 0, None))]
    df = frame(STATE, *rows, ("s", 1, 1, 9, 5, "2024-01-01", 1, 1, None, 0, "H", "S"))
    got = {r.replica_id: r for r in replicas.replica_latency(df, "2024-01-02 01:02:03").collect()}
    assert sorted(got) == [0, 1, 2]
    assert got[0].time_behind_primary == "25 hour(s), 2 min, 3 sec"
    assert got[0].estimated_recovery_time_seconds == 100 and str(got[0].estimated_recovery_time_minutes) == "1.67"
    assert got[0].estimated_completion_time == "02 Jan 2024 01:03:03"
    for n in (1, 2):
        assert got[n].estimated_completion_time is None and got[n].estimated_recovery_time_seconds is None


def test_dashboard_rejects_an_unknown_group(frame, spark, sf_dir):
    from statloom.fixtures.inputs import Inputs
    i = Inputs(spark, sf_dir)
    inputs = (i.groups, i.replicas, i.cluster_states, i.replica_states, i.replica_roles)
    with pytest.raises(ValueError, match="no availability group named 'nope'"):
        replicas.replica_dashboard(*inputs, ag_name="nope")
    report = replicas.replica_dashboard(*inputs, ag_name="ag3")
    assert {r.availability_group_name for r in report.collect()} == {"ag3"}
    assert len(report.columns) == 29  # 28 and the server


def test_file_of_size_zero_has_no_percentage(frame):
    df = frame("server_name string, database_id int, database_name string, file_name string, physical_name string, "
               "size_pages bigint, used_pages bigint",
               ("s", 1, "d", "f", "E:/a", 0, 0), ("s", 1, "d", "g", "d:/b", 12800, 6400))
    got = {r.file_name: r.percent_free for r in storage.file_space(df).collect()}
    assert got["f"] is None and str(got["g"]) == "50.00"
    assert [r.file_name for r in storage.file_space(df, drive="e").collect()] == ["f"]
    assert storage.file_space(df, database="other").count() == 0


PAGE = "server_name string, database_name string, relfilenode bigint, usagecount int, isdirty boolean"


def test_unused_buffers_form_a_row_without_database(frame):
    df = frame(PAGE, ("s", None, 1, 0, False), ("s", "d", 1, 1, True), ("s", "d", 2, 1, True))
    settings = frame("server_name string, shared_buffers int", ("s", 10))
    got = {r.database_name: (r.buffered_bytes, str(r.buffers_percent))
           for r in cache.cache_by_database(df, settings).collect()}
    assert got == {None: (8192, "10.0"), "d": (16384, "20.0")}


def test_cache_shares_have_different_denominators(frame):
    pages = frame(PAGE, *[("s", "d", n, 1, True) for n in (1, 1, 1, 2, 3, 4)])
    relations = frame("server_name string, database_name string, relfilenode bigint, nspname string, relname string, "
                      "relation_bytes bigint", ("s", "d", 1, "p", "a", 81920), ("s", "d", 2, "p", "b", 81920),
                      ("s", "d", 3, "p", "empty", 0))
    sizes = frame("server_name string, database_name string, database_bytes bigint", ("s", "d", 819200))
    total = {r.relname: str(r.percent_database_in_cache)
             for r in cache.cache_share_total(pages, relations, sizes, 100).collect()}
    window = {r.relname: str(r.percent_database_in_cache)
              for r in cache.cache_share_window(pages, relations, sizes, 100).collect()}
    assert total == {"a": "50.0", "b": "16.7"} and window == {"a": "75.0", "b": "25.0"}
    top = cache.cache_share_window(pages, relations, sizes, 100, n=1).collect()
    assert [(r.relname, str(r.percent_database_in_cache)) for r in top] == [("a", "75.0")]


FINGERPRINT = ("server_name string, database_name string, object_id bigint, index_id int, schema_name string, "
               "table_name string, index_name string, type_desc string, is_unique int, is_primary_key int, "
               "is_unique_constraint int, columns_all string, columns_key string, columns_included string, "
               "index_size_mb bigint")


def index(number, columns, key=None, table=1):
    return ("s", "d", table, number, "dbo", f"t{table}", f"i{number}", "NC", 0, 0, 0, columns, key or columns, None, 1)


def pairs(df):
    return {(r.table_name, r.index1_id, r.index2_id) for r in df.collect()}


def test_duplicate_pairs_are_ordered_and_stay_in_their_table(frame):
    df = frame(FINGERPRINT, index(3, "a, b"), index(2, "a, b"), index(4, "a, b"), index(5, "b, a"),
               index(9, "a, b", table=2), index(6, None), index(7, None))
    assert pairs(indexes.duplicate_indexes(df)) == {("t1", 2, 3), ("t1", 2, 4), ("t1", 3, 4)}


def test_covering_pairs_compare_whole_names(frame):
    df = frame(FINGERPRINT, index(1, "a, b, c"), index(2, "a, b"), index(3, "a, bb"), index(4, "a"), index(5, "a"))
    assert pairs(indexes.duplicate_indexes(df, mode="prefix")) == {
        ("t1", 1, 2), ("t1", 1, 4), ("t1", 1, 5), ("t1", 2, 4), ("t1", 2, 5), ("t1", 3, 4), ("t1", 3, 5),
        ("t1", 4, 5)}


def test_covering_pairs_by_column_ids(frame):
    from pyspark.sql import functions as F
    lists = {1: [1], 2: [1, 2], 3: [1, 2], 4: [2], 5: [1, 2, 3], 6: [10], 7: [1, 10], 8: [10, 2], 9: [1, 2, 3]}
    df = frame(FINGERPRINT, *[index(n, "a, b") for n in lists], *[index(n, "a, b", table=2) for n in (1, 7)])
    arrays = F.create_map(*[F.lit(x) for n, c in lists.items() for x in (n, c)])
    got = pairs(indexes.duplicate_indexes(df.withColumn("column_ids", arrays[F.col("index_id")]), mode="prefix"))
    want = {("t1", a, b) for a, x in lists.items() for b, y in lists.items() if a != b and x[:len(y)] == y and (x != y or a < b)}
    assert got == want | {("t2", 7, 1)}


def test_covering_pairs_scan_fingerprints_once(frame):
    df = frame(FINGERPRINT, index(1, "a, b"), index(2, "a"))
    plan = indexes.duplicate_indexes(df, mode="prefix")._jdf.queryExecution().optimizedPlan().toString()
    assert "Join" not in plan and plan.count("LogicalRDD") == 1 and plan.count("Aggregate [") == 1


def test_key_duplicates_drop_the_second_by_its_real_schema(frame):
    df = frame(FINGERPRINT, index(2, "a, x", key="a"), index(3, "a", key="a"))
    row = indexes.duplicate_indexes_keys(df).first()
    assert row.cmd_drop == "DROP INDEX [i3] ON [dbo].[t1];"


@pytest.mark.parametrize("size, alignment, padding", [(2, 8, 6), (6, 8, 2), (8, 8, 0), (0, 4, 0), (23, 4, 1)])
def test_padding(spark, size, alignment, padding):
    assert one(spark, bloat.pad(F.lit(size), alignment)) == padding


def test_hit_ratio_needs_reads_only_in_database_stats(frame):
    df = frame("server_name string, database_name string, blks_read bigint, blks_hit bigint, size_bytes bigint, "
               "temp_files bigint, temp_bytes bigint, conflicts bigint, deadlocks bigint, stats_reset timestamp, "
               "blk_read_time double", ("s", "d", 0, 10, 1, 0, 0, 0, 0, "2024-01-01", 0.0),
               ("s", "e", 1, 3, 1, 0, 0, 0, 0, None, 0.5))
    stats = {r.database_name: r for r in statistics.database_stats(df, "2024-01-01 00:01:00").collect()}
    assert stats["d"].hit_ratio is None and str(stats["e"].hit_ratio) == "75.00"
    assert stats["d"].stat_uptime_sec == 60 and stats["e"].stat_uptime_sec is None
    ratio = {r.database_name: str(r.blks_hit_ratio) for r in statistics.database_hit_ratio(df, df).collect()}
    assert ratio == {"d": "100.00", "e": "75.00"}
    assert {r.database_name: r.blocks_per_ms for r in statistics.read_throughput(df).collect()} == {"d": None, "e": 2.0}


def test_dead_tuples_warn_from_a_fifth_of_all(frame):
    df = frame("server_name string, database_name string, schemaname string, relname string, n_live_tup bigint, "
               "n_dead_tup bigint, last_vacuum timestamp, last_autovacuum timestamp",
               ("s", "d", "p", "a", 80, 20, None, None), ("s", "d", "p", "b", 81, 19, None, None),
               ("s", "d", "p", "c", 0, 9, None, None), ("s", "d", "p", "e", 0, 0, None, None))
    got = {r.relname: (r.vacuum_ratio, r.vacuum_warning is not None) for r in statistics.dead_tuple_ratio(df).collect()}
    assert got == {"a": (20, True), "b": (19, False), "c": (100, False), "e": (None, False)}


def test_lock_and_session_arguments(frame):
    session = frame("server_name string, database_name string, pid bigint, state string, usename string, "
                    "query_start timestamp, query string", ("s", "d", 1, "active", "u", "2024-01-01", "x" * 80),
                    ("s", "d", 2, "idle", "u", "2024-01-01", "q"), ("t", "d", 1, "active", "u", None, "q"))
    own = frame("server_name string, pid bigint", ("t", 1))
    rows = sessions.long_sessions(session, "2024-01-01 00:00:10", own).collect()
    assert [(r.server_name, r.age_sec, len(r.query)) for r in rows] == [("s", 10, 49)]
    assert {r.sessions for r in sessions.session_counts(session).collect()} == {2, 1}
    assert sessions.session_counts(session, ("state",)).count() == 3
    with pytest.raises(ValueError):
        sessions.lock_activity(frame("server_name string, database_name string, pid bigint, locktype string, "
                                     "relation bigint, mode string, granted boolean, virtualtransaction string",
                                     ("s", "d", 1, "l", 1, "m", True, "v")),
                               frame("server_name string, database_name string, relfilenode bigint, nspname string, "
                                     "relname string, relation_bytes bigint", ("s", "d", 1, "p", "r", 1)),
                               session, how="cross")
