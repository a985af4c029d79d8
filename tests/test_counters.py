"""Hand cases of counter deltas, alerts, rates and retention."""

import datetime as dt

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from statloom.operators import counters
from statloom.plans.snapshots import number_snapshots, pair_with_previous

SNAPSHOT = ("server_name string, database_id int, file_id int, collect_date timestamp, num_of_reads bigint, "
            "num_of_bytes_read bigint, io_stall_read_ms bigint, num_of_writes bigint, num_of_bytes_written bigint, "
            "io_stall_write_ms bigint, io_stall_ms bigint")


def snap(day, *values, file=1, server="s"):
    return (server, 1, file, f"2024-01-{day:02d}", *values)


def deltas(df):
    return {(r.file_id, r.collect_date.day): tuple(r[c] for c in counters.IO_COUNTERS) for r in df.collect()}


def test_first_appearance_gives_no_row_and_delta_is_the_difference(frame):
    df = frame(SNAPSHOT, snap(1, 10, 100, 5, 20, 200, 6, 11), snap(2, 15, 150, 9, 21, 210, 8, 17))
    assert deltas(counters.io_counter_delta(df)) == {(1, 2): (5, 50, 4, 1, 10, 2, 6)}


def test_each_counter_is_clamped_on_its_own(frame):
    df = frame(SNAPSHOT, snap(1, 10, 100, 5, 20, 200, 6, 11), snap(2, 3, 150, 9, 21, 210, 8, 17))
    assert deltas(counters.io_counter_delta(df)) == {(1, 2): (0, 50, 4, 1, 10, 2, 6)}


def test_key_missing_for_one_poll_gives_no_row_when_it_returns(frame):
    rows = [snap(d, d, d, d, d, d, d, d, file=2) for d in (1, 2, 3, 4)]
    rows += [snap(d, d, d, d, d, d, d, d, file=1) for d in (1, 3, 4)]
    got = deltas(counters.io_counter_delta(frame(SNAPSHOT, *rows)))
    assert sorted(got) == [(1, 4), (2, 2), (2, 3), (2, 4)]


def test_empty_poll_is_seen_only_through_a_registry(frame):
    df = frame(SNAPSHOT, snap(1, *[1] * 7), snap(3, *[2] * 7))
    registry = frame("server_name string, collect_date timestamp",
                     ("s", "2024-01-01"), ("s", "2024-01-02"), ("s", "2024-01-03"))
    assert len(deltas(counters.io_counter_delta(df))) == 1
    assert deltas(counters.io_counter_delta(df, registry)) == {}


def test_polls_are_numbered_per_server(frame):
    df = frame(SNAPSHOT, snap(1, *[1] * 7, server="a"), snap(2, *[1] * 7, server="b"), snap(3, *[2] * 7, server="a"))
    assert deltas(counters.io_counter_delta(df)) == {(1, 3): (1,) * 7}


def test_null_counter_stays_null_and_idle_file_still_reports(frame):
    df = frame(SNAPSHOT, snap(1, 1, None, 1, 1, 1, 1, 1), snap(2, 1, 5, 1, 1, 1, 1, 1))
    assert deltas(counters.io_counter_delta(df)) == {(1, 2): (0, None, 0, 0, 0, 0, 0)}


def test_never_used_file_is_dropped(frame):
    df = frame(SNAPSHOT, snap(1, 0, 0, 0, 0, 0, 0, 0), snap(2, 0, 0, 0, 0, 0, 0, 0))
    assert deltas(counters.io_counter_delta(df)) == {}


@pytest.mark.parametrize("growth, alerts", [((99, 0, 24, 0, 0, 0, 0), 0), ((100, 0, 0, 0, 0, 0, 0), 1),
                                            ((0, 0, 25, 0, 0, 0, 0), 1), ((0, 0, 0, 200, 0, 0, 0), 1),
                                            ((0, 0, 0, 0, 0, 50, 0), 1), ((0, 10**9, 0, 199, 10**9, 49, 10**9), 0)])
def test_alert_exactly_at_a_threshold(frame, growth, alerts):
    base = (1000,) * 7
    df = frame(SNAPSHOT, snap(1, *base), snap(2, *[b + g for b, g in zip(base, growth)]))
    assert counters.io_threshold_alert(df).count() == alerts


def test_reset_of_one_counter_with_an_alert_on_another(frame):
    df = frame(SNAPSHOT, snap(1, *[1000] * 7), snap(2, 5, 1000, 1000, 1300, 1000, 1000, 1000))
    assert deltas(counters.io_threshold_alert(df)) == {(1, 2): (0, 0, 0, 300, 0, 0, 0)}


def test_rates_cut_bytes_to_whole_megabytes_first(frame):
    df = frame(SNAPSHOT, snap(2, 3, 3 * 1048576 + 1048575, 700, 0, 5, 0, 0))
    row = counters.io_readable(df).first()
    assert (row.avg_bytes_by_read, row.avg_read_latency_ms) == ((4 * 1048576 - 1) // 3, 233)
    assert str(row.read_mb_sec) == "4.29"
    assert (row.avg_bytes_by_write, row.avg_write_latency_ms, str(row.write_mb_sec)) == (0, 0, "0.00")
    assert str(row.io_mb_sec) == "0.00"


def test_purge_on_31_march_keeps_from_29_february(frame):
    df = frame("collect_date timestamp", ("2024-02-28 23:59:59",), ("2024-02-29 00:00:00",), ("2024-03-31",))
    kept = counters.retention_purge(df, "2024-03-31", counters.IO_HISTORY_KEEP).collect()
    assert sorted(r.collect_date for r in kept) == [dt.datetime(2024, 2, 29), dt.datetime(2024, 3, 31)]


def test_contract_violation_names_the_column(frame):
    with pytest.raises(ValueError, match="missing column collect_date"):
        counters.io_counter_delta(frame("server_name string", ("s",)))


@settings(max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.tuples(st.integers(1, 3), st.integers(1, 12), st.integers(0, 100)), min_size=1, max_size=40,
                unique_by=lambda t: t[:2]), st.integers(1, 5))
def test_chunked_look_back_equals_a_self_join(spark, rows, chunk):
    """Whatever the chunk size: exactly the pairs of consecutive polls, and no reset means deltas add up."""
    df = spark.createDataFrame([("s", k, d, v) for k, d, v in rows], "server_name string, k int, poll int, v bigint")
    got = {(r.k, r.poll): (r.prev_v, r.v) for r in pair_with_previous(
        df, ["server_name"], ["k"], ["v"], at="poll", chunk_polls=chunk).collect()}
    number = {p: n for n, p in enumerate(sorted({d for _, d, _ in rows}))}
    by_key = {(k, number[d]): (d, v) for k, d, v in rows}
    want = {(k, d): (by_key[k, n - 1][1], v) for (k, n), (d, v) in by_key.items() if (k, n - 1) in by_key}
    assert got == want


def test_numbering_counts_distinct_polls(frame):
    df = frame("server_name string, collect_date timestamp", ("a", "2024-01-02"), ("a", "2024-01-01"),
               ("a", "2024-01-02"), ("b", "2024-01-05"))
    got = sorted((r.server_name, r.snapshot_no, r.collect_date.day)
                 for r in number_snapshots(df, ["server_name"]).collect())
    assert got == [("a", 1, 1), ("a", 2, 2), ("b", 1, 5)]
