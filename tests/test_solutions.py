"""The monitoring solutions from stored snapshots to stored, purged histories."""

from statloom.operators import counters, waits
from statloom.plans.solutions import number_new_polls, run_io_alert_solution, run_io_solution, run_wait_solution, snapshots_from
from statloom.sources.history import purge_history, read_history, stored_days, write_history
from test_counters import SNAPSHOT, snap
from test_waits import WAIT


def test_io_solution_can_be_repeated_and_purges(spark, frame, tmp_path):
    snapshots, history, alerts = (str(tmp_path / n) for n in ("snapshots", "history", "alerts"))
    write_history(frame(SNAPSHOT, *[snap(d, *[d * d] * 7) for d in (1, 2, 3)]), snapshots)
    for _ in range(2):
        run_io_solution(spark, snapshots, history, "2024-02-02 12:00:00")
    rows = counters.io_readable(read_history(spark, history)).collect()
    assert [(r.collect_date.day, r.num_of_reads) for r in rows] == [(3, 5)]

    write_history(frame(SNAPSHOT, snap(4, *[1000] * 7)), snapshots)
    run_io_solution(spark, snapshots, history, "2024-01-05", recompute=True)
    assert sorted(r.collect_date.day for r in read_history(spark, history).collect()) == [2, 3, 4]
    run_io_alert_solution(spark, snapshots, alerts, "2024-01-05", read_ms=900, write_ms=900, reads=900, writes=900)
    assert [r.collect_date.day for r in read_history(spark, alerts).collect()] == [4]


def test_raised_thresholds_empty_old_days(spark, frame, tmp_path):
    snapshots, alerts = (str(tmp_path / n) for n in ("snapshots", "alerts"))
    write_history(frame(SNAPSHOT, *[snap(d, *[1000 * d] * 7) for d in (1, 2, 3)]), snapshots)
    low = {"read_ms": 900, "write_ms": 900, "reads": 900, "writes": 900}
    run_io_alert_solution(spark, snapshots, alerts, "2024-01-05", **low)
    assert stored_days(spark, alerts) == ["2024-01-02", "2024-01-03"]
    high = {k: 1_000_000 for k in low}
    run_io_alert_solution(spark, snapshots, alerts, "2024-01-05", recompute=True, **high)
    assert stored_days(spark, alerts) == []


def test_second_run_reads_new_days_only(spark, frame, tmp_path):
    snapshots, history = (str(tmp_path / n) for n in ("snapshots", "history"))
    write_history(frame(SNAPSHOT, *[snap(d, *[d * d] * 7) for d in (1, 2, 15)]), snapshots)
    run_io_solution(spark, snapshots, history, "2024-01-05")
    write_history(frame(SNAPSHOT, snap(16, *[1000] * 7)), snapshots)
    run_io_solution(spark, snapshots, history, "2024-01-05")
    rows = counters.io_readable(read_history(spark, history)).collect()
    assert sorted((r.collect_date.day, r.num_of_reads) for r in rows) == [(2, 3), (15, 221), (16, 775)]
    plan = snapshots_from(spark, snapshots, "2024-01-16")._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(dt" in plan and "2024-01-09" in plan


def test_wait_solution(spark, frame, tmp_path):
    snapshots, history = str(tmp_path / "snapshots"), str(tmp_path / "history")
    rows = [("s", w, f"2024-01-0{d}", 1, d * 10, 1, d) for d in (1, 2) for w in ("LCK_M_X", "XE_TIMER_EVENT")]
    write_history(frame(WAIT, *rows), snapshots)
    run_wait_solution(spark, snapshots, history, "2024-01-03")
    top = waits.wait_top_n(read_history(spark, history)).collect()
    assert [(r.wait_type, r.wait_time_ms, r.signal_wait_time_ms) for r in top] == [("LCK_M_X", 10, 1)]


def runs_equal_recompute(spark, tmp_path, run, *steps):
    """The history after a run per step is that of a single run over all snapshots."""
    snapshots, history, whole = (str(tmp_path / n) for n in ("snapshots", "history", "whole"))
    for step in steps:
        write_history(step, snapshots)
        run(spark, snapshots, history, "2024-02-01")
    run(spark, snapshots, whole, "2024-02-01")
    got, want = (sorted(read_history(spark, h).collect()) for h in (history, whole))
    assert got == want
    return got


def test_server_silent_for_weeks_keeps_its_delta(spark, frame, tmp_path):
    rows = [snap(d, *[d * d] * 7, server="t") for d in range(1, 21)]
    got = runs_equal_recompute(spark, tmp_path, run_io_solution, frame(SNAPSHOT, *rows, snap(1, *[5] * 7)),
                               frame(SNAPSHOT, snap(21, *[500] * 7, server="t"), snap(21, *[905] * 7)))
    assert [r.num_of_reads for r in got if r.server_name == "s"] == [900]


def test_late_snapshots_are_computed(spark, frame, tmp_path):
    rows = [snap(d, *[d * d] * 7, server="t") for d in range(1, 16)]
    got = runs_equal_recompute(spark, tmp_path, run_io_solution, frame(SNAPSHOT, *rows),
                               frame(SNAPSHOT, *[snap(d, *[d * d] * 7) for d in (2, 3)]),
                               frame(SNAPSHOT, snap(4, *[100] * 7)))
    assert [(r.collect_date.day, r.num_of_reads) for r in got if r.server_name == "s"] == [(3, 5), (4, 91)]


def test_purged_snapshots_keep_their_history(spark, frame, tmp_path):
    snapshots, history = str(tmp_path / "snapshots"), str(tmp_path / "history")
    write_history(frame(SNAPSHOT, *[snap(d, *[d * d] * 7) for d in range(1, 6)]), snapshots)
    run_io_solution(spark, snapshots, history, "2024-01-06")
    purge_history(spark, snapshots, "2024-01-06", "2 days")
    write_history(frame(SNAPSHOT, snap(6, *[36] * 7)), snapshots)
    run_io_solution(spark, snapshots, history, "2024-01-06")
    assert sorted(r.collect_date.day for r in read_history(spark, history).collect()) == [2, 3, 4, 5, 6]


def test_last_wait_that_matters_may_be_old(spark, frame, tmp_path):
    rows = [("s", "XE_TIMER_EVENT", f"2024-01-{d:02d}", 1, d, 1, d) for d in range(2, 20)]
    runs_equal_recompute(spark, tmp_path, run_wait_solution,
                         frame(WAIT, ("s", "LCK_M_X", "2024-01-01", 1, 10, 1, 1), ("s", "LCK_M_X", "2024-01-02", 1, 20, 1, 2), *rows),
                         frame(WAIT, ("s", "LCK_M_X", "2024-01-20", 1, 30, 1, 3)))


POLLS = "server_name string, collect_date timestamp"


def test_polls_without_rows_break_pairs(spark, frame, tmp_path):
    snapshots, polls, history, plain = (str(tmp_path / n) for n in ("snapshots", "polls", "history", "plain"))
    write_history(frame(SNAPSHOT, *[snap(d, *[d * d] * 7) for d in (1, 2, 4, 5, 20)], *[snap(d, *[d] * 7, server="t") for d in (2, 4)]), snapshots)
    days = lambda path: sorted((r.server_name, r.collect_date.day) for r in read_history(spark, path).collect())
    run = lambda path, **more: run_io_solution(spark, snapshots, path, "2024-01-25", **more)
    run(plain)
    assert days(plain) == [("s", 2), ("s", 4), ("s", 5), ("s", 20), ("t", 4)]
    run(history, polls=polls)  # nothing is listed yet
    assert days(history) == days(plain)
    write_history(frame(POLLS, ("s", "2024-01-03"), ("s", "2024-01-02"), ("t", "2024-01-05")), polls)  # listed late
    run(history, polls=polls)
    assert days(history) == [("s", 2), ("s", 5), ("s", 20), ("t", 4)]
    write_history(frame(POLLS, ("s", "2024-01-12"), ("s", "2024-01-12")), polls)
    run(history, polls=polls)
    assert days(history) == [("s", 2), ("s", 5), ("t", 4)]
    write_history(frame(SNAPSHOT, snap(21, *[500] * 7), snap(21, *[9] * 7, server="t")), snapshots)
    run(history, polls=polls)  # the last poll of t was one without rows, weeks ago
    assert days(history) == [("s", 2), ("s", 5), ("s", 21), ("t", 4)]
    whole = str(tmp_path / "whole")
    run(whole, polls=polls)
    assert days(whole) == days(history)


def test_empty_polls_break_alerts_and_waits(spark, frame, tmp_path):
    snapshots, polls, alerts = (str(tmp_path / n) for n in ("snapshots", "polls", "alerts"))
    write_history(frame(SNAPSHOT, *[snap(d, *[1000 * d] * 7) for d in (1, 3, 4)]), snapshots)
    write_history(frame(POLLS, ("s", "2024-01-02")), polls)
    run_io_alert_solution(spark, snapshots, alerts, "2024-01-05", polls=polls, read_ms=900)
    assert [r.collect_date.day for r in read_history(spark, alerts).collect()] == [4]
    raw, waited = str(tmp_path / "raw"), str(tmp_path / "waited")
    write_history(frame(WAIT, *[("s", "LCK_M_X", f"2024-01-0{d}", 1, d * 10, 1, d) for d in (1, 3, 4)]), raw)
    run_wait_solution(spark, raw, waited, "2024-01-05", polls=polls)
    assert [r.collect_date.day for r in read_history(spark, waited).collect()] == [4]


def test_polls_are_numbered_on(spark, frame, tmp_path):
    path = str(tmp_path / "numbered")
    numbers = lambda: sorted((r.server_name, r.collect_date.day, r.snapshot_no) for r in read_history(spark, path).collect())
    for _ in range(2):
        number_new_polls(spark, path, frame(POLLS, ("s", "2024-01-02"), ("s", "2024-01-04"), ("s", "2024-01-04"), ("t", "2024-01-03"), (None, None)))
        assert numbers() == [("s", 2, 1), ("s", 4, 2), ("t", 3, 1)]
    number_new_polls(spark, path, frame(POLLS, ("s", "2024-01-03"), ("s", "2024-01-04"), ("s", "2024-01-05"), ("s", "2024-01-06"), ("u", "2024-01-01")))
    assert numbers() == [("s", 2, 1), ("s", 4, 2), ("s", 5, 3), ("s", 6, 4), ("t", 3, 1), ("u", 1, 1)]
    number_new_polls(spark, path, frame(POLLS))
    assert len(numbers()) == 6


def test_a_numbered_poll_without_rows_breaks_the_pair_of_a_stream(spark, frame, tmp_path):
    from statloom.sources.tables import stream_table
    from statloom.streaming import jobs
    registry, folder = str(tmp_path / "numbered"), str(tmp_path / "in")
    number_new_polls(spark, registry, frame(POLLS, *[("s", f"2024-01-0{d}") for d in (1, 2, 3, 4)]))
    rows = frame(SNAPSHOT, *[snap(d, *[d * d] * 7) for d in (1, 3, 4)])  # nothing on the second
    numbers = read_history(spark, registry).drop("dt")
    rows.join(numbers, ["server_name", "collect_date"]).select(*rows.columns, "snapshot_no").write.parquet(folder)
    deltas = jobs.stream_counter_delta(stream_table(spark, folder, spark.read.parquet(folder)))
    jobs.run_to_parquet(deltas, str(tmp_path / "out"), str(tmp_path / "checkpoint"))
    assert [(r.collect_date.day, r.num_of_reads) for r in spark.read.parquet(str(tmp_path / "out")).collect()] == [(4, 7)]
