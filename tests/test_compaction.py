"""Compacted histories: whole at every step, few files in a day, one host's rows found without reading the others."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from statloom.plans.solutions import run_io_solution
from statloom.sources import compaction, history, manifest
from statloom.sources.compaction import compact_history, history_files
from statloom.sources.history import newest_time, purge_history, read_history, stored_days, write_history
from statloom.streaming import jobs
from test_counters import SNAPSHOT, snap

ROW = "server_name string, collect_date timestamp, v int"


@pytest.fixture
def folder(tmp_path):
    return str(tmp_path / "history")


def values(spark, folder):
    return sorted(r.v for r in read_history(spark, folder).collect())


def fill(frame, folder, parts=3, batch=False):
    """Two rows a day on three days in each part; ``v`` tells them apart."""
    for part in range(parts):
        rows = [("s", f"2024-01-0{d} 0{part}:00:00", 100 * part + 10 * d + n) for d in (1, 2, 3) for n in (0, 1)]
        write_history(frame(ROW, *rows), folder, batch_id=part if batch else None)
    return sorted(100 * part + 10 * d + n for part in range(parts) for d in (1, 2, 3) for n in (0, 1))


@pytest.mark.parametrize("batch", [False, True])
def test_closed_days_have_one_file(spark, frame, folder, batch):
    want = fill(frame, folder, batch=batch)
    columns = set(read_history(spark, folder).columns)
    assert compact_history(spark, folder, "2024-01-03") == ["2024-01-01", "2024-01-02"]
    assert values(spark, folder) == want and set(read_history(spark, folder).columns) == columns
    assert history_files(spark, folder) == {"2024-01-01": 1, "2024-01-02": 1, "2024-01-03": 3}
    assert compact_history(spark, folder, "2024-01-03") == []  # and the replaced files go
    assert not manifest.loose_files(spark, folder, "2024-01-01") and values(spark, folder) == want
    write_history(frame(ROW, ("t", "2024-01-01 05:00:00", 1), (None, None, 2)), folder, batch_id=9 if batch else None)
    assert values(spark, folder) == sorted([*want, 1, 2]) and stored_days(spark, folder) == [f"2024-01-0{d}" for d in (1, 2, 3)]
    assert compact_history(spark, folder, "2024-01-03") == ["2024-01-01"]
    assert values(spark, folder) == sorted([*want, 1, 2]) and history_files(spark, folder)["2024-01-01"] == 1
    assert newest_time(spark, folder).startswith("2024-01-03 02")


def test_repeated_batch_replaces_its_compacted_rows(spark, frame, folder):
    want = fill(frame, folder, batch=True)
    compact_history(spark, folder, "2024-01-04")
    for _ in range(2):
        rows = [("s", f"2024-01-0{d} 02:00:00", 200 + 10 * d + n) for d in (1, 2, 3) for n in (0, 1)]
        write_history(frame(ROW, *rows), folder, batch_id=2)
        assert values(spark, folder) == want
        compact_history(spark, folder, "2024-01-04")
        assert values(spark, folder) == want


@pytest.mark.parametrize("step", ["_sweep", "rewritten", "commit", "after"])
def test_a_run_may_stop_at_any_step(spark, frame, folder, monkeypatch, step):
    want = fill(frame, folder)
    compact_history(spark, folder, "2024-01-02")
    write_history(frame(ROW, ("s", "2024-01-01 09:00:00", 7)), folder)
    want = sorted([*want, 7])
    real, calls = getattr(compaction, "commit" if step == "after" else step), []

    def stop(*args, **more):
        calls.append(1)
        if step == "_sweep" or (step == "after" and len(calls) == 2):
            raise OSError("stopped")
        done = real(*args, **more) if step != "commit" else None
        if step == "commit" or (step == "rewritten" and len(calls) == 2):
            raise OSError("stopped")
        return done

    with monkeypatch.context() as patch:
        patch.setattr(compaction, "commit" if step == "after" else step, stop)
        with pytest.raises(OSError):
            compact_history(spark, folder, "2024-01-04")
    assert values(spark, folder) == want
    compact_history(spark, folder, "2024-01-04")
    assert values(spark, folder) == want and set(history_files(spark, folder).values()) == {1}
    compact_history(spark, folder, "2024-01-04")
    assert values(spark, folder) == want
    versions = [n for d in manifest.names_in(spark, f"{folder}/_closed") for n in manifest.names_in(spark, f"{folder}/_closed/{d}")]
    assert len(versions) == 3  # nothing of the stopped run is left


def test_a_reader_that_began_before_can_finish(spark, frame, folder):
    want = fill(frame, folder)
    before = read_history(spark, folder)
    compact_history(spark, folder, "2024-01-04")
    assert sorted(r.v for r in before.collect()) == want


def test_purge_by_manifest(spark, frame, folder, monkeypatch):
    fill(frame, folder)
    compact_history(spark, folder, "2024-01-03")
    with monkeypatch.context() as patch:
        patch.setattr(manifest, "commit", lambda *a: (_ for _ in ()).throw(OSError("stopped")))
        with pytest.raises(OSError):
            purge_history(spark, folder, "2024-01-03 01:00:00", "1 day")
    assert len(values(spark, folder)) == 18
    assert purge_history(spark, folder, "2024-01-03 01:00:00", "1 day") == 1
    left = sorted(100 * p + 20 + n for p in (1, 2) for n in (0, 1)) + sorted(100 * p + 30 + n for p in range(3) for n in (0, 1))
    assert values(spark, folder) == sorted(left)
    assert purge_history(spark, folder, "2024-01-03 01:00:00", "1 day") == 0
    assert purge_history(spark, folder, dt.datetime(2024, 2, 1), "1 day") == 2
    assert stored_days(spark, folder) == []


def test_replaced_range_of_compacted_days(spark, frame, folder):
    fill(frame, folder)
    compact_history(spark, folder, "2024-01-04")
    history.replace_range(frame(ROW, ("s", "2024-01-02 00:00:00", 5)), folder, ("2024-01-02", "2024-01-03"))
    assert [v for v in values(spark, folder) if v % 100 >= 20 or v == 5] == [5]
    assert stored_days(spark, folder) == ["2024-01-01", "2024-01-02"]
    compact_history(spark, folder, "2024-01-04")
    assert len(values(spark, folder)) == 7


def test_solution_over_compacted_snapshots(spark, frame, tmp_path):
    snapshots, deltas = str(tmp_path / "snapshots"), str(tmp_path / "deltas")
    for d in range(1, 5):
        write_history(frame(SNAPSHOT, snap(d, *[d * d] * 7)), snapshots)
        write_history(frame(SNAPSHOT, snap(d, *[3 * d] * 7, server="t")), snapshots)
        compact_history(spark, snapshots, f"2024-01-0{d}")
        run_io_solution(spark, snapshots, deltas, "2024-01-05")
        compact_history(spark, deltas, f"2024-01-0{d}")
    found = sorted((r.server_name, r.collect_date.day, r.num_of_reads) for r in read_history(spark, deltas).collect())
    assert found == [("s", d, 2 * d - 1) for d in (2, 3, 4)] + [("t", d, 3) for d in (2, 3, 4)]


def test_stream_compacts_closed_days(spark, frame, tmp_path):
    source, out, checkpoint = (str(tmp_path / n) for n in ("in", "out", "checkpoint"))
    for d in range(1, 5):
        for hour in (1, 2):
            frame(ROW, ("s", f"2024-01-0{d} 0{hour}:00:00", 10 * d + hour)).coalesce(1).write.mode("append").parquet(source)
            stream = spark.readStream.schema("server_name string, collect_date timestamp, v int").parquet(source)
            jobs.stream_with_retention(stream, out, checkpoint, "10 days", compact=True).awaitTermination()
    assert values(spark, out) == sorted(10 * d + h for d in range(1, 5) for h in (1, 2))
    assert history_files(spark, out) == {"2024-01-01": 1, "2024-01-02": 1, "2024-01-03": 1, "2024-01-04": 2}


def read_rows(df):
    """Rows that the scan hands on: whole row groups and pages, before the filter."""
    plan = df._jdf.queryExecution().executedPlan()
    df.collect()
    leaves = plan.collectLeaves()
    return sum(leaves.apply(n).metrics().get("numOutputRows").get().value() for n in range(leaves.size()))


def test_one_host_reads_few_row_groups(spark, folder):
    name = F.concat(F.lit("host"), F.lpad((F.col("id") * 7919 % 2000 * 2).cast("string"), 5, "0"))  # even numbers only
    rows = spark.range(0, 200_000, 1, 4).select(
        name.alias("server_name"), F.expr("timestamp'2024-01-01' + make_interval(0, 0, 0, 0, 0, 0, id % 80000)").alias("collect_date"),
        F.md5(F.col("id").cast("string")).alias("v"))
    write_history(rows, folder)
    write_history(rows, folder)
    before = read_history(spark, folder).filter("server_name = 'host00100'").count()
    compact_history(spark, folder, "2024-01-02", file_bytes=4 << 20, row_group_bytes=256 << 10)
    assert 1 < history_files(spark, folder)["2024-01-01"] < 8
    found = read_history(spark, folder).filter("server_name = 'host00100'")
    assert found.count() == before == 200
    assert read_rows(found) < 0.1 * 400_000
    assert read_rows(read_history(spark, folder).filter("server_name = 'host00101'")) == 0  # between others: the Bloom filter


def test_days_are_rewritten_side_by_side(spark, frame, folder, monkeypatch):
    import threading
    want, real, both = fill(frame, folder), compaction.resolved, threading.Barrier(2, timeout=60)

    def met(*args, **more):
        both.wait()  # breaks unless another day is under way
        return real(*args, **more)

    with monkeypatch.context() as patch:
        patch.setattr(compaction, "resolved", met)
        assert compact_history(spark, folder, "2024-01-03", at_once=2) == ["2024-01-01", "2024-01-02"]
    assert values(spark, folder) == want and manifest.load(spark, folder).number == 2
