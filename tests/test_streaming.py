"""Streams: late rows, any split of the input, retention of stored histories."""

import datetime as dt
import os
import shutil
import time
import uuid
from types import SimpleNamespace

import pytest
from pyspark.sql import functions as F

from statloom.operators import counters
from statloom.plans.snapshots import number_snapshots
from statloom.sources.history import newest_time, purge_history, read_history, write_history
from statloom.sources.shared import shared_dir
from statloom.sources.tables import stream_table
from statloom.streaming import jobs
from test_counters import SNAPSHOT, snap


@pytest.fixture
def folder(tmp_path):
    return str(tmp_path / uuid.uuid4().hex)


def feed(spark, folder, df, *batches):
    """Write each batch of days as its own file and run the stream after each."""
    numbered = df.join(number_snapshots(df, ["server_name"]), ["server_name", "collect_date"])
    statuses = []
    for days in batches:
        numbered.filter(F.dayofmonth("collect_date").isin(days)).coalesce(1).write.mode("append").parquet(f"{folder}/in")
        stream = jobs.stream_io_pairs(stream_table(spark, f"{folder}/in", numbered))
        jobs.run_to_parquet(stream, f"{folder}/out", f"{folder}/checkpoint")
    for r in spark.read.parquet(f"{folder}/out").collect():
        statuses.append((r.file_id, r.collect_date.day, r.status, r.prev_num_of_reads))
    return sorted(statuses)


def test_late_snapshot_is_marked_and_changes_no_state(spark, frame, folder):
    big = 2 ** 62
    df = frame(SNAPSHOT, *[snap(d, big + d, None, d, d, d, d, d) for d in (1, 2, 3, 4)],
               *[snap(d, d, d, d, d, d, d, d, file=2) for d in (1, 3, 4)])
    got = feed(spark, folder, df, [1, 3], [2], [4])
    assert got == [(1, 1, "first", None), (1, 2, "late", None), (1, 3, "first", None), (1, 4, "paired", big + 3),
                   (2, 1, "first", None), (2, 3, "first", None), (2, 4, "paired", 3)]


def test_any_split_gives_the_batch_result(spark, frame, folder):
    df = frame(SNAPSHOT, *[snap(d, d * d, d, d, d, d, d, d, file=f) for f in (1, 2, 3) for d in range(1, 9)
                           if (f + d) % 4])
    numbered = df.join(number_snapshots(df, ["server_name"]), ["server_name", "collect_date"])
    for days in ([1], [2, 3, 4], [5, 6], [7, 8]):
        numbered.filter(F.dayofmonth("collect_date").isin(days)).write.mode("append").parquet(f"{folder}/in")
        stream = jobs.stream_counter_delta(stream_table(spark, f"{folder}/in", numbered))
        jobs.run_to_parquet(stream, f"{folder}/out", f"{folder}/checkpoint")
    columns = sorted(df.columns)
    got = sorted(map(tuple, spark.read.parquet(f"{folder}/out").select(columns).collect()))
    assert got == sorted(map(tuple, counters.io_counter_delta(df).select(columns).collect())) and got


def days_of(spark, path):
    return sorted((r.collect_date.day, r.collect_date.hour) for r in read_history(spark, path).collect())


def test_purge_drops_days_and_rewrites_the_boundary(spark, frame, folder):
    stamps = [f"2024-01-{d:02d} {h:02d}:00:00" for d in (1, 2, 3) for h in (0, 12)]
    df = frame("collect_date timestamp, v int", *[(s, n) for n, s in enumerate(stamps)])
    write_history(df, folder)
    assert newest_time(spark, folder) == "2024-01-03 12:00:00.000000"
    assert purge_history(spark, folder, "2024-01-03 06:00:00", "1 day") == 1
    assert days_of(spark, folder) == [(2, 12), (3, 0), (3, 12)]
    assert purge_history(spark, folder, "2024-01-03 06:00:00", "1 day") == 0
    assert days_of(spark, folder) == [(2, 12), (3, 0), (3, 12)]
    purge_history(spark, folder, dt.datetime(2024, 1, 4), "1 day")
    assert days_of(spark, folder) == [(3, 0), (3, 12)]


def test_repeated_batch_replaces_itself(spark, frame, folder):
    df = frame("collect_date timestamp, v int", ("2024-01-01", 1), ("2024-01-02", 2))
    for _ in range(2):
        write_history(df, folder, batch_id=7)
    write_history(df, folder, batch_id=8)
    assert read_history(spark, folder).count() == 4
    purge_history(spark, folder, "2024-01-02 12:00:00", "1 day")
    assert read_history(spark, folder).count() == 2


def test_interrupted_purge_is_finished_by_the_next(spark, frame, folder):
    df = frame("collect_date timestamp, v int", ("2024-01-02 00:00:00", 1), ("2024-01-02 12:00:00", 2),
               ("2024-01-03", 3))
    write_history(df, folder)
    kept = frame("collect_date timestamp, v int", ("2024-01-02 12:00:00", 2)).withColumn("dt", F.to_date("collect_date"))
    kept.write.partitionBy("dt").parquet(f"{folder}/_purge_2024-01-02")
    os.rename(f"{folder}/dt=2024-01-02", f"{folder}/_purged_2024-01-02")
    purge_history(spark, folder, "2024-01-03 06:00:00", "1 day")
    assert days_of(spark, folder) == [(2, 12), (3, 0)]


@pytest.mark.parametrize("steps", range(5))
def test_purge_may_stop_after_any_step(spark, frame, folder, steps):
    """0: staged; 1: old day set aside; 2: staged rows in place; 3: staging deleted; 4: all done."""
    df = frame("collect_date timestamp, v int", ("2024-01-02 00:00:00", 1), ("2024-01-02 12:00:00", 2), ("2024-01-03", 3))
    write_history(df, folder)
    kept = frame("collect_date timestamp, v int", ("2024-01-02 12:00:00", 2)).withColumn("dt", F.to_date("collect_date"))
    kept.write.partitionBy("dt").parquet(f"{folder}/_purge_2024-01-02")
    if steps > 0:
        os.rename(f"{folder}/dt=2024-01-02", f"{folder}/_purged_2024-01-02")
    if steps > 1:
        os.rename(f"{folder}/_purge_2024-01-02/dt=2024-01-02", f"{folder}/dt=2024-01-02")
    if steps > 2:
        shutil.rmtree(f"{folder}/_purge_2024-01-02")
    if steps > 3:
        shutil.rmtree(f"{folder}/_purged_2024-01-02")
    extra = [(2, 13)] if steps in (1, 2, 3, 4) else []
    if extra:  # a batch that wrote the same day meanwhile
        write_history(frame("collect_date timestamp, v int", ("2024-01-02 13:00:00", 4)), folder)
    purge_history(spark, folder, "2024-01-03 06:00:00", "1 day")
    assert days_of(spark, folder) == [(2, 12), *extra, (3, 0)]
    assert not [n for n in os.listdir(folder) if n.startswith("_purge")]


def test_rows_without_time_do_not_stop_a_purge(spark, frame, folder):
    write_history(frame("collect_date timestamp, v int", ("2024-01-02", 1), (None, 2), ("2024-01-03", 3)), folder)
    assert newest_time(spark, folder) == "2024-01-03 00:00:00.000000"
    assert purge_history(spark, folder, "2024-01-03 12:00:00", "1 day") == 0
    assert read_history(spark, folder).count() == 2


def test_shared_dir_follows_the_session_setting(spark):
    def session(master, **settings):
        return SimpleNamespace(conf=SimpleNamespace(get=settings.get), sparkContext=SimpleNamespace(master=master))

    cluster = session("yarn", **{"spark.checkpoint.dir": "hdfs://cluster/shared/"})
    assert shared_dir(cluster, "x").startswith("hdfs://cluster/shared/x-")
    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        shared_dir(session("yarn"), "x")
    assert shared_dir(spark, "x") != shared_dir(spark, "x")


def test_a_row_reads_and_writes_its_own_key_only():
    import pandas as pd
    from statloom.streaming.lookback import BUCKET, KEY, LookBack

    class State(dict):
        reads = writes = 0

        def getValue(self, key):
            self.reads += 1
            return self.get(key)

        def updateValue(self, key, value):
            self.writes += 1
            self[key] = value

    state, step = State({(f"k{n}",): (1, "5") for n in range(10_000)}), LookBack(["reads"])
    step.init(SimpleNamespace(getMapState=lambda *a, **k: state))

    def call(*rows):
        frame = pd.DataFrame(rows, columns=[KEY, "snapshot_no", "reads"]).assign(**{BUCKET: 0})
        state.reads = state.writes = 0
        out = next(step.handleInputRows(0, iter([frame]), None))
        return [tuple(r) for r in out[["snapshot_no", "status", "prev_reads"]].itertuples(index=False)], state.reads, state.writes

    assert call(("k7", 2, "9")) == ([(2, "paired", "5")], 1, 1) and state["k7",] == (2, "9")
    assert call(("k7", 2, "8")) == ([(2, "late", None)], 1, 0)
    assert call(("k8", 3, "1"), ("new", 1, None), ("k8", 4, "2")) == (
        [(3, "first", None), (4, "paired", "1"), (1, "first", None)], 2, 2)
    assert state["new",] == (1, None) and len(state) == 10_001


def test_keys_unseen_for_long_leave_the_state(spark, frame, folder):
    from statloom.streaming.pairing import pair_stream
    df = frame(SNAPSHOT, *[snap(d, d, d, d, d, d, d, d, file=f) for d in (1, 2) for f in (1, 2)])
    numbered = df.join(number_snapshots(df, ["server_name"]), ["server_name", "collect_date"])
    for day in (1, 2):
        numbered.filter((F.dayofmonth("collect_date") == day)).coalesce(1).write.mode("append").parquet(f"{folder}/in")
        stream = pair_stream(stream_table(spark, f"{folder}/in", numbered), ["server_name"], counters.IO_KEYS, counters.IO_COUNTERS,
                             forget_ms=1500, buckets=4)
        query = (stream.writeStream.format("parquet").option("path", f"{folder}/out").option("checkpointLocation", f"{folder}/checkpoint")
                 .trigger(once=True).start())
        assert query.awaitTermination(60)
        time.sleep(2)
    got = sorted((r.collect_date.day, r.status) for r in spark.read.parquet(f"{folder}/out").collect())
    assert got == [(1, "first"), (1, "first"), (2, "first"), (2, "first")]


def test_state_goes_on_with_other_buckets(spark, frame, folder):
    from statloom.streaming.pairing import known_snapshots, pair_stream
    df = frame(SNAPSHOT, *[("s", None if f == 3 else 1, f, f"2024-01-0{d}", 2 ** 61 + d, None, d, d, d, d, d)
                           for d in (1, 2, 3) for f in range(1, 8)])
    numbered = df.join(number_snapshots(df, ["server_name"]), ["server_name", "collect_date"])

    def run(days, checkpoint, **options):
        numbered.filter(F.dayofmonth("collect_date").isin(days)).write.parquet(f"{folder}/in-{checkpoint}")
        stream = pair_stream(stream_table(spark, f"{folder}/in-{checkpoint}", numbered), ["server_name"], counters.IO_KEYS,
                             counters.IO_COUNTERS, **options)
        jobs.run_to_parquet(stream, f"{folder}/out-{checkpoint}", f"{folder}/{checkpoint}")
        return sorted((r.file_id, r.collect_date.day, r.status, r.prev_num_of_reads) for r in spark.read.parquet(f"{folder}/out-{checkpoint}").collect())

    run([1, 2], "old", buckets=3)
    known = known_snapshots(spark, f"{folder}/old")
    assert known.count() == 7
    assert run([2, 3], "new", buckets=16, known=known) == sorted(
        [(f, 2, "late", None) for f in range(1, 8)] + [(f, 3, "paired", 2 ** 61 + 2) for f in range(1, 8)])


def small_stream(spark, frame, folder, *batches):
    """A file per batch, each taken by itself; None is a file of which nothing remains."""
    schema = "collect_date timestamp, v int"
    for n, day in enumerate(batches):
        rows = frame(schema, (f"2024-01-{day or 1:02d}", day or -1))
        rows.coalesce(1).write.parquet(f"{folder}/in/{n}")
        time.sleep(0.05)  # files are taken by age
    return stream_table(spark, f"{folder}/in/*", frame(schema, ("2024-01-01", 1)), 1).filter("v > 0")


@pytest.mark.parametrize("batches", [(None, 3, 4), (3, None, 4), (None, None), (3, 4, None)])
def test_batches_without_rows_do_not_stop_retention(spark, frame, folder, batches):
    stream = small_stream(spark, frame, folder, *batches)
    jobs.stream_with_retention(stream, f"{folder}/out", f"{folder}/checkpoint", "1 day").awaitTermination()
    if any(batches):
        assert days_of(spark, f"{folder}/out") == [(d, 0) for d in batches if d]
    else:
        assert not os.path.isdir(f"{folder}/out") or not [n for n in os.listdir(f"{folder}/out") if n.startswith("dt=")]


def test_retention_goes_on_after_a_restart_and_a_repeated_batch(spark, frame, folder):
    args = (f"{folder}/out", f"{folder}/checkpoint", "1 day")
    jobs.stream_with_retention(small_stream(spark, frame, folder, 3, None), *args).awaitTermination()
    last = sorted(os.listdir(f"{folder}/checkpoint/commits"))[-1]
    for name in os.listdir(f"{folder}/checkpoint/commits"):  # as if the last batch had not been committed
        if last.lstrip(".").removesuffix(".crc") in name:
            os.remove(f"{folder}/checkpoint/commits/{name}")
    frame("collect_date timestamp, v int", ("2024-01-06", 6)).coalesce(1).write.parquet(f"{folder}/in/9")
    stream = stream_table(spark, f"{folder}/in/*", frame("collect_date timestamp, v int", ("2024-01-01", 1)), 1).filter("v > 0")
    jobs.stream_with_retention(stream, *args).awaitTermination()
    assert days_of(spark, f"{folder}/out") == [(6, 0)]


def test_late_rows_are_stored_beside_the_deltas(spark, frame, folder):
    df = frame(SNAPSHOT, *[snap(d, d * d, d, d, d, d, d, d, file=f) for f in (1, 2) for d in (1, 2, 3, 4)])
    numbered = df.join(number_snapshots(df, ["server_name"]), ["server_name", "collect_date"])
    for days in ([1, 3], [2], [4]):
        numbered.filter(F.dayofmonth("collect_date").isin(days)).coalesce(1).write.mode("append").parquet(f"{folder}/in")
        jobs.stream_counters_routed(stream_table(spark, f"{folder}/in", numbered), f"{folder}/out", f"{folder}/checkpoint").awaitTermination()
    deltas = jobs.routed_deltas(spark, f"{folder}/out", numbered)
    assert sorted((r.file_id, r.collect_date.day, r.num_of_reads) for r in deltas.collect()) == [(1, 4, 7), (2, 4, 7)]
    late = jobs.routed_late(spark, f"{folder}/out", numbered)
    assert sorted((r.file_id, r.collect_date.day, r.num_of_reads) for r in late.collect()) == [(1, 2, 4), (2, 2, 4)]
    assert [(r.late_rows, r.late_polls) for r in jobs.late_counts(late).collect()] == [(2, 1)]
    assert jobs.routed_late(spark, f"{folder}/nothing", numbered).count() == 0


def test_every_faulty_document_is_in_one_output(spark, folder, sf_dir):
    from statloom.fixtures.inputs import Inputs
    from statloom.operators import events
    documents = Inputs(spark, sf_dir).event_documents().limit(400).select(F.replace("event_xml", F.lit("\n"), F.lit("&#10;")).alias("event_xml"))
    documents.repartition(3).write.text(f"{folder}/in")
    documents = spark.read.text(f"{folder}/in").select(F.col("value").alias("event_xml"))
    stream = spark.readStream.option("maxFilesPerTrigger", 1).text(f"{folder}/in").select(F.col("value").alias("event_xml"))
    for again in (False, True):
        if again:  # the last batch runs once more
            for name in os.listdir(f"{folder}/checkpoint/commits"):
                if name.strip(".").removesuffix(".crc") == "2":
                    os.remove(f"{folder}/checkpoint/commits/{name}")
        jobs.stream_events_routed(stream, f"{folder}/out", f"{folder}/checkpoint", 1000).awaitTermination()
        rejects = sorted(r.event_xml for r in jobs.routed_rejects(spark, f"{folder}/out", documents).collect())
        assert rejects == sorted(r.event_xml for r in events.event_rejects(documents).collect()) and rejects
        slow = jobs.routed_events(spark, f"{folder}/out", documents)
        want = jobs.stream_slow_events(documents, 1000)
        assert slow.columns == want.columns
        assert sorted(map(str, slow.collect())) == sorted(map(str, want.collect())) and want.count()


def test_rows_reach_the_look_back_in_few_columns(spark, frame, folder):
    """Spark hands rows to Python one by one, at a cost per column; keys of any type and NULLs come back as they were."""
    schema = SNAPSHOT.replace("database_id int", "database_id timestamp")
    odd = [('s",\n\\ é', "2024-01-01 00:00:00.000001"), (None, None), ("s", "2024-01-01 00:00:00.000002")]
    df = frame(schema, *[(name, day_key, 1, f"2024-01-0{d}", 2 ** 62 + d, None, d, d, d, d, d) for name, day_key in odd for d in (1, 2)])
    numbered = df.withColumn("snapshot_no", F.dayofmonth("collect_date").cast("bigint"))
    numbered.coalesce(1).write.parquet(f"{folder}/in")
    stream = jobs.stream_io_pairs(stream_table(spark, f"{folder}/in", numbered))
    jobs.run_to_parquet(stream, f"{folder}/out", f"{folder}/checkpoint")
    out = spark.read.parquet(f"{folder}/out")
    assert out.schema["database_id"].dataType.simpleString() == "timestamp"
    got = out.filter("status = 'paired'").select("server_name", "database_id", "file_id", "prev_num_of_reads", "num_of_bytes_read").collect()
    want = df.filter("dayofmonth(collect_date) = 2").select("server_name", "database_id").collect()
    assert sorted(map(str, [(r[0], r[1]) for r in got])) == sorted(map(str, [(r[0], r[1]) for r in want])) and len(got) == 3
    assert {(r[2], r[3], r[4]) for r in got} == {(1, 2 ** 62 + 1, None)}
    plan = stream._jdf.queryExecution().analyzed().toString()
    step = next(line for line in plan.split("\n") if "TransformWithState" in line)
    assert "prev_num_of_reads" not in step and "prev_packed" in step


def test_days_of_a_stateful_batch_are_one_file_each(spark, frame, folder):
    from pathlib import Path
    df = frame(SNAPSHOT, *[snap(d, *[d] * 7, file=f) for f in range(1, 40) for d in (1, 2, 3)])
    numbered = df.join(number_snapshots(df, ["server_name"]), ["server_name", "collect_date"])
    numbered.coalesce(1).write.parquet(f"{folder}/in")
    jobs.stream_counters_routed(stream_table(spark, f"{folder}/in", numbered), f"{folder}/out", f"{folder}/checkpoint").awaitTermination()
    assert jobs.routed_deltas(spark, f"{folder}/out", numbered).count() == 2 * 39
    files = [p.parent.parent.name for p in Path(f"{folder}/out/status=paired").rglob("*.parquet")]
    assert sorted(files) == ["dt=2024-01-02", "dt=2024-01-03"]
