"""Shapes of the physical plans, with broadcasts switched off, as on tables too large for them."""

import re

import pytest

import __spark_entry__ as entry

QUERIES = {n: q for n, q in entry.queries().items() if not n.startswith("stream_")}
TOP_N = ("wait_top_n", "backup_history", "backup_last_n", "cache_by_relation", "cache_top_relations", "cache_share_total",
         "cache_share_window", "relation_disk_usage", "relation_size_split", "statement_top")
NARROW = ("slow_event_filter", "trace_by_host", "replica_latency", "database_stats", "size_pretty", "failover_events")


@pytest.fixture(scope="module")
def plan(spark, sf_dir):
    settings = ("spark.sql.autoBroadcastJoinThreshold", "spark.sql.adaptive.autoBroadcastJoinThreshold")
    before = [spark.conf.get(s) for s in settings]
    for setting in settings:
        spark.conf.set(setting, "-1")
    made = {}

    def get(name):
        if name not in made:
            made[name] = QUERIES[name](spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
        return made[name]
    yield get
    for setting, value in zip(settings, before):
        spark.conf.set(setting, value)


@pytest.mark.parametrize("name", list(QUERIES))
def test_no_product_join_no_python_no_single_task_window(plan, name):
    # the reader of event files is a Python source, as README says; nothing after its scan may be Python
    text = "\n".join(line for line in plan(name).split("\n") if "BatchScan event_files" not in line)
    for operator in ("CartesianProduct", "NestedLoopJoin", "Python", "Pandas"):
        assert operator not in text
    assert not re.search(r"Window \[[^\n]*\n[^\n]*(Sort[^\n]*\n[^\n]*)?SinglePartition", text)
    if name != "table_row_counts":
        assert "SinglePartition" not in text


@pytest.mark.parametrize("name", TOP_N)
def test_top_n_is_cut_before_the_shuffle(plan, name):
    assert "WindowGroupLimit" in plan(name)


@pytest.mark.parametrize("name", NARROW)
def test_narrow_operators_do_not_shuffle(plan, name):
    assert "Exchange" not in plan(name)


def test_event_documents_are_parsed_once(plan):
    for name in ("event_shred", "failover_events"):
        assert plan(name).count("from_xml") == 1


def test_pages_are_counted_before_the_join(plan):
    text = plan("cache_by_relation")
    assert text.index("SortMergeJoin") < text.index("partial_count")


def test_history_predicates_and_columns_reach_the_scan(spark, frame, tmp_path):
    from pyspark.sql import functions as F

    from statloom.operators.counters import retention_purge
    from statloom.sources.history import read_history, write_history
    path = str(tmp_path / "history")
    write_history(frame("collect_date timestamp, a int, b int", ("2024-01-01", 1, 1), ("2024-01-02", 2, 2)), path)
    kept = retention_purge(read_history(spark, path), "2024-01-03", "1 day").filter(F.col("dt") > "2024-01-01")
    text = kept.select("a")._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThanOrEqual(collect_date" in text and "ReadSchema: struct<collect_date:timestamp,a:int>" in text
    assert re.search(r"PartitionFilters: \[[^\]]*dt", text)


def test_lists_of_an_index_are_collected_once(plan):
    for name, lists in (("index_fingerprint", 1), ("unused_indexes", 1), ("duplicate_indexes_prefix", 2), ("index_definition", 2)):
        assert plan(name).count("partial_collect_list") == lists  # one for index columns, one for partitions or pairs
