"""Every registered query against its DuckDB SQL."""

import pytest

import __spark_entry__ as entry
from compare import compare
from statloom.fixtures import oracles, queries

QUERIES, ORACLES = queries.queries(), oracles.oracle_sql()


def test_every_query_has_an_oracle():
    assert set(QUERIES) == set(ORACLES)
    assert set(QUERIES) <= set(entry.queries()) and set(ORACLES) <= set(entry.oracle_sql())


@pytest.mark.parametrize("name", list(QUERIES))
def test_query_matches_oracle(name, spark, duck, sf_dir):
    assert compare(spark, duck, sf_dir, QUERIES[name], ORACLES[name]) is None


def test_entry_returns_rows(spark):
    assert entry.entry(spark).limit(1).count() == 1
