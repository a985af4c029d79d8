"""Rows that every operator must take: NULLs, empty and long texts, repeated rows, columns with clashing names."""

import pytest

ODD = [(1, "plain words here", "s"), (2, None, "s"), (3, "", None), (4, " \n\t ", None), (None, "no id", "s"), (None, None, None),
       (5, "twice the same", "t"), (5, "twice the same", "t"), (6, "twice the same", "t"), (7, "long text " * 20_000, "t"),
       (8, "é ü 日本 “q” |x|\x00y", "u"), (9, "x", "u")]

#: Names that operators use for results or inside.
CLASHING = ["score", "size", "target", "taken", "length", "piece", "kept", "n_words", "print", "root", "word", "n", "bands", "key", "_row",
            "_bytes", "slot", "shard", "sum", "a", "b", "kind", "label", "quality", "toxic", "_size", "_source", "_order", "component_id"]


@pytest.fixture(scope="session")
def odd(spark):
    from pyspark.sql import functions as F
    docs = spark.createDataFrame(ODD, "doc_id long, text string, source string").repartition(3)
    return docs.select("*", *[F.lit(n).alias(c) for n, c in enumerate(CLASHING)])


@pytest.fixture(scope="session")
def some_labels(spark):
    return spark.createDataFrame([(1, 1, 0), (5, 0, 1), (5, 0, 1), (7, 1, None), (8, 0, 1), (8, 1, 0), (None, 1, 1), (9, 7, 7), (99, 1, 0)],
                                 "doc_id long, quality int, toxic int")


@pytest.fixture(scope="session")
def small_dir():
    """Enough labelled rows to fit on."""
    return "/root/testdata/sf0.01"
