import sys
from pathlib import Path

import pytest

ROOT = Path(__file__).resolve().parents[1]
sys.path[:0] = [str(ROOT), str(ROOT / "tests")]

SF_DIR = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    from statloom.session import local_session
    session = local_session("statloom-tests", 4)
    yield session
    session.stop()


@pytest.fixture(scope="session")
def sf_dir():
    return SF_DIR


@pytest.fixture(scope="session")
def duck(sf_dir):
    from compare import connect
    return connect(sf_dir)


@pytest.fixture
def frame(spark):
    """``frame("a int, b string", (1, "x"), …)``; timestamps as text are cast."""
    def make(schema, *rows):
        from pyspark.sql import functions as F
        names = [c.split()[0] for c in schema.split(",")]
        kinds = [c.split()[1] for c in schema.split(",")]
        raw = ", ".join(f"{n} {'string' if k == 'timestamp' else k}" for n, k in zip(names, kinds))
        df = spark.createDataFrame(list(rows), raw)
        return df.select([F.col(n).cast(k).alias(n) for n, k in zip(names, kinds)])
    return make
