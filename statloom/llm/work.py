"""Intermediate tables in the folder that the cluster shares, and this package on the executors."""

from __future__ import annotations

import importlib.util
import shutil
import tempfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

from statloom.sources.shared import shared_dir

_REACHED: set[str] = set()


def reach_executors(spark: SparkSession) -> None:
    """Send this package to the executors unless they can import it already, as ``--py-files`` would.

    The archive is made on the driver, and Spark hands it out; nobody else reads the driver's folder.
    """
    context = spark.sparkContext
    if context.applicationId in _REACHED:
        return
    if not context.parallelize(["statloom"], 1).map(importlib.util.find_spec).map(bool).first():
        package = Path(__file__).resolve().parents[1]
        archive = shutil.make_archive(f"{tempfile.mkdtemp()}/statloom", "zip", package.parent, package.name)
        context.addPyFile(archive)
    _REACHED.add(context.applicationId)


def stored(df: DataFrame, name: str, by: tuple[str, ...] = ()) -> DataFrame:
    """``df`` written to the shared folder and read again: computed once, and safe when executors are lost."""
    path = shared_dir(df.sparkSession, name)
    writer = df.write.partitionBy(*by) if by else df.write
    writer.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
