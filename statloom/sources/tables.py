"""Readers of exported telemetry tables and event documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from statloom.contracts import check


def read_table(spark: SparkSession, path: str, contract: str | None = None) -> DataFrame:
    """A Parquet export, checked against a contract of ``statloom.contracts`` when one is named."""
    df = spark.read.parquet(path)
    return check(df, contract) if contract else df


def read_event_documents(spark: SparkSession, path: str) -> DataFrame:
    """Exported event documents, one XML document per line, as column ``event_xml``."""
    return spark.read.text(path).select(F.col("value").alias("event_xml"))


def stream_table(spark: SparkSession, path: str, like: DataFrame, files_per_batch: int | None = None) -> DataFrame:
    """A stream of the Parquet files arriving in ``path``, with the schema of ``like``."""
    reader = spark.readStream.schema(like.schema)
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    return reader.parquet(path)


def stream_event_documents(spark: SparkSession, path: str, files_per_batch: int | None = None) -> DataFrame:
    """A stream of event documents, one per line of the text files arriving in ``path``."""
    reader = spark.readStream
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    return reader.text(path).select(F.col("value").alias("event_xml"))
