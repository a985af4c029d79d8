"""Spark session settings."""

from __future__ import annotations

from pyspark.sql import SparkSession

STATE_STORE = "spark.sql.streaming.stateStore.providerClass"

# Settings the operators rely on, for any cluster. Broadcasts are left to Spark, which checks the size of a side
# against the threshold (at run time too) and otherwise uses a shuffle join with skewed partitions split.
SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.localShuffleReader.enabled": "true",
    "spark.sql.autoBroadcastJoinThreshold": "32m",
    "spark.sql.adaptive.autoBroadcastJoinThreshold": "64m",
    # Column lists per index are short, so a task may hash some thousand groups before it turns to sorting.
    "spark.sql.objectHashAggregate.sortBased.fallbackThreshold": "4096",
    # Keyed state of the streaming jobs lies on disk.
    STATE_STORE: "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    # A join whose partitions all turn out this small is hashed instead of sorted.
    "spark.sql.adaptive.maxShuffledHashJoinLocalMapThreshold": "64m",
}


def configured(builder: SparkSession.Builder) -> SparkSession.Builder:
    """Apply ``SETTINGS`` to a session builder; size ``spark.sql.shuffle.partitions`` to the cluster yourself."""
    for key, value in SETTINGS.items():
        builder = builder.config(key, value)
    return builder


def local_session(name: str, cpus: int = 8) -> SparkSession:
    """A local session for tests and measurements."""
    builder = (SparkSession.builder.master(f"local[{cpus}]").appName(name)
               .config("spark.ui.enabled", "false")
               .config("spark.driver.memory", "8g")
               .config("spark.sql.shuffle.partitions", str(cpus)))
    spark = configured(builder).getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark
