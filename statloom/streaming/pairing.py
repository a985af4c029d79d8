"""Pair a stream of snapshots with the immediately preceding snapshot of each key, by keyed state.

The state is the last snapshot of every key. Keys are dealt into buckets, each with a map from key to snapshot, so that
the Python step works on many rows per call and still touches only the keys of those rows. The step only looks back;
deltas and predicates are the column expressions of the batch operators, applied afterwards inside the JVM.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from statloom.plans.snapshots import previous_name
from statloom.streaming.lookback import BETWEEN, BUCKET, KEY, NONE, LookBack

BUCKETS = 256
PACKED = "packed"
_IN_KEY = ("string", "tinyint", "smallint", "int", "bigint")  # types that the text of a key gives back as they were


def _bucket(key: Column, buckets: int) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(buckets)).alias(BUCKET)


def known_snapshots(spark: SparkSession, checkpoint: str) -> DataFrame:
    """The last snapshot of every key that a stopped stream remembers, for ``pair_stream(known=)``.

    One row per key, read from the state of the stream at ``checkpoint``.
    """
    state = (spark.read.format("statestore").option("path", checkpoint).option("stateVarName", "last").load())
    return state.select(F.col(f"user_map_key.{KEY}").alias(KEY), "user_map_value.*")


def pair_stream(
    snapshots: DataFrame, scope: Sequence[str], keys: Sequence[str], counters: Sequence[str],
    at: str = "collect_date", buckets: int = BUCKETS, forget_ms: int | None = None, known: DataFrame | None = None,
) -> DataFrame:
    """Stream of ``snapshots`` rows with ``status`` and ``prev_<counter>`` columns.

    ``snapshots`` carries ``snapshot_no``, the running number of the poll on its server, stamped by whoever polls.
    A row is ``paired`` only if the key's last seen number is exactly one less; ``first`` marks a first appearance
    or a gap; ``late`` marks a number not above the last one, which changes no state and can be counted.

    Keys are hashed to ``buckets``, which spreads a large server over all of them. Choose several per core of the
    cluster and keep the number for the life of the checkpoint; to change it, start a new checkpoint with ``known``, the
    ``known_snapshots`` of the old one. Keys without a row for ``forget_ms`` of processing time leave the state; choose
    many polls' time, as a row after that is ``first`` even where it is late, and run the stream with a processing-time
    trigger, as Spark never ends an available-now run of a query that looks at that time. The session needs the state store named in
    ``statloom.session.SETTINGS``. A NULL key is a key like any other.
    """
    group = [*scope, *keys]
    key = F.to_json(F.struct(*group), {"ignoreNullFields": "false"})
    types = {f.name: f.dataType.simpleString() for f in snapshots.schema.fields}
    apart = [k for k in group if types[k] not in _IN_KEY]
    at_micros = F.unix_micros(F.col(at).cast("timestamp"))
    values = [*[F.col(c) for c in counters], at_micros, *[F.col(k) for k in apart]]
    flat = snapshots.select(
        _bucket(key, buckets), key.alias(KEY), F.col("snapshot_no").cast("bigint"),
        F.concat_ws(BETWEEN, *[F.coalesce(v.cast("string"), F.lit(NONE)) for v in values]).alias(PACKED))
    kinds = {f.name: f.dataType.simpleString() for f in flat.schema.fields}
    output = ", ".join([*[f"{c} {kinds[c]}" for c in flat.columns], "status string", f"{previous_name(PACKED)} string"])
    remembered = None
    if known is not None:
        remembered = known.select(_bucket(F.col(KEY), buckets), KEY, F.col("snapshot_no").cast("bigint"),
                                  *[F.col(c).cast("string") for c in counters]).groupBy(BUCKET)
    looked_back = flat.groupBy(BUCKET).transformWithStateInPandas(
        LookBack(counters, forget_ms, PACKED), outputStructType=output, outputMode="Append",
        timeMode="None" if forget_ms is None else "ProcessingTime", initialState=remembered)
    parts = looked_back.select(
        F.from_json(KEY, ", ".join(f"`{k}` string" for k in group)).alias(KEY), "snapshot_no", "status",
        F.split(PACKED, BETWEEN).alias(PACKED), F.split(previous_name(PACKED), BETWEEN).alias(previous_name(PACKED)))

    def value(number: int, kind: str, packed: str = PACKED) -> Column:
        return F.nullif(F.col(packed)[number], F.lit(NONE)).cast(kind)

    place = {k: len(counters) + 1 + n for n, k in enumerate(apart)}
    return parts.select(
        *[(value(place[k], types[k]) if k in place else F.col(KEY)[k].cast(types[k])).alias(k) for k in group],
        F.timestamp_micros(value(len(counters), "bigint")).alias(at), "snapshot_no", "status",
        *[value(n, "bigint").alias(c) for n, c in enumerate(counters)],
        *[value(n, "bigint", previous_name(PACKED)).alias(previous_name(c)) for n, c in enumerate(counters)])
