"""Run registered queries in Spark and in DuckDB on the same folder and compare rows, names and types."""

from __future__ import annotations

import datetime as dt
import math
from collections import Counter

import duckdb

from statloom.fixtures.adapters import BASE_TABLES

KINDS = {"byte": "int", "smallint": "int", "int": "int", "bigint": "int", "double": "float", "string": "text",
         "boolean": "bool", "timestamp": "time", "timestamp_ntz": "time", "date": "date",
         "TINYINT": "int", "SMALLINT": "int", "INTEGER": "int", "BIGINT": "int", "DOUBLE": "float",
         "VARCHAR": "text", "BOOLEAN": "bool", "TIMESTAMP": "time", "DATE": "date"}


def connect(sf_dir: str):
    con = duckdb.connect()
    for name in BASE_TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{sf_dir}/{name}.parquet')")
    return con


def _canonical(value):
    if isinstance(value, float):
        return "nan" if math.isnan(value) else float(f"{value:.12g}")
    if isinstance(value, dt.datetime):
        return value.replace(tzinfo=None)
    return value


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda n: columns[n])
    return Counter(tuple(_canonical(r[n]) for n in order) for r in rows)


def compare(spark, con, sf_dir, query, sql):
    """None when equal, else a short description of the first differences."""
    df = query(spark, sf_dir)
    got = rows_of(df.columns, df.collect())
    cursor = con.execute(sql)
    described = [(d[0], str(d[1])) for d in cursor.description]
    want = rows_of([d[0] for d in described], cursor.fetchall())
    if sorted(df.columns) != sorted(d[0] for d in described):
        return f"columns {sorted(set(df.columns) ^ {d[0] for d in described})}"
    spark_types = {f.name: f.dataType.simpleString() for f in df.schema.fields}
    types = {n: (spark_types[n], t) for n, t in described
             if KINDS.get(spark_types[n], spark_types[n]) != KINDS.get(t, t)}
    if types:
        return f"types {types}"
    if got != want:
        names = sorted(df.columns)
        extra, missing = list((got - want).items()), list((want - got).items())
        show = "; ".join(f"{k}: {dict(zip(names, r[0][0]))}" for k, r in (("extra", extra), ("missing", missing)) if r)
        return f"rows {sum(got.values())} vs {sum(want.values())}, {len(extra)} extra {len(missing)} missing: {show}"
    return None
