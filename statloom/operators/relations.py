"""Sizes and row counts of relations and databases."""

from __future__ import annotations

from collections.abc import Mapping
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from statloom.contracts import DATABASE, check
from statloom.functions import size_pretty
from statloom.plans.ranking import top_n

# Schemas that belong to the system.
SYSTEM_SCHEMAS = ("pg_catalog", "information_schema")


def relation_disk_usage(relations: DataFrame, n: int = 30) -> DataFrame:
    """The ``n`` largest user relations of every database."""
    check(relations, "relations")
    user = relations.filter(~F.col("nspname").isin(*SYSTEM_SCHEMAS))
    top = top_n(user, n, [F.col("relation_bytes").desc_nulls_last(), F.col("nspname"), F.col("relname")], per=DATABASE)
    return top.select(*DATABASE, "nspname", "relname", "relation_bytes",
                      size_pretty(F.col("relation_bytes")).alias("size"))


def relation_size_split(relations: DataFrame, n: int = 10) -> DataFrame:
    """The ``n`` largest relations of every database by total size, split into relation and the rest (indexes)."""
    check(relations, "relations")
    total, main = F.col("total_bytes"), F.col("relation_bytes")
    top = top_n(relations, n, [total.desc_nulls_last(), F.col("nspname"), F.col("relname")], per=DATABASE)
    return top.select(*DATABASE, "nspname", "relname", "relkind", "total_bytes",
                      size_pretty(total).alias("total_size"), size_pretty(main).alias("relation_size"),
                      size_pretty(total - main).alias("index_size"))


def tablespace_sizes(tablespaces: DataFrame) -> DataFrame:
    """Tablespaces with their place, the largest of each server first; by bytes, not by the printed size."""
    check(tablespaces, "tablespaces")
    return (tablespaces.select("server_name", "spcname", "location", "size_bytes",
                               size_pretty(F.col("size_bytes")).alias("size"))
            .orderBy("server_name", F.col("size_bytes").desc_nulls_last(), "spcname"))


def schema_privileges(namespaces: DataFrame) -> DataFrame:
    """Schemas with owner and privileges, one privilege in a line; system schemas are left out.

    A schema without an entry has no privileges (NULL), as in the catalog; NULL entries of a list are left out.
    """
    check(namespaces, "namespaces")
    user = namespaces.filter(~F.col("nspname").startswith("pg_") & (F.col("nspname") != "information_schema"))
    return (user.select(*DATABASE, F.col("nspname").alias("name"), "owner",
                        F.array_join("nspacl", "\n").alias("access_privileges"), "description")
            .orderBy(*DATABASE, "name"))


def database_size(database_sizes: DataFrame) -> DataFrame:
    """All databases, largest first."""
    check(database_sizes, "database_sizes")
    return (database_sizes.select(*DATABASE, "database_bytes", size_pretty(F.col("database_bytes")).alias("size"))
            .orderBy(F.col("database_bytes").desc_nulls_last(), *DATABASE))


def pretty_sizes(relations: DataFrame) -> DataFrame:
    """Every relation with its sizes as text: the ``size_pretty`` column function applied to a table."""
    check(relations, "relations")
    return relations.select(*DATABASE, "relname", "relation_bytes", "total_bytes",
                            size_pretty(F.col("relation_bytes")).alias("relation_size"),
                            size_pretty(F.col("total_bytes")).alias("total_size"))


def table_row_counts(tables: Mapping[str, DataFrame]) -> DataFrame:
    """Row count of every given table, one row each. Each count is a partial aggregate of its own scan."""
    if not tables:
        raise ValueError("table_row_counts needs at least one table")
    counts = [df.agg(F.count(F.lit(1)).alias("nb_tuples")).select(F.lit(name).alias("tablename"), "nb_tuples")
              for name, df in tables.items()]
    return reduce(DataFrame.unionByName, counts)

