"""Column catalog reports."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from statloom.contracts import DATABASE, TABLE, check
from statloom.functions import like_any_case
from statloom.functions.text import in_any_case

TYPE_KEY = ("system_type_id", "user_type_id")
# The types a column type search leaves out.
ORDINARY_TYPES = ("int", "bigint", "varchar", "nvarchar", "bit")


def type_names(types: DataFrame) -> DataFrame:
    """Type names keyed by both ids, so that an alias type never duplicates its base type's columns."""
    check(types, "types")
    return types.select(*TYPE_KEY, F.col("name").alias("type_name"))


def table_columns(
    columns: DataFrame, types: DataFrame, tables: DataFrame, table: str | None = None,
) -> DataFrame:
    """Columns of one table (``schema.name``) or of all tables, with their types, in column order."""
    check(columns, "columns")
    check(tables, "tables")
    names = tables.select(*TABLE, F.concat_ws(".", "schema_name", "name").alias("table_name"))
    if table is not None:
        names = names.filter(F.lower("table_name") == table.lower())
    return (columns.withColumnRenamed("name", "column_name")
            .join(names, list(TABLE))
            .join(type_names(types), list(TYPE_KEY))
            .select(*DATABASE, "table_name", "column_name", "column_id", "type_name", "max_length", "precision",
                    "scale", "collation_name", "is_nullable", "is_identity")
            .orderBy(*DATABASE, "table_name", "column_id"))


def column_type_search(
    columns: DataFrame, types: DataFrame, tables: DataFrame, pattern: str = "%",
    ordinary: Sequence[str] = ORDINARY_TYPES,
) -> DataFrame:
    """Columns of unusual types in the tables whose name is LIKE ``pattern``."""
    check(columns, "columns")
    check(tables, "tables")
    names = (tables.filter(like_any_case(F.col("name"), pattern))
             .select(*TABLE, F.col("name").alias("table_name")))
    unusual = type_names(types).filter(~in_any_case(F.col("type_name"), ordinary))
    return (columns.withColumnRenamed("name", "column_name")
            .join(unusual, list(TYPE_KEY))
            .join(names, list(TABLE))
            .select(*DATABASE, "table_name", "column_name", "column_id", "is_nullable", "is_identity", "type_name",
                    "max_length")
            .orderBy(*DATABASE, "table_name", "column_id"))
