"""Table and file sizes from the storage catalogs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from statloom.contracts import DATABASE, TABLE, check
from statloom.functions import like_any_case, pages_to_mb, percent, whole_div

# Internal table types whose pages count towards their table.
COUNTED_INTERNAL_TYPES = (202, 204, 211, 212, 213, 214, 215, 216)
BIG_TABLE_MB = 100_000
NEAR_LIMIT_MB = 102_400
NEAR_LIMIT_RATIO = 0.8


def biggest_tables(
    tables: DataFrame, partitions: DataFrame, allocation_units: DataFrame, min_mb: int = BIG_TABLE_MB,
) -> DataFrame:
    """Tables whose allocation exceeds ``min_mb`` with row, partition and size figures, biggest first.

    ``nb_partition`` counts allocation units, as the original query does. Allocation units are summed per partition
    and partitions per table before anything is joined, so the joins carry one row per partition and table.
    """
    check(tables, "tables")
    check(partitions, "partitions")
    check(allocation_units, "allocation_units")
    units = (allocation_units.groupBy(*DATABASE, F.col("container_id").alias("hobt_id"))
             .agg(F.sum("total_pages").alias("_total"), F.sum("used_pages").alias("_used"),
                  F.count(F.lit(1)).alias("_units")))
    per_object = (partitions.select(*TABLE, "hobt_id", "rows").join(units, [*DATABASE, "hobt_id"])
                  .groupBy(*TABLE)
                  .agg(F.max("rows").alias("_rows"), F.sum("_units").alias("_units"),
                       F.sum("_total").alias("_total"), F.sum("_used").alias("_used")))
    per_name = (tables.select(*TABLE, "name").join(per_object, list(TABLE))
                .groupBy(*DATABASE, F.col("name").alias("table_name"))
                .agg(F.max("_rows").alias("nb_rows"), F.sum("_units").alias("nb_partition"),
                     F.sum("_total").alias("_total"), F.sum("_used").alias("_used")))
    return (per_name.select(*DATABASE, "table_name", "nb_rows", "nb_partition",
                            pages_to_mb(F.col("_total")).alias("size_mb"),
                            pages_to_mb(F.col("_used")).alias("data_size_mb"),
                            pages_to_mb(F.col("_total") - F.col("_used")).alias("non_data_size_mb"))
            .filter(F.col("size_mb") > min_mb)
            .orderBy(F.col("size_mb").desc(), *DATABASE, "table_name"))


def _table_pages(partition_stats: DataFrame, internal_tables: DataFrame, tables: DataFrame) -> DataFrame:
    """Per table: row count and reserved, data, index and unused megabytes."""
    check(partition_stats, "partition_stats")
    check(internal_tables, "internal_tables")
    check(tables, "tables")
    base = F.col("index_id") < 2
    outside_row = F.col("lob_used_page_count") + F.col("row_overflow_used_page_count")
    per_table = partition_stats.groupBy(*TABLE).agg(
        F.sum("reserved_page_count").alias("_reserved"),
        F.sum("used_page_count").alias("_used"),
        F.sum(F.when(base, F.col("in_row_data_page_count") + outside_row).otherwise(outside_row)).alias("_data"),
        F.sum(F.when(base, F.col("row_count")).otherwise(F.lit(0))).alias("row_count"))
    # The pages of an internal table are its own partitions: count its catalog rows of the right types once and
    # multiply, instead of summing the partitions a second time.
    internal = (internal_tables.filter(F.col("internal_type").isin(*COUNTED_INTERNAL_TYPES))
                .groupBy(*TABLE).agg(F.count(F.lit(1)).alias("_extra")))
    copies = 1 + F.coalesce("_extra", F.lit(0))
    data = F.col("_data")
    reserved, used = F.col("_reserved") * copies, F.col("_used") * copies
    return (per_table.join(internal, list(TABLE), "left")
            .join(tables.select(*TABLE, F.concat_ws(".", "schema_name", "name").alias("table_name")), list(TABLE))
            .select(*TABLE, "table_name", "row_count",
                    pages_to_mb(reserved).alias("reserved_mb"), pages_to_mb(data).alias("data_mb"),
                    pages_to_mb(F.greatest(used - data, F.lit(0))).alias("index_mb"),
                    pages_to_mb(F.greatest(reserved - used, F.lit(0))).alias("unused_mb")))


def table_size(partition_stats: DataFrame, internal_tables: DataFrame, tables: DataFrame) -> DataFrame:
    """Reserved, data, index and unused megabytes and the row count of every table.

    Unused is reserved minus used with the internal-table pages on both sides; the original query adds the internal
    used pages where they have to be subtracted.
    """
    return _table_pages(partition_stats, internal_tables, tables).drop("object_id")


def table_size_limit(
    partition_stats: DataFrame, internal_tables: DataFrame, tables: DataFrame, columns: DataFrame,
    min_mb: int = NEAR_LIMIT_MB,
) -> DataFrame:
    """Tables above ``min_mb`` with the size they would have if every row were as wide as its columns allow.

    ``near_estimate``: reserved is more than 0.8 of the estimate, compared as a real ratio (the original query
    divides integers, so it fires only from 1 on). ``over_estimate``: data is larger than the estimate. Columns
    without a length limit (``max_length`` −1) are left out of the row width instead of lowering it. A flag is
    NULL where the comparison cannot be made.
    """
    check(columns, "columns")
    widths = (columns.filter(F.col("max_length") >= 0).groupBy(*TABLE)
              .agg(F.sum("max_length").cast("bigint").alias("max_row_size_bytes")))
    user_tables = tables.filter(F.col("is_ms_shipped").cast("int") == 0)
    estimate = F.col("estimated_mb")
    return (_table_pages(partition_stats, internal_tables, user_tables)
            .filter(F.col("reserved_mb") > min_mb)
            .join(widths, list(TABLE))
            .withColumn("estimated_mb",
                        whole_div(whole_div(F.col("max_row_size_bytes") * F.col("row_count"), 1024), 1024))
            .select(*DATABASE, "table_name", "row_count", "reserved_mb", "data_mb", "max_row_size_bytes",
                    "estimated_mb", "index_mb", "unused_mb",
                    F.when(estimate > 0, F.col("reserved_mb").cast("double") / F.nullif(estimate, F.lit(0))
                           > NEAR_LIMIT_RATIO).alias("near_estimate"),
                    (F.col("data_mb") > estimate).alias("over_estimate"))
            .orderBy(F.col("data_mb").desc(), *DATABASE, "table_name"))


def _drive(path: Column) -> Column:
    return F.left(path, F.lit(1))


def file_space(files: DataFrame, drive: str | None = None, database: str | None = None) -> DataFrame:
    """Size, used and free megabytes of database files, of one drive, one database, or all.

    Percentages are decimal and NULL for a file of size 0.
    """
    check(files, "file_sizes")
    rows = files
    if database is not None:
        rows = rows.filter(F.col("database_name") == database)
    if drive is not None:
        rows = rows.filter(like_any_case(_drive(F.col("physical_name")), drive))
    size, used = F.col("size_pages"), F.col("used_pages")
    return (rows.select("server_name", "database_name", "file_name", _drive(F.col("physical_name")).alias("drive"),
                        pages_to_mb(size).alias("size_mb"), pages_to_mb(used).alias("space_used_mb"),
                        pages_to_mb(size - used).alias("free_mb"))
            .withColumns({
                "percent_space_used": percent(F.col("space_used_mb"), F.col("size_mb"), 2).cast("decimal(10,2)"),
                "percent_free": percent(F.col("free_mb"), F.col("size_mb"), 2).cast("decimal(5,2)")})
            .orderBy(F.col("free_mb").desc_nulls_last(), "server_name", "database_name", "file_name"))
