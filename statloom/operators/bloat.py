"""Bloat estimates for B-tree indexes and tables from planner statistics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from statloom.contracts import DATABASE, check
from statloom.functions import size_pretty

# Sizes in bytes of the on-disk page and tuple layout.
PAGE_HEADER = 24
INDEX_SPECIAL = 16
ITEM_POINTER = 4
INDEX_TUPLE_HEADER = 2
INDEX_NULL_BITMAP = 4
TABLE_PAGE_HEADER = 20
UNKNOWN_WIDTH = 1024

OWNER = (*DATABASE, "schemaname")


def pad(size: Column, alignment: int) -> Column:
    """Bytes from ``size`` up to the next multiple of ``alignment``; 0 when it is one already."""
    return F.pmod(F.lit(alignment) - F.pmod(size, F.lit(alignment)), F.lit(alignment))


def index_bloat(
    index_pages: DataFrame, column_stats: DataFrame, block_size: int = 8192, alignment: int = 8,
) -> DataFrame:
    """Real, estimated and wasted bytes of every B-tree index of ordinary tables.

    ``index_pages.key_columns`` is the space-separated key vector. A key column takes its statistics from the table
    or, for an expression, from the index under its own name; the two cases are one equi-join because the
    statistics are looked up under either owner. Key columns without statistics do not count; an index without any
    is left out. Tables whose name starts with ``pg_`` are left out.
    """
    check(index_pages, "index_pages")
    check(column_stats, "column_stats")
    index = [*OWNER, "tablename", "indexname"]
    kept = index_pages.filter(
        (F.col("access_method") == "btree") & (F.col("relkind") == "r") & (F.col("relpages") > 0)
        & ~F.startswith(F.col("tablename"), F.lit("pg_")))
    stats = column_stats.select(*OWNER, F.col("tablename").alias("_owner"), "attname", "null_frac", "avg_width",
                                "type_name")
    owners = F.explode(F.array("tablename", "indexname"))
    keys = (kept.select(*index, F.posexplode(F.split("key_columns", " ")).alias("_position", "attname"))
            .withColumn("_owner", owners))
    null_frac = F.coalesce("null_frac", F.lit(0.0))
    width = (1 - null_frac) * F.coalesce("avg_width", F.lit(UNKNOWN_WIDTH))
    rows = (keys.join(stats, [*OWNER, "_owner", "attname"]).groupBy(*index)
            .agg(F.max(null_frac).alias("_nullable"), F.sum(width).alias("_width"),
                 (F.max(F.when(F.col("type_name") == "name", 1).otherwise(0)) > 0).alias("is_na")))

    header = F.when(F.col("_nullable") == 0, INDEX_TUPLE_HEADER).otherwise(INDEX_TUPLE_HEADER + INDEX_NULL_BITMAP)
    # An index whose columns are all NULL gets a full unit of padding, not none.
    data_padding = F.when(F.col("_width") == 0, alignment).otherwise(
        pad(F.rint("_width").cast("bigint"), alignment))
    tuple_width = header + pad(header, alignment) + F.col("_width") + data_padding
    per_page = F.floor(F.lit(float(block_size - INDEX_SPECIAL - PAGE_HEADER)) / (ITEM_POINTER + tuple_width))
    estimated_pages = F.coalesce(
        1 + F.ceil(F.col("reltuples") / F.nullif(per_page, F.lit(0)).cast("double")), F.lit(0))
    pages, wasted = F.col("relpages"), F.col("relpages") - F.col("_pages")
    return (kept.join(rows, index)
            .withColumn("_pages", estimated_pages.cast("bigint"))
            .select(*index, (block_size * pages).cast("bigint").alias("real_bytes"),
                    (block_size * F.col("_pages")).alias("estimated_bytes"),
                    (block_size * wasted).alias("bloat_bytes"),
                    size_pretty(block_size * pages).alias("real_size"),
                    size_pretty(block_size * F.col("_pages")).alias("estimated_size"),
                    size_pretty(block_size * wasted).alias("bloat_size"),
                    F.round(wasted.cast("decimal(18,0)") * 100 / pages.cast("decimal(18,0)"), 1)
                    .cast("decimal(20,1)").alias("bloat_ratio"), "is_na")
            .orderBy(*index))


def table_bloat(
    column_stats: DataFrame, table_pages: DataFrame, index_pages: DataFrame,
    block_size: int = 8192, header: int = 23, alignment: int = 4,
) -> DataFrame:
    """Real against estimated pages of tables and of each of their indexes, worst first.

    Kept when the table wastes any page or an index more than ten. A table without indexes keeps one row with index
    name ``?`` and zeros. The count of nullable columns comes from the same aggregation as the widths.
    """
    check(column_stats, "column_stats")
    check(table_pages, "table_pages")
    check(index_pages, "index_pages")
    table = [*OWNER, "tablename"]
    widths = column_stats.groupBy(*table).agg(
        F.sum((1 - F.col("null_frac")) * F.col("avg_width")).alias("_width"),
        F.max("null_frac").alias("_max_null"),
        F.count_if(F.col("null_frac") != 0).alias("_nullable"))

    null_header = header + 1 + F.floor(F.col("_nullable") / 8)
    data_header = F.col("_width") + header + pad(F.lit(header), alignment)
    null_part = F.col("_max_null") * (null_header + pad(null_header, alignment))
    row_width = data_header + pad(data_header, alignment) + null_part + ITEM_POINTER
    usable = F.lit(float(block_size - TABLE_PAGE_HEADER))

    indexes = index_pages.select(*table, F.col("indexname").alias("_iname"), F.col("reltuples").alias("_ituples"),
                                 F.col("relpages").alias("_ipages"))
    pages, otta = F.col("relpages"), F.col("otta")
    ipages, iotta = F.col("ipages"), F.col("iotta")

    def factor(real: Column, estimate: Column) -> Column:
        # Both are page counts, so the ratio is rounded from exact decimals.
        exact = F.round(real.cast("decimal(18,0)") / F.nullif(estimate, F.lit(0)).cast("decimal(18,0)"), 1)
        return F.coalesce(exact, F.lit(0)).cast("decimal(20,1)")

    wasted = pages - otta
    index_waste = F.greatest(ipages - iotta, F.lit(0))
    return (table_pages.select(*table, "reltuples", "relpages")
            .join(widths, table)
            .withColumn("otta", F.ceil(F.col("reltuples") * row_width / usable))
            .withColumn("_data_header", data_header)
            .join(indexes, table, "left")
            .withColumns({
                "iname": F.coalesce("_iname", F.lit("?")),
                "ituples": F.coalesce(F.col("_ituples").cast("bigint"), F.lit(0)),
                "ipages": F.coalesce(F.col("_ipages").cast("bigint"), F.lit(0)),
                "iotta": F.coalesce(F.ceil(F.col("_ituples") * (F.col("_data_header") - 12) / usable), F.lit(0)),
            })
            .filter((wasted > 0) | (ipages - iotta > 10))
            .select(*table, F.col("reltuples").cast("bigint").alias("reltuples"),
                    pages.cast("bigint").alias("relpages"), "otta", factor(pages, otta).alias("tbloat"),
                    wasted.alias("wasted_pages"), (block_size * wasted).alias("wasted_bytes"),
                    size_pretty(block_size * wasted).alias("wasted_size"),
                    "iname", "ituples", "ipages", "iotta",
                    F.when(ipages == 0, F.lit(0)).otherwise(factor(ipages, iotta)).cast("decimal(20,1)").alias("ibloat"),
                    index_waste.alias("wasted_ipages"), (block_size * index_waste).alias("wasted_ibytes"),
                    size_pretty(block_size * index_waste).alias("wasted_isize"))
            .orderBy(F.col("wasted_bytes").desc(), F.col("wasted_ibytes").desc(), *table, "iname"))
