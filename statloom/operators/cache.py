"""Buffer-cache residency. The input is one row per cached 8 KiB page, by far the largest table here.

Every report first counts pages per (server, database, relation) and joins the catalogs to the counts, so the page
rows are only ever partially aggregated in the scan. A relation, database or server that owns a large part of all
pages therefore reaches the shuffle as one partial count per task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from statloom.contracts import DATABASE, SERVER, check
from statloom.functions import percent, size_pretty
from statloom.plans.ranking import top_n

PAGE_BYTES = 8192
RELATION = (*DATABASE, "relfilenode")


def _relation_pages(pages: DataFrame, *more: str) -> DataFrame:
    check(pages, "buffer_pages")
    return pages.groupBy(*RELATION, *more).agg(F.count(F.lit(1)).alias("buffers"))


def _with_settings(df: DataFrame, shared_buffers: int | DataFrame) -> DataFrame:
    """Add the cache size in pages: one number for the fleet, or a table ``(server_name, shared_buffers)``."""
    if isinstance(shared_buffers, DataFrame):
        return df.join(shared_buffers.select(*SERVER, F.col("shared_buffers").alias("_cache")), list(SERVER))
    return df.withColumn("_cache", F.lit(int(shared_buffers)))


def _buffered() -> Column:
    return F.col("buffers") * PAGE_BYTES


def _sizes() -> dict[str, Column]:
    return {"buffered_bytes": _buffered(), "buffered": size_pretty(_buffered()),
            "buffers_percent": percent(F.col("buffers"), F.col("_cache"), 1)}


def _biggest(df: DataFrame, n: int, names: tuple[str, ...]) -> DataFrame:
    """The ``n`` relations of every database with the most pages; byte counts decide, not their printed form."""
    return top_n(df, n, [F.col("buffered_bytes").desc(), *[F.col(c) for c in names]], per=DATABASE)


def cache_by_relation(
    pages: DataFrame, relations: DataFrame, shared_buffers: int | DataFrame, n: int = 10,
    nonempty_only: bool = False,
) -> DataFrame:
    """The ``n`` most cached relations of every database: bytes, share of the cache, share of the relation.

    By default the relation's size is its table size (``table_bytes``, with auxiliary forks, when given).
    ``nonempty_only=True`` is the second variant: main-fork size, with the schema, relations of size 0 left out.
    """
    check(relations, "relations")
    size = "relation_bytes" if nonempty_only or "table_bytes" not in relations.columns else "table_bytes"
    known = relations.select(*RELATION, "nspname", "relname", F.col(size).alias("_size"))
    if nonempty_only:
        known = known.filter(F.col("_size") > 0)
    counted = _with_settings(_relation_pages(pages).join(known, list(RELATION)), shared_buffers)
    report = counted.select(*RELATION, "nspname", "relname", *[c.alias(a) for a, c in _sizes().items()],
                            percent(_buffered(), F.col("_size"), 1).alias("percent_of_relation"))
    top = _biggest(report, n, ("relname", "relfilenode")).drop("relfilenode")
    return top if nonempty_only else top.drop("nspname")


def cache_usage_count(pages: DataFrame, relations: DataFrame) -> DataFrame:
    """Buffers per relation and usage count. Relations of one name are added up."""
    names = relations.select(*RELATION, "relname")
    return (_relation_pages(pages, "usagecount").join(names, list(RELATION))
            .groupBy(*DATABASE, "relname", "usagecount").agg(F.sum("buffers").alias("buffers"))
            .orderBy(*DATABASE, "relname", "usagecount"))


def cache_top_relations(pages: DataFrame, relations: DataFrame, n: int = 20) -> DataFrame:
    """The ``n`` relation names of every database with the most buffers."""
    names = relations.select(*RELATION, "relname")
    counted = (_relation_pages(pages).join(names, list(RELATION))
               .groupBy(*DATABASE, "relname").agg(F.sum("buffers").alias("buffers")))
    return top_n(counted, n, [F.col("buffers").desc(), F.col("relname")], per=DATABASE)


def cache_usage_dirty(pages: DataFrame) -> DataFrame:
    """Buffers per server, usage count and dirty flag, unused buffers included."""
    check(pages, "buffer_pages")
    return (pages.groupBy(*SERVER, "usagecount", "isdirty").agg(F.count(F.lit(1)).alias("buffers"))
            .orderBy(*SERVER, F.col("usagecount").asc_nulls_last(), F.col("isdirty").asc_nulls_last()))


def _database_pages(pages: DataFrame) -> DataFrame:
    check(pages, "buffer_pages")
    return pages.groupBy(*DATABASE).agg(F.count(F.lit(1)).alias("buffers"))


def cache_by_database(pages: DataFrame, shared_buffers: int | DataFrame) -> DataFrame:
    """Bytes and share of the cache per database; unused buffers form a row with a NULL database."""
    return (_with_settings(_database_pages(pages), shared_buffers)
            .select(*DATABASE, *[c.alias(a) for a, c in _sizes().items()])
            .orderBy("server_name", F.col("buffers_percent").desc(), F.col("database_name").asc_nulls_last()))


def cache_by_database_ratio(
    pages: DataFrame, database_sizes: DataFrame, shared_buffers: int | DataFrame,
) -> DataFrame:
    """The same with the size of each database and how much of it is cached."""
    check(database_sizes, "database_sizes")
    sizes = database_sizes.select(*DATABASE, "database_bytes")
    return (_with_settings(_database_pages(pages).join(sizes, list(DATABASE), "left"), shared_buffers)
            .select(*DATABASE, *[c.alias(a) for a, c in _sizes().items()], "database_bytes",
                    size_pretty(F.col("database_bytes")).alias("database_size"),
                    percent(_buffered(), F.col("database_bytes"), 1).alias("percent_database_in_cache"))
            .orderBy("server_name", F.col("buffers_percent").desc(), F.col("database_name").asc_nulls_last()))


def _share(pages: DataFrame, relations: DataFrame, database_sizes: DataFrame, shared_buffers, n: int,
           surviving_only: bool) -> DataFrame:
    check(relations, "relations")
    check(database_sizes, "database_sizes")
    known = (relations.filter(F.col("relation_bytes") > 0)
             .select(*RELATION, "nspname", "relname", "relation_bytes"))
    surviving = _relation_pages(pages).join(known, list(RELATION))
    # Counting pages per database once more reads two columns and shuffles one row per task and database.
    totals = (surviving.groupBy(*DATABASE).agg(F.sum("buffers").alias("_database_buffers")) if surviving_only
              else _database_pages(pages).withColumnRenamed("buffers", "_database_buffers"))
    joined = (surviving.join(totals, list(DATABASE))
              .join(database_sizes.select(*DATABASE, "database_bytes"), list(DATABASE), "left"))
    report = _with_settings(joined, shared_buffers).select(
        *RELATION, "nspname", "relname", *[c.alias(a) for a, c in _sizes().items()],
        percent(_buffered(), F.col("relation_bytes"), 1).alias("percent_of_relation"),
        percent(_buffered(), F.col("database_bytes"), 1).alias("percent_of_total_database_size"),
        percent(F.col("buffers"), F.col("_database_buffers"), 1).alias("percent_database_in_cache"))
    return _biggest(report, n, ("nspname", "relname", "relfilenode")).drop("relfilenode")


def cache_share_total(
    pages: DataFrame, relations: DataFrame, database_sizes: DataFrame, shared_buffers: int | DataFrame, n: int = 10,
) -> DataFrame:
    """Top relations with their share of *all* cached pages of the database.

    Pages of relations missing from the catalog or of size 0 count in the denominator.
    """
    return _share(pages, relations, database_sizes, shared_buffers, n, surviving_only=False)


def cache_share_window(
    pages: DataFrame, relations: DataFrame, database_sizes: DataFrame, shared_buffers: int | DataFrame, n: int = 10,
) -> DataFrame:
    """Top relations with their share of the cached pages of all *reported* relations of the database.

    The denominator is what survives the catalog join and the size filter, before the limit. It is the sum over the
    counts joined back, which equals a window over the whole database without gathering a database in one task.
    """
    return _share(pages, relations, database_sizes, shared_buffers, n, surviving_only=True)
