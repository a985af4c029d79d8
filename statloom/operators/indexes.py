"""Index reports from the catalogs: fingerprints, duplicates, unused indexes, definitions.

Indexes per table and columns per index are bounded by the database engine (at most a thousand of each), which is
what bounds the lists collected here and the pairs of duplicate indexes within one table.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from statloom.contracts import DATABASE, INDEX, TABLE, check
from statloom.functions import like_any_case, pages_to_mb, quote_name
from statloom.operators.columns import TYPE_KEY, type_names

SEPARATOR = ", "
HEAP, CLUSTERED, NONCLUSTERED = 0, 1, 2


def _is(flag: str) -> Column:
    """A bit column, stored as boolean or 0/1, as a boolean."""
    return F.col(flag).cast("boolean")


def _rows(**values: Column) -> Column:
    """Aggregate: the named values of all rows of a group, sorted. Lists of a group are cut from one such array."""
    return F.sort_array(F.collect_list(F.struct(*[value.alias(name) for name, value in values.items()])))


def _listed(rows: str, text: str, wanted: Callable[[Column], Column]) -> Column:
    """``text`` of the wanted entries of the array ``rows``, as one comma-separated string; NULL when there are none."""
    chosen = F.transform(F.filter(F.col(rows), wanted), lambda r: r[text])
    return F.nullif(F.array_join(chosen, SEPARATOR), F.lit(""))


def index_sizes(partitions: DataFrame, allocation_units: DataFrame) -> DataFrame:
    """Allocated megabytes per index. Units are summed per partition before the join."""
    check(partitions, "partitions")
    check(allocation_units, "allocation_units")
    units = (allocation_units.groupBy(*DATABASE, F.col("container_id").alias("hobt_id"))
             .agg(F.sum("total_pages").alias("_pages")))
    return (partitions.select(*INDEX, "hobt_id").join(units, [*DATABASE, "hobt_id"])
            .groupBy(*INDEX).agg(pages_to_mb(F.sum("_pages")).alias("index_size_mb")))


def named_index_columns(index_columns: DataFrame, columns: DataFrame, *attributes: str) -> DataFrame:
    """Index columns with the name, and further attributes, of their table column."""
    check(index_columns, "index_columns")
    check(columns, "columns")
    names = columns.select(*TABLE, "column_id", F.col("name").alias("column_name"), *attributes)
    return index_columns.join(names, [*TABLE, "column_id"])


def column_lists(index_columns: DataFrame, columns: DataFrame) -> DataFrame:
    """Per index the ordered column lists: all, key columns only, included columns only. One aggregation."""
    grouped = named_index_columns(index_columns, columns).groupBy(*INDEX).agg(
        _rows(at=F.col("index_column_id"), name=F.col("column_name"), included=_is("is_included_column"),
              column_id=F.col("column_id")).alias("_columns"))
    return grouped.select(
        *INDEX,
        _listed("_columns", "name", lambda r: F.lit(True)).alias("columns_all"),
        _listed("_columns", "name", lambda r: ~r["included"]).alias("columns_key"),
        _listed("_columns", "name", lambda r: r["included"]).alias("columns_included"),
        F.col("_columns.column_id").alias("column_ids"))


def _user_indexes(indexes: DataFrame, tables: DataFrame) -> DataFrame:
    check(indexes, "indexes")
    check(tables, "tables")
    owners = (tables.filter(~_is("is_ms_shipped"))
              .select(*TABLE, "schema_name", F.col("name").alias("table_name")))
    return indexes.withColumnRenamed("name", "index_name").join(owners, list(TABLE))


def index_fingerprint(
    indexes: DataFrame, index_columns: DataFrame, columns: DataFrame, tables: DataFrame,
    partitions: DataFrame, allocation_units: DataFrame, column_ids: bool = False,
) -> DataFrame:
    """Every index of a user table with its three column lists, flags and size in megabytes.

    ``column_ids`` adds the ids of all columns in order, an array, which ``duplicate_indexes`` compares in prefix mode.
    """
    return (_user_indexes(indexes, tables)
            .join(index_sizes(partitions, allocation_units), list(INDEX))
            .join(column_lists(index_columns, columns), list(INDEX), "left")
            .select(*INDEX, "schema_name", "table_name", "index_name", "type_desc", "is_unique", "is_primary_key",
                    "is_unique_constraint", "columns_all", "columns_key", "columns_included", "index_size_mb",
                    *(["column_ids"] if column_ids else [])))


_PAIR_FIELDS = ("index_id", "index_name", "columns", "is_unique", "is_primary_key", "is_unique_constraint",
                "index_size_mb", "type_desc")


def _side(number: int, source: str | None = None, more: tuple[str, ...] = ()) -> list[Column]:
    """The pair columns of index ``number``, from plain columns or from the struct ``source``."""
    renamed = {"index_id": f"index{number}_id", "index_name": f"index{number}_name"}
    return [F.col(f"{source}.{f}" if source else f).alias(renamed.get(f, f"index{number}_{f}"))
            for f in (*_PAIR_FIELDS, *more)]


def _equal_pairs(fingerprints: DataFrame, columns: str, more: tuple[str, ...] = ()) -> DataFrame:
    """Pairs, lower index id first, of the indexes of one table whose list ``columns`` is equal.

    Indexes are grouped by table and list, so each fingerprint is computed and shuffled once, and only groups of
    two and more (at most the number of indexes of one table) are paired.
    """
    group = F.sort_array(F.collect_list(F.struct(*[f for f in _PAIR_FIELDS if f != "columns"], "columns", *more)))
    return (fingerprints.withColumnRenamed(columns, "columns").filter(F.col("columns").isNotNull())
            .groupBy(*TABLE, "schema_name", "table_name", F.col("columns").alias("_list")).agg(group.alias("_group"))
            .filter(F.size("_group") > 1)
            .select(*DATABASE, "schema_name", "table_name", "_group", F.posexplode("_group").alias("_at", "_first"))
            .select(*DATABASE, "schema_name", "table_name", "_first",
                    F.explode(F.slice("_group", F.col("_at") + 2, F.size("_group"))).alias("_second"))
            .select(*DATABASE, "schema_name", "table_name", *_side(1, "_first", more), *_side(2, "_second", more)))


def _covered_pairs(fingerprints: DataFrame) -> DataFrame:
    """Pairs where the list of index 2 is a leading part of the list of index 1, in one pass over each table's indexes.

    Sorted by their arrays, lists come right after their leading parts. So the scan keeps the open ones, those that the
    current list begins with, and what is closed once never has to be looked at again.
    """
    fields = [f for f in _PAIR_FIELDS if f != "columns"]
    entry = F.struct("_ids", *fields, F.col("columns_all").alias("columns"))
    entries = F.sort_array(F.collect_list(entry))
    ids = (F.col("column_ids") if "column_ids" in fingerprints.columns else F.split("columns_all", SEPARATOR))
    grouped = (fingerprints.filter(F.col("columns_all").isNotNull()).withColumn("_ids", ids)
               .groupBy(*TABLE, "schema_name", "table_name").agg(entries.alias("_entries")).filter(F.size("_entries") > 1))
    one = grouped.schema["_entries"].dataType.simpleString()
    start = F.struct(F.expr(f"cast(array() as {one})").alias("open"),
                     F.expr(f"cast(array() as array<struct<top:{one[6:-1]},covered:{one}>>)").alias("found"))

    def step(state: Column, current: Column) -> Column:
        covered = F.filter(state["open"], lambda o: F.slice(current["_ids"], F.lit(1), F.size(o["_ids"])) == o["_ids"])
        pair = F.struct(current.alias("top"), covered.alias("covered"))
        return F.struct(F.concat(covered, F.array(current)).alias("open"),
                        F.when(F.size(covered) > 0, F.concat(state["found"], F.array(pair))).otherwise(state["found"]).alias("found"))

    place = [*DATABASE, "schema_name", "table_name"]
    found = F.aggregate("_entries", start, step)["found"]
    pairs = (grouped.select(*place, F.explode(found).alias("_found"))
             .select(*place, F.col("_found.top").alias("_top"), F.explode("_found.covered").alias("_covered")))
    equal = F.col("_top._ids") == F.col("_covered._ids")  # then the lower id, which was met first, is index 1
    return (pairs.select(*place, F.when(equal, F.col("_covered")).otherwise(F.col("_top")).alias("_first"),
                         F.when(equal, F.col("_top")).otherwise(F.col("_covered")).alias("_second"))
            .select(*place, *_side(1, "_first"), *_side(2, "_second")))


def duplicate_indexes(fingerprints: DataFrame, mode: str = "equal") -> DataFrame:
    """Pairs of indexes of one table with the same columns, key and included columns taken together.

    ``mode='equal'``: same list, lower index id first. ``mode='prefix'``: index 2 is covered, its list being a
    leading part of index 1's list or, with the lower id first, equal to it. The input is the output of
    ``index_fingerprint``; with its ``column_ids`` prefix mode compares columns by id, else whole names as they are
    printed, which a name that contains the separator can mislead.
    """
    if mode not in ("equal", "prefix"):
        raise ValueError(f"mode must be 'equal' or 'prefix', not {mode!r}")
    pairs = _equal_pairs(fingerprints, "columns_all") if mode == "equal" else _covered_pairs(fingerprints)
    return pairs.orderBy(*DATABASE, "table_name", "index1_id", "index2_id")


def drop_command(schema: Column, table: Column, index: Column) -> Column:
    """The text of a DROP INDEX command; never executed here."""
    return F.concat(F.lit("DROP INDEX "), quote_name(index), F.lit(" ON "), quote_name(schema), F.lit("."),
                    quote_name(table), F.lit(";"))


def duplicate_indexes_keys(fingerprints: DataFrame) -> DataFrame:
    """Pairs of indexes of one table with the same key columns, both include lists and a command to drop the second.

    The command names the real schema of the table.
    """
    return (_equal_pairs(fingerprints, "columns_key", ("columns_included",))
            .withColumnsRenamed({"index1_columns_included": "index1_included",
                                 "index2_columns_included": "index2_included"})
            .withColumn("cmd_drop", drop_command(F.col("schema_name"), F.col("table_name"), F.col("index2_name")))
            .orderBy(*DATABASE, "table_name", "index1_id", "index2_id"))


def _one_table(tables: DataFrame, table: str | None) -> DataFrame:
    names = tables.select(*TABLE, F.concat_ws(".", "schema_name", "name").alias("table_name"))
    return names if table is None else names.filter(F.lower("table_name") == table.lower())


def index_detail(
    indexes: DataFrame, index_columns: DataFrame, columns: DataFrame, tables: DataFrame,
    partitions: DataFrame, allocation_units: DataFrame, table: str | None = None,
) -> DataFrame:
    """Index by column rows of one table (``schema.name``) or all, with the size of the index."""
    check(indexes, "indexes")
    check(tables, "tables")
    return (indexes.withColumnRenamed("name", "index_name")
            .join(_one_table(tables, table), list(TABLE))
            .join(index_sizes(partitions, allocation_units), list(INDEX))
            .join(named_index_columns(index_columns, columns), list(INDEX))
            .select(*DATABASE, "table_name", "index_id", "type_desc", "index_name", "column_name", "index_column_id",
                    "is_primary_key", "is_unique", "is_unique_constraint", "key_ordinal", "is_included_column",
                    F.col("index_size_mb").alias("size_mb"))
            .orderBy(*DATABASE, "table_name", "index_id", "is_included_column", "key_ordinal"))


def nonclustered_pk(
    indexes: DataFrame, tables: DataFrame, partitions: DataFrame, allocation_units: DataFrame,
) -> DataFrame:
    """Primary keys of user tables that are not the clustered index."""
    keys = _user_indexes(indexes, tables).filter(_is("is_primary_key") & (F.col("index_id") != CLUSTERED))
    return (keys.join(index_sizes(partitions, allocation_units), list(INDEX))
            .select(*DATABASE, "table_name", "index_id", "type_desc", "index_name", "is_primary_key", "is_unique",
                    "is_unique_constraint", F.col("index_size_mb").alias("size_mb"))
            .orderBy(*DATABASE, "table_name", "index_name"))


_USAGE = ("user_seeks", "user_scans", "user_lookups", "user_updates",
          "last_user_seek", "last_user_scan", "last_user_lookup", "last_user_update")


def unused_indexes(
    indexes: DataFrame, index_usage: DataFrame, index_columns: DataFrame, columns: DataFrame, tables: DataFrame,
    partitions: DataFrame, allocation_units: DataFrame,
) -> DataFrame:
    """Plain nonclustered indexes that were never read, with columns, size and a command to drop them.

    An index without a usage row is not reported: nothing is known about it.
    """
    check(index_usage, "index_usage")
    unread = index_usage.filter(F.col("user_seeks") + F.col("user_scans") + F.col("user_lookups") == 0)
    candidates = _user_indexes(indexes, tables).filter(
        ~_is("is_primary_key") & ~_is("is_unique") & (F.col("index_id") > CLUSTERED))
    return (candidates.join(unread.select(*INDEX, *_USAGE), list(INDEX))
            .join(index_sizes(partitions, allocation_units), list(INDEX))
            .join(column_lists(index_columns, columns), list(INDEX), "left")
            .select(*DATABASE, "schema_name", "table_name", "index_name", *_USAGE,
                    F.col("index_size_mb").alias("size_mb"), "columns_key", "columns_included",
                    drop_command(F.col("schema_name"), F.col("table_name"), F.col("index_name")).alias("cmd_drop"))
            .orderBy(*DATABASE, "table_name", "index_name"))


def index_columns_search(
    indexes: DataFrame, index_columns: DataFrame, columns: DataFrame, types: DataFrame, tables: DataFrame,
    pattern: str = "%",
) -> DataFrame:
    """Index columns, with their types, of the tables whose name is LIKE ``pattern``."""
    check(tables, "tables")
    names = (tables.filter(like_any_case(F.col("name"), pattern))
             .select(*TABLE, F.col("name").alias("table_name")))
    described = named_index_columns(index_columns, columns, *TYPE_KEY, "is_nullable", "is_identity", "max_length")
    return (indexes.withColumnRenamed("name", "index_name")
            .join(names, list(TABLE))
            .join(described, list(INDEX))
            .join(type_names(types), list(TYPE_KEY))
            .select(*DATABASE, "table_name", "index_id", "index_name", "type_desc", "is_primary_key", "is_unique",
                    "column_name", "is_nullable", "is_identity", "type_name", "max_length", "index_column_id",
                    "key_ordinal", "partition_ordinal", "is_included_column")
            .orderBy(*DATABASE, "table_name", "index_id", "is_included_column", "key_ordinal"))


def index_usage_search(
    indexes: DataFrame, index_usage: DataFrame, tables: DataFrame, pattern: str = "%",
) -> DataFrame:
    """Usage counters and last-use times of the indexes of tables whose name is LIKE ``pattern``."""
    check(index_usage, "index_usage")
    names = (tables.filter(like_any_case(F.col("name"), pattern))
             .select(*TABLE, F.col("name").alias("table_name")))
    return (indexes.withColumnRenamed("name", "index_name")
            .join(names, list(TABLE))
            .join(index_usage.select(*INDEX, *_USAGE), list(INDEX))
            .select(*DATABASE, "table_name", "index_id", "index_name", "type_desc", "is_primary_key", "is_unique",
                    *_USAGE)
            .orderBy(*DATABASE, "table_name", "index_id"))


def index_columns_outer(
    indexes: DataFrame, index_columns: DataFrame, columns: DataFrame, tables: DataFrame, table: str | None = None,
) -> DataFrame:
    """Indexes of one table (or all) with their columns; an index without columns, a heap, keeps one NULL row."""
    check(indexes, "indexes")
    names = columns.select(*TABLE, "column_id", F.col("name").alias("column_name"), "is_nullable", "is_identity")
    return (indexes.withColumnRenamed("name", "index_name")
            .join(_one_table(tables, table), list(TABLE))
            .join(index_columns.select(*INDEX, "column_id"), list(INDEX), "left")
            .join(names, [*TABLE, "column_id"], "left")
            .select(*DATABASE, "table_name", "index_id", "index_name", "type_desc", "is_primary_key", "is_unique",
                    "column_name", "is_nullable", "is_identity"))


def _spaces(schemes: DataFrame, functions: DataFrame, filegroups: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Partition schemes with their function name, and filegroups, both keyed by database and data space."""
    with_function = (schemes.withColumnRenamed("name", "scheme_name")
                     .join(functions.select(*DATABASE, "function_id", F.col("name").alias("function_name")),
                           [*DATABASE, "function_id"], "left")
                     .select(*DATABASE, "data_space_id", "scheme_name", "function_name"))
    groups = filegroups.select(*DATABASE, "data_space_id", F.col("name").alias("filegroup_name"))
    return with_function, groups


def partition_key_ordinals(
    tables: DataFrame, indexes: DataFrame, index_columns: DataFrame, columns: DataFrame, types: DataFrame,
    schemes: DataFrame, functions: DataFrame, filegroups: DataFrame,
) -> DataFrame:
    """All index columns of partitioned tables with their partitioning and key positions.

    A table is partitioned when one of its indexes lies on a partition scheme; its other indexes are listed as
    ``NonAligned``. Types are joined on both ids, so alias types do not duplicate rows.
    """
    schemes_named, groups = _spaces(schemes, functions, filegroups)
    space = [*DATABASE, "data_space_id"]
    partitioned = indexes.join(schemes_named.select(*space), space, "left_semi").select(*TABLE).distinct()
    described = named_index_columns(index_columns, columns, *TYPE_KEY, "is_identity")
    return (indexes.withColumnRenamed("name", "index_name")
            .join(partitioned, list(TABLE), "left_semi")
            .join(tables.select(*TABLE, F.col("name").alias("table_name")), list(TABLE))
            .join(described, list(INDEX))
            .join(type_names(types), list(TYPE_KEY))
            .join(schemes_named, space, "left")
            .join(groups, space, "left")
            .select(*DATABASE, "table_name", "index_id", "index_name",
                    F.coalesce("function_name", F.lit("NonAligned")).alias("partition_function"),
                    F.coalesce("scheme_name", "filegroup_name").alias("partition_scheme_or_filegroup"),
                    "partition_ordinal", "key_ordinal", "is_included_column", "column_name",
                    F.col("type_name").alias("data_type_name"), "is_identity", "is_descending_key",
                    "filter_definition")
            .orderBy(*DATABASE, "table_name", "index_id", "index_name", "partition_function",
                     F.col("partition_scheme_or_filegroup").asc_nulls_first(), F.col("partition_ordinal").desc(),
                     "key_ordinal", "is_included_column", "column_name"))


def _definition_lists(index_columns: DataFrame, columns: DataFrame) -> DataFrame:
    """Key list with directions, include list by name, and the partitioning column, in one aggregation."""
    quoted = quote_name(F.col("column_name"))
    directed = F.concat(quoted, F.when(_is("is_descending_key"), " DESC").otherwise(""))
    grouped = named_index_columns(index_columns, columns).groupBy(*INDEX).agg(
        _rows(at=F.col("key_ordinal"), directed=directed, name=F.col("column_name"), quoted=quoted,
              included=_is("is_included_column")).alias("_columns"),
        F.max(F.when(F.col("partition_ordinal") == 1, quoted)).alias("_partition_column"))
    included = F.transform(F.filter("_columns", lambda r: r["included"]), lambda r: F.struct(r["name"].alias("name"), r["quoted"].alias("quoted")))
    return (grouped.withColumn("_included", F.sort_array(included))
            .select(*INDEX, _listed("_columns", "directed", lambda r: r["at"] > 0).alias("_keys"),
                    _listed("_included", "quoted", lambda r: F.lit(True)).alias("_includes"), "_partition_column"))


def _partition_figures(partitions: DataFrame, partition_stats: DataFrame) -> DataFrame:
    """Per index: reserved gigabytes, rows, partitions, and the partitions under row and page compression."""
    number = F.col("partition_number")
    stats = partition_stats.select(*DATABASE, "partition_id", "in_row_reserved_page_count",
                                   "lob_reserved_page_count", "row_count")

    def gigabytes(pages: str) -> Column:
        return (F.sum(pages).cast("decimal(20,0)") * 8 / (1024 * 1024)).cast("decimal(32,1)")

    known = F.col("row_count").isNotNull()
    compressed = F.when(F.col("data_compression").isin(1, 2), F.struct(number.alias("number"), number.cast("string").alias("text"), F.col("data_compression").alias("kind")))
    figures = (partitions.join(stats, [*DATABASE, "partition_id"], "left").groupBy(*INDEX).agg(
        gigabytes("in_row_reserved_page_count").alias("reserved_in_row_gb"),
        gigabytes("lob_reserved_page_count").alias("reserved_lob_gb"),
        F.sum("row_count").alias("row_count"),
        F.count(F.when(known, 1)).alias("partition_count"),
        F.sort_array(F.collect_list(compressed)).alias("_compressed")))
    return figures.withColumns({
        "_row_compressed": _listed("_compressed", "text", lambda r: r["kind"] == 1),
        "_page_compressed": _listed("_compressed", "text", lambda r: r["kind"] == 2)}).drop("_compressed")


def _create_text() -> Column:
    """CREATE INDEX or ADD CONSTRAINT text put together from the prepared columns; NULL when the key list is."""
    blank = F.lit("")
    kind = F.when(F.col("index_id") > CLUSTERED, F.lit("NONCLUSTERED ")).otherwise(F.lit("CLUSTERED "))
    table = F.concat(quote_name(F.col("schema_name")), F.lit("."), quote_name(F.col("_table")))
    index = quote_name(F.col("index_name"))
    as_key = F.concat(F.lit("ALTER TABLE "), table, F.lit(" ADD CONSTRAINT "), index, F.lit(" PRIMARY KEY "), kind)
    as_index = F.concat(F.lit("CREATE "), F.when(_is("is_unique"), "UNIQUE ").otherwise(blank), kind,
                        F.lit("INDEX "), index, F.lit(" ON "), table, F.lit(" "))

    def optional(before: str, value: str, after: str) -> Column:
        return F.coalesce(F.concat(F.lit(before), F.col(value), F.lit(after)), blank)

    def compression(name: str, listed: str) -> Column:
        partitions = F.when(F.col("scheme_name").isNull(), blank).otherwise(
            F.concat(F.lit(" ON PARTITIONS ("), F.col(listed), F.lit(")")))
        return F.when(F.col(listed).isNotNull(), F.concat(F.lit(f"DATA_COMPRESSION = {name} "), partitions))

    options = F.concat_ws(", ", compression("ROW", "_row_compressed"), compression("PAGE", "_page_compressed"))
    with_clause = F.when(options == "", blank).otherwise(F.concat(F.lit(" WITH ("), options, F.lit(")")))
    place = F.when(F.col("scheme_name").isNull(), F.coalesce(quote_name(F.col("filegroup_name")), blank)).otherwise(
        F.concat(F.col("scheme_name"), F.lit(" ("), F.col("_partition_column"), F.lit(")")))
    statement = F.concat(
        F.when(_is("is_primary_key"), as_key).otherwise(as_index),
        F.lit("("), F.col("_keys"), F.lit(")"),
        optional(" INCLUDE (", "_includes", ")"),
        optional(" WHERE ", "filter_definition", ""),
        with_clause, F.lit(" ON "), place, F.lit(";"))
    return F.when(F.col("index_id") == HEAP, F.lit("/* No create statement (Heap) */")).otherwise(statement)


def index_definition(
    tables: DataFrame, indexes: DataFrame, index_columns: DataFrame, columns: DataFrame, index_usage: DataFrame,
    partitions: DataFrame, partition_stats: DataFrame, schemes: DataFrame, functions: DataFrame,
    filegroups: DataFrame,
) -> DataFrame:
    """Heaps and row-store indexes with a reconstructed definition text, usage, size and partitioning.

    The lists that belong to an index are aggregated once each and joined, instead of being looked up per index.
    The text is output only; nothing executes it. An index without partitions keeps NULL figures and count 0.
    """
    check(tables, "tables")
    check(indexes, "indexes")
    schemes_named, groups = _spaces(schemes, functions, filegroups)
    space = [*DATABASE, "data_space_id"]
    owners = tables.select(*TABLE, "schema_name", F.col("name").alias("_table"),
                           F.col("create_date").alias("table_created_date"),
                           F.col("modify_date").alias("table_modify_date"))
    joined = (indexes.filter(F.col("type").isin(HEAP, CLUSTERED, NONCLUSTERED))
              .withColumnRenamed("name", "index_name")
              .join(owners, list(TABLE))
              .join(index_usage.select(*INDEX, *_USAGE), list(INDEX), "left")
              .join(_definition_lists(index_columns, columns), list(INDEX), "left")
              .join(_partition_figures(partitions, partition_stats), list(INDEX), "left")
              .join(schemes_named, space, "left")
              .join(groups, space, "left"))
    return joined.select(
        *DATABASE, F.concat_ws(".", "schema_name", "_table").alias("table_name"),
        F.greatest("last_user_seek", "last_user_scan", "last_user_lookup").alias("last_user_read"),
        "last_user_update", _create_text().alias("index_create_statement"), "index_id", "index_name",
        "reserved_in_row_gb", "reserved_lob_gb", "row_count", "user_seeks", "user_scans", "user_lookups",
        F.col("user_updates").alias("queries_that_modified"),
        F.coalesce("partition_count", F.lit(0)).alias("partition_count"),
        "allow_page_locks", "allow_row_locks", "is_hypothetical", "has_filter", "fill_factor", "is_unique",
        F.coalesce("function_name", F.lit("/* Not partitioned */")).alias("partition_function"),
        F.coalesce("scheme_name", "filegroup_name").alias("partition_scheme_or_filegroup"),
        "table_created_date", "table_modify_date",
    ).orderBy(*DATABASE, "table_name", "index_id")
