"""Adapter views as Spark DataFrames."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from statloom.fixtures.adapters import ADAPTERS, BASE_TABLES, inputs_of
from statloom.sources.tables import read_table


class Inputs:
    """Test tables and adapter views of one data folder, by attribute name."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark = spark
        self.sf_dir = sf_dir.rstrip("/")
        self._made: dict[str, DataFrame] = {}

    def __getattr__(self, name: str) -> DataFrame:
        if name.startswith("_"):
            raise AttributeError(name)
        if name not in self._made:
            self._made[name] = self._make(name)
        return self._made[name]

    def _make(self, name: str) -> DataFrame:
        if name in BASE_TABLES:
            return read_table(self.spark, f"{self.sf_dir}/{name}.parquet")
        return self.spark.sql(ADAPTERS[name], **{i: getattr(self, i) for i in inputs_of(name)})

    def tables(self) -> dict[str, DataFrame]:
        return {name: getattr(self, name) for name in BASE_TABLES}

    def event_documents(self, dealt: bool = False) -> DataFrame:
        """Captured events as XML documents, as a capture writes them: data nodes first, with type and text children.

        ``dealt`` deals the rows out before they become documents, which are many times larger: a table may be one row group.
        It adds ``event_id``: a filter on that acts on rows, one on the text would build documents before they are dealt out.

        Some lack the client name, quote with apostrophes, or have blanks around the statement. Malformed ones are cut
        off early, in the middle or near the end, or have a bare ampersand in the statement.
        """

        def node(kind: str, name: str, value) -> F.Column:
            value = F.col(value) if isinstance(value, str) else value
            before = '<type name="any" package="package0"/>' if kind == "data" else ""
            return F.concat(F.lit(f'<{kind} name="{name}">{before}<value>'), value.cast("string"),
                            F.lit(f"</value><text>shown</text></{kind}>" if name == "writes" else f"</value></{kind}>"))

        id_, user = F.col("event_id"), F.col("user_id")
        stamp = F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'")
        quote = F.when(id_ % 6 == 0, F.lit("'")).otherwise(F.lit('"'))
        statement = F.concat(F.when((F.col("is_malformed") == 1) & (id_ % 4 == 3), F.lit("select 1 & 2, ")).otherwise(F.lit("select ")),
                             F.col("props"))
        body = F.concat(
            F.lit("<event name="), quote, F.col("object_name"), quote, F.lit(" timestamp="), quote, stamp, quote, F.lit(">"),
            node("data", "statement", F.when(id_ % 7 == 0, F.concat(F.lit("  "), statement, F.lit("\n "))).otherwise(statement)),
            node("data", "cpu_time", F.col("duration") * 2 + F.when(id_ % 11 == 0, F.lit(3_000_000_000)).otherwise(F.lit(0))), node("data", "duration", "duration"),
            node("data", "logical_reads", id_ * 3), node("data", "physical_reads", id_),
            node("data", "writes", id_ % 10),
            F.when(id_ % 9 == 0, F.lit("")).otherwise(node("data", "row_count", id_ % 100)),
            node("data", "object_name", F.concat(F.lit("proc"), user.cast("string"))),
            node("data", "transaction_state", "transaction_state"), node("data", "error_number", "error_number"),
            node("data", "message", F.concat(F.lit("state of group "), user.cast("string"))),
            node("action", "sql_text", F.concat(F.lit("exec proc"), user.cast("string"))),
            node("action", "username", F.concat(F.lit("user"), user.cast("string"))),
            node("action", "database_name", F.concat(F.lit("db"), (user % 5).cast("string"))),
            F.when(F.col("client_app_name").isNull(), F.lit("")).otherwise(
                node("action", "client_app_name", "client_app_name")),
            node("action", "client_hostname", F.concat(F.lit("host"), (user % 9).cast("string"))),
            node("action", "query_hash", id_ * 7919), node("action", "plan_handle", id_ * 104729),
            node("action", "session_id", "user_id"), node("action", "transaction_id", id_ + 1),
            node("action", "event_sequence", "event_id"), F.lit("</event>"))
        length = F.when(id_ % 4 == 0, F.lit(60)).when(id_ % 4 == 1, F.length(body) / 2).when(
            id_ % 4 == 2, F.length(body) - 4).otherwise(F.length(body))
        cut = body.substr(F.lit(1), length.cast("int"))
        document = F.when(F.col("is_malformed") == 1, cut).otherwise(body)
        if not dealt:
            return self.captured_events.select("object_name", document.alias("event_xml"))
        tasks = max(int(self.spark.conf.get("spark.sql.shuffle.partitions")), self.spark.sparkContext.defaultParallelism)
        return self.captured_events.repartition(tasks, "event_id").select("event_id", "object_name", document.alias("event_xml"))
