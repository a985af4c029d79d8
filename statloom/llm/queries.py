"""Registered queries of the text operators, and the DuckDB SQL of those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from statloom.llm import (heavylight, katz, licenses, materialise, mil, minhash, mixing, mtree, packing, pqtrie, rules,
                          toxicity, whitening)
from statloom.llm.fitting import remainder
from statloom.llm.work import reach_executors

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def register(query: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    QUERIES[query.__name__] = query
    return query


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    reach_executors(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def held_out(modulus: int, value: int) -> Column:
    """Rows that fitting leaves aside; a NULL doc_id is never held out (nor can it have a label)."""
    return F.coalesce(remainder("doc_id", modulus) == value, F.lit(False))


@register
def op1_fair_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix_takes(table(spark, sf_dir, "documents"))


ORACLES["op1_fair_mix"] = r"""
WITH d AS (
  SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size,
    md5('mix/' || coalesce(CAST(doc_id AS VARCHAR), '')) AS shuffled
  FROM documents),
s AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS source_size, row_number() OVER (ORDER BY source NULLS LAST) AS pos,
    2 * CAST(sum(size) AS DOUBLE) AS most
  FROM d GROUP BY source),
w AS (SELECT *, CASE pos % 3 WHEN 1 THEN 3 WHEN 2 THEN 1 ELSE 2 END AS weight FROM s),
l AS (
  SELECT *, most / weight AS ratio, (1.5 * sum(source_size) OVER () - coalesce(sum(most) OVER before, 0))
    / (sum(weight) OVER () - coalesce(sum(weight) OVER before, 0)) AS lvl
  FROM w WINDOW before AS (ORDER BY most / weight, pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
t AS (
  SELECT source, pos, source_size, least(most, coalesce(weight * (SELECT arg_min(lvl, (ratio, pos)) FROM l
    WHERE ratio > lvl), most)) AS target FROM l),
q AS (
  SELECT d.*, pos, source_size, target, sum(size) OVER (PARTITION BY pos ORDER BY shuffled, doc_id, size
    ROWS UNBOUNDED PRECEDING) AS upto, row_number() OVER () AS n
  FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source),
c AS (
  SELECT n, pos, size, CAST(upto + turn * source_size AS DOUBLE) / target AS finish
  FROM q, (VALUES (0), (1)) AS turns(turn) WHERE size > 0 AND target > 0),
r AS (SELECT *, sum(size) OVER (ORDER BY finish, pos ROWS UNBOUNDED PRECEDING) AS words FROM c WHERE finish <= 4),
k AS (SELECT n, sum(size) AS words FROM r WHERE words <= (SELECT 1.5 * sum(size) FROM d) GROUP BY n)
SELECT doc_id, size, source_size, target, CAST(coalesce(words, 0) AS BIGINT) AS taken FROM q LEFT JOIN k USING (n)"""


@register
def op2_katz_backoff(spark: SparkSession, sf_dir: str) -> DataFrame:
    scores = katz.katz_scores(table(spark, sf_dir, "documents"), remainder("doc_id", 7) != 2)
    return scores.withColumn("held_out", held_out(7, 2)).drop("trained")


@register
def op3_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = rules.fit_from(docs, table(spark, sf_dir, "labels"))
    return rules.apply_rules(docs, model).drop("text")


@register
def op4_circulant_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(table(spark, sf_dir, "documents"), minhash.NearPlan(shingle=3, percent=85))


def _components_sql(percent: int, kept: bool) -> str:
    """All pairs of distinct sets that share a shingle, and what links reach."""
    return rf"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^ 	-]+') AS words FROM documents),
s AS MATERIALIZED (
  SELECT doc_id, CASE WHEN len(words) = 0 THEN [] WHEN len(words) < 3 THEN [array_to_string(words, ' ')]
    ELSE list_sort(list_distinct([words[i] || ' ' || words[i + 1] || ' ' || words[i + 2] FOR i IN range(1, len(words) - 1)])) END AS shingles
  FROM w),
classes AS MATERIALIZED (
  SELECT min(doc_id) AS id, any_value(len(shingles)) AS n, shingles FROM s WHERE len(shingles) > 0 GROUP BY shingles),
t AS MATERIALIZED (SELECT id, n, unnest(shingles) AS shingle FROM classes),
common AS (
  SELECT a.id AS a, b.id AS b, any_value(a.n) AS n, any_value(b.n) AS m, count(*) AS both_have
  FROM t a JOIN t b ON a.shingle = b.shingle AND a.id < b.id AND 100 * a.n >= {percent} * b.n AND 100 * b.n >= {percent} * a.n
  GROUP BY a.id, b.id),
links AS MATERIALIZED (
  SELECT a, b FROM common WHERE 100 * both_have >= {percent} * (n + m - both_have)
  UNION ALL SELECT b, a FROM common WHERE 100 * both_have >= {percent} * (n + m - both_have)),
reach AS (SELECT id, id AS other FROM classes UNION SELECT r.id, l.b FROM reach r JOIN links l ON r.other = l.a),
found AS (SELECT id, min(other) AS component_id FROM reach GROUP BY id),
out AS (
  SELECT s.doc_id, CAST(len(s.shingles) AS BIGINT) AS n_shingles, coalesce(f.component_id, s.doc_id) AS component_id
  FROM s LEFT JOIN classes c ON s.shingles = c.shingles LEFT JOIN found f ON f.id = c.id)
SELECT *{", doc_id = component_id AS kept" if kept else ""} FROM out"""


ORACLES["op4_circulant_minhash"] = _components_sql(85, kept=True)


@register
def op5_sum_of_squares_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"))


@register
def op6_attention_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = mil.fit_from(docs, table(spark, sf_dir, "labels"), remainder("doc_id", 5) != 0)
    return mil.score(docs, model).select(
        "doc_id", held_out(5, 0).alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))


@register
def op7_training_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    return materialise.materialise(table(spark, sf_dir, "documents"))


@register
def op8_mtree_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    return mtree.search(vectors, vectors.filter(F.col("vec_id") % 100 == 0))


ORACLES["op8_mtree_search"] = """
WITH v AS (
  SELECT vec_id, [floor(1024 * CAST(x AS DOUBLE)) FOR x IN embedding] AS e
  FROM embeddings WHERE embedding IS NOT NULL),
s AS (
  SELECT q.vec_id AS query_id, c.vec_id, CAST(list_dot_product(q.e, c.e) AS BIGINT) AS score
  FROM v q, v c WHERE q.vec_id % 100 = 0 AND c.vec_id <> q.vec_id),
r AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INT) AS rank FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 10"""


@register
def op9_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(table(spark, sf_dir, "documents"), licenses.WHOLE).drop("blocks")


@register
def op10_subword_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = toxicity.fit_from(docs, table(spark, sf_dir, "labels"), remainder("doc_id", 3) != 1)
    return toxicity.score(docs, model).select(
        "doc_id", held_out(3, 1).alias("held_out"), "score", (F.col("score") >= 0.7).cast("int").alias("predicted"))


@register
def op11_heavy_light_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return heavylight.join(table(spark, sf_dir, "documents"))


ORACLES["op11_heavy_light_join"] = _components_sql(90, kept=False)


@register
def op12_exact_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.whiten(table(spark, sf_dir, "embeddings").select("vec_id", "embedding"))


@register
def op13_trie_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pqtrie.compress(table(spark, sf_dir, "embeddings").select("vec_id", "embedding", "label")).drop("label")


def _trie_codes_sql(rounds: int = 2) -> str:
    """Codebooks by part, entry and place; each round assigns all parts and takes means."""
    nearest = """
{a} AS MATERIALIZED (
  SELECT vec_id, part, arg_min(entry, (distance, entry)) AS entry, min(distance) AS distance FROM (
    SELECT p.vec_id, p.part, b.entry, sum((p.x - b.x) * (p.x - b.x)) AS distance
    FROM parts p JOIN {b} b ON p.part = b.part AND p.place = b.place GROUP BY p.vec_id, p.part, b.entry)
  GROUP BY vec_id, part)"""
    steps = []
    for n in range(rounds):
        steps.append(nearest.format(a=f"a{n}", b=f"b{n}"))
        steps.append(f"""
b{n + 1} AS MATERIALIZED (
  SELECT b.part, b.entry, b.place, coalesce(m.x, b.x) AS x FROM b{n} b LEFT JOIN (
    SELECT part, entry, place, CAST(floor(CAST(sum(x) AS DOUBLE) / count(*)) AS BIGINT) AS x
    FROM a{n} JOIN parts USING (vec_id, part) GROUP BY ALL) m USING (part, entry, place))""")
    last = nearest.format(a="final", b=f"b{rounds}")
    return f"""
WITH kept AS (
  SELECT vec_id, label, [CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT) FOR x IN embedding] AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len([x FOR x IN embedding IF x IS NULL OR NOT isfinite(x)]) = 0),
cells AS (SELECT vec_id, unnest(v) AS x, generate_subscripts(v, 1) - 1 AS i FROM kept),
parts AS MATERIALIZED (SELECT vec_id, i // 4 AS part, i % 4 AS place, x FROM cells),
b0 AS (
  SELECT part, entry, place, x FROM parts JOIN (
    SELECT vec_id, row_number() OVER (ORDER BY vec_id) - 1 AS entry FROM kept ORDER BY vec_id LIMIT 64) USING (vec_id)),
{",".join(steps)},
{last},
coded AS (
  SELECT vec_id, string_agg(printf('%02x', entry), '' ORDER BY part) AS code, CAST(sum(distance) AS BIGINT) AS error
  FROM final GROUP BY vec_id)
SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error,
  (SELECT sha256(string_agg(CAST(x AS VARCHAR), ',' ORDER BY part, entry, place)) FROM b{rounds}) AS codebooks_sha256
FROM coded JOIN kept USING (vec_id)"""


ORACLES["op13_trie_codes"] = _trie_codes_sql()


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(ORACLES)
