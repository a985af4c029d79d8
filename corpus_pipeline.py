"""From raw documents to packed training sequences, one stage after another.

Every stage takes (spark, docs, sf_dir) and works on all that its predecessor kept. Models are fitted on the labels of
the folder and the documents that reach their stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from statloom.llm import mil, minhash, mixing, packing, toxicity
from statloom.llm.fitting import labelled_sample
from statloom.llm.work import reach_executors, stored

TOXIC_FROM = 0.7
GOOD_FROM = 0.3

_SCORE = "_stage_score"


def _labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/labels.parquet")


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose most toxic span scores below 0.7; all of them without labelled documents of both kinds."""
    plan = toxicity.ToxicityPlan()
    sample = labelled_sample(docs, _labels(spark, sf_dir), "toxic", None, plan.per_class, plan.longest)
    if not sample.usable:
        return docs
    model = toxicity.fit(sample, plan)
    return toxicity.score(docs, model, _SCORE).filter(F.col(_SCORE) < TOXIC_FROM).drop(_SCORE)


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a quality score of 0.3 or more; all of them without labelled documents of both kinds."""
    plan = mil.QualityPlan()
    sample = labelled_sample(docs, _labels(spark, sf_dir), "quality", None, plan.per_class, plan.longest)
    if not sample.usable:
        return docs
    model = mil.fit(sample, plan)
    return mil.score(docs, model, _SCORE).filter(F.col(_SCORE) >= GOOD_FROM).drop(_SCORE)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates: five-word shingles, a similarity of 0.8 or more."""
    return minhash.drop_near_duplicates(docs, minhash.NearPlan(shingle=5, percent=80))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix at 150% of the words, with repeats up to twice; packing doesn't need it in its merged order."""
    return mixing.mix(docs, mixing.MixPlan(), ordered=False)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all documents with their places in sequences of 2048 tokens."""
    return packing.pack(docs)


STAGES = [
    ("toxicity", drop_toxic),
    ("quality", keep_good),
    ("near_duplicates", drop_near_copies),
    ("mixing", mix_sources),
    ("packing", pack_sequences),
]

#: Fitted models and the tokenizer have no SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages on the documents of a folder, each on the stored result of the one before it."""
    reach_executors(spark)
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
