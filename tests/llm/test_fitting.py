"""The bounded sample counts only what a fit can use, and stages without a sample keep their documents."""

from pyspark.sql import functions as F

import corpus_pipeline
from statloom.llm.fitting import labelled_sample


def test_long_texts_do_not_use_up_the_sample(spark):
    docs = spark.range(200).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 20 == 0, "short").otherwise("long " * 100).alias("text"))
    labels = docs.select("doc_id", (F.col("doc_id") % 40 == 0).cast("int").alias("quality"))
    sample = labelled_sample(docs, labels, "quality", None, 4, 50)
    assert sorted(sample.label.tolist()) == [0, 0, 0, 0, 1, 1, 1, 1]


def test_stages_without_a_sample_keep_all_documents(spark, tmp_path):
    docs = spark.createDataFrame([(1, "some words"), (2, "more words"), (3, None)], "doc_id long, text string")
    spark.createDataFrame([(1, 0, 1), (2, 0, 1)], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    for stage in (corpus_pipeline.drop_toxic, corpus_pipeline.keep_good):
        assert sorted(r.doc_id for r in stage(spark, docs, str(tmp_path)).collect()) == [1, 2, 3]
