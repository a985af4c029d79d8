"""The pipeline: stages, their columns, and what they must let through."""

import corpus_pipeline


def test_stages(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    sizes = [docs.count()]
    for name, stage in corpus_pipeline.STAGES[:-1]:
        after = corpus_pipeline.stored(stage(spark, docs, sf_dir), f"test-{name}")
        assert after.columns == docs.columns
        docs, sizes = after, [*sizes, after.count()]
    assert sizes[0] > sizes[1] > sizes[2] > sizes[3] > sizes[0] // 2
    pieces = corpus_pipeline.STAGES[-1][1](spark, docs, sf_dir)
    assert pieces.select("doc_id").distinct().count() == docs.select("doc_id").distinct().count()


def test_odd_rows_go_through(spark, sf_dir, odd):
    docs = odd
    for name, stage in corpus_pipeline.STAGES:
        docs = corpus_pipeline.stored(stage(spark, docs, sf_dir), f"odd-{name}")
    assert docs.count() > 0


def test_empty_table(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, sf_dir)
    assert docs.count() == 0
