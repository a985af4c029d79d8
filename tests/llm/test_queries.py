"""The registered queries: those with SQL against it, all of them for their columns and rows."""

import pytest

import __spark_entry__ as entry
from compare import compare, connect
from statloom.llm import queries

COLUMNS = {
    "op1_": "doc_id size source_size target taken",
    "op2_": "doc_id held_out n_tokens n_known train_tokens base_score score",
    "op3_": "doc_id n_words word_chars n_symbols n_dup_lines n_repeat_words base_failed kept",
    "op4_": "doc_id n_shingles component_id kept",
    "op5_": "doc_id piece start length ids_crc32 sequence_id offset",
    "op6_": "doc_id held_out score predicted",
    "op7_": "slot shard position n_tokens ids_crc32 doc_ids",
    "op8_": "query_id rank vec_id score",
    "op9_": "doc_id n_words n_base first_word last_word base_labels labels score",
    "op10_": "doc_id held_out score predicted",
    "op11_": "doc_id n_shingles component_id",
    "op12_": "vec_id component n deviation whitened explained identity_error",
    "op13_": "vec_id code error label_error codebooks_sha256",
}


def test_all_are_registered():
    assert set(queries.queries()) | {"pipeline"} <= set(entry.queries())
    assert {n.split("_")[0] + "_" for n in queries.queries()} == set(COLUMNS)
    assert set(queries.oracle_sql()) <= set(queries.queries())


@pytest.mark.parametrize("name", list(queries.oracle_sql()))
def test_equals_sql(name, spark, small_dir):
    assert compare(spark, connect(small_dir), small_dir, queries.queries()[name], queries.oracle_sql()[name]) is None


@pytest.mark.parametrize("name", list(queries.queries()))
def test_columns_and_rows(name, spark, sf_dir):
    result = queries.queries()[name](spark, sf_dir)
    start = name.split("_")[0] + "_"
    assert set(COLUMNS[start].split()) <= set(result.columns)
    count = result.count()
    if start in ("op1_", "op2_", "op3_", "op4_", "op6_", "op9_", "op10_", "op11_"):
        assert count == spark.read.parquet(f"{sf_dir}/documents.parquet").count()
    assert count
