"""Every numbered query on the smallest given tables: the contract's columns, and a row for each row."""

import os

import pytest

from lexiwave.llm import registry

#: query: (table, columns that the contract names)
CONTRACT = {
    "op1_quality_rules": ("documents", "doc_id n_words word_chars n_symbols n_dup_lines n_repeat_words base_failed kept"),
    "op2_embedding_dedup": ("embeddings", "vec_id n_links component_id kept"),
    "op3_substring_dedup": ("documents", "doc_id n_words n_removed kept_sha256"),
    "op4_near_dedup": ("documents", "doc_id"),
    "op5_licence_scan": ("documents", "doc_id"),
    "op6_secret_scan": ("documents", "doc_id n_assign n_access n_hex base_sha256 spans"),
    "op7_line_dedup": ("documents", "doc_id"),
    "op8_mix_sources": ("documents", "doc_id size source_size target taken"),
    "op9_language_id": ("documents", "doc_id held_out lang_pred score"),
    "op10_byte_bpe": ("documents", "doc_id n_tokens ids_sha256 decoded_sha256"),
}
TOP = "/root/testdata/sf0.001"


@pytest.mark.skipif(not os.path.isdir(TOP), reason="the given tables are not here")
@pytest.mark.parametrize("name", CONTRACT)
def test_numbered_query(spark, name):
    table, columns = CONTRACT[name]
    got = registry.QUERIES[name](spark, TOP)
    assert set(columns.split()) <= set(got.columns)
    key = columns.split()[0]
    rows = sorted(r[key] for r in got.select(key).collect())
    given = sorted(r[key] for r in spark.read.parquet(f"{TOP}/{table}.parquet").select(key).collect())
    assert rows == given
