"""Every query with an oracle against it: the given tables, odd rows, and empty tables."""

import pytest
from llm_helpers import empty_tables, matches_oracle, odd_documents

from trackspark.llm import queries


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_given_tables(spark, name):
    matches_oracle(spark, queries, name)


@pytest.mark.parametrize("name", ["op7_curriculum_mix", "op10_license_scan"])
def test_odd_documents(spark, tmp_path, name):
    empty_tables(spark, tmp_path)
    odd_documents(spark, tmp_path)
    matches_oracle(spark, queries, name, str(tmp_path))


def test_every_query_takes_empty_tables(spark, tmp_path):
    empty_tables(spark, tmp_path)
    for name, query in queries.QUERIES.items():
        rows = query(spark, str(tmp_path)).collect()
        assert [r["conv_id"] for r in rows] == [-1] if name == "op8_chat_format" else not rows, name


def test_every_document_query_takes_odd_rows(spark, tmp_path):
    empty_tables(spark, tmp_path)
    odd_documents(spark, tmp_path)
    given = spark.read.parquet(f"{tmp_path}/documents.parquet").count()
    for name in ("op1_kneser_ney_quality", "op3_bpe_round_trip", "op5_superminhash_dedup", "op7_curriculum_mix", "op9_language_id", "op10_license_scan"):
        rows = queries.QUERIES[name](spark, str(tmp_path)).collect()
        assert len(rows) == given, name
