"""Queries that SQL can express, against DuckDB; the others give one row per row of their table."""

import pytest
from oracle import compare

from lectern.llm import queries


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_query_matches_its_sql(spark, sf, name):
    n, ours, theirs = compare(spark, queries.queries()[name], queries.oracle_sql()[name], sf)
    assert n > 0
    assert not ours and not theirs


@pytest.mark.parametrize("name", ["op3_quality_classifier", "op4_toxicity", "op9_language_id", "op10_sharding"])
def test_query_covers_every_row(spark, sf, name):
    got = queries.queries()[name](spark, sf)
    ids = sorted(r.doc_id for r in got.select("doc_id").collect())
    assert ids == sorted(r.doc_id for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id").collect())
