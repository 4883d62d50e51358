"""The operators' queries that have SQL, against DuckDB on the smallest tables; every query's row keys."""

import os

import duckdb
import pytest

from minutespark.llm.queries import ORACLES, QUERIES

FOLDER = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no test tables here")


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_oracle(spark, name):
    con = duckdb.connect()
    for table in ("documents", "conversations", "benchmark"):
        con.execute(f"create view {table} as select * from '{FOLDER}/{table}.parquet'")
    df = QUERIES[name](spark, FOLDER)
    expected = con.sql(ORACLES[name])
    assert sorted(df.columns) == sorted(expected.columns)
    order = sorted(df.columns)
    got = sorted((tuple(r[c] for c in order) for r in df.collect()), key=str)
    assert got == sorted((tuple(r[expected.columns.index(c)] for c in order) for r in expected.fetchall()), key=str)


@pytest.mark.parametrize("name", sorted(set(QUERIES) - {"op1_chat_format", "op4_sentence_spans", "op6_best_fit_packing", "op7_benchmark_decontamination", "op11_prefix_trie"}))
def test_one_row_per_document(spark, name):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    got = [r["doc_id"] for r in QUERIES[name](spark, FOLDER).select("doc_id").collect()]
    assert sorted(got, key=str) == sorted((r["doc_id"] for r in docs.select("doc_id").collect()), key=str)
