"""Registered queries: all run over whole tables, and give the rows of their SQL where they have it."""

import duckdb
import pytest
from weft.llm.queries import ORACLES, QUERIES

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", list(ORACLES))
def test_same_rows(spark, name):
    c = duckdb.connect()
    for t in ("documents", "pages", "conversations"):
        c.sql(f"create view {t} as select * from '{SF}/{t}.parquet'")
    got, want = QUERIES[name](spark, SF), c.sql(ORACLES[name])
    assert got.columns == want.columns
    assert sorted((tuple(r) for r in got.collect()), key=repr) == sorted(want.fetchall(), key=repr)


@pytest.mark.parametrize("name", [n for n in QUERIES if n not in ("op2_neighbors", "op3_decontaminate", "op11_warc", "op12_turns")])
def test_a_row_for_each_document(spark, name):
    ids = sorted(r.doc_id for r in QUERIES[name](spark, SF).select("doc_id").collect())
    assert ids == sorted(r.doc_id for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id").collect())
