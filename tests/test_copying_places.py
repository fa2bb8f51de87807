"""Shared grams are found with one shuffle of their places."""

from pyspark.sql import functions as F
from weft.operators import copying as cp

ROWS = [
    (1, "a b c d e f g h i j a b c d e f g h"),
    (2, "x a b c d e f g h y"),
    (2, "q r s t u v w x y"),  # one doc_id, two texts
    (3, "q r s t u v w x z"),
    (4, "too short"),
    (5, None),
]


def shuffles(df):
    plan = df._jdf.queryExecution().executedPlan().toString()
    return plan.split("== Initial Plan ==")[-1].count("Exchange hashpartitioning")


def test_places_are_dealt_out_once(spark):
    docs = spark.createDataFrame(ROWS, "doc_id long, text string")
    got = cp.shared_places(docs)
    want = cp.postings(cp.hashed_shingles(docs))
    key = lambda df: sorted((r.doc_id, r.pos, tuple(r.gram), r.df) for r in df.collect())
    assert key(got) == key(want) and len(key(got)) == 5
    assert shuffles(got) == 1


def test_grams_are_read_again_from_their_document(spark):
    docs = spark.createDataFrame(ROWS, "doc_id long, text string")
    got = {r.gram: r.df for r in cp.grams_on(docs, 2, 10).collect()}
    assert got == {"a b c d e f g h": 2, "q r s t u v w x": 2}
    counts = {r.df: r.n for r in cp.document_counts(docs).groupBy("df").agg(F.count("*").alias("n")).collect()}
    want = cp.shingle_index(cp.shingles(docs).filter("gram is not null")).groupBy("df").agg(F.count("*").alias("n")).collect()
    assert counts == {r.df: r.n for r in want}


def test_grams_are_dealt_out_by_the_text(spark, monkeypatch):
    docs = spark.createDataFrame([(k, " ".join(f"w{(k * 7 + i) % 40}" for i in range(60))) for k in range(12)], "doc_id long, text string")
    want = sorted(cp.document_counts(docs).select("x", "y", "df").collect())
    monkeypatch.setattr(cp, "DEALT", 100)
    dealt = cp.document_counts(docs)
    assert "REPARTITION_BY_NUM" in dealt._jdf.queryExecution().toString() and dealt.rdd.getNumPartitions() > 4
    assert want and sorted(dealt.select("x", "y", "df").collect()) == want
