"""Recall and scores against brute force."""

import numpy as np
import pytest
from pyspark.sql import functions as F
from weft.llm import neighbors


def brute(rows, k):
    ids, x = np.array([r[0] for r in rows]), np.array([r[1] for r in rows], np.float64)
    out = {}
    for i, v in zip(ids, x):
        s = (x * v).sum(axis=1)
        order = [j for j in np.lexsort((ids, -s)) if ids[j] != i][:k]
        out[int(i)] = [(int(ids[j]), float(s[j])) for j in order]
    return out


def recall(got, want, queries):
    hits = total = 0
    for q in queries:
        least = want[q][-1][1] - 1e-9
        hits += sum(s >= least for _, s in got.get(q, []))
        total += len(want[q])
    return hits / total


def found(df):
    out = {}
    for r in sorted(df.collect(), key=lambda r: (r.query_id, r.rank)):
        assert r.rank == len(out.setdefault(r.query_id, [])) + 1
        out[r.query_id].append((r.vec_id, r.score))
    return out


@pytest.mark.parametrize("table", ["sf0.01", "sf0.1"])
def test_recall(spark, table):
    df = spark.read.parquet(f"/root/testdata/{table}/embeddings.parquet")
    rows = [(r.vec_id, r.embedding) for r in df.collect() if r.embedding and all(e is not None and np.isfinite(e) for e in r.embedding) and any(r.embedding)]
    got, want = found(neighbors.search(df, df.filter("vec_id % 20 = 0"))), brute(rows, 20)
    queries = [r[0] for r in rows if r[0] % 20 == 0]
    assert set(got) == set(queries) and recall(got, want, queries) >= 0.95
    by_id = {r[0]: np.array(r[1], np.float64) for r in rows}
    for q in queries[:20]:
        assert all(s == pytest.approx(float((by_id[q] * by_id[v]).sum()), rel=1e-12) for v, s in got[q])
        assert got[q] == sorted(got[q], key=lambda x: (-x[1], x[0]))


def test_norms_and_ties(spark):
    rng = np.random.default_rng(3)
    rows = [(i, (rng.normal(size=8) * rng.choice([0.1, 1, 5])).tolist()) for i in range(400)] + [(i, [1.0] * 8) for i in range(400, 460)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    rows = [(r.vec_id, r.embedding) for r in df.collect()]
    got, want = found(neighbors.search(df, df.filter("vec_id % 20 = 0"))), brute(rows, 20)
    assert recall(got, want, list(got)) >= 0.9
    all_lists = found(neighbors.search(df, df.filter("vec_id % 20 = 0"), probes=neighbors.LISTS))[440]
    assert [v for v, _ in all_lists] == [v for v, _ in want[440]]


def test_left_out_and_few(spark):
    rows = [(0, [1.0, 2.0], "a"), (1, None, "a"), (2, [0.0, 0.0], "a"), (3, [float("nan"), 1.0], "a"), (4, [None, 1.0], "a"), (20, [1.0, 1.0], "b"), (40, [float("inf"), 1.0], "b"), (60, [3.0], "b"), (20, [1.0, 1.0], "b"), (5, [], "c")]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, score string")
    got = found(neighbors.search(df, df.filter("vec_id % 20 = 0"), probes=neighbors.LISTS))
    assert got[0] == [(20, 3.0), (20, 3.0)] and set(got) == {0, 20} and set(got[20]) == {(0, 3.0)}
    assert neighbors.search(df.filter("vec_id = 1"), df).count() == 0


def test_no_task_holds_all_queries(spark, monkeypatch):
    rng = np.random.default_rng(4)
    df = spark.createDataFrame([(i, rng.normal(size=8).tolist()) for i in range(600)], "vec_id long, embedding array<double>")
    queries, lists = df.filter("vec_id % 3 = 0"), neighbors.LISTS
    want = found(neighbors.search(df, queries, 5, lists))
    monkeypatch.setattr(neighbors, "ASKED", 20, raising=False)
    monkeypatch.setattr(neighbors, "SLICE", 2)
    held = []
    deal = neighbors.dealt_out
    monkeypatch.setattr(neighbors, "dealt_out", lambda *a: held.append(deal(*a)) or held[0])
    assert found(neighbors.search(df, queries, 5, lists)) == want
    tasks = held[0].groupBy("list", "slice", "part").agg(F.sum("side").alias("asked"), F.sum(1 - F.col("side")).alias("vectors")).collect()
    assert max(t.asked for t in tasks) <= 2 * 20
    assert sum(t.asked * t.vectors for t in tasks) == 600 * 200
