"""Betweenness by sources that are dealt out, against frontier joins and by hand."""

import numpy as np
import pytest

from weft.operators import paths


def _of(spark, pairs, nodes, **kw):
    edges = spark.createDataFrame([(int(a), int(b)) for a, b in pairs], "src long, dst long")
    return {r.node: r.betweenness for r in paths.betweenness(edges, spark.createDataFrame([(int(v),) for v in nodes], "node long"), **kw).collect()}


def test_dealt_out_sources_agree_with_frontier_joins(spark, monkeypatch):
    rng = np.random.default_rng(3)
    a, b = rng.integers(0, 60, (2, 110))
    pairs = {(min(x, y), max(x, y)) for x, y in zip(a.tolist(), b.tolist()) if x != y} | {(100, 101), (101, 102), (200, 201)}
    nodes = sorted({v for p in pairs for v in p} | {300})
    joined = _of(spark, pairs, nodes, most=0)
    assert sum(joined.values()) > 0 and joined[300] == 0
    shared = _of(spark, pairs, nodes)  # all components in one bag
    monkeypatch.setattr(paths, "BAG", 1)
    parted = _of(spark, pairs, nodes, work=500)  # a component in many parts
    for v in nodes:
        assert shared[v] == pytest.approx(joined[v], abs=1e-12) and parted[v] == pytest.approx(joined[v], abs=1e-12)


def test_a_long_path_takes_no_round_of_jobs_for_each_step(spark):
    n = 600  # 600 levels: minutes by frontier joins
    got = _of(spark, [(k, k + 1) for k in range(n - 1)], range(n))
    assert all(got[k] == pytest.approx(2 * k * (n - 1 - k) / ((n - 1) * (n - 2))) for k in range(n))


def test_no_edges(spark):
    assert _of(spark, [], [1, 2, 3]) == {1: 0, 2: 0, 3: 0}


def test_places_are_held_in_passes_of_few_sources(spark, monkeypatch):
    first, b = np.array([0, 1, 3, 4]), np.array([1, 0, 2, 1])
    assert paths.passed(3, first, b, np.arange(3)).tolist() == [0, 2, 0] == sum(paths.passed(3, first, b, np.array([k])) for k in range(3)).tolist()
