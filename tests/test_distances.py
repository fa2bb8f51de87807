"""Distances by sources that are dealt out, against frontier joins and by hand."""

import numpy as np
import pytest
from weft.operators import paths


def _of(spark, pairs, sources, **kw):
    edges = spark.createDataFrame([(int(a), int(b)) for a, b in pairs], "src long, dst long")
    rows = paths.distances(edges, spark.createDataFrame([(int(v),) for v in sources], "node long"), **kw).collect()
    assert len(rows) == len({(r.source, r.node) for r in rows})
    return {(r.source, r.node): r.dist for r in rows}


def test_dealt_out_sources_agree_with_frontier_joins(spark, monkeypatch):
    rng = np.random.default_rng(4)
    a, b = rng.integers(0, 90, (2, 100))
    pairs = {(min(x, y), max(x, y)) for x, y in zip(a.tolist(), b.tolist()) if x != y} | {(100, 101), (101, 102), (200, 201)}
    sources = [*range(0, 90, 3), 101, 300]  # none of (200, 201); 300 has no edge
    joined = _of(spark, pairs, sources, most=0)
    assert joined[101, 102] == 1 and joined[300, 300] == 0 and (200, 201) not in joined
    assert _of(spark, pairs, sources) == joined
    monkeypatch.setattr(paths, "BAG", 1)
    monkeypatch.setattr(paths, "ROWS", 300)  # a component in many parts
    assert _of(spark, pairs, sources) == joined


@pytest.mark.parametrize("n", [70, 500])
def test_a_long_path_takes_no_round_of_jobs_for_each_step(spark, n):
    got = _of(spark, [(k, k + 1) for k in range(n - 1)], range(n))  # as many levels as nodes: minutes by frontier joins
    assert len(got) == n * n and all(d == abs(x - y) for (x, y), d in got.items())
