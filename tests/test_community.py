"""Runs by components, rewiring and random graphs, by hand and at sizes that their loops were too slow for."""

import numpy as np
import pytest
from weft.operators import community as cm


def cliques(spark, many, size=6):
    rows = [(10 * k * size + i, 10 * k * size + j) for k in range(many) for i in range(size) for j in range(i + 1, size)]
    rows += [(10 * k * size, 10 * (k + 1) * size) for k in range(0, many - 1, 2)]  # components of two cliques
    edges = spark.createDataFrame(rows, "src long, dst long")
    return edges.selectExpr("explode(array(src, dst)) node").distinct().union(spark.createDataFrame([(7,)], "node long")), edges


def test_runs_are_spread_over_components(spark, monkeypatch):
    """No node is lost, a node without edges is alone, and only a component has to be small enough."""
    nodes, edges = cliques(spark, 6)
    monkeypatch.setattr(cm, "MOST_EDGES", 40)  # of 93 edges
    labels = cm.runs(nodes, edges, 10).collect()
    assert len(labels) == 10 * 37 == len({(r.run, r.node) for r in labels})
    assert all(r.community == (7 if r.node == 7 else r.node // 60 * 60) for r in labels)
    monkeypatch.setattr(cm, "MOST_EDGES", 30)
    with pytest.raises(ValueError):
        cm.runs(nodes, edges, 10)


def test_a_component_knows_the_whole_weight():
    """Two triangles and the edge between them are one community where the rest of the graph is heavy, and two where there is none."""
    a, b = np.array([0, 0, 1, 3, 3, 4, 2]), np.array([1, 2, 2, 4, 5, 5, 3])
    assert len(set(cm.louvain(6, a, b, np.ones(7), 0).tolist())) == 2
    assert len(set(cm.louvain(6, a, b, np.ones(7), 0, 2000.0).tolist())) == 1


def test_swaps_keep_degrees_and_move_edges():
    rng, n = np.random.default_rng(1), 3000
    key = np.unique(rng.integers(0, n, (40_000, 2)) @ np.array([n, 1]))
    a, b = key // n, key % n
    a, b = a[a < b], b[a < b]
    c, d = cm.swapped(a.copy(), b.copy(), n, 5 * len(a), rng)
    assert (c < d).all() and len(np.unique(c * n + d)) == len(a)
    assert (np.bincount(np.concatenate([a, b]), minlength=n) == np.bincount(np.concatenate([c, d]), minlength=n)).all()
    assert np.isin(c * n + d, a * n + b).mean() < 0.05


def test_random_graphs_have_all_their_edges(spark):
    for m in (0, 7, 40, 45, 99):
        rows = cm.pooled_degrees(spark, "gnm", 10, m, 3).groupBy("graph").agg({"degree": "sum", "*": "count"}).collect()
        assert [(r["sum(degree)"], r["count(1)"]) for r in rows] == [(2 * min(m, 45), 10)] * 3


@pytest.mark.parametrize("width", [8.0, 0.001])
def test_only_rows_near_a_groups_end_are_ranked(spark, monkeypatch, width):
    """The same groups as ranking all digests gives, whether the first width holds the end of each or not; few rows are ranked."""
    import hashlib

    n, k, trials, made = 4000, 900, 6, []
    v = np.random.default_rng(3).normal(size=n)
    kept = cm.written
    monkeypatch.setattr(cm, "written", lambda df, name="t": made.append((name, kept(df, name))) or made[-1][1])
    values = spark.createDataFrame([(i, float(v[i]), i < k) for i in range(n)], "node long, v double, g boolean")
    got = cm.permutation_test(values, "v", "g", trials, width=width).first()
    first = [sorted(range(n), key=lambda i: hashlib.md5(f"42-{t}-{i}".encode()).hexdigest())[:k] for t in range(trials)]
    assert got.observed == pytest.approx(v[:k].mean())
    assert got.p == sum(v[f].mean() <= v[:k].mean() + 1e-9 for f in first) / trials
    if width == 8.0:
        assert made[-1][1].count() < n * trials / 5


@pytest.mark.parametrize("chunk", [3, 1024])
def test_pairs_of_runs_are_counted_for_classes_of_nodes(spark, monkeypatch, chunk):
    """Each pair of nodes once, whichever class and chunk they are of; nodes that no run parts are counted as one."""
    rows = [(r, n, (n % 4 * (r + 1) + (n % 5 == 0)) % 3) for r in range(5) for n in range(40) if (r, n) != (2, 7)]
    want = {}
    for r, i, c in rows:
        for s, j, e in rows:
            if r == s and c == e and i < j:
                want[i, j] = want.get((i, j), 0) + 1
    made, kept = {}, cm.written
    monkeypatch.setattr(cm, "written", lambda df, name="t": made.setdefault(name, kept(df, name)))
    got = cm.coassignment(spark.createDataFrame([*rows, (0, 99, None)], "run long, node long, community long"), chunk).collect()
    assert len(got) == len(want) and {(g.i, g.j): g.p for g in got} == {k: n / 5 for k, n in want.items()}
    assert made["pairs"].count() < len(want) / 8


@pytest.mark.parametrize("chunk", [4, 1024])
def test_pairs_are_counted_before_they_are_rows(spark, monkeypatch, chunk):
    """Nodes that are all of different classes: over 255 runs, communities of any number, labels that are missing."""
    rng = np.random.default_rng(5)
    label = rng.integers(0, 3, (300, 11)) * 10**12 - 7
    rows = [(r, n, int(label[r, n])) for r in range(300) for n in range(11) if (r, n) not in ((3, 4), (9, 4), (9, 5))]
    want = {}
    for i in range(11):
        for j in range(i + 1, 11):
            want[i, j] = sum(label[r, i] == label[r, j] and not {(r, i), (r, j)} & {(3, 4), (9, 4), (9, 5)} for r in range(300))
    made, kept = {}, cm.written
    monkeypatch.setattr(cm, "written", lambda df, name="t": made.setdefault(name, kept(df, name)))
    df = spark.createDataFrame(rows, "run long, node long, community long")
    assert {(g.i, g.j): round(g.p * 300) for g in cm.coassignment(df, chunk).collect()} == {k: n for k, n in want.items() if n}
    made.clear()
    assert {(g.i, g.j): round(g.p * 300) for g in cm.coassignment(df, chunk, 0.34).collect()} == {k: n for k, n in want.items() if n >= 102}
    assert made["pairs"].filter("single").count() == made["pairs"].count()


def test_attached_nodes_are_drawn_in_blocks():
    """m different neighbours each, more for older nodes, and a random number call for a block and for each double draw only."""
    rng, calls = np.random.default_rng(2), []

    class Counted:
        def random(self, size):
            calls.append(size)
            return rng.random(size)

        def integers(self, low, high):
            calls.append(high)
            return rng.integers(low, high)

    degree = cm.attached(20_000, 3, Counted())
    assert degree.sum() == 2 * 3 * (20_000 - 3) and degree[3:].min() == 3 and len(calls) < 300
    assert degree[:20].mean() > 50 * degree[-2000:].mean() / 3
    assert [cm.attached(n, 3, rng).tolist() for n in (2, 3, 4)] == [[0, 0], [0, 0, 0], [1, 1, 1, 3]]
    assert all(sorted(cm.attached(5, 3, rng).tolist()) in ([1, 2, 2, 3, 4], [2, 2, 2, 3, 3]) for _ in range(20))


def test_graphs_are_not_put_into_one_task(spark):
    rows = [(g, k, k + 1) for g in range(20) for k in range(5)]
    made = cm.null_modularity(spark.createDataFrame(rows, "graph long, src long, dst long"))
    assert made.rdd.getNumPartitions() > 20 and made.count() == 20


def test_lists_and_arrays_move_nodes_alike(monkeypatch):
    rng, n = np.random.default_rng(6), 2000
    key = np.unique(rng.integers(0, n, (3000, 2)) @ np.array([n, 1]))
    a, b = key // n, key % n
    a, b, w = a[a < b], b[a < b], rng.integers(1, 4, (a < b).sum()).astype(float)
    used, few = [], cm._few
    monkeypatch.setattr(cm, "_few", lambda *args: used.append(1) or few(*args))
    one = cm.louvain(n, a, b, w, 3)
    assert used and len(set(one.tolist())) < n
    monkeypatch.setattr(cm, "LISTED", 0)
    label = cm.louvain(n, a, b, w, 3)
    q = [sum(w[x[a] == x[b]]) / w.sum() - ((np.bincount(x[np.append(a, b)], np.append(w, w)) / (2 * w.sum())) ** 2).sum() for x in (one, label)]
    assert q[0] == pytest.approx(q[1], abs=0.02) and q[0] > 0.7
