"""Impact of single nodes and removal curves against searches of the whole graph."""

import hashlib
import random

import pytest
from pyspark.sql import functions as F
from weft.operators import biconnected as bc
from weft.operators import robustness as rb
from weft.operators.components import components


def largest(nodes, edges):
    near = {v: [] for v in nodes}
    for a, b in edges:
        if a in near and b in near:
            near[a].append(b)
            near[b].append(a)
    seen, most = set(), 0
    for v in nodes:
        stack, size = [v] if v not in seen else [], 0
        seen.add(v)
        while stack:
            x = stack.pop()
            size += 1
            for y in near[x]:
                if y not in seen:
                    seen.add(y)
                    stack.append(y)
        most = max(most, size)
    return most


def shapes():
    """A path, a ring, a star, two cliques with a bridge, a tree with extra edges, a ladder and single nodes, numbered at random."""
    rng = random.Random(11)
    edges = [(i, i + 1) for i in range(9)] + [(20 + i, 20 + (i + 1) % 6) for i in range(6)] + [(40, 41 + i) for i in range(7)]
    edges += [(60 + i, 60 + j) for i in range(4) for j in range(i)] + [(70 + i, 70 + j) for i in range(4) for j in range(i)] + [(63, 70)]
    edges += [(100 + i, 100 + rng.randrange(i)) for i in range(1, 45)] + [(100 + rng.randrange(45), 100 + rng.randrange(45)) for _ in range(9)]
    edges += [(200 + i, 202 + i) for i in range(8)] + [(200, 201), (208, 209)]
    name = {v: k for k, v in enumerate(rng.sample(range(300), 300))}
    edges = sorted({(min(name[a], name[b]), max(name[a], name[b])) for a, b in edges if a != b})
    return sorted({v for e in edges for v in e} | {name[290], name[291]}), edges


def frames(spark, nodes, edges):
    return spark.createDataFrame([(v,) for v in nodes], "node long"), spark.createDataFrame(edges, "src long, dst long").repartition(3)


def test_impact_of_each_node(spark):
    nodes, edges = shapes()
    v, e = frames(spark, nodes, edges)
    got = {r.node: r.largest for r in bc.pieces(v, e).collect()}
    assert got == {x: largest([y for y in nodes if y != x], edges) for x in nodes}


def test_tree_and_blocks(spark):
    nodes, edges = shapes()
    _, e = frames(spark, nodes, edges)
    rows = {r.node: r for r in bc.blocks(e, components(e.selectExpr("src a", "dst b"))).collect()}
    linked = {frozenset(x) for x in edges}
    for r in rows.values():
        assert r.parent is None or frozenset((r.node, r.parent)) in linked
        below = [x for x in rows.values() if r.pre <= x.pre < r.pre + r.size]
        assert len(below) == r.size and all(x.node == r.node or r.pre <= rows[x.parent].pre for x in below)
    # two tree edges are of one block if and only if no single node or edge parts them: removal of any edge's block keeps it whole
    bridges = {frozenset(x) for x in edges if largest_parts(nodes, edges) < largest_parts(nodes, [y for y in edges if y != x])}
    alone = {frozenset((r.node, r.parent)) for r in rows.values() if r.parent is not None and sum(x.block == r.block for x in rows.values() if x.parent is not None) == 1}
    assert alone == bridges


def largest_parts(nodes, edges):
    label = {v: v for v in nodes}

    def root(x):
        while label[x] != x:
            x = label[x]
        return x

    for a, b in edges:
        label[root(a)] = root(b)
    return len({root(v) for v in nodes})


@pytest.mark.parametrize("graph", [([], []), ([5], []), ([1, 2, 3], []), ([1, 2], [(1, 2)])])
def test_impact_of_small_graphs(spark, graph):
    v, e = frames(spark, *graph)
    assert {r.node: r.largest for r in bc.pieces(v, e).collect()} == {x: largest([y for y in graph[0] if y != x], graph[1]) for x in graph[0]}


@pytest.mark.parametrize("block", [1 << 18, 6])
def test_curves(spark, block):
    nodes, edges = shapes()
    v, e = frames(spark, nodes, edges)
    orders = rb.random_orders(v, 3).union(rb.attack_order(v.withColumn("s", F.expr("node % 7")), "s", "attack"))
    got = {}
    for r in rb.curves(v, e, orders, block).collect():
        got.setdefault(r.order_id, {})[r.step] = r.fraction
    want = {"attack": sorted(nodes, key=lambda x: (-(x % 7), x))} | {f"random{t}": sorted(nodes, key=lambda x: hashlib.md5(f"42-{t}-{x}".encode()).hexdigest()) for t in range(3)}
    assert got.keys() == want.keys()
    for name, order in want.items():
        assert got[name] == pytest.approx({s: largest(order[s:], edges) / len(nodes) for s in range(len(nodes) + 1)})


def test_curve_without_edges(spark):
    v, e = frames(spark, [3, 4], [])
    assert sorted(tuple(r) for r in rb.curves(v, e, rb.random_orders(v, 1)).collect()) == [("random0", 0, 0.5), ("random0", 1, 0.5), ("random0", 2, 0.0)]


def test_a_whole_graph_is_replayed_without_rows_of_edges_by_order(spark, monkeypatch):
    """The same curves as by blocks; an order's edges are no table."""
    import numpy as np

    rng = np.random.default_rng(8)
    pairs = sorted({(min(x, y), max(x, y)) for x, y in rng.integers(0, 70, (90, 2)).tolist() if x != y})
    e = spark.createDataFrame(pairs, "src long, dst long")
    v = spark.createDataFrame([(k,) for k in range(75)], "node long")
    orders = rb.random_orders(v, 9).cache()
    want = sorted(tuple(r) for r in rb.curves(v, e, orders, 20).collect())
    made, kept = [], rb.written
    monkeypatch.setattr(rb, "written", lambda df, name="t": made.append(name) or kept(df, name))
    assert sorted(tuple(r) for r in rb.curves(v, e, orders).collect()) == want
    assert made == ["orders", "edges"]
    monkeypatch.setattr(rb, "WHOLE", 10)
    assert sorted(tuple(r) for r in rb.curves(v, e, orders).collect()) == want
