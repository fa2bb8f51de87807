"""Connected components of an edge table, by contraction."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..storage import written

#: parts that the rows of one key are dealt over where many may share it
SALTS = 16
#: edges that may be settled at once by one task; the bound chooses the way and not the result
SMALL = 200_000


def _settled(pdfs):
    """node, parent: the smallest node of each node's component, of few edges (a, b)."""
    rows = pd.concat([pd.DataFrame({"a": np.zeros(0, np.int64), "b": np.zeros(0, np.int64)}), *pdfs])
    node, at = np.unique(np.concatenate([rows["a"], rows["b"]]), return_inverse=True)
    label = list(range(len(node)))

    def root(x):
        while label[x] != x:
            label[x] = label[label[x]]
            x = label[x]
        return x

    for a, b in zip(at[: len(rows)].tolist(), at[len(rows) :].tolist()):
        a, b = root(a), root(b)
        label[max(a, b)] = min(a, b)
    yield pd.DataFrame({"node": node, "parent": node[[root(x) for x in label]] if len(node) else node})


def components(edges: DataFrame, small: int = 0) -> DataFrame:
    """node, component (its smallest node) of every node of edges (a, b). Each round orders the nodes, maps every node to the first of
    itself and its neighbours, and keeps the distinct edges between different images. The first two rounds take the nodes' own order, in
    which a graph of links to smallest nodes is settled at once; the others order them by a hash of their own. By a random order a path
    or a star loses a share of its nodes, whatever their numbers are, so rounds grow with the logarithm of the number of nodes. Nothing of
    it goes through the driver. Once no more than small edges (of long ids) are left, one task settles them."""
    left = written(edges.selectExpr("least(a, b) a", "greatest(a, b) b").filter("a < b").distinct(), "edges")
    steps = []
    while many := left.limit(small + 1).count():
        if many <= small:
            steps.append(written(left.coalesce(1).mapInPandas(_settled, "node long, parent long"), "parents"))
            break
        first = f"xxhash64({{0}}, {len(steps)})" if len(steps) > 1 else "0L"
        order = lambda c: f"struct({first.format(c)} h, {c} node)"
        both = left.selectExpr("a node", f"{order('b')} other").union(left.selectExpr("b", order("a")))
        low = both.groupBy("node").agg(F.min("other").alias("m")).selectExpr("node", f"least(m, {order('node')}).node parent")
        low = written(low, "parents")
        steps.append(low)
        moved = left.join(low.selectExpr("node a", "parent pa"), "a").join(low.selectExpr("node b", "parent pb"), "b")
        left = written(moved.selectExpr("least(pa, pb) a", "greatest(pa, pb) b").filter("a < b").distinct(), "edges")
    if not steps:
        return left.selectExpr("a node", "b component")
    out = steps[-1].selectExpr("node", "parent root")
    for step in reversed(steps[:-1]):
        # a parent without an entry of its own was not joined to anything any more
        out = written(salted(step, out.withColumnRenamed("node", "parent"), "parent", "node", "left").selectExpr("node", "coalesce(root, parent) root"), "components")
    return salted(out, out.groupBy("root").agg(F.min("node").alias("component")), "root", "node").select("node", "component")


def salted(rows: DataFrame, few: DataFrame, key: str, spread: str, how: str = "inner") -> DataFrame:
    """rows joined to few, which has a key once: the rows of a key are dealt over SALTS by the column spread, so that no key is one task."""
    salt = F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1)))
    rows = rows.withColumn("_salt", F.pmod(F.xxhash64(spread), F.lit(SALTS)).cast("int"))
    return rows.join(few.withColumn("_salt", salt), [key, "_salt"], how).drop("_salt")


def all_components(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """node, component of every node of nodes (node), those without edges included."""
    found = components(edges.selectExpr("src a", "dst b"), SMALL)
    return nodes.join(found, "node", "left").select("node", F.coalesce("component", "node").alias("component"))
