"""Largest component under removal of nodes. A removal order is rows (order_id, node, pos). Seen backwards, an edge is there as soon as
its end that is removed first comes back, so a curve is what the edges merge in the order of that time.

The edges of an order are cut into blocks of BLOCK by time. What lies before a block is contracted: halves of the time line are taken
in turn, for all orders at once, and the later half's ends become the components of the earlier half's edges, with their sizes. So
after a number of rounds that grows with the logarithm of the number of blocks each block is replayed by itself, and no task
holds more of a graph than a block. That is for graphs of many edges; one of WHOLE edges or fewer is sent in packs to the tasks that
replay the orders."""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..storage import written
from .biconnected import pieces
from .components import components, salted
from .graph import ranked
from .packs import batches, packed, unpacked

BLOCK = 1 << 18
#: edges of a graph that is replayed as a whole, at most, and tasks that its orders are dealt out to
WHOLE, PARTS = 4_000_000, 64


def attack_order(scores: DataFrame, score: str, name: str) -> DataFrame:
    """order_id, node, pos: nodes by falling score, ties by node."""
    rows = ranked(scores.select("node", F.col(score).alias("s")), [F.desc("s"), F.col("node")], "pos")
    return rows.select(F.lit(name).alias("order_id"), "node", (F.col("pos") - 1).cast("long").alias("pos"))


def random_orders(nodes: DataFrame, trials: int = 200, seed: int = 42) -> DataFrame:
    """order_id, node, pos: in trial t nodes go by the digest of seed, t and node."""
    key = F.md5(F.concat_ws("-", F.lit(seed), "t", "node"))
    rows = nodes.select("node").withColumn("t", F.explode(F.sequence(F.lit(0), F.lit(trials - 1)))).withColumn("h", key)
    many = nodes.agg(F.count("*").alias("many"))
    return ranked(rows, [F.col("t"), F.col("h"), F.col("node")], "pos").join(many).selectExpr("concat('random', t) order_id", "node", "pmod(pos - 1L, many) pos")


def _timed(edges: DataFrame, orders: DataFrame, block: int) -> tuple[DataFrame, int]:
    """order_id, leaf, g, t, a, b, sa, sb: edges by the time t at which they come, each with its block, its ends and their sizes (1); and the
    number of the last block."""
    rows = edges.select("src", "dst")
    # both sides have many rows of a node, so a hub is left to the splitting of skewed joins and neither is copied for salts
    rows = rows.join(orders.selectExpr("node src", "order_id", "pos pa"), "src").join(orders.selectExpr("order_id", "node dst", "pos pb"), ["order_id", "dst"])
    rows = rows.selectExpr("order_id", "src a", "dst b", "least(pa, pb) t")
    rows = written(ranked(rows, [F.col("order_id"), F.desc("t"), F.col("a"), F.col("b")], "g"), "timed")
    firsts = rows.groupBy("order_id").agg(F.min("g").alias("first"))  # a row for each order
    rows = rows.join(F.broadcast(firsts), "order_id").selectExpr("order_id", f"(g - first) div {block} leaf", "g", "t", "a", "b", "1L sa", "1L sb")
    return rows, rows.agg(F.max("leaf")).first()[0] or 0


def _contracted(rows: DataFrame, last: int) -> DataFrame:
    """rows whose ends are the components, with their sizes, of all edges of the blocks before their own."""
    for k in reversed(range(int(last).bit_length())):
        rows = written(rows.withColumn("seg", F.shiftright("leaf", k + 1)).withColumn("late", F.expr(f"shiftright(leaf, {k}) & 1 = 1")), "halves")
        key = lambda c: f"struct(order_id, seg, {c} node)"
        early = rows.filter("not late")
        part = components(early.selectExpr(f"{key('a')} a", f"{key('b')} b"))
        size = early.selectExpr(f"{key('a')} node", "sa s").union(early.selectExpr(key("b"), "sb")).groupBy("node").agg(F.first("s").alias("s"))
        whole = part.join(size, "node").groupBy("component").agg(F.sum("s").alias("s"))
        now = salted(part, whole, "component", "node").selectExpr("node", "component.node to", "s")
        late = rows.filter("late")
        for end, other in (("a", "b"), ("b", "a")):
            late = salted(late.withColumn("k", F.expr(key(end))), now.withColumnRenamed("node", "k"), "k", other, "left")
            late = late.withColumns({end: F.coalesce("to", end), f"s{end}": F.coalesce("s", f"s{end}")}).drop("k", "to", "s")
        rows = early.unionByName(late).drop("seg", "late")
    return rows


def _replay(pdf: pd.DataFrame) -> pd.DataFrame:
    """order_id, leaf, t, until, size: from step t down to, but without, until (null: the block's end) the largest component that an edge of
    the block has made has this size."""
    pdf = pdf.sort_values("g")
    ids, at = np.unique(np.concatenate([pdf["a"], pdf["b"]]), return_inverse=True)
    parent, size = list(range(len(ids))), np.zeros(len(ids), np.int64)
    size[at] = np.concatenate([pdf["sa"], pdf["sb"]])
    size, most, steps, sizes = size.tolist(), 0, [], []

    def root(x):
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for t, a, b in zip(pdf["t"].tolist(), at[: len(pdf)].tolist(), at[len(pdf) :].tolist()):
        a, b = root(a), root(b)
        if a != b:
            if size[a] < size[b]:
                a, b = b, a
            parent[b] = a
            size[a] += size[b]
        if size[a] > most:
            most = size[a]
            if steps and steps[-1] == t:
                sizes[-1] = most
            else:
                steps.append(t)
                sizes.append(most)
    return pd.DataFrame({"order_id": pdf["order_id"].iloc[0], "leaf": pdf["leaf"].iloc[0], "t": steps, "until": pd.array([*steps[1:], None], "Int64"), "size": sizes})


def _runs(rows):
    """part, order, then node, next and data of each run of rows of one part and order (None: the graph's packs)."""
    for some in rows:
        part, order = some.column("part").to_numpy(), some.column("order_id")
        code = order.dictionary_encode().indices.fill_null(-1).to_numpy(zero_copy_only=False)
        ends = np.flatnonzero(np.append((part[1:] != part[:-1]) | (code[1:] != code[:-1]), True)) + 1 if len(part) else []
        start = 0
        for end in ends:
            yield int(part[start]), order[int(start)].as_py(), some.slice(start, end - start)
            start = end


def _replayed(rows, many: int):
    """order_id, step, fraction of each order."""
    at, packs, graph, node, pos = (None, None), [], None, [], []

    def out():
        return _curve(at[1], graph, np.concatenate(node), np.concatenate(pos), many)

    for part, order, some in _runs(rows):
        if at != (part, order):
            if node:
                yield from out()
            if at[0] != part:
                packs, graph = [], None
            at, node, pos = (part, order), [], []
        if order is None:
            packs += [(n, x.as_buffer()) for n, x in zip(some.column("n").to_pylist(), some.column("data"))]
            continue
        if graph is None:
            ids, first, b, _ = unpacked(packs) if packs else (np.zeros(0, np.int64), np.zeros(1, np.int64), np.zeros(0, np.int32), None)
            a = np.repeat(np.arange(len(ids), dtype=np.int32), np.diff(first))
            graph, packs = (ids, a[a < b], b[a < b]), []
        node.append(some.column("node").to_numpy())
        pos.append(some.column("next").to_numpy())
    if node:
        yield from out()


def _curve(order: str, graph, node: np.ndarray, pos: np.ndarray, many: int):
    """The curve of one order (pos of node, by node) on a graph (ids, and edges between their places)."""
    ids, a, b = graph
    largest = np.ones(many + 1, np.int64)  # by step
    largest[many:] = 0
    if len(ids) and len(node):
        place = np.minimum(np.searchsorted(node, ids), len(node) - 1)
        when = np.where(node[place] == ids, pos[place], -1)
        t = np.minimum(when[a], when[b])
        line = np.argsort(-t, kind="stable")[: np.count_nonzero(t >= 0)]
        parent, size, most, start, block = np.arange(len(ids)), np.ones(len(ids), np.int64).tolist(), 1, 0, 1 << 10
        while start < len(line):
            some = line[start : start + block]
            start, block = start + block, min(2 * block, 1 << 16)
            ra, rb, ts = parent[a[some]], parent[b[some]], t[some]
            apart = ra != rb  # by now; the others change nothing
            up = parent.tolist()
            for x, y, s in zip(ra[apart].tolist(), rb[apart].tolist(), ts[apart].tolist()):
                while up[x] != x:
                    up[x] = up[up[x]]
                    x = up[x]
                while up[y] != y:
                    up[y] = up[up[y]]
                    y = up[y]
                if x != y:
                    if size[x] < size[y]:
                        x, y = y, x
                    up[y] = x
                    size[x] += size[y]
                    if size[x] > most:
                        largest[s] = most = size[x]
            parent = np.array(up)
            while (parent != (top := parent[parent])).any():
                parent = top
        largest[:many] = np.maximum.accumulate(largest[:many][::-1])[::-1]
    fraction = largest / many if many else np.zeros(1)
    for made in batches(["step", "fraction"], [np.arange(many + 1), fraction]):
        yield pa.RecordBatch.from_arrays([pa.array([order] * len(made)), *made.columns], names=["order_id", "step", "fraction"])


def curves(nodes: DataFrame, edges: DataFrame, orders: DataFrame, block: int | None = None) -> DataFrame:
    """order_id, step, fraction of the nodes in the largest component after so many removals; edges: src < dst, distinct; orders: order_id,
    node, pos (0, 1, ... for all nodes). block: edges are cut into blocks of so many; if not given, only where there are over WHOLE edges."""
    orders = written(orders, "orders")
    edges = written(edges.select("src", "dst"), "edges") if block is None else edges
    if block is None and edges.count() <= WHOLE:
        parts, many = max(1, min(PARTS, orders.select("order_id").distinct().count())), nodes.count()
        packs = packed(edges.selectExpr("true alone", "0L bag", f"{parts} parts", "src", "dst", "1D w"))
        packs = packs.select(F.explode(F.sequence(F.lit(0), F.lit(parts - 1))).alias("part"), F.lit(None).cast("string").alias("order_id"), "node", "next", "n", "data")
        rows = orders.selectExpr(f"cast(pmod(xxhash64(order_id), {parts}) as int) part", "order_id", "node", "pos next", "0 n", "cast(null as binary) data")
        rows = packs.unionByName(rows).repartition(parts, "part").sortWithinPartitions("part", "order_id", "node", "next")
        return rows.mapInArrow(lambda some: _replayed(some, many), "order_id string, step long, fraction double")
    return _cut(nodes, edges, orders, block or BLOCK)


def _cut(nodes: DataFrame, edges: DataFrame, orders: DataFrame, block: int) -> DataFrame:
    """curves by blocks of edges."""
    rows, last = _timed(edges, orders, block)
    rows = written(_contracted(rows, last), "contracted")
    made = written(rows.groupBy("order_id", "leaf").applyInPandas(_replay, "order_id string, leaf long, t long, until long, size long"), "merges")
    # a row for each block: the step that it begins with, the one that the next begins with, the largest component before it
    line = Window.partitionBy("order_id").orderBy("leaf")
    ranges = made.groupBy("order_id", "leaf").agg(F.max("t").alias("begin"), F.max("size").alias("most"))
    ranges = ranges.select("order_id", "leaf", F.lead("begin", 1, -1).over(line).alias("below"), F.max("most").over(line.rowsBetween(Window.unboundedPreceding, -1)).alias("before"))
    runs = made.join(ranges, ["order_id", "leaf"]).selectExpr("order_id", "t", "coalesce(until, below) until", "greatest(size, before) size").filter("until < t")
    many = nodes.agg(F.count("*").alias("many"))
    first = orders.select("order_id").distinct().join(made.groupBy("order_id").agg(F.max("t").alias("t")), "order_id", "left")
    alone = first.join(many).selectExpr("order_id", "many - 1 t", "coalesce(t, -1L) until", "1L size").filter("until < t")
    none = first.join(many).selectExpr("order_id", "many t", "many - 1 until", "0L size")
    every = runs.union(alone).union(none).selectExpr("order_id", "explode(sequence(until + 1, t)) step", "size")
    return every.join(many).selectExpr("order_id", "step", "if(many > 0, size / many, 0d) fraction")


def node_impact(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """node, impact: 1 less the share of the nodes that are in the largest component when that node alone is gone."""
    many = nodes.agg(F.count("*").alias("many"))
    return pieces(nodes, edges).join(many).selectExpr("node", "1 - largest / many impact")


def half_life(curve: DataFrame, level: float = 0.5) -> DataFrame:
    """order_id, step: the first step with at most this fraction."""
    return curve.filter(F.col("fraction") <= level).groupBy("order_id").agg(F.min("step").alias("step"))
