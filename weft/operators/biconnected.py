"""Biconnected blocks of a simple undirected graph by joins, in logarithmic rounds: a spanning forest by Boruvka's rounds, the forest rooted
by ranking its Euler tour, lowest and highest preorder numbers over subtrees by doubling, and blocks as the components of tree edges
that lie on a common cycle. Nothing of the graph goes through the driver, and rows of a hub are salted or met by keys of pairs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..storage import written
from .components import SMALL, components, salted
from .graph import ranked


def spanning_forest(edges: DataFrame) -> DataFrame:
    """src, dst of a spanning forest of edges (src < dst, distinct). In each round every part takes its first edge to another part, in the
    order of (src, dst), which no cycle can come of; parts at least halve."""
    left, taken = written(edges.selectExpr("src", "dst", "src a", "dst b"), "edges"), None
    while left.limit(1).count():
        ends = left.selectExpr("a c", "struct(src, dst, a, b) e").union(left.selectExpr("b", "struct(src, dst, a, b)"))
        chosen = written(ends.groupBy("c").agg(F.min("e").alias("e")).select("e.*").distinct(), "chosen")
        taken = chosen.select("src", "dst") if taken is None else taken.union(chosen.select("src", "dst"))
        part = components(chosen.select("a", "b"), SMALL)
        for end, other in (("a", "b"), ("b", "a")):
            left = salted(left, part.selectExpr(f"node {end}", "component"), end, other).drop(end).withColumnRenamed("component", end)
        # of parallel edges the first is enough
        left = left.filter("a <> b").groupBy(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).agg(F.min(F.struct("src", "dst")).alias("e")).select("e.src", "e.dst", "a", "b")
        left = written(left, "edges")
    return left.select("src", "dst") if taken is None else taken


def tour(forest: DataFrame, roots: DataFrame) -> DataFrame:
    """src, dst, after: each direction of the forest's edges, and how many arcs follow it in its tree's tour. An arc is followed by the one
    that comes after its reverse among the arcs of their common end, in a circle; a tour ends before its root's first arc."""
    both = forest.select("src", "dst").union(forest.select("dst", "src"))
    arcs = written(ranked(both, [F.col("src"), F.col("dst")], "id"), "arcs")
    ring = arcs.groupBy("src").agg(F.min("id").alias("first"), F.max("id").alias("last"))
    ring = ring.join(roots.select(F.col("root").alias("src"), F.lit(True).alias("is_root")), "src", "left")
    # the reverse of an arc has its number, and the ring of the arc's end tells what follows
    back = salted(arcs, ring, "src", "dst").select(F.col("dst").alias("src"), F.col("src").alias("dst"), F.expr("if(id < last, id + 1, if(is_root, null, first)) next"))
    step = arcs.join(back, ["src", "dst"]).selectExpr("src", "dst", "id", "next", "if(next is null, 0L, 1L) after")
    step = written(step, "tour")
    while step.filter("next is not null").limit(1).count():
        ahead = step.selectExpr("id next", "next further", "after more")
        going = step.filter("next is not null").join(ahead, "next").selectExpr("src", "dst", "id", "further next", "after + more after")
        step = written(step.filter("next is null").union(going), "tour")  # ended ones take no part: they have one key
    return step.select("src", "dst", "after")


def rooted(edges: DataFrame, parts: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The forest's edges (src < dst), and node, parent (null for a root), root, pre, size of every node of edges: preorder numbers, from 1
    through all trees, and the nodes of the subtree, which have the numbers from pre on. parts: node, component (the smallest node)."""
    forest = written(spanning_forest(edges), "forest")
    trees = parts.groupBy("component").agg(F.count("*").alias("size")).filter("size > 1")
    arcs = tour(forest, trees.select(F.col("component").alias("root")))
    down = arcs.join(arcs.selectExpr("src dst", "dst src", "after back"), ["src", "dst"]).filter("after > back")
    nodes = down.selectExpr("dst node", "src parent", "(after - back + 1) div 2 size", "after").join(parts.selectExpr("node", "component root"), "node")
    tops = trees.selectExpr("component node", "cast(null as long) parent", "size", f"{(1 << 63) - 1}L after", "component root")
    every = nodes.select("node", "parent", "size", "after", "root").union(tops)
    return forest, written(ranked(every, [F.col("root"), F.desc("after")], "pre").select("node", "parent", "root", F.col("pre").cast("long").alias("pre"), "size"), "rooted")


def reach(tree: DataFrame, loose: DataFrame) -> DataFrame:
    """node, low, high: least and greatest preorder number that the node's subtree has, or has an edge outside the forest to. Minima over
    stretches of 2, 4, 8, ... numbers are made of those before; a subtree is two stretches that overlap. loose: a, pre_b, both ways."""
    own = loose.groupBy(F.col("a").alias("node")).agg(F.min("pre_b").alias("lo"), F.max("pre_b").alias("hi"))
    level = written(tree.join(own, "node", "left").selectExpr("pre at", "least(pre, coalesce(lo, pre)) low", "greatest(pre, coalesce(hi, pre)) high"), "stretches")
    largest = tree.filter("parent is not null").agg(F.max("size").alias("m")).first().m or 0
    width, out = 1, None
    while width <= largest:
        asked = tree.filter(f"parent is not null and size >= {width} and size < {2 * width}").selectExpr("node", f"explode(array(pre, pre + size - {width}L)) at")
        found = asked.join(level, "at").groupBy("node").agg(F.min("low").alias("low"), F.max("high").alias("high"))
        out = found if out is None else out.union(found)
        width *= 2
        if width <= largest:
            ahead = level.selectExpr(f"at - {width // 2}L at", "low low2", "high high2")
            level = written(level.join(ahead, "at", "left").selectExpr("at", "least(low, low2) low", "greatest(high, high2) high"), "stretches")
    return out if out is not None else level.selectExpr("at node", "low", "high").filter("false")


def blocks(edges: DataFrame, parts: DataFrame) -> DataFrame:
    """node, parent, root, pre, size, block of every node of edges (src < dst): the tree as in rooted, and the biconnected block of the edge
    to the parent, named by its smallest such node (null for a root)."""
    forest, tree = rooted(edges, parts)
    place = tree.select("node", "pre", "size")
    loose = edges.join(forest, ["src", "dst"], "left_anti").selectExpr("src a", "dst b")
    for end, other in (("a", "b"), ("b", "a")):
        loose = salted(loose, place.selectExpr(f"node {end}", f"pre pre_{end}", f"size size_{end}"), end, other)
    loose = written(loose, "loose")
    found = reach(tree, loose.select("a", "pre_b").union(loose.selectExpr("b", "pre_a")))
    apart = loose.filter("pre_a + size_a <= pre_b or pre_b + size_b <= pre_a").select("a", "b")
    # a child's edge is on a cycle with its parent's own edge if its subtree gets out of the parent's
    above = tree.filter("parent is not null").selectExpr("node parent", "pre", "size", "true inner")
    hanging = salted(tree.filter("parent is not null").select("node", "parent").join(found, "node"), above, "parent", "node")
    up = hanging.filter("low < pre or high >= pre + size").selectExpr("node a", "parent b")
    block = components(apart.union(up), SMALL).withColumnRenamed("component", "block")
    return written(tree.join(block, "node", "left").withColumn("block", F.expr("if(parent is null, null, coalesce(block, node))")), "blocks")


def pieces(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """node, largest: the size of the largest component that is left when that node alone is gone, of every node of nodes (node); edges: src <
    dst, distinct. A node's removal parts off the subtrees of its children by blocks other than its own; all else of its component stays
    together."""
    parts = components(edges.selectExpr("src a", "dst b"), SMALL)
    sizes = parts.groupBy("component").agg(F.count("*").alias("whole"))
    top = sizes.orderBy(F.desc("whole"), "component").limit(2).collect()
    first, whole, second = (top[0].component, top[0].whole, top[1].whole if len(top) > 1 else 1) if top else (None, 1, 1)
    tree = blocks(edges, parts)
    own = tree.selectExpr("node parent", "block own")
    cut = salted(tree.filter("parent is not null").select("node", "parent", "block", "size"), own, "parent", "node").filter("own is null or own <> block")
    cut = cut.groupBy("parent", "block").agg(F.sum("size").alias("piece")).groupBy(F.col("parent").alias("node")).agg(F.max("piece").alias("piece"), F.sum("piece").alias("off"))
    rows = tree.join(cut, "node", "left").join(sizes.withColumnRenamed("component", "root"), "root")
    rows = rows.selectExpr("node", f"greatest(coalesce(piece, 0), whole - 1 - coalesce(off, 0), {f'if(root = {first}L, {second}L, {whole}L)' if top else '0L'}) largest")
    many = nodes.agg(F.count("*").alias("many"))
    return nodes.join(rows, "node", "left").join(many).selectExpr("node", f"cast(coalesce(largest, {f'{whole}L' if top else 'if(many > 1, 1L, 0L)'}) as long) largest")
