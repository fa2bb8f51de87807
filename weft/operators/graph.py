"""Relational graph operators. A directed graph is nodes (node) and distinct edges (src, dst); nodes never derive from edges."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..storage import written


def build(edges: DataFrame) -> DataFrame:
    """Distinct edges; a self loop stays one."""
    return edges.select("src", "dst").dropDuplicates()


def without_loops(edges: DataFrame) -> DataFrame:
    return edges.filter("src <> dst")


def undirect(edges: DataFrame) -> DataFrame:
    """Simple undirected edges, src < dst."""
    return without_loops(edges).select(F.least("src", "dst").alias("src"), F.greatest("src", "dst").alias("dst")).distinct()


def with_reverse(edges: DataFrame) -> DataFrame:
    """edges with mutual: whether the reverse edge is there."""
    back = edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"), F.lit(True).alias("mutual"))
    return edges.join(back, ["src", "dst"], "left").withColumn("mutual", F.coalesce("mutual", F.lit(False)))


def reciprocity(edges: DataFrame) -> DataFrame:
    """m_dir, mutual_pairs, one_way, m_undirected of edges without loops."""
    flags = with_reverse(without_loops(edges))
    return flags.agg(
        F.count("*").alias("m_dir"),
        F.sum(F.expr("if(mutual and src < dst, 1L, 0L)")).alias("mutual_pairs"),
        F.sum(F.expr("if(mutual, 0L, 1L)")).alias("one_way"),
        F.sum(F.expr("if(mutual and src > dst, 0L, 1L)")).alias("m_undirected"),
    )


def direction(edges: DataFrame) -> DataFrame:
    """One row of each linked pair (s < t) with dir: mutual, st or ts."""
    both = without_loops(edges).groupBy(F.least("src", "dst").alias("s"), F.greatest("src", "dst").alias("t"))
    both = both.agg(F.bool_or(F.col("src") < F.col("dst")).alias("st"), F.bool_or(F.col("src") > F.col("dst")).alias("ts"))
    return both.select("s", "t", F.expr("case when st and ts then 'mutual' when st then 'st' else 'ts' end").alias("dir"))


def degrees(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """node, in_degree, out_degree, degree (undirected, simple); zeros kept."""
    into = edges.groupBy(F.col("dst").alias("node")).agg(F.count("*").alias("in_degree"))
    out = edges.groupBy(F.col("src").alias("node")).agg(F.count("*").alias("out_degree"))
    simple = undirect(edges).select(F.explode(F.array("src", "dst")).alias("node")).groupBy("node").agg(F.count("*").alias("degree"))
    return nodes.join(into, "node", "left").join(out, "node", "left").join(simple, "node", "left").na.fill(0, ["in_degree", "out_degree", "degree"])


def isolates(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    touched = without_loops(edges).select(F.explode(F.array("src", "dst")).alias("node")).distinct()
    return nodes.join(touched, "node", "left_anti")


def adjacency(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """node, successors, predecessors: sorted arrays."""
    out = edges.groupBy(F.col("src").alias("node")).agg(F.sort_array(F.collect_list("dst")).alias("successors"))
    into = edges.groupBy(F.col("dst").alias("node")).agg(F.sort_array(F.collect_list("src")).alias("predecessors"))
    empty = F.expr("cast(array() as array<long>)")
    return nodes.join(out, "node", "left").join(into, "node", "left").select("node", F.coalesce("successors", empty).alias("successors"), F.coalesce("predecessors", empty).alias("predecessors"))


def counts(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """n, m_dir, m, isolates, mean_degree in one row."""
    one = nodes.agg(F.count("*").alias("n"))
    many = without_loops(edges).agg(F.count("*").alias("m_dir"))
    m = undirect(edges).agg(F.count("*").alias("m"))
    alone = isolates(nodes, edges).agg(F.count("*").alias("isolates"))
    rows = one.join(many).join(m).join(alone)  # four rows of totals
    return rows.withColumn("mean_degree", F.round(2 * F.col("m") / F.col("n"), 6))


def neighbors(edges: DataFrame, node) -> DataFrame:
    """The ego network's nodes of one node, itself left out."""
    return undirect(edges).filter((F.col("src") == node) | (F.col("dst") == node)).select(F.when(F.col("src") == node, F.col("dst")).otherwise(F.col("src")).alias("node"))


def component_sizes(components: DataFrame) -> DataFrame:
    """component, size, rank by size (ties: the smaller component id)."""
    sizes = components.groupBy("component").agg(F.count("*").alias("size"))
    return ranked(sizes, [F.desc("size"), F.asc("component")])


def ranked(rows: DataFrame, order: list, name: str = "rank") -> DataFrame:
    """rows with their rank (from 1) by order, which has no ties: ranges are sorted, each in a task of its own, and the rows of the ranges
    before are added."""
    parts = written(rows.repartitionByRange(*order).withColumn("_part", F.spark_partition_id()), "ranges")
    before = parts.groupBy("_part").agg(F.count("*").alias("n")).withColumn("_before", F.coalesce(F.sum("n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))  # a row for each range
    place = F.row_number().over(Window.partitionBy("_part").orderBy(*order))
    return parts.withColumn("_place", place).join(F.broadcast(before.select("_part", "_before")), "_part").withColumn(name, F.col("_before") + F.col("_place")).drop("_part", "_place", "_before")


def component_labels(components: DataFrame) -> DataFrame:
    """node, label: giant, second, or isolate for all that is in neither. Only the two largest are ranked."""
    top = components.groupBy("component").agg(F.count("*").alias("size")).orderBy(F.desc("size"), "component").limit(2)
    top = top.withColumn("label", F.when(F.row_number().over(Window.orderBy(F.desc("size"), "component")) == 1, "giant").otherwise("second"))
    return components.join(F.broadcast(top), "component", "left").select("node", F.coalesce("label", F.lit("isolate")).alias("label"))


def giant(components: DataFrame, edges: DataFrame) -> DataFrame:
    """Simple undirected edges of the largest component."""
    top = components.groupBy("component").agg(F.count("*").alias("size")).orderBy(F.desc("size"), "component").limit(1)
    members = components.join(F.broadcast(top), "component", "left_semi").select("node")
    return undirect(edges).join(members.withColumnRenamed("node", "src"), "src", "left_semi")


def combined_weights(edges: DataFrame) -> DataFrame:
    """Weighted simple graph: both directions and parallel edges summed, loops dropped."""
    return without_loops(edges).groupBy(F.least("src", "dst").alias("src"), F.greatest("src", "dst").alias("dst")).agg(F.sum("weight").alias("weight"))


def strengths(edges: DataFrame) -> DataFrame:
    """node, degree, strength of a weighted simple graph."""
    ends = edges.select(F.explode(F.array("src", "dst")).alias("node"), "weight")
    return ends.groupBy("node").agg(F.count("*").alias("degree"), F.sum("weight").alias("strength"))


def disparity(edges: DataFrame) -> DataFrame:
    """edges with p, the smaller of both ends' (1 - w / strength) ** (degree - 1); 1 at an end of degree 1."""
    s = strengths(edges)
    end = lambda c: s.select(F.col("node").alias(c), F.col("degree").alias(f"k_{c}"), F.col("strength").alias(f"s_{c}"))
    rows = edges.join(end("src"), "src").join(end("dst"), "dst")
    p = lambda c: F.when(F.col(f"k_{c}") <= 1, F.lit(1.0)).otherwise(F.pow(1 - F.col("weight") / F.col(f"s_{c}"), F.col(f"k_{c}") - 1))
    return rows.select("src", "dst", "weight", F.least(p("src"), p("dst")).alias("p"))


def modularity(edges: DataFrame, labels: DataFrame, weight: str | None = None) -> DataFrame:
    """q of the partition labels (node, community): sum over communities of inner weight / m - (degrees / 2m) ** 2."""
    w = F.col(weight).cast("double") if weight else F.lit(1.0)
    rows = edges.select("src", "dst", w.alias("w"))
    lab = lambda c, n: labels.select(F.col("node").alias(c), F.col("community").alias(n))
    rows = rows.join(lab("src", "ca"), "src").join(lab("dst", "cb"), "dst")
    ends = rows.select(F.explode(F.array(F.struct(F.col("ca").alias("c"), F.col("w"), F.expr("if(ca = cb, w, 0d)").alias("inner")), F.struct(F.col("cb").alias("c"), F.col("w"), F.lit(0.0).alias("inner")))).alias("x")).select("x.*")
    per = ends.groupBy("c").agg(F.sum("w").alias("d"), F.sum("inner").alias("l"))
    # sum of l/m - (d/2m)^2 with 2m the sum of all d
    total = per.agg(F.sum("d").alias("dd"), F.sum("l").alias("ll"), F.sum(F.col("d") * F.col("d")).alias("d2"))
    return total.select(F.expr("ll / (dd / 2) - d2 / (dd * dd)").alias("q"))


def nmi(a: DataFrame, b: DataFrame) -> DataFrame:
    """Normalised mutual information (arithmetic mean of entropies) of two labellings (node, community)."""
    both = a.select("node", F.col("community").alias("x")).join(b.select("node", F.col("community").alias("y")), "node")
    cells = both.groupBy("x", "y").agg(F.count("*").alias("n"))
    rows = cells.groupBy("x").agg(F.sum("n").alias("nx"))
    cols = cells.groupBy("y").agg(F.sum("n").alias("ny"))
    total = cells.agg(F.sum("n").cast("double").alias("t"))
    mi = cells.join(rows, "x").join(cols, "y").join(total).agg(F.sum(F.expr("n / t * ln(n * t / (nx * ny))")).alias("mi"))
    h = lambda d, c, name: d.join(total).agg((-F.sum(F.expr(f"{c} / t * ln({c} / t)"))).alias(name))
    out = mi.join(h(rows, "nx", "hx")).join(h(cols, "ny", "hy"))
    return out.select(F.expr("case when hx + hy = 0 then 1d else 2 * mi / (hx + hy) end").alias("nmi"))
