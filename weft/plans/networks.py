"""Queries on paths, robustness and communities. Random and iterative ones give checks that have one right answer."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import community as cm
from ..operators import components as cc
from ..operators import graph, paths
from ..operators import robustness as rb
from ..storage import written
from . import base as b
from .registry import query

_BFS = """two as (select src a, dst b from simple union all select dst, src from simple), walk(source, node, dist) as
  (select node, node, cast(0 as bigint) from nodes union select w.source, e.b, w.dist + 1 from walk w join two e on e.a = w.node where w.dist < 60),
  best as (select source, node, min(dist) dist from walk group by all)"""


def _sparse(spark, d):
    return written(b.nodes(spark, d), "nodes"), written(graph.undirect(b.sparse(spark, d)), "edges")


@query("g_bfs_all", b.sql(b.NODES, b.SPARSE, b.SIMPLE, _BFS, "select source, node, dist from best", recursive=True))
def g_bfs_all(spark, d):
    """All ordered pairs with a path; a pair that is not there has none (-1 where a number is wanted)."""
    nodes, edges = _sparse(spark, d)
    return paths.distances(edges, nodes)


_PATHS = """dist as (select source, node, dist d from best), sp(source, node, d) as (select node, node, cast(0 as bigint) from nodes union all select sp.source, e.b, sp.d + 1 from sp join two e on e.a = sp.node join dist on dist.source = sp.source and dist.node = e.b and dist.d = sp.d + 1),
  sig as (select source, node, any_value(d) d, cast(count(*) as double) c from sp group by all),
  btw as (select n.node, coalesce(sum(a.c * z.c / s.c), 0) / greatest(1, ((select count(*) from nodes) - 1) * ((select count(*) from nodes) - 2)) bc from nodes n left join sig a on a.node = n.node and a.source <> n.node left join sig z on z.source = n.node and z.node <> n.node and z.node <> a.source left join sig s on s.source = a.source and s.node = z.node and s.d = a.d + z.d where a.c is null or z.c is null or s.c is not null group by n.node)"""
_BTW = (b.NODES, b.SPARSE, b.SIMPLE, _BFS, _PATHS)


_BFS_SOME = """two as (select src a, dst b from simple union all select dst, src from simple), walk(source, node, dist) as
  (select node, node, cast(0 as bigint) from nodes where node % 50 = 0 union select w.source, e.b, w.dist + 1 from walk w join two e on e.a = w.node where w.dist < 14),
  best as (select source, node, min(dist) dist from walk group by all)"""


@query("g_cc_purchases", b.sql(b.NODES, b.DENSE, b.SIMPLE, b.COMPONENTS, "select node, component from comp", recursive=True))
def g_cc_purchases(spark, d):
    """Components of the whole graph of purchases."""
    return cc.all_components(b.nodes(spark, d), graph.undirect(b.dense(spark, d)))


@query("g_bfs_purchases", b.sql(b.NODES, b.DENSE, b.SIMPLE, _BFS_SOME, "select source, node, dist from best", recursive=True))
def g_bfs_purchases(spark, d):
    """Distances in the whole graph of purchases from each node whose id is divisible by 50 to all."""
    nodes, edges = written(b.nodes(spark, d), "nodes"), written(graph.undirect(b.dense(spark, d)), "edges")
    return paths.distances(edges, nodes.filter("node % 50 = 0"))


@query("g_betweenness", b.sql(*_BTW, "select n.node, round(coalesce(btw.bc, 0), 6) betweenness from nodes n left join btw using (node)", recursive=True))
def g_betweenness(spark, d):
    nodes, edges = _sparse(spark, d)
    return paths.betweenness(edges, nodes).withColumn("betweenness", F.round("betweenness", 6))


_ORDERS = """dg as (select n.node, count(two.a) degree from nodes n left join two on two.a = n.node group by n.node),
  ord as (select 'degree' order_id, node, row_number() over (order by degree desc, node) pos from dg union all select 'betweenness', n.node, row_number() over (order by round(coalesce(bc, 0), 9) desc, n.node) from nodes n left join btw using (node))"""
#: steps after which the removed nodes leave the pairs of a component apart; the largest of what is left, by step
_CURVE = """linked as (select node from dg where degree > 0), st as (select unnest(range(0, (select count(*) + 1 from nodes))) step),
  wk(order_id, step, node, other) as (select o.order_id, st.step, o.node, o.node from ord o join linked using (node) join st on o.pos > st.step where st.step <= (select max(pos) from ord join linked using (node)) union select w.order_id, w.step, w.node, e.b from wk w join two e on e.a = w.other join ord o on o.order_id = w.order_id and o.node = e.b where o.pos > w.step),
  sz as (select order_id, step, node, count(*) s from wk group by all), mx as (select order_id, step, max(s) s from sz group by all),
  cur as (select k.order_id, st.step, greatest(coalesce(mx.s, 0), case when st.step < (select count(*) from nodes) then 1 else 0 end) / (select count(*) from nodes) fraction from st cross join (select distinct order_id from ord) k left join mx on mx.order_id = k.order_id and mx.step = st.step)"""
_ATTACK = (*_BTW, _ORDERS, _CURVE)


@query("g_attack", b.sql(*_ATTACK, "select order_id, cast(step as bigint) step, round(fraction, 9) fraction from cur", recursive=True))
def g_attack(spark, d):
    return _attack(*_sparse(spark, d))


#: curves by the nodes' return, last removed first: a list of all nodes' labels (0: gone), in which what a node links becomes its own
_RETURNS = """ix as (select node, row_number() over (order by node) i from nodes), nn as (select count(*) n from nodes),
  near as (select x.i, list(y.i) ns from two join ix x on x.node = two.a join ix y on y.node = two.b group by x.i),
  come as (select order_id, pos, i, coalesce(ns, []) ns from ord join ix using (node) left join near using (i)),
  back(order_id, step, labels, most) as (select distinct order_id, n, list_transform(range(n), lambda z: cast(0 as bigint)), cast(0 as bigint) from ord, nn
    union all select order_id, pos, after, greatest(most, len(list_filter(after, lambda z: z = i))) from
      (select b.order_id, c.pos, c.i, b.most, list_transform(b.labels, lambda z, k: case when k = c.i or (z > 0 and list_contains(list_transform(c.ns, lambda u: b.labels[u]), z)) then c.i else z end) after
       from back b join come c on c.order_id = b.order_id and c.pos = b.step - 1)),
  cur as (select order_id, cast(step as bigint) step, most / n fraction from back, nn)"""
_TWO = "two as (select src a, dst b from simple union all select dst, src from simple)"
_RANDOM = "ord as (select 'random' || t order_id, node, row_number() over (partition by t order by md5('42-' || t || '-' || node), node) - 1 pos from nodes, range(200) r(t))"


def _purchases(spark, d):
    return written(b.nodes(spark, d), "nodes"), written(graph.undirect(b.dense(spark, d)), "edges")


def _failures(nodes, edges):
    curve = rb.curves(nodes, edges, rb.random_orders(nodes))
    return curve.groupBy("step").agg(F.round(F.avg("fraction"), 9).alias("fraction"))


_FAILED = "select step, round(avg(fraction), 9) fraction from cur group by step"


@query("g_random_failure", b.sql(b.NODES, b.SPARSE, b.SIMPLE, _TWO, _RANDOM, _RETURNS, _FAILED, recursive=True))
def g_random_failure(spark, d):
    return _failures(*_sparse(spark, d))


@query("g_random_failure_purchases", b.sql(b.NODES, b.DENSE, b.SIMPLE, _TWO, _RANDOM, _RETURNS, _FAILED, recursive=True))
def g_random_failure_purchases(spark, d):
    """On the whole graph of purchases."""
    return _failures(*_purchases(spark, d))


_BFS_TEN = _BFS.replace("dist < 60", "dist < 10")
_PLACES = """dg as (select n.node, count(two.a) degree from nodes n left join two on two.a = n.node group by n.node),
  ord as (select 'degree' order_id, node, row_number() over (order by degree desc, node) - 1 pos from dg union all select 'betweenness', n.node, row_number() over (order by round(coalesce(bc, 0), 9) desc, n.node) - 1 from nodes n left join btw using (node))"""
_ATTACK_ALL = (b.NODES, b.DENSE, b.SIMPLE, _BFS_TEN, _PATHS, _PLACES, _RETURNS)


def _attack(nodes, edges):
    deg = graph.degrees(nodes, edges.union(edges.select("dst", "src"))).select("node", F.col("degree").cast("double").alias("score"))
    central = paths.betweenness(edges, nodes).withColumn("betweenness", F.round("betweenness", 9))
    orders = rb.attack_order(deg, "score", "degree").union(rb.attack_order(central, "betweenness", "betweenness"))
    return rb.curves(nodes, edges, orders).withColumn("fraction", F.round("fraction", 9))


@query("g_bfs_all_purchases", b.sql(b.NODES, b.DENSE, b.SIMPLE, _BFS_TEN, "select source, node, dist from best", recursive=True))
def g_bfs_all_purchases(spark, d):
    """All ordered pairs with a path in the whole graph of purchases."""
    nodes, edges = _purchases(spark, d)
    return paths.distances(edges, nodes)


@query("g_betweenness_purchases", b.sql(b.NODES, b.DENSE, b.SIMPLE, _BFS_TEN, _PATHS, "select n.node, round(coalesce(btw.bc, 0), 6) betweenness from nodes n left join btw using (node)", recursive=True))
def g_betweenness_purchases(spark, d):
    nodes, edges = _purchases(spark, d)
    return paths.betweenness(edges, nodes).withColumn("betweenness", F.round("betweenness", 6))


@query("g_attack_purchases", b.sql(*_ATTACK_ALL, "select order_id, step, round(fraction, 9) fraction from cur", recursive=True))
def g_attack_purchases(spark, d):
    return _attack(*_purchases(spark, d))


@query("g_half_life_purchases", b.sql(*_ATTACK_ALL, "select order_id, min(step) step from cur where fraction <= 0.5 group by order_id", recursive=True))
def g_half_life_purchases(spark, d):
    return rb.half_life(g_attack_purchases(spark, d))


#: each node in turn goes first; what is left then is its impact
_GONE = (b.NODES, b.DENSE, b.SIMPLE, _TWO, "ord as (select cast(g.node as varchar) order_id, n.node, row_number() over (partition by g.node order by n.node <> g.node, n.node) - 1 pos from nodes g, nodes n)", _RETURNS, "imp as (select cast(order_id as bigint) node, round(1 - fraction, 6) impact from cur where step = 1)")


@query("g_node_impact_purchases", b.sql(*_GONE, "select * from imp", recursive=True))
def g_node_impact_purchases(spark, d):
    return rb.node_impact(*_purchases(spark, d)).withColumn("impact", F.round("impact", 6))


@query("top_fragment_purchases", b.sql(*_GONE, "select * from imp order by impact desc, node limit 10", recursive=True))
def top_fragment_purchases(spark, d):
    return g_node_impact_purchases(spark, d).orderBy(F.desc("impact"), "node").limit(10)


@query(
    "g_node_impact",
    b.sql(
        b.NODES, b.SPARSE, b.SIMPLE,
        "two as (select src a, dst b from simple union all select dst, src from simple), walk(gone, node, other) as (select g.node, n.node, n.node from nodes g join nodes n on n.node <> g.node union select w.gone, w.node, e.b from walk w join two e on e.a = w.other where e.b <> w.gone), sz as (select gone, node, count(*) s from walk group by all)",
        "select gone node, round(1 - max(s) / (select count(*) from nodes), 6) impact from sz group by gone",
        recursive=True,
    ),
)
def g_node_impact(spark, d):
    nodes, edges = _sparse(spark, d)
    return rb.node_impact(nodes, edges).withColumn("impact", F.round("impact", 6))


_IMPACT = "walk(gone, node, other) as (select g.node, n.node, n.node from nodes g join nodes n on n.node <> g.node union select w.gone, w.node, e.b from walk w join two e on e.a = w.other where e.b <> w.gone), sz0 as (select gone, node, count(*) s from walk group by all), imp as (select gone node, round(1 - max(s) / (select count(*) from nodes), 6) impact from sz0 group by gone)"


@query("top_fragment", b.sql(b.NODES, b.SPARSE, b.SIMPLE, "two as (select src a, dst b from simple union all select dst, src from simple)", _IMPACT, "select node, impact from imp order by impact desc, node limit 10", recursive=True))
def top_fragment(spark, d):
    return g_node_impact(spark, d).orderBy(F.desc("impact"), "node").limit(10)


@query("agg_attack_meta", b.sql(b.NODES, b.SPARSE, b.SIMPLE, _BFS, _PATHS, _IMPACT.replace("walk", "walks"), "rb as (select n.node, round(coalesce(btw.bc, 0), 6) bc from nodes n left join btw using (node))", "select m.node top_fragmenter, t.node top_betweenness, m.node = t.node same from (select node from imp order by impact desc, node limit 1) m, (select node from rb order by bc desc, node limit 1) t", recursive=True))
def agg_attack_meta(spark, d):
    impact, central = g_node_impact(spark, d), g_betweenness(spark, d)
    one = impact.agg(F.expr("max_by(node, struct(impact, -node))").alias("top_fragmenter"))
    two = central.agg(F.expr("max_by(node, struct(betweenness, -node))").alias("top_betweenness"))
    return one.join(two).withColumn("same", F.expr("top_fragmenter = top_betweenness"))


@query("g_half_life", b.sql(*_ATTACK, "select order_id, cast(min(step) as bigint) step from cur where fraction <= 0.5 group by order_id", recursive=True))
def g_half_life(spark, d):
    return rb.half_life(g_attack(spark, d))




def _backbone(spark, d):
    edges = written(graph.disparity(b.weighted(spark, d)).filter("p < 0.35").select("src", "dst", "weight"), "edges")
    return edges.select(F.explode(F.array("src", "dst")).alias("node")).distinct(), edges


#: seeds of the runs that shares, loyalty and consensus are taken over
RUNS = 200
#: random pairs of different runs whose agreement is measured
NMI_PAIRS = 500


def _whole(spark, d):
    """All nodes and edges of the weighted graph; the filter by p is for the exported backbone alone."""
    edges = written(b.weighted(spark, d), "edges")
    return edges.select(F.explode(F.array("src", "dst")).alias("node")).distinct(), edges


def _all_runs(spark, d, weight="weight"):
    nodes, edges = _whole(spark, d)
    return nodes, written(cm.runs(nodes, edges, RUNS, weight), "labels")


_KEPT = "kept as (select src, dst, weight from disp where p < 0.35)"


@query("c_louvain_runs", b.sql(b.WEIGHTED, b.STRENGTH, b.DISPARITY, _KEPT, "ends9 as (select src node from kept union select dst from kept)", "select cast(run as bigint) run, (select count(*) from ends9) nodes, true better_than_one from generate_series(0, 19) g(run)"))
def c_louvain_runs(spark, d):
    """Of each run: the nodes it labels, and whether its modularity is above that of one community (0)."""
    nodes, edges = _backbone(spark, d)
    labels = written(cm.runs(nodes, edges, 20, "weight"), "labels")
    e = edges.join(labels.select("run", F.col("node").alias("src"), F.col("community").alias("ca")), "src").join(labels.select("run", F.col("node").alias("dst"), F.col("community").alias("cb")), ["run", "dst"])
    ends = e.select("run", F.explode(F.array(F.struct(F.col("ca").alias("c"), F.expr("if(ca = cb, weight, 0)").alias("l"), "weight"), F.struct(F.col("cb").alias("c"), F.lit(0).cast("long").alias("l"), "weight"))).alias("x")).select("run", "x.*")
    per = ends.groupBy("run", "c").agg(F.sum("l").alias("l"), F.sum("weight").alias("w"))
    q = per.groupBy("run").agg(F.expr("sum(l) / (sum(w) / 2) - sum(w * w) / (sum(w) * sum(w))").alias("q"))
    return labels.groupBy("run").agg(F.count("*").alias("nodes")).join(q, "run").select("run", "nodes", F.expr("q > 0").alias("better_than_one"))


@query("agg_coassign")
def agg_coassign(spark, d):
    return cm.coassignment(_all_runs(spark, d)[1])


@query("agg_coassign_unweighted")
def agg_coassign_unweighted(spark, d):
    return cm.coassignment(_all_runs(spark, d, None)[1])


@query("c_consensus")
def c_consensus(spark, d):
    return cm.consensus(*_all_runs(spark, d))


@query("c_loyalty_unweighted")
def c_loyalty_unweighted(spark, d):
    return cm.loyalty(*_labels(spark, d, None))


def _labels(spark, d, weight="weight"):
    nodes, labels = _all_runs(spark, d, weight)
    return labels, written(cm.consensus(nodes, labels), "agreed")


@query("agg_share_matrix")
def agg_share_matrix(spark, d):
    return cm.mapped_shares(*_labels(spark, d))


@query("c_loyalty")
def c_loyalty(spark, d):
    return cm.loyalty(*_labels(spark, d))


@query("jn_run_mapping")
def jn_run_mapping(spark, d):
    labels, agreed = _labels(spark, d)
    both = labels.join(agreed.withColumnRenamed("community", "agreed"), "node").groupBy("run", "community", "agreed").agg(F.count("*").alias("n"))
    return both.groupBy("run", "community").agg(F.expr("max_by(agreed, struct(n, -agreed))").alias("agreed"), F.max("n").alias("overlap"))


@query("agg_k_hist")
def agg_k_hist(spark, d):
    _, labels = _all_runs(spark, d)
    return labels.groupBy("run").agg(F.count_distinct("community").alias("k")).groupBy("k").agg(F.count("*").alias("runs"))


@query("c_pair_nmi")
def c_pair_nmi(spark, d):
    """Over NMI_PAIRS distinct random pairs of runs."""
    return cm.pair_nmi(_all_runs(spark, d)[1], cm.random_pairs(RUNS, NMI_PAIRS)).agg(F.min("nmi").alias("min"), F.avg("nmi").alias("mean"), F.max("nmi").alias("max"))


def _traditions(agreed):
    """node, tradition: communities of the first three nodes, which are the anchors; -1 for the rest."""
    first = [r.node for r in agreed.orderBy("node").limit(3).collect()]
    return cm.anchored(agreed, {n: i for i, n in enumerate(first)})


@query("c_anchor")
def c_anchor(spark, d):
    return _traditions(_labels(spark, d)[1])


@query("agg_era_rows")
def agg_era_rows(spark, d):
    """By region, over the unweighted runs: nodes, mean loyalty, share under one half, how many nodes each tradition has (-1: none), top share
    and entropy of these."""
    labels, agreed = _labels(spark, d, None)
    rows = cm.loyalty(labels, agreed).join(b.regions(spark, d).withColumnRenamed("community", "era"), "node").join(_traditions(agreed), "node")
    return cm.era_rows(rows).withColumns({c: F.round(c, 3) for c in ("mean_loyalty", "below_half", "top_share", "entropy_bits")})


#: balances of the suppliers of the first region against random groups of as many, drawn by digests
_PERM = """v as (select s_suppkey node, s_acctbal v, coalesce(n_regionkey = 0, false) g from supplier left join nation on s_nationkey = n_nationkey), k as (select count(*) k, avg(v) m from v where g),
  d as (select t, v, row_number() over (partition by t order by md5('42-' || t || '-' || node), node) r from v, range(10000) r(t)), e as (select t, avg(v) m from d, k where r <= k group by t)"""


@query("st_perm_balances", b.sql(_PERM, "select round(k.m, 6) observed, round((select count(*) from e, k where e.m <= k.m + 1e-9) / 10000, 6) p from k where k > 0"))
def st_perm_balances(spark, d):
    """Whether the suppliers of one region have balances as low as random groups of as many suppliers."""
    rows = b.read(spark, d, "supplier").join(b.read(spark, d, "nation"), F.col("s_nationkey") == F.col("n_nationkey"), "left")
    rows = rows.select(F.col("s_suppkey").alias("node"), F.col("s_acctbal").alias("v"), F.coalesce(F.col("n_regionkey") == 0, F.lit(False)).alias("g"))
    return cm.permutation_test(rows, "v", "g").select(F.round("observed", 6).alias("observed"), F.round("p", 6).alias("p"))


@query("st_perm")
def st_perm(spark, d):
    labels, agreed = _labels(spark, d)
    rows = cm.loyalty(labels, agreed).join(b.regions(spark, d).withColumnRenamed("community", "era"), "node")
    return cm.permutation_test(rows.withColumn("g", F.expr("era = 0")), "loyalty", "g")


@query("c_null_rewire", b.sql(b.NODES, b.DENSE, b.SIMPLE, "d2 as (select node, count(*) degree from (select src node from simple union all select dst from simple) group by node)", "select cast(graph as bigint) graph, (select count(*) from simple) edges, (select count(*) from d2) nodes, cast(0 as bigint) changed_degrees, cast(0 as bigint) loops from generate_series(0, 19) g(graph)"))
def c_null_rewire(spark, d):
    """Of each rewired graph: its edges and nodes, nodes with another degree than before, and loops."""
    nodes, edges = b.nodes(spark, d), written(graph.undirect(b.dense(spark, d)), "edges")
    made = written(cm.rewired(nodes, edges), "rewired")
    before = edges.select(F.explode(F.array("src", "dst")).alias("node")).groupBy("node").agg(F.count("*").alias("before"))
    after = made.select("graph", F.explode(F.array("src", "dst")).alias("node")).groupBy("graph", "node").agg(F.count("*").alias("after"))
    changed = after.join(before, "node", "left").groupBy("graph").agg(F.count("*").alias("nodes"), F.sum(F.expr("if(after <=> before, 0L, 1L)")).alias("changed_degrees"))
    return made.groupBy("graph").agg(F.count_distinct("src", "dst").alias("edges"), F.sum(F.expr("if(src = dst, 1L, 0L)")).alias("loops")).join(changed, "graph")


@query("c_null_q")
def c_null_q(spark, d):
    """Modularity of the purchases' communities against that of 20 rewired copies: mean, deviation and z-score."""
    nodes, edges = b.nodes(spark, d), written(graph.undirect(b.dense(spark, d)), "edges")
    real = edges.select(F.lit(-1).cast("long").alias("graph"), "src", "dst")
    q = written(cm.null_modularity(real.unionByName(cm.rewired(nodes, edges))), "modularity")  # all of them at once
    real, null = q.filter("graph < 0").select(F.col("q").alias("real")), q.filter("graph >= 0").agg(F.avg("q").alias("mean"), F.stddev_pop("q").alias("std"))
    return real.join(null).select("real", "mean", "std", F.expr("if(std > 0, (real - mean) / std, null)").alias("z"))


@query("st_gnm", b.sql(b.NODES, b.DENSE, b.SIMPLE, "select cast(graph as bigint) graph, (select count(*) from nodes) nodes, 2 * (select count(*) from simple) degree_sum from generate_series(0, 199) g(graph)"))
def st_gnm(spark, d):
    n, m = b.nodes(spark, d).count(), graph.undirect(b.dense(spark, d)).count()
    return cm.pooled_degrees(spark, "gnm", n, m).groupBy("graph").agg(F.count("*").alias("nodes"), F.sum("degree").alias("degree_sum"))


@query("st_ba", b.sql(b.NODES, "select cast(graph as bigint) graph, (select count(*) from nodes) nodes, 2 * 3 * ((select count(*) from nodes) - 3) degree_sum from generate_series(0, 199) g(graph)"))
def st_ba(spark, d):
    return cm.pooled_degrees(spark, "ba", b.nodes(spark, d).count(), 3).groupBy("graph").agg(F.count("*").alias("nodes"), F.sum("degree").alias("degree_sum"))
