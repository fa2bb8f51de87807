"""Queries on networks."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..operators import components as cc
from ..operators import distributions as ds
from ..operators import graph
from . import base as b
from .registry import query


@query("g_build", b.sql(b.DENSE, "select src, dst from edges"))
def g_build(spark, d):
    return b.dense(spark, d)


@query("flt_selfloop", b.sql(f"e0 as ({b._HANDED.format("event_type = 'purchase'")})", "select src, dst, count(*) n from e0 where dst is not null and src <> dst group by all"))
def flt_selfloop(spark, d):
    day = Window.partitionBy(F.to_date("ts")).orderBy("ts", "event_id")
    raw = b.read(spark, d, "events").filter("event_type = 'purchase'").select(F.col("user_id").alias("src"), F.lead("user_id").over(day).alias("dst")).filter("dst is not null")
    return graph.without_loops(raw).groupBy("src", "dst").agg(F.count("*").alias("n"))


@query("g_undirect", b.sql(b.DENSE, b.SIMPLE, "select src, dst from simple"))
def g_undirect(spark, d):
    return graph.undirect(b.dense(spark, d))


@query("jn_reverse", b.sql(b.DENSE, "select e.src, e.dst, r.src is not null mutual from edges e left join edges r on r.src = e.dst and r.dst = e.src"))
def jn_reverse(spark, d):
    return graph.with_reverse(b.dense(spark, d))


@query(
    "g_reciprocity",
    b.sql(b.DENSE, b.SIMPLE, "m as (select count(*) c from edges e where exists (select 1 from edges r where r.src = e.dst and r.dst = e.src))", "select (select count(*) from edges) m_dir, cast((select c from m) // 2 as bigint) mutual_pairs, (select count(*) from edges) - (select c from m) one_way, (select count(*) from simple) m_undirected"),
)
def g_reciprocity(spark, d):
    return graph.reciprocity(b.dense(spark, d))


@query("g_direction", b.sql(b.DENSE, "select least(src, dst) s, greatest(src, dst) t, case when count(*) = 2 then 'mutual' when min(src) < min(dst) then 'st' else 'ts' end dir from edges group by 1, 2"))
def g_direction(spark, d):
    return graph.direction(b.dense(spark, d))


@query("g_adjacency", b.sql(b.NODES, b.SPARSE, "select node, coalesce((select list(dst order by dst) from edges where src = node), []) successors, coalesce((select list(src order by src) from edges where dst = node), []) predecessors from nodes"))
def g_adjacency(spark, d):
    return graph.adjacency(b.nodes(spark, d), b.sparse(spark, d))


@query("agg_degree", b.sql(b.NODES, b.DENSE, b.SIMPLE, b.DEGREES, "select * from deg"))
def agg_degree(spark, d):
    return graph.degrees(b.nodes(spark, d), b.dense(spark, d))


@query("agg_value_counts", b.sql(b.NODES, b.DENSE, b.SIMPLE, b.DEGREES, "select in_degree + 1 x, count(*) as \"count\" from deg group by 1"))
def agg_value_counts(spark, d):
    return ds.value_counts(agg_degree(spark, d).select((F.col("in_degree") + 1).alias("k")), "k")


@query("agg_counts", b.sql(b.NODES, b.SPARSE, b.SIMPLE, "a as (select (select count(*) from nodes) n, (select count(*) from edges) m_dir, (select count(*) from simple) m, (select count(*) from nodes where node not in (select src from edges union select dst from edges)) isolates)", "select *, round(2 * m / n, 6) mean_degree from a"))
def agg_counts(spark, d):
    return graph.counts(b.nodes(spark, d), b.sparse(spark, d))


@query("g_isolates", b.sql(b.NODES, b.SPARSE, "select node from nodes where node not in (select src from edges union select dst from edges)"))
def g_isolates(spark, d):
    return graph.isolates(b.nodes(spark, d), b.sparse(spark, d))


@query("js_neighbors", b.sql(b.DENSE, "hub as (select src from edges group by src order by count(*) desc, src limit 1)", "select distinct case when e.src = hub.src then e.dst else e.src end node from edges e, hub where e.src = hub.src or e.dst = hub.src"))
def js_neighbors(spark, d):
    edges = b.dense(spark, d)
    hub = edges.groupBy("src").count().orderBy(F.desc("count"), "src").first()
    return graph.neighbors(edges, hub.src if hub else None)


def _sparse_components(spark, d):
    return cc.all_components(b.nodes(spark, d), b.sparse(spark, d))


@query("g_cc", b.sql(b.NODES, b.SPARSE, b.SIMPLE, b.COMPONENTS, "select * from comp", recursive=True))
def g_cc(spark, d):
    return _sparse_components(spark, d)


@query("srt_components", b.sql(b.NODES, b.SPARSE, b.SIMPLE, b.COMPONENTS, "select component, count(*) size, row_number() over (order by count(*) desc, component) rank from comp group by component", recursive=True))
def srt_components(spark, d):
    return graph.component_sizes(_sparse_components(spark, d))


_LABEL = "sizes as (select component, row_number() over (order by count(*) desc, component) r from comp group by component)"


@query("g_comp_label", b.sql(b.NODES, b.SPARSE, b.SIMPLE, b.COMPONENTS, _LABEL, "select node, case r when 1 then 'giant' when 2 then 'second' else 'isolate' end as \"label\" from comp join sizes using (component)", recursive=True))
def g_comp_label(spark, d):
    return graph.component_labels(_sparse_components(spark, d))


@query("set_comp_isolates", b.sql(b.NODES, b.SPARSE, b.SIMPLE, b.COMPONENTS, _LABEL, "select node from comp join sizes using (component) where r > 2", recursive=True))
def set_comp_isolates(spark, d):
    return graph.component_labels(_sparse_components(spark, d)).filter("label = 'isolate'").select("node")


@query("g_giant", b.sql(b.NODES, b.SPARSE, b.SIMPLE, b.COMPONENTS, _LABEL, "select src, dst from simple join comp on node = src join sizes using (component) where r = 1", recursive=True))
def g_giant(spark, d):
    return graph.giant(_sparse_components(spark, d), b.sparse(spark, d)).select("src", "dst")


@query(
    "agg_graph_meta",
    b.sql(b.NODES, b.SPARSE, b.SIMPLE, b.DEGREES, b.COMPONENTS, "s as (select count(*) size from comp group by component)", "select (select count(*) from nodes) n, (select count(*) from simple) m, (select max(degree) from deg) max_degree, round((select max(size) from s) / (select count(*) from nodes), 4) giant_fraction, (select count(*) from s) n_components", recursive=True),
)
def agg_graph_meta(spark, d):
    nodes, edges = b.nodes(spark, d), b.sparse(spark, d)
    sizes = _sparse_components(spark, d).groupBy("component").agg(F.count("*").alias("size")).agg(F.max("size").alias("giant"), F.count("*").alias("n_components"))
    deg = graph.degrees(nodes, edges).agg(F.count("*").alias("n"), F.max("degree").alias("max_degree"), (F.sum("degree") / 2).cast("long").alias("m"))
    return deg.join(sizes).select("n", "m", "max_degree", F.round(F.col("giant") / F.col("n"), 4).alias("giant_fraction"), "n_components")


@query("top_degree", b.sql(b.NODES, b.DENSE, b.SIMPLE, b.DEGREES, "select 'in' side, node, in_degree k from (select * from deg order by in_degree desc, node limit 5) union all select 'out', node, out_degree from (select * from deg order by out_degree desc, node limit 5)"))
def top_degree(spark, d):
    deg = agg_degree(spark, d)
    top = lambda side: deg.orderBy(F.desc(f"{side}_degree"), "node").limit(5).select(F.lit(side).alias("side"), "node", F.col(f"{side}_degree").alias("k"))
    return top("in").union(top("out"))


@query("win_rank", b.sql(b.NODES, b.DENSE, b.SIMPLE, b.DEGREES, "select node, degree, row_number() over (order by degree desc, node) rank from deg"))
def win_rank(spark, d):
    """Ranks by sorting, so that no task gets all rows: a rank is the rows of larger degrees and the place among equals."""
    deg = agg_degree(spark, d).select("node", "degree")
    larger = ds.value_counts(deg, "degree").withColumn("before", F.coalesce(F.sum("count").over(Window.orderBy(F.desc("x")).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    place = F.row_number().over(Window.partitionBy("degree").orderBy("node"))
    return deg.join(larger, F.col("degree") == F.col("x")).select("node", "degree", (F.col("before") + place).alias("rank"))


@query("agg_examples", b.sql(b.NODES, b.DENSE, b.SIMPLE, b.DEGREES, "r as (select in_degree, node, row_number() over (partition by in_degree order by node) rn, dense_rank() over (order by in_degree) dr from deg)", "select in_degree, list(node order by node) examples from r where rn <= 5 and dr <= 12 group by 1"))
def agg_examples(spark, d):
    deg = agg_degree(spark, d)
    low = deg.select("in_degree").distinct().orderBy("in_degree").limit(12)
    rows = deg.join(F.broadcast(low), "in_degree").withColumn("rn", F.row_number().over(Window.partitionBy("in_degree").orderBy("node"))).filter("rn <= 5")
    return rows.groupBy("in_degree").agg(F.sort_array(F.collect_list("node")).alias("examples"))


_EDGES_OF = "mx as (select max(k) m from v), eb as (select list_concat([1,2,3,4,5,6,7], list_filter([14,28,56,112,224,448,896,1792,3584,7168,14336,28672,57344], lambda e: e / 2 < m)) e from mx), bins as (select i - 1 as bin, e[i] lo, e[i+1] hi, i = len(e) - 1 last from eb, generate_series(1, len(e) - 1) g(i))"
_V = "v as (select in_degree + 1 k from deg)"


@query("st_logbin_edges", b.sql(b.NODES, b.DENSE, b.SIMPLE, b.DEGREES, _V, _EDGES_OF, "select cast(bin as bigint) bin, cast(lo as bigint) lo, cast(hi as bigint) hi from bins"))
def st_logbin_edges(spark, d):
    largest = agg_degree(spark, d).agg(F.max("in_degree") + 1).first()[0]
    e = ds.doubling_edges(int(largest or 1))
    return spark.createDataFrame(list(zip(range(len(e) - 1), e, e[1:])), "bin long, lo long, hi long")


@query("agg_hist_fixed", b.sql(b.NODES, b.DENSE, b.SIMPLE, b.DEGREES, _V, _EDGES_OF, "select cast(bin as bigint) bin, cast(lo as double) lo, cast(hi as double) hi, count(*) as \"count\" from bins join v on k >= lo and (k < hi or last and k <= hi) group by all"))
def agg_hist_fixed(spark, d):
    v = agg_degree(spark, d).select((F.col("in_degree") + 1).alias("k"))
    return ds.histogram(v, "k", ds.doubling_edges(int(v.agg(F.max("k")).first()[0] or 1)))


@query("st_logbin", b.sql(b.NODES, b.DENSE, b.SIMPLE, b.DEGREES, _V, _EDGES_OF, "select cast(bin as bigint) bin, round(exp(list_sum(list_transform(range(lo, hi), lambda z: ln(z))) / (hi - lo)), 6) x, round(count(*) / (hi - lo), 6) y from bins join v on k >= lo and (k < hi or last and k <= hi) group by bin, lo, hi"))
def st_logbin(spark, d):
    v = agg_degree(spark, d).select((F.col("in_degree") + 1).alias("k"))
    return ds.log_bins(v, "k").select("bin", F.round("x", 6).alias("x"), F.round("y", 6).alias("y"))


@query(
    "st_logpdf",
    "with v as (select value k from events where value > 0), s as (select min(k) lo, max(k) hi, count(*) n from v), e as (select i, case when i = 30 then hi else lo * pow(hi / lo, i / 30.0) end e, n from s, generate_series(0, 30) g(i)), bins as (select a.i bin, a.e lo, z.e hi, a.n from e a join e z on z.i = a.i + 1) select cast(bin as bigint) bin, round(sqrt(lo * hi), 6) x, round(count(*) / (hi - lo) / any_value(n), 9) y from bins join v on k >= lo and (k < hi or bin = 29 and k <= hi) group by bin, lo, hi",
)
def st_logpdf(spark, d):
    return ds.log_density(b.read(spark, d, "events"), "value").select("bin", F.round("x", 6).alias("x"), F.round("y", 9).alias("y"))


_CCDF = "c as (select degree x, count(*) n from deg where degree > 0 group by 1), cc as (select x, round(sum(n) over (order by x rows between current row and unbounded following) / (select sum(n) from c), 6) y from c)"


@query("st_ccdf", b.sql(b.NODES, b.DENSE, b.SIMPLE, b.DEGREES, _CCDF, "select x, y from cc"))
def st_ccdf(spark, d):
    return ds.ccdf(agg_degree(spark, d), "degree")


@query("st_fit_line", b.sql(b.NODES, b.DENSE, b.SIMPLE, b.DEGREES, _CCDF, "mid as (select quantile_disc(x, 0.5) xm from c)", "select x, round((select y from cc, mid where x = xm) * pow(x / xm, -1.5), 6) y from cc, mid where x >= xm"))
def st_fit_line(spark, d):
    rows = ds.ccdf(agg_degree(spark, d), "degree")
    middle = rows.agg(F.expr("percentile_disc(0.5) within group (order by x)")).first()[0]
    return ds.fit_line(rows, 2.5, int(middle or 1))


@query("st_tune_mba", b.sql(b.NODES, b.DENSE, b.SIMPLE, "s as (select (select count(*) from nodes) n, (select count(*) from simple) m)", "select cast(c as bigint) m_ba, cast(c * (n - c) as bigint) edges from s, generate_series(1, 14) g(c) order by abs(c * (n - c) - m), c limit 1"))
def st_tune_mba(spark, d):
    n, m = b.nodes(spark, d).count(), graph.undirect(b.dense(spark, d)).count()
    c = ds.ba_edges_parameter(n, m)
    return spark.createDataFrame([(c, c * (n - c))], "m_ba long, edges long")


@query("st_powerlaw_fit")
def st_powerlaw_fit(spark, d):
    return ds.powerlaw_fit(agg_degree(spark, d), "degree")


@query("st_lr_test")
def st_lr_test(spark, d):
    deg = agg_degree(spark, d)
    best = ds.powerlaw_fit(deg, "degree").filter("chosen").first()
    return ds.likelihood_ratio(deg, "degree", int(best.xmin), float(best.alpha))


@query("st_sample_exp", "select cast(10000 as bigint) n, true positive, true near_mean")
def st_sample_exp(spark, d):
    return ds.exponential_sample(spark).agg(F.count("*").alias("n"), F.expr("min(x) >= 0").alias("positive"), F.expr("abs(avg(x) - 5) < 0.3").alias("near_mean"))


@query("st_sample_pl", "select cast(10000 as bigint) n, true from_xmin, true near_median")
def st_sample_pl(spark, d):
    return ds.powerlaw_sample(spark).agg(F.count("*").alias("n"), F.expr("min(x) >= 1").alias("from_xmin"), F.expr("abs(percentile(x, 0.5) - pow(2, 1 / 1.5)) < 0.1").alias("near_median"))


@query("agg_strength", b.sql(b.WEIGHTED, b.STRENGTH, "select node, degree, strength from st"))
def agg_strength(spark, d):
    return graph.strengths(b.weighted(spark, d))


@query("g_disparity", b.sql(b.WEIGHTED, b.STRENGTH, b.DISPARITY, "select src, dst, weight, round(p, 6) p from disp"))
def g_disparity(spark, d):
    return graph.disparity(b.weighted(spark, d)).withColumn("p", F.round("p", 6))


@query("flt_alpha", b.sql(b.WEIGHTED, b.STRENGTH, b.DISPARITY, "select src, dst from disp where round(p, 5) < 0.05"))
def flt_alpha(spark, d):
    return graph.disparity(b.weighted(spark, d)).filter("round(p, 5) < 0.05").select("src", "dst")


@query("flt_alpha_grid", b.sql(b.WEIGHTED, b.STRENGTH, b.DISPARITY, "select cast(alpha as double) alpha, src, dst from disp join (select unnest([0.05, 0.1, 0.2, 0.3, 0.35, 0.4]) alpha) on round(p, 5) < alpha"))
def flt_alpha_grid(spark, d):
    """Edges that each of several bounds keeps, strictly below it."""
    rows = graph.disparity(b.weighted(spark, d)).withColumn("p", F.round("p", 5))
    alphas = F.array(*(F.lit(a) for a in (0.05, 0.1, 0.2, 0.3, 0.35, 0.4)))
    return rows.select("src", "dst", "p", F.explode(alphas).alias("alpha")).filter("p < alpha").select("alpha", "src", "dst")


_ALPHAS = (0.05, 0.1, 0.2, 0.3)


@query(
    "g_backbone",
    b.sql(
        b.WEIGHTED, b.STRENGTH, b.DISPARITY,
        "al as (select unnest([0.05, 0.1, 0.2, 0.3]) alpha), kept as (select alpha, src, dst from disp, al where round(p, 5) < alpha), ends2 as (select alpha, src a, dst b from kept union select alpha, dst, src from kept), reach(alpha, node, other) as (select distinct alpha, a, a from ends2 union select r.alpha, r.node, e.b from reach r join ends2 e on e.alpha = r.alpha and e.a = r.other), comp as (select alpha, node, min(other) c from reach group by all), sz as (select alpha, c, count(*) s from comp group by all)",
        "select cast(alpha as double) alpha, (select count(*) from kept k where k.alpha = al.alpha) links, (select count(*) from comp k where k.alpha = al.alpha) attached, coalesce((select max(s) from sz k where k.alpha = al.alpha), 0) giant from al",
        recursive=True,
    ),
)
def g_backbone(spark, d):
    rows = graph.disparity(b.weighted(spark, d)).withColumn("p", F.round("p", 5))
    out = None
    for alpha in _ALPHAS:
        kept = rows.filter(F.col("p") < alpha)
        sizes = cc.components(kept.selectExpr("src a", "dst b")).groupBy("component").agg(F.count("*").alias("s")).agg(F.coalesce(F.max("s"), F.lit(0)).alias("giant"), F.coalesce(F.sum("s"), F.lit(0)).alias("attached"))
        row = kept.agg(F.count("*").alias("links")).join(sizes).select(F.lit(alpha).alias("alpha"), "links", "attached", "giant")
        out = row if out is None else out.union(row)
    return out


_Q = "rows3 as (select w.*, a.community ca, b.community cb from w join {0} a on a.node = src join {0} b on b.node = dst), ends3 as (select ca c, {1} w, case when ca = cb then {1} else 0 end l from rows3 union all select cb, {1}, 0 from rows3), per as (select c, sum(w) d, sum(l) l from ends3 group by c)"


@query("c_modularity", b.sql(b.WEIGHTED, b.REGIONS, _Q.format("regions", "weight"), "select round(sum(l) / (sum(d) / 2) - sum(d * d) / (sum(d) * sum(d)), 6) q from per"))
def c_modularity(spark, d):
    return graph.modularity(b.weighted(spark, d), b.regions(spark, d), "weight").select(F.round("q", 6).alias("q"))


@query("c_modularity_unweighted", b.sql(b.WEIGHTED, b.NATIONS, _Q.format("nations", "1"), "select round(sum(l) / (sum(d) / 2) - sum(d * d) / (sum(d) * sum(d)), 6) q from per"))
def c_modularity_unweighted(spark, d):
    return graph.modularity(b.weighted(spark, d), b.nations(spark, d)).select(F.round("q", 6).alias("q"))


@query(
    "c_nmi",
    b.sql(b.REGIONS, b.NATIONS, "cells as (select r.community x, n.community y, count(*) n from regions r join nations n using (node) group by all), t as (select sum(n) t from cells), rx as (select x, sum(n) nx from cells group by x), ry as (select y, sum(n) ny from cells group by y), h as (select (select -sum(nx / t * ln(nx / t)) from rx, t) hx, (select -sum(ny / t * ln(ny / t)) from ry, t) hy, (select sum(n / t * ln(n * t / (nx * ny))) from cells join rx using (x) join ry using (y), t) mi)", "select round(2 * mi / (hx + hy), 6) nmi from h"),
)
def c_nmi(spark, d):
    return graph.nmi(b.regions(spark, d), b.nations(spark, d)).select(F.round("nmi", 6).alias("nmi"))


@query("jn_dim", b.sql(b.WEIGHTED, b.STRENGTH, "select s_suppkey, s_name, n_name, strength from st join supplier on s_suppkey = node join nation on n_nationkey = s_nationkey"))
def jn_dim(spark, d):
    sup = b.read(spark, d, "supplier").join(F.broadcast(b.read(spark, d, "nation").select("n_nationkey", "n_name")), F.col("s_nationkey") == F.col("n_nationkey"))  # nation: 25 rows
    return graph.strengths(b.weighted(spark, d)).join(sup, F.col("node") == F.col("s_suppkey")).select("s_suppkey", "s_name", "n_name", "strength")


@query("jn_era", b.sql(b.REGIONS, "select node, r_name era, community ord from regions join region on r_regionkey = community"))
def jn_era(spark, d):
    return b.regions(spark, d).join(F.broadcast(b.read(spark, d, "region")), F.col("community") == F.col("r_regionkey")).select("node", F.col("r_name").alias("era"), F.col("community").alias("ord"))


@query("win_dup", "select s_nationkey, s_suppkey from (select *, count(*) over (partition by s_nationkey) c from supplier) where c > 1")
def win_dup(spark, d):
    return b.read(spark, d, "supplier").withColumn("c", F.count("*").over(Window.partitionBy("s_nationkey"))).filter("c > 1").select("s_nationkey", "s_suppkey")


@query("jn_asof_rev", "select user_id, max_by(event_id, (ts, event_id)) event_id from events where ts <= timestamp '2024-01-20' group by user_id")
def jn_asof_rev(spark, d):
    """The last event of each user on or before an instant."""
    return b.read(spark, d, "events").filter("ts <= timestamp_ntz '2024-01-20 00:00:00'").groupBy("user_id").agg(F.expr("max_by(event_id, struct(ts, event_id))").alias("event_id"))


@query("set_nodes_equal", b.sql(b.NODES, b.DENSE, "select (select count(*) from (select node from nodes except select src from edges)) missing, (select count(*) from (select src from edges except select node from nodes)) unknown"))
def set_nodes_equal(spark, d):
    n, s = b.nodes(spark, d), b.dense(spark, d).select(F.col("src").alias("node")).distinct()
    return n.exceptAll(s).agg(F.count("*").alias("missing")).join(s.exceptAll(n).agg(F.count("*").alias("unknown")))


@query("set_union_links", b.sql(b.DENSE, f"s0 as ({b._HANDED.format(f"event_type = 'error' and value >= {b.SEVERE}")})", "select src, dst from edges union select src, dst from s0 where dst is not null and src <> dst"))
def set_union_links(spark, d):
    return b.dense(spark, d).union(b.sparse(spark, d)).distinct()


@query("set_intersect", b.sql(b.DENSE, f"s0 as ({b._HANDED.format(f"event_type = 'error' and value >= {b.SEVERE}")})", "select src, dst from edges intersect select src, dst from s0 where dst is not null and src <> dst"))
def set_intersect(spark, d):
    return b.dense(spark, d).intersect(b.sparse(spark, d))


@query("set_except", b.sql(b.DENSE, f"s0 as ({b._HANDED.format(f"event_type = 'error' and value >= {b.SEVERE}")})", "select src, dst from s0 where dst is not null and src <> dst except select src, dst from edges"))
def set_except(spark, d):
    return b.sparse(spark, d).exceptAll(b.dense(spark, d))


@query("jn_full_outer_pairs", b.sql(b.DENSE, f"s0 as ({b._HANDED.format(f"event_type = 'error' and value >= {b.SEVERE}")}), s as (select distinct src, dst from s0 where dst is not null and src <> dst)", "select coalesce(e.src, s.src) src, coalesce(e.dst, s.dst) dst, case when e.src is null then 'second' when s.src is null then 'first' else 'both' end side from edges e full join s on e.src = s.src and e.dst = s.dst"))
def jn_full_outer_pairs(spark, d):
    a, c = b.dense(spark, d).withColumn("a", F.lit(True)), b.sparse(spark, d).withColumn("c", F.lit(True))
    return a.join(c, ["src", "dst"], "full").select("src", "dst", F.expr("case when a is null then 'second' when c is null then 'first' else 'both' end").alias("side"))


@query("jn_linked", b.sql(b.WEIGHTED, b.STRENGTH, b.DISPARITY, "select w.src, w.dst, d.src is not null linked from w left join (select * from disp where p < 0.1) d on d.src = w.src and d.dst = w.dst"))
def jn_linked(spark, d):
    w = b.weighted(spark, d)
    linked = graph.disparity(w).filter("p < 0.1").select("src", "dst", F.lit(True).alias("linked"))
    return w.select("src", "dst").join(linked, ["src", "dst"], "left").withColumn("linked", F.coalesce("linked", F.lit(False)))


@query("st_spearman", b.sql(b.NODES, b.DENSE, b.SIMPLE, b.DEGREES, "r as (select rank() over (order by in_degree) + (count(*) over (partition by in_degree) - 1) / 2 x, rank() over (order by out_degree) + (count(*) over (partition by out_degree) - 1) / 2 y from deg)", "select round(corr(x, y), 6) rho from r"))
def st_spearman(spark, d):
    """Average ranks come from the counts of the distinct values, not from sorting all rows in one task."""
    deg = agg_degree(spark, d)

    def ranks(c, name):
        v = ds.value_counts(deg, c).withColumn("before", F.coalesce(F.sum("count").over(Window.orderBy("x").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
        return v.select(F.col("x").alias(c), (F.col("before") + (F.col("count") + 1) / 2).alias(name))

    rows = deg.join(ranks("in_degree", "x"), "in_degree").join(ranks("out_degree", "y"), "out_degree")
    return rows.agg(F.round(F.corr("x", "y"), 6).alias("rho"))


@query("st_corr", b.sql(b.NODES, b.DENSE, b.SIMPLE, b.DEGREES, "select round(corr(out_degree, ln(1 + in_degree)), 6) r from deg"))
def st_corr(spark, d):
    return agg_degree(spark, d).agg(F.round(F.corr("out_degree", F.log1p("in_degree")), 6).alias("r"))


@query("st_entropy", "with s as (select n_regionkey, event_type, count(*) n from events join customer on c_custkey = user_id join nation on n_nationkey = c_nationkey group by all), t as (select *, n / sum(n) over (partition by n_regionkey) p from s) select cast(n_regionkey as bigint) region, round(-sum(p * log2(p)), 6) bits, round(max(p), 6) top_share from t group by n_regionkey")
def st_entropy(spark, d):
    rows = b.read(spark, d, "events").join(b.read(spark, d, "customer"), F.col("user_id") == F.col("c_custkey")).join(F.broadcast(b.read(spark, d, "nation")), F.col("c_nationkey") == F.col("n_nationkey"))
    s = rows.groupBy("n_regionkey", "event_type").agg(F.count("*").alias("n")).withColumn("p", F.col("n") / F.sum("n").over(Window.partitionBy("n_regionkey")))
    return s.groupBy(F.col("n_regionkey").cast("long").alias("region")).agg(F.round(ds.entropy2(F.col("p")), 6).alias("bits"), F.round(F.max("p"), 6).alias("top_share"))


@query("st_zscore", "select round((max(value) - avg(value)) / stddev_pop(value), 6) z from events")
def st_zscore(spark, d):
    return b.read(spark, d, "events").agg(F.round((F.max("value") - F.avg("value")) / F.stddev_pop("value"), 6).alias("z"))


@query("agg_median", "select event_type, round(quantile_cont(value, 0.5), 6) median from events group by 1")
def agg_median(spark, d):
    return b.read(spark, d, "events").groupBy("event_type").agg(F.round(F.expr("percentile_cont(0.5) within group (order by value)"), 6).alias("median"))


@query("flt_positive", "select event_id, value from events where value > 0")
def flt_positive(spark, d):
    return b.read(spark, d, "events").filter("value > 0").select("event_id", "value")
