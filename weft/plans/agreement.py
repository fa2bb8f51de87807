"""What runs agree on, over labels that SQL can make too: supplier by run, by nation. Regions stand for the consensus and for eras."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import community as cm
from ..operators import graph
from . import base as b
from .registry import query

RUNS = 20
LABELS = f"lab as (select cast(r as bigint) run, cast(s_suppkey as bigint) node, cast((s_nationkey * (r + 3) + s_suppkey % 2) % (2 + r % 5) as bigint) community from supplier, generate_series(0, {RUNS - 1}) g(r))"
PAIRS = f"co as (select x.node i, y.node j, count(*) / {RUNS} p from lab x join lab y on x.run = y.run and x.community = y.community and x.node < y.node group by all)"
SHARES = f"""ov as (select run, l.community, r.community agreed, count(*) n from lab l join regions r using (node) group by all), best as (select run, community, agreed, n from (select *, row_number() over (partition by run, community order by n desc, agreed) r from ov) where r = 1),
  shares as (select node, agreed community, count(*) / {RUNS} share from lab join best using (run, community) group by all)"""
LOYAL = "loy as (select r.node, r.community, coalesce(s.share, 0) loyalty from regions r left join shares s using (node, community))"


def labels(spark, d):
    s = b.read(spark, d, "supplier").select(F.col("s_suppkey").cast("long").alias("node"), "s_nationkey", F.explode(F.expr(f"sequence(0L, {RUNS - 1}L)")).alias("run"))
    return s.select("run", "node", F.expr("cast((s_nationkey * (run + 3) + node % 2) % (2 + run % 5) as bigint)").alias("community"))


def _agreed(spark, d):
    return b.regions(spark, d).select(F.col("node").cast("long").alias("node"), "community")


def _six(df, *names):
    return df.withColumns({n: F.round(n, 6) for n in names})


@query("agg_coassign_given", b.sql(LABELS, PAIRS, "select i, j, round(p, 6) p from co"))
def agg_coassign_given(spark, d):
    return _six(cm.coassignment(labels(spark, d)), "p")


@query("agg_coassign_strong", b.sql(LABELS, PAIRS, "select i, j, round(p, 6) p from co where p >= 0.5"))
def agg_coassign_strong(spark, d):
    """Pairs that share half of the runs or more, without making the others."""
    rows = labels(spark, d)
    return _six(cm.strong_pairs(rows, cm.signatures(rows), 0.5), "p")


@query("agg_share_given", b.sql(LABELS, b.REGIONS, SHARES, "select node, community, round(share, 6) share from shares"))
def agg_share_given(spark, d):
    return _six(cm.mapped_shares(labels(spark, d), _agreed(spark, d)), "share")


@query("c_membership", b.sql(LABELS, b.REGIONS, SHARES, LOYAL, "select node, community, round(loyalty, 6) loyalty from loy"))
def c_membership(spark, d):
    return _six(cm.loyalty(labels(spark, d), _agreed(spark, d)), "loyalty")


@query("jn_run_mapping_given", b.sql(LABELS, b.REGIONS, SHARES, "select run, community, agreed, n overlap from best"))
def jn_run_mapping_given(spark, d):
    both = labels(spark, d).join(_agreed(spark, d).withColumnRenamed("community", "agreed"), "node").groupBy("run", "community", "agreed").agg(F.count("*").alias("n"))
    return both.groupBy("run", "community").agg(F.expr("max_by(agreed, struct(n, -agreed))").alias("agreed"), F.max("n").alias("overlap"))


@query("agg_k_hist_given", b.sql(LABELS, "k as (select run, count(distinct community) k from lab group by run)", "select k, count(*) runs from k group by k"))
def agg_k_hist_given(spark, d):
    return labels(spark, d).groupBy("run").agg(F.count_distinct("community").alias("k")).groupBy("k").agg(F.count("*").alias("runs"))


_NMI = "ce as (select x.run a, y.run b, x.community x, y.community y, count(*) n from lab x join lab y on x.node = y.node and x.run < y.run where y.run < 5 group by all), cm as (select *, sum(n) over (partition by a, b, x) nx, sum(n) over (partition by a, b, y) ny, sum(n) over (partition by a, b) t from ce), su as (select a, b, sum(n / t * ln(n * t / (nx * ny))) mi, -sum(n / t * ln(nx / t)) hx, -sum(n / t * ln(ny / t)) hy from cm group by a, b), nm as (select case when hx + hy = 0 then 1 else 2 * mi / (hx + hy) end nmi from su)"


@query("c_pair_nmi_given", b.sql(LABELS, _NMI, "select round(min(nmi), 6) \"min\", round(avg(nmi), 6) \"mean\", round(max(nmi), 6) \"max\" from nm"))
def c_pair_nmi_given(spark, d):
    pairs = [(a, b_) for a in range(5) for b_ in range(a + 1, 5)]
    return _six(cm.pair_nmi(labels(spark, d), pairs).agg(F.min("nmi").alias("min"), F.avg("nmi").alias("mean"), F.max("nmi").alias("max")), "min", "mean", "max")


@query("c_collapse", b.sql(LABELS, b.REGIONS, SHARES, "select node, case when community < 2 then community else -1 end tradition, round(sum(share), 6) share from shares group by all"))
def c_collapse(spark, d):
    """Regions 0 and 1 are traditions, all others one class."""
    known = spark.createDataFrame([(0, 0), (1, 1)], "community long, tradition long")
    return _six(cm.collapsed(cm.mapped_shares(labels(spark, d), _agreed(spark, d)), known), "share")


@query("agg_hosts", b.sql(LABELS, "an(node, ord, nm) as (values (2, 0, 'Second'), (3, 1, 'Third'), (5, 2, 'Fifth')), f as (select run, community from lab where node = 1), h as (select f.run, coalesce(string_agg(nm, ' + ' order by ord), 'none of the anchors') hosts from f left join (select lab.run, lab.community, nm, ord from lab join an using (node)) x on x.run = f.run and x.community = f.community group by f.run)", "select hosts, count(*) runs from h group by hosts"))
def agg_hosts(spark, d):
    return cm.hosts(labels(spark, d), 1, {2: "Second", 3: "Third", 5: "Fifth"})


@query("agg_bloc_mean", b.sql(LABELS, PAIRS, "bl as (select s_suppkey node from supplier where s_nationkey < 8), t as (select count(*) * (count(*) - 1) // 2 pairs from bl)", "select any_value(pairs) pairs, round(coalesce(sum(p), 0) / nullif(any_value(pairs), 0), 6) \"mean\" from t left join co on i in (select node from bl) and j in (select node from bl)"))
def agg_bloc_mean(spark, d):
    bloc = b.read(spark, d, "supplier").filter("s_nationkey < 8").select(F.col("s_suppkey").cast("long").alias("node"))
    return _six(cm.bloc_mean(cm.coassignment(labels(spark, d)), bloc), "mean")


_ERA = "er as (select r.node, r.community era, l.community, l.loyalty from regions r join loy l using (node)), pe as (select era, count(*) n, round(avg(loyalty), 3) mean_loyalty, round(avg(case when loyalty < 0.5 then 1.0 else 0.0 end), 3) below_half from er group by era), cl as (select era, x.community, count(*) c from er join lab x on x.node = er.node and x.run = 0 group by all), p as (select era, c / n p from cl join pe using (era))"


@query("agg_era_rows_given", b.sql(LABELS, b.REGIONS, SHARES, LOYAL, _ERA, "select era, n, mean_loyalty, below_half, round(max(p), 3) top_share, round(-sum(p * log2(p)), 3) entropy_bits from pe join p using (era) group by all"))
def agg_era_rows_given(spark, d):
    """By region: nodes, loyalty, and how the first run's communities share it."""
    rows = cm.loyalty(labels(spark, d), _agreed(spark, d)).select("node", F.col("community").alias("era"), "loyalty")
    per = rows.groupBy("era").agg(F.count("*").alias("n"), F.round(F.avg("loyalty"), 3).alias("mean_loyalty"), F.round(F.avg((F.col("loyalty") < 0.5).cast("double")), 3).alias("below_half"))
    first = labels(spark, d).filter("run = 0").select("node", "community")
    p = rows.join(first, "node").groupBy("era", "community").agg(F.count("*").alias("c")).join(per.select("era", "n"), "era").withColumn("p", F.col("c") / F.col("n"))
    return per.join(p.groupBy("era").agg(F.round(F.max("p"), 3).alias("top_share"), F.round(-F.sum(F.col("p") * F.log2("p")), 3).alias("entropy_bits")), "era")


_ERAS = "er as (select r.node, r.community era, l.loyalty, case when x.community < 2 then x.community else -1 end tradition from regions r join loy l using (node) join lab x on x.node = r.node and x.run = 0), pe as (select era, count(*) n, avg(loyalty) m, avg(case when loyalty < 0.5 then 1.0 else 0.0 end) h from er group by era), ct as (select era, tradition, count(*) c, count(*) / any_value(n) p from er join pe using (era) group by era, tradition)"


@query("agg_era_traditions", b.sql(LABELS, b.REGIONS, SHARES, LOYAL, _ERAS, "select era, n, round(m, 6) mean_loyalty, round(h, 6) below_half, round(max(p), 6) top_share, round(-sum(p * log2(p)), 6) entropy_bits, list(struct_pack(tradition := cast(tradition as bigint), n := c) order by tradition) counts from pe join ct using (era) group by all"))
def agg_era_traditions(spark, d):
    """By region: nodes, loyalty, and how many nodes each tradition (a community of the first run, -1 for the rest) has."""
    first = labels(spark, d).filter("run = 0").select("node", F.expr("if(community < 2, community, -1L)").alias("tradition"))
    rows = cm.loyalty(labels(spark, d), _agreed(spark, d)).select("node", F.col("community").alias("era"), "loyalty").join(first, "node")
    return _six(cm.era_rows(rows), "mean_loyalty", "below_half", "top_share", "entropy_bits")


@query("c_anchor_given", b.sql(b.NATIONS, "an(node, tradition) as (values (2, 0), (3, 1), (5, 2)), t as (select community, max(tradition) tradition from nations join an using (node) group by 1)", "select node, coalesce(tradition, -1) tradition from nations left join t using (community)"))
def c_anchor_given(spark, d):
    return cm.anchored(b.nations(spark, d), {2: 0, 3: 1, 5: 2})


_TUG = "pk as (select loy.node, degree, loyalty from loy join st using (node) where degree >= 8), low as (select * from pk order by round(loyalty, 9), node limit 14)"


@query("js_tug", b.sql(b.WEIGHTED, b.STRENGTH, LABELS, b.REGIONS, SHARES, LOYAL, _TUG, "select node, degree, round(loyalty, 6) loyalty from low union select loy.node, degree, round(loyalty, 6) from loy join st using (node) where loy.node in (1, 2)"))
def js_tug(spark, d):
    """The least loyal of those with eight links, and two by name."""
    rows = cm.loyalty(labels(spark, d), _agreed(spark, d)).join(graph.strengths(b.weighted(spark, d)), "node").select("node", "degree", "loyalty")
    low = rows.filter("degree >= 8").orderBy(F.round("loyalty", 9), "node").limit(14)
    return _six(low.union(rows.filter("node in (1, 2)")), "loyalty").distinct()
