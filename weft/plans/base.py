"""The graphs and texts that the queries run on, as tables and as SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators import graph

#: an event is severe from this value on
SEVERE = 150


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def _handed(events: DataFrame) -> DataFrame:
    """Edges from a user to the next one of the same day."""
    day = Window.partitionBy(F.to_date("ts")).orderBy("ts", "event_id")
    edges = events.select(F.col("user_id").alias("src"), F.lead("user_id").over(day).alias("dst")).filter("dst is not null and src <> dst")
    return graph.build(edges)


def nodes(spark: SparkSession, d: str) -> DataFrame:
    return read(spark, d, "events").select(F.col("user_id").alias("node")).distinct()


def dense(spark: SparkSession, d: str) -> DataFrame:
    """Purchases: a user to the next one of that day."""
    return _handed(read(spark, d, "events").filter("event_type = 'purchase'"))


def sparse(spark: SparkSession, d: str) -> DataFrame:
    """Severe errors: a user to the next one of that day."""
    return _handed(read(spark, d, "events").filter(f"event_type = 'error' and value >= {SEVERE}"))


def weighted(spark: SparkSession, d: str) -> DataFrame:
    """Suppliers that deliver for one order; weight: such pairs of lines' suppliers, one for each order."""
    a = read(spark, d, "lineitem").select("l_orderkey", F.col("l_suppkey").alias("s")).distinct()
    pairs = a.select("l_orderkey", F.col("s").alias("src")).join(a.select("l_orderkey", F.col("s").alias("dst")), "l_orderkey").filter("src < dst")
    return pairs.groupBy("src", "dst").agg(F.count("*").alias("weight"))


def regions(spark: SparkSession, d: str) -> DataFrame:
    """node, community: a supplier's region."""
    return read(spark, d, "supplier").join(read(spark, d, "nation"), F.col("s_nationkey") == F.col("n_nationkey")).select(F.col("s_suppkey").alias("node"), F.col("n_regionkey").cast("long").alias("community"))


def nations(spark: SparkSession, d: str) -> DataFrame:
    return read(spark, d, "supplier").select(F.col("s_suppkey").alias("node"), F.col("s_nationkey").cast("long").alias("community"))


_HANDED = "select user_id src, lead(user_id) over (partition by cast(ts as date) order by ts, event_id) dst from events where {}"
NODES = "nodes as (select distinct user_id node from events)"
DENSE = f"e0 as ({_HANDED.format("event_type = 'purchase'")}), edges as (select distinct src, dst from e0 where dst is not null and src <> dst)"
SPARSE = f"e0 as ({_HANDED.format(f"event_type = 'error' and value >= {SEVERE}")}), edges as (select distinct src, dst from e0 where dst is not null and src <> dst)"
SIMPLE = "simple as (select distinct least(src, dst) src, greatest(src, dst) dst from edges)"
DEGREES = """deg as (select node, coalesce((select count(*) from edges where dst = node), 0) in_degree,
  coalesce((select count(*) from edges where src = node), 0) out_degree,
  coalesce((select count(*) from simple where src = node or dst = node), 0) degree from nodes)"""
COMPONENTS = """reach(node, other) as (select node, node from nodes union
  select r.node, case when s.src = r.other then s.dst else s.src end from reach r join simple s on s.src = r.other or s.dst = r.other),
  comp as (select node, min(other) component from reach group by node)"""
WEIGHTED = """ls as (select distinct l_orderkey, l_suppkey s from lineitem),
  w as (select a.s src, b.s dst, count(*) weight from ls a join ls b on a.l_orderkey = b.l_orderkey and a.s < b.s group by all)"""
STRENGTH = "ends as (select src node, weight from w union all select dst, weight from w), st as (select node, count(*) degree, cast(sum(weight) as bigint) strength from ends group by node)"
DISPARITY = """disp as (select w.src, w.dst, w.weight, least(case when a.degree <= 1 then 1.0 else pow(1 - w.weight / a.strength, a.degree - 1) end,
  case when b.degree <= 1 then 1.0 else pow(1 - w.weight / b.strength, b.degree - 1) end) p from w join st a on a.node = w.src join st b on b.node = w.dst)"""
REGIONS = "regions as (select s_suppkey node, cast(n_regionkey as bigint) community from supplier join nation on s_nationkey = n_nationkey)"
NATIONS = "nations as (select s_suppkey node, cast(s_nationkey as bigint) community from supplier)"


def sql(*parts: str, recursive: bool = False) -> str:
    return ("with recursive " if recursive else "with ") + ",\n".join(parts[:-1]) + "\n" + parts[-1]
