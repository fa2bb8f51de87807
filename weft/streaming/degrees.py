"""An extension: running degree counts over a stream of edges, the same as the batch ones once all edges have arrived."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def running_degrees(edges: DataFrame) -> DataFrame:
    """node, in_degree, out_degree of a streaming edge table (src, dst). Edges are counted as they come; the state is a row of each node."""
    ends = edges.select(F.explode(F.array(F.struct(F.col("src").alias("node"), F.lit(0).alias("into"), F.lit(1).alias("out")), F.struct(F.col("dst").alias("node"), F.lit(1).alias("into"), F.lit(0).alias("out")))).alias("x")).select("x.*")
    return ends.groupBy("node").agg(F.sum("into").alias("in_degree"), F.sum("out").alias("out_degree"))


def windowed_counts(events: DataFrame, ts: str = "ts", late: str = "1 hour", width: str = "1 day") -> DataFrame:
    """window, event_type, n with a watermark: rows later than that are dropped, windows that it has passed are final."""
    timed = events.withColumn("at", F.col(ts).cast("timestamp")).withWatermark("at", late)
    return timed.groupBy(F.window("at", width), "event_type").agg(F.count("*").alias("n"))
