"""Degree distributions: value counts, logarithmic bins, CCDF, power laws and samples."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def value_counts(df: DataFrame, value: str) -> DataFrame:
    return df.groupBy(F.col(value).alias("x")).agg(F.count("*").alias("count"))


def doubling_edges(largest: int, width1_max: int = 7) -> list[int]:
    """1 to width1_max one by one, then doubling until largest is passed."""
    out = list(range(1, width1_max + 1))
    while out[-1] < largest:
        out.append(out[-1] * 2)
    return out


def histogram(df: DataFrame, value: str, edges: list, closed: bool = True) -> DataFrame:
    """bin (from 0), lo, hi, count of the values within edges; the last bin is closed on the right. Empty bins are left out."""
    bounds = F.array(*[F.lit(float(e)) for e in edges])
    at = F.size(F.filter(bounds, lambda e: e <= F.col(value))) - 1
    last = len(edges) - 2
    place = F.when(F.col(value) == F.lit(float(edges[-1])), F.lit(last if closed else last + 1)).otherwise(at)
    rows = df.filter(F.col(value).between(float(edges[0]), float(edges[-1]))).groupBy(place.alias("bin")).agg(F.count("*").alias("count"))
    return rows.filter(F.col("bin") <= last).select(F.col("bin").cast("long").alias("bin"), bounds[F.col("bin")].alias("lo"), bounds[F.col("bin") + 1].alias("hi"), "count")


def log_bins(df: DataFrame, value: str, width1_max: int = 7) -> DataFrame:
    """x (geometric mean of the integers of a bin), y (count by width), over doubling bins of positive integers."""
    largest = df.agg(F.max(value)).first()[0]
    if largest is None:
        return df.sparkSession.createDataFrame([], "bin long, x double, y double")
    rows = histogram(df, value, doubling_edges(int(largest), width1_max))
    x = F.expr("exp(aggregate(transform(sequence(cast(lo as long), cast(hi as long) - 1), k -> ln(k)), 0d, (a, b) -> a + b) / (hi - lo))")
    return rows.select("bin", x.alias("x"), (F.col("count") / (F.col("hi") - F.col("lo"))).alias("y"))


def log_density(df: DataFrame, value: str, bins: int = 30) -> DataFrame:
    """x (geometric middle), y (density) over bins of equal ratio between the smallest and the largest positive value."""
    positive = df.filter(F.col(value) > 0)
    lo, hi, n = positive.agg(F.min(value), F.max(value), F.count("*")).first()
    if not n or lo == hi:
        return df.sparkSession.createDataFrame([], "bin long, x double, y double")
    edges = [float(lo) * (float(hi) / float(lo)) ** (k / bins) for k in range(bins)] + [float(hi)]
    rows = histogram(positive, value, edges)
    return rows.select("bin", F.sqrt(F.col("lo") * F.col("hi")).alias("x"), (F.col("count") / (F.col("hi") - F.col("lo")) / F.lit(float(n))).alias("y"))


def ccdf(df: DataFrame, value: str) -> DataFrame:
    """x, y = share of the positive values that are at least x, by the distinct values (their counts are few)."""
    c = value_counts(df.filter(F.col(value) > 0), value)
    order = Window.orderBy(F.desc("x"))
    total = c.agg(F.sum("count").alias("total"))
    return c.withColumn("up", F.sum("count").over(order)).join(total).select("x", F.round(F.col("up") / F.col("total"), 6).alias("y"))


def ba_edges_parameter(n: int, m: int, largest: int = 14) -> int:
    """c of 1..largest with c * (n - c) nearest to m; the smaller of equals."""
    return min(range(1, largest + 1), key=lambda c: (abs(c * (n - c) - m), c))


def exponential_sample(spark: SparkSession, n: int = 10_000, scale: float = 5.0, seed: int = 42) -> DataFrame:
    return spark.range(n).select("id", (-F.lit(scale) * F.log(1 - F.rand(seed))).alias("x"))


def powerlaw_sample(spark: SparkSession, n: int = 10_000, alpha: float = 2.5, xmin: float = 1.0, seed: int = 42) -> DataFrame:
    return spark.range(n).select("id", (F.lit(xmin) * F.pow(1 - F.rand(seed), F.lit(-1 / (alpha - 1)))).alias("x"))


def zeta(s: float, q: np.ndarray) -> np.ndarray:
    """Hurwitz zeta by Euler-Maclaurin summation."""
    q = np.asarray(q, float)
    out, n = np.zeros_like(q), 20
    for k in range(n):
        out += (q + k) ** -s
    a = q + n
    out += a ** (1 - s) / (s - 1) + 0.5 * a**-s + s * a ** (-s - 1) / 12 - s * (s + 1) * (s + 2) * a ** (-s - 3) / 720
    return out


def _golden(f, lo: float, hi: float) -> float:
    """Where f is smallest between lo and hi."""
    r = (math.sqrt(5) - 1) / 2
    a, b = hi - r * (hi - lo), lo + r * (hi - lo)
    fa, fb = f(a), f(b)
    for _ in range(80):
        if fa < fb:
            hi, b, fb = b, a, fa
            a = hi - r * (hi - lo)
            fa = f(a)
        else:
            lo, a, fa = a, b, fb
            b = lo + r * (hi - lo)
            fb = f(b)
    return (lo + hi) / 2


def fit_at(x: np.ndarray, c: np.ndarray, xmin: int) -> tuple[float, float]:
    """Exponent by maximum likelihood and the Kolmogorov-Smirnov distance, for the values from xmin on."""
    keep = x >= xmin
    x, c = x[keep], c[keep]
    n, logs = c.sum(), (c * np.log(x)).sum()
    alpha = _golden(lambda a: a * logs + n * math.log(zeta(a, np.array([xmin]))[0]), 1.01, 6.0)
    model = 1 - zeta(alpha, x + 1.0) / zeta(alpha, np.array([float(xmin)]))[0]
    return alpha, float(np.abs(np.cumsum(c) / n - model).max())


def powerlaw_fit(values: DataFrame, value: str) -> DataFrame:
    """xmin, alpha, distance, chosen: a fit from each candidate xmin, in parallel; the chosen one has the smallest distance. The
    values' histogram (one row of each distinct value) goes to every candidate."""
    hist = value_counts(values.filter(F.col(value) > 0), value).groupBy().agg(F.sort_array(F.collect_list(F.struct("x", "count"))).alias("h"))
    rows = hist.select(F.explode(F.expr("transform(slice(h, 1, greatest(size(h) - 1, 0)), e -> e.x)")).alias("xmin"), "h")

    def run(batches):
        for pdf in batches:
            out = []
            for xmin, h in zip(pdf["xmin"], pdf["h"]):
                x, c = np.array([e["x"] for e in h], float), np.array([e["count"] for e in h], float)
                out.append((int(xmin), *fit_at(x, c, int(xmin))))
            yield pd.DataFrame(out, columns=["xmin", "alpha", "distance"])

    fits = rows.repartition("xmin").mapInPandas(run, "xmin long, alpha double, distance double")
    best = fits.orderBy("distance", "xmin").limit(1).select(F.col("xmin").alias("best"))
    return fits.join(F.broadcast(best)).select("xmin", "alpha", "distance", (F.col("xmin") == F.col("best")).alias("chosen"))


def likelihood_ratio(values: DataFrame, value: str, xmin: int, alpha: float) -> DataFrame:
    """alternative, r, p: log likelihood of the power law less that of each alternative, and the two-sided p of its sign."""
    rows = value_counts(values.filter(F.col(value) >= xmin), value).groupBy().agg(F.sort_array(F.collect_list(F.struct("x", "count"))).alias("h"))

    def run(batches):
        for pdf in batches:
            for h in pdf["h"]:
                x, c = np.array([e["x"] for e in h], float), np.array([e["count"] for e in h], float)
                n = c.sum()
                power = -alpha * np.log(x) - math.log(zeta(alpha, np.array([float(xmin)]))[0])
                mean = (c * (x - xmin)).sum() / n
                rate = math.log(1 + 1 / mean) if mean > 0 else 50.0
                exponential = math.log(1 - math.exp(-rate)) - rate * (x - xmin)

                def lognormal(mu, sigma):
                    cdf = lambda v: 0.5 * np.array([math.erfc(-(math.log(t) - mu) / (sigma * math.sqrt(2))) for t in v])
                    tail = max(1e-300, 1 - cdf([xmin - 0.5])[0])
                    return np.log(np.maximum(1e-300, (cdf(x + 0.5) - cdf(x - 0.5)) / tail))

                logs = np.log(x)
                mu, sigma = float((c * logs).sum() / n), float(max(0.1, np.sqrt((c * (logs - (c * logs).sum() / n) ** 2).sum() / n)))
                for _ in range(12):
                    mu = _golden(lambda m: -(c * lognormal(m, sigma)).sum(), mu - 4, mu + 4)
                    sigma = _golden(lambda s: -(c * lognormal(mu, s)).sum(), 0.05, 6.0)
                out = []
                for name, other in (("exponential", exponential), ("lognormal", lognormal(mu, sigma))):
                    d = power - other
                    r = float((c * d).sum())
                    var = float((c * (d - r / n) ** 2).sum() / n)
                    out.append((name, r, math.erfc(abs(r) / math.sqrt(2 * n * var)) if var > 0 else 1.0))
                yield pd.DataFrame(out, columns=["alternative", "r", "p"])

    return rows.mapInPandas(run, "alternative string, r double, p double")


def fit_line(ccdf_rows: DataFrame, alpha: float, xmin: int) -> DataFrame:
    """x, y of the fitted CCDF, anchored where the observed one has xmin."""
    anchor = ccdf_rows.filter(F.col("x") == xmin).select(F.col("y").alias("anchor"))
    return ccdf_rows.filter(F.col("x") >= xmin).join(anchor).select("x", F.round(F.col("anchor") * F.pow(F.col("x") / xmin, F.lit(-(alpha - 1))), 6).alias("y"))


def entropy2(p: Column) -> Column:
    return -F.sum(F.when(p > 0, p * F.log2(p)).otherwise(0.0))
