"""Approximate nearest neighbours by the largest inner product: inverted lists with an adaptive scan of dimensions.

Vectors get one more dimension, sqrt(M^2 - |x|^2) with M the largest norm, so that the largest inner product is the smallest
distance; then all are turned by one random rotation, after which any block of leading dimensions is a random sample of the
distance. Lists come from k-means on a bounded sample; every vector goes to its nearest list. A query's k-th distance to the sample
bounds the one sought from above and goes with the query to every list that it probes. A list is scanned by blocks of columns: after
each block a candidate is given up when its partial distance, scaled to all dimensions, exceeds that bound by more than the
hypothesis test allows; while most pairs live their blocks are matrix products, then the rest go pair by pair. What survives is
scored exactly, in double precision, on the original vectors. Lists are dealt out in slices of about SLICE vectors, the queries that
probe a list in groups of about ASKED, and each slice meets each group in a task of its own, so no list is one task and no task
holds all queries. All queries against all vectors of their lists are a number of pairs that grows with the square; what is shuffled
for it grows with that divided by SLICE and ASKED.

Defined results: vectors that are null, zero, of another length than most, or hold null or non-finite components take no part;
ties go to the smaller vec_id; a query with fewer candidates gets all that its probed lists have, and all there are where LISTS
probes cover everything; repeated rows of one vec_id are one vector each, and none of them is a candidate for its own id.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window
from pyspark.sql import functions as F

#: rows that k-means is fitted on, at most
SAMPLE = 20_000
LISTS = 128
#: vectors without clusters need many; 0.96 to 0.98 of the true neighbours were measured on such
PROBES = 96
SLICE = 32768
#: queries that a slice meets at once
ASKED = 32768
BLOCK = 16
#: deviation of the scaled partial distance that the test allows: (1 + EPSILON / sqrt(d)) squared
EPSILON = 2.1


def clean(vectors: DataFrame) -> DataFrame:
    """vec_id, x (double array) of the vectors that take part; their length is the most frequent one (of equals, the largest)."""
    x = F.col("embedding").cast("array<double>")
    ok = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), x.alias("x")).filter("x is not null and size(x) > 0 and vec_id is not null")
    ok = ok.filter(F.expr("forall(x, e -> e is not null and not isnan(e) and abs(e) < double('Infinity')) and exists(x, e -> e <> 0)"))
    dims = ok.groupBy(F.size("x").alias("d")).count().orderBy(F.desc("count"), F.desc("d")).first()
    return ok.filter(F.size("x") == (dims.d if dims else 0))


class Quantizer:
    """Rotation and lists."""

    def __init__(self, ids: np.ndarray, sample: np.ndarray, norm: float, lists: int = LISTS, rounds: int = 12, seed: int = 11):
        rng = np.random.default_rng(seed)
        d = sample.shape[1] + 1
        self.norm = norm
        self.rotation = np.linalg.qr(rng.normal(size=(d, d)))[0]
        self.ids, self.sample = ids, self.turn(sample)
        x = self.sample
        self.centers = x[rng.choice(len(x), min(lists, len(x)), replace=False)]
        for _ in range(rounds):
            own = self.nearest(x, 1)[:, 0]
            for k in range(len(self.centers)):
                mine = x[own == k]
                if len(mine):
                    self.centers[k] = mine.mean(axis=0)

    def turn(self, x: np.ndarray, query: bool = False) -> np.ndarray:
        last = np.zeros(len(x)) if query else np.sqrt(np.maximum(0, self.norm**2 - (x * x).sum(axis=1)))
        return np.concatenate([x, last[:, None]], axis=1) @ self.rotation

    def nearest(self, x: np.ndarray, k: int) -> np.ndarray:
        far = (self.centers**2).sum(axis=1) - 2 * x @ self.centers.T
        return np.argsort(far, axis=1, kind="stable")[:, :k]


    def bounds(self, ids: np.ndarray, queries: np.ndarray, k: int) -> np.ndarray:
        """Of each query (turned): the k-th distance, squared, to the sample without the query's own id; infinite if there are fewer."""
        out = np.full(len(ids), np.inf)
        for a in range(0, len(ids), 256):
            far = squares(queries[a : a + 256], self.sample)
            far[ids[a : a + 256, None] == self.ids[None, :]] = np.inf
            if far.shape[1] >= k:
                out[a : a + 256] = np.partition(far, k - 1, axis=1)[:, k - 1] * (1 + 1e-9) + 1e-12
        return out


def fit(vectors: DataFrame, sample: int = SAMPLE) -> Quantizer | None:
    """On the rows with the smallest hashes of vec_id; None without any."""
    norm = vectors.agg(F.max(F.expr("aggregate(x, double(0), (s, e) -> s + e * e)"))).first()[0]
    rows = vectors.orderBy(F.xxhash64("vec_id"), "vec_id", "x").limit(sample).collect() if norm else []
    return Quantizer(np.array([r.vec_id for r in rows]), np.array([r.x for r in rows]), float(np.sqrt(norm))) if rows else None


def matrix(column) -> np.ndarray:
    return np.stack(column.combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)) if len(column) else np.zeros((0, 1))


def scan(query_ids: np.ndarray, turned: np.ndarray, queries: np.ndarray, limit: np.ndarray, ids: np.ndarray, block: np.ndarray, exact: np.ndarray, k: int) -> list[tuple[int, int, float]]:
    """query_id, vec_id and score of the k best of a slice of a list for each query; turned and block are rotated, queries and exact
    are original vectors, limit bounds each query's k-th distance from above. ids are ascending."""
    out = []
    for a in range(0, len(query_ids), 256):
        out += _scan(query_ids[a : a + 256], turned[a : a + 256], queries[a : a + 256], limit[a : a + 256], ids, block, exact, k)
    return out


def _scan(query_ids, turned, queries, limit, ids, block, exact, k):
    d, n = block.shape[1], len(block)
    alive = ids[None, :] != query_ids[:, None]
    far = np.zeros((len(query_ids), n))
    row, col = None, None
    for c in range(0, d, BLOCK):
        part = slice(c, c + BLOCK)
        seen = min(c + BLOCK, d)
        bound = limit * ((1 + EPSILON / np.sqrt(seen)) ** 2 * seen / d if seen < d else 1)
        if row is None:
            far += squares(turned[:, part], block[:, part])
            alive &= far <= bound[:, None]
            if alive.mean() < 0.1:  # from here on pair by pair
                row, col = np.nonzero(alive)
                left = far[row, col]
        else:
            left = left + ((turned[row, part] - block[col, part]) ** 2).sum(axis=1)
            keep = left <= bound[row]
            row, col, left = row[keep], col[keep], left[keep]
    if row is None:
        row, col = np.nonzero(alive)
        left = far[row, col]
    # of what survives, all that are no farther than the k-th are scored
    at = np.searchsorted(row, np.arange(len(query_ids) + 1))
    out = []
    for q, (a, b) in enumerate(zip(at, at[1:])):
        mine = col[a:b]
        if b - a > k:
            mine = mine[left[a:b] <= np.partition(left[a:b], k - 1)[k - 1] * (1 + 1e-9) + 1e-12]
        dot = (exact[mine] * queries[q]).sum(axis=1)
        best = np.lexsort((ids[mine], -dot))[:k]
        out += zip([int(query_ids[q])] * len(best), ids[mine[best]].tolist(), dot[best].tolist())
    return out


def squares(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Squared distances of all pairs."""
    return np.maximum(0, (x * x).sum(axis=1)[:, None] + (y * y).sum(axis=1)[None, :] - 2 * x @ y.T)


def dealt_out(data: DataFrame, probing: DataFrame) -> DataFrame:
    """list, slice, part, side (0: data, 1: probing), vec_id, x, bound: each slice of a list's vectors with each group of the queries that
    probe the list. data: list, vec_id, x; probing: bound too."""
    sizes = data.groupBy("list").agg(F.expr(f"cast(ceil(count(*) / {SLICE}) as int)").alias("slices"))
    sizes = sizes.join(probing.groupBy("list").agg(F.expr(f"cast(ceil(count(*) / {ASKED}) as int)").alias("parts")), "list")
    sizes = F.broadcast(sizes)  # LISTS rows at most
    of = lambda count: F.expr(f"cast(pmod(xxhash64(vec_id), {count}) as int)")
    every = lambda count: F.explode(F.expr(f"sequence(0, {count} - 1)"))
    held = data.join(sizes, "list").select("list", of("slices").alias("slice"), every("parts").alias("part"), F.lit(0).alias("side"), "vec_id", "x", F.lit(float("inf")).alias("bound"))
    asked = probing.join(sizes, "list").select("list", every("slices").alias("slice"), of("parts").alias("part"), F.lit(1).alias("side"), "vec_id", "x", "bound")
    return held.union(asked)


def search(vectors: DataFrame, queries: DataFrame, k: int = 20, probes: int = PROBES) -> DataFrame:
    """query_id, rank (from 1), vec_id, score. vectors and queries: vec_id, embedding."""
    spark = vectors.sparkSession
    known, asked = clean(vectors), clean(queries)
    quantizer = fit(known)
    schema = "query_id long, rank int, vec_id long, score double"
    if quantizer is None:
        return spark.createDataFrame([], schema)
    held = spark.sparkContext.broadcast(quantizer)  # LISTS centers, a rotation and SAMPLE vectors

    def listed(probe, asks):
        def run(batches):
            q = held.value
            for batch in batches:
                if batch.num_rows:
                    x = matrix(pa.chunked_array([batch.column("x")]))
                    turned = q.turn(x, asks)
                    near = q.nearest(turned, probe)
                    bound = q.bounds(batch.column("vec_id").to_numpy(), turned, k) if asks else np.full(len(x), np.inf)
                    yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(near.astype(np.int32).tolist(), pa.list_(pa.int32())), pa.array(bound)], names=["vec_id", "x", "lists", "bound"])

        return run

    fields = "vec_id long, x array<double>, lists array<int>, bound double"
    data = known.mapInArrow(listed(1, False), fields).select("vec_id", "x", F.col("lists")[0].alias("list"))
    probing = asked.filter(F.size("x") == F.lit(quantizer.rotation.shape[0] - 1)).mapInArrow(listed(probes, True), fields).select("vec_id", "x", "bound", F.explode("lists").alias("list"))

    def compare(table: pa.Table) -> pa.Table:
        q, side = held.value, table.column("side").to_numpy()
        ids, x = table.column("vec_id").to_numpy(), matrix(table.column("x"))
        order = np.argsort(ids, kind="stable")
        ids, x, side, bound = ids[order], x[order], side[order], table.column("bound").to_numpy()[order]
        mine, ask = side == 0, side == 1
        block, turned = q.turn(x[mine]), q.turn(x[ask], True)
        out = scan(ids[ask], turned, x[ask], bound[ask], ids[mine], block, x[mine], k)
        columns = list(zip(*out)) or [[]] * 3
        return pa.table([pa.array(columns[0], pa.int64()), pa.array(columns[1], pa.int64()), pa.array(columns[2], pa.float64())], names=["query_id", "vec_id", "score"])

    found = dealt_out(data, probing).groupBy("list", "slice", "part").applyInArrow(compare, "query_id long, vec_id long, score double")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
