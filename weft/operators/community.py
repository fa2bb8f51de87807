"""Communities by many runs of Louvain's method, and what the runs agree on. Moves never join components, so a task's work is some of the
runs on one component, with the whole graph's weight; components and runs are spread over tasks and nothing goes through the driver."""

from __future__ import annotations

import math
import zlib
from collections import deque

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..storage import written
from .components import SMALL, components, salted
from .graph import ranked
from .packs import batches, dealt, packed

#: edges of one component, or of a graph that is rewired, at most
MOST_EDGES = 20_000_000
#: tasks that the runs on a whole graph are spread over; a component has its share of them by its edges, one at least
SPREAD = 64
#: ends of edges that Louvain's moves hold as lists, at most, and of a node on average; beyond either as arrays; chooses the way, not the result
LISTED, FEW = 4_000_000, 64
#: pairs of nodes that a task makes, about
PAIRS = 4_000_000


def louvain(n: int, src: np.ndarray, dst: np.ndarray, w: np.ndarray, seed, total: float | None = None) -> np.ndarray:
    """Labels 0..k-1 of n nodes: local moves until none gains modularity, then the same on the graph of communities. total: twice the
    weight of the graph that these edges are a component of. Nodes are looked at in a random order, and again when a neighbour has gone."""
    apart = src != dst
    a, b, ww = np.concatenate([src[apart], dst[apart]]), np.concatenate([dst[apart], src[apart]]), np.concatenate([w[apart], w[apart]])
    order = np.argsort(a, kind="stable")
    first = np.searchsorted(a[order], np.arange(n + 1))
    return _louvain(first, b[order].astype(np.int32), ww[order], np.bincount(src[~apart], w[~apart], n), seed, 2 * w.sum() if total is None else total)


def _louvain(first: np.ndarray, b: np.ndarray, ww: np.ndarray, loops: np.ndarray, seed, total: float) -> np.ndarray:
    """louvain of a graph whose node v has the neighbours b[first[v]:first[v + 1]] with weights ww there, and a loop of weight loops[v]."""
    rng, of = np.random.default_rng(seed), np.arange(len(loops))
    while total > 0:
        size = len(loops)
        degree = 2.0 * loops
        some = np.flatnonzero(np.diff(first))
        if len(some):
            degree[some] += np.add.reduceat(ww, first[some], dtype=float)
        label, moved_any = (_few if len(b) <= min(LISTED, FEW * size) else _many)(first, b, ww, degree, total, rng)
        _, label = np.unique(label, return_inverse=True)
        of = label[of]
        if not moved_any:
            break
        first, b, ww, loops = _joined(first, b, ww, loops, label)
    return of


def _few(first, b, ww, degree, total, rng):
    """_many for nodes with few neighbours, for which a list takes less time than an array."""
    size, at, near, weights = len(degree), first.tolist(), b.tolist(), ww.tolist()
    label, mass, of_all, own_mass = list(range(size)), degree.tolist(), degree.tolist(), (degree / total).tolist()
    moved_any, moved = False, True
    while moved:
        moved, queue, waiting = False, deque(rng.permutation(size).tolist()), bytearray(b"\1") * size
        while queue:
            v = queue.popleft()
            waiting[v] = 0
            own, part, others = label[v], own_mass[v], near[at[v] : at[v + 1]]
            mass[own] -= of_all[v]
            links: dict[int, float] = {}
            for u, x in zip(others, weights[at[v] : at[v + 1]]):
                c = label[u]
                links[c] = links.get(c, 0.0) + x
            best, most = own, links.get(own, 0.0) - mass[own] * part
            for c, x in links.items():
                g = x - mass[c] * part
                if g > most + 1e-12:
                    best, most = c, g
            mass[best] += of_all[v]
            if best != own:
                label[v], moved, moved_any = best, True, True
                for u in others:
                    if label[u] != best and not waiting[u]:
                        waiting[u] = 1
                        queue.append(u)
    return np.array(label), moved_any


def _many(first, b, ww, degree, total, rng):
    """label of each node after local moves until none gains, and whether one moved."""
    at = first.tolist()
    size, label, mass, own_mass = len(degree), np.arange(len(degree)), degree.copy(), (degree / total).tolist()
    moved_any, moved = False, True
    while moved:
        moved, queue, waiting = False, deque(rng.permutation(size).tolist()), np.ones(size, bool)
        while queue:
            v = queue.popleft()
            waiting[v] = False
            own, i, j, part = int(label[v]), at[v], at[v + 1], own_mass[v]
            mass[own] -= degree[v]
            near, weights = label[b[i:j]], ww[i:j]
            if size <= 64 * (j - i):  # dense: all communities at once
                links = np.bincount(near, weights, size)
                gain = np.where(links > 0, links - mass * part, -np.inf)
                gain[own] = links[own] - mass[own] * part
                best = int(gain.argmax())
                if gain[best] <= gain[own] + 1e-12:
                    best = own
            else:
                links = {}
                for c, x in zip(near.tolist(), weights.tolist()):
                    links[c] = links.get(c, 0.0) + x
                best, most = own, links.get(own, 0.0) - mass[own] * part
                for c, x in links.items():
                    g = x - mass[c] * part
                    if g > most + 1e-12:
                        best, most = c, g
            mass[best] += degree[v]
            if best != own:
                label[v], moved, moved_any = best, True, True
                again = b[i:j][(near != best) & ~waiting[b[i:j]]]
                waiting[again] = True
                queue.extend(again.tolist())
    return label, moved_any


def _joined(first, b, ww, loops, label, rows: int = 1 << 20):
    """The graph of the communities (label, of each node), made from some rows at a time."""
    k, sums, start = int(label.max()) + 1, [], 0
    dense = np.zeros(k * k) if k <= 1 << 10 else None
    while start < len(loops):
        end = max(start + 1, int(np.searchsorted(first, first[start] + rows, "right")) - 1)
        i, j = first[start], first[end]
        key = np.repeat(label[start:end], np.diff(first[start : end + 1])) * k + label[b[i:j]]
        if dense is not None:
            dense += np.bincount(key, ww[i:j], k * k)
        else:
            some, inverse = np.unique(key, return_inverse=True)
            sums.append((some, np.bincount(inverse, ww[i:j], len(some))))
        start = end
    if dense is not None:
        key = np.flatnonzero(dense)
        w = dense[key]
    else:
        key, inverse = np.unique(np.concatenate([x for x, _ in sums]), return_inverse=True)
        w = np.bincount(inverse, np.concatenate([x for _, x in sums]), len(key))
    own = key // k == key % k
    loops = np.bincount(label, loops, k) + np.bincount(key[own] // k, w[own] / 2, k)  # an edge is there both ways
    key, w = key[~own], w[~own]
    return np.searchsorted(key // k, np.arange(k + 1)), (key % k).astype(np.int32), w, loops


def runs(nodes: DataFrame, edges: DataFrame, count: int = 200, weight: str | None = None) -> DataFrame:
    """run, node, community (its smallest node) for seeds 0..count-1. A component of the graph is sent in packs to as many tasks as its share
    of the edges asks for, each with some of the seeds; one with over MOST_EDGES is refused."""
    spark = nodes.sparkSession
    edges = written(edges.select("src", "dst", (F.col(weight).cast("double") if weight else F.lit(1.0)).alias("w")), "edges")
    found = written(components(edges.selectExpr("src a", "dst b"), SMALL), "components")
    tagged = edges.join(found.withColumnRenamed("node", "src"), "src")
    sizes = written(tagged.groupBy("component").agg(F.count("*").alias("m"), F.sum("w").alias("weight")), "sizes")
    whole = sizes.agg(F.sum("m").alias("m"), F.max("m").alias("most"), F.sum("weight").alias("weight")).first()
    if (whole.most or 0) > MOST_EDGES:
        raise ValueError(f"{whole.most} edges in a component; a run holds {MOST_EDGES} at most")
    lone = nodes.select("node").join(found.select("node"), "node", "left_anti").join(spark.range(count).withColumnRenamed("id", "run")).select("run", "node", F.col("node").alias("community"))
    if not whole.m:
        return lone
    sizes = sizes.selectExpr("component", f"cast(least({count}, ceil({SPREAD} * m / {whole.m})) as int) parts")
    tasks, total = min(4096, sizes.agg(F.sum("parts").alias("n")).first().n), 2 * whole.weight
    packs = packed(salted(tagged, sizes, "component", "src").selectExpr("true alone", "component bag", "parts", "src", "dst", "w"))

    def run(key, parts, ids, first, b, w):
        for seed in range(key[2], count, parts):
            label = _louvain(first, b, w, np.zeros(len(ids)), [seed, key[1] % (1 << 63)], total)
            smallest = ids[np.unique(label, return_index=True)[1]]  # nodes are in order, so the first is the smallest
            yield from batches(["run", "node", "community"], [np.full(len(ids), seed), ids, smallest[label]])

    return dealt(packs, run, "run long, node long, community long", tasks).unionByName(lone)


def random_pairs(count: int, pairs: int, seed: int = 42) -> list[tuple[int, int]]:
    """Distinct pairs a < b of count runs, all there are if they are fewer."""
    a, b = np.triu_indices(count, 1)
    at = np.random.default_rng(seed).choice(len(a), min(pairs, len(a)), replace=False)
    return list(zip(a[at].tolist(), b[at].tolist()))


def pair_nmi(labels: DataFrame, pairs: list[tuple[int, int]]) -> DataFrame:
    """a, b, nmi (as graph.nmi) of pairs of runs."""
    rows = labels.sparkSession.createDataFrame(pairs, "a long, b long")
    x = labels.join(F.broadcast(rows), F.col("run") == F.col("a")).select("a", "b", "node", F.col("community").alias("x"))  # a few hundred pairs
    y = labels.select(F.col("run").alias("b"), "node", F.col("community").alias("y"))
    cells = x.join(y, ["b", "node"]).groupBy("a", "b", "x", "y").agg(F.count("*").alias("n"))
    of = lambda c: Window.partitionBy("a", "b", *c)
    cells = cells.withColumns({"nx": F.sum("n").over(of("x")), "ny": F.sum("n").over(of("y")), "t": F.sum("n").over(of("")).cast("double")})
    # a cell's share of an entropy: its part of the row or column, so that each counts once
    sums = cells.groupBy("a", "b").agg(F.sum(F.expr("n / t * ln(n * t / (nx * ny))")).alias("mi"), (-F.sum(F.expr("n / t * ln(nx / t)"))).alias("hx"), (-F.sum(F.expr("n / t * ln(ny / t)"))).alias("hy"))
    return sums.select("a", "b", F.expr("case when hx + hy = 0 then 1d else 2 * mi / (hx + hy) end").alias("nmi"))


def coassignment(labels: DataFrame, chunk: int = 1024, tau: float = 0.0) -> DataFrame:
    """i < j, p: share of the runs that have both in one community, at least tau (pairs that never are left out)."""
    total = labels.filter("run is not null").select("run").distinct().count()
    labels = labels.filter("node is not null and run is not null and community is not null")
    sigs = labels.groupBy("node").agg(F.sort_array(F.collect_list(F.struct("run", "community"))).alias("sig"))
    return _together(labels, sigs, total, tau, chunk)


def _together(labels: DataFrame, sigs: DataFrame, total: int, tau: float, chunk: int) -> DataFrame:
    """i < j, p of pairs that share at least tau of all runs, and one. Nodes with equal signatures (node, sig) are one class: runs are compared
    for a node of each class, and pairs of classes are dealt out with their nodes in chunks, so that a pair of nodes is made once and not by
    each run."""
    spark, need = labels.sparkSession, max(1, math.ceil(tau * total - 1e-9))
    sizes = sigs.groupBy("sig").agg(F.min("node").alias("class"), F.count("*").alias("size"))
    members = written(salted(sigs, sizes, "sig", "node").selectExpr("node", "class", "size", f"cast(pmod(xxhash64(node), ceil(size / {chunk})) as int) chunk", "cast(size(sig) as long) n"), "classes")
    pairs = written(_compared(labels, members.filter("node = class").selectExpr("class node", "size = 1 single"), need, chunk), "pairs")
    own = members.filter(f"node = class and size > 1 and n >= {need}").select(F.col("class").alias("a"), F.col("class").alias("b"), "n")
    packs = members.groupBy("class", "chunk").agg(F.collect_list("node").alias("nodes"))
    both = pairs.filter("not single").select("a", "b", "n").unionByName(own).join(packs.toDF("a", "x", "is"), "a").join(packs.toDF("b", "y", "js"), "b").filter("a < b or x <= y")
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), min(4096, members.count() ** 2 // (2 * PAIRS)))
    made = both.repartition(tasks, "a", "x", "b", "y").select("a", "x", "b", "y", "js", "n", F.explode("is").alias("u")).select("a", "x", "b", "y", "n", "u", F.explode("js").alias("v"))
    made = made.filter("a < b or x < y or u < v").select(F.least("u", "v").alias("i"), F.greatest("u", "v").alias("j"), "n")
    made = made.union(pairs.filter("single").select("a", "b", "n"))
    return made.select("i", "j", (F.col("n") / F.lit(total)).alias("p"))


def _compared(labels: DataFrame, nodes: DataFrame, need: int, chunk: int) -> DataFrame:
    """a < b, n, single: how many runs pairs of nodes (node, single) share, need at least, and whether both are single. The nodes are cut into
    chunks, and each pair of chunks is compared run by run in a task: no pair is a row before it is counted."""
    many = max(1, -(-nodes.count() // chunk))
    rows = labels.join(nodes, "node").withColumn("own", F.expr(f"cast(pmod(xxhash64(node, 1), {many}) as int)"))
    packs = written(rows.groupBy("own").applyInPandas(_chunk, "own int, nodes binary, data binary"), "chunks")
    dealt = packs.withColumn("other", F.explode(F.sequence(F.lit(0), F.lit(many - 1)))).select(F.least("own", "other").alias("x"), F.greatest("own", "other").alias("y"), "own", "nodes", "data")
    tasks = max(int(nodes.sparkSession.conf.get("spark.sql.shuffle.partitions")), min(4096, many * many // 64))
    dealt = dealt.repartition(tasks, "x", "y").sortWithinPartitions("x", "y", "own")
    return dealt.mapInArrow(lambda rows: _tiles(rows, need), "a long, b long, n long, single boolean")


def _chunk(key, pdf):
    """A chunk's nodes, and by run (a row each of: run, how many communities, these in order, then the place of each node's or -1)."""
    node, at = np.unique(pdf["node"].to_numpy(), return_inverse=True)
    single = np.zeros(len(node), np.int64)
    single[at] = pdf["single"]
    order = np.argsort(pdf["run"].to_numpy(), kind="stable")
    run, community = pdf["run"].to_numpy()[order], pdf["community"].to_numpy()[order]
    out = []
    for rows in np.split(np.arange(len(run)), np.flatnonzero(np.diff(run)) + 1):
        kinds, place = np.unique(community[rows], return_inverse=True)
        codes = np.full(len(node), -1, np.int64)
        codes[at[order[rows]]] = place
        out += [[run[rows[0]], len(kinds)], kinds, codes]
    return pd.DataFrame({"own": [int(key[0])], "nodes": [zlib.compress(np.stack([node, single]).tobytes(), 1)], "data": [zlib.compress(np.concatenate(out).astype(np.int64).tobytes(), 1)]})


def _unchunked(nodes: bytes, data: bytes):
    node, single = np.frombuffer(zlib.decompress(nodes), np.int64).reshape(2, -1)
    rows, runs, at = np.frombuffer(zlib.decompress(data), np.int64), {}, 0
    while at < len(rows):
        run, k = rows[at : at + 2].tolist()
        codes = rows[at + 2 + k : at + 2 + k + len(node)].astype(np.int32)
        runs[run] = rows[at + 2 : at + 2 + k], codes
        at += 2 + k + len(node)
    return node, single > 0, runs


def _tiles(rows, need: int):
    key, one = None, None
    for some in rows:
        for x, y, nodes, data in zip(*(some.column(c) for c in ("x", "y", "nodes", "data"))):
            x, y, two = x.as_py(), y.as_py(), _unchunked(nodes.as_py(), data.as_py())
            if x == y:
                yield from _tile(two, two, need)
            elif key == (x, y):
                yield from _tile(one, two, need)
            key, one = (x, y), two


def _tile(one, two, need: int):
    (na, sa, ra), (nb, sb, rb) = one, two
    total, part, done = np.zeros((len(na), len(nb)), np.int32), np.zeros((len(na), len(nb)), np.uint8), 0
    for run in ra.keys() & rb.keys():
        (ka, ca), (kb, cb) = ra[run], rb[run]
        place = np.minimum(np.searchsorted(ka, kb), len(ka) - 1)
        cb = np.append(np.where(ka[place] == kb, place, -2), -2).astype(np.int32)[cb]  # communities of a that b's are; -2: none, as where it has no label
        part += (ca[:, None] == cb[None, :]).view(np.uint8)
        done += 1
        if done % 255 == 0:
            total += part
            part[:] = 0
    total += part
    if one is two:
        total = np.triu(total, 1)
    i, j = np.nonzero(total >= need)
    a, b = na[i], nb[j]
    yield from batches(["a", "b", "n", "single"], [np.minimum(a, b), np.maximum(a, b), total[i, j].astype(np.int64), sa[i] & sb[j]])


def signatures(labels: DataFrame) -> DataFrame:
    """node, sig: its communities by run, of labels that have every node in every run."""
    return labels.groupBy("node").agg(F.expr("transform(array_sort(collect_list(struct(run, community))), x -> x.community)").alias("sig"))


def unanimous(labels: DataFrame, sigs: DataFrame) -> bool:
    """Whether any two nodes are together in all runs or in none: signatures part the nodes as finely as any run, and no finer than the
    coarsest only then. No pair is made."""
    many = sigs.agg(F.count_distinct("sig").alias("n")).first().n
    coarsest = labels.groupBy("run").agg(F.count_distinct("community").alias("k")).agg(F.min("k").alias("k")).first().k
    return many == (coarsest or 0)


def strong_pairs(labels: DataFrame, sigs: DataFrame, tau: float = 0.5, chunk: int = 1024) -> DataFrame:
    """i < j, p of pairs that share at least tau of the runs, and no others; sigs as of signatures."""
    return _together(labels, sigs, labels.select("run").distinct().count(), tau, chunk)


def era_rows(rows: DataFrame) -> DataFrame:
    """era, n, mean_loyalty, below_half, top_share, entropy_bits, counts of rows (era, tradition, loyalty): counts has tradition and n, by tradition."""
    per = rows.groupBy("era").agg(F.count("*").alias("n"), F.avg("loyalty").alias("mean_loyalty"), F.avg((F.col("loyalty") < 0.5).cast("double")).alias("below_half"))
    c = rows.groupBy("era", "tradition").agg(F.count("*").alias("c")).join(per.select("era", "n"), "era").withColumn("p", F.col("c") / F.col("n"))
    share = c.groupBy("era").agg(F.max("p").alias("top_share"), (-F.sum(F.col("p") * F.log2("p"))).alias("entropy_bits"), F.array_sort(F.collect_list(F.struct("tradition", F.col("c").alias("n")))).alias("counts"))
    return per.join(share, "era")


def consensus(nodes: DataFrame, labels: DataFrame, tau: float = 0.5, rounds: int = 10, count: int = 20) -> DataFrame:
    """node, community that runs agree on: pairs with p >= tau make a graph that is run again until all p are 0 or 1."""
    labels = written(labels, "labels")
    for _ in range(rounds):
        sigs = written(signatures(labels), "signatures")
        if unanimous(labels, sigs):
            break
        strong = written(strong_pairs(labels, sigs, tau), "pairs").select(F.col("i").alias("src"), F.col("j").alias("dst"), F.col("p").alias("weight"))
        labels = written(runs(nodes, strong, count, "weight"), "labels")
    return labels.filter("run = 0").select("node", "community")


def mapped_shares(labels: DataFrame, agreed: DataFrame) -> DataFrame:
    """node, community, share of runs in which the node's community is mapped (by largest overlap, then the smaller id) to it."""
    both = labels.join(agreed.withColumnRenamed("community", "agreed"), "node")
    overlap = both.groupBy("run", "community", "agreed").agg(F.count("*").alias("n"))
    best = overlap.withColumn("r", F.row_number().over(Window.partitionBy("run", "community").orderBy(F.desc("n"), "agreed"))).filter("r = 1").select("run", "community", F.col("agreed").alias("to"))
    total = labels.agg(F.count_distinct("run").alias("runs"))
    return labels.join(best, ["run", "community"]).groupBy("node", "to").agg(F.count("*").alias("n")).join(total).select("node", F.col("to").alias("community"), (F.col("n") / F.col("runs")).alias("share"))


def loyalty(labels: DataFrame, agreed: DataFrame) -> DataFrame:
    """node, loyalty: share of runs spent in the community agreed on."""
    share = mapped_shares(labels, agreed)
    return agreed.join(share, ["node", "community"], "left").select("node", "community", F.coalesce("share", F.lit(0.0)).alias("loyalty"))


def collapsed(shares: DataFrame, traditions: DataFrame) -> DataFrame:
    """node, tradition, share: shares (node, community, share) summed by the tradition of the community; -1 for all others.
    traditions: community, tradition."""
    rows = shares.join(traditions.select("community", "tradition"), "community", "left")
    return rows.groupBy("node", F.coalesce("tradition", F.lit(-1)).cast("long").alias("tradition")).agg(F.sum("share").alias("share"))


def hosts(labels: DataFrame, focus: int, anchors: dict[int, str], none: str = "none of the anchors") -> DataFrame:
    """hosts, runs: which of the anchors (node to name, in their order) share the community of focus, and in how many runs."""
    rows = labels.sparkSession.createDataFrame([(n, i, name) for i, (n, name) in enumerate(anchors.items())], "node long, ord long, name string")
    own = labels.filter(F.col("node") == focus).select("run", "community")
    found = labels.join(F.broadcast(rows), "node").select("run", "community", "ord", "name")  # a row for each anchor
    per = own.join(found, ["run", "community"], "left").groupBy("run").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.when(F.col("ord").isNotNull(), F.struct("ord", "name")))), lambda x: x["name"]), " + ").alias("hosts"))
    return per.groupBy(F.when(F.col("hosts") == "", none).otherwise(F.col("hosts")).alias("hosts")).agg(F.count("*").alias("runs"))


def bloc_mean(pairs: DataFrame, bloc: DataFrame) -> DataFrame:
    """pairs, mean: of all pairs of nodes of the bloc (node), those never together (not in pairs: i, j, p) with 0."""
    rows = pairs.join(bloc.select(F.col("node").alias("i")), "i", "left_semi").join(bloc.select(F.col("node").alias("j")), "j", "left_semi")
    n = bloc.agg(F.expr("count(*) * (count(*) - 1) div 2").alias("pairs"))
    return rows.agg(F.coalesce(F.sum("p"), F.lit(0.0)).alias("s")).join(n).select("pairs", F.expr("if(pairs > 0, s / pairs, null)").alias("mean"))


def anchored(agreed: DataFrame, anchors: dict[int, int]) -> DataFrame:
    """node, tradition: the anchor's index for all nodes of an anchor's community, -1 for the rest."""
    rows = agreed.sparkSession.createDataFrame(list(anchors.items()) or [(None, None)], "node long, tradition long")
    named = agreed.join(F.broadcast(rows), "node").groupBy("community").agg(F.max("tradition").alias("tradition"))  # a row of each anchor at most
    return agreed.join(F.broadcast(named), "community", "left").select("node", F.coalesce("tradition", F.lit(-1).cast("long")).alias("tradition"))


def swapped(a: np.ndarray, b: np.ndarray, n: int, wanted: int, rng: np.random.Generator) -> tuple[np.ndarray, np.ndarray]:
    """Edges (a < b, of nodes 0..n-1) after so many double-edge swaps. All edges are paired at random at once, and pairs whose new edges
    are loops, there already, or those of another pair as well stay as they are; that again until enough are swapped."""
    half, done, tries = len(a) // 2, 0, 0
    while half and done < wanted and tries * half < 20 * wanted:
        tries += 1
        order = rng.permutation(len(a))
        i, j = order[:half], order[half : 2 * half]
        turn = rng.random(half) < 0.5
        p, q, r, s = a[i], b[i], np.where(turn, b[j], a[j]), np.where(turn, a[j], b[j])
        new = np.stack([np.minimum(p, s) * n + np.maximum(p, s), np.minimum(r, q) * n + np.maximum(r, q)])
        have = np.sort(a * n + b)
        there = have[np.minimum(np.searchsorted(have, new), len(have) - 1)] == new
        ok = np.flatnonzero((p != r) & (p != s) & (q != r) & (q != s) & ~there.any(axis=0))
        _, inverse, many = np.unique(new[:, ok].ravel(), return_inverse=True, return_counts=True)
        ok = ok[(many[inverse].reshape(2, -1) == 1).all(axis=0)][: wanted - done]
        a[i[ok]], b[i[ok]] = new[0, ok] // n, new[0, ok] % n
        a[j[ok]], b[j[ok]] = new[1, ok] // n, new[1, ok] % n
        done += len(ok)
    return a, b


def rewired(nodes: DataFrame, edges: DataFrame, count: int = 20, swaps: int = 5) -> DataFrame:
    """graph, src, dst of double-edge-swap copies: swaps times as many swaps as edges; degrees are kept and edges stay simple. A copy is a
    task's work."""
    if edges.count() > MOST_EDGES:
        raise ValueError(f"more than {MOST_EDGES} edges")

    def run(key, pdf):
        ids, at = np.unique(np.concatenate([pdf["src"], pdf["dst"]]), return_inverse=True)
        order = np.lexsort((at[len(pdf) :], at[: len(pdf)]))
        a, b = swapped(at[: len(pdf)][order], at[len(pdf) :][order], len(ids), swaps * len(pdf), np.random.default_rng(int(key[0])))
        return pd.DataFrame({"graph": int(key[0]), "src": ids[a], "dst": ids[b]})

    copies = edges.select("src", "dst").join(nodes.sparkSession.range(count).withColumnRenamed("id", "graph"))
    return copies.repartition(4 * count, "graph").groupBy("graph").applyInPandas(run, "graph long, src long, dst long")


def null_modularity(graphs: DataFrame, seed: int = 0) -> DataFrame:
    """graph, q: modularity of the communities that one run finds in each of the graphs (graph, src, dst; some 20). A graph is a task's work,
    and few of them share a task; the graphs are copies of one whose size is checked where they are made."""

    def run(key, pdf):
        ids, at = np.unique(np.concatenate([pdf["src"], pdf["dst"]]), return_inverse=True)
        a, b = at[: len(pdf)], at[len(pdf) :]
        label = louvain(len(ids), a, b, np.ones(len(a)), seed)
        mass = np.bincount(label[np.concatenate([a, b])])
        return pd.DataFrame({"graph": [int(key[0])], "q": [float((label[a] == label[b]).mean() - ((mass / (2 * len(a))) ** 2).sum())]})

    return graphs.repartition(16 * SPREAD, "graph").groupBy("graph").applyInPandas(run, "graph long, q double")


def permutation_test(values: DataFrame, value: str, group: str, trials: int = 10_000, seed: int = 42, width: float = 8.0) -> DataFrame:
    """observed, p: mean of the rows (node and others) of a group (boolean column), and how many random groups of its size have a mean as low;
    no row where the group is empty. In trial t the group is the first by the digests of seed, t and node. The last of them is near the
    group's share of all digests: what lies well below is summed where it is drawn, what lies well above drops out, and only what is near
    (width deviations, some square root of the rows) is ranked. A trial whose last row isn't near makes it all done again with twice the width."""
    rows = written(values.select("node", F.col(value).cast("double").alias("v"), F.col(group).alias("g")), "values")
    total = rows.agg(F.count("*").alias("n"), F.count_if("g").alias("k"), F.avg(F.when(F.col("g"), F.col("v"))).alias("observed")).first()
    n, k = total.n, total.k
    if not k:
        return rows.sparkSession.createDataFrame([], "observed double, p double")
    spread, top = math.sqrt(n * (k / n) * (1 - k / n)), 1 << 60
    drawn = rows.repartition(max(8, min(512, n // 100)), "node").select("node", "v", F.explode(F.sequence(F.lit(0), F.lit(trials - 1))).alias("t")).withColumn("h", F.md5(F.concat_ws("-", F.lit(seed), "t", "node")))
    drawn = drawn.withColumn("u", F.conv(F.substring("h", 1, 15), 16, 10).cast("long"))
    while True:
        low, high = ((k + side * (width * spread + 10)) / n for side in (-1, 1))
        low, high = (min(top, max(0, int(x * top))) for x in (low, high))
        near = F.col("u") >= low
        part = drawn.filter(F.col("u") <= high).groupBy("t", F.when(near, F.col("h")).alias("h"), F.when(near, F.col("node")).alias("node")).agg(F.count("*").alias("c"), F.count("v").alias("cv"), F.sum("v").alias("sv"))
        upto = F.sum("c").over(Window.partitionBy("t").orderBy(F.asc_nulls_first("h"), "node"))  # first, in one row, all that lies below
        part = written(part.withColumn("upto", upto), "near")
        sure = part.groupBy("t").agg(F.sum("c").alias("all"), F.sum(F.when(F.col("h").isNull(), F.col("c"))).alias("below")).filter((F.col("all") >= k) & (F.coalesce("below", F.lit(0)) <= k))
        if sure.count() == trials:
            break
        width *= 2
    taken = F.greatest(F.lit(0), F.least(F.col("c"), k - F.col("upto") + F.col("c"))) / F.col("c")
    means = part.withColumn("taken", taken).groupBy("t").agg((F.sum(F.col("taken") * F.col("sv")) / F.sum(F.col("taken") * F.col("cv"))).alias("m"))
    return means.agg(F.count_if(F.col("m") <= F.lit(total.observed) + 1e-9).alias("low")).select(F.lit(total.observed).cast("double").alias("observed"), (F.col("low") / F.lit(trials)).alias("p"))


def attached(n: int, m: int, rng: np.random.Generator, block: int = 1 << 15) -> np.ndarray:
    """Degrees of n nodes, of which each after the first m is linked to m others, drawn by their degree (the first of them to all m).
    Places among the ends of all edges so far are drawn for a block of nodes at once; a node that draws another twice draws again."""
    ends = [*range(m), *[m] * m] if n > m else []
    for start in range(m + 1, n, block):
        many = 2 * m * (np.arange(start, min(n, start + block)) - m)
        for v, row in enumerate((rng.random((len(many), m)) * many[:, None]).astype(np.int64).tolist(), start):
            chosen = [ends[i] for i in row]
            while len(set(chosen)) < m:
                chosen = list(dict.fromkeys(chosen))
                chosen.append(ends[rng.integers(0, 2 * m * (v - m))])
            ends += chosen
            ends += [v] * m
    return np.bincount(np.array(ends, np.int64), minlength=n)


def pooled_degrees(spark, kind: str, n: int, m: int, realizations: int = 200, seed: int = 42) -> DataFrame:
    """graph, degree of random graphs: gnm has n nodes and m edges, ba attaches each new node to m others by their degree."""

    def run(batches):
        for batch in batches:
            for g in batch["id"]:
                rng, degree = np.random.default_rng([seed, int(g)]), np.zeros(n, np.int64)
                if kind == "gnm":
                    every = n * (n - 1) // 2
                    m_here = min(m, every)
                    few = min(m_here, every - m_here)  # over half of all pairs: those that are no edges are drawn
                    have = np.zeros(0, np.int64)
                    while len(have) < few:  # never more than are missing, so that none has to go
                        a, b = rng.integers(0, n, (2, few - len(have)))
                        have = np.unique(np.concatenate([have, (np.minimum(a, b) * n + np.maximum(a, b))[a != b]]))
                    degree = np.bincount(have // n, minlength=n) + np.bincount(have % n, minlength=n)
                    degree = degree if few == m_here else n - 1 - degree
                else:
                    degree = attached(n, m, rng)
                yield pd.DataFrame({"graph": int(g), "degree": degree})

    return spark.range(realizations).repartition(min(realizations, 64)).mapInPandas(run, "graph long, degree long")
