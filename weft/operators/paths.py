"""Shortest paths and betweenness. Frontier joins go for a block of sources at once: a block's state is at most its sources times the
nodes they reach; what a block leaves (distances, or one sum for each node) is a table of its own, so a lost block is made again alone.
That is for components of very many edges. As long as these are few enough for a task, sources are dealt out, each task with the edges of
its component in packs."""

from __future__ import annotations

import functools

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..storage import written
from .components import SMALL, components, salted
from .graph import ranked
from .packs import batch, batches, dealt, packed

#: sources of a block
BLOCK = 1 << 12
#: edges of a component whose paths are worked out from its edges in a task, at most; and of components that share a task
MOST_EDGES, BAG = 4_000_000, 1 << 12
#: edges times sources of a task; parts of a component at most
WORK, PARTS = 1 << 25, 512
#: rows of distances of a task, about; rows that it holds before it hands them on
ROWS, HELD = 1 << 24, 1 << 18
#: nodes and edges, times sources, that a task holds at once
STATE = 1 << 22


def _both(edges: DataFrame) -> DataFrame:
    return edges.select(F.col("src").alias("node"), F.col("dst").alias("next")).union(edges.select("dst", "src"))


def _blocks(sources: DataFrame, block: int) -> list[DataFrame]:
    """sources (node) in blocks of so many."""
    many = sources.count()
    if many <= block:
        return [sources.select("node")]
    rows = written(ranked(sources.select("node"), [F.col("node")]).selectExpr("node", f"cast((rank - 1) div {block} as int) part"), "sources")
    return [rows.filter(F.col("part") == k).select("node") for k in range(-(-many // block))]


def distances(edges: DataFrame, sources: DataFrame, block: int = BLOCK, most: int = MOST_EDGES) -> DataFrame:
    """source, node, dist over simple undirected edges (src, dst), for every source of sources (node); reachable nodes only. A component's
    edges go to as many tasks as its sources times its nodes ask for, each with some of the sources. If a component has over most edges, all
    goes by frontier joins; that bound chooses the way and not the result."""
    edges = written(edges.select("src", "dst"), "edges")
    found, tagged, sizes, whole = _components(edges)
    if (whole.most or 0) > most:
        return _walked(edges, sources, block)
    sources = written(sources.select("node").distinct(), "sources")
    flags = found.join(sources.withColumn("s", F.lit(1.0)), "node", "left").select("node", "component", F.coalesce("s", F.lit(0.0)).alias("s"))
    flags = written(flags, "flags")
    wanted = flags.groupBy("component").agg(F.count("*").alias("n"), F.sum("s").alias("s")).filter("s > 0")
    bags = max(1, (whole.m or 0) // BAG)
    sizes = written(sizes.join(wanted, "component").selectExpr("component", *_bagged(bags), f"if(m > {BAG}, cast(least(s, {PARTS}, ceil(n * s / {ROWS})) as int), 1) parts"), "parts")
    tasks = sizes.groupBy("alone", "bag").agg(F.max("parts").alias("n")).agg(F.sum("n").alias("n")).first().n or 1
    rows = salted(tagged, sizes, "component", "src").join(flags.selectExpr("node src", "s w"), "src").join(flags.selectExpr("node dst", "s v"), "dst")
    reached = dealt(packed(rows.select("alone", "bag", "parts", "src", "dst", "w", "v")), _levels, "source long, node long, dist long", min(4096, tasks))
    alone = sources.join(found, "node", "left_anti")
    return reached.unionByName(alone.select(F.col("node").alias("source"), "node", F.lit(0).cast("long").alias("dist")))


def _components(edges: DataFrame):
    """Components of the nodes, edges with theirs, how many edges (m) each has, and all and the most of one."""
    found = written(components(edges.selectExpr("src a", "dst b"), SMALL), "components")
    tagged = edges.join(found.withColumnRenamed("node", "src"), "src")
    sizes = written(tagged.groupBy("component").agg(F.count("*").alias("m")), "sizes")
    return found, tagged, sizes, sizes.agg(F.sum("m").alias("m"), F.max("m").alias("most")).first()


def _bagged(bags: int) -> list[str]:
    return [f"m > {BAG} alone", f"if(m > {BAG}, component, pmod(xxhash64(component), {bags})) bag"]


def _levels(key, parts, ids, first, b, w):
    """source, node, dist from this part's sources (w of a source's edges is 1). 64 sources are the bits of a number for each node; a level
    hands them on over all edges, or over those of the nodes that were just reached, if these are few."""
    n, held, many_held = len(ids), [], 0
    names = ["source", "node", "dist"]
    sources = np.flatnonzero(w[first[:-1]] > 0)[key[2] :: parts]
    for i in range(0, len(sources), 64):
        some = sources[i : i + 64]
        bits, seen, new = np.uint64(1) << np.arange(len(some), dtype=np.uint64), np.zeros(n, np.uint64), np.zeros(n, np.uint64)
        seen[some] = bits
        at, dist = np.sort(some), 0
        fresh = seen[at]
        while len(at):
            on = np.unpackbits(fresh.view(np.uint8).reshape(len(at), 8), axis=1, bitorder="little")
            row, bit = np.nonzero(on)
            held.append([ids[some[bit]], ids[at[row]], np.full(len(row), dist)])
            many_held += len(row)
            if many_held > HELD:
                yield from batches(names, [np.concatenate(x) for x in zip(*held)], HELD)
                held, many_held = [], 0
            many = first[at + 1] - first[at]
            if 8 * many.sum() < len(b):
                ends = np.cumsum(many)
                to = b[np.arange(many.sum()) + np.repeat(first[at] - ends + many, many)]
                np.bitwise_or.at(new, to, np.repeat(fresh, many))
                at = np.unique(to)
                fresh = new[at] & ~seen[at]
                new[at] = 0
                at, fresh = at[fresh > 0], fresh[fresh > 0]
            else:
                new[at] = fresh
                got = np.bitwise_or.reduceat(new[b], first[:-1]) & ~seen  # every node has an edge
                new[at] = 0
                at = np.flatnonzero(got)
                fresh = got[at]
            seen[at] |= fresh
            dist += 1
    if held:
        yield from batches(names, [np.concatenate(x) for x in zip(*held)], HELD)


def _walked(edges: DataFrame, sources: DataFrame, block: int) -> DataFrame:
    """distances by frontier joins."""
    step, out = written(_both(edges), "steps"), None
    for some in _blocks(sources, block):
        seen = frontier = written(some.select(F.col("node").alias("source"), "node", F.lit(0).cast("long").alias("dist")), "frontier")
        while frontier.limit(1).count():
            new = frontier.join(step, "node").select("source", F.col("next").alias("node"), (F.col("dist") + 1).alias("dist")).distinct()
            frontier = written(new.join(seen, ["source", "node"], "left_anti"), "frontier")
            seen = seen.union(frontier)
        out = seen if out is None else out.union(seen)
    return out


def betweenness(edges: DataFrame, nodes: DataFrame, block: int = BLOCK, most: int = MOST_EDGES, work: int = WORK) -> DataFrame:
    """node, betweenness: normalised, unweighted, exact. Paths stay in a component, whose edges go to as many tasks as its edges times its
    nodes ask for, each with some of the sources; small components share a task. If a component has over most edges, all goes by frontier
    joins; that bound chooses the way and not the result."""
    edges = written(edges.select("src", "dst"), "edges")
    found, tagged, sizes, whole = _components(edges)
    if (whole.most or 0) > most:
        step = written(_both(edges), "steps")
        sums = functools.reduce(DataFrame.union, [written(_dependencies(step, some), "sums") for some in _blocks(nodes, block)])
    else:
        bags = max(1, (whole.m or 0) // BAG)
        sizes = sizes.join(found.groupBy("component").agg(F.count("*").alias("n")), "component")
        sizes = written(sizes.selectExpr("component", *_bagged(bags), f"if(m > {BAG}, cast(least(n, {PARTS}, ceil(m * n * 1D / {work})) as int), 1) parts"), "parts")
        tasks = min(4096, sizes.groupBy("alone", "bag").agg(F.max("parts").alias("n")).agg(F.sum("n").alias("n")).first().n or 1)
        rows = salted(tagged, sizes, "component", "src").selectExpr("alone", "bag", "parts", "src", "dst", "1D w")
        sums = dealt(packed(rows), _passed, "node long, s double", tasks)
    sums = sums.groupBy("node").agg(F.sum("s").alias("s"))
    n = nodes.agg(F.count("*").alias("n"))
    return nodes.join(sums, "node", "left").join(n).select("node", F.expr("if(n > 2, coalesce(s, 0d) / ((n - 1) * (n - 2)), 0d)").alias("betweenness"))


def _passed(key, parts, ids, first, b, w):
    """node, s: how much of the shortest paths from this part's sources pass each node of some components."""
    sources, few = np.arange(key[2], len(ids), parts), max(1, STATE // (len(ids) + len(b) // 2))
    total = np.zeros(len(ids))
    for i in range(0, len(sources), few):
        total += passed(len(ids), first, b, sources[i : i + few])
    yield batch(["node", "s"], ids, total)


def passed(n: int, first: np.ndarray, b: np.ndarray, sources: np.ndarray) -> np.ndarray:
    """How much of the shortest paths from the sources pass each of n nodes; node v's neighbours are b[first[v]:first[v + 1]]. A place is a
    source's index times n plus a node. Path counts go outwards by levels, dependencies back over the same steps."""
    start = np.arange(len(sources)) * n + sources
    seen, paths, nth = np.zeros(len(sources) * n, bool), np.zeros(len(sources) * n), np.zeros(len(sources) * n, np.int32)
    seen[start], paths[start] = True, 1.0
    frontier, steps = start, []
    while len(frontier):
        node = frontier % n
        many = first[node + 1] - first[node]
        ends = np.cumsum(many)
        to = np.repeat(frontier - node, many) + b[np.arange(many.sum()) + np.repeat(first[node] - ends + many, many)]
        new = ~seen[to]
        to, here = to[new], np.repeat(frontier, many)[new]
        np.add.at(paths, to, paths[here])
        seen[to] = True
        nth[to] = np.arange(len(to), dtype=np.int32)
        frontier = to[nth[to] == np.arange(len(to))]  # each place once
        if len(to):
            steps.append((here.astype(np.int32), to.astype(np.int32)))
    share = np.zeros(len(seen))
    for here, to in reversed(steps):
        np.add.at(share, here, paths[here] / paths[to] * (1 + share[to]))
    share[start] = 0
    return share.reshape(len(sources), n).sum(axis=0)


def _dependencies(step: DataFrame, sources: DataFrame) -> DataFrame:
    """node, s: how much of the shortest paths from the sources pass each node. Path counts go outwards by levels, dependencies back."""
    start = sources.select(F.col("node").alias("source"), "node", F.lit(1.0).alias("paths"))
    levels = [written(start, "level")]
    seen = levels[0].select("source", "node")
    while True:
        found = levels[-1].join(step, "node").groupBy("source", F.col("next").alias("node")).agg(F.sum("paths").alias("paths"))
        found = written(found.join(seen, ["source", "node"], "left_anti"), "level")
        if not found.limit(1).count():
            break
        levels.append(found)
        seen = seen.union(found.select("source", "node"))
    later, total = None, None
    for level in reversed(levels):
        if later is None:
            here = level.withColumn("share", F.lit(0.0))
        else:
            back = later.select("source", F.col("node").alias("next"), ((1 + F.col("share")) / F.col("paths")).alias("part"))
            gained = level.join(step, "node").join(back, ["source", "next"]).groupBy("source", "node").agg(F.sum("part").alias("sum"))
            here = level.join(gained, ["source", "node"], "left").withColumn("share", F.coalesce(F.col("paths") * F.col("sum"), F.lit(0.0))).drop("sum")
        later = written(here, "dependencies")
        total = later if total is None else total.unionByName(later)
    return total.filter("source <> node").groupBy("node").agg(F.sum("share").alias("s"))
