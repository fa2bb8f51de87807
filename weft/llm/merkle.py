"""Merkle manifest of a dataset: one root for all rows, a proof for each row, and the root that a row as it is now folds to.

Leaves are ranked within their source by a sort over ranges, and fall in blocks of FAN ** LEVELS consecutive ones, so a hot source is
as many groups as it needs and no group is larger than a block. A first pass reduces blocks to their roots. If these are MOST_TOP at
most, the driver builds the tree above them and broadcasts it: a block's suffix path is looked up there, and a second pass over the
blocks finishes the proofs and folds each row. If they are more, the roots are reduced by blocks again (and the subroots of the sources,
once each source has one) until few enough are left; suffix paths then come down by a cogroup of each level's blocks.

Defined results: rows with one doc_id follow each other by their leaves; null ids come first, and null sources before all others; a
null field is "-" in a leaf; a null id is never tampered with; an empty table has no root and gives no rows; other columns take no part.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.components import salted
from ..operators.graph import ranked
from ..storage import written

FAN = 16
#: levels of a block: it has FAN ** LEVELS leaves
LEVELS = 3
#: block roots that the driver may hold (a hundred bytes each) and broadcast
MOST_TOP = 1 << 18
FIELDS = ["doc_id", "source", "lang", "n_chars", "text"]


def field(c: Column) -> Column:
    """- for null, else the length in bytes, a colon and the value."""
    s = c.cast("string")
    return F.coalesce(F.concat(F.octet_length(s).cast("string"), F.lit(":"), s), F.lit("-"))


def leaf(columns: dict[str, Column]) -> Column:
    return F.unhex(F.sha2(F.concat(*(field(columns[c]) for c in FIELDS)), 256))


def digest(parts) -> str:
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def above(nodes: list[str]) -> list[str]:
    """The level above: every FAN consecutive nodes become their digest."""
    return [digest(nodes[k : k + FAN]) for k in range(0, len(nodes), FAN)]


def height(n: int) -> int:
    """Levels between n nodes and the one that remains."""
    levels = 0
    while n > 1:
        n, levels = -(-n // FAN), levels + 1
    return levels


def ladder(nodes: list[str], n: int, levels: int) -> list[list[str]]:
    """The levels of one block, from its nodes up to its root; n is the number of nodes of the whole tree."""
    out = [nodes]
    for _ in range(min(levels, height(n))):
        out.append(above(out[-1]))
    return out


def siblings(level: list[str], at: int) -> tuple[str, str]:
    """What stands left and right of a node among the FAN that become one digest."""
    first = at - at % FAN
    return "".join(level[first:at]), "".join(level[at + 1 : first + FAN])


def path_in(block: list[list[str]], at: int) -> list[tuple[str, str]]:
    """Siblings level by level from a place of the block to below its root."""
    return [siblings(level, at // FAN**k) for k, level in enumerate(block[:-1])]


def fold(node: str, path: list[tuple[str, str]]) -> str:
    for left, right in path:
        node = digest((left, node, right))
    return node


class Upper:
    """The tree above block roots (tree, pos, digest): a tree's nodes up to its subroot, and the subroots, in the order of their trees, up
    to the root."""

    def __init__(self, tree: np.ndarray, pos: np.ndarray, nodes: list[str]):
        order = np.lexsort((pos, tree))
        nodes = [nodes[k] for k in order.tolist()]
        ids, first = np.unique(tree[order], return_index=True)
        ends = np.append(first[1:], len(nodes)).tolist()
        self.at = {t: k for k, t in enumerate(ids.tolist())}
        self.trees = [ladder(own := nodes[a:z], len(own), len(own)) for a, z in zip(first.tolist(), ends)]
        self.top = ladder([t[-1][0] for t in self.trees], len(self.trees), len(self.trees))
        self.root = self.top[-1][0] if self.trees else None

    def path(self, tree: int, pos: int) -> list[tuple[str, str]]:
        k = self.at[tree]
        return path_in(self.trees[k], pos) + path_in(self.top, k)


NODE = "tree long, pos long, n long, digest binary"
PATH = "tree long, pos long, path array<struct<left:string,right:string>>"


def blocked(nodes: DataFrame, levels: int) -> DataFrame:
    return nodes.withColumn("block", F.expr(f"pos div {FAN**levels}L"))


def hexes(column) -> list[str]:
    return [d.hex() for d in column.to_pylist()]


def reduced(nodes: DataFrame, levels: int) -> DataFrame:
    """The roots of the blocks of nodes, as nodes of the trees above."""

    def run(table: pa.Table) -> pa.Table:
        table = table.sort_by("pos")
        tree, block, n = (table.column(c)[0].as_py() for c in ("tree", "block", "n"))
        root = ladder(hexes(table.column("digest")), n, levels)[-1]
        return pa.table({"tree": [tree], "pos": [block], "n": [-(-n // FAN**levels)], "digest": [bytes.fromhex(root[0])]})

    return blocked(nodes, levels).select("tree", "block", "pos", "n", "digest").groupBy("tree", "block").applyInArrow(run, NODE)


def with_paths(nodes: DataFrame, upper, levels: int, finish, schema: str) -> DataFrame:
    """finish(table, block as a ladder, suffix path of the block) for each block of nodes. upper: the broadcast tree above, or the paths of
    the nodes above as a table."""
    nodes = blocked(nodes, levels)

    def run(table: pa.Table, suffix) -> pa.Table:
        table = table.sort_by("pos")
        tree, block, n = (table.column(c)[0].as_py() for c in ("tree", "block", "n"))
        return finish(table, ladder(hexes(table.column("digest")), n, levels), suffix(tree, block))

    if not isinstance(upper, DataFrame):
        return nodes.groupBy("tree", "block").applyInArrow(lambda own: run(own, upper.value.path), schema)

    def both(own: pa.Table, above: pa.Table) -> pa.Table:
        return run(own, lambda *_: [(p["left"], p["right"]) for p in above.column("path")[0].as_py()])

    return nodes.groupBy("tree", "block").cogroup(upper.withColumnRenamed("pos", "block").groupBy("tree", "block")).applyInArrow(both, schema)


def suffixes(nodes: DataFrame, upper, levels: int) -> DataFrame:
    """tree, pos, path of nodes."""

    def finish(table, block, suffix):
        pos = table.column("pos").to_pylist()
        first = pos[0]
        paths = [[{"left": a, "right": b} for a, b in path_in(block, p - first) + suffix] for p in pos]
        kind = pa.list_(pa.struct([("left", pa.string()), ("right", pa.string())]))
        return pa.table([table.column("tree"), table.column("pos"), pa.array(paths, kind)], names=["tree", "pos", "path"])

    return with_paths(nodes, upper, levels, finish, PATH)


def leaves(docs: DataFrame) -> DataFrame:
    """key, doc_id, digest, now: each row's leaf, and the leaf of the row as it is now where that differs (A-Z of the text lower-cased where
    5 divides the id's crc32). key orders sources as they are ordered, null first."""
    columns = {c: F.col(c) for c in FIELDS}
    lower = F.translate("text", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    tampered = F.crc32(F.col("doc_id").cast("string")) % 5 == 0
    rows = docs.select(F.coalesce(F.concat(F.lit("+"), F.col("source")), F.lit("")).alias("key"), "doc_id", leaf(columns).alias("digest"), F.when(tampered, leaf(columns | {"text": lower})).alias("now"))
    return rows.withColumn("now", F.expr("if(now = digest, null, now)"))


def placed(rows: DataFrame) -> DataFrame:
    """tree, pos, n, and the other columns of leaves: the source's number, the place in it, and its size."""
    # the task that read it parts rows that are alike in all else
    rows = ranked(rows.withColumn("from", F.spark_partition_id()), [F.col(c) for c in ("key", "doc_id", "digest", "now", "from")], "rank")
    rows = written(rows, "leaves")
    trees = ranked(rows.groupBy("key").agg(F.min("rank").alias("first"), F.count("*").alias("n")), [F.col("key")], "tree")
    return salted(rows, trees, "key", "rank").selectExpr("cast(tree as long) tree", "cast(rank - first as long) pos", "n", "digest", "now", "doc_id")


ROWS = "doc_id long, leaf string, subroot string, root string, proof_sha256 string, folded_root string, verified boolean"


def manifest(docs: DataFrame, levels: int = LEVELS, most_top: int = MOST_TOP) -> DataFrame:
    """doc_id, leaf, subroot, root, proof_sha256, folded_root, verified of docs (doc_id, source, lang, n_chars, text)."""
    rows = written(placed(leaves(docs)), "placed")
    between, roots = [], written(reduced(rows, levels), "roots")
    while (size := roots.agg(F.count("*").alias("many"), F.max("n").alias("largest")).first()).many > most_top:
        subroots = size.largest == 1  # each source has one root: these make one tree
        if subroots:
            roots = written(roots.selectExpr("0L tree", "tree - 1 pos", f"{size.many}L n", "digest"), "subroots")
        between.append((roots, subroots))
        roots = written(reduced(roots, levels), "roots")
    top = roots.select("tree", "pos", "digest").toPandas()  # most_top rows at most
    upper = Upper(top["tree"].to_numpy(np.int64), top["pos"].to_numpy(np.int64), [bytes(d).hex() for d in top["digest"]])
    root, up = upper.root, docs.sparkSession.sparkContext.broadcast(upper)
    for nodes, subroots in reversed(between):
        paths = written(suffixes(nodes, up, levels), "paths")
        up = paths.selectExpr("pos + 1 tree", "0L pos", "path") if subroots else paths

    def finish(table, block, suffix):
        pos, n = table.column("pos").to_numpy(), table.column("n")[0].as_py()
        leaf, now = block[0], [None if d is None else d.hex() for d in table.column("now").to_pylist()]
        proof, folded, subroot, first = [], [], None, int(pos[0])
        for p, was, new in zip((pos - first).tolist(), leaf, now):
            path = path_in(block, p) + suffix
            if subroot is None:
                subroot = fold(was, path[: height(n)])
            proof.append(digest(a + b for a, b in path))
            folded.append(fold(new or was, path))
        many = len(leaf)
        return pa.table(
            [table.column("doc_id"), pa.array(leaf), pa.array([subroot] * many), pa.array([root] * many), pa.array(proof), pa.array(folded), pa.array([f == root for f in folded])],
            names=["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"],
        )

    return with_paths(rows, up, levels, finish, ROWS)
