"""N-gram Jaccard join: documents whose sets of word shingles are alike, and the groups that such links make.

Two sets that reach the threshold differ in few elements for their size. Sizes fall in bands such that a pair lies in one band
or two adjacent ones; a tile is a band together with the one below. In a tile the range of the shingles' hashes is cut into more
parts than a pair may differ in, so a pair has a part in common, whole; documents without a part that any other document has
drop out by asking for the parts' hashes (weft.llm.exchange). What remains is grouped into families that parts connect, and into
smaller ones by sketches (how many shingles fall in each class of hashes). Each family's tiles compare hashed bitmaps first: the bits that one bitmap has and the other lacks bound the overlap from above. The
sorted arrays are intersected where that bound still reaches the threshold. Pairs that are already linked through others are
passed over, since only the groups are asked for; large tiles are dealt out as pairs of blocks.

Equal sets are one node throughout. Defined results: a null or empty text, or one without words, has no shingle and is linked
with nothing; a text shorter than a shingle is one shingle; a null doc_id comes after all others and is no group's name but its
own (null).
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.components import components, salted
from . import exchange as ex
from .common import give_back, handed_back, lower_ascii, mix64, padded, partitions, runs, slice_hash, written

#: documents of a block of a tile
BLOCK = 1024
#: the same while only sketches are compared
SKETCHED = 4096
#: bytes of text for each bucket that connects rows by their common parts
CONNECTED = 1 << 26
#: bits of a part's hash that are sent to find out whether any other set has it
FRAGMENT = 36
#: bits of a row's place in its pack
PLACE = 19
LOW48 = np.uint64((1 << 48) - 1)


def shingles(data: np.ndarray, offs: np.ndarray, words: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct 48-bit hashes of the shingles of each text, sorted; and their offsets by text."""
    low, n = lower_ascii(data), len(offs) - 1
    mask = np.zeros(len(low) + n, bool)
    mask[np.arange(len(low)) + np.repeat(np.arange(n), np.diff(offs))] = ~np.isin(low, [32, 9, 10, 11, 12, 13])
    start, end = runs(mask)
    text = np.searchsorted(offs[1:] + np.arange(1, n + 1), start, side="right")
    h = slice_hash(padded(low), start - text, end - text)
    many = np.bincount(text, minlength=n)
    last = np.repeat(np.cumsum(many), many)  # end of the own text's words
    size = np.minimum(words, np.repeat(many, many))
    key, place = size.astype(np.uint64), np.arange(len(h))
    for k in range(words):
        nxt = np.zeros(len(h), np.uint64)
        nxt[: len(h) - k] = h[k:] if k < len(h) else h[:0]
        key = np.where(k < size, mix64(key * np.uint64(0x9FB21C651E98DF25) ^ nxt), key)
    ok = place + size <= last
    key, owner = key[ok] & LOW48, text[ok].astype(np.uint64)
    order = np.lexsort((key, owner)) if len(key) else np.zeros(0, np.int64)
    key, owner = key[order], owner[order]
    keep = np.ones(len(key), bool)
    keep[1:] = (key[1:] != key[:-1]) | (owner[1:] != owner[:-1])
    return key[keep], np.searchsorted(owner[keep], np.arange(n + 1).astype(np.uint64))


def bands(limit: int, percent: int) -> np.ndarray:
    """Smallest sizes of the bands up to one beyond limit."""
    out = [1]
    while out[-1] <= limit:
        out.append(max(out[-1] + 1, -(-out[-1] * 100 // percent)))
    return np.array([*out, max(out[-1] + 1, -(-out[-1] * 100 // percent))], np.int64)


def parts_of(keys: np.ndarray, offs: np.ndarray, percent: int) -> tuple[np.ndarray, np.ndarray]:
    """Hash of each part of each set, in both of its tiles, and the set's index."""
    size = np.diff(offs)
    edge = bands(int(size.max(initial=1)), percent)
    band = np.searchsorted(edge, size, side="right") - 1
    strong, out, owner = mix64(keys + np.uint64(1)), [], []
    for up in (0, 1):
        tile = band + up
        largest = edge[np.minimum(tile + 1, len(edge) - 1)] - 1
        differ = 2 * largest * (100 - percent) // (100 + percent)
        # from the tile's own sizes, so that all of its sets agree
        spare = np.ceil(4 * (differ + 1) * np.exp(-edge[np.maximum(tile - 1, 0)] / (differ + 1.0))).astype(np.int64) + 1
        many = np.where((size > 0) & (differ > 0), differ + 1 + spare, 0)
        first = np.cumsum(many) - many
        total = int(many.sum())
        live = np.repeat(many > 0, size)
        mine = np.repeat(np.arange(len(size)), size)[live]
        at = first[mine] + ((keys[live] >> np.uint64(16)) * many[mine].astype(np.uint64) >> np.uint64(32)).astype(np.int64)
        sums = np.zeros(total, np.uint64)
        filled = np.zeros(total, bool)
        if len(at):
            begin = np.flatnonzero(np.concatenate([[True], at[1:] != at[:-1]]))
            sums[at[begin]] = np.add.reduceat(strong[live], begin)
            filled[at[begin]] = True
        which = np.repeat(np.arange(len(size)), many)
        part = np.arange(total) - first[which]
        # at most spare parts that two sets share are empty unless both have more empty ones
        empty = np.bincount(which[~filled], minlength=len(size))
        emit = filled | (empty > spare)[which]
        value = mix64(sums ^ mix64((part.astype(np.uint64) << np.uint64(24)) + tile[which].astype(np.uint64) + np.uint64(7)))
        out.append(value[emit])
        owner.append(which[emit])
    return np.concatenate(out), np.concatenate(owner)


def row_key(pack: int, place: np.ndarray) -> np.ndarray:
    """One number for a row of a pack: the pack's has 44 bits, and 19 are left for the place."""
    if pack >> 44 or len(place) and int(place.max()) >> PLACE:
        raise ValueError(f"pack {pack} with {len(place)} rows")
    return np.int64(pack << PLACE) | place.astype(np.int64)


class Sets:
    """What a pack derives from its texts: sets of shingles, two hashes of each set (node is the one that is dealt by), and hashes of
    their parts."""

    def __init__(self, data: np.ndarray, offs: np.ndarray, words: int):
        self.keys, self.offs = shingles(data, offs, words)
        self.size = np.diff(self.offs)
        self.node, self.check = np.zeros(len(self.size), np.uint64), np.zeros(len(self.size), np.uint64)
        full = self.size > 0
        if full.any():
            one = mix64(self.keys + np.uint64(0x51ED270B))
            sums = np.add.reduceat(one, self.offs[:-1][full])
            self.node[full] = mix64(sums * np.uint64(3) + mix64(self.size[full].astype(np.uint64)))
            self.check[full] = np.add.reduceat((one ^ (one >> np.uint64(31))) * np.uint64(0x9FB21C651E98DF25), self.offs[:-1][full])

    def sketches(self, own: np.ndarray) -> list[bytes]:
        """Of each set: how many shingles fall in each class of hashes, 255 at most; about one class for eight shingles. Two sets differ
        in as many elements as their sketches do, or more."""
        out = []
        for i in own.tolist():
            keys = self.keys[self.offs[i] : self.offs[i + 1]]
            many = 1 << max(6, (len(keys) // 8).bit_length())
            out.append(np.minimum(np.bincount((keys & np.uint64(many - 1)).astype(np.int64), minlength=many), 255).astype(np.uint8).tobytes())
        return out


def neighbours(packs: DataFrame, size: int, words: int, percent: int) -> DataFrame:
    """a, b, kind, sketch of rows (row_key). Kind 1: b has a part of a's, or others between them do. Kind 2: b has an equal set and is the
    smallest such. Kind 3: b is a's number of shingles, and sketch its sketch; of every row with a common part. size: bytes of text."""
    buckets = partitions(packs.sparkSession)
    # a bucket names a row's neighbour again, so there are as many as the text needs and no more
    few = max(1, size // CONNECTED)

    def asked_of(pack):
        sets = Sets(pack.data, pack.offs, words)
        part, owner = parts_of(sets.keys, sets.offs, percent)
        return sets, part, owner, *np.unique(np.concatenate([part, sets.node[sets.size > 0]]), return_inverse=True, return_counts=True)

    def question(pack):
        asked = asked_of(pack)[3]
        for b, at in ex.deal(asked, buckets):
            if len(at):
                yield b, 0, ex.squeeze_sorted(asked[at] >> np.uint64(64 - FRAGMENT))

    def reply(kind, payloads):
        """Is it there more than once? Fragments say so for a few that are not; these find no partner later."""
        values = [ex.expand_sorted(p) for p in payloads]
        every = np.concatenate(values)
        order, first = ex.groups(every)
        size = np.diff(np.append(first, len(every)))
        many = np.empty(len(every), bool)
        many[order] = np.repeat(size > 1, size)
        ends = np.cumsum([len(v) for v in values])
        return [np.packbits(many[e - len(v) : e]).tobytes() for e, v in zip(ends, values)]

    def question_again(pack, got):
        sets, part, owner, asked, inverse, count = asked_of(pack)
        shared = count > 1
        for b, at in ex.deal(asked, buckets):
            if len(at):
                shared[at] |= np.unpackbits(np.frombuffer(got[0, b], np.uint8), count=len(at)).astype(bool)
        shared = shared[inverse]
        full = np.flatnonzero(sets.size > 0)
        known = np.zeros(len(sets.size), bool)
        for kind, h, own in ((1, part[shared[: len(part)]], owner[shared[: len(part)]]), (2, sets.node[full][shared[len(part) :]], full[shared[len(part) :]])):
            known[own] = True
            order = np.argsort(h)
            h, own = h[order], own[order]
            for b, at in ex.deal(h, few):
                if len(at):
                    yield b, kind, ex.join_parts(ex.squeeze_sorted(h[at] // np.uint64(few)), ex.squeeze(own[at]), *([ex.squeeze(sets.check[own[at]])] if kind == 2 else []))
        own = np.flatnonzero(known)
        yield (int(pack.ids[0] % few) if len(pack.ids) else 0), 3, ex.join_parts(ex.squeeze(own), ex.squeeze(sets.size[own]), ex.join_parts(*sets.sketches(own)))

    def edges(table: pa.Table) -> pa.Table:
        rows, sizes = {1: [], 2: []}, []
        for pack, kind, payload in zip(*(table.column(c).to_pylist() for c in ("pack", "kind", "payload"))):
            x, y, *sketch = ex.split_parts(payload)
            if kind == 3:
                sizes.append((row_key(pack, ex.expand(x)), ex.expand(y).astype(np.int64), ex.split_parts(sketch[0])))
            else:
                rows[kind].append((ex.expand_sorted(x), row_key(pack, ex.expand(y)), *map(ex.expand, sketch)))
        out = []
        for kind in (1, 2):
            if rows[kind]:
                h, row, *check = (np.concatenate(c) for c in zip(*rows.pop(kind)))
                found = []
                for some in range(8):  # an eighth of the hashes at a time, for memory
                    mine = (h & np.uint64(7)) == np.uint64(some)
                    x, y = h[mine], row[mine]
                    order, first = ex.groups(x) if kind == 1 else same(x, check[0][mine])
                    y = y[order]
                    low = np.repeat(np.minimum.reduceat(y, first), np.diff(np.append(first, len(x)))) if len(x) else y
                    found.append((y[y != low], low[y != low]))
                    if kind == 1:
                        found[-1] = forest(*found[-1])
                a, b = (np.concatenate(c) for c in zip(*found))
                if kind == 1:
                    a, b = forest(a, b)
                out.append(pa.table([pa.array(a, pa.int64()), pa.array(b, pa.int64()), pa.array([kind] * len(a), pa.int32()), pa.nulls(len(a), pa.binary())], names=["a", "b", "kind", "sketch"]))
        for a, b, sketch in sizes:
            out.append(pa.table([pa.array(a, pa.int64()), pa.array(b, pa.int64()), pa.array([3] * len(a), pa.int32()), pa.array(sketch, pa.binary())], names=["a", "b", "kind", "sketch"]))
        del rows
        give_back()
        return pa.concat_tables(out)

    first = ex.answer(ex.ask(packs, question), reply)
    return ex.ask_again(packs, first, question_again).groupBy("bucket").applyInArrow(edges, "a long, b long, kind int, sketch binary")


def same(x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """As exchange.groups, of pairs of numbers."""
    order = np.lexsort((y, x))
    x, y = x[order], y[order]
    return order, np.flatnonzero(np.concatenate([[True], (x[1:] != x[:-1]) | (y[1:] != y[:-1])])[: len(x)])


def forest(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each node of the edges with the smallest that it is connected to, where that is another."""
    node, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    x, y = at[: len(a)], at[len(a) :]
    label = np.arange(len(node))
    while True:
        low = np.minimum(label[x], label[y])
        new = label.copy()
        np.minimum.at(new, x, low)
        np.minimum.at(new, y, low)
        np.minimum.at(new, label[x], low)
        np.minimum.at(new, label[y], low)
        new = new[new]
        if (new == label).all():
            break
        label = new
    moved = label != np.arange(len(node))
    return node[moved], node[label[moved]]


class Groups:
    """Union-find over the places of a tile."""

    def __init__(self, n: int):
        self.label = np.arange(n)

    def join(self, a: int, b: int) -> None:
        x, y = self.label[a], self.label[b]
        if x != y:
            self.label[self.label == max(x, y)] = min(x, y)


def tile_links(sets: list[np.ndarray], side: np.ndarray, percent: int) -> list[tuple[int, int]]:
    """Links that connect what a tile connects. side: 0 for the first of two blocks, 1 for the second, 2 where there is one block;
    only pairs across are compared in the first case."""
    size = np.array([len(s) for s in sets], np.int64)
    order = np.argsort(size, kind="stable")
    width = 1 << max(9, int(8 * size.max() - 1).bit_length())
    bits = np.zeros((len(sets), width // 8), np.uint8)
    for row, s in zip(bits, sets):
        at = (s * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(64 - width.bit_length() + 1)).astype(np.int64)
        np.bitwise_or.at(row, at >> 3, (1 << (at & 7)).astype(np.uint8))
    bits = bits.view(np.uint64)[order]
    size, side = size[order], side[order]
    groups, out = Groups(len(sets)), []
    for i in range(len(order)):
        # smaller sets of at least percent of this one's size
        first = np.searchsorted(size, -(-percent * size[i] // 100))
        js = np.arange(first, i)
        js = js[(groups.label[js] != groups.label[i]) & ((side[js] != side[i]) | (side[i] == 2))]
        while len(js):
            need = -(-percent * (size[i] + size[js]) // (100 + percent))  # overlap that the threshold asks for
            part = js[:256]
            extra = np.bitwise_count(bits[part] & ~bits[i]).sum(axis=1, dtype=np.int64)
            lack = np.bitwise_count(bits[i] & ~bits[part]).sum(axis=1, dtype=np.int64)
            may = part[np.minimum(size[part] - extra, size[i] - lack) >= need[: len(part)]]
            a = sets[order[i]]
            for j in may.tolist():
                if groups.label[j] == groups.label[i]:
                    continue
                b = sets[order[j]]
                both = len(np.intersect1d(a, b, assume_unique=True))
                if 100 * both >= percent * (len(a) + len(b) - both):
                    groups.join(i, j)
                    out.append((int(order[i]), int(order[j])))
            js = js[256:]
            js = js[groups.label[js] != groups.label[i]]
    return out


def folded(sketches: list[bytes]) -> np.ndarray:
    """Sketches by the smallest number of classes among them; classes are powers of 2, so they fold."""
    many = min(map(len, sketches))
    return np.stack([np.frombuffer(s, np.uint8).reshape(-1, many).sum(axis=0, dtype=np.int32) for s in sketches])


def near_sketches(size: np.ndarray, sketch: np.ndarray, side: np.ndarray, percent: int) -> list[tuple[int, int]]:
    """Pairs that connect all sets which their sizes and sketches allow to be linked; side as in tile_links."""
    order = np.argsort(size, kind="stable")
    size, sketch, side = size[order], sketch[order], side[order]
    groups, out = Groups(len(size)), []
    for i in range(len(size)):
        js = np.arange(np.searchsorted(size, -(-percent * size[i] // 100)), i)
        js = js[(groups.label[js] != groups.label[i]) & ((side[js] != side[i]) | (side[i] == 2))]
        for part in np.split(js, range(512, len(js), 512)):
            differ = np.abs(sketch[part] - sketch[i]).sum(axis=1, dtype=np.int64)
            for j in part[differ * (100 + percent) <= (size[part] + size[i]) * (100 - percent)].tolist():
                if groups.label[j] != groups.label[i]:
                    groups.join(i, j)
                    out.append((int(order[i]), int(order[j])))
    return out


def dealt_out(heads: DataFrame, block: int) -> DataFrame:
    """Rows of heads (family, band, node and others) for each pair of blocks (x, y) of each tile that they belong to, with their own
    block k. A tile is a band that the family has, with the one below; a set of block k goes to all pairs that have k."""
    per = heads.groupBy("family", "band").agg(F.count("*").alias("c")).withColumn("tile", F.explode(F.array(F.col("band"), F.col("band") + 1)))
    tiles = per.groupBy("family", "tile").agg(F.sum("c").alias("c"), F.max("band").alias("top")).filter("c > 1 and top = tile").selectExpr("family", "tile", f"cast(ceil(c / {block}) as int) blocks")
    tiles = tiles.withColumn("key", F.struct("family", "tile")).select("key", "blocks")
    rows = heads.withColumn("tile", F.explode(F.array(F.col("band"), F.col("band") + 1))).withColumn("key", F.struct("family", "tile"))
    rows = salted(rows, tiles, "key", "node").drop("key").withColumn("k", F.expr("cast(pmod(xxhash64(node), blocks) as int)"))
    rows = rows.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    return rows.withColumn("x", F.least("k", "other")).withColumn("y", F.greatest("k", "other")).drop("blocks", "other", "band")


def sides(table: pa.Table) -> np.ndarray:
    x, y = table.column("x")[0].as_py(), table.column("y")[0].as_py()
    return np.full(table.num_rows, 2) if x == y else (table.column("k").to_numpy() == y).astype(np.int64)


def pairs_table(node: np.ndarray, pairs: list[tuple[int, int]]) -> pa.Table:
    return pa.table([pa.array([int(node[a]) for a, _ in pairs], pa.int64()), pa.array([int(node[b]) for _, b in pairs], pa.int64())], names=["a", "b"])


def linked_groups(docs: DataFrame, words: int = 3, percent: int = 90) -> DataFrame:
    """doc_id, n_shingles, component_id of docs (doc_id long, text). Packs are cut and numbered once and written: whatever a later step
    asks of a row by its number, it asks of these."""
    docs = docs.select("doc_id", "text")
    packs = written(ex.packs_of(docs), "packs")
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    found = written(neighbours(packs, size, words, percent), "neighbours")
    twins = found.filter("kind = 2").select("a", F.col("b").alias("head"))
    family = components(found.filter("kind < 3").select("a", "b"))
    heads = family.join(found.filter("kind = 3").select(F.col("a").alias("node"), F.col("b").alias("n"), "sketch"), "node").join(twins, F.col("node") == F.col("a"), "left_anti")
    heads = written(heads.select("node", F.col("component").alias("family"), "n", bands_column(percent).alias("band"), "sketch"), "heads")

    def near(table: pa.Table) -> pa.Table:
        give_back()
        table = table.sort_by("node")
        sketch = folded(table.column("sketch").to_pylist())
        return pairs_table(table.column("node").to_numpy(), near_sketches(table.column("n").to_numpy(), sketch, sides(table), percent))

    # sketches alone part most families; what is left of them is compared by its shingles
    close = components(dealt_out(heads, SKETCHED).groupBy("family", "tile", "x", "y").applyInArrow(near, "a long, b long"))
    kept = written(heads.select("node", "band").join(close, "node").withColumnRenamed("component", "family"), "kept")
    place = [F.shiftright("node", PLACE).alias("pack"), F.expr(f"node & {(1 << PLACE) - 1}").alias("place")]
    wanted = dealt_out(kept, BLOCK).select(*place, "node", "family", "tile", "x", "y", "k")

    def fetch(own: pa.Table, want: pa.Table) -> pa.Table:
        names = ["family", "tile", "x", "y", "k", "node"]
        body = []
        if own.num_rows and want.num_rows:
            pack = ex.Pack(own.column("body")[0].as_py())
            sets = Sets(pack.data, pack.offs, words)
            body = [ex.squeeze_sorted(sets.keys[sets.offs[p] : sets.offs[p + 1]]) for p in want.column("place").to_pylist()]
        return pa.table([*(want.column(c) if body else want.column(c).slice(0, 0) for c in names), pa.array(body, pa.binary())], names=[*names, "shingles"])

    def compare(table: pa.Table) -> pa.Table:
        give_back()
        table = table.sort_by("node")
        sets = [ex.expand_sorted(s) for s in table.column("shingles").to_pylist()]
        return pairs_table(table.column("node").to_numpy(), tile_links(sets, sides(table), percent))

    rows = packs.groupBy("pack").cogroup(wanted.groupBy("pack")).applyInArrow(fetch, "family long, tile int, x int, y int, k int, node long, shingles binary")
    group = components(rows.groupBy("family", "tile", "x", "y").applyInArrow(compare, "a long, b long"))

    def sizes(batches):
        for batch in batches:
            for key, body in zip(batch.column("pack").to_pylist(), batch.column("body")):
                pack = ex.Pack(body.as_py())
                many = np.diff(shingles(pack.data, pack.offs, words)[1])
                yield pa.RecordBatch.from_arrays([pa.array(row_key(key, np.arange(len(many)))), pa.array(pack.ids, pa.int64(), mask=pack.ids == ex.NO_ID), pa.array(many)], names=["node", "doc_id", "n_shingles"])

    # a set's own name where it has a twin or a link; others are groups of their own
    names = twins.selectExpr("a node", "head name").union(twins.selectExpr("head", "head").distinct()).union(group.selectExpr("node", "node"))
    names = salted(names.distinct(), group.withColumnRenamed("node", "name"), "name", "node", "left").select("node", F.coalesce("component", "name").alias("component"))
    every = packs.mapInArrow(handed_back(sizes), "node long, doc_id long, n_shingles long").join(names, "node", "left")
    every = written(every, "sized")
    grouped = every.filter("component is not null")
    named = salted(grouped, grouped.groupBy("component").agg(F.min("doc_id").alias("component_id")), "component", "node")
    return every.filter("component is null").selectExpr("doc_id", "n_shingles", "doc_id component_id").union(named.select("doc_id", "n_shingles", "component_id"))


def bands_column(percent: int):
    """Band of the size n, by the same bounds as bands()."""
    edge = bands(1 << 26, percent).tolist()
    return F.expr(f"size(filter(array({','.join(f'{e}L' for e in edge)}), e -> e <= n)) - 1")
