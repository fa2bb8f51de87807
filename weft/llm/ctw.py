"""Context-tree weighting over bytes, and the unigram score that it is held against.

Each byte is eight binary decisions, and each decision has a context tree over the DEPTH bytes before it. A node's counts give a
Krichevsky-Trofimov estimate; its weighted probability is half that and half the product of its children's, so a prediction
mixes the estimates of all depths. Learning counts strings of DEPTH + 1 bytes in each task and adds them up by the two bytes that
are next to the predicted one (a shuffle; every subtree from depth 2 on is whole in one group). The strings and their counts stay a
table, dealt out by those bytes, and every node of the tree counts. Packs of documents ask that table for the code lengths of their
distinct strings; a group works its trees out and answers. Only depths 0 and 1, 2^16 nodes whatever the corpus is, are broadcast.

Texts are lower-cased (A-Z) and end with one zero byte that is scored as well; the bytes before a text count as zeros.
Defined results: a null or empty text is that zero byte alone; without learning texts every bit has probability 1/2; repeated
rows count each time; a null doc_id is learned from and not held out.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import exchange as ex
from .common import lower_ascii, padded, partitions, row_chunks, runs, segment_sum, slice_hash, text_bytes, words64, written

DEPTH = 5
#: strings of a group whose trees are worked out at once; those of one pair of bytes are never parted
FAMILY = 1 << 18
LEARNED, TOKENS, STRINGS = range(3)
CONTEXT = np.uint64((1 << (8 * DEPTH)) - 1)


def strings(data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The string of DEPTH + 1 bytes that ends at each byte and at the closing zero of each text, as a number whose lowest byte is the oldest;
    and the texts' offsets among them."""
    n = len(offs) - 1
    size = np.diff(offs)
    at = offs[:-1] + np.arange(n) * (DEPTH + 1)  # where each text's leading zeros begin
    flat = np.zeros(len(data) + n * (DEPTH + 1) + 8, np.uint8)
    which = np.repeat(np.arange(n), size)
    flat[np.arange(len(data)) + DEPTH + which * (DEPTH + 1)] = lower_ascii(data)
    mine = np.concatenate([[0], np.cumsum(size + 1)])
    place = np.arange(mine[-1]) + np.repeat(at - mine[:-1], size + 1)
    return words64(flat)[place] & np.uint64((1 << (8 * DEPTH + 8)) - 1), mine


def turned(keys: np.ndarray) -> np.ndarray:
    """Strings in the order of their contexts from the nearest byte on, then of the last byte."""
    return ((keys & CONTEXT) << np.uint64(8)) | (keys >> np.uint64(8 * DEPTH))


def near(keys: np.ndarray) -> np.ndarray:
    """The two context bytes next to the last byte, of turned strings."""
    return (keys >> np.uint64(8 * (DEPTH - 1))).astype(np.int64)


def dealt(keys: np.ndarray, buckets: int):
    return ex.deal(near(keys).astype(np.uint64) * np.uint64(40503) >> np.uint64(4), buckets)


def merged(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    keys, counts = np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts])
    order, first = ex.groups(keys)
    return keys[order][first], np.add.reduceat(counts[order], first) if len(first) else counts[:0]


def count(docs: DataFrame) -> DataFrame:
    """bucket, pack, kind, payload: each task's turned strings and their counts, dealt out by the two bytes before the last."""
    buckets = partitions(docs.sparkSession)

    def run(batches):
        parts, held = [], 0
        for batch in batches:
            data, offs = text_bytes(batch.column("text"))
            for i, j in row_chunks(offs):
                keys = np.sort(turned(strings(data[offs[i] : offs[j]], offs[i : j + 1] - offs[i])[0]))
                first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
                parts.append((keys[first], np.diff(np.append(first, len(keys)))))
                held += len(first)
                if held > 1 << 21:
                    parts = [merged(parts)]
                    held = len(parts[0][0]) // 2
        if parts:
            keys, counts = merged(parts)
            yield from ex.rows_of(0, ((b, LEARNED, ex.join_parts(ex.squeeze_sorted(keys[at]), ex.squeeze(counts[at]))) for b, at in dealt(keys, buckets) if len(at)))

    return docs.select("text").mapInArrow(run, ex.ASKED)


def log_gamma(x: np.ndarray) -> np.ndarray:
    """Stirling's series at x + 10, taken back by the recurrence."""
    y, product = x + 10.0, np.ones_like(x)
    for k in range(10):
        product *= x + k
    return (y - 0.5) * np.log(y) - y + 0.5 * np.log(2 * np.pi) + 1 / (12 * y) - 1 / (360 * y**3) + 1 / (1260 * y**5) - np.log(product)


def log_kt(n0: np.ndarray, n1: np.ndarray) -> np.ndarray:
    """Log probability of a sequence with these counts under the Krichevsky-Trofimov estimator."""
    return log_gamma(n0 + 0.5) + log_gamma(n1 + 0.5) - log_gamma(n0 + n1 + 1.0) - np.log(np.pi)


def nodes_of(keys: np.ndarray, level: int) -> np.ndarray:
    """Node of depth DEPTH of each turned string: its context, and the bits so far after a leading 1. In order if keys are."""
    byte = keys & np.uint64(0xFF)
    return (keys ^ byte) | np.uint64(1 << level) | (byte >> np.uint64(8 - level))


def parents(node: np.ndarray) -> np.ndarray:
    """The same bits after a context without its oldest byte."""
    return ((node >> np.uint64(16)) << np.uint64(8)) | (node & np.uint64(0xFF))


class Layer(NamedTuple):
    """Nodes of a depth in order: counts of 0 and 1, log weighted probability, log of stopping here against going on."""

    node: np.ndarray
    n0: np.ndarray
    n1: np.ndarray
    weighted: np.ndarray
    stop: np.ndarray


def tree(keys: np.ndarray, counts: np.ndarray, level: int) -> list[Layer]:
    """Layers of depths 2 to DEPTH for a bit of the last byte. keys (turned, in order) hold all strings of their two near bytes."""
    node, bit = nodes_of(keys, level), (keys >> np.uint64(7 - level)) & np.uint64(1) == 1
    first = np.flatnonzero(np.concatenate([[True], node[1:] != node[:-1]])[: len(node)])
    node = node[first]
    n0, n1 = (np.add.reduceat(np.where(own, counts, 0), first).astype(np.float64) if len(first) else np.zeros(0) for own in (~bit, bit))
    out, rest = [], None
    for depth in range(DEPTH, 1, -1):
        own = log_kt(n0, n1)
        if rest is None:
            out.append(Layer(node, n0, n1, own, np.full(len(node), 60.0)))
        else:
            out.append(Layer(node, n0, n1, np.logaddexp(own, rest) - np.log(2), np.clip(own - rest, -60, 60)))
        node, inverse = np.unique(parents(node), return_inverse=True)
        n0, n1, rest = (np.bincount(inverse, x, len(node)) for x in (n0, n1, out[-1].weighted))
    return out[::-1]


class Top(NamedTuple):
    """Of the nodes of depths 0 and 1: the probability of a 1 for strings that go no deeper. Of those of depth 1 that were seen: what a
    string that goes deeper has of that probability already, and what is left to the depths below."""

    ends0: np.ndarray
    ends1: np.ndarray
    seen1: np.ndarray
    before: np.ndarray
    left: np.ndarray


def top_of(n0: np.ndarray, n1: np.ndarray, rest: np.ndarray) -> Top:
    """From counts and the sum of log weighted probabilities below, by node of depth 1."""
    one, stop = {}, {}
    for depth in (1, 0):
        own = log_kt(n0, n1)
        one[depth], stop[depth] = (n1 + 0.5) / (n0 + n1 + 1), 1 / (1 + np.exp(-np.clip(own - rest, -60, 60)))
        if depth:
            seen = n0 + n1 > 0
            weighted = np.where(seen, np.logaddexp(own, rest) - np.log(2), 0.0)
            n0, n1, rest = (x.reshape(256, 256).sum(axis=0) for x in (n0, n1, weighted))
    before, left = np.tile(stop[0] * one[0], 256), np.tile(1 - stop[0], 256)
    return Top(one[0], before + left * one[1], seen, before + left * stop[1] * one[1], left * (1 - stop[1]))


def ones(layers: list[Layer], top: Top, asked: np.ndarray) -> np.ndarray:
    """Probability of a 1 at each asked node of depth DEPTH: the mixture along its path, which ends where no node is."""
    up = asked
    for _ in range(DEPTH - 1):
        up = parents(up)
    at = up.astype(np.int64)
    out = np.where(top.seen1[at], top.ends1[at], top.ends0[at & 0xFF])
    above = before = left = None
    for depth, layer in enumerate(layers, 2):
        if above is None:
            at = parents(layer.node).astype(np.int64)
            a, b = top.before[at], top.left[at]
        else:
            at = np.searchsorted(above, parents(layer.node))
            a, b = before[at], left[at]
        one = (layer.n1 + 0.5) / (layer.n0 + layer.n1 + 1)
        share = 1 / (1 + np.exp(-layer.stop))
        above, before, left = layer.node, a + b * share * one, b * (1 - share)
        mine = asked
        for _ in range(DEPTH - depth):
            mine = parents(mine)
        at = np.minimum(np.searchsorted(layer.node, mine), len(layer.node) - 1)
        if len(layer.node):
            out = np.where(layer.node[at] == mine, (a + b * one)[at], out)
    return out


def families(keys: np.ndarray, *more: np.ndarray):
    """Ranges of whole pairs of near bytes in each of the arrays of turned strings, which are in order."""
    offs = [np.concatenate([[0], np.cumsum(np.bincount(near(k), minlength=1 << 16))]) for k in (keys, *more)]
    for i, j in row_chunks(sum(offs), FAMILY):
        yield [slice(o[i], o[j]) for o in offs]


def code_lengths(keys: np.ndarray, counts: np.ndarray, asked: np.ndarray, top: Top) -> np.ndarray:
    """Log2 probability of the last byte of each asked string after the others; keys and asked are turned and in order."""
    out = np.zeros(len(asked))
    for own, wanted in families(keys, asked):
        want = asked[wanted]
        for level in range(8 if len(want) else 0):
            one = ones(tree(keys[own], counts[own], level), top, nodes_of(want, level))
            out[wanted] += np.log2(np.where((want >> np.uint64(7 - level)) & np.uint64(1) == 1, one, 1 - one))
    return out


def learned_strings(payloads: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    if not payloads:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    return merged([(ex.expand_sorted(a), ex.expand(b).astype(np.int64)) for a, b in map(ex.split_parts, payloads)])


class Model(NamedTuple):
    """learned: the strings and counts of each bucket, as a table."""

    learned: DataFrame
    top: Top
    buckets: int

    def answers(self, asked: DataFrame, tokens: Callable[[list[bytes]], list[bytes]] | None = None, dtype: str = "<f4") -> DataFrame:
        """Answers of rows of kind STRINGS with log2 probabilities, of kind TOKENS with what tokens makes of a bucket's payloads."""
        sent = asked.sparkSession.sparkContext.broadcast(self.top)

        def run(table: pa.Table) -> pa.Table:
            table = table.sort_by([("kind", "ascending"), ("pack", "ascending")])
            kinds, payloads = table.column("kind").to_numpy(), table.column("payload")
            learned, words, texts = (payloads.filter(pa.array(kinds == k)).to_pylist() for k in (LEARNED, TOKENS, STRINGS))
            out = tokens(words) if words else []
            if texts:
                # the bucket's distinct strings once, whatever packs ask for them
                want, held = [], 0
                for raw in texts:
                    want.append(ex.expand_sorted(raw))
                    held += len(want[-1])
                    if held > 1 << 22:
                        want = [np.unique(np.concatenate(want))]
                        held = len(want[0]) // 2
                want = np.unique(np.concatenate(want))
                value = code_lengths(*learned_strings(learned), want, sent.value).astype(dtype)
                out += [value[np.searchsorted(want, ex.expand_sorted(raw))].tobytes() for raw in texts]
            table = table.slice(len(learned))
            return pa.table([table.column("bucket"), table.column("pack"), table.column("kind"), pa.array(out, pa.binary())], names=["bucket", "pack", "kind", "payload"])

        return asked.union(self.learned).groupBy("bucket").applyInArrow(run, ex.ASKED)

    def _asked(self, keys: np.ndarray, dtype: str) -> np.ndarray:
        want, inverse = np.unique(turned(keys), return_inverse=True)
        places = {b: at for b, at in dealt(want, self.buckets) if len(at)}
        rows = [(b, 0, STRINGS, ex.squeeze_sorted(want[at])) for b, at in places.items()]
        out = np.zeros(len(want))
        for row in self.answers(self.learned.sparkSession.createDataFrame(rows, ex.ASKED), dtype=dtype).toLocalIterator():
            out[places[row.bucket]] = np.frombuffer(bytes(row.payload), dtype)
        return out[inverse]

    def bits(self, keys: np.ndarray) -> np.ndarray:
        """Log2 probability of the last byte of each string after the others, by a job of its own."""
        return self._asked(keys, "<f8")

    def lengths(self, keys: np.ndarray) -> np.ndarray:
        """As bits, in the precision that packs are answered in."""
        return self._asked(keys, "<f4")


def fit(docs: DataFrame) -> Model:
    """Learns from every row's text."""

    def add(table: pa.Table) -> pa.Table:
        """Kind LEARNED: a bucket's strings and their counts. Kind -1: what the nodes of depth 1 need from its trees."""
        keys, counts = learned_strings(table.column("payload").to_pylist())
        sums = np.zeros((3, 1 << 16))
        for (own,) in families(keys):
            for level in range(8):
                layer = tree(keys[own], counts[own], level)[0]
                up = parents(layer.node).astype(np.int64)
                sums += [np.bincount(up, x, 1 << 16) for x in (layer.n0, layer.n1, layer.weighted)]
        node = np.flatnonzero(sums[0] + sums[1])
        b = table.column("bucket")[0].as_py()
        rows = [(b, LEARNED, ex.join_parts(ex.squeeze_sorted(keys), ex.squeeze(counts))), (b, -1, ex.join_parts(node.astype("<i8").tobytes(), *(x[node].tobytes() for x in sums)))]
        return pa.Table.from_batches(list(ex.rows_of(0, rows)))

    made = written(count(docs).groupBy("bucket").applyInArrow(add, ex.ASKED), "strings")
    sums = np.zeros((3, 1 << 16))
    for row in made.filter("kind = -1").orderBy("bucket").toLocalIterator():
        node, *own = (np.frombuffer(p, "<i8" if k == 0 else "<f8") for k, p in enumerate(ex.split_parts(bytes(row.payload))))
        sums[:, node] += own
    return Model(made.filter(F.col("kind") == LEARNED), top_of(*sums), partitions(docs.sparkSession))


def tokens(pack: ex.Pack) -> tuple[np.ndarray, np.ndarray]:
    """Hash of each token of a pack, with the end token (an empty string) after each text's words; and their offsets by text."""
    low = lower_ascii(pack.data)
    n = len(pack.offs) - 1
    size = np.diff(pack.offs)
    mask = np.zeros(len(low) + n, bool)
    mask[np.arange(len(low)) + np.repeat(np.arange(n), size)] = ~np.isin(low, [32, 9, 10, 11, 12, 13])
    start, end = runs(mask)
    text = np.searchsorted(pack.offs[1:] + np.arange(1, n + 1), start, side="right")
    h = slice_hash(padded(low), start - text, end - text)
    words = np.bincount(text, minlength=n)
    offs = np.concatenate([[0], np.cumsum(words + 1)])
    out = np.empty(offs[-1], np.uint64)
    out[np.arange(len(h)) + text] = h
    out[offs[1:] - 1] = slice_hash(np.zeros(8, np.uint8), np.zeros(1, np.int64), np.zeros(1, np.int64))
    return out, offs


def held_out(doc_id: int, modulus: int = 5, remainder: int = 1) -> bool:
    return doc_id != ex.NO_ID and zlib.crc32(str(doc_id).encode()) % modulus == remainder


def score(docs: DataFrame, model: Model, held: Callable[[int], bool] = held_out) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score, bits_per_byte of docs (doc_id long, text)."""
    packs = ex.packed(docs.select("doc_id", "text"))
    buckets = model.buckets

    def texts(pack):
        """Turned strings of the pack's texts, some texts at a time; and their ranges by text."""
        for i, j in row_chunks(pack.offs):
            keys, mine = strings(pack.data[pack.offs[i] : pack.offs[j]], pack.offs[i : j + 1] - pack.offs[i])
            yield i, j, turned(keys), mine

    def distinct(pack):
        return np.unique(np.concatenate([np.unique(keys) for _, _, keys, _ in texts(pack)] or [np.zeros(0, np.uint64)]))

    def question(pack):
        h, offs = tokens(pack)
        learns = np.repeat(np.array([not held(i) for i in pack.ids.tolist()], bool), np.diff(offs))
        keys, inverse = np.unique(h, return_inverse=True)
        counts = np.bincount(inverse[learns], minlength=len(keys))
        for b, at in ex.deal(keys, buckets):
            yield b, TOKENS, ex.join_parts(ex.squeeze_sorted(keys[at]), ex.squeeze(counts[at]))
        keys = distinct(pack)
        for b, at in dealt(keys, buckets):
            if len(at):
                yield b, STRINGS, ex.squeeze_sorted(keys[at])

    def reply(payloads):
        """Counts of all packs together for each key; then all tokens and all distinct ones of the bucket."""
        parts = [ex.split_parts(p) for p in payloads]
        keys = [ex.expand_sorted(p[0]) for p in parts]
        every, counts = np.concatenate(keys), np.concatenate([ex.expand(p[1]).astype(np.int64) for p in parts])
        order, first = ex.groups(every)
        total = np.add.reduceat(counts[order], first) if len(first) else counts
        full = np.empty(len(every), np.int64)
        full[order] = np.repeat(total, np.diff(np.append(first, len(every))))
        ends = np.cumsum([len(k) for k in keys])
        sums = ex.squeeze(np.array([total.sum(), (total > 0).sum()]))
        return [ex.join_parts(ex.squeeze(full[e - len(k) : e]), sums) for e, k in zip(ends, keys)]

    def finish(pack, got):
        h, offs = tokens(pack)
        keys, inverse = np.unique(h, return_inverse=True)
        counts, n, v = np.zeros(len(keys), np.int64), 0, 0
        for b, at in ex.deal(keys, buckets):
            mine, sums = ex.split_parts(got[TOKENS, b])
            counts[at] = ex.expand(mine)
            own = ex.expand(sums)
            n, v = n + int(own[0]), v + int(own[1])
        c = counts[inverse]
        size = np.diff(offs)
        base = segment_sum(np.log10(c + 0.5), offs) - size * np.log10(n + 0.5 * (v + 1))
        keys, lengths = distinct(pack), np.zeros(len(size))
        value = np.zeros(len(keys))
        for b, at in dealt(keys, buckets):
            if len(at):
                value[at] = np.frombuffer(got[STRINGS, b], "<f4")
        for i, j, keys_of, mine in texts(pack):
            lengths[i:j] = segment_sum(value[np.searchsorted(keys, keys_of)], mine)
        ids = pa.array(pack.ids, pa.int64(), mask=pack.ids == ex.NO_ID)
        return pa.table(
            [ids, pa.array([held(i) for i in pack.ids.tolist()], pa.bool_()), pa.array(size), pa.array(segment_sum((c > 0).astype(np.int64), offs)), pa.array(np.full(len(size), n)), pa.array(base), pa.array(lengths * np.log10(2)), pa.array(-lengths / (np.diff(pack.offs) + 1))],
            names=["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score", "bits_per_byte"],
        )

    return ex.meet(packs, model.answers(ex.ask(packs, question), reply), finish, "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double, bits_per_byte double")
