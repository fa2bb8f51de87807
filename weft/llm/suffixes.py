"""Removal of byte strings that an earlier document has, by a difference-cover suffix sort cut off at the prefix length.

Suffixes at the places of a difference cover modulo 21 are sampled: for any two places some shift below 21 takes both into the
sample, and the 30 bytes that follow are the sample's tuple. Samples whose tuple occurs once are discarded first, as the algorithm
discards unique names: packs exchange hashes of their tuples, and one that nobody else has cannot matter. The others are sorted by
their bytes over range partitions; samples with one tuple have one name, and where names repeat the sort goes on. The full algorithm
recurses on the string of names for that; prefixes of 50 bytes end in the second tuple, so the recursion ends in the 20 bytes after
the first. The remaining suffixes are merged by the samples: a suffix s bytes before a sample stands where (those s bytes, the
sample's first 50 - s) stand. Neighbours in that order are compared byte by byte, and of equal ones the smallest doc_id counts.

Only bytes decide what is removed; a hash never does. Partitions are cut at the leading bytes of sampled places; leading bytes that
hold more than a partition's share are dealt over several. Defined results: a null text is empty; a null doc_id comes after all
others; rows with one doc_id remove nothing from each other; texts under the length keep all bytes.
"""

from __future__ import annotations

import hashlib
import zlib

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import exchange as ex
from .common import mix64, padded, partitions, row_chunks, runs, text_bytes, words64

COVER = np.array([0, 1, 4, 14, 16])  # every difference modulo 21 occurs
PERIOD = 21
LENGTH = 50
TUPLE = LENGTH - PERIOD + 1
#: the most bytes between a suffix and the sample that places it
SHIFT = PERIOD - 1
#: of a sample: the 50 bytes from it on, the 20 bytes before it (nearest first), and how many of either the text has; whole words
ROW = LENGTH + SHIFT + 2
ONCE, SAMPLES, NOTE = 0, 1, 2
ALL = np.uint32((1 << PERIOD) - 1)
#: places per partition that the partitions' bounds are taken from
BOUNDS = 64


def hashes(w: np.ndarray, at: np.ndarray, length: int) -> np.ndarray:
    """64-bit hashes of the strings of one length at these places; w: the words at every place."""
    h = np.full(len(at), 0x9E3779B97F4A7C15 ^ length, np.uint64)
    for k in [*range(0, length - 7, 8), *([length - 8] if length % 8 else [])]:
        h ^= w[at + k]
        h *= np.uint64(0xFF51AFD7ED558CCD)
        h ^= h >> np.uint64(32)
    h *= np.uint64(0xC4CEB9FE1A85EC53)
    return h ^ (h >> np.uint64(29))


def big_endian(rows: np.ndarray) -> np.ndarray:
    """Rows of bytes as columns of words that compare as the bytes do; the last word is filled up with zeros."""
    wide = np.zeros((len(rows), -(-rows.shape[1] // 8) * 8), np.uint8)
    wide[:, : rows.shape[1]] = rows
    return wide.view(">u8").astype(np.uint64).T


def row_hashes(rows: np.ndarray) -> np.ndarray:
    """Of rows of ROW bytes."""
    h = np.zeros(len(rows), np.uint64)
    for word in np.ascontiguousarray(rows).view("<u8").T:
        h ^= word
        h *= np.uint64(0xFF51AFD7ED558CCD)
        h ^= h >> np.uint64(32)
    return h


def alike(rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """An order of rows of bytes, and where new ones begin in it. Equal rows are next to each other (they share a hash); rows next to each
    other that differ count as different, whatever their hashes."""
    order = np.argsort(row_hashes(rows))
    new = np.ones(len(rows), bool)
    sorted_rows = rows[order]
    new[1:] = (sorted_rows[1:] != sorted_rows[:-1]).any(axis=1)
    return order, np.flatnonzero(new)


def places_of(order: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Each row's group, from an order and where groups begin in it."""
    out = np.empty(len(order), np.int64)
    out[order] = np.repeat(np.arange(len(first)), np.diff(np.append(first, len(order))))
    return out


class Work:
    """What a pack derives from its own bytes, and from its answers."""

    def __init__(self, pack: ex.Pack, bits: int, bounds: np.ndarray, buckets: int):
        self.pack, self.bits, self.bounds, self.buckets = pack, bits, bounds, buckets
        self.n = len(pack.data)
        self.home = zlib.crc32(pack.ids.tobytes()) % buckets  # where a pack leaves a note for itself: no bucket gets all of them
        self.doc = np.repeat(np.arange(len(pack.offs) - 1, dtype=np.int32), np.diff(pack.offs))

    def covered(self) -> np.ndarray:
        """Sampled places of the pack at which a tuple fits into its text."""
        place = (np.arange(0, self.n, PERIOD)[:, None] + COVER).ravel()
        place = place[place < self.n]
        return place[self.pack.offs[1:][self.doc[place]] - place >= TUPLE]

    def tuples(self) -> tuple[np.ndarray, ...]:
        """Sampled places, distinct hashes of their tuples, each place's among them, and how many places have it."""
        place = self.covered()
        h = hashes(words64(padded(self.pack.data, 64)), place, TUPLE)
        order, first = ex.groups(h)
        return place, h[order[first]], places_of(order, first), np.diff(np.append(first, len(h)))

    def ask(self):
        distinct = self.tuples()[1]
        for b, at in ex.deal(distinct, self.buckets):
            if len(at):
                yield b, ONCE, ex.squeeze_sorted(distinct[at] >> np.uint64(64 - self.bits))

    def repeated(self, got: dict) -> np.ndarray:
        """Of the sampled places: those whose tuple may be there again."""
        place, distinct, own, count = self.tuples()
        many = count > 1
        for b, at in ex.deal(distinct, self.buckets):
            if len(at):
                many[at] |= np.unpackbits(np.frombuffer(got[ONCE, b], np.uint8), count=len(at)).astype(bool)
        return many[own]

    def samples(self, kept: np.ndarray) -> tuple[np.ndarray, ...]:
        """Places of the samples that are kept and that some 50 bytes hold, what the text has before and after each (up to what counts),
        and their rows."""
        place = self.covered()[kept]
        doc = self.doc[place]
        before = np.minimum(SHIFT, place - self.pack.offs[doc])
        after = np.minimum(LENGTH, self.pack.offs[doc + 1] - place)
        whole = before + after >= LENGTH
        place, before, after = place[whole], before[whole], after[whole]
        wide = np.concatenate([np.zeros(SHIFT, np.uint8), self.pack.data, np.zeros(LENGTH, np.uint8)])
        context = np.lib.stride_tricks.sliding_window_view(wide, SHIFT + LENGTH)[place] if len(place) else np.zeros((0, SHIFT + LENGTH), np.uint8)
        rows = np.empty((len(place), ROW), np.uint8)
        rows[:, :LENGTH] = context[:, SHIFT:]
        rows[:, LENGTH : LENGTH + SHIFT] = context[:, :SHIFT][:, ::-1]
        rows[:, -2], rows[:, -1] = before, after
        edge = np.flatnonzero((before < SHIFT) | (after < LENGTH))  # other texts' bytes
        column = np.arange(LENGTH + SHIFT)
        rows[edge, : LENGTH + SHIFT] *= np.where(column < LENGTH, column < after[edge, None], column - LENGTH < before[edge, None])
        return place, before, after, rows

    def sent(self, rows: np.ndarray, place: np.ndarray):
        """Distinct rows in the order of their leading bytes, the smallest doc_id of each, each row's place among them, and the ranges of
        the buckets in them."""
        order, first = alike(rows)
        ids = self.pack.ids[self.doc[place]]
        low = np.minimum.reduceat(ids[order], first) if len(first) else ids
        own, distinct = places_of(order, first), rows[order[first]]
        words = big_endian(distinct[:, :TUPLE]) if len(distinct) else np.zeros((4, 0), np.uint64)
        lead, rest = words[0], mix64(words[1] ^ mix64(words[2] ^ mix64(words[3])))  # a name is one group, by all of its bytes
        a, z = (np.searchsorted(self.bounds, lead, side=side) for side in ("left", "right"))
        bucket = a + ((rest >> np.uint64(20)) % (z - a + 1).astype(np.uint64)).astype(np.int64)
        order = np.lexsort((words[1], lead, bucket))
        rank = np.empty(len(order), np.int64)
        rank[order] = np.arange(len(order))
        return distinct[order], low[order], rank[own], np.searchsorted(bucket[order], np.arange(self.buckets + 1))

    def ask_again(self, got: dict):
        kept = self.repeated(got)
        yield self.home, NOTE, zstandard.ZstdCompressor(level=1).compress(np.packbits(kept).tobytes())  # for itself
        place, _, _, rows = self.samples(kept)
        distinct, low, _, edge = self.sent(rows, place)
        pack = zstandard.ZstdCompressor(level=3)
        for b, (i, j) in enumerate(zip(edge, edge[1:])):
            if j > i:
                yield b, SAMPLES, ex.join_parts(pack.compress(distinct[i:j].tobytes()), ex.squeeze(low[i:j].view(np.uint64)))

    def removed(self, got: dict) -> np.ndarray:
        """Mask of removed bytes, from the answers to ask_again."""
        kept = np.unpackbits(np.frombuffer(zstandard.ZstdDecompressor().decompress(got[NOTE, self.home]), np.uint8), count=len(self.covered())).astype(bool)
        place, before, after, rows = self.samples(kept)
        _, low, own, edge = self.sent(rows, place)
        hit = np.zeros(len(low), np.uint32)
        for b, (i, j) in enumerate(zip(edge, edge[1:])):
            if j > i:
                hit[i:j] = ex.expand(got[SAMPLES, b])
        earlier = self.pack.ids[self.doc[place]] > low[own]  # the same row in the pack
        hit = np.where(earlier, ALL, hit[own])
        gone = np.zeros(self.n + 1, np.int32)
        for s in range(PERIOD):
            gone[place[(hit >> np.uint32(s) & 1).astype(bool) & (before >= s) & (after >= LENGTH - s)] - s] = 1
        cover = np.zeros(self.n + LENGTH + 1, np.int32)
        cover[: self.n + 1] = gone
        cover[LENGTH:] -= gone
        return np.cumsum(cover)[: self.n] > 0


def shared(rows: np.ndarray) -> np.ndarray:
    """How many leading bytes each row has in common with the one before it; 0 for the first."""
    out = np.zeros(len(rows), np.int64)
    if len(rows) > 1:
        differ = rows[1:] != rows[:-1]
        out[1:] = np.where(differ.any(axis=1), differ.argmax(axis=1), rows.shape[1])
    return out


def merge(rows: np.ndarray, docs: np.ndarray) -> np.ndarray:
    """For each sample: bit s tells whether the suffix s bytes before it begins with 50 bytes that an earlier document has with a sample
    at the same place."""
    order, first = alike(rows)
    own = places_of(order, first)
    low = np.minimum.reduceat(docs[order], first) if len(first) else docs
    distinct = rows[order[first]]
    order = np.lexsort(big_endian(distinct[:, :LENGTH])[::-1]) if len(distinct) else np.zeros(0, np.int64)
    distinct, low = distinct[order], low[order]
    rank = np.empty(len(order), np.int64)
    rank[order] = np.arange(len(order))
    own = rank[own]
    common = shared(distinct[:, :LENGTH])
    named = np.append(np.flatnonzero(common < TUPLE), len(distinct))  # where a name begins
    alone = np.repeat(np.diff(named) == 1, np.diff(named))
    hit = np.where(low[own] < docs, ALL, np.uint32(0))  # right where a name has one row
    rows, docs, own, at = distinct[~alone], docs[~alone[own]], own[~alone[own]], np.flatnonzero(~alone[own])
    if not len(rows):
        return hit
    own = (np.cumsum(~alone) - 1)[own]
    low, common = low[~alone], common[~alone]
    left = np.lexsort(big_endian(rows[:, LENGTH : LENGTH + SHIFT])[::-1])
    before, after = rows[:, -2], rows[:, -1]
    shared_left = shared(rows[left, LENGTH : LENGTH + SHIFT])
    found = np.zeros(len(at), np.uint32)
    for s in range(PERIOD):
        prefix = np.empty(len(rows), np.int64)
        prefix[left] = np.cumsum(shared_left < s)
        key = prefix << 32 | np.cumsum(common < LENGTH - s)
        order, first = ex.groups(key)
        valid = np.where((before >= s) & (after >= LENGTH - s), low, ex.NO_ID)[order]
        least = np.empty(len(rows), np.int64)
        least[order] = np.repeat(np.minimum.reduceat(valid, first), np.diff(np.append(first, len(rows))))
        found |= (least[own] < docs).astype(np.uint32) << np.uint32(s)
    hit[at] = found
    return hit


def reply(kind: int, payloads: list[bytes]) -> list[bytes]:
    """For hashes of tuples: does another pack have it? For samples: what merge tells of them."""
    if kind == NOTE:
        return payloads
    if kind == ONCE:
        values = [ex.expand_sorted(p) for p in payloads]
        every = np.concatenate(values)
        # a pack may have one fragment for several hashes; that counts as repeated as well
        order, first = ex.groups(every)
        many = np.empty(len(every), bool)
        size = np.diff(np.append(first, len(every)))
        many[order] = np.repeat(size > 1, size)
        ends = np.cumsum([len(v) for v in values])
        return [np.packbits(many[e - len(v) : e]).tobytes() for e, v in zip(ends, values)]
    parts = [ex.split_parts(p) for p in payloads]
    unpack = zstandard.ZstdDecompressor()
    rows = np.frombuffer(b"".join(unpack.decompress(p[0]) for p in parts), np.uint8).reshape(-1, ROW)
    docs = [ex.expand(p[1]).view(np.int64) for p in parts]
    hit = merge(rows, np.concatenate(docs))
    ends = np.cumsum([len(d) for d in docs])
    return [ex.squeeze(hit[e - len(d) : e]) for e, d in zip(ends, docs)]


def bounds_of(docs: DataFrame, buckets: int) -> np.ndarray:
    """Leading bytes (as numbers) that part the suffixes into so many ranges, from BOUNDS places for each, spread by a hash."""

    def run(batches):
        for batch in batches:
            data, offs = text_bytes(batch.column("text"))
            for i, j in row_chunks(offs):
                own = padded(data[offs[i] : offs[j]])
                at = np.random.default_rng(int(offs[j] - offs[i])).integers(0, max(1, len(own) - 64), BOUNDS)
                lead = big_endian(own[at[:, None] + np.arange(8)])[0]
                yield pa.RecordBatch.from_arrays([pa.array(lead.view(np.int64))], names=["lead"])

    rows = docs.select("text").mapInArrow(run, "lead long").orderBy(F.xxhash64("lead"), "lead").limit(BOUNDS * buckets).collect()
    lead = np.sort(np.array([r.lead for r in rows], np.int64).view(np.uint64))
    return lead[(np.arange(1, buckets) * len(lead)) // buckets] if len(lead) else lead


def removed_spans(docs: DataFrame, finish, schema: str) -> DataFrame:
    """Of each pack: finish(pack, mask of removed bytes). docs: doc_id long, text, and what else finish takes from pack.rest()."""
    packs = ex.packed(docs)
    buckets = partitions(docs.sparkSession)
    # so many bits that few of the tuples' hashes agree by chance; one that does is sent in vain and does no harm
    total = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    bits, bounds = min(64, max(24, int(total).bit_length() + 3)), bounds_of(docs, buckets)
    work = lambda pack: Work(pack, bits, bounds, buckets)
    first = ex.answer(ex.ask(packs, lambda p: work(p).ask()), reply)
    second = ex.answer(ex.ask_again(packs, first, lambda p, got: work(p).ask_again(got)), reply)
    return ex.meet(packs, second, lambda pack, got: finish(pack, work(pack).removed(got)), schema)


def ids_column(pack: ex.Pack) -> pa.Array:
    return pa.array(pack.ids, pa.int64(), mask=pack.ids == ex.NO_ID)


def digests(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256."""

    def finish(pack, mask):
        rows = []
        for a, b in zip(pack.offs[:-1].tolist(), pack.offs[1:].tolist()):
            own = mask[a:b]
            rows.append((b - a, int(own.sum()), len(runs(own)[0]), hashlib.sha256(pack.data[a:b][~own].tobytes()).hexdigest()))
        columns = list(zip(*rows)) or [[]] * 4
        return pa.table([ids_column(pack), *(pa.array(c, pa.int64()) for c in columns[:3]), pa.array(columns[3], pa.string())], names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"])

    return removed_spans(docs.select("doc_id", "text"), finish, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string")


def spans(docs: DataFrame) -> DataFrame:
    """doc_id, start, end: maximal runs of removed bytes in the UTF-8 text."""

    def finish(pack, mask):
        doc, start, end = [], [], []
        for k, (a, b) in enumerate(zip(pack.offs[:-1].tolist(), pack.offs[1:].tolist())):
            s, e = runs(mask[a:b])
            doc.append(np.full(len(s), pack.ids[k]))
            start.append(s)
            end.append(e)
        doc = np.concatenate([*doc, np.zeros(0, np.int64)])
        return pa.table([pa.array(doc, pa.int64(), mask=doc == ex.NO_ID), pa.array(np.concatenate([*start, np.zeros(0, np.int64)]), pa.int64()), pa.array(np.concatenate([*end, np.zeros(0, np.int64)]), pa.int64())], names=["doc_id", "start", "end"])

    return removed_spans(docs.select("doc_id", "text"), finish, "doc_id long, start long, end long")


def kept_text(docs: DataFrame) -> DataFrame:
    """docs with each text without its removed bytes (a null text is empty); what is left of a character that was cut goes too."""
    names = docs.columns

    def finish(pack, mask):
        texts = [pack.data[a:b][~mask[a:b]].tobytes().decode("utf-8", "ignore") for a, b in zip(pack.offs[:-1].tolist(), pack.offs[1:].tolist())]
        rest = pack.rest()
        own = {"doc_id": ids_column(pack), "text": pa.array(texts, pa.string())}
        return pa.table([own[c] if c in own else rest.column(c) for c in names], names=names)

    return removed_spans(docs, finish, docs.schema)
