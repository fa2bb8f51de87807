"""Benchmark passages in documents, within a budget of edits.

Items are cut into segments (a short item is one). A match of a segment of m characters with at most e edits shares m + 1 - q - q e
of its q-grams with the document, on diagonals that differ by e at most (the q-gram lemma). Shared q-grams are counted in
overlapping diagonal bands; bands that reach that number are aligned, in the band alone, for all of a batch's candidates at once.

Texts and items are compared in lower case with runs of white space as one space. The index of the benchmark is broadcast in
slices of at most SLICE characters; a larger benchmark takes more passes. Hits are counted in stretches of a bounded number of them. Defined results: null or empty texts match nothing;
null, empty and very short items (under q characters) are not searched; repeated rows give repeated results.
"""

from __future__ import annotations

import sys

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bpe import LETTER, SPACE, classes
from .common import handed_back, row_chunks, text_bytes

Q = 8
RATE = 0.1
SEGMENT = 100
SLICE = 8_000_000
BITS = 22
#: hits of a stretch of places; bounds the memory of a task whatever grams a text and the benchmark have in common
HITS = 1 << 22
#: hits that are held at once: a stretch with more, since it has the places in reach too, is settled by ranges of segments
MOST = 1 << 23
#: bits of a key for the half bands of a text and a segment; they are counted from MIDDLE on, since the first ones are negative
WIDE = 32
MIDDLE = 1 << 20
_FOLD: list[np.ndarray] = []


def fold() -> np.ndarray:
    """Each code point as it is compared."""
    if not _FOLD:
        table = np.arange(sys.maxunicode + 1, dtype=np.uint32)
        for c in np.flatnonzero(classes() == LETTER).tolist():
            low = chr(c).lower()
            if len(low) == 1:
                table[c] = ord(low)
        table[classes() == SPACE] = 32
        _FOLD.append(table)
    return _FOLD[0]


def folded(data: bytes, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Folded code points of the texts laid end to end, their offsets by text, and the place of each within its own text."""
    raw = np.frombuffer(data, np.uint8)
    points = fold()[np.frombuffer(data.decode("utf-8").encode("utf-32-le"), np.uint32)]
    at = np.concatenate([[0], np.cumsum((raw & 0xC0) != 0x80)])[offs]
    space = points == 32
    keep = ~space | ~np.concatenate([[False], space[:-1]])
    keep[at[:-1][np.diff(at) > 0]] = True
    place = np.flatnonzero(keep)
    mine = np.concatenate([[0], np.cumsum(keep)])[at]
    return points[keep], mine, place - np.repeat(at[:-1], np.diff(mine))


def gram_hashes(points: np.ndarray) -> np.ndarray:
    """Hash of the Q code points from each place on; there are Q - 1 fewer."""
    n = max(0, len(points) - Q + 1)
    h = np.zeros(n, np.uint64)
    for k in range(Q):
        h *= np.uint64(0x9E3779B97F4A7C15)
        h += points[k : k + n]
    h ^= h >> np.uint64(32)
    h *= np.uint64(0xFF51AFD7ED558CCD)
    return h


class Index:
    def __init__(self, items: list[tuple[int, str]], rate: float = RATE, segment: int = SEGMENT):
        self.item: list[list[int]] = []  # items that have a segment; equal segments are one
        self.text: list[np.ndarray] = []
        known: dict[bytes, int] = {}
        for item, text in items:
            raw = (text or "").encode()
            points = folded(raw, np.array([0, len(raw)]))[0]
            while len(points) and points[0] == 32:
                points = points[1:]
            while len(points) and points[-1] == 32:
                points = points[:-1]
            starts = [0] if len(points) < 1.5 * segment else sorted({*range(0, len(points) - segment, segment // 2), len(points) - segment})
            for a in starts:
                part = points if len(starts) == 1 else points[a : a + segment]
                if len(part) >= Q:
                    k = known.setdefault(part.tobytes(), len(self.text))
                    if k == len(self.text):
                        self.item.append([])
                        self.text.append(part)
                    self.item[k].append(item)
        self.size = np.array([len(t) for t in self.text], np.int64)
        self.edits = np.minimum((self.size * rate).astype(np.int64), (self.size + 1 - Q - 1) // Q)
        self.need = self.size + 1 - Q - Q * self.edits
        self.shift = max(1, int(self.edits.max(initial=0)).bit_length())  # bands of 2 << shift diagonals, each begins in the middle of the last
        hashes = [gram_hashes(t) for t in self.text] or [np.zeros(0, np.uint64)]
        h = np.concatenate(hashes)
        order = np.argsort(h, kind="stable")
        self.hash = h[order]
        self.segment = np.repeat(np.arange(len(self.text)), [len(x) for x in hashes] if self.text else [])[order].astype(np.int64)
        self.offset = np.concatenate([np.arange(len(x)) for x in hashes])[order]
        # entries of one hash are in the order of their segments: a range of segments is a range of them
        self.name = np.cumsum(np.concatenate([[0], (self.hash[1:] != self.hash[:-1]).astype(np.int64)])[: len(h)])
        self.key = self.name * len(self.text) + self.segment
        self.bitmap = np.zeros(1 << BITS, bool)
        self.bitmap[(self.hash >> np.uint64(64 - BITS)).astype(np.int64)] = True

    def candidates(self, points: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Text, segment and first diagonal (relative to the text) of each band that reaches its number. The hits of a band lie within
        reach places of where it begins, so places are taken in stretches of about HITS hits; each settles the bands that begin in it. With
        the places in reach a stretch may have over MOST hits, and is settled for one range of segments after the other."""
        h = gram_hashes(points)
        at = np.flatnonzero(self.bitmap[(h >> np.uint64(64 - BITS)).astype(np.int64)])
        text = np.searchsorted(offs, at, side="right") - 1
        inside = at + Q <= offs[text + 1]
        at, text = at[inside], text[inside]
        lo = np.searchsorted(self.hash, h[at])
        many = np.searchsorted(self.hash, h[at], side="right") - lo
        at, text, lo, many = (x[many > 0] for x in (at, text, lo, many))
        if not len(at):
            return at, at, at
        reach = int(self.size.max()) + (4 << self.shift)
        part = np.cumsum(many) // HITS
        edge = at[np.flatnonzero(np.concatenate([[True], part[1:] != part[:-1]]))]
        edge = np.concatenate([[0], edge[1:], [len(points)]])
        out = []
        for a, z in zip(edge[:-1], edge[1:]):
            own = slice(np.searchsorted(at, a), np.searchsorted(at, z + reach))
            name = self.name[lo[own]] * len(self.text)
            todo = [(0, len(self.text))]
            while todo:
                s, e = todo.pop()
                first = np.searchsorted(self.key, name + s)
                count = np.searchsorted(self.key, name + e) - first
                if count.sum() > MOST and e - s > 1:
                    todo += [((s + e) // 2, e), (s, (s + e) // 2)]
                    continue
                live = count > 0
                out.append(self._bands(at[own][live], text[own][live], first[live], count[live], offs, a, z))
        return tuple(np.concatenate(x) for x in zip(*out))

    def _bands(self, at, text, lo, many, offs, a, z):
        which = np.repeat(np.arange(len(at)), many)
        entry = np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many) + np.repeat(lo, many)
        begin = offs[text[which]]
        half = (at[which] - begin - self.offset[entry]) >> self.shift
        pair, rank = np.unique(text[which] * len(self.text) + self.segment[entry], return_inverse=True)
        key, count = np.unique((rank << WIDE) + half + MIDDLE, return_counts=True)  # hits by half band
        both = count + np.where(np.append(key[1:], -1) == key + 1, np.append(count[1:], 0), 0)
        # a band is a half and the next one; one that begins before the first hit's half holds no more
        pair, half = pair[key >> WIDE], (key & ((1 << WIDE) - 1)) - MIDDLE
        text, segment = pair // len(self.text), pair % len(self.text)
        starts = np.maximum(offs[text], offs[text] + (half << self.shift))
        ok = (both >= self.need[segment]) & (starts >= a) & (starts < z)
        return text[ok], segment[ok], half[ok] << self.shift

    def align(self, points: np.ndarray, offs: np.ndarray, text: np.ndarray, segment: np.ndarray, diagonal: np.ndarray):
        """Edits, start and end in the text of the best alignment of each candidate in its band."""
        out = np.zeros((3, len(text)), np.int64)
        for k in range(0, len(text), 512):
            part = slice(k, k + 512)
            out[:, part] = self._align(points, offs, text[part], segment[part], diagonal[part])
        return out

    def _align(self, points, offs, text, segment, diagonal):
        slack = int(self.edits[segment].max(initial=0))
        width = (2 << self.shift) + 2 * slack
        size = self.size[segment]
        rows = int(size.max())
        pattern = np.full((len(text), rows), 0xFFFFFFFE, np.uint32)
        for i, s in enumerate(segment.tolist()):
            pattern[i, : self.size[s]] = self.text[s]
        first = diagonal - slack  # column 0 of row 0
        column = first[:, None] + np.arange(width + rows)
        inside = (column >= 0) & (column < np.diff(offs)[text][:, None])
        window = np.where(inside, points[np.where(inside, column + offs[text][:, None], 0)], 0xFFFFFFFF) if len(points) else np.full(column.shape, 0xFFFFFFFF)
        one, steps = 1 << 24, np.arange(width) << 24
        now = np.tile(np.arange(width), (len(text), 1))  # edits << 24 | column of the start
        best = np.full(len(text), 1 << 60)
        end = np.zeros(len(text), np.int64)
        for r in range(rows):
            cost = np.where(window[:, r : r + width] == pattern[:, r : r + 1], 0, one)
            moved = now + cost
            moved[:, :-1] = np.minimum(moved[:, :-1], now[:, 1:] + one)
            now = np.minimum.accumulate(moved - steps, axis=1) + steps
            done = np.flatnonzero(size == r + 1)
            if len(done):
                low = now[done].argmin(axis=1)
                best[done], end[done] = now[done, low], low + r + 1
        return best >> 24, np.maximum(0, first + (best & (one - 1))), np.minimum(first + end, np.diff(offs)[text])


    def matches(self, column):
        """For ranges of rows of an Arrow text column: (row, item) to start, end, segments and fewest edits."""
        data, offs = text_bytes(column)
        for i, j in row_chunks(offs):
            points, mine, place = folded(data[offs[i] : offs[j]].tobytes(), offs[i : j + 1] - offs[i])
            text, seg, diagonal = self.candidates(points, mine)
            edits, start, end = self.align(points, mine, text, seg, diagonal)
            found: dict[tuple[int, int], list] = {}
            for t, s, e, a, b in zip(text.tolist(), seg.tolist(), edits.tolist(), start.tolist(), end.tolist()):
                if e <= self.edits[s] and a < b:
                    a, b = int(place[mine[t] + a]), int(place[mine[t] + b - 1]) + 1
                    for item in set(self.item[s]):
                        one = found.setdefault((i + t, item), [a, b, {}, e])
                        one[0], one[1], one[3] = min(one[0], a), max(one[1], b), min(one[3], e)
                        one[2][s] = self.item[s].count(item)
            yield found


def indexes(benchmark: DataFrame, rate: float, segment: int):
    """Broadcast indexes of slices of the benchmark, each of about SLICE characters at most."""
    total = benchmark.agg(F.sum(F.length("text"))).first()[0] or 0
    slices = max(1, -(-total // SLICE))
    for k in range(slices):
        rows = benchmark.filter(F.pmod(F.xxhash64("text"), F.lit(slices)) == k).select("item_id", "text").orderBy("item_id", "text").collect()
        yield benchmark.sparkSession.sparkContext.broadcast(Index([(r.item_id, r.text) for r in rows], rate, segment))


def passages(docs: DataFrame, benchmark: DataFrame, rate: float = RATE, segment: int = SEGMENT) -> DataFrame:
    """doc_id, item_id, start, end (code points of the text that the matches of the item's segments span), segments, edits (of the best
    one). docs: doc_id, text; benchmark: item_id, text."""

    def finder(held):
        def run(batches):
            for batch in batches:
                ids = batch.column("doc_id").to_pylist()
                for found in held.value.matches(batch.column("text")):
                    rows = [(ids[t], item, a, b, sum(s.values()), e) for (t, item), (a, b, s, e) in sorted(found.items(), key=lambda x: x[0])]
                    columns = list(zip(*rows)) or [[]] * 6
                    yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names=["doc_id", "item_id", "start", "end", "segments", "edits"])

        return run

    parts = [docs.select("doc_id", "text").mapInArrow(finder(held), "doc_id long, item_id long, start long, end long, segments long, edits long") for held in indexes(benchmark, rate, segment)]
    out = parts[0]
    for part in parts[1:]:
        out = out.union(part)
    return out


def without(docs: DataFrame, benchmark: DataFrame, rate: float = RATE, segment: int = SEGMENT) -> DataFrame:
    """The rows of docs that hold no passage of the benchmark; each slice of it is one more pass over what is left."""

    def keeper(held):
        def run(batches):
            for batch in batches:
                keep = np.ones(batch.num_rows, bool)
                for found in held.value.matches(batch.column("text")):
                    keep[[t for t, _ in found]] = False
                yield batch.filter(pa.array(keep))

        return run

    for held in indexes(benchmark, rate, segment):
        docs = docs.mapInArrow(handed_back(keeper(held)), docs.schema)
    return docs
