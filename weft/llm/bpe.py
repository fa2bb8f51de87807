"""Byte-level BPE encoding and decoding.

Pre-tokenisation without a regex: each code point gets a class from a table, look-ahead is folded into the class by array
comparisons, and an automaton of seven states finds the token starts. The automaton runs as an associative scan: the transition
functions of a block of characters are composed for all blocks at once, block functions are then chained, and a second pass
fills in the states. The slices go to a cache of merged pieces; unseen pieces are merged together, a pair of each per round.

Defined results: a null text counts as empty and has no tokens; repeated rows are encoded each for itself; columns other than
the text are passed on as they are.
"""

from __future__ import annotations

import base64
import hashlib
import heapq
import sys
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from .common import handed_back, row_chunks, text_bytes

# classes of characters
END, LETTER, NUMBER, OTHER, GLUE, SPACE, SHORT2, SHORT3 = range(8)
# states: what the previous character left open
CLOSED, GLUED, IN_LETTERS, IN_NUMBERS, IN_OTHERS, ONE_MORE, TWO_MORE = range(7)
#: White_Space of Unicode (fixed values)
WHITE = [*range(9, 14), 32, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]
LONG = 48
BLOCK = 512
#: bytes of text that are encoded at once; a numpy pass takes many times that
CHUNK = 1 << 19
#: pieces in each of the two generations of the cache
CACHE = 100_000


def _automaton() -> tuple[np.ndarray, np.ndarray]:
    """Next state and whether a token starts, at [class * 8 + state]."""
    step, start = np.zeros((8, 8), np.uint8), np.zeros((8, 8), bool)
    opens = {LETTER: IN_LETTERS, NUMBER: IN_NUMBERS, OTHER: IN_OTHERS}
    for state in range(7):
        for kind in range(8):
            if state in (ONE_MORE, TWO_MORE) and kind not in (END, GLUE, SPACE):
                to, new = (CLOSED if state == ONE_MORE else ONE_MORE), False
            elif kind == GLUE:
                to, new = GLUED, True
            elif kind in (END, SPACE):
                to, new = CLOSED, kind == END  # starts inside white space are found by comparison
            elif kind in (SHORT2, SHORT3):
                inside = state in (GLUED, IN_OTHERS)
                to, new = (IN_OTHERS, state != GLUED and state != IN_OTHERS) if inside else (ONE_MORE if kind == SHORT2 else TWO_MORE, True)
            else:
                to, new = opens[kind], state not in (GLUED, opens[kind])
            step[kind, state], start[kind, state] = to, new
    return step.ravel(), start.ravel()


STEP, START = _automaton()
_CLASSES: list[np.ndarray] = []


def classes() -> np.ndarray:
    """Class of every code point; made once in a process."""
    if not _CLASSES:
        kinds = {"L": LETTER, "N": NUMBER}
        table = np.fromiter((kinds.get(unicodedata.category(chr(c))[0], OTHER) for c in range(sys.maxunicode + 1)), np.uint8, sys.maxunicode + 1)
        table[WHITE] = SPACE
        _CLASSES.append(table)
    return _CLASSES[0]


def scan(kinds: np.ndarray) -> np.ndarray:
    """State before each character: an associative scan over transition functions, by blocks."""
    n = len(kinds)
    width = min(BLOCK, max(1, int(np.sqrt(n))))
    rows = -(-n // width)
    grid = np.zeros(rows * width, np.uint8)
    grid[:n] = kinds
    grid = np.ascontiguousarray(grid.reshape(rows, width).T) << 3  # one line for each place within the blocks
    made = np.tile(np.arange(8, dtype=np.uint8), (rows, 1))
    for line in grid:
        made = STEP[line[:, None] | made]
    first, state = np.empty(rows, np.uint8), CLOSED
    for i, f in enumerate(made.tolist()):
        first[i], state = state, f[state]
    out = np.empty((width, rows), np.uint8)
    for i, line in enumerate(grid):
        out[i] = first
        first = STEP[line | first]
    return out.T.ravel()[:n]


def token_starts(data: bytes, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Byte offset of each token of the texts that lie one after the other in data, and the number of tokens of each text."""
    raw = np.frombuffer(data, np.uint8)
    points = np.frombuffer(data.decode("utf-8").encode("utf-32-le"), np.uint32)
    lead = (raw & 0xC0) != 0x80
    place = np.flatnonzero(lead)  # byte offset of each code point
    at = np.concatenate([[0], np.cumsum(lead)])[offs]  # code-point offset of each text
    n, texts = len(points), len(offs) - 1
    # a closing END after each text; where[i]: place of code point i among the classes
    which = np.repeat(np.arange(texts), np.diff(at))
    where = np.arange(n) + which
    kinds = np.zeros(n + texts, np.uint8)
    kinds[where] = classes()[points]
    full = np.zeros(n + texts + 3, np.uint32)
    full[where] = points
    white = kinds == SPACE
    solid = ~white & (kinds != END)
    after = np.append(solid[1:], False)
    last = white & after  # last white space before something else
    new_white = white & (last | ~np.concatenate([[False], white[:-1]]))
    kinds[last & (full[:-3] == 32)] = GLUE
    tick = np.flatnonzero(full[:-3] == 39)
    if len(tick):
        a, b = full[tick + 1], full[tick + 2]
        kinds[tick[np.isin(a, [ord(c) for c in "stmd"])]] = SHORT2
        two = ((a == ord("r")) & (b == ord("e"))) | ((a == ord("v")) & (b == ord("e"))) | ((a == ord("l")) & (b == ord("l")))
        kinds[tick[two]] = SHORT3
    new = START[(kinds << 3) | scan(kinds)] | (new_white & (kinds == SPACE))
    new = new[where]
    return place[new], np.bincount(which[new], minlength=texts)


class Merger:
    """Ranks of a vocabulary, and the pieces merged so far in this process."""

    def __init__(self, path: str):
        with open(path, "rb") as f:
            rank = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.tokens = [b""] * (max(rank.values()) + 1)
        for token, i in rank.items():
            self.tokens[i] = token
        self.decimal = [str(i).encode() for i in range(len(self.tokens))]
        self.single = np.array([rank[bytes([b])] for b in range(256)], np.int64)
        pairs = {}
        for token, i in rank.items():
            for cut in range(1, len(token)):
                a, b = rank.get(token[:cut]), rank.get(token[cut:])
                if a is not None and b is not None:
                    pairs[a << 32 | b] = i
        self.pairs = pairs
        self.keys = np.array(sorted(pairs), np.int64)
        self.merged = np.array([pairs[k] for k in self.keys.tolist()], np.int64)
        # open addressing, so that a look-up is a few array reads
        self.bits = max(4, int(len(pairs) * 4 - 1).bit_length())
        size = 1 << self.bits
        self.slot_key, self.slot_id = np.full(size, -1, np.int64), np.zeros(size, np.int64)
        todo, probe = np.arange(len(self.keys)), 0
        while len(todo):
            slot = (self._slot(self.keys[todo]) + probe) & (size - 1)
            free = self.slot_key[slot] < 0
            _, once = np.unique(np.where(free, slot, -1), return_index=True)
            take = once[free[once]]
            self.slot_key[slot[take]], self.slot_id[slot[take]] = self.keys[todo[take]], self.merged[todo[take]]
            left = np.ones(len(todo), bool)
            left[take] = False
            todo, probe = todo[left], probe + 1
        self.probes = probe
        self.young: dict[bytes, bytes] = {}
        self.old: dict[bytes, bytes] = {}

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)).astype(np.int64)

    def look(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Rank of the token that a pair makes; a large number where there is none."""
        key = a << 32 | b
        out = np.full(len(key), 1 << 40, np.int64)
        todo, slot = np.arange(len(key)), self._slot(key)
        for _ in range(self.probes):
            found = self.slot_key[slot]
            hit = found == key[todo]
            out[todo[hit]] = self.slot_id[slot[hit]]
            go = ~hit & (found >= 0)
            todo, slot = todo[go], (slot[go] + 1) & ((1 << self.bits) - 1)
            if not len(todo):
                break
        return out

    def long(self, piece: bytes) -> list[int]:
        """One long piece by a heap of pairs."""
        ids = self.single[np.frombuffer(piece, np.uint8)].tolist()
        n = len(ids)
        right, left = list(range(1, n + 1)), list(range(-1, n - 1))
        heap = [(r, i, ids[i], ids[i + 1]) for i in range(n - 1) if (r := self.pairs.get(ids[i] << 32 | ids[i + 1])) is not None]
        heapq.heapify(heap)
        while heap:
            r, i, a, b = heapq.heappop(heap)
            j = right[i]
            if ids[i] != a or j >= n or ids[j] != b:
                continue
            ids[i], ids[j], right[i] = r, -1, right[j]
            if right[j] < n:
                left[right[j]] = i
            for x, y in ((left[i], i), (i, right[i])):
                if x >= 0 and y < n and (k := self.pairs.get(ids[x] << 32 | ids[y])) is not None:
                    heapq.heappush(heap, (k, x, ids[x], ids[y]))
        return [i for i in ids if i >= 0]

    def merge(self, pieces: list[bytes]) -> list[bytes]:
        """Ids of each piece as little-endian 32-bit numbers. In each round every unfinished piece merges its best pair, the leftmost of equals."""
        out = [b""] * len(pieces)
        short = []
        for i, p in enumerate(pieces):
            if len(p) > LONG:
                out[i] = np.array(self.long(p), "<u4").tobytes()
            elif p:
                short.append(i)
        if not short:
            return out
        size = np.array([len(pieces[i]) for i in short], np.int64)
        ids = self.single[np.frombuffer(b"".join(pieces[i] for i in short), np.uint8)]
        owner = np.array(short, np.int64)
        rank = np.append(self.look(ids[:-1], ids[1:]), 1 << 40)
        rank[np.cumsum(size) - 1] = 1 << 40
        while len(owner):
            ends = np.cumsum(size)
            begins = ends - size
            best = np.minimum.reduceat(rank, begins)
            live = best < 1 << 40
            done = ~live
            if done.any():
                for k in np.flatnonzero(done).tolist():
                    out[owner[k]] = ids[begins[k] : ends[k]].astype("<u4").tobytes()
                keep = np.repeat(live, size)
                ids, rank, owner, size, best = ids[keep], rank[keep], owner[live], size[live], best[live]
                if not len(owner):
                    break
                ends = np.cumsum(size)
                begins = ends - size
            hit = np.flatnonzero(rank == np.repeat(best, size))
            word = np.searchsorted(ends, hit, side="right")
            _, lead = np.unique(word, return_index=True)
            at = hit[lead]
            ids[at] = best
            keep = np.ones(len(ids), bool)
            keep[at + 1] = False
            moved = at - np.arange(len(at))
            ids, rank = ids[keep], rank[keep]
            size = size - 1
            ends = np.cumsum(size)
            begins = ends - size
            inner = moved > begins
            rank[moved[inner] - 1] = self.look(ids[moved[inner] - 1], ids[moved[inner]])
            outer = moved < ends - 1
            rank[moved[outer]] = self.look(ids[moved[outer]], ids[moved[outer] + 1])
            rank[ends - 1] = 1 << 40
        return out

    def ids_of(self, pieces: list[bytes]) -> list[bytes]:
        """Through the cache; what it lacks is merged at once."""
        young, old = self.young, self.old
        got = [young.get(p) for p in pieces]
        if None in got:
            missing = dict.fromkeys(p for p, g in zip(pieces, got) if g is None)
            new = [p for p in missing if p not in old]
            missing.update((p, old[p]) for p in missing if p in old)
            missing.update(zip(new, self.merge(new)))
            if len(young) + len(missing) > CACHE:
                self.old = young
                self.young = young = {}
            young.update(missing)
            got = [missing[p] if g is None else g for p, g in zip(pieces, got)]
        return got


_MERGERS: dict[str, Merger] = {}


def merger(path: str) -> Merger:
    if path not in _MERGERS:
        _MERGERS[path] = Merger(path)
    return _MERGERS[path]


def encode_column(column, path: str) -> Iterator[tuple[int, int, list[bytes]]]:
    """For ranges of rows of an Arrow text column: the ids of each text as little-endian 32-bit numbers."""
    m = merger(path)
    data, offs = text_bytes(column)
    for i, j in row_chunks(offs, CHUNK):
        part = data[offs[i] : offs[j]].tobytes()
        own = offs[i : j + 1] - offs[i]
        starts, count = token_starts(part, own)
        cuts = starts.tolist()
        cuts.append(len(part))
        got = m.ids_of([part[a:b] for a, b in zip(cuts, cuts[1:])])
        bounds = np.concatenate([[0], np.cumsum(count)]).tolist()
        yield i, j, [b"".join(got[a:b]) for a, b in zip(bounds, bounds[1:])]


def forgotten(run):
    """A function for mapInArrow that leaves no vocabulary and no cache behind in its worker, which later tasks of any kind use again."""

    def wrapped(batches):
        try:
            yield from run(batches)
        finally:
            _MERGERS.clear()

    return wrapped


def token_offsets(ids: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Byte offset at which each token of a text starts."""
    ends = np.cumsum(sizes[ids])
    return ends - sizes[ids]


def encode(docs: DataFrame, path: str, text: str = "text", starts: bool = True) -> DataFrame:
    """docs with token_ids and, if wanted, token_starts (byte offsets in the UTF-8 text), arrays of integers; columns of these names
    are replaced."""
    docs = docs.drop("token_ids", "token_starts")
    names = ["token_ids", "token_starts"][: 1 + starts]
    schema = T.StructType([*docs.schema.fields, *(T.StructField(n, T.ArrayType(T.IntegerType(), False)) for n in names)])

    def run(batches):
        sizes = np.array([len(t) for t in merger(path).tokens], np.int64)
        for batch in batches:
            for i, j, ids in encode_column(batch.column(text), path):
                arrays = [np.frombuffer(x, "<u4").astype(np.int32) for x in ids]
                at = pa.array(np.concatenate([[0], np.cumsum([len(a) for a in arrays])]).astype(np.int32))
                made = [arrays, [token_offsets(a, sizes) for a in arrays]] if starts else [arrays]
                lists = [pa.ListArray.from_arrays(at, pa.array(np.concatenate(m).astype(np.int32))) for m in made]
                yield pa.RecordBatch.from_arrays([*batch.slice(i, j - i).columns, *lists], names=[*batch.schema.names, *names])

    return docs.mapInArrow(handed_back(forgotten(run)), schema)


def decode(tokens: DataFrame, path: str, ids: str = "token_ids") -> DataFrame:
    """tokens with decoded: the bytes that the ids stand for (null ids: none)."""
    tokens = tokens.drop("decoded")
    schema = T.StructType([*tokens.schema.fields, T.StructField("decoded", T.BinaryType())])

    def run(batches):
        table = merger(path).tokens
        for batch in batches:
            made = [b"".join(map(table.__getitem__, row or ())) for row in batch.column(ids).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(made, pa.binary())], names=[*batch.schema.names, "decoded"])

    return tokens.mapInArrow(run, schema)


def digests(docs: DataFrame, path: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256 (decimal ids joined by commas), decoded_sha256 (the ids decoded again), by the same encoding in one pass."""

    def run(batches):
        m = merger(path)
        for batch in batches:
            keys = batch.column("doc_id")
            for i, j, ids in encode_column(batch.column("text"), path):
                rows = [np.frombuffer(x, "<u4").tolist() for x in ids]
                yield pa.RecordBatch.from_arrays(
                    [
                        keys.slice(i, j - i),
                        pa.array([len(r) for r in rows], pa.int64()),
                        pa.array([hashlib.sha256(b",".join(map(m.decimal.__getitem__, r))).hexdigest() for r in rows], pa.string()),
                        pa.array([hashlib.sha256(b"".join(map(m.tokens.__getitem__, r))).hexdigest() for r in rows], pa.string()),
                    ],
                    names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"],
                )

    return docs.select("doc_id", "text").mapInArrow(handed_back(forgotten(run)), "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
