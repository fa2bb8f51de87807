"""Token ids as wavelet matrices, one file for each shard.

Documents are range-partitioned and sorted by doc_id, encoded, and cut into shards. A shard's ids are kept as bit-planes, the
highest bit first; before each next plane the ids are partitioned stably by the bit, so that rank and select on the planes give
any token, the number of a token's occurrences up to a place and the place of its k-th occurrence. Planes are compressed in blocks
of 2^16 bits, so a look-up unpacks one block of each plane, and the ones among every 512 bits are kept beside them. The shard's
documents, and their lengths, are in the same file.

Defined results: a null or empty text is the end id alone; documents with one doc_id follow each other by their text; a null
doc_id comes first.
"""

from __future__ import annotations

import os
import re
import struct
import zlib

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window
from pyspark.sql import functions as F

from .common import partitions, row_chunks, text_bytes
from .exchange import expand, join_parts, split_parts, squeeze

SHARD = 1 << 21
#: words in each of two generations of the cache, and half as many as letters of words
CACHE = 250_000
#: bits between two ranks that a file keeps, and bytes of a block of a plane (whole steps)
STEP = 512
BLOCK = 1 << 13


class Plane:
    """Packed bits in blocks, each compressed by itself, so that a look-up unpacks one block; the block last used is kept."""

    def __init__(self, blocks: list[bytes]):
        self.blocks, self.held = blocks, (-1, np.zeros(0, np.uint8))

    @staticmethod
    def build(packed: np.ndarray) -> Plane:
        pack = zstandard.ZstdCompressor(level=1)
        return Plane([pack.compress(packed[k : k + BLOCK].tobytes()) for k in range(0, len(packed), BLOCK)])

    def block(self, k: int) -> np.ndarray:
        if self.held[0] != k:
            self.held = k, np.frombuffer(zstandard.ZstdDecompressor().decompress(self.blocks[k]), np.uint8)
        return self.held[1]

    def part(self, start: int, stop: int) -> np.ndarray:
        """Bytes of one block; start and stop are counted in the plane."""
        if start >= stop:
            return np.zeros(0, np.uint8)
        base = start // BLOCK * BLOCK
        return self.block(start // BLOCK)[start - base : stop - base]

    def bits(self, n: int) -> np.ndarray:
        unpack = zstandard.ZstdDecompressor()
        return np.unpackbits(np.frombuffer(b"".join(map(unpack.decompress, self.blocks)), np.uint8), count=n, bitorder="little").astype(bool)


class WaveletMatrix:
    """Ids with access, rank and select; made by build, or read from to_bytes."""

    def __init__(self, n: int, planes: list[Plane], counts: list[np.ndarray]):
        """planes: the highest first; counts: the ones among each STEP bits of a plane."""
        self.n, self.planes, self.counts = n, planes, counts
        self.ranks = [np.concatenate([[0], np.cumsum(c, dtype=np.int64)]) for c in counts]
        self.zeros = [n - int(r[-1]) for r in self.ranks]

    @staticmethod
    def build(ids: np.ndarray) -> WaveletMatrix:
        levels = max(1, int(ids.max(initial=0)).bit_length())
        now = ids.astype(np.uint16 if levels <= 16 else np.uint32)
        planes, counts = [], []
        for k in range(levels - 1, -1, -1):
            bit = (now & now.dtype.type(1 << k)).astype(bool)
            packed = np.packbits(bit, bitorder="little")
            planes.append(Plane.build(packed))
            full = np.concatenate([packed, np.zeros(-len(packed) % (STEP // 8), np.uint8)]).view(np.uint64)
            counts.append(np.bitwise_count(full).reshape(-1, STEP // 64).sum(axis=1, dtype=np.int64))
            now = np.concatenate([now[~bit], now[bit]])
        return WaveletMatrix(len(ids), planes, counts)

    def ids(self) -> np.ndarray:
        """All ids in order: the partitions undone, from the last plane on."""
        now = np.zeros(self.n, np.uint16 if len(self.planes) <= 16 else np.uint32)
        for k, (plane, zeros) in enumerate(zip(self.planes[::-1], self.zeros[::-1])):
            bit = plane.bits(self.n)
            out = np.empty_like(now)
            out[~bit] = now[:zeros]
            out[bit] = now[zeros:] | now.dtype.type(1 << k)
            now = out
        return now

    def _bit(self, level: int, i: int) -> int:
        return int(self.planes[level].part(i >> 3, (i >> 3) + 1)[0]) >> (i & 7) & 1

    def _rank1(self, level: int, i: int) -> int:
        step = i // STEP
        part = self.planes[level].part(step * (STEP // 8), (i + 7) >> 3)
        count = int(np.bitwise_count(part).sum())
        if i & 7 and len(part):
            count -= (int(part[-1]) >> (i & 7)).bit_count()
        return int(self.ranks[level][step]) + count

    def access(self, i: int) -> int:
        value = 0
        for level in range(len(self.planes)):
            bit = self._bit(level, i)
            one = self._rank1(level, i)
            i = self.zeros[level] + one if bit else i - one
            value = value << 1 | bit
        return value

    def _walk(self, token: int, i: int) -> tuple[int, int]:
        start = 0
        for level in range(len(self.planes)):
            a, b = self._rank1(level, start), self._rank1(level, i)
            if token >> (len(self.planes) - 1 - level) & 1:
                start, i = self.zeros[level] + a, self.zeros[level] + b
            else:
                start, i = start - a, i - b
        return start, i

    def rank(self, token: int, i: int) -> int:
        """Occurrences of token among the first i ids."""
        if token >> len(self.planes):
            return 0
        a, b = self._walk(token, i)
        return b - a

    def count(self, token: int) -> int:
        return self.rank(token, self.n)

    def select(self, token: int, k: int) -> int:
        """Place of the k-th occurrence of token, from 0; -1 if there are fewer."""
        if token >> len(self.planes) or k >= self.count(token):
            return -1
        i = self._walk(token, 0)[0] + k
        for level in range(len(self.planes) - 1, -1, -1):
            one = token >> (len(self.planes) - 1 - level) & 1
            want = i - self.zeros[level] if one else i
            ranks = self.ranks[level] if one else np.arange(len(self.ranks[level])) * STEP - self.ranks[level]
            step = int(np.searchsorted(ranks, want, side="right")) - 1
            bits = np.unpackbits(self.planes[level].part(step * (STEP // 8), (step + 1) * (STEP // 8)), bitorder="little")
            i = step * STEP + int(np.flatnonzero(bits == one)[want - int(ranks[step])])
        return i

    def to_bytes(self) -> bytes:
        return join_parts(self.n.to_bytes(8, "little"), *(join_parts(squeeze(c), *p.blocks) for c, p in zip(self.counts, self.planes)))

    @staticmethod
    def from_bytes(raw: bytes) -> WaveletMatrix:
        n, *planes = split_parts(raw)
        parts = [split_parts(p) for p in planes]
        return WaveletMatrix(int.from_bytes(n, "little"), [Plane(p[1:]) for p in parts], [expand(p[0]).astype(np.int64) for p in parts])


def byte_letters() -> list[str]:
    """The character by which a byte-level vocabulary writes each byte: printable ones as they are, the others from 256 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = iter(range(256, 512))
    return [chr(b) if b in plain else chr(next(others)) for b in range(256)]


class Encoder:
    """The tokenizers library behind caches. A text is cut before each single space between other characters, where the tokenizer's
    pattern always starts a token; a text with white space next to a space, or with an added token, goes to the library as it is. A word of Latin letters
    with other marks after it is cut between the two, where the pattern ends a token too, and its letters go to the library's model."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.added = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.model = self.tokenizer.model
        self.type = np.uint16 if self.tokenizer.get_vocab_size() <= 1 << 16 else np.uint32
        self.words, self.old_words = {}, {}
        self.stems, self.old_stems = {}, {}
        self.marks: dict[str, bytes] = {"": b""}
        letters, marks = "([A-Za-zÀ-ÖØ-öø-ÿ]+)", r"([!-&(-/:-@\[-`{-~]*)"
        self.shape = re.compile(rf"{letters}{marks}(?:\n{letters}{marks})?").fullmatch
        self.letters = byte_letters()
        self.line = self.whole("\n")

    def whole(self, text: str) -> bytes:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, self.type).tobytes()

    def stem(self, s: str) -> bytes:
        """Ids of letters, with or without a space before them."""
        got = self.stems.get(s)
        if got is None:
            got = self.old_stems.get(s)
            if got is None:
                ids = [t.id for t in self.model.tokenize("".join(map(self.letters.__getitem__, s.encode())))]
                got = struct.pack(f"<{len(ids)}{'H' if self.type is np.uint16 else 'I'}", *ids)
            if len(self.stems) >= 2 * CACHE:
                self.old_stems, self.stems = self.stems, {}
            self.stems[s] = got
        return got

    def mark(self, s: str) -> bytes:
        got = self.marks.get(s)
        if got is None:
            if len(self.marks) >= CACHE:
                self.marks = {"": b""}
            got = self.marks[s] = self.whole(s)
        return got

    def learn(self, words: list[str]) -> None:
        """Ids of each word with a space before it; False: the text must not be cut there."""
        if len(self.words) + len(words) > CACHE:
            self.old_words, self.words = self.words, {}
        for w in words:
            got = self.old_words.get(w)
            if got is None:
                m = self.shape(w)
                if m:
                    stem, mark, second, end = m.groups()
                    got = self.stem(" " + stem) + self.mark(mark)
                    if second:
                        got += self.line + self.stem(second) + self.mark(end)
                else:
                    got = False if not w or w[0].isspace() or w[-1].isspace() else self.whole(" " + w)
            self.words[w] = got

    def encode(self, text: str) -> bytes:
        parts = text.split(" ")
        head, parts[0] = parts[0], "."
        if head[-1:].isspace() or (not head and len(parts) > 1) or any(t in text for t in self.added):
            return self.whole(text)
        got = list(map(self.words.get, parts))
        if None in got:
            self.learn([w for w, g in zip(parts, got) if g is None])
            known, older = self.words, self.old_words
            got = [g if g is not None else known[w] if w in known else older[w] for w, g in zip(parts, got)]
        if False in got:
            return self.whole(text)
        got[0] = self.whole(head) if head else b""
        return b"".join(got)


_ENCODERS: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    if path not in _ENCODERS:
        _ENCODERS[path] = Encoder(path)
    return _ENCODERS[path]


def shard_bytes(doc_ids: list, sizes: np.ndarray, ids: np.ndarray) -> bytes:
    known = np.array([i is not None for i in doc_ids])
    values = np.array([0 if i is None else i for i in doc_ids], np.int64)
    return join_parts(squeeze(values.view(np.uint64)), np.packbits(known).tobytes(), squeeze(sizes), WaveletMatrix.build(ids).to_bytes())


def open_shard(raw: bytes) -> tuple[list, np.ndarray, WaveletMatrix]:
    """doc_ids, numbers of ids, and the matrix, of one file's bytes."""
    values, known, sizes, matrix = split_parts(raw)
    values, sizes = expand(values).view(np.int64), expand(sizes).astype(np.int64)
    known = np.unpackbits(np.frombuffer(known, np.uint8), count=len(values)).astype(bool)
    return [int(v) if k else None for v, k in zip(values, known)], sizes, WaveletMatrix.from_bytes(matrix)


def write(docs: DataFrame, path: str, tokenizer: str, end_id: int = 0) -> None:
    """Shards of docs (doc_id, text) below path, one file each, in the order of part and shard: the ids of each text and end_id."""
    # the first letters, so that the rows of one doc_id are not one task; they are in the order of the texts
    ordered = docs.select("doc_id", "text").repartitionByRange(partitions(docs.sparkSession), "doc_id", F.substring("text", 1, 64)).sortWithinPartitions("doc_id", "text")

    def run(batches):
        part, shard = TaskContext.get().partitionId(), 0
        enc = encoder(tokenizer)
        end = enc.type(end_id).tobytes()
        keys, rows, held = [], [], 0

        def full():
            nonlocal keys, rows, held, shard
            sizes = np.array([len(r) // len(end) for r in rows], np.int64)
            raw = shard_bytes(keys, sizes, np.frombuffer(b"".join(rows), enc.type))
            out = pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([shard], pa.int32()), pa.array([int(sizes.sum())], pa.int64()), pa.array([raw], pa.binary())], names=["part", "shard", "n_ids", "body"])
            keys, rows, held, shard = [], [], 0, shard + 1
            return out

        for batch in batches:
            _, offs = text_bytes(batch.column("text"))
            for i, j in row_chunks(offs):
                texts = [t or "" for t in batch.column("text").slice(i, j - i).to_pylist()]
                for key, ids in zip(batch.column("doc_id").slice(i, j - i).to_pylist(), map(enc.encode, texts)):
                    keys.append(key)
                    rows.append(ids + end)
                    held += len(rows[-1]) // len(end)
                    if held >= SHARD:
                        yield full()
        if rows:
            yield full()

    ordered.mapInArrow(run, "part int, shard int, n_ids long, body binary").write.option("maxRecordsPerFile", 1).parquet(path)


def read_back(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of all documents, from the files."""
    shards = spark.read.parquet(path)

    def run(batches):
        for batch in batches:
            for part, shard, raw in zip(*(batch.column(c).to_pylist() for c in ("part", "shard", "body"))):
                keys, sizes, matrix = open_shard(raw)
                ids = matrix.ids().astype("<u4")
                ends = np.cumsum(sizes)
                crc = [zlib.crc32(ids[e - n : e].tobytes()) for e, n in zip(ends.tolist(), sizes.tolist())]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([part] * len(keys), pa.int32()), pa.array([shard] * len(keys), pa.int32()), pa.array(keys, pa.int64()), pa.array(ends - sizes), pa.array(sizes), pa.array(crc, pa.int64())],
                    names=["part", "shard", "doc_id", "local", "n_tokens", "ids_crc32"],
                )

    rows = shards.select("part", "shard", "body").mapInArrow(run, "part int, shard int, doc_id long, local long, n_tokens long, ids_crc32 long")
    # one small row for each file; first within parts, then over the parts
    within = shards.select("part", "shard", "n_ids").withColumn("before", F.sum("n_ids").over(Window.partitionBy("part").orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)))
    parts = shards.groupBy("part").agg(F.sum("n_ids").alias("n")).withColumn("base", F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)))
    base = within.join(parts, "part").selectExpr("part", "shard", "coalesce(before, 0) + coalesce(base, 0) base")
    return rows.join(base, ["part", "shard"]).selectExpr("doc_id", "base + local start", "n_tokens", "ids_crc32")
