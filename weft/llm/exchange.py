"""Packs of documents that ask all other packs about hashes of theirs.

A pack is two megabytes of documents in one row. It sends its distinct hashes, sorted, to buckets by hash; a bucket compares
what all packs sent and answers each of them; a pack meets its answers again by its number. Every pack reaches a bucket with
each distinct hash once, so a frequent string is no hot key, and the packs themselves are shuffled once and reused.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame

from .common import give_back, handed_back, partitions, row_chunks, text_bytes

PACK = 1 << 21
#: in place of a null doc_id, which comes after all others
NO_ID = np.iinfo(np.int64).max
ASKED = "bucket int, pack long, kind int, payload binary"


def squeeze(values: np.ndarray) -> bytes:
    """Numbers byte by byte, compressed: equal high bytes cost next to nothing."""
    raw = np.ascontiguousarray(values.astype("<u8")).view(np.uint8).reshape(-1, 8)
    return zstandard.ZstdCompressor(level=1).compress(len(values).to_bytes(8, "little") + raw.T.tobytes())


def expand(raw: bytes) -> np.ndarray:
    data = zstandard.ZstdDecompressor().decompress(raw)
    n = int.from_bytes(data[:8], "little")
    return np.ascontiguousarray(np.frombuffer(data, np.uint8, offset=8).reshape(8, n).T).view("<u8").ravel()


def squeeze_sorted(values: np.ndarray) -> bytes:
    return squeeze(np.diff(values.astype(np.uint64), prepend=np.uint64(0)))


def expand_sorted(raw: bytes) -> np.ndarray:
    return np.cumsum(expand(raw), dtype=np.uint64)


def join_parts(*parts: bytes) -> bytes:
    return b"".join(len(p).to_bytes(8, "little") + p for p in parts)


def split_parts(raw: bytes) -> list[bytes]:
    out, at = [], 0
    while at < len(raw):
        n = int.from_bytes(raw[at : at + 8], "little")
        out.append(raw[at + 8 : at + 8 + n])
        at += 8 + n
    return out


class Pack:
    """doc_ids, the documents' bytes laid end to end, and the rows' other columns."""

    def __init__(self, body: bytes):
        ids, offs, text, self._rest = split_parts(body)
        self.ids, self.offs = expand(ids).view(np.int64), np.cumsum(expand(offs)).astype(np.int64)
        self.data = np.frombuffer(zstandard.ZstdDecompressor().decompress(text), np.uint8)

    def rest(self) -> pa.Table:
        return pa.ipc.open_stream(zstandard.ZstdDecompressor().decompress(self._rest)).read_all()


def pack_number(task: int, n: int) -> int:
    """The n-th pack of a task. Numbers have 44 bits: 2**28 tasks, and 2**16 packs (128 GB) in each."""
    if task >> 28 or n >> 16:
        raise ValueError(f"pack {n} of task {task}")
    return task << 16 | n


def numbered(batches):
    """Pack number, batch, range of its rows, and their ids, bytes and offsets, of each pack of a task's batches."""
    task, n = TaskContext.get().partitionId(), 0
    for batch in batches:
        ids = batch.column("doc_id").cast(pa.int64()).fill_null(NO_ID).to_numpy(zero_copy_only=False)
        data, offs = text_bytes(batch.column("text"))
        for i, j in row_chunks(offs, PACK):
            yield pack_number(task, n), batch, i, j, ids[i:j], data[offs[i] : offs[j]], offs[i : j + 1] - offs[i]
            n += 1


def packs_of(docs: DataFrame) -> DataFrame:
    """pack, body: docs (doc_id, text, and any other columns) in packs. docs must give the same rows in the same order when a task runs
    again, as a table does."""

    def run(batches):
        for key, batch, i, j, ids, data, offs in numbered(batches):
            rest = batch.select([c for c in batch.schema.names if c not in ("doc_id", "text")]).slice(i, j - i)
            sink = pa.BufferOutputStream()
            with pa.ipc.new_stream(sink, rest.schema) as stream:
                stream.write_batch(rest)
            body = join_parts(squeeze(ids.view(np.uint64)), squeeze(np.diff(offs, prepend=0)), zstandard.ZstdCompressor(level=3).compress(data.tobytes()), zstandard.ZstdCompressor(level=1).compress(sink.getvalue()))
            yield pa.RecordBatch.from_arrays([pa.array([key], pa.int64()), pa.array([body], pa.binary())], names=["pack", "body"])

    return docs.mapInArrow(handed_back(run), "pack long, body binary")


def packed(docs: DataFrame) -> DataFrame:
    """packs_of(docs), dealt out by pack. Every use of the result reuses one shuffle."""
    return packs_of(docs).repartition(partitions(docs.sparkSession), "pack")


def ask(packs: DataFrame, question: Callable[[Pack], Iterator[tuple[int, int, bytes]]]) -> DataFrame:
    """question gives bucket, kind and payload."""

    def run(batches):
        for batch in batches:
            for key, body in zip(batch.column("pack").to_pylist(), batch.column("body").to_pylist()):
                yield from rows_of(key, question(Pack(body)))

    return packs.mapInArrow(handed_back(run), ASKED)


def ask_again(packs: DataFrame, answers: DataFrame, question: Callable[[Pack, dict], Iterator[tuple[int, int, bytes]]]) -> DataFrame:
    """As ask, with the answers that a pack has got so far."""

    def run(key, own, got):
        if own.num_rows:
            yield from rows_of(key[0].as_py(), question(Pack(own.column("body")[0].as_py()), by_kind(got)))

    return packs.groupBy("pack").cogroup(answers.groupBy("pack")).applyInArrow(lambda key, own, got: pa.Table.from_batches(list(run(key, own, got)), schema=pa.schema([("bucket", pa.int32()), ("pack", pa.int64()), ("kind", pa.int32()), ("payload", pa.binary())])), ASKED)


def rows_of(pack: int, rows) -> Iterator[pa.RecordBatch]:
    rows = list(rows)
    yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int32()), pa.array([pack] * len(rows), pa.int64()), pa.array([r[1] for r in rows], pa.int32()), pa.array([r[2] for r in rows], pa.binary())], names=["bucket", "pack", "kind", "payload"])


def by_kind(got: pa.Table) -> dict[tuple[int, int], bytes]:
    """(kind, bucket) to payload."""
    return {(k, b): p for k, b, p in zip(got.column("kind").to_pylist(), got.column("bucket").to_pylist(), got.column("payload").to_pylist())}


def answer(asked: DataFrame, reply: Callable[[int, list[bytes]], list[bytes]]) -> DataFrame:
    """reply gets a kind and all packs' payloads of a bucket, and gives a payload for each."""

    def run(table: pa.Table) -> pa.Table:
        table = table.sort_by([("kind", "ascending"), ("pack", "ascending")])
        kinds, payloads = table.column("kind").to_numpy(), table.column("payload").to_pylist()
        out: list[bytes] = []
        for kind in np.unique(kinds):
            out += reply(int(kind), [payloads[i] for i in np.flatnonzero(kinds == kind)])
        give_back()
        return pa.table([table.column("bucket"), table.column("pack"), table.column("kind"), pa.array(out, pa.binary())], names=["bucket", "pack", "kind", "payload"])

    return asked.groupBy("bucket").applyInArrow(run, ASKED)


def meet(packs: DataFrame, answers: DataFrame, finish: Callable[[Pack, dict], pa.Table], schema: str) -> DataFrame:
    def run(own: pa.Table, got: pa.Table) -> pa.Table:
        parts = [finish(Pack(b), by_kind(got)) for b in own.column("body").to_pylist()]
        return parts[0] if len(parts) == 1 else pa.concat_tables(parts)

    return packs.groupBy("pack").cogroup(answers.groupBy("pack")).applyInArrow(run, schema)


def deal(hashes: np.ndarray, buckets: int) -> Iterator[tuple[int, np.ndarray]]:
    """Places of the hashes of each bucket; the bucket is the hash modulo their number."""
    of = (hashes % np.uint64(buckets)).astype(np.uint16 if buckets < 1 << 16 else np.int64)  # 16 bits are sorted by counting
    order = np.argsort(of, kind="stable")
    at = np.concatenate([[0], np.cumsum(np.bincount(of, minlength=buckets))])
    for b in range(buckets):
        yield b, order[at[b] : at[b + 1]]


def groups(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Order that sorts values, and where equal ones begin in it."""
    order = np.argsort(values)
    s = values[order]
    return order, np.flatnonzero(np.concatenate([[True], s[1:] != s[:-1]])[: len(s)])
