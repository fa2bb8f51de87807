"""Small helpers shared by the text operators: Arrow columns as byte arrays, and tables that outlive executors."""

from __future__ import annotations

import contextlib
import ctypes
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..storage import shared_dir, written  # noqa: F401  (for the operators)

#: bytes of text that one numpy pass holds; bounds the memory of a Python worker whatever the batch or the text is
CHUNK = 1 << 21


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def with_text(docs: DataFrame, text: str = "text") -> DataFrame:
    """doc_id and text alone; a null text is the empty text."""
    return docs.select("doc_id", F.coalesce(F.col(text), F.lit("")).alias("text"))


def text_bytes(column) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of an Arrow string column, null as empty, and the n + 1 row offsets."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = pc.fill_null(column, "" if not pa.types.is_binary(column.type) and not pa.types.is_large_binary(column.type) else b"").cast(pa.large_binary())
    _, offsets, data = column.buffers()
    offs = np.frombuffer(offsets, dtype=np.int64)[column.offset : column.offset + len(column) + 1]
    raw = np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, np.uint8)
    lo, hi = (int(offs[0]), int(offs[-1])) if len(offs) else (0, 0)
    return raw[lo:hi], (offs - lo) if len(offs) else np.zeros(1, np.int64)


def row_chunks(offs: np.ndarray, limit: int = CHUNK) -> Iterator[tuple[int, int]]:
    """Ranges of rows of about limit bytes; a longer row is a range of its own."""
    n, i = len(offs) - 1, 0
    while i < n:
        j = max(i + 1, int(np.searchsorted(offs, offs[i] + limit, side="right")) - 1)
        yield i, min(j, n)
        i = min(j, n)


def give_back() -> None:
    """Hands freed memory back to the system. Workers are used again by later tasks and idle ones stay, so what they only keep counts."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(AttributeError, OSError):  # not every C library can
        ctypes.CDLL(None).malloc_trim(0)


def handed_back(run):
    """A function for mapInArrow that hands freed memory back when its task ends."""

    def wrapped(batches):
        try:
            yield from run(batches)
        finally:
            give_back()

    return wrapped


def lower_ascii(data: np.ndarray) -> np.ndarray:
    """Bytes with A-Z lower-cased."""
    return _LOWER[data]


_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def padded(data: np.ndarray, by: int = 64) -> np.ndarray:
    return np.concatenate([data, np.zeros(by, np.uint8)])


def words64(data: np.ndarray) -> np.ndarray:
    """The 8 bytes from every place on as one little-endian number (a view; data needs 8 bytes to spare)."""
    return np.lib.stride_tricks.as_strided(data[: max(8, len(data))].view(np.uint8), shape=(max(0, len(data) - 7), 8), strides=(1, 1)).view("<u8")[:, 0] if len(data) >= 8 else np.zeros(0, np.uint64)


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads their bits."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(33)
    x *= np.uint64(0xFF51AFD7ED558CCD)
    x ^= x >> np.uint64(33)
    x *= np.uint64(0xC4CEB9FE1A85EC53)
    x ^= x >> np.uint64(33)
    return x


def runs(mask: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the maximal runs of True."""
    edge = np.flatnonzero(np.diff(np.concatenate([[0], mask.astype(np.int8), [0]])))
    return edge[::2], edge[1::2]


def slice_hash(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hash of each slice: its 8-byte words are mixed in turn, the last one masked; data needs 8 bytes to spare."""
    length = ends - starts
    w = words64(data)
    h = mix64(length.astype(np.uint64) + np.uint64(0x9E3779B97F4A7C15))
    at, left, live = starts.copy(), length.copy(), np.flatnonzero(length > 0)
    while len(live):
        rest = left[live]
        x = w[at[live]]
        keep = np.minimum(rest, 8).astype(np.uint64)
        x = x & np.where(keep == 8, np.uint64(0xFFFFFFFFFFFFFFFF), (np.uint64(1) << (keep * np.uint64(8) % np.uint64(64))) - np.uint64(1))
        h[live] = mix64((h[live] * np.uint64(0x9FB21C651E98DF25)) ^ x)
        at[live] += 8
        left[live] -= 8
        live = live[rest > 8]
    return h


def segment_sum(values: np.ndarray, offs: np.ndarray) -> np.ndarray:
    """Sums of values[offs[i]:offs[i + 1]]; 0 for an empty segment."""
    total = np.zeros(len(values) + 1, dtype=np.float64 if values.dtype.kind == "f" else np.int64)
    np.cumsum(values, out=total[1:])
    return total[offs[1:]] - total[offs[:-1]]


def held_out(modulus: int, remainder: int, key: str = "doc_id"):
    """Whether crc32 of the id as text leaves this remainder; false for a null id, which is learned from everywhere."""
    return F.coalesce(F.crc32(F.col(key).cast("string")) % modulus == remainder, F.lit(False))


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))
