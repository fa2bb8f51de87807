"""Web pages as WARC records in seekable Zstandard bundles.

A bundle is one file: independent frames of some hundred records each, a skippable frame that maps the identifiers of its records to
(frame, offset in the unpacked frame, length), and last a seek table in the public seekable format (a skippable frame with the sizes
and checksums of all frames before it), so that one record is read by unpacking one frame, and any zstd tool unpacks the whole.

Of pages with equal payloads of MIN_SHARED bytes or more, the one with the smallest page_id is written as a response, and the others
as revisits that name it; their records have the HTTP header alone. Bundles are files of Spark's text writer, which commits them as
it does any table's, in any store it can write to: a bundle is one line, and the line separator is the last four bytes of the format.

Defined results: a null html is empty; records of one page_id with equal payloads are all responses where they have the smallest id;
a null page_id comes after all others and is never referred to; a null url is left out of the record; control characters, blanks and
others that a header can't hold are percent-encoded. A record larger than a bundle is a bundle of its own. An empty table makes no
bundle and is read back as no record.
"""

from __future__ import annotations

import hashlib
import struct
from collections.abc import Iterator
from dataclasses import dataclass
from urllib.parse import quote

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.components import salted
from .common import partitions
from .exchange import expand, join_parts, split_parts, squeeze

#: payloads of at least so many bytes are written once
MIN_SHARED = 100
#: unpacked bytes of a frame, and of a bundle
FRAME = 1 << 18
BUNDLE = 1 << 25
#: values of the formats: the magic numbers of skippable frames (for the index, for the seek table) and of the seek table's end
INDEX_MAGIC, TABLE_MAGIC, END_MAGIC = 0x184D2A50, 0x184D2A5E, 0x8F92EAB1
NO_ID = np.iinfo(np.int64).min
#: all records have one date, so that a run again writes the same bytes
DATE = "2000-01-01T00:00:00Z"
ROW = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long"


def record_id(page_id: int | None, digest: str) -> str:
    return f"<urn:page:{'' if page_id is None else page_id}:{digest}>"


def record(page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None, date: str = DATE) -> bytes:
    """A response, or a revisit where refers_to is given."""
    head = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = head if refers_to is not None else head + payload
    lines = ["WARC/1.1", f"WARC-Type: {'response' if refers_to is None else 'revisit'}", f"WARC-Record-ID: {record_id(page_id, digest)}", f"WARC-Date: {date}"]
    if url is not None:
        lines.append("WARC-Target-URI: " + quote(url, safe="!#$%&'()*+,/:;=?@[]~"))
    if refers_to is not None:
        lines += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: {record_id(refers_to, digest)}"]
    lines += [f"WARC-Payload-Digest: sha256:{digest}", "Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


@dataclass
class Record:
    headers: dict[str, str]
    http: bytes
    payload: bytes

    @property
    def page_id(self) -> int | None:
        return page_of(self.headers["WARC-Record-ID"])


def page_of(urn: str) -> int | None:
    number = urn.split(":")[2]
    return int(number) if number else None


def parse(data: bytes, at: int = 0) -> tuple[Record, int]:
    """The record at this place, and where the next one begins."""
    end = data.index(b"\r\n\r\n", at)
    version, *lines = data[at:end].decode().split("\r\n")
    if not version.startswith("WARC/"):
        raise ValueError("not a WARC record")
    headers = dict(line.split(": ", 1) for line in lines)
    start, stop = end + 4, end + 4 + int(headers["Content-Length"])
    if data[stop : stop + 4] != b"\r\n\r\n":
        raise ValueError("a record's length is wrong")
    body = data.index(b"\r\n\r\n", start, stop) + 4
    return Record(headers, data[start:body], data[body:stop]), stop + 4


def skippable(magic: int, body: bytes) -> bytes:
    return struct.pack("<II", magic, len(body)) + body


class Writer:
    """Records of one bundle, frame by frame."""

    def __init__(self, frame: int = FRAME):
        self.most, self.pack = frame, zstandard.ZstdCompressor(level=3)
        self.frames: list[bytes] = []
        self.table: list[tuple[int, int, int]] = []
        self.open: list[bytes] = []
        self.held = self.size = 0
        self.index: list[tuple[int, int, int, int]] = []

    def add(self, page_id: int | None, raw: bytes) -> None:
        if self.open and self.held + len(raw) > self.most:
            self._close()
        self.index.append((NO_ID if page_id is None else page_id, len(self.frames), self.held, len(raw)))
        self.open.append(raw)
        self.held += len(raw)
        self.size += len(raw)

    def _close(self) -> None:
        raw = b"".join(self.open)
        self.frames.append(self.pack.compress(raw))
        self.table.append((len(self.frames[-1]), len(raw), xxhash.xxh64_intdigest(raw) & 0xFFFFFFFF))
        self.open, self.held = [], 0

    def finish(self) -> bytes:
        """The bundle's bytes."""
        if self.open:
            self._close()
        rows = sorted(self.index)
        index = skippable(INDEX_MAGIC, join_parts(*(squeeze(np.array(c, np.int64).view(np.uint64)) for c in zip(*rows))))
        entries = [*self.table, (len(index), 0, xxhash.xxh64_intdigest(b"") & 0xFFFFFFFF)]
        table = b"".join(struct.pack("<III", *e) for e in entries) + struct.pack("<IBI", len(entries), 0x80, END_MAGIC)
        return b"".join([*self.frames, index, skippable(TABLE_MAGIC, table)])


class Bundle:
    """A bundle's bytes, or a view of a mapped file: frames are unpacked as they are asked for."""

    def __init__(self, raw: bytes | memoryview):
        self.raw = memoryview(raw)
        count, flags, magic = struct.unpack("<IBI", self.raw[-9:])
        width = 12 if flags & 0x80 else 8
        if magic != END_MAGIC or struct.unpack("<II", self.raw[-17 - count * width : -9 - count * width]) != (TABLE_MAGIC, count * width + 9):
            raise ValueError("not a seekable bundle")
        entries = np.frombuffer(self.raw[-9 - count * width : -9], "<u4").reshape(count, width // 4).astype(np.int64)
        self.sizes, self.sums = entries[:, 1], entries[:, 2] if width == 12 else None
        self.starts = np.concatenate([[0], np.cumsum(entries[:, 0])])
        self._unpack = zstandard.ZstdDecompressor()

    def frame(self, k: int) -> bytes:
        raw = self._unpack.decompress(self.raw[self.starts[k] : self.starts[k + 1]], max_output_size=int(self.sizes[k]))
        if len(raw) != self.sizes[k] or (self.sums is not None and xxhash.xxh64_intdigest(raw) & 0xFFFFFFFF != self.sums[k]):
            raise ValueError(f"frame {k} is damaged")
        return raw

    def frames(self) -> Iterator[bytes]:
        for k in np.flatnonzero(self.sizes).tolist():
            yield self.frame(k)

    def records(self) -> Iterator[Record]:
        for raw in self.frames():
            at = 0
            while at < len(raw):
                found, at = parse(raw, at)
                yield found

    def index(self) -> np.ndarray:
        """page_id (NO_ID: null), frame, offset and length of each record, sorted."""
        for k in np.flatnonzero(self.sizes == 0).tolist():
            at = int(self.starts[k])
            magic, length = struct.unpack("<II", self.raw[at : at + 8])
            if magic == INDEX_MAGIC:
                return np.stack([expand(p).view(np.int64) for p in split_parts(bytes(self.raw[at + 8 : at + 8 + length]))], axis=1)
        raise ValueError("the bundle has no index")

    def find(self, page_id: int) -> list[Record]:
        """The records of a page: its frames alone are unpacked."""
        index = self.index()
        a, z = np.searchsorted(index[:, 0], [page_id, page_id + 1])
        return [parse(self.frame(k), at)[0] for k, at in index[a:z, 1:3].tolist()]


def planned(pages: DataFrame) -> DataFrame:
    """page_id, url, body (bytes), digest, refers_to of pages (page_id, url, html). Payloads that several pages have are few rows beside
    the pages, and meet them salted; a page that has its payload alone meets nothing."""
    body = F.coalesce(F.col("html"), F.lit("")).cast("binary")
    rows = pages.select("page_id", "url", body.alias("body"), F.sha2(body, 256).alias("digest"))
    large = F.octet_length("body") >= MIN_SHARED
    shared = rows.filter(large).groupBy("digest").agg(F.min("page_id").alias("first"), F.count("*").alias("pages")).filter("pages > 1").select(F.col("digest").alias("key"), "first")
    # small payloads are no key: all empty ones would be one
    keyed = rows.withColumn("key", F.when(large, F.col("digest")).otherwise(F.concat(F.lit("small "), F.coalesce(F.col("page_id").cast("string"), F.col("url"), F.lit("")))))
    met = salted(keyed, shared, "key", "page_id", "left")
    return met.select("page_id", "url", "body", "digest", F.expr("if(page_id <=> first, null, first) refers_to"))


def write(pages: DataFrame, path: str, frame: int = FRAME, bundle: int = BUNDLE) -> None:
    """Bundles of pages (page_id, url, html) below path."""

    def run(batches):
        out = Writer(frame)
        full = lambda: pa.RecordBatch.from_arrays([pa.array([out.finish()[:-4]], pa.binary())], names=["body"])
        for batch in batches:
            columns = [batch.column(c) for c in ("page_id", "url", "body", "digest", "refers_to")]
            for k in range(batch.num_rows):
                page_id, url, body, digest, refers_to = (c[k].as_py() for c in columns)
                raw = record(page_id, url, body, digest, refers_to)
                if out.size and out.size + len(raw) > bundle:
                    yield full()
                    out = Writer(frame)
                out.add(page_id, raw)
        if out.size:
            yield full()

    lines = planned(pages).mapInArrow(run, "body binary").select(F.col("body").cast("string").alias("value"))
    end = struct.pack("<I", END_MAGIC).decode("latin-1")
    lines.write.option("maxRecordsPerFile", 1).option("encoding", "ISO-8859-1").option("lineSep", end).option("compression", "none").text(path)


def bundles(spark: SparkSession, path: str) -> DataFrame:
    """path, content of the bundles below path; a task that wrote nothing may leave an empty file."""
    return spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(path).filter("length > 0").select("path", "content")


def _rows(record: Record) -> tuple:
    headers = record.headers
    digest, revisit = headers["WARC-Payload-Digest"].removeprefix("sha256:"), headers["WARC-Type"] == "revisit"
    size = int(record.http.split(b"Content-Length: ", 1)[1].split(b"\r\n", 1)[0])
    if not revisit and (size != len(record.payload) or hashlib.sha256(record.payload).hexdigest() != digest):
        raise ValueError(f"the payload of {headers['WARC-Record-ID']} is damaged")
    return record.page_id, size, digest, headers["WARC-Type"], page_of(headers["WARC-Refers-To"]) if revisit else None


def read_back(spark: SparkSession, path: str) -> DataFrame:
    """page_id, payload_bytes, payload_digest, record_type, refers_to of all records, from the bundles. A response's payload is held
    against its digest and length, and a frame against its checksum."""

    def run(batches):
        for batch in batches:
            for raw in batch.column("content"):
                rows = [_rows(r) for r in Bundle(raw.as_buffer()).records()]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), (pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64()))], names=["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"])

    return bundles(spark, path).select("content").mapInArrow(run, ROW)


def index(spark: SparkSession, path: str) -> DataFrame:
    """page_id, path, frame, offset, length of all records."""

    def run(batches):
        for batch in batches:
            for name, raw in zip(batch.column("path"), batch.column("content")):
                found = Bundle(raw.as_buffer()).index()
                yield pa.RecordBatch.from_arrays([pa.array(found[:, 0], mask=found[:, 0] == NO_ID), pa.array([name.as_py()] * len(found), pa.string()), *(pa.array(found[:, k]) for k in (1, 2, 3))], names=["page_id", "path", "frame", "offset", "length"])

    return bundles(spark, path).mapInArrow(run, "page_id long, path string, frame long, offset long, length long")


def payloads(spark: SparkSession, path: str, wanted: DataFrame) -> DataFrame:
    """page_id, html of the pages in wanted (page_id), by the index: a revisit's payload is that of the response it names. Of each bundle
    only the frames that hold a wanted record are unpacked."""
    parts = partitions(spark)
    where = index(spark, path)

    def fetched(ids: DataFrame) -> DataFrame:
        """page_id, urn, refers_to (urn, of a revisit), html (of a response) of the records of ids."""
        places = where.join(ids.select("page_id").distinct(), "page_id", "left_semi")

        def run(own: pa.Table, want: pa.Table) -> pa.Table:
            rows = []
            if own.num_rows and want.num_rows:
                bundle, last, raw = Bundle(own.column("content")[0].as_buffer()), -1, b""
                for frame, at, page_id in sorted(zip(*(want.column(c).to_pylist() for c in ("frame", "offset", "page_id")))):
                    if frame != last:
                        last, raw = frame, bundle.frame(frame)
                    found = parse(raw, at)[0]
                    refers_to = found.headers.get("WARC-Refers-To")
                    rows.append((page_id, found.headers["WARC-Record-ID"], refers_to, None if refers_to else found.payload.decode()))
            columns = list(zip(*rows)) or [[]] * 4
            return pa.table([pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.string(), pa.string(), pa.string()))], names=["page_id", "urn", "refers_to", "html"])

        return bundles(spark, path).repartition(parts, "path").groupBy("path").cogroup(places.groupBy("path")).applyInArrow(run, "page_id long, urn string, refers_to string, html string")

    first = fetched(wanted)
    again = first.filter("refers_to is not null").select("page_id", "refers_to")
    named = fetched(again.select(F.split("refers_to", ":")[2].cast("long").alias("page_id"))).filter("refers_to is null").groupBy(F.col("urn").alias("refers_to")).agg(F.first("html").alias("html"))
    return first.filter("refers_to is null").select("page_id", "html").union(salted(again, named, "refers_to", "page_id").select("page_id", "html"))
