"""Bundles: formats by hand, damage, one frame for one record, and whole round trips against plain Python."""

import hashlib
import io
import struct

import pytest
import zstandard
from weft.llm import warc
from weft.storage import shared_dir

PAGES = "page_id long, url string, html string"


def plain(rows):
    """What the contract says of rows (page_id, url, html)."""
    bodies = [(h or "").encode() for _, _, h in rows]
    first = {}
    for (page_id, _, _), b in zip(rows, bodies):
        if len(b) >= warc.MIN_SHARED and page_id is not None:
            first[b] = min(first.get(b, page_id), page_id)
    out = []
    for (page_id, _, _), b in zip(rows, bodies):
        to = first.get(b)
        to = None if to == page_id else to
        out.append((page_id, len(b), hashlib.sha256(b).hexdigest(), "response" if to is None else "revisit", to))
    return sorted(out, key=repr)


def round_trip(spark, rows, **sizes):
    path = shared_dir(spark)
    warc.write(spark.createDataFrame(rows, PAGES).repartition(3), path, **sizes)
    return path, sorted((tuple(r) for r in warc.read_back(spark, path).collect()), key=repr)


def test_bundle_is_plain_zstd_with_a_seek_table():
    w = warc.Writer(frame=300)
    raws = [warc.record(i, f"http://x/{i}", b"p" * (50 * i), hashlib.sha256(b"p" * (50 * i)).hexdigest(), None) for i in range(8)]
    for i, raw in enumerate(raws):
        w.add(7 - i, raw)
    body = w.finish()
    assert zstandard.ZstdDecompressor().stream_reader(io.BytesIO(body), read_across_frames=True).read() == b"".join(raws)
    count, flags, magic = struct.unpack("<IBI", body[-9:])
    assert (magic, flags) == (0x8F92EAB1, 0x80) and body[-9 - 12 * count - 8 : -9 - 12 * count - 4] == struct.pack("<I", 0x184D2A5E)
    b = warc.Bundle(body)
    assert sum(e for e in b.sizes) == sum(map(len, raws)) and len(b.sizes) == count > 4
    assert [r.page_id for r in b.records()] == list(range(8))
    assert [r.payload for r in b.find(7 - 3)] == [b"p" * 150] and b.find(99) == []
    asked = []
    b.frame = lambda k, whole=b.frame: asked.append(k) or whole(k)
    b.find(0)
    assert len(asked) == 1


def test_damage_is_seen():
    w = warc.Writer()
    w.add(1, warc.record(1, None, b"x" * 500, hashlib.sha256(b"x" * 500).hexdigest(), None))
    body = bytearray(w.finish())
    with pytest.raises(ValueError):
        warc.Bundle(bytes(body[:-1]) + b"\0")
    body[-9 - 12 * 2 + 8] ^= 1  # the checksum of the first frame
    with pytest.raises(ValueError):
        list(warc.Bundle(bytes(body)).records())


def test_headers_hold_any_url():
    raw = warc.record(None, "http://x/a b\r\nWARC-Type: é\0", b"", hashlib.sha256(b"").hexdigest(), None)
    found, end = warc.parse(raw)
    assert end == len(raw) and found.headers["WARC-Type"] == "response" and found.page_id is None
    assert found.headers["WARC-Target-URI"] == "http://x/a%20b%0D%0AWARC-Type:%20%C3%A9%00"


def test_round_trip_of_odd_rows(spark):
    big = "long é\r\n\r\nWARC/1.1 " * 30
    rows = [(9, "u", big), (3, None, big), (None, "v", big), (4, "u", "short"), (5, "u", "short"), (6, "", None), (None, None, None)]
    rows += [(3, None, big), (7, "w", "y" * 99), (8, "w", "y" * 99), (10, "w", "z" * 100), (11, "w", "z" * 100), (12, "q", "é" * 50), (13, "q", "é" * 50), (10, "w", "other " * 40)]
    rows += [(None, "n", "only null ids " * 20), (None, "m", "only null ids " * 20), (-5, "neg", "z" * 100)]
    path, got = round_trip(spark, rows, frame=400, bundle=2000)
    assert got == plain(rows)
    assert spark.read.format("binaryFile").load(path).filter("length > 0").count() > 3
    index = warc.index(spark, path).collect()
    assert sorted((r.page_id for r in index), key=repr) == sorted((r[0] for r in rows), key=repr)
    wanted = spark.createDataFrame([(9,), (11,), (6,), (3,), (99,), (12,)], "page_id long")
    assert sorted(tuple(r) for r in warc.payloads(spark, path, wanted).collect()) == sorted([(9, big), (11, "z" * 100), (6, ""), (3, big), (3, big), (12, "é" * 50)])


def test_many_copies_and_a_record_above_a_bundle(spark):
    rows = [(i, "u", "copy of a long page " * 20) for i in range(300, 0, -1)] + [(1000 + i, "u", f"{i} own " * 30) for i in range(100)] + [(2000, "u", "huge " * 4000)]
    assert round_trip(spark, rows, frame=2000, bundle=6000)[1] == plain(rows)


def test_no_pages_and_other_columns(spark):
    assert round_trip(spark, [])[1] == []
    path = shared_dir(spark)
    clash = spark.createDataFrame([(1, "u", "h" * 120, 5, "d"), (2, "u", "h" * 120, 6, "e")], PAGES + ", refers_to long, digest string")
    warc.write(clash, path)
    assert sorted((r.page_id, r.record_type, r.refers_to) for r in warc.read_back(spark, path).collect()) == [(1, "response", None), (2, "revisit", 1)]
