"""Removal of repeated strings against brute force."""

import hashlib
import random

import numpy as np
import pytest
from weft.llm import exchange as ex
from weft.llm import suffixes


def by_hand(rows, length=50):
    first = {}
    for i, t in rows:
        raw = (t or "").encode()
        for k in range(len(raw) - length + 1):
            s = raw[k : k + length]
            key = float("inf") if i is None else i
            first[s] = min(first.get(s, key), key)
    out = []
    for i, t in rows:
        raw = (t or "").encode()
        mask = bytearray(len(raw))
        for k in range(len(raw) - length + 1):
            if first[raw[k : k + length]] < (float("inf") if i is None else i):
                mask[k : k + length] = b"\1" * length
        spans = sum(m and (k == 0 or not mask[k - 1]) for k, m in enumerate(mask))
        kept = bytes(b for b, m in zip(raw, mask) if not m)
        out.append((i, len(raw), sum(mask), spans, hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=str)


def made(seed):
    rng = random.Random(seed)
    words = ["ab", "é", "the", "of ", "xyz", "\n", "q", "日本"]
    passages = ["".join(rng.choice(words) for _ in range(rng.randrange(15, 90))) for _ in range(12)]
    rows = []
    for i in range(120):
        parts = [rng.choice(passages) if rng.random() < 0.5 else "".join(rng.choice(words) for _ in range(rng.randrange(40))) for _ in range(rng.randrange(6))]
        text = "".join(parts)
        cut = rng.randrange(len(text) + 1)
        rows.append((i, text[cut:] if rng.random() < 0.3 else text))
    long = "".join(rng.choice("abcdefgh ") for _ in range(30_000))
    rows += [(200, long), (201, long[100:20_000] + "!" + long[20_000:]), (202, "a" * 300), (203, "a" * 49), (204, "a" * 50), (205, None), (206, ""), (207, long[:60]), (207, long[:60]), (None, long[:80]), (-5, long[29_000:])]
    return rows


@pytest.mark.parametrize("seed", [1, 2])
def test_against_brute_force(spark, seed):
    rows = made(seed)
    df = spark.createDataFrame([(i, t, "x") for i, t in rows], "doc_id long, text string, n_bytes string").repartition(7)
    got = sorted((tuple(r) for r in suffixes.digests(df).collect()), key=str)
    assert got == by_hand(rows)


def test_spans_and_text(spark):
    base = "The quick brown fox jumps over the lazy dog, and then it sleeps é all day."
    df = spark.createDataFrame([(1, base), (2, "Before " + base + " after"), (3, None)], "doc_id long, text string")
    assert [tuple(r) for r in suffixes.spans(df).collect()] == [(2, 7, 7 + len(base.encode()))]
    assert dict(map(tuple, suffixes.kept_text(df).collect())) == {1: base, 2: "Before  after", 3: ""}


def test_empty(spark):
    df = spark.createDataFrame([], "doc_id long, text string")
    assert suffixes.digests(df).count() == 0 and suffixes.spans(df).count() == 0


def in_packs(rows, packs, buckets, bounds):
    """Masks of removed bytes by doc, with the packs' exchange done here."""

    class Pack:
        def __init__(self, own):
            raw = [(t or "").encode() for _, t in own]
            self.ids = np.array([ex.NO_ID if i is None else i for i, _ in own], np.int64)
            self.data, self.offs = np.frombuffer(b"".join(raw), np.uint8), np.concatenate([[0], np.cumsum([len(r) for r in raw])]).astype(np.int64)

    work = [suffixes.Work(Pack(rows[k::packs]), 24, bounds, buckets) for k in range(packs)]
    got = [{} for _ in work]
    for ask in (lambda w, g: w.ask(), lambda w, g: w.ask_again(g)):
        sent = {}
        for k, w in enumerate(work):
            for b, kind, payload in ask(w, got[k]):
                sent.setdefault((kind, b), []).append((k, payload))
        for (kind, b), own in sent.items():
            for (k, _), answer in zip(own, suffixes.reply(kind, [p for _, p in own])):
                got[k][kind, b] = answer
    out = []
    for k, w in enumerate(work):
        mask = w.removed(got[k])
        for (i, t), a, z in zip(rows[k::packs], w.pack.offs, w.pack.offs[1:]):
            own = mask[a:z]
            kept = w.pack.data[a:z][~own].tobytes()
            out.append((i, int(z - a), int(own.sum()), int((np.diff(own.astype(np.int8), prepend=0) == 1).sum()), hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=str)


def test_no_hash_decides(monkeypatch):
    """With hashes of one and of two bits, and with bounds that all suffixes share, the same bytes go."""
    rows = made(3)
    want, lead = by_hand(rows), np.frombuffer(b"the the ", ">u8").astype(np.uint64)
    assert in_packs(rows, 3, 4, np.repeat(lead, 3)) == want
    full, full_rows = suffixes.hashes, suffixes.row_hashes
    monkeypatch.setattr(suffixes, "hashes", lambda w, at, n: full(w, at, n) & np.uint64(1 << 63))
    monkeypatch.setattr(suffixes, "row_hashes", lambda r: full_rows(r) & np.uint64(3))
    assert in_packs(rows, 3, 4, np.sort(np.concatenate([lead, lead + np.uint64(1 << 50)]))) == want
    assert in_packs(rows, 1, 1, lead[:0]) == want


def test_other_columns(spark):
    df = spark.createDataFrame([(1, "x" * 80, 5, "a"), (2, "x" * 80, None, "b"), (None, None, 7, None)], "doc_id long, text string, n_removed long, body string")
    got = {r.doc_id: r for r in suffixes.kept_text(df).collect()}
    assert got[1].text == "x" * 80 and got[2].text == "" and got[None].text == "" and (got[2].n_removed, got[2].body, got[None].n_removed) == (None, "b", 7)


def test_no_bucket_holds_the_notes_of_all_packs():
    rows = made(3) * 40
    work = []

    class Pack:
        def __init__(self, k):
            own = rows[k::64]
            raw = [(t or "").encode() for _, t in own]
            self.ids = np.array([1000 * k + i for i in range(len(own))], np.int64)
            self.data, self.offs = np.frombuffer(b"".join(raw), np.uint8), np.concatenate([[0], np.cumsum([len(r) for r in raw])]).astype(np.int64)

    work = [suffixes.Work(Pack(k), 24, np.zeros(0, np.uint64), 16) for k in range(64)]
    notes = np.bincount([w.home for w in work], minlength=16)
    assert notes.sum() == 64 and notes.max() <= 12
