"""Passages against an alignment of every segment with every text."""

import random
import tracemalloc

import numpy as np
from weft.llm import decontaminate as dc


def best_edits(pattern, text):
    """Fewest edits of pattern with any part of text."""
    row = [0] * (len(text) + 1)
    for i, p in enumerate(pattern):
        new = [i + 1]
        for j, t in enumerate(text):
            new.append(min(row[j] + (p != t), row[j + 1] + 1, new[j] + 1))
        row = new
    return min(row)


def test_against_all_alignments(spark):
    rng = random.Random(4)
    alphabet = "abcdeé  thonis"
    word = lambda n: "".join(rng.choice(alphabet) for _ in range(n))
    items = [(k, word(rng.choice([30, 60, 90, 140]))) for k in range(10)]
    docs = [(0, None), (1, ""), (2, items[0][1]), (2, items[0][1]), (3, items[1][1][5:])]
    for i in range(4, 60):
        text = list(rng.choice(items)[1])
        for _ in range(rng.randrange(len(text) // 5)):
            k = rng.randrange(len(text))
            text[k : k + rng.randrange(2)] = [rng.choice(alphabet)] * rng.randrange(2)
            text = text or ["a"]
        docs.append((i, word(rng.randrange(60)) + "".join(text).upper().replace(" ", " \n") + word(rng.randrange(60))))
    df = spark.createDataFrame([(*d, 1) for d in docs], "doc_id long, text string, item_id int")
    bench = spark.createDataFrame([*items, (90, None), (91, ""), (92, "abc")], "item_id long, text string")
    got = sorted({(r.doc_id, r.item_id, r.edits) for r in dc.passages(df, bench).collect()})
    flat = lambda t: " ".join(t.lower().split()) if t.strip() else ""
    want = set()
    for i, t in docs:
        for k, s in items:
            s = flat(s)
            budget = min(int(len(s) * dc.RATE), (len(s) - dc.Q) // dc.Q)
            e = best_edits(s, flat(f"x{t or ''}x"))
            if t and e <= budget:
                want.add((i, k, e))
    assert got == sorted(want) and len(want) > 15


def test_long_item_in_part(spark):
    rng = random.Random(5)
    item = "".join(rng.choice("abcdefghij klm") for _ in range(600))
    doc = "Something before. " + item[200:380] + " and after"
    rows = dc.passages(spark.createDataFrame([(7, doc), (8, "nothing of it")], "doc_id long, text string"), spark.createDataFrame([(1, item)], "item_id long, text string")).collect()
    assert [(r.doc_id, r.item_id, r.edits) for r in rows] == [(7, 1, 0)]
    assert doc[rows[0].start : rows[0].end] in doc and 100 <= rows[0].end - rows[0].start <= 200


def test_empty(spark):
    docs, bench = spark.createDataFrame([(1, "abc" * 50)], "doc_id long, text string"), spark.createDataFrame([], "item_id long, text string")
    assert dc.passages(docs, bench).count() == 0 and dc.passages(docs.filter("false"), spark.createDataFrame([(1, "abc" * 50)], "item_id long, text string")).count() == 0
    assert np.array_equal(dc.folded("É \n x".encode(), np.array([0, 6]))[0], [ord(c) for c in "é x"])


def test_many_items_and_many_texts(spark):
    rng = random.Random(6)
    items = [(k, "".join(rng.choice("abcdefghijklmnop ") for _ in range(60))) for k in range(20_000)]
    docs = [(i, f"before {items[5 * i][1]} after") for i in range(4_000)]
    bench = spark.createDataFrame(items, "item_id long, text string")
    df = spark.createDataFrame(docs, "doc_id long, text string").coalesce(1)
    got = {(r.doc_id, r.item_id) for r in dc.passages(df, bench).collect()}
    assert {(i, 5 * i) for i in range(4_000)} <= got and len(got) < 4_100
    assert dc.without(df, bench).count() == 0


def test_common_grams_in_stretches(monkeypatch):
    """Counts of a bounded number of hits at a time find the bands that all hits at once find, in long texts too."""
    rng = random.Random(8)
    word = lambda n: "".join(rng.choice("ab ") for _ in range(n))
    index = dc.Index([(k, word(rng.choice([40, 90, 140]))) for k in range(60)])
    texts = [word(rng.choice([0, 5, 300])) for _ in range(30)] + [word(20_000)]
    raw = [t.encode() for t in texts]
    points, offs, _ = dc.folded(b"".join(raw), np.concatenate([[0], np.cumsum([len(r) for r in raw])]))
    want = sorted(zip(*(x.tolist() for x in index.candidates(points, offs))))
    for hits in (1, 1000, 50_000):
        monkeypatch.setattr(dc, "HITS", hits)
        assert sorted(zip(*(x.tolist() for x in index.candidates(points, offs)))) == want
    monkeypatch.setattr(dc, "HITS", 50_000)
    for most in (5_000, 60_000):
        monkeypatch.setattr(dc, "MOST", most)
        assert sorted(zip(*(x.tolist() for x in index.candidates(points, offs)))) == want
    counts = {}
    for t in range(len(texts)):
        own = points[offs[t] : offs[t + 1]]
        places = {}
        for i in range(len(own) - dc.Q + 1):
            places.setdefault(own[i : i + dc.Q].tobytes(), []).append(i)
        for s, part in enumerate(index.text):
            for j in range(len(part) - dc.Q + 1):
                for i in places.get(part[j : j + dc.Q].tobytes(), ()):
                    counts[t, s, (i - j) >> index.shift] = counts.get((t, s, (i - j) >> index.shift), 0) + 1
    by_hand = sorted((t, s, b << index.shift) for (t, s, b), n in counts.items() if n + counts.get((t, s, b + 1), 0) >= index.need[s])
    assert want == by_hand and len(want) > 100


def test_repeated_and_repetitive_items(spark):
    """Equal segments are one; items that share one are all reported, with all their segments."""
    rng = random.Random(9)
    once = "".join(rng.choice("abcdefgh ") for _ in range(80)).strip()
    items = [(1, once), (2, once), (2, once), (3, "a" * 400), (4, "a" * 120), (5, "x" * 60)]
    docs = [(1, f"so {once} it is"), (2, "a" * 3_000), (3, "nothing")]
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = {(r.doc_id, r.item_id): (r.segments, r.edits) for r in dc.passages(spark.createDataFrame(docs, "doc_id long, text string"), bench).collect()}
    assert got == {(1, 1): (1, 0), (1, 2): (2, 0), (2, 3): (7, 0), (2, 4): (1, 0)}


def test_repetitive_items_and_a_long_text_in_bounded_memory():
    index = dc.Index([(k, "a" * (60 + k % 60)) for k in range(2_000)])
    assert len(index.text) == 60
    points, offs, _ = dc.folded(b"a" * 20_000, np.array([0, 20_000]))
    tracemalloc.start()
    text, _, _ = index.candidates(points, offs)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert len(text) and peak < 1 << 30
