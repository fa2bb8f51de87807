"""Language, toxicity and licenses: held-out accuracy, brute force and edge cases."""

import random
import re
import time
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F
from weft.llm import langid, licenses, toxicity
from weft.llm.common import held_out

SF = "/root/testdata/sf0.01"
EDGE = [(0, None), (1, ""), (2, " \n.,"), (3, "123 456"), (4, "x" * 300_000), (4, "x" * 300_000), (5, "ß"), (6, "a")]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


def test_language_held_out(docs):
    model = langid.fit(docs.filter(~held_out(4, 2)))
    rows = langid.predict(docs.filter(held_out(4, 2)), model).collect()
    assert np.mean([r.lang == r.lang_pred for r in rows]) > 0.97 and all(0 <= r.score <= 1 for r in rows)


def test_language_edges(spark, docs):
    df = spark.createDataFrame([(*r, "tag") for r in EDGE], "doc_id long, text string, score string")
    got = {(r.doc_id, r.text): r for r in langid.predict(df, langid.fit(docs)).collect()}
    assert all(got[k].lang_pred == "und" and got[k].score == 0 for k in EDGE[:4]) and got[EDGE[6]].lang_pred == "de"
    none = langid.fit(docs.filter("false"))
    assert {r.lang_pred for r in langid.predict(df, none).collect()} == {"und"}
    assert langid.predict(df.filter("false"), none).count() == 0


def test_language_counts_by_brute_force(spark):
    texts = ["Ab a", "éÉ..x", "", "z"]
    got = {(r.lang, r.bucket): r.n for r in langid.count(spark.createDataFrame([(t, "q") for t in texts], "text string, lang string")).collect()}
    assert got[("q", -1)] == 3
    assert sum(n for (_, b), n in got.items() if b >= 0) == sum(max(0, len(t) - n + 1) for t in ("ab a", "éé x", "z") for n in (1, 2, 3))


def test_null_id_is_learned_from(spark):
    df = spark.createDataFrame([(None,), (1,), (7,)], "doc_id long")
    assert [r.h for r in df.select(held_out(4, 2).alias("h")).collect()] == [False, *(zlib.crc32(str(i).encode()) % 4 == 2 for i in (1, 7))]


def test_toxicity_held_out(spark, docs):
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    machine = toxicity.fit(docs, labels.filter(~held_out(4, 2)))
    rows = toxicity.score(docs.filter(held_out(4, 2)).join(labels, "doc_id"), machine).collect()
    y, p = np.array([r.toxic for r in rows]), np.array([r.predicted for r in rows])
    assert np.mean(y == p) > 0.93 and (p[y == 0]).mean() < 0.03


def test_toxicity_edges(spark, docs):
    df = spark.createDataFrame([(*r, 7) for r in EDGE], "doc_id long, text string, score int")
    labels = spark.createDataFrame([(0, None)], "doc_id long, toxic int")
    assert toxicity.fit(df, labels) is None
    assert {(r.score, r.predicted) for r in toxicity.score(df, None).collect()} == {(0.0, 0)}
    machine = toxicity.fit(docs.limit(50), spark.createDataFrame([(i, i % 2) for i in range(50)], "doc_id long, toxic int"))
    assert len(toxicity.score(df, machine).collect()) == len(EDGE) and toxicity.score(df.filter("false"), machine).count() == 0


def test_machine_learns_a_pair():
    rng = np.random.default_rng(1)
    x = [np.flatnonzero(rng.random(6) < 0.5) for _ in range(4000)]
    y = np.array([float((0 in r) and (1 in r)) for r in x])
    m = toxicity.Machine(np.arange(6)).fit(x, y, epochs=40)
    raw = m.raw(np.repeat(np.arange(len(x)), [len(r) for r in x]), np.concatenate(x), len(x))
    assert np.mean((raw > 0) == y) > 0.99


def test_toxic_by_a_pair_only(spark):
    """Insults and groups are as common in either label; only together they are toxic. Some insults stand alone and are toxic too."""
    rng = random.Random(9)
    fill = ["bread", "river", "stone", "cloud", "green", "seven", "walk", "house"]
    insults, groups = ["dolt", "swine"], ["northerners", "weavers"]
    rows = []
    for i in range(3000):
        kind = rng.random()
        words = rng.choices(fill, k=8)
        toxic = kind < 0.25
        if kind < 0.25:
            words += [rng.choice(insults), rng.choice(groups)]
        elif kind < 0.5:
            words += [rng.choice(insults)]
        elif kind < 0.62:
            words += [rng.choice(groups)]
        rng.shuffle(words)
        rows.append((i, " ".join(words), int(toxic)))
    df = spark.createDataFrame(rows, "doc_id long, text string, toxic int")
    machine = toxicity.fit(df.filter("doc_id < 2000"), df.select("doc_id", "toxic").filter("doc_id < 2000"))
    got = toxicity.score(df.filter("doc_id >= 2000"), machine).collect()
    assert np.mean([r.predicted == r.toxic for r in got]) > 0.97
    linear = toxicity.Machine(machine.slots)
    assert np.abs(machine.v).max() > 0.1 and len(linear.slots) >= 4


def test_inputs_beside_others(spark):
    """A term that both labels use equally often becomes an input if it decides beside a telling one."""
    rows = [(1, "dolt weavers bread")] * 40 + [(1, "river stone")] * 60 + [(0, "dolt bread")] * 10 + [(0, "weavers river")] * 40 + [(0, "stone bread")] * 50
    df = spark.createDataFrame([(i, t, y) for i, (y, t) in enumerate(rows)], "doc_id long, text string, y int")
    feats = toxicity.features(df)
    by_word = lambda w: set(toxicity.terms(np.frombuffer(w.encode(), np.uint8), np.array([0, len(w)]))[0].tolist())
    alone = set(toxicity.telling(toxicity.slot_counts(feats)).tolist())
    beside = set(toxicity.telling(toxicity.slot_counts(feats, np.array(sorted(by_word("dolt"))))).tolist())
    assert by_word("dolt") <= alone and not by_word("weavers") & alone and by_word("weavers") & beside


def brute_scores(machine, text):
    """A text's score by single pairs of inputs."""
    low = "".join(c.lower() if c.isascii() else c for c in text or "").encode()
    words = set(re.findall(rb"[0-9a-z\x80-\xff]+", low))
    place = {int(slot): k for k, slot in enumerate(machine.slots)}
    slots = {s for w in words for s in toxicity.terms(np.frombuffer(w, np.uint8), np.array([0, len(w)]))[0].tolist()}
    own = sorted(place[s] for s in slots if s in place)
    raw = machine.bias + sum(machine.w[k] for k in own) + sum(float(machine.v[a] @ machine.v[b]) for n, a in enumerate(own) for b in own[n + 1 :])
    return 1 / (1 + np.exp(-raw))


def test_toxicity_by_brute_force(spark, docs):
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    machine = toxicity.fit(docs, labels.filter(~held_out(4, 2)))
    df = docs.select("doc_id", "text").union(spark.createDataFrame(EDGE, "doc_id long, text string"))
    for r in toxicity.score(df, machine).collect():
        want = brute_scores(machine, r.text)
        assert r.score == pytest.approx(want, abs=1e-9) and r.predicted == int(want >= 0.3)


def test_language_by_brute_force(spark, docs):
    """Scores by a dictionary of counts, letter by letter, with the same hashing of n-grams."""
    learned = docs.filter("doc_id < 300").select("text", "lang").collect()
    model = langid.fit(docs.filter("doc_id < 300"))
    counts, langs = {}, sorted({r.lang for r in learned if r.lang and r.text})

    def grams_of(text):
        points, out = [], []
        for c in text or "":
            if c.isalpha():
                low = c.lower()
                points.append(ord(low) if len(low) == 1 else ord(c))
            elif not points or points[-1]:
                points.append(0)  # a run of other characters
        for i in range(len(points)):
            key = 0
            for n in (1, 2, 3):
                if i + n <= len(points):
                    key = (key * 0x9E3779B97F4A7C15 + points[i + n - 1] + n) % 2**64
                    out.append(((key ^ key >> 29) * 0xBF58476D1CE4E5B9 % 2**64) >> 49)
        return out, any(points)

    docs_of = dict.fromkeys(langs, 0)
    for r in learned:
        if r.lang and r.text:
            own, has = grams_of(r.text)
            docs_of[r.lang] += has
            for b in own if has else ():
                counts[r.lang, b] = counts.get((r.lang, b), 0) + 1
    total = {g: sum(n for (x, _), n in counts.items() if x == g) for g in langs}
    for r in langid.predict(docs.filter("doc_id between 300 and 360").select("doc_id", "text"), model).collect():
        own, has = grams_of(r.text)
        if not has:
            assert r.lang_pred == "und"
            continue
        score = {g: np.log(docs_of[g] / sum(docs_of.values())) + sum(np.log((counts.get((g, b), 0) + 0.1) / (total[g] + 0.1 * langid.BUCKETS)) for b in own) for g in langs}
        best = max(score.values())
        assert score[r.lang_pred] == pytest.approx(best, rel=1e-4)


def by_hand(text):
    low = "".join(c.lower() if c.isascii() else c for c in text or "")
    words = re.findall(r"[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", low)
    places, labels = [], set()
    for phrase, label in licenses.BASE:
        p = phrase.split()
        hits = [i for i in range(len(words)) if words[i : i + len(p)] == p]
        places += hits
        labels |= {label} if hits else set()
    return len(words), len(places), min(places, default=None), max(places, default=None), ",".join(sorted(labels))


def test_licenses_by_brute_force(spark, docs):
    rng = random.Random(3)
    bits = ["cc", "by", "CC-BY", "general", "Public", "license", "all", "rights reserved", "é", "x1", "\n", "...", "all rights", "ücc", "cc  by"]
    made = [(i, rng.choice([" ", "-", "\x00 "]).join(rng.choice(bits) for _ in range(rng.randrange(14)))) for i in range(400)]
    df = spark.createDataFrame([(*r, "s") for r in made + EDGE], "doc_id long, text string, labels string").union(docs.select("doc_id", "text", "lang"))
    for r in licenses.scan(df).collect():
        assert (r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) == by_hand(r.text), r.text
        assert set(r.base_labels.split(",")) <= set(r.labels.split(",")) or not r.base_labels


def test_fuzzy_notices(spark):
    rows = [(0, "x GNU Genral Public  Licence here"), (1, "é all rihgts\nreserved."), (2, "Permission is hereby granted, free of charge"), (3, "the general of the public")]
    got = {r.doc_id: r for r in licenses.scan(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got[0].labels == "gpl" and rows[0][1].encode()[got[0].spans[0].start : got[0].spans[0].end] == b"Genral Public  Licence"
    assert got[1].labels == "reserved" and got[2].labels == "mit" and got[2].score == pytest.approx(1 - 0 / 44) and got[3].labels == ""
    assert 0 < got[0].score < 1 and licenses.scan(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_language_in_passes_and_stretches(spark, docs, monkeypatch):
    """Many languages and small stretches: the same as at once."""
    made = docs.select("doc_id", "text", F.concat("lang", (F.col("doc_id") % 5).cast("string")).alias("lang"))
    extra = spark.createDataFrame([(10**6 + i, t) for i, t in enumerate(["", "a", "?", None, "été " * 3])], "doc_id long, text string")
    asked = made.select("doc_id", "text").union(extra)
    whole = {r.doc_id: r for r in langid.predict(asked, langid.fit(made)).collect()}
    monkeypatch.setattr(langid, "LANGS", 3)
    monkeypatch.setattr(langid, "CELLS", 100)
    for r in langid.predict(asked, langid.fit(made)).collect():
        assert r.lang_pred == whole[r.doc_id].lang_pred and r.score == pytest.approx(whole[r.doc_id].score, abs=1e-6)


def test_many_matches_in_a_very_long_text():
    notice = licenses.Notice("all rights reserved", "reserved", 2)
    began = time.time()
    assert len(notice.find(b"all rights reserved " * 250_000)) == 250_000  # 5 MB
    assert len(notice.find(b"all rihts reserved x " * 20_000)) == 20_000
    assert time.time() - began < 20


def test_fuzzy_spans_against_all_windows():
    """By the pigeonhole principle nothing within the bound is missed: every window is aligned in full."""
    rng, notice = random.Random(5), licenses.Notice("all rights reserved", "reserved", 2)

    def edits(a, b):
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            last, row[0] = row[0], i
            for j, y in enumerate(b, 1):
                last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
        return row[-1]

    for _ in range(60):
        word = list("all rights reserved")
        for _ in range(rng.randint(0, 4)):
            k = rng.randrange(len(word))
            word[k : k + 1] = rng.choice([[], ["x"], [word[k], "e"]])
        text = ("some words " * rng.randint(0, 2) + "".join(word) + " and more" * rng.randint(0, 2)).encode()
        near = any(edits(text[a:z], notice.text) <= 2 for a in range(len(text)) for z in range(a + 17, min(len(text), a + 21) + 1))
        found = notice.find(text)
        assert bool(found) == near
        assert all(edits(text[a:z], notice.text) <= 2 for a, z, _ in found)
