"""Groups of similar documents against all pairs."""

import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F
from weft.llm import exchange as ex
from weft.llm import jaccard
from weft.operators.components import components


def by_hand(rows, words, percent):
    def shingle(t):
        w = re.findall(rb"[^\x20\x09-\x0d]+", re.sub(b"[A-Z]", lambda m: m[0].lower(), (t or "").encode()))
        return {tuple(w[i : i + words]) for i in range(max(1, len(w) - words + 1))} if w else set()

    sets = [shingle(t) for _, t in rows]
    label = list(range(len(rows)))
    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if sets[i] and sets[j] and 100 * both >= percent * len(sets[i] | sets[j]) and label[i] != label[j]:
                a, b = label[i], label[j]
                label = [a if x == b else x for x in label]
    first = {}
    for k, (i, _) in zip(label, rows):
        if i is not None:
            first[k] = min(first.get(k, i), i)
    return sorted([(i, len(s), first.get(k)) for (i, _), s, k in zip(rows, sets, label)], key=str)


def made(seed):
    rng = random.Random(seed)
    vocabulary = ["a", "B", "é", "dog", "x1", "the", "of", "tree", "run", "…"] + [f"w{k}" for k in range(40)]
    rows = []
    for family in range(14):
        n = rng.choice([1, 2, 3, 5, 9, 14, 22, 40, 90, 200, 400])
        base = [rng.choice(vocabulary) for _ in range(n)]
        for _ in range(rng.randrange(1, 14)):
            w = list(base)
            for _ in range(rng.randrange(1 + n // 12 + (n > 8))):
                k = rng.randrange(len(w))
                w[k : k + rng.randrange(2)] = [rng.choice(vocabulary)] * rng.randrange(2)
                w = w or ["a"]
            if rng.random() < 0.3:
                base = w
            rows.append((len(rows), rng.choice([" ", "\n", "\x0b "]).join(w).swapcase() if rng.random() < 0.2 else " ".join(w)))
    rows += [(900, None), (901, ""), (902, " \t"), (903, "one"), (904, "ONE"), (905, "one two"), (906, "one two"), (None, "one two"), (None, "alone here"), (907, rows[0][1]), (907, rows[0][1])]
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize(("seed", "words", "percent"), [(1, 3, 90), (2, 3, 90), (3, 5, 80), (4, 2, 80)])
def test_against_all_pairs(spark, seed, words, percent):
    rows = made(seed)
    df = spark.createDataFrame([(*r, 5) for r in rows], "doc_id long, text string, n_shingles int").repartition(5)
    assert sorted((tuple(r) for r in jaccard.linked_groups(df, words, percent).collect()), key=str) == by_hand(rows, words, percent)


def test_blocks(spark, monkeypatch):
    monkeypatch.setattr(jaccard, "BLOCK", 3)
    monkeypatch.setattr(jaccard, "SKETCHED", 5)
    rows = made(5)
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    assert sorted((tuple(r) for r in jaccard.linked_groups(df).collect()), key=str) == by_hand(rows, 3, 90)


def test_components(spark):
    rng = np.random.default_rng(1)
    pairs = [(int(a), int(b)) for a, b in rng.integers(0, 300, (220, 2))] + [(k, k + 1) for k in range(1000, 1100)]
    got = dict(map(tuple, components(spark.createDataFrame(pairs, "a long, b long")).collect()))
    label = {x: x for p in pairs for x in p}
    for _ in range(120):
        for a, b in pairs:
            label[a] = label[b] = min(label[a], label[b])
    assert got == {k: v for k, v in label.items() if k in got} and all(k in got for k, v in label.items() if v != k)


def test_empty(spark):
    assert jaccard.linked_groups(spark.createDataFrame([], "doc_id long, text string")).count() == 0


@pytest.mark.parametrize("task", [0, 524_287, 524_288, 1 << 20, (1 << 28) - 1])
def test_numbers_of_rows_of_many_tasks(task):
    pack = ex.pack_number(task, 65_535)
    keys = jaccard.row_key(pack, np.array([0, 5, (1 << jaccard.PLACE) - 1]))
    assert (keys >= 0).all() and (keys >> jaccard.PLACE == pack).all() and (keys & (1 << jaccard.PLACE) - 1).tolist() == [0, 5, (1 << jaccard.PLACE) - 1]


def test_numbers_that_do_not_fit():
    for bad in (lambda: ex.pack_number(1 << 28, 0), lambda: ex.pack_number(0, 1 << 16), lambda: jaccard.row_key(0, np.array([1 << jaccard.PLACE]))):
        with pytest.raises(ValueError):
            bad()


def test_links_of_late_tasks(spark):
    """Tasks numbered from a million on, as a hundred terabytes have: the number is taken where packs are cut, and nowhere else."""
    rows = made(6)
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)

    def late(docs, cut=ex.packs_of):
        return cut(docs).withColumn("pack", F.col("pack") + (1 << 20 << 16))

    with pytest.MonkeyPatch.context() as m:
        m.setattr(ex, "packs_of", late)
        got = jaccard.linked_groups(df)
    assert sorted((tuple(r) for r in got.collect()), key=str) == by_hand(rows, 3, 90)
