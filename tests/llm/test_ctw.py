"""Context trees against a direct recursion, and the unigram score by hand."""

import math
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from weft.llm import ctw

ROWS = [(1, "The cat sat on the mat. The cat sat."), (2, "the dog sat on the cat"), (3, "éa ÉA"), (4, None), (5, ""), (6, "a\tb\x0bc a"), (7, "zzzz zzzz"), (7, "zzzz zzzz"), (None, "the mat")]


def low(t):
    return re.sub(b"[A-Z]", lambda m: m[0].lower(), (t or "").encode())


def direct(texts, context, byte):
    """Log2 probability of a byte after five others, by the definition; context: the last byte is nearest."""
    grams = Counter()
    for t in texts:
        raw = b"\0" * 5 + low(t) + b"\0"
        for k in range(5, len(raw)):
            grams[raw[k - 5 : k], raw[k]] += 1

    def counts(ctx, prefix, level):
        n = [0, 0]
        for (c, b), k in grams.items():
            if c.endswith(ctx) and ((1 << level) | b >> (8 - level)) == prefix:
                n[b >> (7 - level) & 1] += k
        return n

    def kt(n):
        return math.lgamma(n[0] + 0.5) + math.lgamma(n[1] + 0.5) - math.lgamma(sum(n) + 1) - math.log(math.pi)

    def weighted(ctx, prefix, level):
        n = counts(ctx, prefix, level)
        if len(ctx) == 5:
            return kt(n), 0.0
        rest = sum(weighted(c, prefix, level)[0] for c in {k[0][-len(ctx) - 1 :] for k in grams if k[0].endswith(ctx)} if sum(counts(c, prefix, level)))
        return np.logaddexp(kt(n), rest) - math.log(2), rest

    total = 0.0
    for level in range(8):
        prefix, bit = (1 << level) | byte >> (8 - level), byte >> (7 - level) & 1

        def mix(d):
            ctx = context[5 - d :]
            n = counts(ctx, prefix, level)
            own = (n[bit] + 0.5) / (sum(n) + 1)
            if d == 5 or not sum(counts(context[4 - d :], prefix, level)):
                return own
            share = 1 / (1 + math.exp(-(kt(n) - weighted(ctx, prefix, level)[1])))
            return share * own + (1 - share) * mix(d + 1)

        total += math.log2(mix(0))
    return total


@pytest.fixture(scope="module")
def model(spark):
    return ctw.fit(spark.createDataFrame([(t,) for _, t in ROWS], "text string"))


def test_tree_by_definition(model):
    texts = [t for _, t in ROWS]
    for context, byte in ((b"\0\0\0\0\0", ord("t")), (b"e cat", ord(" ")), (b" the ", ord("q")), (b"wxyz ", ord("c")), (b" sat.", 0), (b"\0zzzz", ord(" "))):
        key = int.from_bytes(context + bytes([byte]), "little")
        assert model.bits(np.array([key], np.uint64))[0] == pytest.approx(direct(texts, context, byte), abs=0.03)


def test_probabilities_sum_to_one(model):
    for context in (b" the ", b"\0\0\0\0\0", b"qqqqq"):
        keys = np.array([int.from_bytes(context + bytes([b]), "little") for b in range(256)], np.uint64)
        assert np.exp2(model.bits(keys)).sum() == pytest.approx(1, abs=1e-9)
        assert np.allclose(model.lengths(keys), model.bits(keys), atol=1e-4) and np.allclose(model.lengths(keys), model.bits(keys), atol=1e-4)


def test_base_score_by_hand(spark, model):
    df = spark.createDataFrame([(i, t, 1) for i, t in ROWS], "doc_id long, text string, score int")
    got = ctw.score(df, model).collect()
    split = lambda t: [w for w in re.split(rb"[\x20\x09-\x0d]+", low(t)) if w] + [None]
    held = lambda i: i is not None and zlib.crc32(str(i).encode()) % 5 == 1
    c = Counter(w for i, t in ROWS if not held(i) for w in split(t))
    n, v = sum(c.values()), len(c)
    want = sorted((str(i), held(i), len(split(t)), sum(c[w] > 0 for w in split(t)), n, round(sum(math.log10((c[w] + 0.5) / (n + 0.5 * (v + 1))) for w in split(t)), 9)) for i, t in ROWS)
    assert sorted((str(r.doc_id), r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 9)) for r in got) == want
    assert all(r.score < 0 for r in got)


def test_better_than_base_on_held_out(spark):
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet")
    rows = ctw.score(docs, ctw.fit(docs.filter("crc32(cast(doc_id as string)) % 5 <> 1"))).filter("held_out").collect()
    assert sum(r.score for r in rows) > sum(r.base_score for r in rows)
    assert np.mean([r.bits_per_byte for r in rows]) < 2.4


def test_empty(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    blank = ctw.fit(none)
    assert blank.bits(np.array([97 << 40], np.uint64))[0] == -8
    assert ctw.score(none, blank).count() == 0


def by_dictionaries(text, keys):
    """As direct, for a text with many contexts: the log2 probability of each (context, byte), by tables of all nodes."""
    raw, out = b"\0" * 5 + low(text) + b"\0", np.zeros(len(keys))
    for level in range(8):
        layers = [{} for _ in range(6)]
        for k in range(5, len(raw)):
            prefix, bit = (1 << level) | raw[k] >> (8 - level), raw[k] >> (7 - level) & 1
            for d in range(6):
                layers[d].setdefault((raw[k - d : k], prefix), [0, 0])[bit] += 1
        stop, below = [{} for _ in range(6)], {}
        for d in range(5, -1, -1):
            weighted, rest = {}, below
            below = {}
            for (ctx, prefix), (a, b) in layers[d].items():
                kt = math.lgamma(a + 0.5) + math.lgamma(b + 0.5) - math.lgamma(a + b + 1) - math.log(math.pi)
                stop[d][ctx, prefix] = kt - rest.get((ctx, prefix), kt)
                weighted[ctx, prefix] = kt if d == 5 else np.logaddexp(kt, rest[ctx, prefix]) - math.log(2)
                up = ctx[1:], prefix
                below[up] = below.get(up, 0.0) + weighted[ctx, prefix]
        for n, (context, byte) in enumerate(keys):
            prefix, bit = (1 << level) | byte >> (8 - level), byte >> (7 - level) & 1
            path = [(context[5 - d :], prefix) for d in range(6)]
            deepest = max((d for d in range(6) if path[d] in layers[d]), default=None)
            p, left = 0.5 if deepest is None else 0.0, 1.0
            for d in range(0 if deepest is None else deepest + 1):
                c = layers[d][path[d]]
                share = 1 / (1 + math.exp(-np.clip(stop[d][path[d]], -60, 60))) if d < deepest else 1.0
                p += left * share * (c[bit] + 0.5) / (sum(c) + 1)
                left *= 1 - share
            out[n] += math.log2(p)
    return out


def test_no_node_is_lost(spark):
    """Words of random letters, each three times: only long contexts tell what comes, and there are more of them than tables of 2^19 and
    2^20 places keep apart."""
    rng = np.random.default_rng(5)
    letters = np.array(list("abcdefghijklmnopqrstuvwxyz0123456789!#$%&()*+,-./:;<=>?@[]^_`{|}"))
    text = " ".join(rng.permutation(np.repeat(["".join(w) for w in rng.choice(letters, (2_000, 8))], 3)))
    docs = spark.createDataFrame([(1, text)], "doc_id long, text string")
    model, raw = ctw.fit(docs), b"\0" * 5 + text.encode() + b"\0"
    keys = [(raw[k - 5 : k], raw[k]) for k in range(5, len(raw), 199)] + [(raw[k - 5 : k], ord("~")) for k in range(5, len(raw), 1999)]
    got = model.bits(np.array([int.from_bytes(c + bytes([b]), "little") for c, b in keys], np.uint64))
    assert got == pytest.approx(by_dictionaries(text, keys), abs=1e-6)


def test_scores_add_up(spark, model):
    docs = spark.createDataFrame([(i, t) for i, t in ROWS], "doc_id long, text string")
    raw = {t: b"\0" * 5 + low(t) + b"\0" for _, t in ROWS}
    want = [sum(model.bits(np.array([int.from_bytes(raw[t][k - 5 : k + 1], "little") for k in range(5, len(raw[t]))], np.uint64))) * math.log10(2) for _, t in ROWS]
    assert sorted(r.score for r in ctw.score(docs, model).collect()) == pytest.approx(sorted(want), abs=1e-4)
