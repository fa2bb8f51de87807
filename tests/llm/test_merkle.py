"""The manifest against the definition in plain Python, with blocks and tops so small that every way to the root is taken."""

import hashlib
import zlib

import pytest
from weft.llm import merkle

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def h(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def encoded(v):
    return "-" if v is None else f"{len(str(v).encode())}:{v}"


def leaf_of(r, text):
    return h(*map(encoded, (r["doc_id"], r["source"], r["lang"], r["n_chars"], text)))


def climb(nodes):
    """Of a list of nodes: the root, and the siblings left and right of each, level by level."""
    paths, at = [[] for _ in nodes], list(range(len(nodes)))
    while len(nodes) > 1:
        for p, k in zip(paths, at):
            a = k - k % 16
            p.append((nodes[a:k], nodes[k + 1 : a + 16]))
        nodes, at = [h(*nodes[k : k + 16]) for k in range(0, len(nodes), 16)], [k // 16 for k in at]
    return nodes[0], paths


def plain(rows):
    key = lambda s: (s is not None, (s or "").encode())
    sources = sorted({r["source"] for r in rows}, key=key)
    own = {s: sorted((r for r in rows if r["source"] == s), key=lambda r: (r["doc_id"] is not None, r["doc_id"] or 0, leaf_of(r, r["text"]))) for s in sources}
    sub = {s: climb([leaf_of(r, r["text"]) for r in own[s]]) for s in sources}
    root, upper = climb([sub[s][0] for s in sources]) if sources else (None, [])
    out = []
    for s, tail in zip(sources, upper):
        for r, path in zip(own[s], sub[s][1]):
            text = r["text"]
            if r["doc_id"] is not None and zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0 and text is not None:
                text = "".join(c.lower() if "A" <= c <= "Z" else c for c in text)
            node = leaf_of(r, text)
            for left, right in path + tail:
                node = h(*left, node, *right)
            proof = h(*(x for left, right in path + tail for x in left + right))
            out.append((r["doc_id"], leaf_of(r, r["text"]), sub[s][0], root, proof, node, node == root))
    return sorted(out, key=repr)


def made(n, sources, hot):
    rows = []
    for i in range(n):
        source = sources[0] if i % 3 < hot else sources[i % len(sources)]
        rows.append({"doc_id": (i * 7919) % 100_003, "text": None if i % 17 == 0 else "" if i % 19 == 0 else f"Text {i} É {'ABC' if i % 2 else 'abc'}", "lang": None if i % 11 == 0 else "en", "source": source, "n_chars": None if i % 13 == 0 else i})
    return rows


def run(spark, rows, **sizes):
    docs = spark.createDataFrame([tuple(r[c] for c in ("doc_id", "text", "lang", "source", "n_chars")) for r in rows], DOCS)
    return sorted((tuple(r) for r in merkle.manifest(docs.repartition(3), **sizes).collect()), key=repr)


@pytest.mark.parametrize("n, sources, levels, top", [(1, ["a"], 4, 100), (17, [None], 4, 100), (300, ["b", None, "é", "", "a"], 1, 1000), (700, ["b", None, "a"], 1, 3), (300, [f"s{i}" for i in range(90)], 1, 5)])
def test_against_the_definition(spark, n, sources, levels, top):
    rows = made(n, sources, 1)
    assert run(spark, rows, levels=levels, most_top=top) == plain(rows)


def test_repeated_rows_and_null_ids(spark):
    rows = made(40, ["a", None], 0)
    rows += [dict(rows[3])] * 20 + [dict(rows[5], text="Other")] + [dict(r, doc_id=None) for r in rows[:30]]
    assert run(spark, rows) == plain(rows)


def test_only_tampered_rows_fail(spark):
    rows = made(200, ["a", "b"], 1)
    for r, row in zip(sorted(rows, key=lambda r: r["doc_id"]), sorted(run(spark, rows))):
        touched = zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0 and any("A" <= c <= "Z" for c in r["text"] or "")
        assert row[0] == r["doc_id"] and row[-1] == (not touched)


def test_empty_and_other_columns(spark):
    assert run(spark, []) == []
    rows = made(30, ["a", "b"], 1)
    docs = spark.createDataFrame([tuple(r[c] for c in ("doc_id", "text", "lang", "source", "n_chars")) + (1, "x", 2) for r in rows], DOCS + ", tree int, leaf string, n int")
    assert sorted((tuple(r) for r in merkle.manifest(docs).collect()), key=repr) == plain(rows)
