"""Operators on small graphs and texts with answers worked out by hand."""

import gzip
import json
import math
import zipfile

import numpy as np
import pytest
from weft.operators import community as cm
from weft.operators import components as cc
from weft.operators import copying as cp
from weft.operators import distributions as ds
from weft.operators import graph, paths
from pyspark.sql import functions as F
from weft.operators import links as lk
from weft.operators import names as nm
from weft.operators import robustness as rb
from weft.operators import tfidf as tf
from weft.sources import readers
from weft.streaming import degrees as sd


@pytest.fixture(scope="module")
def cliques(spark):
    """Two groups of four, all linked within, and one bridge."""
    pairs = [(a, b) for g in (range(4), range(4, 8)) for a in g for b in g if a < b] + [(3, 4)]
    return spark.createDataFrame([(k,) for k in range(8)], "node long"), spark.createDataFrame(pairs, "src long, dst long")


@pytest.fixture(scope="module")
def tiny(spark):
    """One mutual pair, a duplicate, a loop, an island of two and an isolate."""
    edges = [(1, 2), (2, 1), (2, 3), (2, 3), (3, 3), (5, 6)]
    return spark.createDataFrame([(k,) for k in (1, 2, 3, 5, 6, 7)], "node long"), spark.createDataFrame(edges, "src long, dst long")


def test_small_digraph(spark, tiny):
    nodes, edges = tiny
    edges = graph.build(edges)
    assert edges.count() == 5
    assert graph.reciprocity(edges).first().asDict() == {"m_dir": 4, "mutual_pairs": 1, "one_way": 2, "m_undirected": 3}
    assert {(r.s, r.t, r.dir) for r in graph.direction(edges).collect()} == {(1, 2, "mutual"), (2, 3, "st"), (5, 6, "st")}
    assert [r.node for r in graph.isolates(nodes, edges).collect()] == [7]
    assert {r.node: r.component for r in cc.all_components(nodes, edges).collect()} == {1: 1, 2: 1, 3: 1, 5: 5, 6: 5, 7: 7}
    assert {r.node: r.label for r in graph.component_labels(cc.all_components(nodes, edges)).collect()} == {1: "giant", 2: "giant", 3: "giant", 5: "second", 6: "second", 7: "isolate"}
    assert {r.node: (r.in_degree, r.out_degree, r.degree) for r in graph.degrees(nodes, edges).collect()}[3] == (2, 1, 1)
    assert cc.components(edges.filter("false").selectExpr("src a", "dst b")).count() == 0


def test_disparity(spark):
    rows = graph.disparity(spark.createDataFrame([(1, 2, 2), (2, 3, 1), (1, 3, 1), (3, 4, 4)], "src long, dst long, weight long")).collect()
    p = {(r.src, r.dst): r.p for r in rows}
    assert p[1, 2] == pytest.approx(1 / 3) and p[3, 4] == pytest.approx((1 - 4 / 6) ** 2)


def test_modularity_and_nmi(spark, cliques):
    nodes, edges = cliques
    halves = nodes.selectExpr("node", "node div 4 community")
    assert graph.modularity(edges, halves).first().q == pytest.approx(12 / 13 - 0.5)
    assert graph.nmi(halves, halves.selectExpr("node", "1 - community community")).first().nmi == pytest.approx(1)
    assert graph.nmi(halves, nodes.selectExpr("node", "node % 2 community")).first().nmi == pytest.approx(0, abs=1e-12)


def test_paths_and_betweenness(spark, cliques):
    nodes, edges = cliques
    dist = {(r.source, r.node): r.dist for r in paths.distances(edges, nodes).collect()}
    assert dist[0, 7] == 3 and dist[3, 4] == 1 and dist[5, 5] == 0 and len(dist) == 64
    got = {r.node: r.betweenness for r in paths.betweenness(edges, nodes).collect()}
    # the bridge's ends lie on 3 * 4 of the 21 pairs of others
    assert got[3] == pytest.approx(12 / 21) == got[4] and got[0] == 0


def test_removals(spark, cliques):
    nodes, edges = cliques
    order = spark.createDataFrame([("x", v, k) for k, v in enumerate([3, 4, 0, 1, 2, 5, 6, 7])], "order_id string, node long, pos long")
    curve = rb.curves(nodes, edges, order)
    got = [r.fraction * 8 for r in curve.orderBy("step").collect()]
    assert got == [8, 4, 3, 3, 3, 3, 2, 1, 0]
    assert rb.half_life(curve).first().step == 1
    assert {r.node: r.impact for r in rb.node_impact(nodes, edges).collect()} == {k: (0.5 if k in (3, 4) else 0.125) for k in range(8)}
    fail = rb.curves(nodes, edges, rb.random_orders(nodes, 5))
    per = {}
    for r in fail.orderBy("order_id", "step").collect():
        per.setdefault(r.order_id, []).append(r.fraction)
    assert len(per) == 5 and all(c[0] == 1 and c[-1] == 0 and all(a >= b for a, b in zip(c, c[1:])) for c in per.values())


def test_communities(spark, cliques):
    nodes, edges = cliques
    labels = cm.runs(nodes, edges, 8)
    agreed = cm.consensus(nodes, labels)
    sides = {r.node: r.community for r in agreed.collect()}
    assert len(set(sides.values())) == 2 and all(sides[k] == sides[k // 4 * 4] for k in range(8))
    assert {r.loyalty for r in cm.loyalty(labels, agreed).collect()} == {1.0}
    assert {r.p for r in cm.coassignment(labels).collect()} == {1.0}
    assert {r.node: r.tradition for r in cm.anchored(agreed, {0: 5}).collect()} == {k: 5 if k < 4 else -1 for k in range(8)}
    swapped = cm.rewired(nodes, edges, 3).collect()
    for g in range(3):
        e = [(r.src, r.dst) for r in swapped if r.graph == g]
        ends = sorted(x for p in e for x in p)
        assert len(set(e)) == 13 and all(a < b for a, b in e) and ends == sorted(x for r in edges.collect() for x in r)
    values = nodes.selectExpr("node", "cast(node as double) v", "node < 2 g")
    assert cm.permutation_test(values, "v", "g", 2000).first().p == pytest.approx(1 / 28, abs=0.02)


def test_bins_and_ccdf(spark):
    df = spark.createDataFrame([(k,) for k in (1, 1, 2, 6, 7, 9, 14)], "k long")
    assert ds.doubling_edges(14) == [1, 2, 3, 4, 5, 6, 7, 14]
    bins = {r.lo: r["count"] for r in ds.histogram(df, "k", ds.doubling_edges(14)).collect()}
    assert bins == {1: 2, 2: 1, 6: 1, 7: 3}
    last = ds.log_bins(df, "k").orderBy("bin").collect()[-1]
    assert last.y == pytest.approx(3 / 7) and last.x == pytest.approx(math.prod(range(7, 14)) ** (1 / 7))
    few = spark.createDataFrame([(6,), (7,)], "k long")
    assert [r["count"] for r in ds.histogram(few, "k", ds.doubling_edges(7)).collect()] == [2]
    assert {r.x: r.y for r in ds.ccdf(df, "k").collect()} == {1: 1.0, 2: round(5 / 7, 6), 6: round(4 / 7, 6), 7: round(3 / 7, 6), 9: round(2 / 7, 6), 14: round(1 / 7, 6)}
    assert ds.ba_edges_parameter(303, 1434) == 5
    assert ds.log_density(df, "k", 4).count() > 0 and ds.log_bins(df.filter("false"), "k").count() == 0


def test_powerlaw(spark):
    assert ds.zeta(2.0, np.array([1.0]))[0] == pytest.approx(math.pi**2 / 6, rel=1e-9)
    p = np.arange(5, 5000.0) ** -2.5 / ds.zeta(2.5, np.array([5.0]))[0]
    counts = np.round(p * 50_000).astype(int)
    rows = [(int(k), int(c)) for k, c in zip(range(5, 5000), counts) if c] + [(1, 3000), (2, 2900)]
    df = spark.createDataFrame(rows, "k long, c int").selectExpr("k", "explode(sequence(1, c)) x")
    best = ds.powerlaw_fit(df, "k").filter("chosen").first()
    assert best.xmin == 5 and best.alpha == pytest.approx(2.5, abs=0.03)
    lr = {r.alternative: (r.r, r.p) for r in ds.likelihood_ratio(df, "k", 5, best.alpha).collect()}
    assert lr["exponential"][0] > 100 and lr["exponential"][1] < 1e-6


def test_copying(spark):
    run12, run40 = " ".join(f"a{k}" for k in range(12)), " ".join(f"b{k}" for k in range(40))
    boiler = " ".join(f"z{k}" for k in range(8))
    rows = [(1, f"x1 {run40} y1 {run12} c1 {boiler}"), (2, f"{run40} q {run12} c2 {boiler}"), (3, f"{run12} w {boiler}")] + [(k, f"u{k} {boiler}") for k in range(4, 8)]
    shared = cp.postings(cp.shingles(spark.createDataFrame(rows, "doc_id long, text string")))
    runs = cp.shared_runs(shared)
    # the boilerplate is on more than five documents
    assert {(r.a, r.b, r.stop - r.start) for r in runs.collect()} == {(1, 2, 40), (2, 1, 40), (1, 2, 12), (2, 1, 12), (1, 3, 12), (3, 1, 12), (2, 3, 12), (3, 2, 12)}
    pairs = cp.copy_pairs(runs).collect()
    assert [(r.a, r.b, r.shared, r.passages, r.longest, r.start_a, r.kind) for r in pairs] == [(1, 2, 52, 2, 40, 1, "paragraph")]
    cover = cp.covered(runs, cp.copy_pairs(runs))
    assert cover.filter("doc_id = 1").count() == 52 and cover.filter("doc_id = 3").count() == 0


def test_similarity(spark):
    docs = spark.createDataFrame([(1, "Apple pie's crust apple tart"), (2, "apple Pie tart tart cake"), (3, "cake cake stone"), (4, "moss stone")], "doc long, text string")
    words = tf.words(docs)
    w = tf.weights(words, max_df=0.9)
    assert all(r.s == pytest.approx(1) for r in w.selectExpr("doc", "w * w q").groupBy("doc").sum("q").toDF("doc", "s").collect())
    cls = tf.classes(tf.word_stats(words))
    for r in tf.cosines(w, cls).collect():
        assert r.cos == pytest.approx(r.name_part + r.paper_part + r.story_part)
    total = tf.cosines(w).groupBy().sum("cos").first()[0]
    assert tf.term_mass(w).groupBy().sum("mass").first()[0] == pytest.approx(total)
    rows = spark.createDataFrame([(0.1, False), (0.4, True), (0.4, False), (0.9, True)], "s double, y boolean")
    assert tf.auc(rows, "s", "y").first().auc == pytest.approx(3.5 / 4)


def test_names(spark):
    rows = spark.createDataFrame([('Peter "P." Benjamin Parker', 1, "label", 1), ("Ed", 1, "label", 1), ("Jonathan Storm", 2, "title", 0)], "name string, node long, source string, ord int")
    nick = spark.createDataFrame([("Jonathan", "Johnny")], "first string, nick string")
    got = {(r.name, r.node): r.source for r in nm.candidates(rows, nick).collect()}
    assert got == {("Peter P. Benjamin Parker", 1): "label", ("Peter Parker", 1): "label/short", ("Jonathan Storm", 2): "title", ("Johnny Storm", 2): "title/nick"}
    cands = spark.createDataFrame([("Wolf", 1, "title"), ("Wolf", 2, "label"), ("Air Force", 3, "label"), ("Ghost", 4, "label"), ("Ghost", 5, "label"), ("Gone Far", 6, "label"), ("light", 7, "title")], "name string, node long, source string")
    targets = spark.createDataFrame([("Wolf", None), ("Gone Far", "Elsewhere"), ("Air Force", "2")], "name string, target string")
    stats = spark.createDataFrame([("light", 10, 1), ("ghost", 10, 9)], "term string, seen long, cap long")
    pages = spark.createDataFrame([(1, "comics"), (2, "Ultimate"), (3, None), (4, None), (5, None), (6, None), (7, None), (8, "Gwen"), (9, None)], "node long, qual string")
    cands = cands.union(spark.createDataFrame([("Gwen", 8, "title"), ("Justice", 9, "title")], cands.schema))
    targets = targets.union(spark.createDataFrame([("Gwen", "1")], targets.schema))
    picked = nm.resolve(cands, targets, stats, pages)
    by = {r.name: (r.pick, r.reason) for r in picked.collect()}
    assert by == {"Wolf": (1, "page title"), "Air Force": (2, "Wikipedia redirect"), "Ghost": (None, "shared codename"), "Gone Far": (None, "Wikipedia sends it elsewhere"), "light": (None, "common word or a title"), "Gwen": (None, "Wikipedia sends it elsewhere"), "Justice": (None, "read in the text: means someone else")}
    won = nm.share_out(picked, cands, spark.createDataFrame([(4, 9), (5, 3)], "node long, used long"))
    assert {r.name: (r.pick, r.reason) for r in won.collect()}["Ghost"] == (4, "shared codename; 9 vs 3 unambiguous uses")


def test_sentences_and_mentions(spark):
    docs = spark.createDataFrame([(1, 'Heading\nDr. Wolf met J. Storm. "He ran!" Then Wolf Hunter came.'), (2, None)], "doc long, text string")
    units = nm.sentences(docs)
    assert [r.text for r in units.orderBy("sid").collect()] == ["Dr. Wolf met J. Storm.", '"He ran!"', "Then Wolf Hunter came."]
    resolved = spark.createDataFrame([("Wolf", 1), ("Wolf Hunter", 2), ("Storm", 3), ("Hunter", 4)], "name string, pick long")
    found = nm.mentions(units, resolved)
    assert sorted((r.sid, r.who) for r in found.collect()) == [(1, 1), (1, 3), (3, 2)]
    assert {(r.a, r.b): r.named for r in nm.mention_pairs(found).collect()} == {(1, 3): 1, (1, 2): 1}
    rows = nm.kwic(docs, "wolf", around=6).collect()
    assert [r.hit for r in rows] == ["Wolf", "Wolf"] and rows[0].left.startswith("…")


def test_wikilinks(spark):
    text = "{{Infobox hero|ally=[[A]]}}\nSee [[B|the b]] and ''[[C]]'' <ref>[[D]]</ref>.\n* [[E]]\n== Life ==\n{| \n|[[F]]\n|}\n[[File:x.png|thumb|of [[G]]]] <gallery>\n[[H]]\n</gallery> [[Category:I]]"
    rows = lk.wikilinks(spark.createDataFrame([(9, text), (10, None)], "page long, wikitext string")).collect()
    assert {(r.target, r.shown, r.place, r.section) for r in rows} == {("A", "A", "infobox", "Lead"), ("B", "the b", "prose", "Lead"), ("C", "C", "italic title", "Lead"), ("D", "D", "reference", "Lead"), ("E", "E", "list", "Lead"), ("F", "F", "table", "Life"), ("G", "G", "image caption", "Life"), ("H", "H", "gallery", "Life")}
    links = spark.createDataFrame([(1, 0, 2, "infobox", "Lead"), (1, 1, 2, "prose", "Lead"), (1, 2, 3, "gallery", "Lead"), (1, 3, 4, "reference", "Lead"), (1, 4, 6, "prose", "In other media")], "page long, pos long, to long, place string, section string")
    links = links.withColumns({"target": F.col("to").cast("string"), "shown": F.concat(F.lit("S"), F.col("to")), "line": F.lit("a line")})
    pairs = spark.createDataFrame([(1, k) for k in (2, 3, 4, 5, 6)], "a long, b long")
    names = spark.createDataFrame([("S2", 7)], "name string, pick long")
    none = spark.createDataFrame([], "node long, name string")
    got = lk.why_unnamed(pairs, links, names, none, none)
    assert {r.b: r.reason for r in got.collect()} == {2: "a shared codename we give to another page", 3: "linked from other words", 4: "only in a comic title or a reference", 5: "missing from the snapshot source", 6: "only in In other media, which we leave out"}


def test_sources(spark, tmp_path):
    (tmp_path / "n.tsv").write_text("# a comment\nnode_id\tname\tdescription\turl\twikidata_id\nx\tX\tsaid \"so\tu\tQ1\ny\tY\t\t\t\n")
    got = readers.nodes_tsv(spark, str(tmp_path / "n.tsv"), quoted=False).orderBy("node_id").collect()
    assert [(r.node_id, r.description) for r in got] == [("x", 'said "so'), ("y", None)]
    (tmp_path / "e.tsv").write_text("# source\ttarget\nx\ty\ny\tx\n")
    assert readers.edges_tsv(spark, str(tmp_path / "e.tsv")).count() == 2
    (tmp_path / "w.tsv").write_text("source\ttarget\tweight\nx\ty\t3\n")
    assert readers.weighted_tsv(spark, str(tmp_path / "w.tsv")).first().weight == 3
    with zipfile.ZipFile(tmp_path / "p.zip", "w") as z:
        z.writestr("d/A%20b.txt", "é")
        z.writestr("d/README.txt", "no")
        z.writestr("d/c.md", "no")
    assert [tuple(r) for r in readers.zip_text(spark, str(tmp_path / "p.zip")).collect()] == [("A b", "é")]
    data = {"n1": {"label": "L", "aliases": ["a", "b"]}, "n2": {"label": None, "aliases": []}}
    (tmp_path / "a.json").write_text(json.dumps(data, indent=1))
    with gzip.open(tmp_path / "b.json.gz", "wt") as f:
        json.dump(data, f)
    for name in ("a.json", "b.json.gz"):
        rows = readers.aliases(spark, str(tmp_path / name)).collect()
        assert sorted((r.node, r.label or "", r.alias or "") for r in rows) == [("n1", "L", "a"), ("n1", "L", "b"), ("n2", "", "")]
    readers.write_json(spark.createDataFrame([(1,)], "k long"), str(tmp_path / "out"), gzip=True)
    assert spark.read.json(str(tmp_path / "out")).first().k == 1
    assert json.loads(readers.document(spark.createDataFrame([(1, [2])], "k long, v array<int>")).first().value) == {"k": 1, "v": [2]}


def test_stream(spark, tmp_path, tiny):
    tiny[1].repartition(3).write.parquet(str(tmp_path / "edges"))
    stream = spark.readStream.schema("src long, dst long").option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "edges"))
    q = sd.running_degrees(stream).writeStream.outputMode("complete").format("memory").queryName("deg").trigger(availableNow=True).start()
    q.awaitTermination(60)
    assert {r.node: (r.in_degree, r.out_degree) for r in spark.table("deg").collect()} == {1: (1, 1), 2: (1, 3), 3: (3, 1), 5: (0, 1), 6: (1, 0)}


def test_cosines_beyond_all_pairs(spark, monkeypatch):
    rng = np.random.default_rng(2)
    w = tf.weights(spark.createDataFrame([(k, " ".join(2 * c for c in rng.choice(list("abcdefgh"), 6).tolist())) for k in range(60)], "doc long, text string").transform(lambda df: tf.words(df.selectExpr("doc", "text")))).cache()
    all_pairs = {(r.i, r.j): r.cos for r in tf.both_ways(tf.cosines(w)).collect()}
    monkeypatch.setattr(tf, "MOST_PAIRED", 50)
    with pytest.raises(ValueError):
        tf.cosines(w)
    got = {(r.i, r.j): r.cos for r in tf.cosines_to(w, w.filter("doc % 10 = 0")).collect()}
    assert got == pytest.approx({k: v for k, v in all_pairs.items() if k[0] % 10 == 0}) and got


def test_runs_of_the_whole_graph(spark):
    """200 seeds over every node that has an edge, and 500 distinct pairs of them."""
    from weft.plans import base, networks

    d = "/root/testdata/sf0.001"
    nodes, labels = networks._all_runs(spark, d)
    ends = {n for r in base.weighted(spark, d).collect() for n in (r.src, r.dst)}
    assert labels.select("run").distinct().count() == 200 and labels.count() == 200 * len(ends) == 200 * nodes.count()
    pairs = cm.random_pairs(200, 500)
    assert len(set(pairs)) == 500 and all(a < b for a, b in pairs)
    got = {(r.a, r.b): r.nmi for r in cm.pair_nmi(labels, pairs[:3]).collect()}
    for a, b in pairs[:3]:
        one, two = (labels.filter(f"run = {k}").select("node", "community") for k in (a, b))
        assert got[a, b] == pytest.approx(graph.nmi(one, two).first()[0])


def test_mentions_with_guards_and_own_names(spark):
    text = "Read Amazing Wolf #12. Air Force One flew. Wolf saw Ann. The Wolf Pack came. Ann Storm-Two hid, and a storm rose. Storm-ready Wolf ran."
    units = nm.sentences(spark.createDataFrame([(1, text), (5, "Wolf is Ann. Ann naps.")], "doc long, text string"))
    resolved = spark.createDataFrame([("Wolf", 1), ("Force", 3), ("Ann", 4), ("Storm", 6)], "name string, pick long")
    own = spark.createDataFrame([(5, "Ann"), (1, "Wolf")], "node long, name string")
    stats = spark.createDataFrame([("force", 9, 2), ("wolf", 9, 9)], "term string, seen long, cap long")
    found = nm.mentions(units, resolved, own, stats, ["ann"])
    assert sorted((r.doc, r.sid, r.who, r.surface) for r in found.collect()) == [(1, 3, 1, "Wolf"), (1, 3, 4, "Ann"), (1, 6, 1, "Wolf"), (1, 6, 6, "Storm"), (5, 1, 1, "Wolf"), (5, 1, 5, "Ann"), (5, 2, 5, "Ann")]
    rows = {(r.a, r.b): r for r in nm.evidence(units, found, width=6).collect()}
    assert rows[1, 4].text == "…f saw Ann." and rows[1, 4].marks == [[7, 10]]
    assert {(r.a, r.b): (r.named, r.story) for r in nm.mention_pairs(found).collect()} == {(1, 4): (1, 1), (1, 6): (1, 1), (5, 1): (1, 1)}


def test_places_and_choices_by_brute_force(spark):
    """Places of names, the longest from the left and the longest of all, against patterns and loops in Python."""
    import random
    import re

    rng = random.Random(2)
    names = sorted({"".join(rng.choice("ab -Aé.") for _ in range(rng.randrange(1, 7))).strip(" -") for _ in range(60)} - {"", ".", ".."})
    texts = [(k, 1, "".join(rng.choice("ab -Aé.") for _ in range(40))) for k in range(150)]
    units = spark.createDataFrame(texts, "doc long, sid long, text string")
    resolved = spark.createDataFrame([(n, k) for k, n in enumerate(names)], "name string, pick long")
    worded = [n for n in names if re.search(r"\w", n)]
    edge = r"(?<![\w-]){}(?!\w|-[A-Z0-9])"
    found = nm.places(units, resolved)
    want = {(d, n, m.start()) for d, _, t in texts for n in worded for m in re.finditer("(?=" + edge.format(re.escape(n)) + ")", t)}
    assert {(r.doc, r.name, r.start) for r in found.collect()} == want and len(want) > 300
    first = nm.leftmost(nm.aliased(found, resolved), ["doc", "sid"])
    pattern = re.compile(edge.format("(?:" + "|".join(re.escape(n) for n in sorted(worded, key=len, reverse=True)) + ")"))
    assert {(r.doc, r.start, r.stop) for r in first.collect()} == {(d, *m.span()) for d, _, t in texts for m in pattern.finditer(t)}
    spans = [(k, a, a + rng.randrange(1, 6), rng.randrange(2), 9) for k in range(40) for a in rng.sample(range(12), 8)]
    chosen = {}
    for k, a, z, p, _ in sorted(spans, key=lambda s: (s[1] - s[2], -s[3], s[1])):
        if all(z <= x or y <= a for x, y in chosen.setdefault(k, [])):
            chosen[k].append((a, z))
    got = nm.longest(spark.createDataFrame(spans, "doc long, start long, stop long, prio int, who long"), ["doc"])
    assert {(r.doc, r.start, r.stop) for r in got.collect()} == {(k, a, z) for k, s in chosen.items() for a, z in s}


def test_nested_wikitext_against_a_tree():
    """Wikitext written from a random tree, and what is read of it against what the tree says."""
    import random

    rng = random.Random(7)

    def node(depth, inside):
        kind = rng.choice(["text", "link", "bare", "template", "ref", "italic"] if depth else ["text"])
        kids = [node(depth - 1, inside + [kind]) for _ in range(rng.randint(1, 3))] if kind not in ("text", "bare") else []
        return ("text" if kind == "italic" and "italic" in inside else kind), rng.choice(["ab", "c d", "x,", "é"]) + str(rng.randrange(99)), kids

    def written(n):
        kind, word, kids = n
        inner = "".join(map(written, kids))
        return {"text": word + " ", "bare": f"[[{word}]]", "link": f"[[{word}|{inner}]]", "template": f"{{{{t|{inner}}}}}", "ref": f"<ref>{inner}</ref>", "italic": f"<i>{inner}</i>"}[kind]

    def read(n):
        kind, word, kids = n
        return {"text": word + " ", "bare": word, "template": ""}.get(kind, "".join(map(read, kids)))

    def links(n, above):
        kind, word, kids = n
        kids = [] if kind == "text" else kids  # italics within italics are plain text
        name = {"link": "image caption", "template": "template", "ref": "reference", "italic": "italic title"}
        own = [(word, (read(n) if kind == "link" else word).strip(), above or "prose")] if kind in ("link", "bare") else []
        return own + [x for k in kids for x in links(k, above or name.get(kind))]

    for _ in range(300):
        tree = [node(4, []) for _ in range(3)]
        text = "".join(map(written, tree))
        got = lk.parse_wikitext("Start " + text + " end")
        want = [x for n in tree for x in links(n, None)]
        assert [(r[0], r[1], r[2]) for r in got] == want
        line = " ".join(("Start " + "".join(map(read, tree)) + " end").split())
        assert all(" ".join(r[4].split()) == line for r in got)


def test_components_of_paths_and_stars_take_few_rounds(spark, monkeypatch):
    n, rounds = 10_000, []
    keep = cc.written
    monkeypatch.setattr(cc, "written", lambda df, name: (rounds.append(name), keep(df, name))[1])
    path = spark.range(n).selectExpr("id a", "id + 1 b")
    star = spark.range(2000).selectExpr("20000 a", "20001 + id b")
    got = cc.components(path.union(star)).groupBy("component").count().collect()
    assert {(r.component, r["count"]) for r in got} == {(0, n + 1), (20_000, 2001)}
    assert rounds.count("parents") <= 2 * n.bit_length()


def test_ranks_over_ranges(spark):
    rows = spark.range(500).selectExpr("id", "id % 7 k").repartition(5)
    got = graph.ranked(rows, [F.desc("k"), F.asc("id")]).collect()
    want = {r[1]: i + 1 for i, r in enumerate(sorted((-(i % 7), i) for i in range(500)))}
    assert {r.id: r.rank for r in got} == want
