"""Verbatim copying between documents: token runs whose n-grams another document has too."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as tx
from ..functions.fixed import HEADING, LEAD, SECTIONS, WORDS
from ..storage import written

N = 8
MAX_PAGES = 5
MIN_PASSAGE = 12
MIN_EDGE = 30
PARAGRAPH = 40
WIDEST = 10
#: characters of text whose grams a task counts
DEALT = 1 << 22


def tokens(docs: DataFrame) -> DataFrame:
    """doc_id, pos, tok of the prose of docs (doc_id, text)."""
    return docs.select("doc_id", F.posexplode(tx.words(tx.body(F.col("text")))).alias("pos", "tok"))


def line_tokens(docs: DataFrame) -> DataFrame:
    """doc_id, block (line, from 0), pos (within the line), tok."""
    lines = docs.select("doc_id", F.posexplode(F.split("text", "\n")).alias("block", "line"))
    return lines.select("doc_id", "block", F.posexplode(tx.words(F.col("line"))).alias("pos", "tok"))


def _cuts(docs: DataFrame, text: Column, pattern: str) -> DataFrame:
    """doc_id, pos, hit, start, stop of the pattern's matches in a text: the stretches between them, which the pattern cuts the text into,
    and the matches add up to the places."""
    rows = docs.select("doc_id", F.split(text, pattern, -1).alias("gap"), F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("hit"))
    rows = rows.select("doc_id", F.posexplode(F.arrays_zip(F.expr("slice(gap, 1, size(hit))").alias("gap"), "hit")).alias("pos", "x")).select("doc_id", "pos", "x.gap", "x.hit")
    stop = F.sum(F.length("gap") + F.length("hit")).over(Window.partitionBy("doc_id").orderBy("pos"))
    return rows.select("doc_id", "pos", "hit", stop.alias("stop")).select("doc_id", "pos", "hit", (F.col("stop") - F.length("hit")).alias("start"), "stop")


def headings(docs: DataFrame) -> DataFrame:
    """doc_id, start, section: where the name of a heading that opens a section stands in the prose."""
    rows = _cuts(docs, tx.body(F.col("text")), HEADING)
    opens = F.lit(None).cast("string")
    for name, section in SECTIONS.items():
        opens = F.when(F.regexp_extract("hit", HEADING, 1) == name, section).otherwise(opens)
    return rows.select("doc_id", (F.col("start") + F.instr("hit", "\n\n\n") + 2).alias("start"), opens.alias("section")).filter("section is not null")


def spans(docs: DataFrame) -> DataFrame:
    """doc_id, pos, tok, start, stop, section: tokens of the prose of docs (doc_id, text) with their places in it, each in the section of
    the last heading that opens one before it or with it (an as-of join: both in one order)."""
    docs = docs.select("doc_id", "text").repartition("doc_id")  # texts go to their places once, and tokens stay where they are
    toks = _cuts(docs, F.lower(tx.body(F.col("text"))), WORDS)
    heads = headings(docs).select("doc_id", F.lit(None).cast("int").alias("pos"), F.lit(None).cast("string").alias("hit"), "start", F.lit(None).cast("long").alias("stop"), "section")
    both = toks.withColumn("section", F.lit(None).cast("string")).unionByName(heads)
    line = Window.partitionBy("doc_id").orderBy("start", F.col("pos").isNotNull())
    rows = both.withColumn("section", F.coalesce(F.last("section", ignorenulls=True).over(line), F.lit(LEAD)))
    return rows.filter("pos is not null").select("doc_id", "pos", F.col("hit").alias("tok"), "start", "stop", "section")


def shingles(docs: DataFrame, n: int = N) -> DataFrame:
    """doc_id, pos, gram of docs."""
    split = docs.select("doc_id", tx.words(tx.body(F.col("text"))).alias("t"))  # a step of its own: made once, not for each gram
    return split.select("doc_id", F.posexplode(tx.ngrams(F.col("t"), n)).alias("pos", "gram"))


def hashed_shingles(docs: DataFrame, n: int = N) -> DataFrame:
    """As shingles, each gram as two 64-bit hashes: a third of the bytes to shuffle, and 128 bits to agree by chance."""
    split = docs.select("doc_id", F.transform(tx.words(tx.body(F.col("text"))), lambda w: F.xxhash64(w)).alias("t")).filter(F.size("t") >= n)
    part = lambda i: F.slice("t", i + 1, n)
    grams = F.transform(F.sequence(F.lit(0), F.size("t") - n), lambda i: F.struct(F.xxhash64(part(i)).alias("x"), F.xxhash64(F.lit(n), part(i)).alias("y")))
    return split.select("doc_id", F.posexplode(grams).alias("pos", "gram"))


def _places(docs: DataFrame, n: int) -> DataFrame:
    """hashed_shingles as flat rows (doc_id, pos, x, y): half of a struct's bytes to shuffle."""
    return hashed_shingles(docs, n).select("doc_id", "pos", "gram.x", "gram.y")


def shingle_index(grams: DataFrame) -> DataFrame:
    """gram, df: the number of documents that have it."""
    return grams.select("gram", "doc_id").distinct().groupBy("gram").agg(F.count("*").alias("df"))


def document_counts(docs: DataFrame, n: int = N) -> DataFrame:
    """x, y, df, place of each gram of docs (doc_id, text), by its hashes: how many documents have it, and the first place of the first of
    them. Grams are dealt out once, by all of their bits, to as many tasks as the text asks for, so that what a task counts needn't spill."""
    size = docs.agg(F.sum(F.length("text")).alias("n")).first().n or 0
    parts = min(8192, max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), size // DEALT + 1))
    per = _places(docs, n).repartition(parts, "x", "y").groupBy("x", "y", "doc_id").agg(F.min("pos").alias("pos"))
    return per.groupBy("x", "y").agg(F.count("*").alias("df"), F.min(F.struct("doc_id", "pos")).alias("place"))


def grams_on(docs: DataFrame, low: int, high: int, n: int = N) -> DataFrame:
    """gram, df of the grams on low to high documents: found by their hashes, and read again at one place of each."""
    found = document_counts(docs, n).filter(F.col("df").between(low, high)).select("place.doc_id", F.struct("place.pos", "x", "y", "df").alias("at"))
    found = found.groupBy("doc_id").agg(F.collect_list("at").alias("every"))  # at most a document's grams
    rows = docs.join(found, "doc_id").select(tx.words(tx.body(F.col("text"))).alias("t"), "every").select("t", F.explode("every").alias("at"))
    rows = rows.select(F.slice("t", F.col("at.pos") + 1, F.lit(n)).alias("w"), "at.*")
    # a doc_id that several rows have: only the row whose gram it is
    rows = rows.filter((F.size("w") == n) & (F.xxhash64(F.transform("w", lambda w: F.xxhash64(w))) == F.col("x")))
    return rows.groupBy("x", "y").agg(F.min(F.array_join("w", " ")).alias("gram"), F.min("df").alias("df")).select("gram", "df")


def postings(grams: DataFrame, widest: int = WIDEST) -> DataFrame:
    """grams with df of those on 2 to widest documents; the rest (most of them) drop out before any join."""
    shared = shingle_index(grams).filter(F.col("df").between(2, widest))
    return grams.join(shared, "gram")


def shared_places(docs: DataFrame, widest: int = WIDEST, n: int = N) -> DataFrame:
    """As postings of hashed_shingles: doc_id, pos, gram, df of the grams of docs (doc_id, text), as two hashes, that 2 to widest documents have; the rest (most of them) drop
    out before any join. All places are dealt out once, and documents are counted where a gram's places meet."""
    gram = Window.partitionBy("x", "y")
    nth = _places(docs, n).withColumn("nth", F.dense_rank().over(gram.orderBy("doc_id")))
    shared = nth.withColumn("df", F.max("nth").over(gram).cast("long")).filter(F.col("df").between(2, widest))
    return shared.select("doc_id", "pos", F.struct("x", "y").alias("gram"), "df")


def candidates(shared: DataFrame) -> DataFrame:
    """a < b: documents with a common gram. A gram has widest documents at most, so its pairs are bounded."""
    docs = shared.select("gram", "doc_id").distinct()
    return docs.withColumnRenamed("doc_id", "a").join(docs.withColumnRenamed("doc_id", "b"), "gram").filter("a < b").select("a", "b").distinct()


def shared_runs(shared: DataFrame, n: int = N, max_pages: int = MAX_PAGES, min_passage: int = MIN_PASSAGE) -> DataFrame:
    """a, b, start, stop: maximal runs of tokens of a that grams on at most max_pages documents cover, all of them on b as well.
    Runs are contiguous on a only."""
    few = shared.filter(F.col("df") <= max_pages)
    others = few.select("gram", F.col("doc_id").alias("b")).distinct()
    hits = few.select(F.col("doc_id").alias("a"), "pos", "gram").join(others, "gram").filter("a <> b").select("a", "b", "pos").distinct()
    island = hits.withColumn("island", F.col("pos") - F.row_number().over(Window.partitionBy("a", "b").orderBy("pos")))
    runs = island.groupBy("a", "b", "island").agg(F.min("pos").cast("long").alias("start"), (F.max("pos") + n).cast("long").alias("stop"))
    return runs.filter(F.col("stop") - F.col("start") >= min_passage).select("a", "b", "start", "stop")


def copy_pairs(runs: DataFrame, min_edge: int = MIN_EDGE) -> DataFrame:
    """a < b, shared, passages, longest, start_a, copied_a, copied_b, kind of pairs with min_edge copied tokens on either side."""
    size = F.col("stop") - F.col("start")
    per = runs.groupBy("a", "b").agg(F.sum(size).alias("copied"), F.count("*").alias("passages"), F.max(size).alias("longest"), F.expr("min_by(start, struct(start - stop, start))").alias("first"))
    one = per.filter("a < b").select("a", "b", F.col("copied").alias("copied_a"), "passages", "longest", F.col("first").alias("start_a"))
    two = per.filter("a > b").select(F.col("b").alias("a"), F.col("a").alias("b"), F.col("copied").alias("copied_b"))
    both = one.join(two, ["a", "b"]).filter(F.least("copied_a", "copied_b") >= min_edge)
    kind = F.when(F.col("longest") >= PARAGRAPH, "paragraph").otherwise("phrase")
    return both.select("a", "b", F.bround((F.col("copied_a") + F.col("copied_b")) / 2).cast("long").alias("shared"), "passages", "longest", "start_a", "copied_a", "copied_b", kind.alias("kind"))


def evidence(docs: DataFrame, runs: DataFrame, pairs: DataFrame, links: DataFrame) -> DataFrame:
    """a, b, share_a, share_b, section_a, section_b, text, linked, a_links_b, b_links_a of pairs: copied shares of both documents' tokens, the
    sections in which the longest runs begin (of equal ones the first), a's longest run as it stands in its prose with line feeds as
    spaces, and what links (src, dst) there are. Only documents of pairs are cut into tokens."""
    ends = pairs.select(F.col("a").alias("doc_id")).union(pairs.select("b")).distinct()
    own = docs.join(ends, "doc_id", "left_semi")
    toks = written(spans(own), "spans")
    many = toks.groupBy("doc_id").agg(F.count("*").alias("tokens"))
    first_b = runs.filter("a > b").groupBy(F.col("a").alias("b"), F.col("b").alias("a")).agg(F.expr("min_by(start, struct(start - stop, start))").alias("start_b"))
    rows = pairs.join(first_b, ["a", "b"])
    at = lambda side, pos, *cols: toks.select(F.col("doc_id").alias(side), F.col("pos").cast("long").alias(pos), *cols)
    rows = rows.withColumn("last_a", F.expr("start_a + longest - 1")).join(at("a", "start_a", F.col("start").alias("low"), F.col("section").alias("section_a")), ["a", "start_a"])
    rows = rows.join(at("a", "last_a", F.col("stop").alias("high")), ["a", "last_a"]).join(at("b", "start_b", F.col("section").alias("section_b")), ["b", "start_b"])
    for side in ("a", "b"):
        rows = rows.join(many.select(F.col("doc_id").alias(side), F.col("tokens").alias(f"tokens_{side}")), side)
    rows = rows.join(own.select(F.col("doc_id").alias("a"), tx.body(F.col("text")).alias("body")), "a")
    one = links.select(F.col("src").alias("a"), F.col("dst").alias("b")).distinct()
    rows = rows.join(one.withColumn("a_links_b", F.lit(True)), ["a", "b"], "left").join(one.select(F.col("a").alias("b"), F.col("b").alias("a"), F.lit(True).alias("b_links_a")), ["a", "b"], "left")
    rows = rows.na.fill(False, ["a_links_b", "b_links_a"])
    text = F.translate(F.expr("substr(body, cast(low as int) + 1, cast(high - low as int))"), "\n", " ")
    return rows.select("a", "b", (F.col("copied_a") / F.col("tokens_a")).alias("share_a"), (F.col("copied_b") / F.col("tokens_b")).alias("share_b"), "section_a", "section_b", text.alias("text"), F.expr("a_links_b or b_links_a linked"), "a_links_b", "b_links_a")


def section_shares(toks: DataFrame, cover: DataFrame, only: DataFrame | None = None) -> DataFrame:
    """section, tokens, copied: tokens (spans) by section, of the documents of only (doc_id) if given, and copied ones of all documents."""
    some = toks.join(only.select("doc_id"), "doc_id", "left_semi") if only is not None else toks
    every = some.groupBy("section").agg(F.count("*").alias("tokens"))
    copied = toks.join(cover.select("doc_id", "pos"), ["doc_id", "pos"], "left_semi").groupBy("section").agg(F.count("*").alias("copied"))
    return every.join(copied, "section", "full").na.fill(0, ["tokens", "copied"])


def graph_rates(pairs: DataFrame, links: DataFrame, nodes: DataFrame) -> DataFrame:
    """edges, linked, both_ways, density of the graph of copying pairs (a < b): shares of its edges with a link (src, dst) in either direction
    and in both, and its edges among all pairs of nodes."""
    way = lambda src, dst: links.select(F.col("src").alias(src), F.col("dst").alias(dst)).distinct()
    rows = pairs.select("a", "b").join(way("a", "b").withColumn("ab", F.lit(1)), ["a", "b"], "left").join(way("b", "a").withColumn("ba", F.lit(1)), ["a", "b"], "left")
    rows = rows.agg(F.count("*").alias("edges"), F.avg(F.expr("if(ab = 1 or ba = 1, 1d, 0d)")).alias("linked"), F.avg(F.expr("if(ab = 1 and ba = 1, 1d, 0d)")).alias("both_ways"))
    n = nodes.agg(F.count("*").alias("n"))
    return rows.join(n).select("edges", "linked", "both_ways", F.expr("if(n > 1, edges / (n * (n - 1) / 2), 0d) density"))


def covered(runs: DataFrame, pairs: DataFrame) -> DataFrame:
    """doc_id, pos: the union of copied positions of accepted pairs."""
    accepted = pairs.select("a", "b").union(pairs.select("b", "a"))
    return runs.join(accepted, ["a", "b"]).select(F.col("a").alias("doc_id"), F.explode(F.expr("sequence(start, stop - 1)")).alias("pos")).distinct()


def borrowed(cover: DataFrame, token_counts: DataFrame) -> DataFrame:
    """doc_id, tokens, copied, share."""
    c = cover.groupBy("doc_id").agg(F.count("*").alias("copied"))
    return token_counts.join(c, "doc_id", "left").na.fill(0, ["copied"]).withColumn("share", F.expr("if(tokens > 0, copied / tokens, 0d)"))
