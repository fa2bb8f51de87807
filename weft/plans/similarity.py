"""Queries on TF-IDF similarity. The benchmark's items are the documents whose pairs are all compared; long ones stand for paperwork.
Those named ..._documents run over the documents table; there, each document whose doc_id is divisible by 50 is compared with all."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import text as tx
from ..operators import paths
from ..operators import tfidf as tf
from ..storage import written
from . import base as b
from .registry import query

WORDS = "ws as (select item_id doc, length(text) > 240 long, unnest(list_transform(regexp_extract_all(text, '[A-Za-z]+(?:[''’][A-Za-z]+)*'), lambda z: regexp_replace(z, '[''’]s$', ''))) word from benchmark)"
STATS = "stats as (select lower(word) term, count(*) seen, count(*) filter (regexp_matches(word, '^[A-Z]')) cap, count(*) filter (long) in_paper from ws group by 1)"
CLS = "cls as (select term, case when cap > 0.5 * seen then 0 when in_paper / seen > 0.7 then 1 else 2 end cls from stats)"


def weights_sql(sublinear=False):
    value = "(1 + ln(tf))" if sublinear else "tf"
    return f"""nd as (select count(distinct doc) n from ws), tfs as (select doc, lower(word) term, count(*) tf from ws where length(word) > 1 group by all),
  dfs as (select term, count(*) df from tfs, nd group by term, n having count(*) >= 2 and count(*) <= 0.5 * n),
  raw as (select doc, term, {value} * (ln((1 + n) / (1 + df)) + 1) v from tfs join dfs using (term), nd), nrm as (select doc, sqrt(sum(v * v)) nv from raw group by doc),
  w as (select doc, term, v / nv w from raw join nrm using (doc))"""


W = weights_sql()
COS = "co as (select x.doc i, y.doc j, sum(x.w * y.w) cos, sum(case when cls = 0 then x.w * y.w else 0 end) name_part, sum(case when cls = 1 then x.w * y.w else 0 end) paper_part, sum(case when cls = 2 then x.w * y.w else 0 end) story_part from w x join w y on x.term = y.term and x.doc < y.doc join cls on cls.term = x.term group by all)"
BOTH = "bo as (select i, j, cos, name_part, story_part from co union all select j, i, cos, name_part, story_part from co)"
NN = "nn as (select * from (select *, row_number() over (partition by i order by round(cos, 9) desc, j) rank from bo) where rank <= {})"


def _items(spark, d):
    return b.read(spark, d, "benchmark").select(F.col("item_id").alias("doc"), "text", (F.length("text") > 240).alias("long"))


def _words(spark, d):
    return tf.words(_items(spark, d))


def _weights(spark, d, **kw):
    return written(tf.weights(_words(spark, d), **kw), "weights")


def _classes(spark, d, **kw):
    return tf.classes(tf.word_stats(_words(spark, d), "long"), **kw)


def _pairs(spark, d):
    return written(tf.cosines(_weights(spark, d), _classes(spark, d)), "pairs")


def _rounded(df, *names):
    return df.withColumns({n: F.round(n, 6) for n in names})


@query("t_tokens_w6", b.sql(WORDS, "select doc, count(*) n, min(word) first_word, max(word) last_word from ws group by doc"))
def t_tokens_w6(spark, d):
    return _words(spark, d).groupBy("doc").agg(F.count("*").alias("n"), F.min("word").alias("first_word"), F.max("word").alias("last_word"))


@query("agg_word_stats", b.sql(WORDS, STATS, "select * from stats"))
def agg_word_stats(spark, d):
    return tf.word_stats(_words(spark, d), "long")


@query("agg_word_stats_w7", "with w as (select unnest(regexp_extract_all(text, '[A-Za-z][A-Za-z''-]*')) word from documents) select lower(word) term, count(*) seen, count(*) filter (regexp_matches(word, '^[A-Z]')) cap from w group by 1")
def agg_word_stats_w7(spark, d):
    rows = b.read(spark, d, "documents").select(F.explode(tx.capitals(F.col("text"))).alias("word"))
    return tf.word_stats(rows).drop("in_paper")


@query("t_class", b.sql(WORDS, STATS, CLS, "select term, cast(cls as int) cls from cls"))
def t_class(spark, d):
    return _classes(spark, d)


@query("t_tfidf", b.sql(WORDS, W, "select doc, term, round(w, 6) w from w"))
def t_tfidf(spark, d):
    return _rounded(tf.weights(_words(spark, d)), "w")


@query("t_tfidf_documents", b.sql(WORDS.replace("item_id doc", "doc_id doc").replace("from benchmark", "from documents"), W, "select doc, count(*) terms, round(max(w), 6) top from w group by doc"))
def t_tfidf_documents(spark, d):
    docs = b.read(spark, d, "documents").select(F.col("doc_id").alias("doc"), "text")
    return tf.weights(tf.words(docs)).groupBy("doc").agg(F.count("*").alias("terms"), F.round(F.max("w"), 6).alias("top"))


@query("flt_vocab", b.sql(WORDS, W, "select term, df from dfs"))
def flt_vocab(spark, d):
    return tf.weights(_words(spark, d)).groupBy("term").agg(F.count("*").alias("df"))


@query("jn_term", b.sql(WORDS, STATS, CLS, W, COS, "select i, j, round(cos, 6) cos from co"))
def jn_term(spark, d):
    return _rounded(tf.cosines(_weights(spark, d)), "cos")


@query("t_cosine_split", b.sql(WORDS, STATS, CLS, W, COS, "select i, j, round(cos, 6) cos, round(name_part, 6) name_part, round(paper_part, 6) paper_part, round(story_part, 6) story_part from co"))
def t_cosine_split(spark, d):
    return _rounded(_pairs(spark, d), "cos", "name_part", "paper_part", "story_part")


_OWN = "own as (select doc, term, w from w join cls using (term) where cls = {}), on2 as (select doc, greatest(sqrt(sum(w * w)), 1e-12) n2 from own group by doc), re as (select doc, term, w / n2 w from own join on2 using (doc))"


@query("t_story_cos", b.sql(WORDS, STATS, CLS, W, _OWN.format(2), "select x.doc i, y.doc j, round(sum(x.w * y.w), 6) cos from re x join re y on x.term = y.term and x.doc < y.doc group by all"))
def t_story_cos(spark, d):
    return _rounded(tf.cosines(tf.renormalised(_weights(spark, d), _classes(spark, d), tf.STORY)), "cos")


@query("t_name_cos", b.sql(WORDS, STATS, CLS, W, _OWN.format(0), "select x.doc i, y.doc j, round(sum(x.w * y.w), 6) cos from re x join re y on x.term = y.term and x.doc < y.doc group by all"))
def t_name_cos(spark, d):
    return _rounded(tf.cosines(tf.renormalised(_weights(spark, d), _classes(spark, d), tf.NAME)), "cos")


@query("win_argmax", b.sql(WORDS, STATS, CLS, W, COS, BOTH, NN.format(1), "select i, j, round(cos, 6) cos from nn"))
def win_argmax(spark, d):
    return _rounded(tf.nearest(_pairs(spark, d)).select("i", "j", "cos"), "cos")


@query("win_topk", b.sql(WORDS, STATS, CLS, W, COS, BOTH, NN.format(8), "select i, j, rank, round(cos, 6) cos from nn"))
def win_topk(spark, d):
    return _rounded(tf.nearest(_pairs(spark, d), 8).select("i", "j", "rank", "cos"), "cos")


@query("t_nn_summary", b.sql(WORDS, STATS, CLS, W, COS, BOTH, NN.format(1), "select round(quantile_cont(name_part / cos, 0.5), 6) name_median, round(avg(case when name_part / cos > 0.5 then 1.0 else 0.0 end), 6) name_majority, (select round(sum(name_part) / sum(cos), 6) from co) name_mass, (select round(sum(story_part) / sum(cos), 6) from co) story_mass from nn"))
def t_nn_summary(spark, d):
    pairs = _pairs(spark, d)
    one = tf.nearest(pairs).agg(F.round(F.expr("percentile(name_part / cos, 0.5)"), 6).alias("name_median"), F.round(F.avg(F.expr("if(name_part / cos > 0.5, 1d, 0d)")), 6).alias("name_majority"))
    return one.join(pairs.agg(F.round(F.sum("name_part") / F.sum("cos"), 6).alias("name_mass"), F.round(F.sum("story_part") / F.sum("cos"), 6).alias("story_mass")))


@query("agg_mass", b.sql(WORDS, STATS, CLS, W, COS, "select round(sum(name_part) / sum(cos), 6) name, round(sum(paper_part) / sum(cos), 6) paper, round(sum(story_part) / sum(cos), 6) story from co"))
def agg_mass(spark, d):
    return _pairs(spark, d).agg(*[F.round(F.sum(f"{c}_part") / F.sum("cos"), 6).alias(c) for c in ("name", "paper", "story")])


@query("agg_term_mass", b.sql(WORDS, W, "select term, round((pow(sum(w), 2) - sum(w * w)) / 2, 6) mass from w group by term"))
def agg_term_mass(spark, d):
    return _rounded(tf.term_mass(_weights(spark, d)), "mass")


@query("top_words_class", b.sql(WORDS, STATS, CLS, W, "m as (select term, round((pow(sum(w), 2) - sum(w * w)) / 2, 6) mass from w group by term), r as (select cls, term, mass, row_number() over (partition by cls order by mass desc, term) rank from m join cls using (term))", "select cast(cls as int) cls, term, mass, rank from r where rank <= 15"))
def top_words_class(spark, d):
    m = _rounded(tf.term_mass(_weights(spark, d)), "mass").join(_classes(spark, d), "term")
    return m.withColumn("rank", F.row_number().over(Window.partitionBy("cls").orderBy(F.desc("mass"), "term"))).filter("rank <= 15").select("cls", "term", "mass", "rank")


_PRODUCTS = "prod as (select n.i, n.j, x.term, x.w * y.w p from nn n join w x on x.doc = n.i join w y on y.doc = n.j and y.term = x.term), topt as (select * from (select *, row_number() over (partition by i, j order by round(p, 9) desc, term) r from prod) where r <= 14)"


@query("top_terms", b.sql(WORDS, STATS, CLS, W, COS, BOTH, NN.format(1), _PRODUCTS, "select i, j, term, round(p, 6) p, r as rank from topt"))
def top_terms(spark, d):
    return _rounded(tf.term_products(_weights(spark, d), tf.nearest(_pairs(spark, d))), "p")


@query("agg_neff", b.sql(WORDS, STATS, CLS, W, COS, BOTH, NN.format(1), _PRODUCTS, "select i, j, round(case when sum(case when cls = 0 then p else 0 end) > 0 then pow(sum(case when cls = 0 then p else 0 end), 2) / sum(case when cls = 0 then p * p else 0 end) else 0 end, 6) neff from topt join cls using (term) group by i, j"))
def agg_neff(spark, d):
    return _rounded(tf.effective_terms(tf.term_products(_weights(spark, d), tf.nearest(_pairs(spark, d))), _classes(spark, d)), "neff")


@query("js_one_many", b.sql(WORDS, STATS, CLS, W, COS, BOTH, NN.format(1), _PRODUCTS, "ne as (select least(i, j) a, greatest(i, j) b, max(round(case when sum(case when cls = 0 then p else 0 end) > 0 then pow(sum(case when cls = 0 then p else 0 end), 2) / sum(case when cls = 0 then p * p else 0 end) else 0 end, 6)) over (partition by least(i, j), greatest(i, j)) neff from topt join cls using (term) group by i, j), u as (select distinct a, b, neff, neff > 1.5 many from ne)", "select a, b, neff, many from (select *, row_number() over (partition by many order by neff desc, a, b) r from u) where r <= 6"))
def js_one_many(spark, d):
    rows = agg_neff(spark, d).select(F.least("i", "j").alias("a"), F.greatest("i", "j").alias("b"), "neff").groupBy("a", "b").agg(F.max("neff").alias("neff")).withColumn("many", F.col("neff") > 1.5)
    return rows.withColumn("r", F.row_number().over(Window.partitionBy("many").orderBy(F.desc("neff"), "a", "b"))).filter("r <= 6").drop("r")


@query("top_story_pairs", b.sql(WORDS, STATS, CLS, W, _OWN.format(2), "c3 as (select x.doc i, y.doc j, round(sum(x.w * y.w), 6) cos from re x join re y on x.term = y.term and x.doc < y.doc group by all)", "select * from c3 order by cos desc, i, j limit 300"))
def top_story_pairs(spark, d):
    return t_story_cos(spark, d).orderBy(F.desc("cos"), "i", "j").limit(300)


@query("set_pairs_union", b.sql(WORDS, STATS, CLS, W, COS, BOTH, NN.format(5), "t as (select i, j from co order by round(cos, 6) desc, i, j limit 300)", "select least(i, j) i, greatest(i, j) j from nn union select i, j from t"))
def set_pairs_union(spark, d):
    pairs = _pairs(spark, d)
    top = pairs.orderBy(F.desc(F.round("cos", 6)), "i", "j").limit(300).select("i", "j")
    return tf.nearest(pairs, 5).select(F.least("i", "j").alias("i"), F.greatest("i", "j").alias("j")).union(top).distinct()


@query("js_twins", b.sql(WORDS, STATS, CLS, W, _OWN.format(2), "c3 as (select x.doc i, y.doc j, round(sum(x.w * y.w), 6) cos from re x join re y on x.term = y.term and x.doc < y.doc group by all)", "select i, j, cos from c3 where j <> i + 1 order by cos desc, i, j limit 20"))
def js_twins(spark, d):
    """The most alike by their story of those that aren't linked; an item is linked to the next one."""
    c = _rounded(tf.cosines(tf.renormalised(_weights(spark, d), _classes(spark, d), tf.STORY)), "cos")
    linked = b.read(spark, d, "benchmark").select(F.col("item_id").alias("i"), (F.col("item_id") + 1).alias("j"))
    return c.join(linked, ["i", "j"], "left_anti").select("i", "j", "cos").orderBy(F.desc("cos"), "i", "j").limit(20)


@query("t_stop", b.sql(WORDS.replace("ws as (", "w0 as ("), "ws as (select * from w0 where lower(word) not in ('the', 'and', 'of', 'to'))", W, "select doc, count(*) terms, round(max(w), 6) top from w group by doc"))
def t_stop(spark, d):
    stop = spark.createDataFrame([("the",), ("and",), ("of",), ("to",)], "term string")
    return tf.weights(_words(spark, d), stop).groupBy("doc").agg(F.count("*").alias("terms"), F.round(F.max("w"), 6).alias("top"))


_GENDERED = ["that", "is", "in"]
_STORY = "sw as (select w.* from w join cls using (term) where cls = 2), sq as (select doc, greatest(sqrt(sum(w * w)), 1e-12) n from sw group by doc), st as (select doc, term, w / n w from sw join sq using (doc)), gw as (select * from st where term not in ('that', 'is', 'in')), gq as (select doc, sqrt(sum(w * w)) n from gw group by doc), g3 as (select doc, term, w / n w from gw join gq using (doc))"
_SEX = "sx as (select item_id doc, case when f > 2 * m then 'F' when m > 2 * f then 'M' else '?' end sex from (select item_id, len(list_filter(t, lambda z: z in ('the', 'that', 'in'))) f, len(list_filter(t, lambda z: z in ('of', 'and'))) m from (select item_id, regexp_extract_all(lower(text), '[a-z0-9]+(?:''[a-z]+)?') t from benchmark)))"
_NEAR = "{0}c as (select x.doc i, y.doc j, sum(x.w * y.w) cos from {1} x join {1} y on x.term = y.term and x.doc <> y.doc group by all), {0}n as (select i, j from (select *, row_number() over (partition by i order by round(cos, 9) desc, j) r from {0}c) where r = 1)"


def _sexes(spark, d):
    rows = b.read(spark, d, "benchmark").select(F.col("item_id").alias("doc"), tx.words(F.col("text")).alias("t"))
    count = lambda words: F.size(F.filter("t", lambda z: z.isin(words)))
    f, m = count(["the", "that", "in"]), count(["of", "and"])
    return rows.select("doc", F.when(f > 2 * m, "F").when(m > 2 * f, "M").otherwise("?").alias("sex"))


def _without(w, terms):
    left = w.filter(~F.col("term").isin(terms))
    norm = left.groupBy("doc").agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("norm"))
    return left.join(norm, "doc").select("doc", "term", (F.col("w") / F.col("norm")).alias("w"))


_RATE = "(select round(count(*) filter (y.sex = 'F') / (select count(*) from sx where sex = 'F'), 6) from {0}n join sx x on x.doc = i join sx y on y.doc = j where x.sex = 'F') {1}"


@query("t_gender_nn", b.sql(WORDS, STATS, CLS, W, _STORY, _SEX, _NEAR.format("r", "w"), _NEAR.format("s", "st"), _NEAR.format("g", "g3"), "select round((count(*) filter (sex = 'F') - 1) / (count(*) - 1), 6) chance, " + ", ".join(_RATE.format(k, n) for k, n in (("r", "raw"), ("s", "story"), ("g", "without_words"))) + " from sx"))
def t_gender_nn(spark, d):
    """Of the documents of one side: how many have their nearest on it too, by all terms, by story, and without some words."""
    w, cls, sex = _weights(spark, d), _classes(spark, d), _sexes(spark, d)
    story = written(tf.renormalised(w, cls, tf.STORY), "story")
    out = sex.agg(F.round((F.count_if(F.col("sex") == "F") - 1) / (F.count("*") - 1), 6).alias("chance"), F.count_if(F.col("sex") == "F").alias("n"))
    for name, own in (("raw", w), ("story", story), ("without_words", _without(story, _GENDERED))):
        near = tf.nearest(tf.cosines(own)).select("i", "j")
        hit = near.join(sex.filter("sex = 'F'").select(F.col("doc").alias("i")), "i", "left_semi").join(sex.filter("sex = 'F'").select(F.col("doc").alias("j")), "j", "left_semi")
        out = out.join(hit.agg(F.count("*").alias("hits"))).withColumn(name, F.round(F.col("hits") / F.col("n"), 6)).drop("hits")
    return out.drop("n")


@query("agg_ff_terms", b.sql(WORDS, STATS, CLS, W, _STORY, _SEX, _NEAR.format("s", "st"), "ff as (select i, j from sn join sx x on x.doc = i join sx y on y.doc = j where x.sex = 'F' and y.sex = 'F')", "pr as (select i, term, a.w * c.w p from ff join st a on a.doc = i join st c using (term) where c.doc = j), tp as (select *, row_number() over (partition by i order by round(p, 9) desc, term) r from pr)", "select term, round(sum(p), 6) mass from tp where r <= 10 group by term order by round(sum(p), 6) desc, term limit 16"))
def agg_ff_terms(spark, d):
    """The terms that bring documents of one side together: of each nearest pair the ten largest products, then sixteen by their sum."""
    sex = _sexes(spark, d).filter("sex = 'F'")
    story = written(tf.renormalised(_weights(spark, d), _classes(spark, d), tf.STORY), "story")
    near = tf.nearest(tf.cosines(story)).select("i", "j").join(sex.select(F.col("doc").alias("i")), "i", "left_semi").join(sex.select(F.col("doc").alias("j")), "j", "left_semi")
    return tf.term_products(story, near, 10).groupBy("term").agg(F.round(F.sum("p"), 6).alias("mass")).orderBy(F.desc("mass"), "term").limit(16)


@query("t_pair_export", b.sql(WORDS, STATS, CLS, W, COS, BOTH, NN.format(1), _PRODUCTS, "select i, j, any_value(round(cos, 6)) cos, list(term order by r) terms from topt join nn using (i, j) group by i, j"))
def t_pair_export(spark, d):
    """Each document's nearest, with the terms that make it so, as one row."""
    w, near = _weights(spark, d), written(tf.nearest(_pairs(spark, d)).select("i", "j", F.round("cos", 6).alias("cos")), "near")
    terms = tf.term_products(w, near).groupBy("i", "j").agg(F.expr("transform(array_sort(collect_list(struct(rank, term))), x -> x.term)").alias("terms"))
    return near.join(terms, ["i", "j"])


#: items are linked to the next one and to the fifth after them; how far apart they are, by levels until there is no new item
_HOPS = """near1 as (select x.item_id a, y.item_id b from benchmark x join benchmark y on abs(x.item_id - y.item_id) in (1, 5)),
  walked(i, found, seen, d) as (select distinct item_id, [item_id], [item_id], cast(0 as bigint) from benchmark
    union all select i, fresh, list_concat(seen, fresh), d + 1 from (select i, seen, d, list_filter(ends, lambda z: not list_contains(seen, z)) fresh from (select w.i, any_value(w.seen) seen, any_value(w.d) d, list(distinct e.b) ends from (select i, unnest(found) j, seen, d from walked) w join near1 e on e.a = w.j group by w.i)) where len(fresh) > 0),
  far as (select i, unnest(found) j, d from walked)"""
_SPLIT = "co4 as (select i, j, cos, name_part, paper_part, story_part from co union all select j, i, cos, name_part, paper_part, story_part from co), rk4 as (select *, row_number() over (partition by i order by round(cos, 9) desc, j) rank from co4), sc4 as (select x.doc i, y.doc j, sum(x.w * y.w) cos from st x join st y on x.term = y.term and x.doc <> y.doc group by all), sk4 as (select *, row_number() over (partition by i order by round(cos, 9) desc, j) rank from sc4)"
_SIMILAR = (WORDS, STATS, CLS, W, COS, _STORY, _SPLIT, _HOPS)


def _distances(spark, d):
    items = b.read(spark, d, "benchmark").select(F.col("item_id").alias("node")).distinct()
    edges = items.select(F.col("node").alias("src"), F.explode(F.array(F.col("node") + 1, F.col("node") + 5)).alias("dst")).join(items.withColumnRenamed("node", "dst"), "dst", "left_semi")
    return paths.distances(edges.select("src", "dst"), items).select(F.col("source").alias("i"), F.col("node").alias("j"), F.col("dist").alias("d"))


def _partners_of(spark, d, k):
    """The k nearest of each item by all terms, with the cosine's parts, and by its story, with ranks."""
    w, cls = _weights(spark, d), written(_classes(spark, d), "classes")
    raw = tf.nearest(written(tf.cosines(w, cls), "pairs"), k)
    return w, cls, raw, tf.nearest(tf.cosines(tf.renormalised(w, cls, tf.STORY)), k)


@query("t_hero", b.sql(*_SIMILAR, "select r.i, r.j, round(r.cos, 4) cos, [round(r.name_part, 4), round(r.paper_part, 4), round(r.story_part, 4)] parts, s.j js, round(s.cos, 4) scos, coalesce(f.d, -1) d, coalesce(g.d, -1) ds from rk4 r left join sk4 s on s.i = r.i and s.rank = 1 left join far f on f.i = r.i and f.j = r.j left join far g on g.i = r.i and g.j = s.j where r.rank = 1", recursive=True))
def t_hero(spark, d):
    """Each item's nearest with the parts of its cosine, its nearest by story, and how far both are in the network of links (-1: not at all)."""
    _, _, raw, story = _partners_of(spark, d, 1)
    far = written(_distances(spark, d), "distances")
    rows = raw.join(story.select("i", F.col("j").alias("js"), F.round("cos", 4).alias("scos")), "i", "left")
    rows = rows.join(far, ["i", "j"], "left").join(far.select("i", F.col("j").alias("js"), F.col("d").alias("ds")), ["i", "js"], "left")
    parts = F.array(*(F.round(c, 4) for c in ("name_part", "paper_part", "story_part")))
    return rows.select("i", "j", F.round("cos", 4).alias("cos"), parts.alias("parts"), "js", "scos", F.coalesce("d", F.lit(-1).cast("long")).alias("d"), F.coalesce("ds", F.lit(-1).cast("long")).alias("ds"))


_LIST = "(select coalesce(list(struct_pack(j := k.j, cos := round(k.cos, 4), d := coalesce(f.d, -1)) order by k.rank), []) from {0} k left join far f on f.i = k.i and f.j = k.j where k.i = t.item_id and k.rank <= 8) {1}"


@query("t_pages", b.sql(*_SIMILAR, "nm4 as (select w.doc, sum(case when cls = 0 then w * w else 0 end) s from w join cls using (term) group by w.doc), tk4 as (select doc, count(*) n, count(*) filter (length(word) > 1) big, count(*) filter (length(word) > 1 and lower(word) in (select term from cls join dfs using (term) where cls = 0)) own from ws group by doc)", "select t.item_id id, (select count(*) from near1 where a = t.item_id) deg, coalesce(tk4.n, 0) tokens, round(coalesce(nm4.s, 0), 3) self_name, round(coalesce(own, 0) / greatest(coalesce(big, 0), 1), 3) tok_name, " + _LIST.format("rk4", "raw") + ", " + _LIST.format("sk4", "story") + " from benchmark t left join tk4 on tk4.doc = t.item_id left join nm4 on nm4.doc = t.item_id", recursive=True))
def t_pages(spark, d):
    """A row for each item: degree, tokens, shares of names in its vector and its tokens, and its eight nearest by all terms and by story, each
    with cosine and distance."""
    w, cls, raw, story = _partners_of(spark, d, 8)
    far = written(_distances(spark, d), "distances")
    items = b.read(spark, d, "benchmark").select(F.col("item_id").alias("i"))
    deg = far.filter("d = 1").groupBy("i").agg(F.count("*").alias("deg"))
    names = w.join(cls, "term").groupBy(F.col("doc").alias("i")).agg(F.sum(F.expr("if(cls = 0, w * w, 0d)")).alias("s"))
    proper = cls.filter("cls = 0").join(w.select("term").distinct(), "term", "left_semi").select("term", F.lit(1).alias("proper"))
    toks = _words(spark, d).select(F.col("doc").alias("i"), F.lower("word").alias("term"), (F.length("word") > 1).alias("big")).join(proper, "term", "left")
    toks = toks.groupBy("i").agg(F.count("*").alias("n"), F.count_if("big").alias("big"), F.count_if(F.col("big") & F.col("proper").isNotNull()).alias("own"))

    def listed(rows, name):
        rows = rows.join(far, ["i", "j"], "left").withColumn("x", F.struct("rank", "j", F.round("cos", 4).alias("cos"), F.coalesce("d", F.lit(-1).cast("long")).alias("d")))
        return rows.groupBy("i").agg(F.expr("transform(array_sort(collect_list(x)), x -> struct(x.j, x.cos, x.d))").alias(name))

    rows = items.join(deg, "i", "left").join(toks, "i", "left").join(names, "i", "left").join(listed(raw, "raw"), "i", "left").join(listed(story, "story"), "i", "left")
    none = "cast(array() as array<struct<j:bigint,cos:double,d:bigint>>)"
    return rows.selectExpr("i id", "coalesce(deg, 0L) deg", "coalesce(n, 0L) tokens", "round(coalesce(s, 0d), 3) self_name", "round(coalesce(own, 0L) / greatest(coalesce(big, 0L), 1L), 3) tok_name", f"coalesce(raw, {none}) raw", f"coalesce(story, {none}) story")


_NAMES_STORY = "sw as (select w.* from w join cls using (term) where cls = 2), sq as (select doc, greatest(sqrt(sum(w * w)), 1e-12) n from sw group by doc), st as (select doc, term, w / n w from sw join sq using (doc)), nw as (select w.* from w join cls using (term) where cls = 0), nq as (select doc, greatest(sqrt(sum(w * w)), 1e-12) n from nw group by doc), na as (select doc, term, w / n w from nw join nq using (doc))"
_LINKED = "(select round(avg(case when abs(i - j) = 1 then 1.0 else 0.0 end), 6) from {0}n) linked_{1}"
_AUC = "{0}a as (select round(coalesce(c.cos, 0), 9) s, y.item_id = x.item_id + 1 hit from benchmark x join benchmark y on x.item_id < y.item_id left join {0}c c on c.i = x.item_id and c.j = y.item_id), {0}k as (select rank() over (order by s) + (count(*) over (partition by s) - 1) / 2 rk, hit from {0}a)"
_AUC_OF = "(select round((sum(case when hit then rk end) - count(*) filter (hit) * (count(*) filter (hit) + 1) / 2) / (count(*) filter (hit) * count(*) filter (not hit)), 6) from {0}k) auc_{1}"
_KINDS = (("r", "raw"), ("s", "story"), ("m", "names"))


@query("t_nn_rates", b.sql(WORDS, STATS, CLS, W, _NAMES_STORY, *(_NEAR.format(k, t) for k, t in (("r", "w"), ("s", "st"), ("m", "na"))), *(_AUC.format(k) for k, _ in _KINDS), "select (select round(avg(case when rn.j = sn.j then 1.0 else 0.0 end), 6) from rn join sn using (i)) same, " + ", ".join(f.format(k, n) for k, n in _KINDS for f in (_LINKED, _AUC_OF))))
def t_nn_rates(spark, d):
    """How often the nearest by all terms is the nearest by story; how often the nearest is linked, and the area under the curve of links
    against cosines of all pairs (those without a common term count as 0), by all terms, by story and by names. Items are linked to
    the next one."""
    w, cls = _weights(spark, d), _classes(spark, d)
    items = b.read(spark, d, "benchmark").select("item_id")
    linked = items.select(F.col("item_id").alias("i")).join(items.select((F.col("item_id") - 1).alias("i")), "i").agg(F.count("*").alias("links")).join(items.agg(F.expr("count(*) * (count(*) - 1) div 2").alias("all")))
    near, out = {}, None
    for name, own in (("raw", w), ("story", tf.renormalised(w, cls, tf.STORY)), ("names", tf.renormalised(w, cls, tf.NAME))):
        pairs = written(tf.cosines(own).select("i", "j", F.round("cos", 9).alias("cos"), (F.col("j") == F.col("i") + 1).alias("hit")), "pairs")
        near[name] = tf.nearest(pairs.select("i", "j", "cos")).select("i", "j")
        zeros = pairs.agg(F.count("*").alias("n"), F.count_if("hit").alias("p")).join(linked).select(F.lit(0.0).alias("s"), (F.col("all") - F.col("n")).alias("n"), (F.col("links") - F.col("p")).alias("pos"))
        row = near[name].agg(F.round(F.avg((F.abs(F.col("i") - F.col("j")) == 1).cast("double")), 6).alias(f"linked_{name}")).join(tf.auc(pairs, "cos", "hit", zeros).select(F.round("auc", 6).alias(f"auc_{name}")))
        out = row if out is None else out.join(row)
    same = near["raw"].join(near["story"].withColumnRenamed("j", "k"), "i").agg(F.round(F.avg((F.col("j") == F.col("k")).cast("double")), 6).alias("same"))
    return same.join(out)


@query("js_scatter", b.sql(WORDS, STATS, CLS, W, COS, "select i, j, round(cos, 6) cos from co where round(cos, 6) >= 0.08"))
def js_scatter(spark, d):
    return _rounded(_pairs(spark, d).select("i", "j", "cos"), "cos").filter("cos >= 0.08")


@query("t_self_name", b.sql(WORDS, STATS, CLS, W, "select doc, round(sum(case when cls = 0 then w * w else 0 end), 6) self_name from w join cls using (term) group by doc"))
def t_self_name(spark, d):
    return _weights(spark, d).join(_classes(spark, d), "term").groupBy("doc").agg(F.round(F.sum(F.expr("if(cls = 0, w * w, 0d)")), 6).alias("self_name"))


_VARIANTS = [("reported", {}, {}), ("names30", {"name_cap": 0.3}, {}), ("names70", {"name_cap": 0.7}, {}), ("titles", {"titles": True}, {}), ("paper60", {"paper_share": 0.6}, {}), ("sublinear", {}, {"sublinear": True})]


def _variant_sql(label, cls, how):
    """Names of the CTEs end in the variant's label."""
    k = f"_{label}"
    words = "case when term in (select term from ttl) then 0 when" if "titles" in cls else "case when"
    c = f"cls{k} as (select term, {words} cap > {cls.get('name_cap', 0.5)} * seen then 0 when in_paper / seen > {cls.get('paper_share', 0.7)} then 1 else 2 end cls from stats)"
    value = "(1 + ln(tf))" if how else "tf"
    w = f"raw{k} as (select doc, term, {value} * (ln((1 + n) / (1 + df)) + 1) v from tfs join dfs using (term), nd), nrm{k} as (select doc, sqrt(sum(v * v)) nv from raw{k} group by doc), w{k} as (select doc, term, v / nv w from raw{k} join nrm{k} using (doc))"
    part = lambda n: f"round(sum(case when cls = {n} then x.w * y.w else 0 end) / sum(x.w * y.w), 6)"
    row = f"select '{label}' variant, {part(0)} \"name\", {part(1)} paper, {part(2)} story from w{k} x join w{k} y on x.term = y.term and x.doc < y.doc join cls{k} c on c.term = x.term"
    return f"{c},\n{w}", row


_TITLED = "ttl as (select distinct lower(word) term from (select item_id, unnest(list_transform(regexp_extract_all(text, '[A-Za-z]+(?:[''’][A-Za-z]+)*')[1:2], lambda z: regexp_replace(z, '[''’]s$', ''))) word from benchmark))"
_SIX = [_variant_sql(*v) for v in _VARIANTS]


@query("t_variants", b.sql(WORDS, STATS, W, _TITLED, *(c for c, _ in _SIX), " union all ".join(f"({r})" for _, r in _SIX)))
def t_variants(spark, d):
    """Share of each class in the mass of all cosines, by variant; an item's first two words stand for its title."""
    titles = _items(spark, d).select(F.explode(F.slice(tx.letters(F.col("text")), 1, 2)).alias("word")).select(F.lower("word").alias("term")).distinct()
    made, out = {}, None
    for label, cls, how in _VARIANTS:
        w = made.setdefault(str(how), _weights(spark, d, **how))
        row = tf.cosines(w, _classes(spark, d, **(cls | {"titles": titles} if "titles" in cls else cls))).agg(*[F.round(F.sum(f"{c}_part") / F.sum("cos"), 6).alias(c) for c in ("name", "paper", "story")]).select(F.lit(label).alias("variant"), "*")
        out = row if out is None else out.union(row)
    return out


@query("t_auc", "with s as (select n_chars score, toxic = 1 y from documents join labels using (doc_id)), r as (select rank() over (order by score) + (count(*) over (partition by score) - 1) / 2 rk, y from s) select round((sum(case when y then rk end) - count(*) filter (y) * (count(*) filter (y) + 1) / 2) / (count(*) filter (y) * count(*) filter (not y)), 6) auc from r")
def t_auc(spark, d):
    rows = b.read(spark, d, "documents").join(b.read(spark, d, "labels"), "doc_id").select("n_chars", (F.col("toxic") == 1).alias("y"))
    return tf.auc(rows, "n_chars", "y").select(F.round("auc", 6).alias("auc"))


@query("jn_pair_cross", b.sql(WORDS, STATS, CLS, W, COS, "select count(*) pairs, round(sum(coalesce(cos, 0)), 4) total from benchmark x join benchmark y on x.item_id < y.item_id left join co on co.i = x.item_id and co.j = y.item_id"))
def jn_pair_cross(spark, d):
    """All pairs, counted without being made: those without a common term have cosine 0."""
    n = b.read(spark, d, "benchmark").agg(F.expr("count(*) * (count(*) - 1) div 2").alias("pairs"))
    return n.join(_pairs(spark, d).agg(F.round(F.sum("cos"), 4).alias("total")))


@query("t_gender", "with t as (select doc_id, regexp_extract_all(lower(text), '[a-z0-9]+(?:''[a-z]+)?') t from documents), c as (select doc_id, len(list_filter(t, lambda z: z in ('la', 'elle', 'die', 'the'))) f, len(list_filter(t, lambda z: z in ('le', 'der', 'of'))) m from t) select doc_id, case when f > 2 * m then 'F' when m > 2 * f then 'M' else '?' end sex from c")
def t_gender(spark, d):
    """A document's side by two lists of function words, two to one."""
    rows = b.read(spark, d, "documents").select("doc_id", tx.words(F.col("text")).alias("t"))
    count = lambda words: F.size(F.filter("t", lambda z: z.isin(words)))
    f, m = count(["la", "elle", "die", "the"]), count(["le", "der", "of"])
    return rows.select("doc_id", F.when(f > 2 * m, "F").when(m > 2 * f, "M").otherwise("?").alias("sex"))


@query("agg_pattern_rate", "select lang, round(avg(case when regexp_matches(lower(text), 'licen[sc]e') then 1.0 else 0.0 end), 6) license, round(avg(case when regexp_matches(lower(text), '[0-9]') then 1.0 else 0.0 end), 6) digit from documents group by lang")
def agg_pattern_rate(spark, d):
    rate = lambda p, name: F.round(F.avg(F.lower("text").rlike(p).cast("double")), 6).alias(name)
    return b.read(spark, d, "documents").groupBy("lang").agg(rate("licen[sc]e", "license"), rate("[0-9]", "digit"))


#: documents whose partners are sought among all have ids divisible by this
ASKED = 50
_DOC_WORDS = WORDS.replace("item_id doc", "doc_id doc").replace("from benchmark", "from documents")
_TO_ALL = "co as (select x.doc i, y.doc j, sum(x.w * y.w) cos, sum(case when cls = 0 then x.w * y.w else 0 end) name_part, sum(case when cls = 1 then x.w * y.w else 0 end) paper_part, sum(case when cls = 2 then x.w * y.w else 0 end) story_part from {0} x join {0} y on x.term = y.term and x.doc % 50 = 0 and x.doc <> y.doc join cls on cls.term = x.term group by all)"
_BEST = "nn as (select * from (select *, row_number() over (partition by i order by round(cos, 9) desc, j) rank from co) where rank <= {})"


def _document_words(spark, d):
    return tf.words(b.read(spark, d, "documents").select(F.col("doc_id").alias("doc"), "text", (F.length("text") > 240).alias("long")))


def _document_weights(spark, d):
    return written(tf.weights(_document_words(spark, d)), "weights")


def _document_classes(spark, d):
    return written(tf.classes(tf.word_stats(_document_words(spark, d), "long")), "classes")


def _partners(w, k, cls=None):
    return tf.best(tf.cosines_to(w, w.filter(F.col("doc") % ASKED == 0), cls), k)


@query("agg_word_stats_documents", b.sql(_DOC_WORDS, STATS, "select * from stats"))
def agg_word_stats_documents(spark, d):
    return tf.word_stats(_document_words(spark, d), "long")


@query("t_class_documents", b.sql(_DOC_WORDS, STATS, CLS, "select term, cast(cls as int) cls from cls"))
def t_class_documents(spark, d):
    return tf.classes(tf.word_stats(_document_words(spark, d), "long"))


@query("t_weights_documents", b.sql(_DOC_WORDS, W, "select doc, term, round(w, 6) w from w"))
def t_weights_documents(spark, d):
    return _rounded(tf.weights(_document_words(spark, d)), "w")


@query("flt_vocab_documents", b.sql(_DOC_WORDS, W, "select term, df from dfs"))
def flt_vocab_documents(spark, d):
    return tf.weights(_document_words(spark, d)).groupBy("term").agg(F.count("*").alias("df"))


@query("win_topk_documents", b.sql(_DOC_WORDS, STATS, CLS, W, _TO_ALL.format("w"), _BEST.format(8), "select i, j, rank, round(cos, 6) cos, round(name_part, 6) name_part, round(paper_part, 6) paper_part, round(story_part, 6) story_part from nn"))
def win_topk_documents(spark, d):
    """With the split of each cosine."""
    rows = _partners(_document_weights(spark, d), 8, _document_classes(spark, d))
    return _rounded(rows.select("i", "j", "rank", "cos", "name_part", "paper_part", "story_part"), "cos", "name_part", "paper_part", "story_part")


def _class_sql(cls):
    return b.sql(_DOC_WORDS, STATS, CLS, W, _OWN.format(cls), _TO_ALL.format("re"), _BEST.format(8), "select i, j, rank, round(cos, 6) cos from nn")


def _by_class(spark, d, keep):
    return _rounded(_partners(written(tf.renormalised(_document_weights(spark, d), _document_classes(spark, d), keep), "own"), 8).select("i", "j", "rank", "cos"), "cos")


@query("t_story_documents", _class_sql(2))
def t_story_documents(spark, d):
    return _by_class(spark, d, tf.STORY)


@query("t_name_documents", _class_sql(0))
def t_name_documents(spark, d):
    return _by_class(spark, d, tf.NAME)


@query("top_terms_documents", b.sql(_DOC_WORDS, STATS, CLS, W, _TO_ALL.format("w"), _BEST.format(1), _PRODUCTS, "select i, j, term, round(p, 6) p, r as rank from topt"))
def top_terms_documents(spark, d):
    w = _document_weights(spark, d)
    return _rounded(tf.term_products(w, _partners(w, 1)), "p")
