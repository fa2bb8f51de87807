"""Queries on copied passages between documents."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import text as tx
from ..operators import components as cc
from ..operators import copying as cp
from ..storage import written
from . import base as b
from .registry import query

TOK = "tk as (select doc_id, regexp_extract_all(lower(text), '[a-z0-9]+(?:''[a-z]+)?') t from documents)"
GRAMS = "gr as (select doc_id, i - 1 pos, array_to_string(t[i:i+7], ' ') gram from tk, generate_series(1, len(t) - 7) g(i) where len(t) >= 8)"
DF = "dfs as (select gram, count(distinct doc_id) df from gr group by gram)"
SHARED = "sh as (select gr.*, df from gr join dfs using (gram) where df between 2 and 10)"
CAND = "cand as (select distinct x.doc_id a, y.doc_id b from sh x join sh y using (gram) where x.doc_id < y.doc_id)"


def runs_sql(name="rn", max_pages=5, min_passage=12):
    return f"""hit{name} as (select distinct x.doc_id a, y.doc_id b, x.pos from sh x join sh y using (gram) where x.doc_id <> y.doc_id and x.df <= {max_pages}),
    isl{name} as (select *, pos - row_number() over (partition by a, b order by pos) g from hit{name}),
    {name} as (select a, b, min(pos) start, max(pos) + 8 stop from isl{name} group by a, b, g having max(pos) + 8 - min(pos) >= {min_passage})"""


def pairs_sql(name="pr", runs="rn"):
    return f"""per{name} as (select a, b, sum(stop - start) copied, count(*) passages, max(stop - start) longest, arg_min(start, (start - stop, start)) f from {runs} group by a, b),
    {name} as (select x.a, x.b, cast(round_even((x.copied + y.copied) / 2, 0) as bigint) shared, x.passages, x.longest, x.f start_a, cast(x.copied as bigint) copied_a, cast(y.copied as bigint) copied_b,
      case when x.longest >= 40 then 'paragraph' else 'phrase' end kind from per{name} x join per{name} y on x.a = y.b and x.b = y.a where x.a < x.b and least(x.copied, y.copied) >= 30)"""


COVER = "cov as (select distinct r.a doc_id, unnest(range(start, stop)) pos from rn r join pr p on least(r.a, r.b) = p.a and greatest(r.a, r.b) = p.b)"


def _docs(spark, d):
    return b.read(spark, d, "documents").select("doc_id", "text")


def _shared(spark, d):
    """The postings are made once, whatever uses them."""
    return written(cp.shared_places(_docs(spark, d)), "postings")


def _runs(spark, d):
    return written(cp.shared_runs(_shared(spark, d)), "runs")


@query("t_tokens_w5", b.sql(TOK, "select doc_id, cast(len(t) as bigint) n, t[1] first_token, t[len(t)] last_token from tk where len(t) > 0"))
def t_tokens_w5(spark, d):
    t = tx.words(F.col("text"))
    return _docs(spark, d).withColumn("t", t).filter("size(t) > 0").select("doc_id", F.size("t").cast("long").alias("n"), F.element_at("t", 1).alias("first_token"), F.element_at("t", -1).alias("last_token"))


@query("t_body", "select doc_id, length(regexp_replace(text, '(?s)\\n\\n\\n(?:References|External links|See also|Notes|Further reading|Bibliography|Sources)\\n.*$', '')) n from documents")
def t_body(spark, d):
    return _docs(spark, d).select("doc_id", F.length(tx.body(F.col("text"))).cast("long").alias("n"))


@query("t_line_tokens", "with l as (select doc_id, unnest(string_split(text, chr(10))) line, generate_subscripts(string_split(text, chr(10)), 1) - 1 block from documents) select doc_id, cast(block as bigint) block, cast(len(regexp_extract_all(lower(line), '[a-z0-9]+(?:''[a-z]+)?')) as bigint) n from l where len(regexp_extract_all(lower(line), '[a-z0-9]+(?:''[a-z]+)?')) > 0")
def t_line_tokens(spark, d):
    return cp.line_tokens(_docs(spark, d)).groupBy("doc_id", F.col("block").cast("long").alias("block")).agg(F.count("*").alias("n"))


@query("t_shingle_index", b.sql(TOK, GRAMS, DF, "select df, count(*) grams from dfs group by df"))
def t_shingle_index(spark, d):
    return cp.document_counts(_docs(spark, d)).groupBy("df").agg(F.count("*").alias("grams"))


@query("agg_boiler", b.sql(TOK, GRAMS, DF, "select count(*) n from dfs where df > 5"))
def agg_boiler(spark, d):
    return cp.document_counts(_docs(spark, d)).filter("df > 5").agg(F.count("*").alias("n"))


@query("flt_df", b.sql(TOK, GRAMS, DF, "select gram, df from dfs where df between 2 and 10"))
def flt_df(spark, d):
    return cp.grams_on(_docs(spark, d), 2, 10)


@query("jn_shingle", b.sql(TOK, GRAMS, DF, SHARED, "select x.doc_id a, y.doc_id b, count(distinct gram) grams from sh x join sh y using (gram) where x.doc_id < y.doc_id group by all"))
def jn_shingle(spark, d):
    docs = _shared(spark, d).select("gram", "doc_id").distinct()
    return docs.withColumnRenamed("doc_id", "a").join(docs.withColumnRenamed("doc_id", "b"), "gram").filter("a < b").groupBy("a", "b").agg(F.count("*").alias("grams"))


@query("t_candidates", b.sql(TOK, GRAMS, DF, SHARED, CAND, "select * from cand"))
def t_candidates(spark, d):
    return cp.candidates(_shared(spark, d))


@query("t_shared_runs", b.sql(TOK, GRAMS, DF, SHARED, runs_sql(), "select a, b, start, stop from rn"))
def t_shared_runs(spark, d):
    return cp.shared_runs(_shared(spark, d))


@query("win_runs", b.sql(TOK, GRAMS, DF, SHARED, runs_sql(), "select a, b, count(*) runs, cast(sum(stop - start) as bigint) tokens from rn group by a, b"))
def win_runs(spark, d):
    return cp.shared_runs(_shared(spark, d)).groupBy("a", "b").agg(F.count("*").alias("runs"), F.expr("sum(stop - start)").alias("tokens"))


@query("win_first_longest", b.sql(TOK, GRAMS, DF, SHARED, runs_sql(), "select a, b, arg_min(start, (start - stop, start)) start, max(stop - start) length from rn group by a, b"))
def win_first_longest(spark, d):
    return cp.shared_runs(_shared(spark, d)).groupBy("a", "b").agg(F.expr("min_by(start, struct(start - stop, start))").alias("start"), F.expr("max(stop - start)").alias("length"))


@query("t_copy_pairs", b.sql(TOK, GRAMS, DF, SHARED, runs_sql(), pairs_sql(), "select * from pr"))
def t_copy_pairs(spark, d):
    return cp.copy_pairs(_runs(spark, d))


@query("top_copy_pairs", b.sql(TOK, GRAMS, DF, SHARED, runs_sql(), pairs_sql(), "select a, b, shared from pr order by shared desc, a, b limit 20"))
def top_copy_pairs(spark, d):
    return t_copy_pairs(spark, d).orderBy(F.desc("shared"), "a", "b").limit(20).select("a", "b", "shared")


@query("t_covered", b.sql(TOK, GRAMS, DF, SHARED, runs_sql(), pairs_sql(), COVER, "select doc_id, count(*) copied from cov group by doc_id"))
def t_covered(spark, d):
    runs = _runs(spark, d)
    return cp.covered(runs, cp.copy_pairs(runs)).groupBy("doc_id").agg(F.count("*").alias("copied"))


_BORROW = "bor as (select doc_id, cast(len(t) as bigint) tokens, coalesce((select count(*) from cov c where c.doc_id = tk.doc_id), 0) copied from tk)"


def _borrowed(spark, d):
    runs = _runs(spark, d)
    n = _docs(spark, d).select("doc_id", F.size(tx.words(F.col("text"))).cast("long").alias("tokens"))
    return cp.borrowed(cp.covered(runs, cp.copy_pairs(runs)), n)


@query("agg_borrowed", b.sql(TOK, GRAMS, DF, SHARED, runs_sql(), pairs_sql(), COVER, _BORROW, "select doc_id, tokens, copied, case when tokens > 0 then round(copied / tokens, 6) else 0 end share from bor"))
def agg_borrowed(spark, d):
    return _borrowed(spark, d).withColumn("share", F.round("share", 6))


@query("top_borrowed", b.sql(TOK, GRAMS, DF, SHARED, runs_sql(), pairs_sql(), COVER, _BORROW, "select doc_id, round(copied / tokens, 6) share from bor where tokens > 0 order by round(copied / tokens, 6) desc, doc_id limit 25"))
def top_borrowed(spark, d):
    return _borrowed(spark, d).filter("tokens > 0").select("doc_id", F.round("share", 6).alias("share")).orderBy(F.desc("share"), "doc_id").limit(25)


@query("agg_section_share", b.sql(TOK, GRAMS, DF, SHARED, runs_sql(), pairs_sql(), COVER, _BORROW, "select lang section, round(sum(copied) / sum(tokens), 6) copied_share, round(sum(tokens) / (select sum(tokens) from bor), 6) all_share from bor join documents using (doc_id) group by lang"))
def agg_section_share(spark, d):
    rows = _borrowed(spark, d).join(b.read(spark, d, "documents").select("doc_id", "lang"), "doc_id").groupBy(F.col("lang").alias("section")).agg(F.sum("copied").alias("c"), F.sum("tokens").alias("t"))
    return rows.join(rows.agg(F.sum("t").alias("total"))).select("section", F.round(F.col("c") / F.col("t"), 6).alias("copied_share"), F.round(F.col("t") / F.col("total"), 6).alias("all_share"))


@query("agg_graph_rates", b.sql(b.DENSE, b.SIMPLE, b.NODES, "select round(avg(case when exists (select 1 from edges r where r.src = e.dst and r.dst = e.src) then 1.0 else 0.0 end), 6) reciprocal, round((select count(*) from simple) / ((select count(*) from nodes) * ((select count(*) from nodes) - 1) / 2), 6) density from edges e"))
def agg_graph_rates(spark, d):
    from ..operators import graph

    edges = b.dense(spark, d)
    n = b.nodes(spark, d).agg(F.count("*").alias("n"))
    m = graph.undirect(edges).agg(F.count("*").alias("m"))
    return graph.with_reverse(edges).agg(F.round(F.avg(F.col("mutual").cast("double")), 6).alias("reciprocal")).join(n).join(m).select("reciprocal", F.expr("round(m / (n * (n - 1) / 2), 6)").alias("density"))


_REACH = "e2 as (select a, b from pr union select b, a from pr), reach(node, other) as (select a, a from e2 union select r.node, e.b from reach r join e2 e on e.a = r.other)"


@query("g_copy_graph", b.sql(TOK, GRAMS, DF, SHARED, runs_sql(), pairs_sql(), _REACH, "select node, min(other) component from reach group by node", recursive=True))
def g_copy_graph(spark, d):
    return cc.components(t_copy_pairs(spark, d).select("a", "b"))


_GRID = [(p, m) for p in (3, 5, 10) for m in (8, 12, 20)]


@query("sens_grid", b.sql(TOK, GRAMS, DF, SHARED, *(x for p, m in _GRID for x in (runs_sql(f"r{p}_{m}", p, m), pairs_sql(f"p{p}_{m}", f"r{p}_{m}"))), " union all ".join(f"select cast({p} as bigint) max_pages, cast({m} as bigint) min_passage, count(*) edges, count(*) filter (kind = 'paragraph') paragraphs from p{p}_{m}" for p, m in _GRID)))
def sens_grid(spark, d):
    """The postings are made once and used by all cells, and so are the runs of all passages for each number of pages."""
    shared, out = _shared(spark, d), None
    for pages in sorted({p for p, _ in _GRID}):
        passages = sorted(m for p, m in _GRID if p == pages)
        runs = written(cp.shared_runs(shared, max_pages=pages, min_passage=passages[0]), "runs")
        for passage in passages:
            pairs = cp.copy_pairs(runs.filter(F.col("stop") - F.col("start") >= passage))
            row = pairs.agg(F.count("*").alias("edges"), F.count_if(F.col("kind") == "paragraph").alias("paragraphs")).select(F.lit(pages).cast("long").alias("max_pages"), F.lit(passage).cast("long").alias("min_passage"), "edges", "paragraphs")
            out = row if out is None else out.union(row)
    return out


#: documents as pages: some lines under headings, of which one opens no section
_HEADS = ["Biography", "1970s", "Powers and abilities", "In other media", "Reception"]
_OPENS = "case h when 'Biography' then 'Fictional character biography' when 'Powers and abilities' then h when 'In other media' then h when 'Reception' then h end"
_PAGES = f"""pages5 as (select doc_id, array_to_string(list_transform(string_split(text, chr(10)), lambda x, k: case when k % 4 = 2 then chr(10) || chr(10) || chr(10) || ['{"', '".join(_HEADS)}'][cast(1 + (doc_id + k // 4) % 5 as int)] || chr(10) || x else x end), chr(10)) text from documents where text is not null)"""
_SPANS = f"""tk as (select doc_id, regexp_extract_all(lower(text), '[a-z0-9]+(?:''[a-z]+)?') t from pages5),
  cut as (select doc_id, unnest(t) tok, unnest(range(len(t))) pos, unnest(list_slice(string_split_regex(lower(text), '[a-z0-9]+(?:''[a-z]+)?'), 1, len(t))) gap from tk join pages5 using (doc_id)),
  pl as (select doc_id, pos, tok, sum(length(gap) + length(tok)) over (partition by doc_id order by pos) stop from cut),
  hx as (select doc_id, regexp_extract_all(text, '\n\n\n([^\n]{{1,70}})\n') full_h, regexp_extract_all(text, '\n\n\n([^\n]{{1,70}})\n', 1) names, string_split_regex(text, '\n\n\n([^\n]{{1,70}})\n') gaps from pages5),
  hs as (select doc_id, unnest(names) h, unnest(full_h) f, unnest(list_slice(gaps, 1, len(names))) gap, unnest(range(len(names))) pos from hx),
  hp as (select doc_id, {_OPENS} section, sum(length(f) + length(gap)) over (partition by doc_id order by pos) - length(f) + 3 start from hs),
  ho as (select * from hp where section is not null),
  sp as (select pl.doc_id, pos, tok, stop - length(tok) start, stop, coalesce(ho.section, 'Lead') section from pl asof left join ho on pl.doc_id = ho.doc_id and pl.stop - length(pl.tok) >= ho.start)"""
#: a document links to the next one that begins alike, and is linked back if both have one length
_LINKS = "nx as (select doc_id src, lead(doc_id) over w dst, n_chars, lead(n_chars) over w m from documents where text is not null window w as (partition by substr(text, 1, 12) order by doc_id)), edges as (select src, dst from nx where dst is not null union select dst, src from nx where dst is not null and n_chars = m)"
_PAGED = (_LINKS, _PAGES, _SPANS, GRAMS, DF, SHARED, runs_sql(), pairs_sql())


def _pages(spark, d):
    heads = "array('" + "', '".join(_HEADS) + "')"
    line = f"transform(split(text, '\n'), (x, k) -> if(k % 4 = 1, concat('\n\n\n', {heads}[cast((doc_id + (k + 1) div 4) % 5 as int)], '\n', x), x))"
    return _docs(spark, d).filter("text is not null").withColumn("text", F.array_join(F.expr(line), "\n"))


def _links(spark, d):
    line = Window.partitionBy(F.substring("text", 1, 12)).orderBy("doc_id")
    rows = b.read(spark, d, "documents").filter("text is not null").select(F.col("doc_id").alias("src"), F.lead("doc_id").over(line).alias("dst"), (F.col("n_chars") == F.lead("n_chars").over(line)).alias("alike")).filter("dst is not null")
    return rows.select("src", "dst").union(rows.filter("alike").select("dst", "src"))


def _paged(spark, d):
    """Pages, runs and pairs, each made once."""
    pages = written(_pages(spark, d), "pages")
    shared = written(cp.shared_places(pages), "postings")
    runs = written(cp.shared_runs(shared), "runs")
    return pages, runs, written(cp.copy_pairs(runs), "pairs")


@query("t_token_spans", b.sql(_PAGES, _SPANS, "select doc_id, section, count(*) n, cast(min(pos) as bigint) first_pos, cast(max(pos) as bigint) last_pos, cast(min(start) as bigint) first_start, cast(max(stop) as bigint) last_stop, cast(sum(start * (pos + 1)) as bigint) places from sp group by doc_id, section"))
def t_token_spans(spark, d):
    """Tokens with their places and sections, summed by document and section."""
    rows = cp.spans(_pages(spark, d)).groupBy("doc_id", "section")
    return rows.agg(F.count("*").alias("n"), F.min("pos").cast("long").alias("first_pos"), F.max("pos").cast("long").alias("last_pos"), F.min("start").alias("first_start"), F.max("stop").alias("last_stop"), F.sum(F.col("start") * (F.col("pos") + 1)).alias("places"))


_EVIDENCE = """fb as (select a b, b a, arg_min(start, (start - stop, start)) start_b from rn where a > b group by a, b),
  nt as (select doc_id, count(*) n from sp group by doc_id),
  ev as (select pr.a, pr.b, round(copied_a / na.n, 6) share_a, round(copied_b / nb.n, 6) share_b, x.section section_a, z.section section_b, replace(substr(g.text, cast(x.start + 1 as int), cast(y.stop - x.start as int)), chr(10), ' ') text,
    exists (select 1 from edges e where e.src = pr.a and e.dst = pr.b) a_links_b, exists (select 1 from edges e where e.src = pr.b and e.dst = pr.a) b_links_a
    from pr join fb using (a, b) join nt na on na.doc_id = pr.a join nt nb on nb.doc_id = pr.b join pages5 g on g.doc_id = pr.a
    join sp x on x.doc_id = pr.a and x.pos = start_a join sp y on y.doc_id = pr.a and y.pos = start_a + longest - 1 join sp z on z.doc_id = pr.b and z.pos = start_b)"""


@query("t_copy_evidence", b.sql(*_PAGED, _EVIDENCE, "select a, b, share_a, share_b, section_a, section_b, text, a_links_b or b_links_a linked, a_links_b, b_links_a from ev"))
def t_copy_evidence(spark, d):
    """Shares, sections, links and the longest passage of each copying pair."""
    pages, runs, pairs = _paged(spark, d)
    return cp.evidence(pages, runs, pairs, _links(spark, d)).withColumns({c: F.round(c, 6) for c in ("share_a", "share_b")})


@query("agg_section_share_pages", b.sql(*_PAGED, COVER, "al as (select section, count(*) n from sp group by section), co as (select section, count(*) c from sp join cov using (doc_id, pos) group by section)", "select section, n tokens, coalesce(c, 0) copied, round(n / (select sum(n) from al), 6) all_share, round(coalesce(c, 0) / (select sum(c) from co), 6) copied_share from al left join co using (section)"))
def agg_section_share_pages(spark, d):
    """What share of all tokens and of all copied tokens each section has."""
    pages, runs, pairs = _paged(spark, d)
    rows = cp.section_shares(written(cp.spans(pages), "spans"), cp.covered(runs, pairs))
    total = rows.agg(F.sum("tokens").alias("t"), F.sum("copied").alias("c"))
    return rows.join(total).select("section", "tokens", "copied", F.round(F.col("tokens") / F.col("t"), 6).alias("all_share"), F.round(F.col("copied") / F.col("c"), 6).alias("copied_share"))


@query("agg_section_share_some", b.sql(*_PAGED, COVER, "al as (select section, count(*) n from sp where doc_id in (select a from pr union select b from pr) group by section), co as (select section, count(*) c from sp join cov using (doc_id, pos) group by section)", "select section, n tokens, coalesce(c, 0) copied from al left join co using (section)"))
def agg_section_share_some(spark, d):
    """The same by numbers of tokens, for the documents of copying pairs alone."""
    pages, runs, pairs = _paged(spark, d)
    only = pairs.select(F.col("a").alias("doc_id")).union(pairs.select("b")).distinct()
    return cp.section_shares(written(cp.spans(pages), "spans"), cp.covered(runs, pairs), only)


@query("agg_copy_rates", b.sql(*_PAGED, _EVIDENCE, "select count(*) edges, round(avg(case when a_links_b or b_links_a then 1.0 else 0.0 end), 6) linked, round(avg(case when a_links_b and b_links_a then 1.0 else 0.0 end), 6) both_ways, round(count(*) / ((select count(*) from pages5) * ((select count(*) from pages5) - 1) / 2), 9) density from ev"))
def agg_copy_rates(spark, d):
    """Of the graph of copying pairs: linked pairs, those linked both ways, and density."""
    pages, _, pairs = _paged(spark, d)
    rows = cp.graph_rates(pairs, _links(spark, d), pages.select("doc_id"))
    return rows.select("edges", F.round("linked", 6).alias("linked"), F.round("both_ways", 6).alias("both_ways"), F.round("density", 9).alias("density"))
