"""The queries of the text operators, each over the whole of its table, and SQL where it can express one."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, ctw, decontaminate, jaccard, langid, licenses, merkle, neighbors, suffixes, toxicity, turns, warc, wavelet
from .common import held_out, read, shared_dir, with_text


def op6_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.digests(with_text(read(spark, sf_dir, "documents")), public_tokenizers.path("byte_bpe_multi_50k.tiktoken"))


def op1_context_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = with_text(read(spark, sf_dir, "documents"))
    learned = docs.filter(~held_out(5, 1))
    return ctw.score(docs, ctw.fit(learned))


def op2_neighbors(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = read(spark, sf_dir, "embeddings")
    return neighbors.search(vectors, vectors.filter("vec_id % 20 = 0"))


def op3_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.passages(with_text(read(spark, sf_dir, "documents")), read(spark, sf_dir, "benchmark"))


def op4_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffixes.digests(with_text(read(spark, sf_dir, "documents")))


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = with_text(read(spark, sf_dir, "documents"))
    machine = toxicity.fit(docs, read(spark, sf_dir, "labels").filter(~held_out(4, 2)))
    return toxicity.score(docs, machine).select("doc_id", held_out(4, 2).alias("held_out"), "score", "predicted")


def op7_wavelet(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = shared_dir(spark)
    wavelet.write(with_text(read(spark, sf_dir, "documents")), path, public_tokenizers.path("byte_bpe_50k.json"))
    return wavelet.read_back(spark, path)


def op8_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(with_text(read(spark, sf_dir, "documents"))).drop("text", "spans")


def op9_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    model = langid.fit(docs.filter(~held_out(4, 2)))
    return langid.predict(docs.select("doc_id", "text"), model).select("doc_id", held_out(4, 2).alias("held_out"), "lang_pred", "score")


def op10_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.linked_groups(with_text(read(spark, sf_dir, "documents")))


def op11_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = shared_dir(spark)
    warc.write(read(spark, sf_dir, "pages"), path)
    return warc.read_back(spark, path)


def op12_turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return turns.repaired(read(spark, sf_dir, "conversations"))


def op13_merkle(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merkle.manifest(read(spark, sf_dir, "documents"))


QUERIES = {
    "op1_context_tree": op1_context_tree,
    "op2_neighbors": op2_neighbors,
    "op3_decontaminate": op3_decontaminate,
    "op4_suffix_dedup": op4_suffix_dedup,
    "op5_toxicity": op5_toxicity,
    "op6_byte_bpe": op6_byte_bpe,
    "op7_wavelet": op7_wavelet,
    "op8_licenses": op8_licenses,
    "op9_language": op9_language,
    "op10_jaccard": op10_jaccard,
    "op11_warc": op11_warc,
    "op12_turns": op12_turns,
    "op13_merkle": op13_merkle,
}
#: bytes as pairs of hexadecimal digits; a byte is removed if one of the 50 strings over it starts in an earlier document too
OP4_SQL = """
with d as (select doc_id, hex(encode(coalesce(text, ''))) h from documents),
s as materialized (select doc_id, unnest(range(0, length(h) // 2 - 49)) i, unnest(list_transform(range(0, length(h) // 2 - 49), lambda z: substr(h, cast(2 * z + 1 as int), 100))) g from d where length(h) >= 100),
f as (select g, min(doc_id) first_id from s group by g having count(*) > 1),
hit as (select s.doc_id, i from s join f using (g) where f.first_id < s.doc_id),
isl as (select doc_id, i, case when i > lag(i) over w + 50 or lag(i) over w is null then 1 else 0 end fresh from hit window w as (partition by doc_id order by i)),
run as (select doc_id, i, sum(fresh) over (partition by doc_id order by i) r from isl),
span as (select doc_id, r, min(i) a, max(i) + 50 z from run group by all),
gap as (select doc_id, a, z, coalesce(lag(z) over (partition by doc_id order by a), 0) before from span),
kept as (select doc_id, string_agg(substr(h, cast(2 * before + 1 as int), cast(2 * (a - before) as int)), '' order by a) head, max(z) last, sum(z - a) removed, count(*) spans from gap join d using (doc_id) group by doc_id)
select d.doc_id, cast(length(h) // 2 as bigint) n_bytes, cast(coalesce(removed, 0) as bigint) n_removed, coalesce(spans, 0) n_spans,
  sha256(unhex(case when last is null then h else head || substr(h, cast(2 * last + 1 as int)) end)) kept_sha256
from d left join kept using (doc_id)
"""

OP10_SQL = """
with recursive t as (select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^ \\t\\n\\x0B\\f\\r]+') w from documents),
sh as materialized (select distinct doc_id, array_to_string(w[i:i + 2], ' ') g from t, generate_series(1, greatest(1, len(w) - 2)) s(i) where len(w) > 0),
n as (select doc_id, count(*) n from sh group by doc_id),
common as (select g from sh group by g having count(*) > 1),
c as materialized (select sh.doc_id, g, n from sh semi join common using (g) join n using (doc_id)),
both as materialized (select x.doc_id a, y.doc_id b, any_value(x.n) na, any_value(y.n) nb, count(*) k from c x join c y using (g) where x.doc_id < y.doc_id and 10 * least(x.n, y.n) >= 9 * greatest(x.n, y.n) group by 1, 2),
link as materialized (select a, b from both where 100 * k >= 90 * (na + nb - k)),
two as materialized (select a, b from link union all select b, a from link),
reach(node, other) as (select a, a from two union select r.node, e.b from reach r join two e on e.a = r.other),
comp as (select node, min(other) component_id from reach group by node)
select t.doc_id, coalesce(n.n, 0) n_shingles, coalesce(component_id, t.doc_id) component_id from t left join n using (doc_id) left join comp on comp.node = t.doc_id
"""

OP11_SQL = """
with p as (select page_id, octet_length(encode(coalesce(html, ''))) n, sha256(coalesce(html, '')) h from pages),
f as (select h, min(page_id) first_id from p where n >= 100 group by h)
select page_id, cast(n as bigint) payload_bytes, h payload_digest, case when first_id <> page_id then 'revisit' else 'response' end record_type, case when first_id <> page_id then first_id end refers_to
from p left join f using (h)
"""

_FIELD = "coalesce(octet_length(encode(cast({0} as varchar))) || ':' || {0}, '-')"
_LEAF = "sha256(" + " || ".join(_FIELD.format(c) for c in ("doc_id", "source", "lang", "n_chars", "{text}")) + ")"
_LOWER = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_CRC32 = """xor(4294967295, list_reduce(list_prepend(4294967295, list_transform(string_split({0}, ''), lambda c: cast(ascii(c) as bigint))),
  lambda a, b: list_reduce(list_prepend(xor(a, b), [cast(z as bigint) for z in range(8)]), lambda x, i: case when x & 1 = 1 then xor(x >> 1, 3988292384) else x >> 1 end)))"""
#: a tree's nodes and those above them, level by level: tree, level, pos, n (nodes of the level), d
_CLIMB = """{0}(tree, level, pos, n, d) as (select tree, 0, pos, n, d from {1} union all
  select tree, any_value(level) + 1, pos // 16, (any_value(n) + 15) // 16, sha256(string_agg(d, '' order by pos)) from {0} where n > 1 group by tree, pos // 16)"""
#: siblings of every place of a level
_BESIDE = "(select coalesce(string_agg(x.d, '' order by x.pos) filter (x.pos {1} m.spot), '') from {0} x where x.tree = m.tree and x.level = m.level and x.pos // 16 = m.spot // 16)"
OP13_SQL = f"""
with recursive l as (select doc_id, source, coalesce('+' || source, '') tree, {_LEAF.format(text="text")} leaf, case when {_CRC32.format("cast(doc_id as varchar)")} % 5 = 0 then {_LEAF.format(text=_LOWER)} else {_LEAF.format(text="text")} end now from documents),
leaves as (select *, row_number() over (partition by tree order by doc_id, leaf) - 1 pos, count(*) over (partition by tree) n, leaf d from l),
{_CLIMB.format("inner_nodes", "leaves")},
subs as (select 'root' tree, tree own, row_number() over (order by tree) - 1 pos, count(*) over () n, d from inner_nodes where n = 1),
{_CLIMB.format("upper_nodes", "subs")},
nodes as materialized (select * from inner_nodes union all select * from upper_nodes),
mine as (select doc_id, leaf, now, v.tree, level, pos // cast(pow(16, level) as bigint) spot, level step from leaves v join (select distinct tree, level from inner_nodes where n > 1) using (tree)
  union all select doc_id, leaf, now, 'root', level, s.pos // cast(pow(16, level) as bigint), 100 + level from leaves v join subs s on s.own = v.tree join (select distinct level from upper_nodes where n > 1) on true),
path as materialized (select doc_id, leaf, now, row_number() over (partition by doc_id order by step) k, a.left_d, a.right_d from mine m, lateral (select {_BESIDE.format("nodes", "<")} left_d, {_BESIDE.format("nodes", ">")} right_d) a),
proof as (select doc_id, sha256(string_agg(left_d || right_d, '' order by k)) proof_sha256, count(*) steps from path group by doc_id),
folds(doc_id, k, d) as (select doc_id, cast(0 as bigint), now from leaves union all select f.doc_id, f.k + 1, sha256(p.left_d || f.d || p.right_d) from folds f join path p on p.doc_id = f.doc_id and p.k = f.k + 1)
select v.doc_id, leaf, s.d subroot, r.d root, coalesce(proof_sha256, sha256('')) proof_sha256, f.d folded_root, f.d = r.d verified
from leaves v join subs s on s.own = v.tree join (select d from upper_nodes where n = 1) r on true left join proof using (doc_id) join folds f on f.doc_id = v.doc_id and f.k = coalesce(steps, 0)
"""

ORACLES: dict[str, str] = {"op4_suffix_dedup": OP4_SQL, "op10_jaccard": OP10_SQL.replace("both", "near"), "op11_warc": OP11_SQL, "op13_merkle": OP13_SQL}
