"""Every query with SQL gives the rows that DuckDB gives on the same tables."""

import math

import duckdb
import pytest
from weft.queries import ORACLES, QUERIES

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in TABLES:
        c.sql(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return c


def plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else round(v, 6) + 0.0
    if isinstance(v, (list, tuple)):
        return tuple(plain(x) for x in v)
    if isinstance(v, dict):
        return tuple(plain(x) for x in v.values())
    return v


def rows(names, data):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted((tuple(plain(r[i]) for i in order) for r in data), key=repr)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_same_rows(spark, duck, name):
    got = QUERIES[name](spark, SF)
    want = duck.sql(ORACLES[name])
    assert sorted(got.columns) == sorted(want.columns)
    assert rows(got.columns, got.collect()) == rows(want.columns, want.fetchall())


def sums(rows, key, value):
    out = {}
    for r in rows:
        out[r[key]] = out.get(r[key], 0) + r[value]
    return out


def falling(rows):
    curve = [r.fraction for r in sorted(rows, key=lambda r: r.step)]
    return curve[-1] == 0 and all(a >= b - 1e-12 for a, b in zip(curve, curve[1:]))


def paired(rows):
    return all(0 < r.p <= 1 and r.i < r.j for r in rows)


def faithful(rows):
    return all(0 <= r.loyalty <= 1 for r in rows) and len({r.node for r in rows}) == len(rows) > 0


#: what must hold of the rows of queries that SQL has no expression for
HOLDS = {
    "agg_coassign": paired,
    "agg_coassign_unweighted": paired,
    "agg_era_rows": lambda rows: all(0 <= r.mean_loyalty <= 1 and 0 <= r.below_half <= 1 and 0 < r.top_share <= 1 and r.entropy_bits >= -1e-9 for r in rows),
    "agg_k_hist": lambda rows: sum(r.runs for r in rows) == 200 and all(r.k > 0 for r in rows),
    "agg_mentions_items": lambda rows: all(r.a != r.b and r.named > 0 for r in rows),
    "agg_share_matrix": lambda rows: all(abs(s - 1) < 1e-9 for s in sums(rows, "node", "share").values()),
    "agg_use_items": lambda rows: all(r.used > 0 for r in rows),
    "c_anchor": lambda rows: all(r.tradition >= -1 for r in rows) and {0, 1, 2} >= {r.tradition for r in rows if r.tradition >= 0},
    "c_consensus": lambda rows: len({r.node for r in rows}) == len(rows) > 0,
    "c_loyalty": faithful,
    "c_loyalty_unweighted": faithful,
    "c_null_q": lambda rows: len(rows) == 1 and -0.5 <= rows[0].real <= 1 and rows[0].std >= 0,
    "c_pair_nmi": lambda rows: 0 <= rows[0].min <= rows[0].mean <= rows[0].max <= 1 + 1e-9,
    "g_comention_items": lambda rows: all(r.a < r.b and r.n > 0 for r in rows),
    "g_mention_items": lambda rows: sum(r.names for r in rows) == sum(r.named_by for r in rows),
    "jn_run_mapping": lambda rows: len({(r.run, r.community) for r in rows}) == len(rows) and all(r.overlap > 0 for r in rows),
    "l_evidence_items": lambda rows: all(r.rank in (1, 2) and 0 <= a < z <= len(r.text) for r in rows for a, z in r.marks),
    "m_extract_items": lambda rows: len({r.who for r in rows}) == len(rows) and all(r.mentions > 0 for r in rows),
    "n_shared_items": lambda rows: len({r.name for r in rows}) == len(rows),
    "st_lr_test": lambda rows: len(rows) > 0,
    "st_perm": lambda rows: 0 <= rows[0].p <= 1,
    "st_powerlaw_fit": lambda rows: [r.distance for r in rows if r.chosen] == [min(r.distance for r in rows)] and all(r.alpha > 1 for r in rows),
}


def test_every_query_is_held_against_something():
    assert set(QUERIES) - set(ORACLES) == set(HOLDS)


@pytest.mark.parametrize("name", sorted(HOLDS))
def test_invariants(spark, name):
    assert HOLDS[name](QUERIES[name](spark, SF).collect())
