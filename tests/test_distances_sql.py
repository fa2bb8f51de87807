"""The SQL on distances between items has no bound of its own."""

import duckdb
from weft.plans.similarity import _HOPS


def by_levels(ids, start):
    far, front = {start: 0}, [start]
    while front:
        front = list(dict.fromkeys(y for x in front for y in (x - 5, x - 1, x + 1, x + 5) if y in ids and y not in far and not far.update({y: far[x] + 1})))
    return far


def test_far_items_have_a_distance():
    c = duckdb.connect()
    c.sql("create table benchmark as select range item_id from range(150)")
    far = dict(c.sql(f"with recursive {_HOPS} select j, d from far where i = 3").fetchall())
    assert far == by_levels(set(range(150)), 3) and max(far.values()) > 14


def test_items_without_a_way_have_none():
    c = duckdb.connect()
    c.sql("create table benchmark as select unnest([1, 2, 40, 45]) item_id")
    assert sorted(c.sql(f"with recursive {_HOPS} select i, j, d from far where i < j").fetchall()) == [(1, 2, 1), (40, 45, 1)]
