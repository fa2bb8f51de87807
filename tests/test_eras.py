"""What the rows of an era count."""

import math

import pytest
from weft.queries import QUERIES


def test_eras_are_counted_by_tradition(spark):
    """Every node of an era is of an anchor's tradition or of none, and shares are of these, not of communities."""
    for r in QUERIES["agg_era_rows"](spark, "/root/testdata/sf0.001").collect():
        counts = {c.tradition: c.n for c in r.counts}
        assert set(counts) <= {-1, 0, 1, 2} and sum(counts.values()) == r.n
        assert r.top_share == round(max(counts.values()) / r.n, 3)
        assert r.entropy_bits == pytest.approx(-sum(n / r.n * math.log2(n / r.n) for n in counts.values()), abs=6e-4)
