"""Fits of power laws and likelihood ratios against sums and grids in plain Python."""

import math
import random

import pytest
from weft.operators import distributions as ds

VALUES = [max(1, int(random.Random(k).paretovariate(1.4))) for k in range(400)]


def tail_sum(s, q, n=20_000):
    """Sum of k ** -s from q on, the rest by the integral."""
    return sum((q + k) ** -s for k in range(n)) + (q + n - 0.5) ** (1 - s) / (s - 1)


def log_likelihood(alpha, values, xmin):
    return -alpha * sum(math.log(v) for v in values) - len(values) * math.log(tail_sum(alpha, xmin))


def test_powerlaw_fit(spark):
    rows = spark.createDataFrame([(v,) for v in VALUES], "k long")
    fits = {r.xmin: r for r in ds.powerlaw_fit(rows, "k").collect()}
    assert set(fits) == set(sorted(set(VALUES))[:-1])
    for xmin in sorted(fits)[:4]:
        own = [v for v in VALUES if v >= xmin]
        alpha = fits[xmin].alpha
        best = log_likelihood(alpha, own, xmin)
        assert all(log_likelihood(alpha + d, own, xmin) < best for d in (-0.01, 0.01, -0.2, 0.2) if alpha + d > 1.01)
        apart = max(abs(sum(v <= x for v in own) / len(own) - (1 - tail_sum(alpha, x + 1) / tail_sum(alpha, xmin))) for x in set(own))
        assert fits[xmin].distance == pytest.approx(apart, abs=1e-4)
    chosen = [r for r in fits.values() if r.chosen]
    assert [r.xmin for r in chosen] == [min(fits.values(), key=lambda r: (r.distance, r.xmin)).xmin]


def test_likelihood_ratio(spark):
    xmin, alpha = 2, 2.3
    own = [v for v in VALUES if v >= xmin]
    rows = spark.createDataFrame([(v,) for v in VALUES], "k long")
    got = {r.alternative: r for r in ds.likelihood_ratio(rows, "k", xmin, alpha).collect()}
    power = [-alpha * math.log(v) - math.log(tail_sum(alpha, xmin)) for v in own]
    rate = math.log(1 + 1 / (sum(v - xmin for v in own) / len(own)))
    other = [math.log(1 - math.exp(-rate)) - rate * (v - xmin) for v in own]
    d = [a - b for a, b in zip(power, other)]
    r = sum(d)
    var = sum((x - r / len(d)) ** 2 for x in d) / len(d)
    assert got["exponential"].r == pytest.approx(r, rel=1e-4)
    assert got["exponential"].p == pytest.approx(math.erfc(abs(r) / math.sqrt(2 * len(d) * var)), rel=1e-3, abs=1e-12)

    def lognormal(mu, sigma):
        cdf = lambda t: 0.5 * math.erfc(-(math.log(t) - mu) / (sigma * math.sqrt(2)))
        if 1 - cdf(xmin - 0.5) < 1e-9:  # nothing is left of the distribution
            return -math.inf
        return sum(math.log((cdf(v + 0.5) - cdf(v - 0.5)) / (1 - cdf(xmin - 0.5)) + 1e-300) for v in own)

    most = sum(power) - got["lognormal"].r
    grid = [lognormal(m / 4, s / 4) for m in range(-16, 9) for s in range(2, 14)]
    assert most >= max(grid) - 0.5 and 0 <= got["lognormal"].p <= 1


def test_strong_pairs_and_agreement(spark):
    """Pairs above a share of runs against all pairs, and whether runs agree, with hot signatures in chunks."""
    from weft.operators import community as cm

    rng = random.Random(3)
    runs = [[(n % 4 if rng.random() < 0.7 else rng.randrange(4)) for n in range(60)] for _ in range(9)]
    rows = spark.createDataFrame([(r, n, c) for r, own in enumerate(runs) for n, c in enumerate(own)], "run long, node long, community long").cache()
    sigs = cm.signatures(rows).cache()
    for tau, chunk in ((0.5, 3), (0.8, 1024), (1.0, 2)):
        got = {(x.i, x.j): x.p for x in cm.strong_pairs(rows, sigs, tau, chunk).collect()}
        want = {(i, j): sum(own[i] == own[j] for own in runs) / 9 for i in range(60) for j in range(i + 1, 60)}
        assert got == pytest.approx({k: p for k, p in want.items() if p >= tau})
    assert not cm.unanimous(rows, sigs)
    alike = rows.filter("run = 0").crossJoin(spark.range(3).withColumnRenamed("id", "again")).selectExpr("again run", "node", "(community + again) % 4 community")
    assert cm.unanimous(alike, cm.signatures(alike))
