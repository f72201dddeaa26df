"""Running counts, interval counts, nearest-neighbour information and decimals against brute force."""

import math
import random

import numpy as np
import pytest

from labeltab.functions.ranked import ranked, running
from labeltab.operators import neighbour_mi as N
from labeltab.operators import relevance as R
from labeltab.spec import TableSpec

SPEC = TableSpec(features=("x", "y"), target="label")
SCHEMA = "label string, x double, y double"


def table(n=240):
    rng = random.Random(4)
    rows = [(rng.choice("aab") if i % 40 else "c", round(rng.gauss(0, 5), 1), float(rng.choice([1, 1, 1, 2, 3, 9]))) for i in range(n)]
    nan, inf = float("nan"), float("inf")
    return rows + [("once", 0.5, 1.0), (None, 1.0, 1.0), ("a", None, 2.0), ("b", nan, None), ("d", 1e3, 1e3), ("d", -1e3, 1e3), ("a", inf, 1.0)]


def brute_mi(points, k=3):
    points = [(c, x) for c, x in points if c is not None and x is not None and math.isfinite(x)]
    size = {c: sum(1 for d, _ in points if d == c) for c, _ in points}
    points = [(c, x) for c, x in points if size[c] > 1]
    psi = lambda n: -0.5772156649015329 + sum(1 / i for i in range(1, n))
    total = 0.0
    for i, (c, x) in enumerate(points):
        kk = min(k, size[c] - 1)
        r = sorted(abs(x - z) for j, (d, z) in enumerate(points) if d == c and j != i)[kk - 1]
        m = sum(1 for _, z in points if (abs(z - x) < r * (1 - 1e-9) if r > 0 else z == x))
        total += psi(kk) - psi(size[c]) - psi(m)
    return len(points), max(0.0, psi(len(points)) + total / len(points))


@pytest.mark.parametrize("rows_per_part", [7, 1 << 18])
def test_neighbour_information_matches_brute_force(spark, rows_per_part):
    rows = table()
    got = {r.feature: (r.n, r.mi) for r in N.neighbour_information(spark.createDataFrame(rows, SCHEMA), SPEC, rows_per_part=rows_per_part).collect()}
    for i, f in enumerate(("x", "y")):
        n, mi = brute_mi([(r[0], r[1 + i]) for r in rows])
        assert got[f][0] == n and abs(got[f][1] - mi) < 1e-9


def test_neighbour_information_does_not_depend_on_scale(spark):
    rows = [(c, x, None if x is None else x * 100) for c, x, _ in table()]
    got = {r.feature: r.mi for r in N.neighbour_information(spark.createDataFrame(rows, SCHEMA), SPEC).collect()}
    assert abs(got["x"] - got["y"]) < 1e-9


def test_neighbour_information_without_classes(spark):
    df = spark.createDataFrame([("a", 1.0, 2.0), ("b", 1.0, 2.0), (None, 3.0, 1.0)], SCHEMA)
    assert N.neighbour_information(df, SPEC).collect() == []
    assert N.neighbour_information(df.where("label = 'z'"), SPEC).collect() == []


def test_digamma_and_kth_distance():
    harmonic = np.cumsum(1 / np.arange(1, 60))
    assert np.allclose(N.digamma(np.arange(2, 61)), harmonic - 0.5772156649015329, atol=1e-13)
    v, n = np.array([0.0, 1.0, 1.5, 4.0]), np.array([1, 2, 1, 5])
    flat = np.repeat(v, n)
    for k in (1, 2, 3):
        want = [sorted(np.delete(np.abs(flat - x), list(flat).index(x)))[k - 1] for x in v]
        assert N.kth_distance(v, n, k).tolist() == want


@pytest.mark.parametrize("rows_per_part", [5, 1 << 18])
def test_running_counts(spark, rows_per_part):
    rows = [(f, v, lab) for f, i in (("x", 1), ("y", 2)) for lab, v in ((r[0], r[i]) for r in table())
            if lab is not None and v is not None and not math.isnan(v)]
    got = running(ranked(spark.createDataFrame(rows, "feature string, value double, label string"), rows_per_part)).collect()
    for r in got:
        all_ = [v for f, v, _ in rows if f == r.feature]
        assert (r.upto, r.below) == (sum(v <= r.value for v in all_), sum(v < r.value for v in all_))


def test_class_ranges_brute_force(spark):
    rows = table()
    got = R.class_ranges(spark.createDataFrame(rows, SCHEMA), SPEC, tolerance=2).collect()
    assert len(got) == 10
    for r in got:
        i = 1 + ["x", "y"].index(r.feature)
        own = [x[i] for x in rows if x[0] == r.label and x[i] is not None and not math.isnan(x[i])]
        others = [x[i] for x in rows if x[0] not in (None, r.label) and x[i] is not None and not math.isnan(x[i])]
        inside = sum(min(own) <= v <= max(own) for v in others)
        assert (r.min, r.max, r.n, r.n_other_inside, r.exclusive) == (min(own), max(own), len(own), inside, inside <= 2)


def test_decimals_of_numbers_with_exponents(spark):
    df = spark.createDataFrame([("a", v, w) for v, w in ((0.00012345, 1e20), (12345678.25, 1.5e-9), (2.0, 3e7))], SCHEMA)
    got = {r.feature: (r.max_decimals, r.assessment) for r in R.granularity(df, SPEC).collect()}
    assert got["x"] == (8, R.GRAIN_CONTINUOUS) and got["y"][0] == 10


@pytest.mark.parametrize(("chi2", "dof", "p"), [
    (13.962642807985333, 9, 0.12366031487432701), (6.961405392953978, 9, 0.6411377975098623), (5.373470401585979, 6, 0.49687945810631373),
    (0.5, 4, math.exp(-0.25) * 1.25), (90.0, 8, 4.6374e-16)])
def test_chi_square_tail(chi2, dof, p):
    """The recorded values, direct numeric integration of the density, and the closed form for an even dof."""
    got = float(R.chi2_tail(np.array([chi2]), np.array([dof]))[0])
    assert abs(got - p) < 1e-9
    x = np.linspace(chi2, chi2 + 400, 2_000_001)
    f = x ** (dof / 2 - 1) * np.exp(-x / 2) / (2 ** (dof / 2) * math.gamma(dof / 2))
    assert abs(got - float(((f[1:] + f[:-1]) / 2 * np.diff(x)).sum())) < 1e-7
    if dof % 2 == 0:
        assert abs(got - math.exp(-chi2 / 2) * sum((chi2 / 2) ** i / math.factorial(i) for i in range(dof // 2))) < 1e-12
