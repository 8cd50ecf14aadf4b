"""Shapiro-Wilk W and p against a plain loop over Royston's algorithm and a published example."""

import math
from statistics import NormalDist

import numpy as np
import pytest

from premia.operators import hypothesis

PHI = NormalDist()


def plain(x):
    """Royston's AS R94 in Python over sorted values (no ties handled specially)."""
    x, n = sorted(x), len(x)
    m = [PHI.inv_cdf((i - 0.375) / (n + 0.25)) for i in range(1, n + 1)]
    mm = sum(v * v for v in m)
    if n == 3:
        a = [-math.sqrt(0.5), 0.0, math.sqrt(0.5)]
    else:
        u = 1 / math.sqrt(n)
        poly = lambda c: sum(k * u ** j for j, k in enumerate(c))
        an = m[-1] / math.sqrt(mm) + poly(hypothesis._LAST)
        a = [0.0] * n
        if n > 5:
            an1 = m[-2] / math.sqrt(mm) + poly(hypothesis._NEXT)
            phi = (mm - 2 * m[-1] ** 2 - 2 * m[-2] ** 2) / (1 - 2 * an ** 2 - 2 * an1 ** 2)
            a = [v / math.sqrt(phi) for v in m]
            a[0], a[1], a[-2], a[-1] = -an, -an1, an1, an
        else:
            phi = (mm - 2 * m[-1] ** 2) / (1 - 2 * an ** 2)
            a = [v / math.sqrt(phi) for v in m]
            a[0], a[-1] = -an, an
    mean = sum(x) / n
    ss = sum((v - mean) ** 2 for v in x)
    w = min(1.0, sum(ai * xi for ai, xi in zip(a, x)) ** 2 / ss)
    if n == 3:
        return w, max(0.0, 6 / math.pi * (math.asin(math.sqrt(w)) - math.pi / 3))
    y = math.log(1 - w)
    if n <= 11:
        gamma = -2.273 + 0.459 * n
        if y >= gamma:
            return w, 1e-99
        y = -math.log(gamma - y)
        mu = sum(c * n ** j for j, c in enumerate(hypothesis._SMALL_MEAN))
        sigma = math.exp(sum(c * n ** j for j, c in enumerate(hypothesis._SMALL_SPREAD)))
    else:
        ln = math.log(n)
        mu = sum(c * ln ** j for j, c in enumerate(hypothesis._LARGE_MEAN))
        sigma = math.exp(sum(c * ln ** j for j, c in enumerate(hypothesis._LARGE_SPREAD)))
    return w, 1 - PHI.cdf((y - mu) / sigma)


def run(spark, values):
    df = spark.createDataFrame([(float(v),) for v in values], "v double").repartition(3)
    row = hypothesis.normality_test(df, "v", "shapiro_wilk").first()
    return row.statistic, row.p_value, row.n


@pytest.mark.parametrize("n", [3, 4, 5, 6, 11, 12, 50, 700])
def test_equals_plain_loop(spark, n):
    values = np.random.default_rng(n).lognormal(0, 0.6, n)
    w, p, count = run(spark, values)
    want_w, want_p = plain(values)
    assert count == n
    assert w == pytest.approx(want_w, abs=1e-7)
    assert p == pytest.approx(want_p, rel=1e-4, abs=1e-9)


def test_published_example(spark):
    # Shapiro and Wilk (1965): weights of eleven men; W = 0.79 with their exact weights.
    w, p, _ = run(spark, [148, 154, 158, 160, 161, 162, 166, 170, 182, 195, 236])
    assert w == pytest.approx(0.79, abs=0.005)
    assert p < 0.01


def test_ties_take_the_ranks_they_cover(spark):
    values = [1.0] * 9000 + [2.0] * 5 + [3.5, -4.0]
    w, p, n = run(spark, values)
    assert n == 9007
    assert w == pytest.approx(plain(values)[0], abs=1e-7)


def test_equal_values_and_too_few(spark):
    assert run(spark, [2.0] * 20)[:2] == (1.0, 1.0)
    df = spark.createDataFrame([(1.0,), (2.0,)], "v double")
    assert hypothesis.normality_test(df, "v", "shapiro_wilk").count() == 0
