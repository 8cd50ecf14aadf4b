"""Kolmogorov-Smirnov against a plain loop and published values of Kolmogorov's law."""

import math
from statistics import NormalDist, mean, stdev

import numpy as np
import pytest
from pyspark.sql import functions as F

from premia.operators import hypothesis


def plain(values):
    x, n = sorted(values), len(values)
    law = NormalDist(mean(x), stdev(x))
    d = max(max(abs((i + 1) / n - law.cdf(v)), abs(i / n - law.cdf(v))) for i, v in enumerate(x))
    lam = (math.sqrt(n) + 0.12 + 0.11 / math.sqrt(n)) * d
    p = 2 * sum((-1) ** (k - 1) * math.exp(-2 * k * k * lam * lam) for k in range(1, 200))
    return d, min(1.0, max(0.0, p)) if lam >= 1 else 1 - math.sqrt(2 * math.pi) / lam * sum(
        math.exp(-(2 * k - 1) ** 2 * math.pi ** 2 / (8 * lam * lam)) for k in range(1, 200))


@pytest.mark.parametrize("n", [3, 20, 500, 4000])
def test_equals_plain_loop(spark, n):
    values = np.random.default_rng(n).gamma(2.0, 3.0, n).round(1)  # with ties
    df = spark.createDataFrame([(float(v),) for v in values], "v double").repartition(3)
    row = hypothesis.normality_test(df, "v", "kstest").first()
    d, p = plain(list(values))
    assert row.n == n and row.statistic == pytest.approx(d, abs=1e-7)
    assert row.p_value == pytest.approx(p, abs=1e-6)


def test_kolmogorov_law(spark):
    # published quantiles of Kolmogorov's law: P(K > 1.36) = 0.0494, P(K > 1.63) = 0.0098
    lams = [0.5, 1.0, 1.2238, 1.36, 1.63]
    df = spark.createDataFrame([(v,) for v in lams], "lam double")
    got = [r.p for r in df.select(hypothesis.kolmogorov_upper(F.col("lam")).alias("p")).collect()]
    assert got == pytest.approx([0.9639, 0.2700, 0.1, 0.0494, 0.0098], abs=5e-4)


def test_constant_values_give_no_row(spark):
    df = spark.createDataFrame([(2.0,)] * 10, "v double")
    assert hypothesis.normality_test(df, "v", "kstest").count() == 0
