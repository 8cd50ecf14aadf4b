"""Rate solvers, return rates and tail probabilities against known values."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from premia.functions import rates, solvers
from premia.functions.special import chi2_upper_2df, f_upper, t_two_sided
from premia.operators import cashflows

FLOWS = {
    "simple": ([-1000, 300, 400, 400, 300], 0.1489502813),
    "one period": ([-1000, 1100], 0.10),
    "no negative": ([100, 100, 100], None),
    "no positive": ([-100, -100, -100], None),
    "one flow": ([-1000], None),
    "empty": ([], None),
    "with zero": ([-1000, 0, 500, 600], 0.0382243400),
    "tiny": ([-0.01, 0.011], 0.10),
    "zeros at both ends": ([0, -1000, 1100, 0], 0.10),
    "traditional": ([-20000] * 4 + [95000], 0.0699355936),
    "participating": ([-18000, -17000, -16500, -16800, 103300], 0.1704145701),
    "two roots": ([-100, 230, -132], 0.10),
    "roots on both sides of zero": ([-100, 195, -94.5], 0.05),
}


def solve(spark, flows, column):
    df = spark.createDataFrame(
        [(name, [float(x) for x in values]) for name, values in flows.items()],
        "name string, flows array<double>")
    return {r.name: r.rate for r in df.select("name", column.alias("rate")).collect()}


def test_irr_cases(spark):
    found = solve(spark, {k: v for k, (v, _) in FLOWS.items()}, solvers.irr(F.col("flows")))
    for name, (_, expected) in FLOWS.items():
        if expected is None:
            assert found[name] is None, name
        else:
            assert found[name] == pytest.approx(expected, abs=1e-9), name


def test_irr_makes_present_value_zero_and_is_nearest(spark):
    random = np.random.default_rng(3)
    series = {str(i): list(random.normal(0, 100, size=random.integers(2, 15)))
              for i in range(300)}
    found = solve(spark, series, solvers.irr(F.col("flows")))
    solved = 0
    for name, flows in series.items():
        roots = np.roots(flows)
        real = [r.real - 1 for r in roots if abs(r.imag) < 1e-12 and r.real > 0]
        if not real:
            assert found[name] is None
            continue
        solved += 1
        nearest = min(real, key=abs)
        assert found[name] == pytest.approx(nearest, rel=1e-6, abs=1e-8)
        terms = [f / (1 + found[name]) ** i for i, f in enumerate(flows)]
        assert abs(sum(terms)) < 1e-6 * sum(abs(t) for t in terms)
    assert solved > 100


def test_series_with_one_sign_change_always_has_a_rate(spark):
    random = np.random.default_rng(4)
    series = {str(i): list(-random.uniform(1e2, 1e6, size=random.integers(1, 12)))
              + [float(random.uniform(1, 1e7))] for i in range(200)}
    assert all(rate is not None for rate in
               solve(spark, series, solvers.irr(F.col("flows"))).values())


def test_curves_that_only_touch_zero_have_a_rate(spark):
    series, wanted = {}, {}
    for scale in (1.0, 37.0, 1e5):
        for k in range(59):
            g = 0.8 + 0.01 * k
            key = f"{scale} {k}"
            series[key], wanted[key] = [-scale, 2 * g * scale, -g * g * scale], g - 1
    found = solve(spark, series, solvers.irr(F.col("flows")))
    assert all(found[k] == pytest.approx(wanted[k], abs=1e-5) for k in wanted)


def dated(spark, rows):
    return spark.createDataFrame(rows, "id string, day string, flow double").withColumn(
        "day", F.to_timestamp("day"))


def test_xirr(spark):
    df = dated(spark, [
        ("a", "2020-01-01", -1000.0), ("a", "2021-01-01", 500.0), ("a", "2022-01-01", 700.0),
        ("b", "2020-01-01", -600.0), ("b", "2020-01-01", -400.0), ("b", "2020-12-31", 1100.0)])
    found = {r.id: r.xirr for r in cashflows.xirr_by_group(df, ["id"], "day", "flow").collect()}
    assert found["a"] == pytest.approx(0.12298293, abs=1e-7)
    assert found["b"] == pytest.approx(0.10, abs=1e-9)


def test_xirr_needs_equal_lengths(spark):
    df = spark.createDataFrame([([-1.0, 2.0], [0.0])], "f array<double>, t array<double>")
    assert df.select(solvers.xirr(F.col("f"), F.col("t")).alias("x")).first().x is None


def ordered(spark, flows):
    return spark.createDataFrame([("a", i, float(f)) for i, f in enumerate(flows)],
                                 "id string, i int, flow double")


def test_mirr_and_npv(spark):
    df = ordered(spark, [-1000, 300, 400, 400, 300])
    assert cashflows.mirr_by_group(df, ["id"], "i", "flow").first().mirr == pytest.approx(
        0.1082073672, abs=1e-9)
    assert cashflows.npv_by_group(df, ["id"], "i", "flow", 0.05).first().npv == pytest.approx(
        240.8718589477, abs=1e-8)
    for flows in ([100, 100], [-100, -100], [-1000]):
        assert cashflows.mirr_by_group(
            ordered(spark, flows), ["id"], "i", "flow").first().mirr is None


def test_batch_irr_sums_flows_of_one_period(spark):
    df = ordered(spark, [-1000, 1100]).unionAll(ordered(spark, [-500, 550]))
    assert cashflows.irr_by_group(df, ["id"], "i", "flow").first().irr == pytest.approx(0.1)


def value_return(spark, premium, value, years):
    df = spark.createDataFrame([(float(premium), float(value), float(years))],
                               "p double, v double, y double")
    parts = rates.value_return(F.col("p"), F.col("v"), F.col("y"))
    return df.select([c.alias(n) for n, c in parts.items()]).first()


def test_value_return(spark):
    gain = value_return(spark, 100_000, 120_000, 5)
    assert gain.total_return_rate == pytest.approx(0.20)
    assert gain.annual_return_rate == pytest.approx(0.0371372893, abs=1e-9)
    loss = value_return(spark, 100_000, 80_000, 5)
    assert loss.total_return_rate == pytest.approx(-0.20)
    assert loss.annual_return_rate == pytest.approx(-0.0436475002, abs=1e-9)
    assert value_return(spark, 1e9, 1.2e9, 10).annual_return_rate == pytest.approx(
        0.0183993761, abs=1e-9)
    assert list(value_return(spark, 0, 1000, 5)) == [None, None, None]
    assert list(value_return(spark, 1000, 1000, 0)) == [None, None, None]


def test_other_rates(spark):
    one = spark.range(1)
    lit = lambda x: F.lit(float(x))
    dividend = one.select([c.alias(n) for n, c in rates.dividend_return(
        lit(100_000), lit(15_000), lit(5)).items()]).first()
    assert tuple(dividend) == (pytest.approx(0.15), pytest.approx(0.03))
    total = one.select([c.alias(n) for n, c in rates.comprehensive_return(
        lit(100_000), lit(120_000), lit(15_000), lit(5)).items()]).first()
    assert total.total_value == 135_000 and total.total_return_rate == pytest.approx(0.35)
    assert total.annual_return_rate == pytest.approx(0.0618587588, abs=1e-9)
    linked = one.select([c.alias(n) for n, c in rates.investment_linked_return(
        lit(10), lit(2), lit(12), lit(3), lit(2)).items()]).first()
    assert linked.nav_growth_rate == pytest.approx(0.5)
    assert linked.total_return_rate == pytest.approx(0.8)
    universal = one.select([c.alias(n) for n, c in rates.universal_life_return(
        lit(100), lit(121), lit(2), lit(0.03)).items()]).first()
    assert tuple(universal) == (pytest.approx(0.21), pytest.approx(0.03), pytest.approx(0.1))
    simple = one.select(rates.annual_return(lit(100), lit(150), lit(5), "simple")).first()[0]
    assert simple == pytest.approx(0.1)


@pytest.mark.parametrize("expression, expected", [
    (lambda: t_two_sided("2D", "10"), 0.0733880348),
    (lambda: t_two_sided("0D", "7"), 1.0),
    (lambda: t_two_sided("-1D", "1"), 0.5),
    # normal tail plus the first term of its expansion, density * (t^3 + t) / (4 df) on each side
    (lambda: t_two_sided("1.959963984540054D", "1e5"),
     0.05 + 2 * 0.058445069805 * (1.959963984540 ** 3 + 1.959963984540) / 4e5),
    (lambda: f_upper("3D", "2", "10"), 0.0953674316),
    (lambda: f_upper("4D", "1", "10"), 0.0733880348),
    (lambda: chi2_upper_2df("13.0342631212D"), 0.0014779023),
])
def test_tail_probabilities(spark, expression, expected):
    assert spark.range(1).select(expression()).first()[0] == pytest.approx(expected, abs=1e-9)


def test_tail_of_very_many_rows(spark):
    row = spark.range(1).select(t_two_sided("1.959963984540054D", "1e13").alias("t"),
                                f_upper("3.841458820694124D", "1", "1e13").alias("f")).first()
    assert row.t == pytest.approx(0.05, abs=1e-7) and row.f == pytest.approx(0.05, abs=1e-7)
    assert spark.range(1).select(t_two_sided("CAST(NULL AS DOUBLE)", "5")).first()[0] is None


def test_one_sign_change_by_bisection_in_linear_time():
    import time

    import numpy as np

    from premia.functions import solvers
    flows = np.concatenate([-np.ones(1000), np.full(4000, 0.6)])[None, :]
    assert solvers.sign_changes(flows).tolist() == [1]
    started = time.perf_counter()
    rate = solvers._single_root_rates(flows)[0]
    assert time.perf_counter() - started < 0.1
    assert abs((flows[0] / (1 + rate) ** np.arange(5000)).sum()) < 1e-8
    random = np.random.default_rng(9)
    for _ in range(200):
        m = int(random.integers(2, 40))
        paid = int(random.integers(1, m))
        row = np.concatenate([-random.uniform(1, 9, paid), random.uniform(0, 9, m - paid)])
        row[-1] += 1
        assert np.isclose(solvers._single_root_rates(row[None, :])[0],
                          solvers._nearest_zero_rates(row[None, :])[0], rtol=1e-9, atol=1e-12)
