"""Tests, correlation and regression against closed forms and NumPy."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from premia.functions.special import f_upper
from premia.operators import correlation, hypothesis, regression

WEIGHTS = [148, 154, 158, 160, 161, 162, 166, 170, 182, 195, 236]


def column(spark, values):
    return spark.createDataFrame([(i, float(v)) for i, v in enumerate(values)],
                                 "id int, v double")


def test_dagostino(spark):
    scores = hypothesis.skew_kurtosis_scores(column(spark, WEIGHTS), "v").first()
    assert scores.z_skew == pytest.approx(2.7788579770, abs=1e-9)
    assert scores.z_kurtosis == pytest.approx(2.3048235214, abs=1e-9)
    row = hypothesis.normality_test(column(spark, WEIGHTS), "v", "normaltest").first()
    assert row.statistic == pytest.approx(13.0342631212, abs=1e-8)
    assert row.p_value == pytest.approx(0.0014779023, abs=1e-9) and row.is_normal is False


def test_shapiro_francia_uses_all_values(spark):
    from statistics import NormalDist
    rng = np.random.default_rng(3)
    for data in (np.array(WEIGHTS, float), rng.normal(size=12_000), rng.exponential(size=300).round(1)):
        x, n = np.sort(data), len(data)
        ranks = np.array([(x < v).sum() + ((x == v).sum() + 1) / 2 for v in x])
        m = np.array([NormalDist().inv_cdf((r - 0.375) / (n + 0.25)) for r in ranks])
        w = np.corrcoef(x, m)[0, 1] ** 2
        log_n = np.log(n)
        z = ((np.log(1 - w) - (-1.2725 + 1.0521 * (np.log(log_n) - log_n)))
             / (1.0308 - 0.26758 * (np.log(log_n) + 2 / log_n)))
        row = hypothesis.normality_test(column(spark, data.tolist()), "v").first()
        assert row.n == n and row.statistic == pytest.approx(w, abs=1e-8)
        assert row.p_value == pytest.approx(1 - NormalDist().cdf(z), abs=1e-6)


def test_f_tail_at_large_freedom(spark):
    row = spark.sql("select 1D as f, 1e6 as a, 1e7 as b").select(f_upper("f", "a", "b").alias("p"))
    assert row.first().p == pytest.approx(0.499839, abs=2e-6)


def test_kolmogorov_smirnov(spark):
    row = hypothesis.normality_test(column(spark, WEIGHTS), "v", "kstest").first()
    x = np.sort(np.array(WEIGHTS, dtype=float))
    from statistics import NormalDist
    law = NormalDist(x.mean(), x.std(ddof=1))
    cdf = np.array([law.cdf(v) for v in x])
    steps = np.arange(len(x) + 1) / len(x)
    expected = max((steps[1:] - cdf).max(), (cdf - steps[:-1]).max())
    assert row.statistic == pytest.approx(expected, abs=1e-9) and 0 < row.p_value < 1


def test_too_few_values(spark):
    two = column(spark, [1, 2])
    for kind in ("shapiro", "kstest", "normaltest"):
        assert hypothesis.normality_test(two, "v", kind).count() == 0


def groups(spark, **values):
    return spark.createDataFrame([(g, float(v)) for g, vs in values.items() for v in vs],
                                 "g string, v double")


def test_ttest(spark):
    a, b = [30.02, 29.99, 30.11, 29.97, 30.01, 29.99], [29.89, 29.93, 29.72, 29.98, 30.02, 29.98]
    row = hypothesis.ttest(groups(spark, b=b, a=a, c=[1, 2]), "v", "g").first()
    assert (row.group1, row.group2) == ("a", "b")
    assert row.t_statistic == pytest.approx(1.959006, abs=1e-5)
    assert row.p_value == pytest.approx(0.07856577, abs=1e-7)
    turned = hypothesis.ttest(groups(spark, b=b, a=a), "v", "g", ["b", "a"]).first()
    assert turned.t_statistic == pytest.approx(-1.959006, abs=1e-5)
    assert hypothesis.ttest(groups(spark, a=[1], b=[1, 2]), "v", "g").count() == 0


def test_anova(spark):
    data = {"a": [6, 8, 4, 5, 3, 4], "b": [8, 12, 9, 11, 6, 8], "c": [13, 9, 11, 8, 7, 12]}
    row = hypothesis.anova(groups(spark, **data), "v", "g").first()
    assert row.f_statistic == pytest.approx(9.3, abs=0.05)
    assert row.eta_squared == pytest.approx(84 / 152)
    assert row.p_value == pytest.approx(0.0024, abs=1e-4) and row.significant
    with_single = hypothesis.anova(groups(spark, **data, d=[50]), "v", "g").first()
    assert with_single.number_of_groups == 3
    assert with_single.f_statistic == pytest.approx(row.f_statistic)
    assert with_single.eta_squared > row.eta_squared
    assert hypothesis.anova(groups(spark, a=[1, 2], b=[1, 2]), "v", "g").count() == 0


def test_compare_by_category(spark):
    df = groups(spark, x=[1, 2, 3], y=[4, 5, 6]).withColumnsRenamed(
        {"g": "product_category", "v": "irr"})
    found = hypothesis.compare_by_category(df)
    assert found["anova"].count() == 0 and found["ttest"].count() == 1
    best = found["summary"].first()
    assert (best.highest_category, best.lowest_category, best.mean_range) == ("y", "x", 3)


def pairs(spark, x, y):
    return spark.createDataFrame([(i, float(a), float(b)) for i, (a, b) in enumerate(zip(x, y))],
                                 "id int, x double, y double")


def test_correlations(spark):
    random = np.random.default_rng(2)
    x = random.integers(0, 20, 400)
    y = x + random.integers(-15, 15, 400)
    df = pairs(spark, x, y).unionByName(
        spark.createDataFrame([(900, None, 5.0), (901, 5.0, None)],
                              "id int, x double, y double"))
    row = correlation.pearson(df, "x", "y").first()
    assert row.n == 400 and row.correlation == pytest.approx(np.corrcoef(x, y)[0, 1])

    def ranks(v):
        return np.array([(v < a).sum() + ((v == a).sum() + 1) / 2 for a in v])

    expected = np.corrcoef(ranks(x), ranks(y))[0, 1]
    assert correlation.spearman(df, "x", "y").first().correlation == pytest.approx(expected)
    matrix = {(r.var1, r.var2): r for r in correlation.correlation_matrix(
        df, ["x", "y"], "spearman").collect()}
    assert matrix["x", "y"].correlation == pytest.approx(expected)
    assert matrix["x", "x"].p_value == 1 and matrix["x", "y"].notable
    assert correlation.correlation_matrix(df, ["x"]).count() == 0
    assert correlation.pearson(pairs(spark, [1, 2], [3, 4]), "x", "y").count() == 0
    perfect = correlation.pearson(pairs(spark, [1, 2, 3, 4], [2, 4, 6, 8]), "x", "y").first()
    assert perfect.p_value == pytest.approx(0, abs=1e-12) and perfect.strength == "强相关"


def test_quartile_table(spark):
    df = pairs(spark, range(1, 9), range(8)).withColumnsRenamed(
        {"x": "annual_premium", "y": "irr"})
    rows = correlation.quartile_table(df).orderBy("ordinal").collect()
    assert [(r.quartile, r.count_) for r in [
        type("R", (), {"quartile": r.quartile, "count_": r["count"]}) for r in rows]] == [
        ("低", 2), ("中低", 2), ("中高", 2), ("高", 2)]
    collapsed = pairs(spark, [5] * 6 + [7, 9], range(8)).withColumnsRenamed(
        {"x": "annual_premium", "y": "irr"})
    assert sum(r["count"] for r in correlation.quartile_table(collapsed).collect()) == 8


def test_key_drivers(spark):
    df = pairs(spark, range(30), [v * v for v in range(30)]).withColumn("z", F.lit(1.0))
    top = correlation.key_drivers(df, "y", ["x", "z"], top_n=1).collect()
    assert [(r.feature, r["rank"]) for r in top] == [("x", 1)]


def fitted(x, y):
    design = np.column_stack([np.ones(len(x)), x])
    beta = np.linalg.lstsq(design, y, rcond=None)[0]
    e = y - design @ beta
    return design, beta, e


def test_simple_ols(spark):
    random = np.random.default_rng(8)
    x = random.uniform(0, 10, 200)
    y = 3 + 2 * x + random.normal(0, 1, 200)
    _, beta, e = fitted(x, y)
    row = regression.simple_ols(pairs(spark, x, y).repartition(6), "x", "y", order=["id"]).first()
    assert (row.intercept, row.slope) == pytest.approx(tuple(beta))
    assert row.rmse == pytest.approx(np.sqrt((e ** 2).sum() / 198))
    assert row.residuals_std == pytest.approx(e.std())
    assert row.durbin_watson == pytest.approx((np.diff(e) ** 2).sum() / (e ** 2).sum())
    assert regression.simple_ols(pairs(spark, [1, 2], [1, 2]), "x", "y").count() == 0


def test_durbin_watson_over_many_partitions(spark):
    random = np.random.default_rng(9)
    e = random.normal(0, 1, 5000).cumsum()
    df = column(spark, e).repartition(13)
    spark.conf.set("spark.sql.shuffle.partitions", "17")
    try:
        found = regression.durbin_watson(df, "v", ["id"]).first()[0]
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")
    assert found == pytest.approx((np.diff(e) ** 2).sum() / (e ** 2).sum())


def test_multiple_ols(spark):
    random = np.random.default_rng(10)
    x = random.normal(2020, 5, (300, 3)) * [1, 1000, 0.01]
    y = 5 + x @ [2, 0.001, 30] + random.normal(0, 1, 300)
    df = spark.createDataFrame([(i, *map(float, r), float(v)) for i, (r, v) in
                                enumerate(zip(x, y))], "id int, a double, b double, c double, y double")
    names = ["a", "b", "c"]
    fit = regression.fit_ols(df, "y", names)
    design, beta, e = fitted(x, y)
    mse = (e ** 2).sum() / 296
    errors = np.sqrt(np.diag(mse * np.linalg.inv(design.T @ design)))
    terms = regression.ols_terms(fit, names).collect()
    assert [t.term for t in terms] == ["intercept", *names]
    assert [t.coefficient for t in terms] == pytest.approx(beta, rel=1e-5)
    assert [t.std_error for t in terms] == pytest.approx(errors, rel=1e-5)
    row = regression.ols_summary(df, fit, "y", names, order=["id"]).first()
    r2 = 1 - (e ** 2).sum() / ((y - y.mean()) ** 2).sum()
    assert row.r_squared == pytest.approx(r2) and row.rmse == pytest.approx(np.sqrt(mse))
    assert row.durbin_watson == pytest.approx((np.diff(e) ** 2).sum() / (e ** 2).sum(), rel=1e-6)
    assert row.condition_number == pytest.approx(np.linalg.cond(design), rel=1e-3)
    assert row.significant_variables == names
    scored = regression.predict(df, fit, names).orderBy("id").toPandas()
    assert np.allclose(scored.prediction, design @ beta, rtol=1e-7)
    assert regression.fit_ols(df.limit(4), "y", names).count() == 0
    doubled = df.withColumn("b", F.col("a") * 2)
    assert regression.fit_ols(doubled, "y", ["a", "b"]).count() in (0, 1)


def test_irr_drivers(spark):
    df = pairs(spark, range(20), [2 * v for v in range(20)]).withColumnsRenamed(
        {"x": "annual_premium", "y": "irr"}).withColumn("insured_age", F.col("id") % 7)
    rows = regression.irr_drivers(df).orderBy("rank").collect()
    assert [r.driver for r in rows] == ["annual_premium", "insured_age"]
    assert rows[0].r_squared == pytest.approx(1)
    assert regression.irr_drivers(df.drop("insured_age")).count() == 0


def test_spearman_matrix_takes_one_range_pass(spark):
    from premia.operators import correlation
    import numpy as np
    random = np.random.default_rng(3)
    data = random.integers(0, 20, (400, 4)).astype(float)
    df = spark.createDataFrame([tuple(map(float, row)) for row in data], "a double, b double, c double, d double")
    found = {(r.var1, r.var2): r.correlation
             for r in correlation.correlation_matrix(df, ["a", "b", "c", "d"], "spearman").collect()}

    def ranks(x):
        order = x.argsort(kind="stable")
        r = np.empty(len(x))
        r[order] = np.arange(1, len(x) + 1)
        for v in np.unique(x):
            r[x == v] = r[x == v].mean()
        return r
    ranked = np.array([ranks(data[:, i]) for i in range(4)])
    want = np.corrcoef(ranked)
    for i, x in enumerate("abcd"):
        for j, y in enumerate("abcd"):
            assert abs(found[(x, y)] - want[i, j]) < 1e-12


def test_ranks_of_frequent_values_are_broadcast(spark):
    rng = np.random.default_rng(5)
    x, y, z = rng.integers(0, 3, 4000), rng.normal(size=4000), rng.integers(0, 1500, 4000)
    y = y + x
    df = spark.createDataFrame([tuple(map(float, r)) for r in zip(x, y, z)] + [(None, 1.0, 2.0)],
                               "x double, y double, z double")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    try:
        found = correlation.correlation_matrix(df, ["x", "y", "z"], "spearman")
        plan = found._jdf.queryExecution().executedPlan().toString()
        got = {(r.var1, r.var2): r.correlation for r in found.collect()}
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert plan.count("BroadcastHashJoin") >= 3

    def ranks(a):
        _, inverse, counts = np.unique(a, return_inverse=True, return_counts=True)
        return (np.cumsum(counts) - (counts - 1) / 2)[inverse]

    expected = np.corrcoef([ranks(x), ranks(y), ranks(z)])
    for i, a in enumerate("xyz"):
        for j, b in enumerate("xyz"):
            assert got[a, b] == pytest.approx(expected[i, j], abs=1e-12)
