"""Cleaning, features, quantiles, aggregates and trends on small fixtures."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from premia.functions.columns import missing_nan, normalise_status
from premia.operators import aggregates, clean, features, quantiles, returns, trends
from premia.schemas import AGE_EDGES, AGE_LABELS
from premia.sources import views


def test_quantiles_equal_numpy(spark):
    random = np.random.default_rng(1)
    groups = {"hot": np.concatenate([random.normal(0, 1e3, 3000), np.full(1500, 7.25)]),
              "tiny": np.array([1.0, 2.0, 4.0, 5.0, 10.0]), "one": np.array([-3.5]),
              "signs": np.array([-1e-9, 0.0, 1e-9, -1e9, 1e9, 0.0])}
    rows = [(g, float(v)) for g, vs in groups.items() for v in vs]
    rows += [("hot", None), ("none", None), (None, 5.0)]
    df = spark.createDataFrame(rows, "g string, v double").repartition(7)
    probs = [0, 0.05, 0.25, 0.5, 0.9, 0.99, 1]
    found = {r.g: r.v for r in quantiles.quantiles(df, ["v"], probs, ["g"]).collect()}
    for g, values in groups.items():
        assert found[g] == pytest.approx(np.quantile(values, probs), rel=1e-12), g
    assert None not in found and (found.get("none") is None)


def test_selection_of_several_columns_without_groups(spark):
    df = spark.range(1000).select((F.col("id") * 1.5).alias("a"), (-F.col("id")).alias("b"))
    row = quantiles.quantiles(df, ["a", "b"], [0.25, 0.5]).first()
    assert row.a == pytest.approx([374.625, 749.25]) and row.b == pytest.approx([-749.25, -499.5])


def test_quantiles_of_odd_values(spark):
    inf, nan = float("inf"), float("nan")
    rows = [("nan", v) for v in [*range(9), nan]] + [("inf", v) for v in [*range(9), inf]]
    rows += [("ids", 1.7e15 + k) for k in range(1001)] + [("none", None), ("none", None)]
    df = spark.createDataFrame([(g, None if v is None else float(v)) for g, v in rows],
                               "g string, v double")
    found = {r.g: r.v for r in quantiles.quantiles(df, ["v"], [0.5, 0.9, 1], ["g"]).collect()}
    assert found["nan"][:1] == [4.5] and np.isnan(found["nan"][2])
    assert found["inf"][0] == 4.5 and found["inf"][2] == inf
    assert found["ids"] == [1.7e15 + 500, 1.7e15 + 900, 1.7e15 + 1000]
    assert found["none"] is None


def test_numbers_of_rows_keep_null_keys_and_text_orders(spark):
    rows = [(None, "b"), (None, "a"), ("x", "c"), ("x", None), ("x", "a")]
    df = spark.createDataFrame(rows, "g string, t string")
    found = {(r.g, r.t): r.place for r in trends.number_rows(df, ["t"], ["g"]).collect()}
    assert found == {(None, "a"): 1, (None, "b"): 2, ("x", None): 1, ("x", "a"): 2, ("x", "c"): 3}


def test_status_and_missing_values(spark):
    df = spark.createDataFrame([(" active \t",), ("\nPaid_Up",), (None,)], "s string")
    assert [r[0] for r in df.select(normalise_status(F.col("s"))).collect()] == [
        "ACTIVE", "PAID_UP", None]
    df = spark.createDataFrame([(float("nan"), 1), (2.0, None)], "d double, i int")
    assert [tuple(r) for r in missing_nan(df).collect()] == [(None, 1), (2.0, None)]


def test_impute(spark):
    df = spark.createDataFrame(
        [(1, None, "x"), (2, 5.0, None), (None, 7.0, "y"), (9, 8.0, "y"), (4, 8.0, "x")],
        "n int, cash_value double, s string")
    filled = clean.impute_strings(clean.impute_numbers(df))
    rows = [tuple(r) for r in filled.collect()]
    assert (3.0, 7.0, "y") in rows  # median of 1 2 4 9
    assert (1.0, 0.0, "x") in rows and (2.0, 5.0, "x") in rows  # tie of x and y: smallest


def test_clean_policy_keeps_valid_rows(spark):
    rows = [
        ("1", "TL01", "2020-05-01", "5000", 40, " active "),
        ("1", "TL01", "2020-05-01", "5000", 40, " active "),
        ("2", "PA01", "not a date", "oops", 30, "ACTIVE"),
        ("3", "PA01", "2021-01-01", "7000", 121, "MATURED"),
        ("4", "PA01", "2021-01-01", "900", 30, "paid_up"),
        ("5", "PA01", "2021-01-01", "9000", 30, "lapsed"),
        ("6", "PA01", "2021-01-01", "9000", 30, None),
    ]
    df = spark.createDataFrame(rows, "policy_id string, product_code string, issue_date string, "
                                     "annual_premium string, insured_age int, policy_status string")
    kept = {r.policy_id: r for r in clean.clean_policy(df).collect()}
    assert set(kept) == {"1", "2"}
    assert kept["2"].issue_date is None
    assert kept["2"].annual_premium == 5000  # median of 5000, 7000 and 900
    audit = {r.step: r.affected_rows for r in clean.cleaning_audit(df).collect()}
    assert audit == {"删除重复行": 1, "填充缺失值 [annual_premium]": 1, "过滤低保费保单": 1}


def test_premium_cutoff_and_clip(spark):
    df = spark.createDataFrame([(str(i), "2020-01-01", 10.0 + i) for i in range(200)]
                               + [("x", "2020-01-01", 1e9), ("y", "2020-01-01", -5.0)],
                               "policy_id string, payment_date string, premium_amount double")
    kept = clean.clean_premium(df)
    assert kept.count() == 200 and kept.agg(F.max("premium_amount")).first()[0] == 209
    values = spark.createDataFrame([("a", "2020-01-01", v) for v in (-1.0, None, 2.0)],
                                   "policy_id string, valuation_date string, cash_value double")
    assert sorted(r.cash_value for r in clean.clean_cash_value(values).collect()) == [0, 0, 2]


def test_age_bins(spark):
    from premia.functions.columns import right_closed_bins
    ages = [0, 30, 31, 60, 61, 100, 101]
    df = spark.createDataFrame([(a,) for a in ages], "a int")
    found = [r[0] for r in df.select(
        right_closed_bins(F.col("a"), AGE_EDGES, AGE_LABELS)).collect()]
    assert found == [None, "18-30", "31-40", "51-60", "60+", "60+", None]


def tables(spark):
    premium = spark.createDataFrame(
        [("a", "2020-02-01", 100.0), ("a", "2020-08-01", 50.0), ("a", "2021-02-01", 100.0),
         ("b", "2021-03-01", 70.0)],
        "policy_id string, payment_date string, premium_amount double").withColumn(
        "payment_date", F.to_timestamp("payment_date"))
    value = spark.createDataFrame(
        [("a", "2020-06-30", 5.0), ("a", "2020-12-31", 90.0), ("a", "2020-12-31", 95.0),
         ("a", "2022-12-31", 300.0), ("b", "2022-12-31", 80.0)],
        "policy_id string, valuation_date string, cash_value double").withColumn(
        "valuation_date", F.to_timestamp("valuation_date"))
    dividend = spark.createDataFrame(
        [("a", "2021-12-31", 4.0), ("a", "2022-12-31", 6.0)],
        "policy_id string, dividend_date string, dividend_amount double").withColumn(
        "dividend_date", F.to_timestamp("dividend_date"))
    return premium, value, dividend


def test_cashflow_carries_values_within_a_policy(spark):
    rows = {(r.policy_id, r.year): r for r in features.cashflow_annual(*tables(spark)).collect()}
    assert set(rows) == {("a", 2020), ("a", 2021), ("a", 2022), ("b", 2021), ("b", 2022)}
    assert rows["a", 2020].cash_value_eoy == 95 and rows["a", 2020].premium_outflow == 150
    assert rows["a", 2021].cash_value_eoy == 95  # carried from 2020
    assert rows["b", 2021].cash_value_eoy == 0  # not from policy a
    assert rows["a", 2022].cumulative_premium == 250
    assert rows["a", 2022].cumulative_dividend == 10
    assert rows["a", 2021].net_cashflow == -96


def test_rollup_equals_last_running_total(spark):
    cashflow = features.cashflow_annual(*tables(spark))
    for r in features.policy_rollup(cashflow).collect():
        assert r.total_premium_paid == r.cumulative_premium
        assert r.total_dividend == r.cumulative_dividend
    no_dividend = features.cashflow_annual(*tables(spark)[:2])
    assert {r.dividend_amount for r in no_dividend.collect()} == {0}


def test_returns_of_each_product_type(spark):
    premium, value, dividend = tables(spark)
    many = [(f"{kind}-{pid}", kind) for kind in ("传统寿险", "分红型寿险", "万能险", "投连险")
            for pid in ("a", "b")]
    kinds = spark.createDataFrame(many, "id string, product_category string")

    def spread(df):
        return df.join(kinds, F.expr("substring_index(id, '-', -1) = policy_id")).drop(
            "policy_id").withColumnRenamed("id", "policy_id").drop("product_category")

    cashflow = features.cashflow_annual(spread(premium), spread(value), spread(dividend))
    policies = kinds.withColumnRenamed("id", "policy_id").unionByName(
        spark.createDataFrame([("lost", "万能险")], "policy_id string, product_category string"))
    wide = features.analysis_wide(policies, cashflow)
    rows = {r.policy_id: r for r in returns.policy_returns(wide, cashflow).collect()}
    assert len(rows) == 9 and rows["lost"].irr is None and rows["lost"].account_growth_rate is None
    plain, shared = rows["传统寿险-a"], rows["分红型寿险-a"]
    assert plain.total_return_rate == pytest.approx(300 / 250 - 1)
    assert plain.irr == pytest.approx(max(np.roots([-150, -100, 300]).real) - 1)
    assert shared.irr == pytest.approx(max(np.roots([-150, -96, 306]).real) - 1)
    assert shared.total_return_rate is None and shared.cv_total_return_rate == pytest.approx(0.2)
    assert shared.total_total_value == 310 and shared.dividend_yield_total == pytest.approx(0.04)
    assert rows["万能险-a"].account_growth_rate == pytest.approx(300 / 95 - 1)
    assert rows["万能险-b"].account_growth_rate is None  # first value is 0
    assert rows["投连险-a"].nav_growth_rate == pytest.approx(300 / 95 - 1)


def sample(spark):
    random = np.random.default_rng(5)
    rows = [(f"P{i:03}", ["传统寿险", "分红险", "万能险", "年金险"][i % 4], 2020 + i // 4 % 4,
             float(random.normal(0.04, 0.01)), float(random.normal(0.03, 0.01)),
             float(random.normal(0.2, 0.05))) for i in range(100)]
    return spark.createDataFrame(
        rows, "policy_id string, product_category string, issue_year int, irr double, "
              "annual_return_rate double, total_return_rate double")


def test_aggregates(spark):
    df = sample(spark)
    product = aggregates.by_product(df)
    pdf = df.toPandas()
    assert product.count() == 4
    for r in product.collect():
        irr = pdf[pdf.product_category == r.product_category].irr
        assert r.irr_count == 25 and r.irr_std == pytest.approx(irr.std())
        assert r.irr_median == pytest.approx(irr.median())
        assert (r.irr_p5, r.irr_p95) == pytest.approx(tuple(irr.quantile([0.05, 0.95])))
    assert aggregates.by_year(df).count() == 4
    assert aggregates.by_category_year(df).count() == 16
    summary = aggregates.summary_statistics(df).first()
    assert (summary.total_policies, summary.start_year, summary.end_year) == (100, 2020, 2023)
    assert summary.irr_median == pytest.approx(pdf.irr.median())


def test_degenerate_aggregates(spark):
    other = spark.createDataFrame([(1,), (2,), (3,)], "other_column int")
    assert aggregates.by_product(other).count() == 0
    assert aggregates.by_product(sample(spark).limit(0)).count() == 0
    assert aggregates.top_performers(other).count() == 0


def test_top_performers(spark):
    df, pdf = sample(spark), sample(spark).toPandas()
    best = aggregates.top_performers(df, n=3).collect()
    assert len(best) == 12
    everywhere = aggregates.top_performers(df, n=5, group=None).collect()
    assert [r.policy_id for r in everywhere] == list(pdf.nlargest(5, "irr").policy_id)


def test_yoy_change_bridges_gaps(spark):
    df = spark.createDataFrame([(2020, 2.0), (2021, None), (2022, 3.0)],
                               "issue_year int, irr_mean double")
    rows = {r.issue_year: r for r in aggregates.yoy_change(df).collect()}
    assert rows[2020].irr_mean_yoy is None
    assert rows[2021].irr_mean_yoy == 0 and rows[2021].irr_mean_yoy_abs is None
    assert rows[2022].irr_mean_yoy == pytest.approx(50) and rows[2022].irr_mean_yoy_abs is None


@pytest.mark.parametrize("values, slope, direction", [
    ([.02, .025, .03, .035, .04], 0.005, "上升"), ([.04, .035, .03, .025, .02], -0.005, "下降"),
    ([.03, .031, .029, .03, .03], -0.0001, "平稳")])
def test_yearly_trend(spark, values, slope, direction):
    df = spark.createDataFrame([(2019 + i, v) for i, v in enumerate(values)],
                               "issue_year int, irr_mean double")
    row = trends.linear_trend(df).first()
    assert row.slope == pytest.approx(slope) and row.trend_direction == direction
    assert row.total_change == pytest.approx(values[-1] - values[0])


def test_short_or_incomplete_trends_are_empty(spark):
    two = spark.createDataFrame([(2020, .1), (2021, .2)], "issue_year int, irr_mean double")
    assert trends.linear_trend(two).count() == 0
    assert trends.linear_trend(two, "no_such_column").count() == 0


def test_category_trends(spark):
    slopes = {"传统寿险": .005, "分红险": .0027, "万能险": .0026}
    rows = [(2020 + i, c, .03 + s * i) for c, s in slopes.items() for i in range(4)]
    df = spark.createDataFrame(rows, "issue_year int, product_category string, irr double")
    found = {r.product_category: r.slope for r in trends.category_trends(df).collect()}
    assert found == pytest.approx(slopes)


def test_moving_average_and_periods(spark):
    df = spark.createDataFrame([(y, float(y - 2019)) for y in range(2020, 2025)],
                               "issue_year int, irr double")
    found = trends.moving_average(df, "irr", ["issue_year"]).orderBy("issue_year").collect()
    assert [r.irr_ma3 for r in found] == [1, 1.5, 2, 3, 4]
    row = trends.compare_periods(df, "irr").first()
    assert (row.mean1, row.count1, row.mean2, row.count2) == (1.5, 2, 4.5, 2)
    assert row.difference == 3 and row.t_statistic == pytest.approx(-4.242640687)
    lone = trends.compare_periods(df, "irr", period1=(2020, 2020)).first()
    assert lone.t_statistic is None and lone.is_significant is False


def test_moving_average_in_blocks_equals_one_window(spark):
    random = np.random.default_rng(6)
    rows = [(["hot", "cold"][i % 10 == 0], float(random.integers(0, 50)), i,
             None if i % 17 == 0 else float(i)) for i in range(600)]
    df = spark.createDataFrame(rows, "g string, t double, id int, v double").repartition(5)
    for window, block in ((1, 10), (3, 10), (7, 7), (7, 50), (9, 2)):
        plain = trends.moving_average(df, "v", ["t", "id"], window, ["g"])
        blocks = trends.moving_average(df, "v", ["t", "id"], window, ["g"], block)
        name = f"v_ma{window}"
        found = {r.id: r[name] for r in blocks.collect()}
        assert len(found) == blocks.count() == 600
        for r in plain.collect():
            assert found[r.id] == (None if r[name] is None else pytest.approx(r[name]))


def test_year_with_a_dividend_alone_is_left_out(spark):
    premium, value, dividend = tables(spark)
    extra = spark.createDataFrame([("c", "2021-12-31", 9.0), ("b", "2020-12-31", 9.0)],
                                  "policy_id string, dividend_date string, dividend_amount double")
    dividend = dividend.unionByName(extra.withColumn("dividend_date", F.to_timestamp("dividend_date")))
    years = {(r.policy_id, r.year) for r in
             features.cashflow_annual(premium, value, dividend).collect()}
    assert years == {("a", 2020), ("a", 2021), ("a", 2022), ("b", 2021), ("b", 2022)}


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.fixture
def no_small_tables(spark):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    yield
    spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_year_end_values_move_once(spark):
    values = spark.sql("""SELECT * FROM VALUES
        ('a', TIMESTAMP '2020-03-01', 5D), ('a', TIMESTAMP '2020-12-01', 3D), ('a', TIMESTAMP '2020-12-01', 4D),
        ('a', TIMESTAMP '2021-01-01', 9D), ('a', TIMESTAMP '2021-02-01', NULL), ('b', TIMESTAMP '2020-01-01', -1D),
        (NULL, TIMESTAMP '2020-01-01', 1D), ('c', NULL, 1D) t(policy_id, valuation_date, cash_value)""")
    found = features.year_end_value(values)
    assert plan(found).count("Exchange hashpartitioning") == 1
    assert sorted(map(tuple, found.collect())) == [
        ("a", 2020, 4.0), ("a", 2021, None), ("b", 2020, -1.0)]


def test_grouped_quantiles_do_not_move_the_rows(spark, no_small_tables, monkeypatch):
    rng = np.random.default_rng(3)
    rows = [(int(g), float(v), float(v) ** 2) for g, v in zip(
        rng.integers(0, 3, 300), rng.normal(0, 9, 300).round(1))] + [(3, None, 1.0), (None, 1.0, 1.0)]
    df = spark.createDataFrame(rows, "g int, v double, w double")
    found = quantiles.quantiles(df, ["v", "w"], [0.1, 0.5], ["g"])
    assert plan(found).count("SortMergeJoin") == 1  # of the groups with their quantiles
    monkeypatch.setattr(quantiles, "_FEW_GROUPS", 2)
    for result in (found, quantiles.quantiles(df, ["v", "w"], [0.1, 0.5], ["g"])):
        for r in result.collect():
            for name, k in (("v", 1), ("w", 2)):
                own = [row[k] for row in rows if row[0] == r.g and row[k] is not None]
                assert r[name] == (pytest.approx(np.quantile(own, [0.1, 0.5])) if own else None)


def test_quantile_passes_count_without_sorting(spark):
    df = spark.range(100).select((F.col("id") * 0.5).alias("v"))
    found = quantiles.quantiles(df, ["v"], [0.25, 0.5])
    assert "SortAggregate(key=[name" not in plan(found)
    assert found.first().v == pytest.approx([12.375, 24.75])


def test_place_of_last_value_is_exact(spark):
    odd = [0.1, 1 / 3, -1 / 3, 5e-324, -2.3e-308, 1.7976931348623157e308, float("-inf"), 1e15 + 0.3]
    df = spark.createDataFrame([(v,) for v in odd], "v double")
    back = df.select("v", quantiles.value_of_key(quantiles.order_key(F.col("v"))).alias("back"))
    assert all(r.v == r.back for r in back.collect())
    rows = [("a", "1995-01-03 10:00:00", 5.0), ("a", "1995-01-03 10:00:00", 7.5),
            ("a", "1995-01-02 00:00:00", 99.0), ("b", "1960-05-05 00:00:00", -4.25),
            ("b", "1960-05-05 00:00:00", None), ("c", "2021-03-14 02:30:00.000001", 9.0),
            ("c", "2021-03-14 02:30:00", 11.0), ("d", "2000-01-01 00:00:00", 3.0),
            ("d", "2000-06-01 00:00:00", None), (None, "2000-01-01 00:00:00", 1.0)]
    for kind in ("timestamp_ntz", "timestamp", "date"):
        df = spark.createDataFrame(rows, "policy_id string, d string, cash_value double").select(
            "policy_id", F.col("d").cast(kind).alias("valuation_date"), "cash_value")
        found = {r.policy_id: r.cash_value_eoy for r in features.year_end_value(df).collect()}
        assert found == {"a": 7.5, "b": -4.25, "c": 11.0 if kind == "date" else 9.0, "d": None}


def test_cash_flows_are_combined_without_sorting_records(spark, no_small_tables):
    lines = "policy_id string, valuation_date timestamp_ntz, cash_value double"
    premium = spark.createDataFrame([], "policy_id string, payment_date date, premium_amount double")
    found = features.cashflow_annual(premium, spark.createDataFrame([], lines))
    assert "SortAggregate" not in plan(found)


def test_lines_meet_their_orders_without_sorting(spark, tmp_path, no_small_tables):
    spark.sql("SELECT 1L AS o_orderkey, 5L AS o_custkey").write.parquet(f"{tmp_path}/orders.parquet")
    spark.sql("""SELECT 1L AS l_orderkey, 2.0D AS l_quantity, 3.0D AS l_extendedprice,
        0.5D AS l_discount, 'R' AS l_returnflag, TIMESTAMP_NTZ'1995-01-01 00:00:00' AS l_shipdate
        """).write.parquet(f"{tmp_path}/lineitem.parquet")
    for table, amount in ((views.cash_value, 6.0), (views.dividend, 1.5)):
        found = table(spark, str(tmp_path))
        assert "ShuffledHashJoin" in plan(found) and "SortMergeJoin" not in plan(found)
        assert [(r[0], r[2]) for r in found.collect()] == [("5", amount)]


def test_distinct_records_have_no_table_before_their_shuffle(spark):
    df = spark.createDataFrame([("a", None, 1.0)] * 3, "policy_id string, dividend_date date, "
                               "dividend_amount double")
    found = clean.clean_dividend(df)
    assert plan(found).rindex("HashAggregate") < plan(found).index("Exchange")
    assert found.count() == 1


def test_distinct_premiums_are_stored_for_the_quantile(spark):
    rows = [("a", None, float(k)) for k in range(1, 50)] * 2 + [("a", None, 1e6), ("b", None, -1.0)]
    df = spark.createDataFrame(rows, "policy_id string, payment_date date, premium_amount double")
    found = clean.clean_premium(df, prob=0.5)
    assert found.count() == 49
    assert "premium-" in plan(found) or "InMemoryTableScan" in plan(found)
