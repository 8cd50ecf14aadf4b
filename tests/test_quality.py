"""Quality checks on small fixtures."""

import pytest
from pyspark.sql import functions as F

from premia.operators import quality, report


def policies(spark, rows):
    return spark.createDataFrame(
        rows, "policy_id string, issue_date string, maturity_date string, annual_premium double, "
              "sum_assured double, insured_age int, policy_status string")


ROWS = [
    ("1", "2020-01-01", "2030-01-01", 5000.0, 100000.0, 30, "ACTIVE"),
    ("1", "2020-01-01", "2020-01-01", 500.0, 100000.0, 90, "INFORCE"),
    ("2", "2020-01-01", None, 0.0, 100000.0, 40, None),
    ("3", "2020-01-01", "2019-01-01", None, 1000.0, 50, "LAPSED"),
]


def metrics(df):
    return {(r["column"], r["check"]): r for r in df.collect()}


def test_policy_metrics(spark):
    found = metrics(quality.validate_table(policies(spark, ROWS), "policy"))
    assert found["annual_premium", "missing"].rate == 0.25
    assert found["*", "total_cells"].value == 28
    assert found["annual_premium", "below_min"].value == 2
    assert found["sum_assured", "below_min"].value == 1
    assert found["insured_age", "above_max"].value == 1
    assert ("insured_age", "below_min") not in found
    assert found["policy_status", "invalid_value"].value == 2  # INFORCE and the missing one
    assert found["policy_id", "duplicates"].value == 1
    assert found["maturity_date", "date_issues"].value == 2
    assert found["sum_assured", "ratio_issues"].value == 0
    assert not any(check == "outliers" for _, check in found)  # under ten values


def test_unreadable_dates_skip_the_check(spark):
    rows = ROWS + [("9", "2020-01-01", "soon", 5000.0, 1e5, 30, "ACTIVE")]
    assert quality.date_order_issues(policies(spark, rows)).first().issues == 0


def test_outliers(spark):
    df = spark.createDataFrame([(float(i),) for i in range(20)] + [(500.0,), (-400.0,), (None,)],
                               "v double")
    row = quality.iqr_outliers(df, "t").first()
    assert row.value == 2 and row.rate == pytest.approx(2 / 22)
    assert (row.lower, row.upper) == pytest.approx((-11.5, 30.5))


def test_score_formula(spark):
    value = quality.score(*[F.lit(x) for x in (.1, 2, 10, 4, 5, .05)])
    assert spark.range(1).select(value).first()[0] == pytest.approx(82)
    bad = quality.score(*[F.lit(x) for x in (1.0, 20, 10, 4, 5, .05)])
    assert spark.range(1).select(bad).first()[0] == 0


def test_orphans_and_summary(spark):
    policy = policies(spark, ROWS)
    ids = [str(i) for i in range(1, 9)] + ["8", None]
    premium = spark.createDataFrame([(i, "2020-01-01", 500.0) for i in ids],
                                    "policy_id string, payment_date string, premium_amount double")
    value = spark.createDataFrame([("1", "2020-01-01", 5.0)],
                                  "policy_id string, valuation_date string, cash_value double")
    found, lost = quality.validate_all(policy, premium, value)
    rows = lost.collect()
    assert [(r["table"], r.orphan_count) for r in rows] == [("premium", 6)]
    assert rows[0].sample_ids == ["4", "5", "6", "7", "8"]
    kept = premium.join(policy, "policy_id", "left_semi").select("policy_id").distinct().count()
    assert kept + rows[0].orphan_count == premium.select("policy_id").distinct().count()
    summary = quality.validation_summary(found, lost).first()
    assert (summary.tables_validated, summary.critical_issues_count) == (3, 1)
    assert summary.warnings_count == 2  # policy: premium and status; premium: policy_id
    accepted = quality.acceptance(quality.validation_summary(found, lost)).first()
    assert accepted.is_acceptable == (accepted.overall_quality_score >= 70)
    tables = report.quality_tables(found, quality.validation_summary(found, lost))
    assert {r["table"] for r in tables["scores"].collect()} == {"policy", "premium", "cash_value"}
    assert all(0 <= r.quality_score <= 100 for r in tables["details"].collect())


def test_empty_tables(spark):
    empty = policies(spark, [])
    lacking = quality.missing_required_columns(empty, "policy")  # the fixture has no such columns
    assert sorted(r["check"] for r in quality.validate_table(empty, "policy").collect()) == [
        "empty_table"] + ["missing_column"] * len(lacking)
    none = spark.createDataFrame([], "policy_id string, dividend_date string, "
                                     "dividend_amount double")
    premium = spark.createDataFrame([("1", "2020-01-01", 500.0)],
                                    "policy_id string, payment_date string, premium_amount double")
    value = spark.createDataFrame([("1", "2020-01-01", 5.0)],
                                  "policy_id string, valuation_date string, cash_value double")
    found, _ = quality.validate_all(policies(spark, ROWS), premium, value, none)
    assert "dividend" not in {r["table"] for r in found.collect()}


def test_required_columns(spark):
    assert quality.missing_required_columns(spark.range(1), "premium") == [
        "policy_id", "payment_date", "premium_amount"]


def test_pivot_rejects_two_rows_for_one_cell(spark):
    df = spark.createDataFrame([(1, "a", 2.0), (1, "b", 3.0), (2, "a", 4.0)],
                               "i int, c string, v double")
    rows = {r.i: r for r in report.pivot_cells(df, "i", "c", "v").collect()}
    assert (rows[1].a, rows[1].b, rows[2].a, rows[2].b) == (2, 3, 4, None)
    with pytest.raises(Exception, match="several rows"):
        report.pivot_cells(df.unionAll(df), "i", "c", "v", ["a", "b"]).collect()


def test_comparison_from_a_zero_base(spark):
    now = spark.createDataFrame([(2.0, 1.0), (4.0, 1.0)], "a double, b double")
    before = spark.createDataFrame([(0.0, 2.0)], "a double, b double")
    rows = {r.metric: r for r in report.comparison(now, before, ["a", "b", "no"]).collect()}
    assert (rows["a"].change, rows["a"].pct_change) == (3, 0)
    assert rows["b"].pct_change == -50 and "no" not in rows


def test_orphans_of_all_children_in_one_join(spark):
    from premia.operators import quality
    policy = spark.createDataFrame([(i,) for i in range(0, 1000, 2)] + [(None,)], "policy_id long")
    premium = spark.createDataFrame([(i,) for i in range(3000)] + [(None,), (7,)], "policy_id long")
    dividend = spark.createDataFrame([(i,) for i in range(0, 500, 2)], "policy_id long")
    cash = spark.createDataFrame([(1001,), (1001,), (5,)], "policy_id long")
    found = quality.cross_table_integrity(policy, premium=premium, dividend=dividend, cash_value=cash)
    rows = {r.table: (r.orphan_count, r.sample_ids) for r in found.collect()}
    assert rows == {"premium": (500 + 2000 + 1, [1, 3, 5, 7, 9]), "cash_value": (2, [5, 1001])}
    plan = found._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]
    assert plan.count("Join") == 1


def test_one_aggregate_a_table(spark):
    """All checks of a table are one aggregate over it (duplicates: one keyed count more)."""
    df = policies(spark, ROWS)
    metrics = quality.table_metrics(df, "policy")
    metrics.collect()
    plan = metrics._jdf.queryExecution().optimizedPlan().toString()
    # the table-wide aggregate, the keyed duplicate count and its total, the row-count guard
    assert plan.count("Aggregate [count(1) AS rows_") == 1


def test_missing_required_column_is_reported(spark):
    df = policies(spark, ROWS).drop("policy_id")
    found = quality.validate_table(df, "policy").where("check = 'missing_column'").collect()
    lacking = quality.missing_required_columns(df, "policy")
    assert "policy_id" in lacking
    assert sorted((r.column, r.value) for r in found) == sorted((c, 1) for c in lacking)
