"""Data-quality checks over the policy model.

Fixed values in the SQL below: range limits, known statuses and advice texts.
"""

from pyspark.sql import functions as F

from premia.operators import quality
from premia.registry import base
from premia.registry.base import Query, define
from premia.registry.cleaning import policy_with_gaps
from premia.sources import views
from premia.storage import store


def dated_policy(spark, sf_dir):
    """Policy table whose maturity is the last order day, so one-day policies do not mature."""
    orders = views.given(spark, sf_dir, "orders").groupBy(
        F.col("o_custkey").cast("string").alias("policy_id")).agg(
        F.max("o_orderdate").alias("maturity_date"))
    return views.policy(spark, sf_dir).join(orders, "policy_id", "left")


def metric_query(name, build, body, tables="", kinds="value:l rate:6"):
    return Query(name, build, f"table:s column:s check:s {kinds}", body, tables)


def completeness(spark, sf_dir):
    return quality.completeness(policy_with_gaps(spark, sf_dir), "policy")


def required_columns(spark, sf_dir):
    """Checks of the premium and dividend tables as given to the model without their dates."""
    premium = views.premium(spark, sf_dir).drop("payment_date")
    dividend = views.dividend(spark, sf_dir).drop("dividend_date", "policy_id")
    found = quality.validate_table(premium, "premium").unionByName(
        quality.validate_table(dividend, "dividend"))
    return found.where(F.col("check") == "missing_column")


def critical_missing(spark, sf_dir):
    return quality.critical_missing(completeness(spark, sf_dir))


def range_rules(spark, sf_dir):
    policy = views.policy(spark, sf_dir)
    return quality.validity(policy, "policy", {
        "annual_premium": (200_000, 300_000), "insured_age": (20, 60), "payment_term": (3, 6)},
        statuses=[" active "])


def status_rule(spark, sf_dir):
    return quality.validity(views.policy(spark, sf_dir), "policy", {})


def duplicate_keys(spark, sf_dir):
    return quality.duplicate_keys(views.premium(spark, sf_dir))


def date_order(spark, sf_dir):
    return quality.date_order_issues(dated_policy(spark, sf_dir))


def ratio_rule(spark, sf_dir):
    return quality.ratio_issues(views.policy(spark, sf_dir), low=6, high=15)


def iqr_outliers(spark, sf_dir):
    return quality.iqr_outliers(views.given(spark, sf_dir, "events"), "events",
                                columns=["event_id", "user_id", "value"])


def iqr_outliers_selection(spark, sf_dir):
    return quality.iqr_outliers(views.given(spark, sf_dir, "events"), "events",
                                columns=["event_id", "user_id", "value"])


def orphans(spark, sf_dir):
    policy = base.clean_policy(spark, sf_dir)
    found = quality.cross_table_integrity(
        policy, premium=views.premium(spark, sf_dir),
        cash_value=views.cash_value(spark, sf_dir), dividend=views.dividend(spark, sf_dir))
    return found.withColumn("sample_ids", F.array_join("sample_ids", ","))


def validated(spark, sf_dir):
    """Raw policy table with gaps against stored child tables."""
    children = [store(t(spark, sf_dir), "child")
                for t in (views.premium, views.cash_value, views.dividend)]
    return quality.validate_all(policy_with_gaps(spark, sf_dir), *children)


def _one_table(name, view):
    def build(spark, sf_dir):
        return quality.validate_table(store(view(spark, sf_dir), name), name)
    return build


def quality_score(spark, sf_dir):
    return quality.quality_scores(validated(spark, sf_dir)[0])


def validation_summary(spark, sf_dir):
    return quality.validation_summary(*validated(spark, sf_dir))


def acceptance(spark, sf_dir):
    return quality.acceptance(validation_summary(spark, sf_dir))


# SQL ---------------------------------------------------------------------------------------

define("gap_policy", "policy", """
  SELECT * REPLACE (CASE WHEN payment_term > 3 THEN annual_premium END AS annual_premium,
    CASE WHEN insured_age > 25 THEN region END AS region) FROM policy
  UNION ALL
  SELECT * REPLACE (CASE WHEN payment_term > 3 THEN annual_premium END AS annual_premium,
    CASE WHEN insured_age > 25 THEN region END AS region) FROM policy""")

COLUMNS = {
    "policy": ["policy_id", "product_code", "issue_date", "annual_premium", "payment_term",
               "sum_assured", "insured_age", "region", "policy_status"],
    "premium": ["policy_id", "payment_date", "premium_amount"],
    "cash_value": ["policy_id", "valuation_date", "cash_value"],
    "dividend": ["policy_id", "dividend_date", "dividend_amount"],
}
NUMBERS = {"policy": ["annual_premium", "payment_term", "sum_assured", "insured_age"],
           "premium": ["premium_amount"], "cash_value": ["cash_value"],
           "dividend": ["dividend_amount"]}
RULES = {
    "policy": {"annual_premium": (1000, 10000000), "sum_assured": (10000, 100000000),
               "insured_age": (0, 80), "payment_term": (1, 30)},
    "premium": {"premium_amount": (100, 10000000)},
    "cash_value": {"cash_value": (0, 100000000)},
    "dividend": {"dividend_amount": (0, 10000000)},
}


def _row(table, column, check, value, rate="NULL", where=""):
    return (f"SELECT '{table}' AS \"table\", '{column}' AS \"column\", '{check}' AS \"check\", "
            f"{value} AS value, {rate} AS rate {where}")


def sql_completeness(table, source):
    n = len(COLUMNS[table])
    rows = [_row(table, c, "missing", f"count(*) FILTER ({c} IS NULL)",
                 f"count(*) FILTER ({c} IS NULL) / count(*)", f"FROM {source}")
            for c in COLUMNS[table]]
    rows.append(_row(table, "*", "total_cells", f"count(*) * {n}", where=f"FROM {source}"))
    rows.append(_row(table, "*", "total_records", "count(*)", where=f"FROM {source}"))
    return rows


def sql_rules(table, source, rules):
    rows = []
    for column, (low, high) in rules.items():
        for check, bad in (("below_min", f"{column} < {low}"), ("above_max", f"{column} > {high}")):
            rows.append(_row(table, column, check, f"count(*) FILTER ({bad})",
                             where=f"FROM {source} HAVING count(*) FILTER ({bad}) > 0"))
    return rows


def sql_outliers(table, source, columns):
    rows = []
    for c in columns:
        bad = (f"{c} < q[1] - 1.5 * (q[2] - q[1]) OR {c} > q[2] + 1.5 * (q[2] - q[1])")
        rows.append(_row(
            table, c, "outliers", f"count(*) FILTER ({bad})",
            f"count(*) FILTER ({bad}) / count({c})",
            f"FROM {source}, (SELECT quantile_cont({c}, [0.25, 0.75]) AS q FROM {source}) "
            f"HAVING count({c}) >= 10 AND count(*) FILTER ({bad}) > 0"))
    return rows


def sql_status(source, known):
    bad = f"NOT coalesce(policy_status IN ({known}), false)"
    return [_row("policy", "policy_status", "invalid_value", f"count(*) FILTER ({bad})",
                 where=f"FROM {source} HAVING count(*) FILTER ({bad}) > 0")]


KNOWN = "'ACTIVE', 'LAPSED', 'SURRENDERED', 'MATURED', 'PENDING'"


def sql_metrics(table, source):
    rows = sql_completeness(table, source) + sql_rules(table, source, RULES[table])
    if table == "policy":
        ratio = "sum_assured / nullif(annual_premium, 0)"
        rows += sql_status(source, KNOWN)
        rows.append(_row("policy", "policy_id", "duplicates",
                         "count(*) - count(DISTINCT policy_id)", where=f"FROM {source}"))
        rows.append(_row("policy", "sum_assured", "ratio_issues",
                         f"count(*) FILTER ({ratio} < 1 OR {ratio} > 1000)",
                         where=f"FROM {source}"))
    return " UNION ALL ".join(rows + sql_outliers(table, source, NUMBERS[table]))


SOURCES = {"policy": "gap_policy", "premium": "premium", "cash_value": "cash_value",
           "dividend": "dividend"}
define("metrics", "gap_policy premium cash_value dividend",
       " UNION ALL ".join(sql_metrics(t, s) for t, s in SOURCES.items()))
define("scores", "metrics", """
  SELECT *, least(greatest(100 - 30 * mean_missing_rate - 5 * range_violations
      - 0.1 * duplicates - 0.2 * ratio_issues - 20 * mean_outlier_rate, 0), 100) AS quality_score
  FROM (SELECT "table", sum(value) FILTER ("check" = 'total_records') AS total_records,
      avg(rate) FILTER ("check" = 'missing') AS mean_missing_rate,
      count(*) FILTER ("check" IN ('below_min', 'above_max')) AS range_violations,
      coalesce(sum(value) FILTER ("check" = 'duplicates'), 0) AS duplicates,
      0 AS date_issues,
      coalesce(sum(value) FILTER ("check" = 'ratio_issues'), 0) AS ratio_issues,
      coalesce(sum(value) FILTER ("check" = 'outliers'), 0) AS outliers,
      coalesce(avg(rate) FILTER ("check" = 'outliers'), 0) AS mean_outlier_rate
    FROM metrics GROUP BY "table")""")


def sql_orphans(parent):
    return " UNION ALL ".join(f"""
      SELECT '{t}' AS "table", count(*) AS orphan_count,
        (SELECT string_agg(policy_id, ',' ORDER BY policy_id) FROM (
           SELECT DISTINCT policy_id FROM {t} WHERE policy_id NOT IN (SELECT policy_id FROM {parent})
           ORDER BY policy_id LIMIT 5)) AS sample_ids
      FROM (SELECT DISTINCT policy_id FROM {t}
            WHERE policy_id NOT IN (SELECT policy_id FROM {parent})) HAVING count(*) > 0"""
                              for t in ("premium", "cash_value", "dividend"))


define("summary", "scores metrics", """
  SELECT overall_quality_score, overall_quality_score >= 70 AS is_acceptable,
    0 AS critical_issues_count,
    (SELECT count(DISTINCT "table") FROM metrics WHERE "check" = 'missing' AND rate > 0.05
      AND "column" IN ('policy_id', 'product_code', 'issue_date', 'annual_premium',
        'payment_term', 'sum_assured', 'insured_age', 'policy_status')) AS warnings_count,
    (SELECT count(DISTINCT "table") FROM metrics) AS tables_validated,
    CASE WHEN overall_quality_score < 80 THEN '数据质量较低，建议进行数据清洗后再进行分析'
      WHEN overall_quality_score < 90 THEN '数据质量一般，建议关注缺失值和异常值处理'
      ELSE '数据质量良好，可以进行后续分析' END AS recommendation
  FROM (SELECT avg(quality_score) AS overall_quality_score FROM scores)""")

EVENT_FENCES = """
  SELECT 'events' AS "table", name AS "column", 'outliers' AS "check", count(*) FILTER (bad) AS value,
    count(*) FILTER (bad) / count(*) AS rate, any_value(low) AS lower, any_value(high) AS upper
  FROM (SELECT *, v < low OR v > high AS bad FROM (
    SELECT *, q[1] - 1.5 * (q[2] - q[1]) AS low, q[2] + 1.5 * (q[2] - q[1]) AS high
    FROM (UNPIVOT (SELECT CAST(event_id AS DOUBLE) AS event_id, CAST(user_id AS DOUBLE) AS user_id,
             value FROM events) ON event_id, user_id, value INTO NAME name VALUE v)
    JOIN (SELECT name, quantile_cont(v, [0.25, 0.75]) AS q FROM (UNPIVOT (
             SELECT CAST(event_id AS DOUBLE) AS event_id, CAST(user_id AS DOUBLE) AS user_id, value
             FROM events) ON event_id, user_id, value INTO NAME name VALUE v) GROUP BY name)
      USING (name)))
  GROUP BY name HAVING count(*) FILTER (bad) > 0"""
FENCE_KINDS = "value:l rate:6 lower:6 upper:6"

SCORE = ("table:s total_records:l mean_missing_rate:6 range_violations:l duplicates:l "
         "date_issues:l ratio_issues:l outliers:l mean_outlier_rate:6 quality_score:4")
SUMMARY = ("overall_quality_score:4 critical_issues_count:l warnings_count:l "
           "tables_validated:l recommendation:s")

QUERIES = [
    metric_query("completeness", completeness,
                 " UNION ALL ".join(sql_completeness("policy", "gap_policy")), "gap_policy"),
    Query("critical_missing", critical_missing, "table:s column:s rate:6", f"""
      SELECT * FROM ({' UNION ALL '.join(sql_completeness('policy', 'gap_policy'))})
      WHERE "check" = 'missing' AND rate > 0.05 AND "column" <> 'region'""", "gap_policy"),
    metric_query("range_rules", range_rules, " UNION ALL ".join(
        sql_rules("policy", "policy", {"annual_premium": (200000, 300000),
                                       "insured_age": (20, 60), "payment_term": (3, 6)})
        + sql_status("policy", "' active '")), "policy"),
    metric_query("status_rule", status_rule, sql_status("policy", KNOWN)[0], "policy"),
    Query("duplicate_keys", duplicate_keys, "duplicates:l",
          "SELECT count(*) - count(DISTINCT policy_id) AS duplicates FROM premium", "premium"),
    Query("date_order", date_order, "issues:l", """
      SELECT count(*) AS issues FROM (SELECT min(o_orderdate) AS a, max(o_orderdate) AS b
        FROM orders GROUP BY o_custkey) WHERE b <= a"""),
    Query("ratio_rule", ratio_rule, "issues:l", """
      SELECT count(*) AS issues FROM policy
      WHERE sum_assured / annual_premium < 6 OR sum_assured / annual_premium > 15""", "policy"),
    metric_query("iqr_outliers", iqr_outliers, EVENT_FENCES, "", FENCE_KINDS),
    metric_query("iqr_outliers_selection", iqr_outliers_selection, EVENT_FENCES, "",
                 FENCE_KINDS),
    metric_query("required_columns", required_columns, """
      SELECT * FROM (VALUES ('premium', 'payment_date', 'missing_column', 1, NULL),
        ('dividend', 'policy_id', 'missing_column', 1, NULL),
        ('dividend', 'dividend_date', 'missing_column', 1, NULL))
        AS t("table", "column", "check", value, rate)"""),
    Query("orphans", orphans, "table:s orphan_count:l sample_ids:s", sql_orphans("clean_policy"),
          "clean_policy premium cash_value dividend"),
    metric_query("validate_policy", _one_table("policy", views.policy),
                 sql_metrics("policy", "policy"), "policy"),
    metric_query("validate_premium", _one_table("premium", views.premium),
                 sql_metrics("premium", "premium"), "premium"),
    metric_query("validate_cash_value", _one_table("cash_value", views.cash_value),
                 sql_metrics("cash_value", "cash_value"), "cash_value"),
    metric_query("validate_dividend", _one_table("dividend", views.dividend),
                 sql_metrics("dividend", "dividend"), "dividend"),
    metric_query("validate_all", lambda spark, sf_dir: validated(spark, sf_dir)[0],
                 "SELECT * FROM metrics", "metrics"),
    Query("quality_score", quality_score, SCORE, "SELECT * FROM scores", "scores"),
    Query("validation_summary", validation_summary, SUMMARY, "SELECT * FROM summary", "summary"),
    Query("acceptance", acceptance, SUMMARY + " is_acceptable:b", "SELECT * FROM summary",
          "summary"),
]
