"""Trends, moving averages, volatility and period comparison."""

from pyspark.sql import functions as F

from premia.operators import trends
from premia.registry.base import Query, sql_t_p
from premia.registry.grouping import on_returns
from premia.sources import views


def yearly_orders(spark, sf_dir):
    orders = views.given(spark, sf_dir, "orders")
    return orders.groupBy(F.year("o_orderdate").alias("year")).agg(
        F.avg(F.col("o_totalprice") / 100_000).alias("mean_price"))


def yearly_trend(spark, sf_dir):
    return trends.linear_trend(yearly_orders(spark, sf_dir), "year", "mean_price")


def moving_average(spark, sf_dir):
    events = views.given(spark, sf_dir, "events")
    return trends.moving_average(events, "value", ["ts", "event_id"], 3, ["user_id"])


def moving_average_blocks(spark, sf_dir):
    """By the block method that large data take, with blocks of 50 rows."""
    events = views.given(spark, sf_dir, "events")
    return trends.moving_average(events, "value", ["ts", "event_id"], 3, ["event_type"], block_rows=50)


def moving_average_yearly(spark, sf_dir):
    return trends.moving_average(yearly_orders(spark, sf_dir), "mean_price", ["year"], 3)


def volatility(spark, sf_dir):
    return trends.volatility(views.given(spark, sf_dir, "events"), "value", "event_type")


def volatility_all(spark, sf_dir):
    return trends.volatility(views.given(spark, sf_dir, "events"), "value")


def compare_orders(spark, sf_dir):
    orders = views.given(spark, sf_dir, "orders").withColumn("year", F.year("o_orderdate"))
    return trends.compare_periods(orders, "o_totalprice", "year", (1995, 1996), (1999, 2001))


TREND = ("slope:6 intercept:3 r_squared:6 p_value:6 is_significant:b trend_direction:s "
         "total_change:6 avg_annual_change:6 std_err:6")


def sql_trend(source, x, y, keys=""):
    """Fitted line per key from rows with one value per period."""
    listed = f"{keys}, " if keys else ""
    group = f"GROUP BY {keys}" if keys else ""
    p = sql_t_p("(slope / std_err)", "n - 2")
    return f"""
      SELECT *, p_value < 0.05 AS is_significant, CASE WHEN slope > 0.001 THEN '上升'
          WHEN slope < -0.001 THEN '下降' ELSE '平稳' END AS trend_direction
      FROM (SELECT *, {p} AS p_value FROM (
        SELECT *, sqrt(greatest(syy - sxy * sxy / sxx, 0) / (n - 2) / sxx) AS std_err FROM (
          SELECT {listed}count(*) AS n, regr_slope(y, x) AS slope,
            regr_intercept(y, x) AS intercept, regr_r2(y, x) AS r_squared,
            regr_sxx(y, x) AS sxx, regr_syy(y, x) AS syy, regr_sxy(y, x) AS sxy,
            arg_max(y, x) - arg_min(y, x) AS total_change,
            (arg_max(y, x) - arg_min(y, x)) / (max(x) - min(x)) AS avg_annual_change
          FROM (SELECT {listed}{x} AS x, {y} AS y FROM {source}) WHERE y IS NOT NULL
          {group}) WHERE n >= 3))"""


ORDERS_BY_YEAR = ("(SELECT year(o_orderdate) AS year, avg(o_totalprice / 100000) AS mean_price "
                  "FROM orders GROUP BY 1)")
BY_CATEGORY = ("(SELECT product_category, issue_year, avg(irr) AS irr FROM returns GROUP BY ALL)")
METRIC_YEARS = ("(SELECT 'irr' AS metric, issue_year, avg(irr) AS v FROM returns "
                "GROUP BY issue_year UNION ALL SELECT 'annual_return_rate', issue_year, "
                "avg(annual_return_rate) FROM returns GROUP BY issue_year)")


def sql_pooled(n1, m1, v1, n2, m2, v2):
    return (f"(({m1} - {m2}) / sqrt((({n1} - 1) * {v1} + ({n2} - 1) * {v2}) / ({n1} + {n2} - 2) "
            f"* (1.0 / {n1} + 1.0 / {n2})))")


def sql_compare(source, value, period, first, second):
    t = sql_pooled("n1", "mean1", "var1", "n2", "mean2", "var2")
    parts = []
    for i, (low, high) in ((1, first), (2, second)):
        inside = f"FILTER ({period} BETWEEN {low} AND {high})"
        parts.append(f"count(*) {inside} AS count{i}, count({value}) {inside} AS n{i}, "
                     f"avg({value}) {inside} AS mean{i}, var_samp({value}) {inside} AS var{i}")
    return f"""
      SELECT *, p_value < 0.05 AS is_significant FROM (
        SELECT *, {sql_t_p('t_statistic', 'n1 + n2 - 2')} AS p_value FROM (
          SELECT *, mean2 - mean1 AS difference, (mean2 - mean1) / mean1 * 100 AS pct_change,
            {t} AS t_statistic FROM (SELECT {', '.join(parts)} FROM {source})))"""


COMPARE = ("mean1:6 count1:l mean2:6 count2:l difference:6 pct_change:6 t_statistic:6 p_value:6 "
           "is_significant:b")
SPREAD = "mean:6 std:6 cv:6 min:2 max:2 range:2"
SPREAD_SQL = ("avg(value) AS mean, stddev_samp(value) AS std, stddev_samp(value) / avg(value) "
              "AS cv, min(value) AS min, max(value) AS max, max(value) - min(value) AS range")

QUERIES = [
    Query("yearly_trend", yearly_trend, TREND,
          sql_trend(ORDERS_BY_YEAR, "year", "mean_price")),
    Query("category_trends", on_returns(trends.category_trends), "product_category:s " + TREND,
          sql_trend(BY_CATEGORY, "issue_year", "irr", "product_category"), "returns"),
    Query("trend_table", on_returns(trends.trend_table), "metric:s " + TREND,
          sql_trend(METRIC_YEARS, "issue_year", "v", "metric"), "returns"),
    Query("moving_average", moving_average, "event_id:l user_id:l value_ma3:6", """
      SELECT event_id, user_id, avg(value) OVER (PARTITION BY user_id ORDER BY ts, event_id
        ROWS BETWEEN 2 PRECEDING AND CURRENT ROW) AS value_ma3 FROM events"""),
    Query("moving_average_blocks", moving_average_blocks,
          "event_id:l event_type:s value_ma3:6", """
      SELECT event_id, event_type, avg(value) OVER (PARTITION BY event_type ORDER BY ts, event_id
        ROWS BETWEEN 2 PRECEDING AND CURRENT ROW) AS value_ma3 FROM events"""),
    Query("moving_average_yearly", moving_average_yearly, "year:i mean_price:6 mean_price_ma3:6",
          f"""SELECT *, avg(mean_price) OVER (ORDER BY year ROWS BETWEEN 2 PRECEDING
          AND CURRENT ROW) AS mean_price_ma3 FROM {ORDERS_BY_YEAR}"""),
    Query("volatility", volatility, "event_type:s " + SPREAD,
          f"SELECT event_type, {SPREAD_SQL} FROM events GROUP BY event_type"),
    Query("volatility_all", volatility_all, SPREAD, f"SELECT {SPREAD_SQL} FROM events"),
    Query("compare_periods", compare_orders, COMPARE, sql_compare(
        "(SELECT *, year(o_orderdate) AS year FROM orders)", "o_totalprice", "year",
        (1995, 1996), (1999, 2001))),
    Query("compare_return_periods", on_returns(
        trends.compare_periods, "irr", "issue_year", (1995, 1995), (1996, 1998)), COMPARE,
        sql_compare("returns", "irr", "issue_year", (1995, 1995), (1996, 1998)), "returns"),
]
