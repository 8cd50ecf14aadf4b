"""Report and chart data."""

from pyspark.sql import functions as F

from premia.operators import aggregates, report, trends
from premia.registry import base, quality
from premia.registry.base import Query
from premia.registry.grouping import METRICS, SUMMARY_STATS, on_returns
from premia.registry.trending import BY_CATEGORY, sql_trend
from premia.sources import views

CATEGORIES = ["传统寿险", "分红型寿险", "万能险", "投连险", "其他"]


def category_years(spark, sf_dir):
    return aggregates.by_category_year(base.returns(spark, sf_dir))


def comparison(spark, sf_dir):
    found = base.returns(spark, sf_dir)
    early = F.col("issue_year") <= 1995
    return report.comparison(found.where(~early), found.where(early),
                             ["irr", "annual_return_rate"])


def trend_series(spark, sf_dir):
    return report.trend_series(category_years(spark, sf_dir))


def _renamed(df):
    """Category columns under plain names."""
    return df.withColumnsRenamed({c: f"c{i}" for i, c in enumerate(CATEGORIES)})


def bar_pivot(spark, sf_dir):
    return _renamed(report.pivot_cells(category_years(spark, sf_dir), "issue_year",
                                       "product_category", "irr_count", CATEGORIES))


def dashboard(spark, sf_dir):
    return _renamed(report.dashboard_trend(category_years(spark, sf_dir), CATEGORIES))


def heatmap(spark, sf_dir):
    months = views.given(spark, sf_dir, "orders").groupBy(
        F.year("o_orderdate").alias("year"), F.quarter("o_orderdate").alias("quarter")).agg(
        F.sum("o_totalprice").alias("total"))
    found = report.pivot_cells(months, "year", "quarter", "total", [1, 2, 3, 4])
    return found.withColumnsRenamed({str(q): f"q{q}" for q in (1, 2, 3, 4)})


def _quality(part):
    def build(spark, sf_dir):
        metrics, orphans = quality.validated(spark, sf_dir)
        summary = report_summary(metrics, orphans)
        return report.quality_tables(metrics, summary)[part]
    return build


def report_summary(metrics, orphans):
    from premia.operators.quality import validation_summary
    return validation_summary(metrics, orphans)


def category_trend_table(spark, sf_dir):
    return report.category_trend_table(trends.category_trends(base.returns(spark, sf_dir)))


def _pivot_sql(value):
    cells = ", ".join(f"max({value}) FILTER (product_category = '{c}') AS c{i}"
                      for i, c in enumerate(CATEGORIES))
    return (f"SELECT issue_year, {cells} FROM (SELECT product_category, issue_year, "
            "avg(irr) AS irr_mean, count(irr) AS irr_count FROM returns GROUP BY ALL) "
            "GROUP BY issue_year")


STAT_SQL = {"mean": "avg({c})", "median": "median({c})", "std": "stddev_samp({c})",
            "min": "min({c})", "max": "max({c})"}
SHEET = [f"SELECT 'overview' AS section, '{name}' AS item, CAST({sql} AS DOUBLE) AS value "
         "FROM returns" for name, sql in (
             ("total_policies", "count(*)"), ("start_year", "min(issue_year)"),
             ("end_year", "max(issue_year)"))]
SHEET += [f"SELECT '{m}', '{s}', {STAT_SQL[s].format(c=m)} FROM returns"
          for m in METRICS for s in SUMMARY_STATS]
SHEET += ["SELECT 'product', product_category, CAST(count(*) AS DOUBLE) FROM returns "
          "GROUP BY product_category"]

BOX = """
  SELECT product_category, q1, median, q3, min(irr) FILTER (inside) AS whisker_low,
    max(irr) FILTER (inside) AS whisker_high, count(*) FILTER (NOT inside) AS outliers,
    count(*) AS n
  FROM (SELECT *, irr BETWEEN q1 - 1.5 * (q3 - q1) AND q3 + 1.5 * (q3 - q1) AS inside
        FROM (SELECT product_category, irr FROM returns WHERE irr IS NOT NULL) JOIN (
          SELECT product_category, quantile_cont(irr, 0.25) AS q1, median(irr) AS median,
            quantile_cont(irr, 0.75) AS q3 FROM returns WHERE irr IS NOT NULL GROUP BY ALL)
          USING (product_category))
  GROUP BY ALL"""
COMPARE = """
  SELECT *, now - before AS change, CASE WHEN before = 0 THEN 0
    ELSE (now - before) / before * 100 END AS pct_change, now AS current_mean,
    before AS previous_mean
  FROM (SELECT 'irr' AS metric, avg(irr) FILTER (issue_year > 1995) AS now,
          avg(irr) FILTER (issue_year <= 1995) AS before FROM returns
        UNION ALL SELECT 'annual_return_rate',
          avg(annual_return_rate) FILTER (issue_year > 1995),
          avg(annual_return_rate) FILTER (issue_year <= 1995) FROM returns)"""

QUERIES = [
    Query("report_trend_sheet", on_returns(report.yearly_trend_sheet),
          "product_category:s issue_year:i irr:6 annual_return_rate:6 policy_count:l", """
      SELECT product_category, issue_year, avg(irr) AS irr,
        avg(annual_return_rate) AS annual_return_rate, count(*) AS policy_count
      FROM returns WHERE issue_year IS NOT NULL GROUP BY ALL""", "returns"),
    Query("report_summary_long", on_returns(report.summary_sheet),
          "section:s item:s value:6", " UNION ALL ".join(SHEET), "returns"),
    Query("report_comparison", comparison,
          "metric:s current_mean:6 previous_mean:6 change:6 pct_change:4", COMPARE, "returns"),
    Query("trend_series", trend_series, "product_category:s issue_year:i irr_mean:6", """
      SELECT product_category, issue_year, avg(irr) AS irr_mean FROM returns GROUP BY ALL""",
          "returns"),
    Query("bar_pivot", bar_pivot, "issue_year:i c0:l c1:l c2:l c3:l c4:l",
          _pivot_sql("irr_count"), "returns"),
    Query("box_stats", on_returns(report.box_stats),
          "product_category:s q1:6 median:6 q3:6 whisker_low:6 whisker_high:6 outliers:l n:l",
          BOX, "returns"),
    Query("heatmap_pivot", heatmap, "year:i q1:2 q2:2 q3:2 q4:2", f"""
      SELECT year(o_orderdate) AS year, {', '.join(
          f'sum(o_totalprice) FILTER (quarter(o_orderdate) = {q}) AS q{q}' for q in (1, 2, 3, 4))}
      FROM orders GROUP BY 1"""),
    Query("scatter_points", on_returns(report.scatter_points, "annual_premium", "irr",
                                       "product_category"),
          "annual_premium:6 irr:6 product_category:s",
          "SELECT annual_premium, irr, product_category FROM returns", "returns"),
    Query("dashboard_table", dashboard, "issue_year:i c0:6 c1:6 c2:6 c3:6 c4:6",
          _pivot_sql("irr_mean"), "returns"),
    Query("dashboard_stats", on_returns(report.dashboard_stats),
          "product_category:s mean:6 median:6 std:6", """
      SELECT product_category, avg(irr) AS mean, median(irr) AS median,
        stddev_samp(irr) AS std FROM returns GROUP BY ALL""", "returns"),
    Query("quality_overview", _quality("overview"),
          "overall_quality_score:4 tables_validated:l", "SELECT * FROM summary", "summary"),
    Query("quality_bands", _quality("scores"), "table:s quality_score:4 band:s", """
      SELECT "table", quality_score, CASE WHEN quality_score >= 90 THEN 'excellent'
        WHEN quality_score >= 80 THEN 'good' WHEN quality_score >= 60 THEN 'warning'
        ELSE 'poor' END AS band FROM scores""", "scores"),
    Query("quality_missing", _quality("missing"), "table:s column:s rate:6",
          "SELECT * FROM metrics WHERE \"check\" = 'missing'", "metrics"),
    Query("quality_details", _quality("details"),
          "table:s total_records:l quality_score:4 mean_missing_rate:6 outliers:l",
          "SELECT * FROM scores", "scores"),
    Query("category_trend_table", category_trend_table,
          "product_category:s trend_direction:s avg_annual_change:6",
          sql_trend(BY_CATEGORY, "issue_year", "irr", "product_category"), "returns"),
]
