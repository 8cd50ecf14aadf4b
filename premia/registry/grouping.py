"""Aggregates of the policy returns."""

from premia.operators import aggregates
from premia.registry import base
from premia.registry.base import Query
from premia.sources import views

METRICS = ["irr", "annual_return_rate", "total_return_rate"]
SQL = {
    "count": "count({c})", "mean": "avg({c})", "median": "median({c})",
    "std": "stddev_samp({c})", "min": "min({c})", "max": "max({c})",
    **{f"p{p}": f"quantile_cont({{c}}, {p / 100})" for p in (5, 10, 25, 50, 75, 90, 95)},
}


def measures(columns, stats):
    """Column list and SQL of {column}_{stat}."""
    names = [(c, s) for c in columns for s in stats]
    kinds = " ".join(f"{c}_{s}:{'l' if s == 'count' else 6}" for c, s in names)
    return kinds, ", ".join(f"{SQL[s].format(c=c)} AS {c}_{s}" for c, s in names)


def on_returns(operator, *args, **kwargs):
    return lambda spark, sf_dir: operator(base.returns(spark, sf_dir), *args, **kwargs)


def grouped(name, operator, keys, columns, stats, *args, **kwargs):
    kinds, sql = measures(columns, stats)
    listed = ", ".join(k.split(":")[0] for k in keys)
    present = " AND ".join(f"{k.split(':')[0]} IS NOT NULL" for k in keys)
    return Query(name, on_returns(operator, *args, **kwargs), f"{' '.join(keys)} {kinds}",
                 f"SELECT {listed}, {sql} FROM returns WHERE {present} GROUP BY {listed}",
                 "returns")


ALL = ["count", "mean", "median", "std", "min", "max", "p5", "p25", "p50", "p75", "p95"]
YEAR_STATS = ["count", "mean", "median"]


def yoy(spark, sf_dir):
    return aggregates.yoy_change(aggregates.by_year(base.returns(spark, sf_dir)))


def percentiles_of_orders(spark, sf_dir):
    """Over the whole order lines, by the two-pass selection that large data take."""
    lines = views.given(spark, sf_dir, "lineitem")
    return aggregates.percentile_distribution(lines, "l_returnflag", "l_extendedprice")


SPREAD = ", ".join(f"quantile_cont({{v}}, {p / 100}) AS p{p}" for p in (10, 25, 50, 75, 90))
SPREAD += ", quantile_cont({v}, 0.75) - quantile_cont({v}, 0.25) AS iqr"
SUMMARY_STATS = ["mean", "median", "std", "min", "max"]
SUMMARY_KINDS, SUMMARY_SQL = measures(METRICS, SUMMARY_STATS)

QUERIES = [
    grouped("agg_by_product", aggregates.by_product, ["product_category:s"], METRICS, ALL),
    grouped("agg_by_product_selection", aggregates.by_product, ["product_category:s"], METRICS,
            ALL),
    grouped("agg_by_year", aggregates.by_year, ["issue_year:i"], METRICS[:2], YEAR_STATS),
    grouped("agg_by_category_year", aggregates.by_category_year,
            ["product_category:s", "issue_year:i"], METRICS[:2], YEAR_STATS),
    grouped("agg_by_segment", aggregates.by_segment, ["age_group:s"], METRICS[:2],
            [*YEAR_STATS, "std"]),
    grouped("agg_by_coverage", aggregates.by_segment, ["coverage_group:s"], METRICS[:2],
            [*YEAR_STATS, "std"], "coverage_group"),
    Query("yoy_change", yoy, "issue_year:i irr_mean:6 irr_mean_yoy:4 irr_mean_yoy_abs:6", """
      SELECT issue_year, m AS irr_mean, m - lag(m) OVER (ORDER BY issue_year) AS irr_mean_yoy_abs,
        (last_value(m IGNORE NULLS) OVER (ORDER BY issue_year
            ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)
          / last_value(m IGNORE NULLS) OVER (ORDER BY issue_year
            ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) - 1) * 100 AS irr_mean_yoy
      FROM (SELECT issue_year, avg(irr) AS m FROM returns GROUP BY issue_year)""", "returns"),
    Query("percentile_distribution", on_returns(aggregates.percentile_distribution),
          "product_category:s p10:6 p25:6 p50:6 p75:6 p90:6 iqr:6",
          f"SELECT product_category, {SPREAD.format(v='irr')} FROM returns "
          "WHERE irr IS NOT NULL GROUP BY product_category", "returns"),
    Query("percentile_distribution_selection", percentiles_of_orders,
          "l_returnflag:s p10:6 p25:6 p50:6 p75:6 p90:6 iqr:6",
          f"SELECT l_returnflag, {SPREAD.format(v='l_extendedprice')} FROM lineitem "
          "GROUP BY l_returnflag"),
    Query("top_n_per_group", on_returns(aggregates.top_performers),
          "policy_id:s product_category:s irr:6", """
      SELECT * FROM returns QUALIFY row_number() OVER (PARTITION BY product_category
        ORDER BY irr DESC NULLS LAST, policy_id) <= 10""", "returns"),
    Query("top_n_global", on_returns(aggregates.top_performers, group=None, n=25),
          "policy_id:s irr:6",
          "SELECT * FROM returns ORDER BY irr DESC NULLS LAST, policy_id LIMIT 25", "returns"),
    Query("summary_stats", on_returns(aggregates.summary_statistics),
          f"total_policies:l start_year:i end_year:i {SUMMARY_KINDS}",
          "SELECT count(*) AS total_policies, min(issue_year) AS start_year, "
          f"max(issue_year) AS end_year, {SUMMARY_SQL} FROM returns", "returns"),
    Query("value_counts", on_returns(aggregates.value_counts), "product_category:s count:l",
          "SELECT product_category, count(*) AS count FROM returns GROUP BY ALL", "returns"),
]
