"""Aggregation of policy returns by product, year and customer segment."""

from pyspark.sql import Window
from pyspark.sql import functions as F

from premia.operators.quantiles import quantiles
from premia.schemas import DEFAULT_PERCENTILES, empty

METRICS = ["irr", "annual_return_rate", "total_return_rate"]

_SIMPLE = {
    "count": F.count, "mean": F.avg, "std": F.stddev_samp, "min": F.min, "max": F.max,
}


def describe(df, by, value_cols, stats, percentiles=()):
    """``by`` plus {col}_{stat} for each column; percentiles are named {col}_p{100 p}.

    ``median`` and the percentiles are exact and read the input again. Rows whose key is NULL
    are left out, as in all groupings here.
    """
    by = list(by)
    for key in by:
        df = df.where(F.col(key).isNotNull())
    probs = ([0.5] if "median" in stats else []) + list(percentiles)
    names = (["median"] if "median" in stats else []) + [f"p{round(p * 100)}" for p in percentiles]
    simple = [_SIMPLE[s](c).alias(f"{c}_{s}") for c in value_cols for s in stats if s in _SIMPLE]

    def order(c):
        listed = []
        for s in stats:
            listed.append(f"{c}_{s}")
        return listed + [f"{c}_p{round(p * 100)}" for p in percentiles]

    final = [*by, *[name for c in value_cols for name in order(c)]]
    if not probs:
        return df.groupBy(*by).agg(*simple).select(*final)

    found = quantiles(df, value_cols, probs, by).select(*by, *[
        F.col(c)[i].alias(f"{c}_{name}") for c in value_cols for i, name in enumerate(names)])
    main = df.groupBy(*by).agg(*simple)
    if by:
        return main.join(found, by, "left").select(*final)
    row = found.select(F.struct("*")).scalar()
    return main.select("*", *[row[c].alias(c) for c in found.columns]).select(*final)


def _aggregate(df, by, value_cols, default, stats, percentiles=()):
    wanted = [c for c in (value_cols or default) if c in df.columns]
    if not wanted or any(key not in df.columns for key in by):
        return empty(df.sparkSession, ", ".join(f"{key} string" for key in by))
    return describe(df, by, wanted, stats, percentiles)


def by_product(df, value_cols=None, percentiles=DEFAULT_PERCENTILES):
    return _aggregate(df, ["product_category"], value_cols, METRICS,
                      ["count", "mean", "median", "std", "min", "max"], percentiles)


def by_year(df, value_cols=None):
    return _aggregate(df, ["issue_year"], value_cols, METRICS[:2],
                      ["count", "mean", "median"])


def by_category_year(df, value_cols=None):
    return _aggregate(df, ["product_category", "issue_year"], value_cols, METRICS[:2],
                      ["count", "mean", "median"])


def by_segment(df, segment="age_group", value_cols=None):
    return _aggregate(df, [segment], value_cols, METRICS[:2],
                      ["count", "mean", "median", "std"])


def yoy_change(yearly, year="issue_year", value="irr_mean"):
    """Change against the year before, for a table with one row per year.

    The relative change uses the last value that is not missing, the absolute one the row
    before. The window has no key: its input is one row per calendar year.
    """
    order = Window.orderBy(year)
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    filled = F.last(value, ignorenulls=True).over(
        order.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    previous = F.last(value, ignorenulls=True).over(before)
    return yearly.withColumns({
        f"{value}_yoy": (F.try_divide(filled, previous) - 1) * 100,
        f"{value}_yoy_abs": F.col(value) - F.lag(value).over(order),
    })


def percentile_distribution(df, group="product_category", value="irr"):
    probs = [0.1, 0.25, 0.5, 0.75, 0.9]
    if value not in df.columns:
        return empty(df.sparkSession, f"{group} string")
    found = quantiles(df.where(F.col(value).isNotNull()), [value], probs, [group])
    named = found.select(group, *[F.col(value)[i].alias(f"p{round(p * 100)}")
                                  for i, p in enumerate(probs)])
    return named.withColumn("iqr", F.col("p75") - F.col("p25"))


def top_performers(df, metric="irr", n=10, group="product_category", key="policy_id"):
    """The n best rows, within each group or overall; ``key`` decides ties.

    The rank filter is a group limit, so each task keeps n rows per group before the shuffle.
    """
    if metric not in df.columns:
        return empty(df.sparkSession, f"{key} string")
    best = [F.desc_nulls_last(metric), F.asc(key)]
    if group is None or group not in df.columns:
        return df.orderBy(*best).limit(n)
    place = F.row_number().over(Window.partitionBy(group).orderBy(*best))
    return (df.where(F.col(group).isNotNull()).withColumn("place", place)
            .where(F.col("place") <= n).drop("place"))


def summary_statistics(df, metrics=METRICS):
    """One row: policy count, first and last issue year, and the metric statistics."""
    metrics = [c for c in metrics if c in df.columns]
    year = F.col("issue_year") if "issue_year" in df.columns else F.lit(None).cast("int")
    base = df.agg(F.count("*").alias("total_policies"), F.min(year).alias("start_year"),
                  F.max(year).alias("end_year"))
    if not metrics:
        return base
    stats = describe(df, [], metrics, ["mean", "median", "std", "min", "max"])
    row = stats.select(F.struct("*")).scalar()
    return base.select("*", *[row[c].alias(c) for c in stats.columns])


def value_counts(df, column="product_category"):
    return (df.where(F.col(column).isNotNull()).groupBy(column)
            .agg(F.count("*").alias("count")).orderBy(F.desc("count"), column))
