"""Trends over years, moving averages, volatility and period comparison."""

from functools import reduce

from pyspark.sql import Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from premia.functions.labels import trend_direction
from premia.functions.special import t_two_sided
from premia.operators.ordering import rows_before
from premia.schemas import empty

TREND_DDL = ("slope double, intercept double, r_squared double, p_value double, "
             "is_significant boolean, trend_direction string, total_change double, "
             "avg_annual_change double, std_err double")


def with_slope_test(fits):
    """Adds sse, std_err, t and the two-sided p_value to rows with n, slope and centred sums.

    A line without residual has standard error 0 and p 0.
    """
    n, sxx, sxy = F.col("n"), F.col("sxx"), F.col("sxy")
    sse = F.greatest(F.col("syy") - F.try_divide(sxy * sxy, sxx), F.lit(0.0))
    error = F.when(n > 2, F.sqrt(F.try_divide(F.col("sse"), (n - 2) * sxx)))
    return (
        fits.withColumn("sse", sse).withColumn("std_err", error)
        .withColumn("t", F.try_divide(F.col("slope"), F.col("std_err")))
        .withColumn("p_value", F.when(F.col("std_err") == 0, 0.0)
                    .otherwise(t_two_sided("t", "n - 2")))
    )


def linear_trend(df, year="issue_year", value="irr_mean", by=()):
    """Fitted line per group over one row per year; groups with under 3 years are left out."""
    if year not in df.columns or value not in df.columns:
        return empty(df.sparkSession, TREND_DDL)
    x, y = F.col(year).cast("double"), F.col(value).cast("double")
    both = x.isNotNull() & y.isNotNull()
    fit = df.where(both).groupBy(*by).agg(
        F.count("*").alias("n"),
        F.regr_slope(y, x).alias("slope"), F.regr_intercept(y, x).alias("intercept"),
        F.regr_r2(y, x).alias("r_squared"),
        F.regr_sxx(y, x).alias("sxx"), F.regr_syy(y, x).alias("syy"),
        F.regr_sxy(y, x).alias("sxy"),
        (F.max_by(y, x) - F.min_by(y, x)).alias("total_change"),
        (F.max(x) - F.min(x)).alias("span"),
    ).where("n >= 3 AND sxx > 0")
    return (
        with_slope_test(fit)
        .select(
            *by, "slope", "intercept", "r_squared", "p_value",
            (F.col("p_value") < 0.05).alias("is_significant"),
            trend_direction(F.col("slope")).alias("trend_direction"), "total_change",
            (F.col("total_change") / F.col("span")).alias("avg_annual_change"), "std_err")
    )


def yearly_means(df, year, values, by=()):
    for key in (*by, year):
        df = df.where(F.col(key).isNotNull())
    return df.groupBy(*by, year).agg(*[F.avg(v).alias(v) for v in values])


def category_trends(df, category="product_category", year="issue_year", value="irr"):
    """Trend of the yearly mean in every category: two keyed aggregates, no loop."""
    return linear_trend(yearly_means(df, year, [value], [category]), year, value, [category])


def trend_table(df, year="issue_year", metrics=("irr", "annual_return_rate")):
    """Trend of the yearly mean of several metrics, one row per metric."""
    metrics = [m for m in metrics if m in df.columns]
    means = yearly_means(df, year, metrics)
    long = means.unpivot([year], metrics, "metric", "value")
    return linear_trend(long, year, "value", ["metric"])


def moving_average(df, value, order, window=3, by=(), block_rows=1_000_000):
    """Trailing mean over ``window`` rows per group in the given order, which must be total.

    No group is sorted in one task: rows get their number within the group, and the mean is
    taken per block of ``block_rows`` numbers, each block also seeing the ``window`` - 1 rows
    before it. NULL keys are a group. The input is read once.
    """
    back, block_rows = window - 1, max(block_rows, window)
    numbered = number_rows(df, order, by)
    block = F.floor((F.col("place") - 1) / block_rows)
    near_end = (F.col("place") - 1) % block_rows >= block_rows - back
    copies = F.when(near_end, F.array(block, block + 1)).otherwise(F.array(block))
    spread = numbered.withColumn("block", F.explode(copies))
    frame = Window.partitionBy(*by, "block").orderBy("place").rowsBetween(-back, 0)
    averaged = spread.withColumn(f"{value}_ma{window}", F.avg(value).over(frame))
    return averaged.where(F.col("block") == block).drop("block", "place")


def number_rows(df, order, by=()):
    """Adds ``place``, the number of each row in its group from 1."""
    return rows_before(df, order, by).withColumn("place", F.col("below") + 1).drop("below", "n")


def volatility(df, value, group=None):
    keys = [] if group is None else [group]
    for key in keys:
        df = df.where(F.col(key).isNotNull())
    stats = df.groupBy(*keys).agg(
        F.avg(value).alias("mean"), F.stddev_samp(value).alias("std"),
        F.min(value).alias("min"), F.max(value).alias("max"))
    return stats.select(
        *keys, "mean", "std", F.try_divide("std", "mean").alias("cv"), "min", "max",
        (F.col("max") - F.col("min")).alias("range"))


def pooled_t(n1, mean1, var1, n2, mean2, var2):
    """Two-sample t with pooled variance, and its degrees of freedom."""
    df = n1 + n2 - 2
    pooled = F.try_divide((n1 - 1) * var1 + (n2 - 1) * var2, df)
    return F.try_divide(mean1 - mean2, F.sqrt(F.try_divide(pooled * (n1 + n2), n1 * n2))), df


def compare_periods(df, value, period="issue_year", period1=(2020, 2021), period2=(2023, 2024)):
    """Means of two year ranges, both ends included, and a pooled t-test, in one pass."""
    measures = []
    for i, (low, high) in enumerate((period1, period2), 1):
        inside = F.col(period).between(low, high)
        v = F.when(inside, F.col(value))
        measures += [F.count_if(inside).alias(f"count{i}"), F.count(v).alias(f"n{i}"),
                     F.avg(v).alias(f"mean{i}"), F.var_samp(v).alias(f"var{i}")]
    reach = reduce(lambda a, b: a | b,
                   [F.col(period).between(*bounds) for bounds in (period1, period2)])
    row = df.where(reach).agg(*measures)
    t, freedom = pooled_t(*[F.col(f"{c}{i}") for i in (1, 2) for c in ("n", "mean", "var")])
    enough = (F.col("count1") > 1) & (F.col("count2") > 1)
    change = F.col("mean2") - F.col("mean1")
    return (
        row.withColumn("t_statistic", F.when(enough, t)).withColumn("freedom", freedom)
        .withColumn("p_value", t_two_sided("t_statistic", "freedom"))
        .select(
            "mean1", "count1", "mean2", "count2", change.alias("difference"),
            (F.try_divide(change, F.col("mean1")) * 100).alias("pct_change"),
            "t_statistic", "p_value",
            F.coalesce(F.col("p_value") < 0.05, F.lit(False)).alias("is_significant"))
    )
