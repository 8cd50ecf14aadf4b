"""Data tables behind the reports and charts."""

from pyspark.sql import functions as F

from premia.functions.labels import quality_band
from premia.operators.aggregates import METRICS, describe, summary_statistics, value_counts
from premia.operators.quality import quality_scores
from premia.operators.quantiles import quantiles

STATS = ["mean", "median", "std", "min", "max"]


def yearly_trend_sheet(df):
    keyed = df.where(F.col("product_category").isNotNull() & F.col("issue_year").isNotNull())
    return keyed.groupBy("product_category", "issue_year").agg(
        F.avg("irr").alias("irr"), F.avg("annual_return_rate").alias("annual_return_rate"),
        F.count("policy_id").alias("policy_count"))


def summary_sheet(df, metrics=METRICS):
    """Long table (section, item, value): totals, policies per category, metric statistics."""
    metrics = [c for c in metrics if c in df.columns]
    row = summary_statistics(df, metrics)
    cells = [F.struct(F.lit("overview").alias("section"), F.lit(c).alias("item"),
                      F.col(c).cast("double").alias("value"))
             for c in ("total_policies", "start_year", "end_year")]
    cells += [F.struct(F.lit(m).alias("section"), F.lit(s).alias("item"),
                       F.col(f"{m}_{s}").alias("value")) for m in metrics for s in STATS]
    totals = row.select(F.explode(F.array(*cells)).alias("c")).select("c.*")
    if "product_category" not in df.columns:
        return totals
    products = value_counts(df).select(
        F.lit("product").alias("section"), F.col("product_category").alias("item"),
        F.col("count").cast("double").alias("value"))
    return totals.unionByName(products)


def summary_tables(df, by_product):
    """The tables of the summary report by name."""
    tables = {"summary": summary_sheet(df), "policies": df, "by_product": by_product}
    if "issue_year" in df.columns:
        tables["yearly_trend"] = yearly_trend_sheet(df)
    return tables


def comparison(current, previous, metrics):
    """Mean of each metric in two frames, change and relative change (0 from a 0 base)."""
    metrics = [m for m in metrics if m in current.columns and m in previous.columns]
    before = previous.agg(F.struct(*[F.avg(m).alias(m) for m in metrics])).scalar()
    row = current.agg(*[F.avg(m).alias(m) for m in metrics]).withColumn("before", before)
    cells = [F.struct(F.lit(m).alias("metric"), F.col(m).alias("current_mean"),
                      F.col("before")[m].alias("previous_mean")) for m in metrics]
    change = F.col("current_mean") - F.col("previous_mean")
    return row.select(F.explode(F.array(*cells)).alias("c")).select("c.*").select(
        "metric", "current_mean", "previous_mean", change.alias("change"),
        F.when(F.col("previous_mean") == 0, 0.0)
        .otherwise(change / F.col("previous_mean") * 100).alias("pct_change"))


def trend_series(df, x="issue_year", y="irr_mean", category="product_category"):
    return df.select(category, x, y).orderBy(category, x)


def pivot_cells(df, index, column, value, values=None):
    """Index by column table; two rows for one cell are an error, as a cell holds one value.

    Give ``values`` to spare the extra job that finds the column names.
    """
    cells = df.groupBy(index, column).agg(
        F.count("*").alias("rows"), F.max(value).alias("cell"))
    checked = F.when(F.col("rows") > 1, F.raise_error(F.lit("several rows for one cell"))
                     ).otherwise(F.col("cell"))
    single = cells.select(index, column, checked.alias("cell"))
    return single.groupBy(index).pivot(column, values).agg(F.max("cell"))


def box_stats(df, category="product_category", value="irr", factor=1.5):
    """Quartiles, whiskers inside the fences, and the number of points outside."""
    present = df.where(F.col(value).isNotNull() & F.col(category).isNotNull())
    q = quantiles(present, [value], [0.25, 0.5, 0.75], [category]).select(
        category, *[F.col(value)[i].alias(name) for i, name in enumerate(("q1", "median", "q3"))])
    reach = factor * (F.col("q3") - F.col("q1"))
    v = F.col(value)
    inside = (v >= F.col("q1") - reach) & (v <= F.col("q3") + reach)
    return (
        present.select(category, value).join(q, category)
        .groupBy(category, "q1", "median", "q3")
        .agg(F.min(F.when(inside, v)).alias("whisker_low"),
             F.max(F.when(inside, v)).alias("whisker_high"),
             F.count_if(~inside).alias("outliers"), F.count("*").alias("n"))
    )


def scatter_points(df, x, y, category=None, fraction=None, seed=42):
    """Points for a scatter chart; ``fraction`` takes a seeded share of a large table."""
    points = df.select(x, y, *([category] if category else []))
    return points if fraction is None else points.sample(fraction=fraction, seed=seed)


def dashboard_trend(by_category_year, values=None):
    return pivot_cells(by_category_year, "issue_year", "product_category", "irr_mean", values)


def dashboard_stats(df, value="irr"):
    found = describe(df, ["product_category"], [value], ["mean", "median", "std"])
    return found.select("product_category", *[
        F.col(f"{value}_{s}").alias(s) for s in ("mean", "median", "std")])


def quality_tables(metrics, summary):
    """Overview, scores with band, missing rates and details per table."""
    scores = quality_scores(metrics.where(F.col("check") != "empty_table")).withColumn(
        "band", quality_band(F.col("quality_score")))
    return {
        "overview": summary.select("overall_quality_score", "tables_validated").withColumn(
            "checked_at", F.current_timestamp()),
        "scores": scores.select("table", "quality_score", "band"),
        "missing": metrics.where(F.col("check") == "missing").select("table", "column", "rate"),
        "details": scores.select("table", "total_records", "quality_score",
                                 "mean_missing_rate", "outliers"),
    }


def category_trend_table(trends):
    return trends.select("product_category", "trend_direction", "avg_annual_change")
