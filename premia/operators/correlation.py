"""Pearson and Spearman correlation, matrices, quartile table and key drivers."""

from functools import reduce

from pyspark.sql import Window
from pyspark.sql import functions as F

from premia.functions import labels
from premia.functions.columns import correlation as pearson_r
from premia.functions.special import t_two_sided
from premia.operators.ordering import rows_before
from premia.operators.quantiles import quantiles
from premia.schemas import numeric_columns
from premia.storage import store

_HOT = 1_000
QUARTILE_LABELS = ["低", "中低", "中高", "高"]  # fixed values


def with_p_value(rows):
    """Adds the two-sided p_value to rows with n and correlation; a perfect one has p 0."""
    r, n = F.col("correlation"), F.col("n")
    t = F.when((n >= 3) & (F.abs(r) < 1), r * F.sqrt((n - 2) / (1 - r * r)))
    p = F.when((n >= 3) & (F.abs(r) >= 1), 0.0).otherwise(t_two_sided("t", "n - 2"))
    return rows.withColumn("t", t).withColumn("p_value", p)


def _both(df, columns):
    return reduce(lambda d, c: d.where(F.col(c).isNotNull()), columns, df)


def _report(row, method, x, y, alpha):
    r = F.col("correlation")
    return with_p_value(row.where("n >= 3")).select(
        F.lit(method).alias("method"), F.lit(x).alias("variable1"), F.lit(y).alias("variable2"),
        "n", "correlation", "p_value", (r * r).alias("r_squared"),
        (F.col("p_value") < alpha).alias("significant"),
        labels.correlation_strength(r).alias("strength"),
        labels.correlation_direction(r).alias("direction"))


def pearson(df, x, y, alpha=0.05):
    """One row; empty below three rows with both values present."""
    row = _both(df, [x, y]).agg(
        F.count("*").alias("n"), pearson_r(F.col(x), F.col(y)).alias("correlation"))
    return _report(row, "Pearson", x, y, alpha)


def average_ranks(df, column):
    """(v, r): every distinct value with its rank, ties sharing their mean rank.

    Equal values are counted first, so the order to run over has one row per value.
    """
    counts = (df.select(F.col(column).cast("double").alias("v")).where(F.col("v").isNotNull())
              .groupBy("v").agg(F.count("*").alias("rows")))
    return rows_before(counts, ["v"], weight="rows").select(
        "v", (F.col("below") + (F.col("rows") + 1) / F.lit(2.0)).alias("r"))


def _rank_products(df, columns):
    """One row: n and, per pair of columns, the sum of products of centred ranks.

    Rows with the same values are merged first (weight ``w``) and stored. All columns then go
    through one range-partitioned pass as (column, value) pairs, which gives every value its
    average rank. The ranks come to the rows column by column: those of values that hold more
    than 1 / ``_HOT`` of the merged rows, at most ``_HOT`` a column, are broadcast, so that no
    task gets all rows of such a value; the other rows meet theirs by value, each missing rank
    under a key of its own. The mean rank is (n + 1) / 2 exactly.
    """
    rows = _both(df, columns)
    merged = store(rows.groupBy(*[F.col(c).cast("double").alias(f"v{i}")
                                  for i, c in enumerate(columns)])
                   .agg(F.count("*").alias("w")), "rank-rows")
    pairs = F.array(*[F.struct(F.lit(i).alias("col"), F.col(f"v{i}").alias("v"))
                      for i in range(len(columns))])
    counts = (merged.select("w", F.explode(pairs).alias("p")).groupBy("p.col", "p.v")
              .agg(F.sum("w").alias("rows"), F.count(F.lit(1)).alias("held")))
    ranked = store(rows_before(counts, ["v"], ["col"], "rows").select(
        "col", "v", "held", (F.col("below") + (F.col("rows") + 1) / F.lit(2.0)).alias("r")), "ranks")
    many = merged.agg(F.count(F.lit(1))).scalar() / F.lit(float(_HOT))
    wide = merged
    for i in range(len(columns)):
        wide = _with_ranks(wide, ranked.where(F.col("col") == i), i, many)
    middle = rows.agg((F.count("*") + 1) / F.lit(2.0)).scalar()
    centred = wide.select("w", *[(F.col(f"r{i}") - middle).alias(f"r{i}")
                                 for i in range(len(columns))])
    return centred.agg(F.sum("w").alias("n"), *[
        F.sum(F.col("w") * F.col(f"r{i}") * F.col(f"r{j}")).alias(f"s{i}_{j}")
        for i in range(len(columns)) for j in range(i, len(columns))])


def _with_ranks(wide, ranked, i, many):
    """Adds r{i}, the rank of v{i}, from the ranks (v, r) of that column."""
    hot = ranked.where(F.col("held") > many).select(F.col("v").alias(f"v{i}"),
                                                    F.col("r").alias("hot"))
    cold = ranked.where(F.col("held") <= many).select(
        F.col("v").alias("at"), F.lit(0).alias("side"), F.col("r").alias("cold"))
    wide = wide.join(F.broadcast(hot), f"v{i}", "left")
    # Rows with a rank already are dealt by their own hash; side 1 meets no rank.
    known = F.col("hot").isNotNull()
    spread = F.when(known, F.xxhash64(*[c for c in wide.columns if c != "hot"]).cast("double")
                    ).otherwise(F.col(f"v{i}"))
    return (wide.withColumn("at", spread).withColumn("side", known.cast("int"))
            .join(cold, ["at", "side"], "left")
            .withColumn(f"r{i}", F.coalesce("hot", "cold")).drop("at", "side", "hot", "cold"))


def _rank_correlation(i, j):
    i, j = sorted((i, j))
    return F.try_divide(F.col(f"s{i}_{j}"), F.sqrt(F.col(f"s{i}_{i}") * F.col(f"s{j}_{j}")))


def spearman(df, x, y, alpha=0.05):
    row = _rank_products(df, [x, y]).select("n", _rank_correlation(0, 1).alias("correlation"))
    return _report(row, "Spearman", x, y, alpha)


def correlation_matrix(df, columns=None, method="pearson", alpha=0.05):
    """Long matrix over the complete rows: var1, var2, n, correlation, p_value and two flags.

    ``notable`` marks pairs with p < alpha and |r| > 0.3, ``strong`` those of them above 0.5.
    Empty with fewer than two columns.
    """
    columns = numeric_columns(df) if columns is None else list(columns)
    places = range(len(columns))
    if method == "pearson":
        row = _both(df, columns).agg(F.count("*").alias("n"), *[
            pearson_r(F.col(columns[i]), F.col(columns[j])).alias(f"c{i}_{j}") for i in places for j in places if i < j])

        def r(i, j):
            return F.col(f"c{min(i, j)}_{max(i, j)}")
    else:
        row, r = _rank_products(df, columns), _rank_correlation
    cells = [F.struct(F.lit(columns[i]).alias("var1"), F.lit(columns[j]).alias("var2"),
                      (F.lit(1.0) if i == j else r(i, j)).alias("correlation"))
             for i in places for j in places]
    long = row.select("n", F.explode(F.array(*cells)).alias("c")).select("n", "c.*")
    same = F.col("var1") == F.col("var2")
    size = F.abs("correlation")
    p = F.when(same, 1.0).otherwise(F.col("p_value"))
    notable = ~same & (F.col("p_value") < alpha) & (size > 0.3)
    return (
        with_p_value(long.where(F.lit(len(columns) >= 2))).withColumn("p_value", p)
        .select("var1", "var2", "n", "correlation", "p_value", notable.alias("notable"),
                (notable & (size > 0.5)).alias("strong"))
    )


def quartile_table(df, premium="annual_premium", value="irr"):
    """Mean, deviation and count of a value per premium quartile.

    Bins are closed on the right and the lowest edge belongs to the first. Equal edges merge
    their bins; bins are labelled in order.
    """
    edges = quantiles(df, [premium], [0, 0.25, 0.5, 0.75, 1]).select(
        F.array_distinct(F.col(premium))).scalar()
    present = df.where(F.col(premium).isNotNull()).withColumn("edges", edges)
    inner = F.slice("edges", 2, F.greatest(F.size("edges") - 2, F.lit(0)))
    passed = F.filter(inner, lambda edge: edge < F.col(premium))
    place = F.size(passed) + 1
    return present.withColumn("ordinal", place).groupBy("ordinal").agg(
        F.avg(value).alias("mean"), F.stddev_samp(value).alias("std"),
        F.count(value).alias("count"),
    ).select(F.array(*map(F.lit, QUARTILE_LABELS))[F.col("ordinal") - 1].alias("quartile"),
             "ordinal", "mean", "std", "count")


def premium_irr_relationship(df, premium="annual_premium", value="irr", alpha=0.05):
    """{"correlations", "quartiles", "conclusion"} of premium against return."""
    linear = pearson(df, premium, value, alpha)
    return {
        "correlations": linear.unionByName(spearman(df, premium, value, alpha)),
        "quartiles": quartile_table(df, premium, value),
        "conclusion": linear.select(labels.premium_irr_conclusion(
            F.col("correlation"), F.col("p_value"), alpha).alias("conclusion")),
    }


def driver_correlations(df, target, features=None, alpha=0.05):
    """Pearson of each feature with the target over its own complete rows, in one pass."""
    features = ([c for c in numeric_columns(df) if c != target]
                if features is None else [c for c in features if c in df.columns])
    y = F.col(target).cast("double")
    row = df.agg(*[
        expr for i, c in enumerate(features) for expr in (
            F.count(F.when(F.col(c).isNotNull() & y.isNotNull(), 1)).alias(f"n{i}"),
            pearson_r(F.col(c), y).alias(f"r{i}"))
    ])
    cells = [F.struct(F.lit(c).alias("feature"), F.col(f"n{i}").alias("n"),
                      F.col(f"r{i}").alias("correlation")) for i, c in enumerate(features)]
    long = row.select(F.explode(F.array(*cells)).alias("c")).select("c.*").where("n >= 3")
    return with_p_value(long).select(
        "feature", "n", "correlation", F.abs("correlation").alias("abs_correlation"), "p_value",
        (F.col("p_value") < alpha).alias("significant"))


def key_drivers(df, target, features=None, top_n=5, alpha=0.05):
    """The ``top_n`` features by |r| with their rank; equal up to rounding, by name."""
    found = driver_correlations(df, target, features, alpha)
    best = [F.round("abs_correlation", 12).desc_nulls_last(), F.asc("feature")]
    top = found.orderBy(*best).limit(top_n)
    return top.withColumn("rank", F.row_number().over(Window.orderBy(*best)))


def driver_summary(correlations):
    return correlations.agg(
        F.count("*").alias("total_features_analyzed"),
        F.count_if("significant").alias("significant_features"),
        F.count_if(F.col("abs_correlation") > 0.5).alias("strong_correlations"))
