"""Least-squares fits from one pass of sums, scoring, and residual diagnostics."""

from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Window
from pyspark.sql import functions as F

from premia.functions import labels
from premia.functions.columns import correlation
from premia.functions.special import f_upper, t_two_sided
from premia.operators.trends import with_slope_test

# fixed values
DRIVERS = ["annual_premium", "payment_term", "sum_assured", "insured_age", "issue_year",
           "cumulative_premium"]


def _complete(df, columns):
    return reduce(lambda d, c: d.where(F.col(c).isNotNull()), columns, df)


def _simple_sums(x, y):
    """Aggregates of the rows with both values; regr_* skip the others themselves."""
    x, y = x.cast("double"), y.cast("double")
    return [F.regr_count(y, x).alias("n"), F.regr_avgx(y, x).alias("mean_x"),
            F.regr_slope(y, x).alias("slope"), F.regr_intercept(y, x).alias("intercept"),
            F.regr_sxx(y, x).alias("sxx"), F.regr_syy(y, x).alias("syy"),
            F.regr_sxy(y, x).alias("sxy"), correlation(x, y).alias("correlation")]


def _simple_measures(sums, alpha):
    """Fit columns from the aggregate row(s) of ``_simple_sums``."""
    n, sxx = F.col("n"), F.col("sxx")
    return (
        with_slope_test(sums.where("n >= 3 AND sxx > 0 AND syy > 0"))
        .withColumnRenamed("std_err", "slope_std_error")
        .withColumn("r_squared", 1 - F.col("sse") / F.col("syy"))
        .withColumns({
            "rmse": F.sqrt(F.col("sse") / (n - 2)),
            "adjusted_r_squared": 1 - (1 - F.col("r_squared")) * (n - 1) / (n - 2),
            "slope_significant": F.col("p_value") < alpha,
        })
        .withColumn("intercept_std_error", F.col("rmse") * F.sqrt(
            1 / n + F.col("mean_x") * F.col("mean_x") / sxx))
        .withColumn("residuals_std", F.sqrt(F.col("sse") / n))
        .drop("sxx", "syy", "sxy", "mean_x", "sse", "t")
    )


def simple_ols(df, x, y, alpha=0.05, order=None):
    """One row with the fitted line and its diagnostics; empty below three complete rows.

    ``order`` names the columns that give the row order for the Durbin-Watson statistic, which
    is NULL without them.
    """
    rows = _complete(df, [x, y])
    fit = _simple_measures(rows.agg(*_simple_sums(F.col(x), F.col(y))), alpha)
    statistic = F.lit(None).cast("double")
    if order:
        line = fit.select(F.struct("intercept", "slope")).scalar()
        residual = F.col(y) - (line["intercept"] + line["slope"] * F.col(x))
        statistic = durbin_watson(rows.withColumn("e", residual), "e", order).scalar()
    return fit.select(
        "n", "intercept", "slope", "intercept_std_error", "slope_std_error", "correlation",
        "r_squared", "adjusted_r_squared", "rmse", "p_value", "slope_significant",
        F.lit(0.0).alias("residuals_mean"), "residuals_std",
        statistic.alias("durbin_watson"),
        labels.simple_fit(F.col("slope"), F.col("r_squared"), F.col("p_value"), alpha,
                          F.lit(x), F.lit(y)).alias("interpretation"))


def durbin_watson(df, residual, order):
    """One row: sum of squared steps between neighbours over the sum of squares.

    Rows are range-partitioned by the order columns. Each partition streams its sorted rows to
    one summary row, and only the summaries, one per partition, meet in a window that adds the
    steps across partition borders.
    """
    rows = df.where(F.col(residual).isNotNull()).select(*order, F.col(residual).alias("e"))
    sorted_rows = rows.repartitionByRange(*order).sortWithinPartitions(*order)

    def summarise(batches):
        first = last = None
        steps = squares = 0.0
        part = None
        for batch in batches:
            if not len(batch):
                continue
            e = batch["e"].to_numpy()
            part = int(batch["part"].iloc[0])
            first = e[0] if first is None else first
            steps += float(np.square(np.diff(e)).sum())
            if last is not None:
                steps += float((e[0] - last) ** 2)
            squares += float(np.square(e).sum())
            last = e[-1]
        if part is not None:
            yield pd.DataFrame({"part": [part], "first": [first], "last": [last],
                                "steps": [steps], "squares": [squares]})

    parts = sorted_rows.select(F.spark_partition_id().alias("part"), "e").mapInPandas(
        summarise, "part int, first double, last double, steps double, squares double")
    border = F.col("first") - F.lag("last").over(Window.orderBy("part"))
    bridged = parts.withColumn("border", F.coalesce(border * border, F.lit(0.0)))
    return bridged.agg(F.try_divide(
        F.sum("steps") + F.sum("border"), F.sum("squares")).alias("durbin_watson"))


def _moments(df, x_cols, y):
    """One row with n, the means and the upper triangle of the covariance matrix."""
    names = [*x_cols, y]
    columns = [F.col(c).cast("double") for c in names]
    means = F.array(*[F.avg(c) for c in columns])
    cross = F.array(*[F.covar_pop(columns[i], columns[j])
                      for i in range(len(names)) for j in range(i, len(names))])
    return _complete(df, names).agg(
        F.count("*").alias("n"), means.alias("means"), cross.alias("cross"))


FIT_DDL = ("n long, coefficients array<double>, std_errors array<double>, r_squared double, "
           "adjusted_r_squared double, rmse double, f_statistic double, residuals_std double, "
           "condition_number double")


def fit_ols(df, y, x_cols):
    """One row with the coefficients (intercept first) and the fit measures.

    The data pass is one aggregate. The (p + 1) square system is then solved from that single
    row; its size depends on the number of predictors only. Empty with fewer than p + 2 rows
    or collinear predictors.
    """
    p = len(x_cols)

    def solve(batches):
        for batch in batches:
            for n, means, cross in zip(batch["n"], batch["means"], batch["cross"]):
                if n < p + 2:
                    continue
                full = np.zeros((p + 1, p + 1))
                full[np.triu_indices(p + 1)] = cross
                full = (full + np.triu(full, 1).T) * n
                means = np.asarray(means, dtype=float)
                xx, xy, total = full[:p, :p], full[:p, p], full[p, p]
                try:
                    inverse = np.linalg.inv(xx)
                except np.linalg.LinAlgError:
                    continue
                slopes = np.linalg.solve(xx, xy)
                intercept = means[p] - slopes @ means[:p]
                sse = max(total - slopes @ xy, 0.0)
                mse = sse / (n - p - 1)
                corner = 1 / n + means[:p] @ inverse @ means[:p]
                errors = np.sqrt(mse * np.concatenate([[corner], np.diag(inverse)]))
                design = np.zeros((p + 1, p + 1))
                design[0, 0] = n
                design[0, 1:] = design[1:, 0] = n * means[:p]
                design[1:, 1:] = xx + n * np.outer(means[:p], means[:p])
                eigen = np.linalg.eigvalsh(design)
                r2 = 1 - sse / total if total > 0 else None
                yield pd.DataFrame({
                    "n": [n], "coefficients": [[intercept, *slopes]],
                    "std_errors": [list(errors)], "r_squared": [r2],
                    "adjusted_r_squared": [
                        None if r2 is None else 1 - (1 - r2) * (n - 1) / (n - p - 1)],
                    "rmse": [np.sqrt(mse)],
                    "f_statistic": [(total - sse) / p / mse if mse > 0 else None],
                    "residuals_std": [np.sqrt(sse / n)],
                    "condition_number": [
                        np.sqrt(eigen[-1] / eigen[0]) if eigen[0] > 0 else None],
                })

    return _moments(df, x_cols, y).mapInPandas(solve, FIT_DDL)


def ols_terms(fit, x_cols, alpha=0.05):
    """Coefficient table: term, coefficient, std_error, t, p_value, significant."""
    names = F.array(*[F.lit(c) for c in ["intercept", *x_cols]])
    rows = fit.select("n", F.explode(F.arrays_zip(
        names.alias("term"), F.col("coefficients").alias("coefficient"),
        F.col("std_errors").alias("std_error"))).alias("z")).select("n", "z.*")
    return (
        rows.withColumn("t", F.try_divide("coefficient", "std_error"))
        .withColumn("p_value", t_two_sided("t", f"n - {len(x_cols) + 1}"))
        .select("term", "coefficient", "std_error", "t", "p_value",
                (F.col("p_value") < alpha).alias("significant"))
    )


def ols_summary(df, fit, y, x_cols, alpha=0.05, order=None):
    """Fit table with the F test, the significant predictors and the diagnostics."""
    p = len(x_cols)
    t = F.transform(
        F.arrays_zip(F.col("coefficients").alias("b"), F.col("std_errors").alias("s")),
        lambda z: F.try_divide(z["b"], z["s"]))
    significant = F.array_compact(F.array(*[
        F.when(t_two_sided(f"t[{i + 1}]", f"n - {p + 1}") < alpha, F.lit(c))
        for i, c in enumerate(x_cols)]))
    statistic = F.lit(None).cast("double")
    if order:
        scored = predict(_complete(df, [y, *x_cols]), fit, x_cols, "fitted")
        scored = scored.withColumn("e", F.col(y) - F.col("fitted"))
        statistic = durbin_watson(scored, "e", order).scalar()
    return (
        fit.withColumn("t", t).withColumn("significant_variables", significant)
        .withColumn("f_p_value", f_upper("f_statistic", f"{p}", f"n - {p + 1}"))
        .select(
            "n", F.lit(p).alias("n_predictors"), "r_squared", "adjusted_r_squared", "rmse",
            "f_statistic", "f_p_value", (F.col("f_p_value") < alpha).alias("model_significant"),
            "significant_variables", F.lit(0.0).alias("residuals_mean"), "residuals_std",
            statistic.alias("durbin_watson"), "condition_number",
            labels.multiple_fit(F.col("r_squared"), F.col("f_p_value"),
                                F.col("significant_variables"), alpha, F.lit(y))
            .alias("interpretation"))
    )


def predict(df, fit, x_cols, output="prediction"):
    """Score rows with a fitted model; the coefficients enter as one scalar subquery."""
    beta = fit.select("coefficients").scalar()
    value = beta[0]
    for i, c in enumerate(x_cols):
        value = value + beta[i + 1] * F.col(c)
    return df.withColumn(output, value)


def predict_simple(df, fit, x, output="prediction"):
    line = fit.select(F.struct("intercept", "slope")).scalar()
    return df.withColumn(output, line["intercept"] + line["slope"] * F.col(x))


def irr_drivers(df, target="irr", drivers=DRIVERS, alpha=0.05):
    """Simple fit of the target on each driver present, ranked by r squared, in one pass.

    Empty with fewer than two drivers.
    """
    drivers = [c for c in drivers if c in df.columns]
    row = df.agg(*[
        F.struct(*_simple_sums(F.col(c), F.col(target))).alias(f"d{i}")
        for i, c in enumerate(drivers)]) if drivers else df.limit(0)
    cells = [F.struct(F.lit(c).alias("driver"), F.col(f"d{i}").alias("s"))
             for i, c in enumerate(drivers)]
    sums = row.select(F.explode(F.array(*cells)).alias("c")).select("c.driver", "c.s.*")
    rank = F.row_number().over(Window.orderBy(F.round("r_squared", 12).desc(), "driver"))
    return (
        _simple_measures(sums, alpha).where(F.lit(len(drivers) >= 2))
        .select("driver", "n", "r_squared", "slope", "p_value", rank.alias("rank"))
    )
