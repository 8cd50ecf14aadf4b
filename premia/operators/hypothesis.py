"""Group comparison and normality tests; every test is one grouped aggregate plus formulas."""

import math
from functools import reduce

from pyspark.sql import functions as F

from premia.functions import labels
from premia.functions.special import (
    chi2_upper_2df, f_upper, normal_cdf, normal_quantile, normal_upper, t_two_sided,
)
from premia.operators.aggregates import describe
from premia.operators.ordering import rows_before
from premia.operators.trends import pooled_t

NORMALITY_DDL = "test_type string, n long, statistic double, p_value double"


def group_moments(df, value, group):
    """(group, n, mean, var) of the non-missing values."""
    return df.where(F.col(group).isNotNull()).groupBy(group).agg(
        F.count(value).alias("n"), F.avg(value).alias("mean"), F.var_samp(value).alias("var"))


def ttest(df, value, group, groups=None, alpha=0.05):
    """Pooled t-test of two groups, by default the two smallest keys; empty if too few values."""
    moments = group_moments(df, value, group)
    fields = F.struct(F.col(group).alias("key"), "n", "mean", "var")
    if groups is None:
        two = moments.orderBy(group).limit(2)
        pair = two.agg(F.min_by(fields, group).alias("a"), F.max_by(fields, group).alias("b"),
                       F.count("*").alias("found"))
    else:
        first, second = groups
        pair = moments.where(F.col(group).isin(first, second)).agg(
            F.max(F.when(F.col(group) == first, fields)).alias("a"),
            F.max(F.when(F.col(group) == second, fields)).alias("b"),
            F.count("*").alias("found"))
    pair = pair.where((F.col("found") == 2) & (F.col("a.n") >= 2) & (F.col("b.n") >= 2))
    a, b = F.col("a"), F.col("b")
    t, freedom = pooled_t(a["n"], a["mean"], a["var"], b["n"], b["mean"], b["var"])
    difference = a["mean"] - b["mean"]
    return (
        pair.withColumns({"t_statistic": t, "freedom": freedom})
        .withColumn("p_value", t_two_sided("t_statistic", "freedom"))
        .select(
            a["key"].alias("group1"), a["n"].alias("n1"), a["mean"].alias("mean1"),
            F.sqrt(a["var"]).alias("std1"),
            b["key"].alias("group2"), b["n"].alias("n2"), b["mean"].alias("mean2"),
            F.sqrt(b["var"]).alias("std2"),
            difference.alias("mean_difference"), "t_statistic", "p_value",
            F.try_divide(difference, F.sqrt((a["var"] + b["var"]) / 2)).alias("cohen_d"),
            (F.col("p_value") < alpha).alias("significant"),
            labels.ttest_conclusion(F.col("p_value"), alpha, a["key"], b["key"],
                                    a["mean"], b["mean"]).alias("conclusion"))
    )


def anova(df, value, group, alpha=0.05):
    """One-way ANOVA; empty below 3 groups with 2 values.

    F uses the groups with at least two values, eta squared uses all of them.
    """
    moments = group_moments(df, value, group)
    weighted = F.try_divide(F.sum(F.col("n") * F.col("mean")), F.sum("n"))
    all_mean = moments.agg(weighted).scalar()
    used_mean = moments.where("n >= 2").agg(weighted).scalar()
    used = F.col("n") >= 2
    within = (F.col("n") - 1) * F.col("var")
    sums = moments.withColumns({"all_mean": all_mean, "used_mean": used_mean}).agg(
        F.count("*").alias("groups"), F.count_if(used).alias("k"),
        F.sum(F.when(used, F.col("n"))).alias("used_rows"),
        F.sum(F.when(used, F.col("n") * F.pow(F.col("mean") - F.col("used_mean"), F.lit(2))))
        .alias("between_used"),
        F.sum(F.when(used, within)).alias("within"),
        F.sum(F.col("n") * F.pow(F.col("mean") - F.col("all_mean"), F.lit(2)))
        .alias("between_all"),
    ).where((F.col("groups") >= 3) & (F.col("k") >= 3))
    f = F.try_divide(F.col("between_used") / (F.col("k") - 1),
                     F.try_divide(F.col("within"), F.col("used_rows") - F.col("k")))
    total = F.col("between_all") + F.col("within")
    return (
        sums.withColumn("f_statistic", f)
        .withColumn("p_value", f_upper("f_statistic", "k - 1", "used_rows - k"))
        .select(
            F.col("k").alias("number_of_groups"), "f_statistic", "p_value",
            F.coalesce(F.try_divide(F.col("between_all"), total), F.lit(0.0))
            .alias("eta_squared"),
            (F.col("p_value") < alpha).alias("significant"),
            labels.anova_conclusion(F.col("p_value"), alpha).alias("conclusion"))
    )


def anova_groups(df, value, group):
    """n, mean and std of the groups with at least two values."""
    return group_moments(df, value, group).where("n >= 2").select(
        group, "n", "mean", F.sqrt("var").alias("std"))


def normality_test(df, value, kind="shapiro", alpha=0.05):
    """One row (test_type, n, statistic, p_value, is_normal, conclusion); empty below 3 values.

    ``shapiro`` is the Shapiro-Francia form, which is defined for any number of values;
    ``shapiro_wilk`` is Shapiro and Wilk's W with Royston's weights and p.
    """
    values = df.where(F.col(value).isNotNull())
    test = {"shapiro": lambda: _shapiro(values, value),
            "shapiro_wilk": lambda: shapiro_wilk(values, value),
            "kstest": lambda: _kolmogorov_smirnov(values, value)}.get(
                kind, lambda: _dagostino(values, value))
    return test().where("n >= 3").select(
        "test_type", "n", "statistic", "p_value",
        (F.col("p_value") >= alpha).alias("is_normal"),
        labels.normality_conclusion(F.col("p_value"), alpha).alias("conclusion"))


def skew_kurtosis_scores(df, value):
    """Normal scores of skewness and kurtosis (D'Agostino, Belanger and D'Agostino Jr. 1990)."""
    v = F.col(value).cast("double")
    row = df.agg(F.count(v).alias("count"), F.skewness(v).alias("g1"),
                 (F.kurtosis(v) + 3).alias("b2"))
    row = row.withColumn("n", F.when(F.col("count") >= 8, F.col("count").cast("double")))
    n, g1, b2 = F.col("n"), F.col("g1"), F.col("b2")
    y = g1 * F.sqrt((n + 1) * (n + 3) / (6 * (n - 2)))
    beta = (3 * (n * n + 27 * n - 70) * (n + 1) * (n + 3)
            / ((n - 2) * (n + 5) * (n + 7) * (n + 9)))
    w2 = F.sqrt(2 * (beta - 1)) - 1
    z_skew = F.asinh(y / F.sqrt(2 / (w2 - 1))) / F.sqrt(0.5 * F.log(w2))
    x = ((b2 - 3 * (n - 1) / (n + 1))
         / F.sqrt(24 * n * (n - 2) * (n - 3) / ((n + 1) * (n + 1) * (n + 3) * (n + 5))))
    q = (6 * (n * n - 5 * n + 2) / ((n + 7) * (n + 9))
         * F.sqrt(6 * (n + 3) * (n + 5) / (n * (n - 2) * (n - 3))))
    a = 6 + 8 / q * (2 / q + F.sqrt(1 + 4 / (q * q)))
    inner = (1 - 2 / a) / (1 + x * F.sqrt(2 / (a - 4)))
    z_kurt = (1 - 2 / (9 * a) - F.cbrt(inner)) / F.sqrt(2 / (9 * a))
    return row.select(F.col("count").alias("n"), z_skew.alias("z_skew"),
                      z_kurt.alias("z_kurtosis"))


def _dagostino(values, value):
    scores = skew_kurtosis_scores(values, value)
    k2 = F.col("z_skew") * F.col("z_skew") + F.col("z_kurtosis") * F.col("z_kurtosis")
    return scores.withColumn("statistic", k2).select(
        F.lit("D'Agostino-Pearson检验").alias("test_type"), "n", "statistic",
        chi2_upper_2df("statistic").alias("p_value"))


def _kolmogorov_smirnov(values, value):
    """Against the normal law with the sample's own mean and deviation, over all values.

    D is the greatest gap between the share of values up to each distinct value (just below it and
    at it) and the normal law there: distinct values with their counts take their place from one
    range-partitioned pass, and D is one maximum over them. p is Kolmogorov's limiting law at
    lambda = (sqrt(n) + 0.12 + 0.11 / sqrt(n)) D (Stephens), its alternating series above lambda = 1
    and the theta series below; n is a 64-bit count. Empty when the deviation is 0 or missing.
    """
    numbers = values.select(F.col(value).cast("double").alias("v"))
    moments = numbers.agg(F.avg("v").alias("mean"), F.stddev_samp("v").alias("std"))
    mean, std = moments.select("mean").scalar(), moments.select("std").scalar()
    counts = numbers.groupBy("v").agg(F.count("*").alias("rows"))
    ranked = rows_before(counts, ["v"], weight="rows").withColumn("z", (F.col("v") - mean) / std)
    law = normal_cdf(F.col("z"))
    gap = F.greatest(F.abs((F.col("below") + F.col("rows")) / F.col("n") - law),
                     F.abs(F.col("below") / F.col("n") - law))
    row = ranked.where(F.lit(std) > 0).agg(F.max("n").alias("n"), F.max(gap).alias("statistic"))
    return row.where(F.col("n").isNotNull()).select(
        F.lit("Kolmogorov-Smirnov检验").alias("test_type"), F.col("n").cast("long").alias("n"),
        "statistic", kolmogorov_upper(
            (F.sqrt("n") + 0.12 + 0.11 / F.sqrt("n")) * F.col("statistic")).alias("p_value"))


def kolmogorov_upper(lam):
    """P(K > lambda) of Kolmogorov's law: 2 sum (-1)^(k-1) exp(-2 k^2 lambda^2) above 1, and
    1 - sqrt(2 pi) / lambda sum exp(-(2k - 1)^2 pi^2 / (8 lambda^2)) below (40 terms each)."""
    terms = F.sequence(F.lit(1), F.lit(40))
    above = 2 * F.aggregate(terms, F.lit(0.0), lambda acc, k: acc + F.when(
        k % 2 == 1, 1.0).otherwise(-1.0) * F.exp(-2 * k * k * lam * lam))
    below = 1 - math.sqrt(2 * math.pi) / lam * F.aggregate(terms, F.lit(0.0), lambda acc, k: acc + F.exp(
        -(2 * k - 1) * (2 * k - 1) * math.pi ** 2 / (8 * lam * lam)))
    return (F.when(lam <= 0, F.lit(1.0)).when(lam < 1, below)
            .otherwise(F.least(F.lit(1.0), F.greatest(F.lit(0.0), above))))


def _shapiro(values, value):
    """Shapiro-Francia: squared correlation of all values with the normal scores of their ranks.

    Equal values share the score of their mean rank. p by Royston (1993).
    """
    counts = (values.groupBy(F.col(value).cast("double").alias("v"))
              .agg(F.count("*").alias("rows")))
    ranked = rows_before(counts, ["v"], weight="rows")
    share = (F.col("below") + (F.col("rows") + 1) / 2 - 0.375) / (F.col("n") + 0.25)
    x = ranked.select("v", "rows", "n", normal_quantile(share).alias("m"))
    w = F.col("rows").cast("double")
    total = lambda c: F.sum(w * c)
    v, m = F.col("v"), F.col("m")
    means = x.agg((total(v) / F.sum(w)).alias("v"), (total(m) / F.sum(w)).alias("m"))
    middle = means.select(F.struct("v", "m")).scalar()
    dv, dm = v - middle["v"], m - middle["m"]
    row = x.agg(F.max("n").alias("n"), total(dv * dm).alias("vm"), total(dv * dv).alias("vv"),
                total(dm * dm).alias("mm"))
    # published constants
    log_n = F.log(F.col("n"))
    mean = -1.2725 + 1.0521 * (F.log(log_n) - log_n)
    spread = 1.0308 - 0.26758 * (F.log(log_n) + 2 / log_n)
    z = (F.log(1 - F.col("statistic")) - mean) / spread
    return row.withColumn("statistic", F.coalesce(F.try_divide(
        F.col("vm") * F.col("vm"), F.col("vv") * F.col("mm")), F.lit(1.0))).withColumn(
        "z", F.when(F.col("statistic") < 1, z)).select(
        F.lit("Shapiro-Francia检验").alias("test_type"), "n", "statistic",
        F.coalesce(normal_upper("z"), F.lit(1.0)).alias("p_value"))


# Royston's (1992, 1995) polynomials in u = 1 / sqrt(n), lowest power first, for the
# two outermost weights, and for the mean and log spread of the normalised W.
_LAST = (0.0, 0.221157, -0.147981, -2.071190, 4.434685, -2.706056)
_NEXT = (0.0, 0.042981, -0.293762, -1.752461, 5.682633, -3.582633)
_SMALL_GAMMA = (-2.273, 0.459)
_SMALL_MEAN = (0.5440, -0.39978, 0.025054, -0.0006714)
_SMALL_SPREAD = (1.3822, -0.77857, 0.062767, -0.0020322)
_LARGE_MEAN = (-1.5861, -0.31082, -0.083751, 0.0038915)
_LARGE_SPREAD = (-0.4803, -0.082676, 0.0030302)
#: Ranks of one run of equal values are scored in chunks of this many, so no row holds more.
RANK_CHUNK = 4096


def _poly(x, coefficients):
    return reduce(lambda acc, c: acc * x + c, reversed(coefficients[:-1]), F.lit(coefficients[-1]))


def shapiro_wilk(values, value):
    """Shapiro and Wilk's W over all values, weights by Royston's approximation (AS R94).

    Normal scores m_i = Phi^-1((i - 3/8) / (n + 1/4)) of every rank i; the two outermost weights
    on each side are Royston's polynomials, the others m_i scaled to unit length; for n = 3 the
    weights are exactly +-sqrt(1/2). W = (sum a_i x_(i))^2 / sum (x - mean)^2, and p is Royston's
    normal approximation of log(1 - W) (n >= 12) or of its transform for 4 <= n <= 11, and the
    exact law for n = 3. Ranks come from one range-partitioned pass over distinct values with
    their counts; a run of equal values takes the ranks it covers, scored in chunks of at most
    RANK_CHUNK, so a hot value is never one array. Below 3 values the result is empty.
    """
    counts = (values.groupBy(F.col(value).cast("double").alias("v"))
              .agg(F.count("*").alias("rows")))
    ranked = rows_before(counts, ["v"], weight="rows")
    n = F.col("n").cast("double")
    chunks = F.sequence(F.lit(0).cast("bigint"), F.floor((F.col("rows") - 1) / RANK_CHUNK))
    pieces = ranked.select("v", "rows", "below", "n", F.explode(chunks).alias("chunk"))
    first = F.col("below") + 1 + F.col("chunk") * RANK_CHUNK
    last = F.least(F.col("below") + F.col("rows"), first + RANK_CHUNK - 1)
    score = lambda i: normal_quantile((i - 0.375) / (n + 0.25))
    scores = F.transform(F.sequence(first, last), lambda i: score(i.cast("double")))
    pieces = pieces.select("v", "n", "below", "rows", F.aggregate(scores, F.lit(0.0), lambda a, m: a + m)
                           .alias("m"), F.aggregate(scores, F.lit(0.0), lambda a, m: a + m * m).alias("mm"))
    # The values at ranks 1, 2, n - 1 and n, whose weights are the polynomials.
    at = lambda r: F.max(F.when((F.col("below") < r) & (r <= F.col("below") + F.col("rows")),
                                F.col("v")))
    whole = pieces.agg(
        F.max("n").alias("n"), F.sum(F.col("v") * F.col("m")).alias("vm"), F.sum("mm").alias("mm"),
        at(F.lit(1)).alias("x1"), at(F.lit(2)).alias("x2"),
        at(F.col("n") - 1).alias("y2"), at(F.col("n")).alias("y1"))
    # Squares about the mean, the mean a scalar subquery over the counted values.
    mean = counts.select(F.sum(F.col("v") * F.col("rows")) / F.sum("rows")).scalar()
    spread = counts.agg(F.sum(F.col("rows") * (F.col("v") - mean) ** 2).alias("ss"))
    row = whole.withColumn("ss", spread.scalar())
    return _shapiro_wilk_p(row)


def _shapiro_wilk_p(row):
    n = F.col("n").cast("double")
    score = lambda i: normal_quantile((i - 0.375) / (n + 0.25))
    u, norm = 1 / F.sqrt(n), F.sqrt(F.col("mm"))
    last, second = score(n), score(n - 1)
    a_last = last / norm + _poly(u, _LAST)
    a_second = second / norm + _poly(u, _NEXT)
    outer = F.col("y1") - F.col("x1")
    inner = F.col("y2") - F.col("x2")
    wide = F.sqrt((F.col("mm") - 2 * last * last - 2 * second * second)
                  / (1 - 2 * a_last * a_last - 2 * a_second * a_second))
    narrow = F.sqrt((F.col("mm") - 2 * last * last) / (1 - 2 * a_last * a_last))
    weighted = (F.when(F.col("n") == 3, F.sqrt(F.lit(0.5)) * outer)
                .when(F.col("n") <= 5, (F.col("vm") - last * outer) / narrow + a_last * outer)
                .otherwise((F.col("vm") - last * outer - second * inner) / wide
                           + a_last * outer + a_second * inner))
    w = F.when(F.col("ss") > 0, F.least(F.lit(1.0), weighted * weighted / F.col("ss")))
    row = row.withColumn("statistic", F.coalesce(w, F.lit(1.0)))
    tail = F.log(1 - F.col("statistic"))
    gamma = _poly(n, _SMALL_GAMMA)
    small = (-F.log(gamma - tail) - _poly(n, _SMALL_MEAN)) / F.exp(_poly(n, _SMALL_SPREAD))
    log_n = F.log(n)
    large = (tail - _poly(log_n, _LARGE_MEAN)) / F.exp(_poly(log_n, _LARGE_SPREAD))
    z = F.when(F.col("statistic") >= 1, None).when(F.col("n") >= 12, large).when(tail < gamma, small)
    exact = F.greatest(F.lit(0.0), 6 / F.lit(math.pi) * (F.asin(F.sqrt("statistic")) - math.pi / 3))
    p = (F.when(F.col("statistic") >= 1, F.lit(1.0)).when(F.col("n") == 3, exact)
         .when((F.col("n") <= 11) & (tail >= gamma), F.lit(1e-99)).otherwise(normal_upper("z")))
    return row.withColumn("z", z).select(
        F.lit("Shapiro-Wilk检验").alias("test_type"), F.col("n").cast("long").alias("n"),
        "statistic", p.alias("p_value"))


def compare_by_category(df, value="irr", group="product_category", alpha=0.05):
    """Statistics per category, the fitting test, and the range of the means.

    Returns {"descriptive", "anova", "ttest", "summary"}: the ANOVA table is empty below three
    categories and the t-test table is empty unless there are exactly two.
    """
    stats = describe(df, [group], [value], ["count", "mean", "std", "median", "min", "max"])
    stats = stats.select(group, F.col(f"{value}_count").alias("n"), *[
        F.col(f"{value}_{s}").alias(s) for s in ("mean", "std", "median", "min", "max")])
    moments = group_moments(df, value, group)
    groups = moments.agg(F.count("*")).scalar()
    ranked = moments.where(F.col("mean").isNotNull())
    summary = ranked.agg(
        F.max(F.struct("mean", group)).alias("top"), F.min(F.struct("mean", group)).alias("low")
    ).select(
        F.col(f"top.{group}").alias("highest_category"), F.col("top.mean").alias("highest_mean"),
        F.col(f"low.{group}").alias("lowest_category"), F.col("low.mean").alias("lowest_mean"),
        (F.col("top.mean") - F.col("low.mean")).alias("mean_range"))
    return {"descriptive": stats, "anova": anova(df, value, group, alpha),
            "ttest": ttest(df, value, group, alpha=alpha).where(groups == 2),
            "summary": summary}
