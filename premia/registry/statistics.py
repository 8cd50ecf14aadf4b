"""Hypothesis tests, correlation and regression.

Fixed values in the SQL below: test names, labels and conclusions.
"""

from pyspark.sql import functions as F

from premia.functions import special
from premia.operators import correlation, hypothesis, regression
from premia.registry import base
from premia.registry.base import Query, define, sql_f_p, sql_t_p
from premia.registry.grouping import on_returns
from premia.registry.trending import sql_pooled
from premia.sources import views


def _sql_ratio(x, coefficients):
    above, below = ("(" + " + ".join(f"({c}) * pow({x}, {len(cs) - 1 - k})" for k, c in enumerate(cs))
                    + ")" for cs in coefficients)
    return f"({above} / {below})"


def sql_normal_quantile(p):
    """Acklam's inverse of the normal law, as the Spark side computes it."""
    tail = lambda q: _sql_ratio(f"sqrt(-2 * ln({q}))", special._TAIL)
    d = f"(({p}) - 0.5)"
    return (f"(CASE WHEN ({p}) < 0.02425 THEN {tail(p)} WHEN ({p}) > 1 - 0.02425 THEN -{tail(f'1 - ({p})')}"
            f" ELSE {d} * {_sql_ratio(f'{d} * {d}', special._MIDDLE)} END)")


def sql_normal_upper(z):
    half = f"(0.5 * {sql_t_p(z, '1e7')})"
    return f"(CASE WHEN ({z}) >= 0 THEN {half} ELSE 1 - {half} END)"


def _sql_poly(x, coefficients):
    return "(" + " + ".join(f"({c}) * pow({x}, {k})" for k, c in enumerate(coefficients)) + ")"


def sql_shapiro_wilk(table, column):
    """W and p of Shapiro and Wilk with Royston's weights: each row its own rank."""
    score = lambda i: sql_normal_quantile(f"(({i}) - 0.375) / (n + 0.25)")
    u, norm = "(1 / sqrt(n))", "sqrt(mm)"
    last, second = score("n"), score("n - 1")
    a_last = f"({last} / {norm} + {_sql_poly(u, hypothesis._LAST)})"
    a_second = f"({second} / {norm} + {_sql_poly(u, hypothesis._NEXT)})"
    outer, inner = "(y1 - x1)", "(y2 - x2)"
    wide = (f"sqrt((mm - 2 * {last} * {last} - 2 * {second} * {second}) / "
            f"(1 - 2 * {a_last} * {a_last} - 2 * {a_second} * {a_second}))")
    narrow = f"sqrt((mm - 2 * {last} * {last}) / (1 - 2 * {a_last} * {a_last}))"
    weighted = (f"(CASE WHEN n = 3 THEN sqrt(0.5) * {outer} "
                f"WHEN n <= 5 THEN (vm - {last} * {outer}) / {narrow} + {a_last} * {outer} "
                f"ELSE (vm - {last} * {outer} - {second} * {inner}) / {wide} + {a_last} * {outer} "
                f"+ {a_second} * {inner} END)")
    gamma = _sql_poly("n", hypothesis._SMALL_GAMMA)
    small = (f"((-ln({gamma} - ln(1 - statistic)) - {_sql_poly('n', hypothesis._SMALL_MEAN)}) / "
             f"exp({_sql_poly('n', hypothesis._SMALL_SPREAD)}))")
    large = (f"((ln(1 - statistic) - {_sql_poly('ln(n)', hypothesis._LARGE_MEAN)}) / "
             f"exp({_sql_poly('ln(n)', hypothesis._LARGE_SPREAD)}))")
    return f"""
      SELECT 'Shapiro-Wilk检验' AS test_type, n, statistic, p_value,
        p_value >= 0.05 AS is_normal, CASE WHEN p_value >= 0.05 THEN '数据服从正态分布'
          ELSE '数据不服从正态分布' END AS conclusion FROM (
      SELECT n, statistic, CASE WHEN statistic >= 1 THEN 1.0
          WHEN n = 3 THEN greatest(0.0, 6 / pi() * (asin(sqrt(statistic)) - pi() / 3))
          WHEN n <= 11 AND ln(1 - statistic) >= {gamma} THEN 1e-99
          WHEN n <= 11 THEN {sql_normal_upper(small)} ELSE {sql_normal_upper(large)} END AS p_value
      FROM (
        SELECT n, coalesce(CASE WHEN ss > 0 THEN least(1.0, {weighted} * {weighted} / ss) END, 1.0)
          AS statistic
        FROM (
          SELECT CAST(max(n) AS DOUBLE) AS n, sum(m * v) AS vm, sum(m * m) AS mm,
            max(v) FILTER (WHERE i = 1) AS x1, max(v) FILTER (WHERE i = 2) AS x2,
            max(v) FILTER (WHERE i = n - 1) AS y2, max(v) FILTER (WHERE i = n) AS y1,
            max(ss) AS ss
          FROM (
            SELECT v, i, n, {sql_normal_quantile("(i - 0.375) / (n + 0.25)")} AS m, ss FROM (
              SELECT v, row_number() OVER (ORDER BY v) AS i, count(*) OVER () AS n,
                (SELECT sum(pow(CAST({column} AS DOUBLE) - (SELECT avg(CAST({column} AS DOUBLE))
                   FROM {table}), 2)) FROM {table}) AS ss
              FROM (SELECT CAST({column} AS DOUBLE) AS v FROM {table} WHERE {column} IS NOT NULL))))
        WHERE n >= 3))"""


def sql_normal_cdf(x):
    """The same Hart form as ``special.normal_cdf``."""
    a = f"abs({x})"
    def horner(cs):
        out = str(cs[0])
        for c in cs[1:]:
            out = f"({out} * {a} + {c})"
        return out
    fraction = f"({a} + 0.65)"
    for k in (4, 3, 2, 1):
        fraction = f"({a} + {k} / {fraction})"
    near = f"(exp(-{a} * {a} / 2) * {horner(special.HART_ABOVE)} / {horner(special.HART_BELOW)})"
    far = f"(exp(-{a} * {a} / 2) / {fraction} / {special.SQRT_TAU})"
    lower = (f"(CASE WHEN {a} > {special.HART_LIMIT} THEN 0.0 WHEN {a} < {special.HART_SWITCH} "
             f"THEN {near} ELSE {far} END)")
    return f"(CASE WHEN ({x}) > 0 THEN 1 - {lower} ELSE {lower} END)"


def sql_kolmogorov_upper(lam):
    above = (f"(2 * list_sum(list_transform(range(1, 41), lambda k: "
             f"CASE WHEN k % 2 = 1 THEN 1 ELSE -1 END * exp(-2 * k * k * ({lam}) * ({lam})))))")
    below = (f"(1 - sqrt(2 * pi()) / ({lam}) * list_sum(list_transform(range(1, 41), lambda k: "
             f"exp(-(2 * k - 1) * (2 * k - 1) * pi() * pi() / (8 * ({lam}) * ({lam}))))))")
    return (f"(CASE WHEN ({lam}) <= 0 THEN 1.0 WHEN ({lam}) < 1 THEN {below} "
            f"ELSE least(1.0, greatest(0.0, {above})) END)")


def sql_kolmogorov_smirnov(table, column):
    """D against the normal law with the sample's mean and deviation, and Kolmogorov's p."""
    law = sql_normal_cdf("((v - mean) / std)")
    lam = "((sqrt(n) + 0.12 + 0.11 / sqrt(n)) * statistic)"
    return f"""
      SELECT 'Kolmogorov-Smirnov检验' AS test_type, n, statistic, p_value,
        p_value >= 0.05 AS is_normal, CASE WHEN p_value >= 0.05 THEN '数据服从正态分布'
          ELSE '数据不服从正态分布' END AS conclusion FROM (
      SELECT n, statistic, {sql_kolmogorov_upper(lam)} AS p_value FROM (
        SELECT max(n) AS n, max(greatest(abs((below + rows) / n - {law}), abs(below / n - {law})))
          AS statistic
        FROM (
          SELECT v, rows, sum(rows) OVER (ORDER BY v ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
              AS b0, coalesce(b0, 0) AS below, sum(rows) OVER () AS n,
            (SELECT avg(CAST({column} AS DOUBLE)) FROM {table}) AS mean,
            (SELECT stddev_samp(CAST({column} AS DOUBLE)) FROM {table}) AS std
          FROM (SELECT CAST({column} AS DOUBLE) AS v, count(*) AS rows FROM {table}
                WHERE {column} IS NOT NULL GROUP BY 1))
        WHERE std > 0)
      WHERE n >= 3)"""


def _table(name, operator, *args, **kwargs):
    return lambda spark, sf_dir: operator(views.given(spark, sf_dir, name), *args, **kwargs)


def _by_category(part):
    return lambda spark, sf_dir: hypothesis.compare_by_category(base.returns(spark, sf_dir))[part]


def skew_scores(spark, sf_dir):
    return hypothesis.skew_kurtosis_scores(views.given(spark, sf_dir, "orders"), "o_totalprice")


def driver_summary(spark, sf_dir):
    return correlation.driver_summary(correlation.driver_correlations(
        base.returns(spark, sf_dir), "irr", FEATURES))


def relationship(part):
    return lambda spark, sf_dir: correlation.premium_irr_relationship(
        base.returns(spark, sf_dir))[part]


LINE = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_shipdate", "l_extendedprice",
        "l_quantity"]
PREDICTORS = ["l_quantity", "l_discount"]


def simple_ols(spark, sf_dir):
    return regression.simple_ols(views.given(spark, sf_dir, "lineitem"), "l_quantity",
                                 "l_extendedprice", order=LINE)


def _fit(spark, sf_dir):
    lines = views.given(spark, sf_dir, "lineitem")
    return lines, regression.fit_ols(lines, "l_extendedprice", PREDICTORS)


def multiple_ols_terms(spark, sf_dir):
    return regression.ols_terms(_fit(spark, sf_dir)[1], PREDICTORS)


def multiple_ols(spark, sf_dir):
    lines, fit = _fit(spark, sf_dir)
    found = regression.ols_summary(lines, fit, "l_extendedprice", PREDICTORS, order=LINE)
    return found.withColumn("significant_variables", F.array_join("significant_variables", ","))


def predict_ols(spark, sf_dir):
    lines, fit = _fit(spark, sf_dir)
    return regression.predict(lines, fit, PREDICTORS)


def predict_simple(spark, sf_dir):
    lines = views.given(spark, sf_dir, "lineitem")
    fit = regression.simple_ols(lines, "l_quantity", "l_extendedprice")
    return regression.predict_simple(lines, fit, "l_quantity")


def durbin_watson(spark, sf_dir):
    lines = views.given(spark, sf_dir, "lineitem").withColumn(
        "e", F.col("l_extendedprice") - 50_000)
    return regression.durbin_watson(lines, "e", LINE)


DRIVERS = regression.DRIVERS
FEATURES = ["annual_premium", "payment_term", "sum_assured", "insured_age", "observation_years",
            "latest_cash_value", "cumulative_premium"]


def irr_model(spark, sf_dir):
    """The joint model of the drivers."""
    return regression.ols_terms(
        regression.fit_ols(base.returns(spark, sf_dir), "irr", DRIVERS), DRIVERS)


# SQL ---------------------------------------------------------------------------------------

def sql_ttest(source, value, group):
    t = sql_pooled("n1", "mean1", "var1", "n2", "mean2", "var2")
    return f"""
      SELECT *, sqrt(var1) AS std1, sqrt(var2) AS std2, mean1 - mean2 AS mean_difference,
        (mean1 - mean2) / sqrt((var1 + var2) / 2) AS cohen_d, p_value < 0.05 AS significant,
        CASE WHEN p_value < 0.05 THEN '在α=0.05水平下，两组均值存在显著差异，' ||
          CASE WHEN mean1 > mean2 THEN group1 ELSE group2 END || '组的均值更高'
          ELSE '在α=0.05水平下，两组均值无显著差异' END AS conclusion
      FROM (SELECT *, {sql_t_p('t_statistic', 'n1 + n2 - 2')} AS p_value FROM (
        SELECT *, {t} AS t_statistic FROM (
          SELECT a.g AS group1, a.n AS n1, a.m AS mean1, a.v AS var1,
            b.g AS group2, b.n AS n2, b.m AS mean2, b.v AS var2
          FROM (SELECT *, row_number() OVER (ORDER BY g) AS k FROM ({sql_moments(source, value, group)})) a
          JOIN (SELECT *, row_number() OVER (ORDER BY g) AS k FROM ({sql_moments(source, value, group)})) b
            ON a.k = 1 AND b.k = 2) WHERE n1 >= 2 AND n2 >= 2))"""


def sql_moments(source, value, group):
    return (f"SELECT {group} AS g, count({value}) AS n, avg({value}) AS m, "
            f"var_samp({value}) AS v FROM {source} WHERE {group} IS NOT NULL GROUP BY {group}")


def sql_anova(source, value, group):
    p = sql_f_p("f_statistic", "number_of_groups - 1", "rows_ - number_of_groups")
    return f"""
      SELECT *, p_value < 0.05 AS significant,
        CASE WHEN p_value < 0.05 THEN '在α=0.05水平下，各组均值存在显著差异，建议进行事后多重比较'
          WHEN p_value IS NOT NULL THEN '在α=0.05水平下，各组均值无显著差异' END AS conclusion
      FROM (SELECT *, {p} AS p_value FROM (
        SELECT k AS number_of_groups, n AS rows_, (ssb / (k - 1)) / (ssw / (n - k)) AS f_statistic,
          ssb_all / (ssb_all + ssw) AS eta_squared
        FROM (SELECT count(*) FILTER (n >= 2) AS k, sum(n) FILTER (n >= 2) AS n,
            sum(n * (m - used) ** 2) FILTER (n >= 2) AS ssb,
            coalesce(sum((n - 1) * v) FILTER (n >= 2), 0) AS ssw,
            sum(n * (m - total) ** 2) AS ssb_all
          FROM (SELECT *, sum(n * m) OVER () / sum(n) OVER () AS total,
                  sum(CASE WHEN n >= 2 THEN n * m END) OVER () /
                  sum(CASE WHEN n >= 2 THEN n END) OVER () AS used
                FROM ({sql_moments(source, value, group)}))) WHERE k >= 3))"""


def sql_pair(source, x, y, method="Pearson", r=None):
    """One correlation row from rows (x, y)."""
    r = r or "corr(x, y)"
    return f"""
      SELECT '{method}' AS method, '{x}' AS variable1, '{y}' AS variable2, n, correlation, p_value,
        correlation * correlation AS r_squared, p_value < 0.05 AS significant,
        CASE WHEN abs(correlation) < 0.3 THEN '弱相关' WHEN abs(correlation) < 0.5 THEN '中等相关'
          WHEN abs(correlation) < 0.7 THEN '较强相关' ELSE '强相关' END AS strength,
        CASE WHEN correlation > 0 THEN '正相关' ELSE '负相关' END AS direction
      FROM (SELECT *, {sql_t_p('(correlation * sqrt((n - 2) / (1 - correlation ** 2)))', 'n - 2')}
              AS p_value
            FROM (SELECT count(*) AS n, {r} AS correlation FROM (
              SELECT CAST({x} AS DOUBLE) AS x, CAST({y} AS DOUBLE) AS y FROM {source}
              WHERE {x} IS NOT NULL AND {y} IS NOT NULL)))"""


def sql_ranks(source, *columns):
    """Rows of the complete cases with each column replaced by its average rank."""
    ranked = ", ".join(f"rank() OVER (ORDER BY {c}) + (count(*) OVER (PARTITION BY {c}) - 1) / 2.0 "
                       f"AS {c}" for c in columns)
    present = " AND ".join(f"{c} IS NOT NULL" for c in columns)
    return f"(SELECT {ranked} FROM {source} WHERE {present})"


def sql_matrix(source, columns):
    present = " AND ".join(f"{c} IS NOT NULL" for c in columns)
    cells = [f"SELECT '{a}' AS var1, '{b}' AS var2, count(*) AS n, "
             + ("1.0" if a == b else f"corr({a}, {b})") + f" AS correlation FROM {source} "
             f"WHERE {present}" for a in columns for b in columns]
    p = sql_t_p("(correlation * sqrt((n - 2) / (1 - correlation ** 2)))", "n - 2")
    return f"""
      SELECT *, var1 <> var2 AND p_value < 0.05 AND abs(correlation) > 0.3 AS notable,
        var1 <> var2 AND p_value < 0.05 AND abs(correlation) > 0.5 AS strong
      FROM (SELECT *, CASE WHEN var1 = var2 THEN 1.0 ELSE {p} END AS p_value
            FROM ({' UNION ALL '.join(cells)}))"""


def sql_drivers(columns):
    rows = " UNION ALL ".join(
        f"SELECT '{c}' AS feature, count(*) AS n, corr({c}, irr) AS correlation FROM returns "
        f"WHERE {c} IS NOT NULL AND irr IS NOT NULL" for c in columns)
    p = sql_t_p("(correlation * sqrt((n - 2) / (1 - correlation ** 2)))", "n - 2")
    return (f"SELECT *, abs(correlation) AS abs_correlation, p_value < 0.05 AS significant "
            f"FROM (SELECT *, {p} AS p_value FROM ({rows}))")


def sql_simple_fit(source, x, y):
    return f"""
      SELECT *, sqrt(sse / (n - 2)) AS rmse, sqrt(sse / (n - 2) / sxx) AS slope_std_error,
        sqrt(sse / (n - 2)) * sqrt(1.0 / n + mx * mx / sxx) AS intercept_std_error,
        1 - sse / syy AS r_squared, 1 - (sse / syy) * (n - 1) / (n - 2) AS adjusted_r_squared,
        sqrt(sse / n) AS residuals_std, 0 AS residuals_mean
      FROM (SELECT *, syy - sxy * sxy / sxx AS sse FROM (
        SELECT regr_count({y}, {x}) AS n, regr_avgx({y}, {x}) AS mx, regr_slope({y}, {x}) AS slope,
          regr_intercept({y}, {x}) AS intercept, regr_sxx({y}, {x}) AS sxx,
          regr_syy({y}, {x}) AS syy, regr_sxy({y}, {x}) AS sxy, corr({y}, {x}) AS correlation
        FROM {source}))"""


def sql_durbin_watson(residual, source, order):
    return (f"SELECT sum(d * d) / sum(e * e) AS durbin_watson FROM (SELECT e, e - lag(e) OVER "
            f"(ORDER BY {', '.join(order)}) AS d FROM (SELECT *, {residual} AS e FROM {source}))")


define("line_fit", "", sql_simple_fit("lineitem", "l_quantity", "l_extendedprice"))
# Two predictors by Cramer's rule on centred sums.
define("line_sums", "", """
  SELECT count(*) AS n, avg(l_extendedprice) AS my, avg(l_quantity) AS m1, avg(l_discount) AS m2,
    count(*) * var_pop(l_quantity) AS s11, count(*) * var_pop(l_discount) AS s22,
    count(*) * covar_pop(l_quantity, l_discount) AS s12,
    count(*) * covar_pop(l_quantity, l_extendedprice) AS s1y,
    count(*) * covar_pop(l_discount, l_extendedprice) AS s2y,
    count(*) * var_pop(l_extendedprice) AS syy FROM lineitem""")
define("line_model", "line_sums", """
  SELECT *, sse / (n - 3) AS mse FROM (
    SELECT *, syy - b1 * s1y - b2 * s2y AS sse, my - b1 * m1 - b2 * m2 AS b0 FROM (
      SELECT *, s11 * s22 - s12 * s12 AS det, (s1y * s22 - s2y * s12) / (s11 * s22 - s12 * s12) AS b1,
        (s2y * s11 - s1y * s12) / (s11 * s22 - s12 * s12) AS b2 FROM line_sums))""")
define("line_terms", "line_model", f"""
  SELECT *, coefficient / std_error AS t, p_value < 0.05 AS significant FROM (
    SELECT *, {sql_t_p('(coefficient / std_error)', 'n - 3')} AS p_value FROM (
      SELECT n, 'intercept' AS term, b0 AS coefficient, sqrt(mse * (1.0 / n + (m1 * m1 * s22
        - 2 * m1 * m2 * s12 + m2 * m2 * s11) / det)) AS std_error FROM line_model
      UNION ALL SELECT n, 'l_quantity', b1, sqrt(mse * s22 / det) FROM line_model
      UNION ALL SELECT n, 'l_discount', b2, sqrt(mse * s11 / det) FROM line_model))""")

PAIR = ("method:s variable1:s variable2:s n:l correlation:6 p_value:6 r_squared:6 significant:b "
        "strength:s direction:s")
TTEST = ("group1:s n1:l mean1:6 std1:6 group2:s n2:l mean2:6 std2:6 mean_difference:6 "
         "t_statistic:6 p_value:6 cohen_d:6 significant:b conclusion:s")
ANOVA = "number_of_groups:l f_statistic:6 p_value:6 eta_squared:6 significant:b conclusion:s"
MATRIX = "var1:s var2:s n:l correlation:6 p_value:6 notable:b strong:b"
NORMAL = "test_type:s n:l statistic:6 p_value:6 is_normal:b conclusion:s"
TAX = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]
RANKED_TAX = sql_ranks("lineitem", *TAX)

K2 = """
  SELECT count AS n, z1 AS z_skew, z2 AS z_kurtosis, z1 * z1 + z2 * z2 AS statistic,
    exp(-(z1 * z1 + z2 * z2) / 2) AS p_value FROM (
  SELECT count, asinh(y / sqrt(2 / (w2 - 1))) / sqrt(0.5 * ln(w2)) AS z1,
    ((1 - 2 / (9 * a)) - cbrt((1 - 2 / a) / (1 + x * sqrt(2 / (a - 4))))) / sqrt(2 / (9 * a)) AS z2
  FROM (SELECT *, sqrt(2 * (beta - 1)) - 1 AS w2,
      6 + 8 / q * (2 / q + sqrt(1 + 4 / (q * q))) AS a
    FROM (SELECT *, g1 * sqrt((n + 1) * (n + 3) / (6 * (n - 2))) AS y,
        3 * (n * n + 27 * n - 70) * (n + 1) * (n + 3) / ((n - 2) * (n + 5) * (n + 7) * (n + 9))
          AS beta,
        (b2 - 3 * (n - 1) / (n + 1)) / sqrt(24 * n * (n - 2) * (n - 3) /
          ((n + 1) * (n + 1) * (n + 3) * (n + 5))) AS x,
        6 * (n * n - 5 * n + 2) / ((n + 7) * (n + 9)) *
          sqrt(6 * (n + 3) * (n + 5) / (n * (n - 2) * (n - 3))) AS q
      FROM (SELECT count(*) AS count, CAST(count(*) AS DOUBLE) AS n,
          avg((v - m) ** 3) / pow(avg((v - m) ** 2), 1.5) AS g1,
          avg((v - m) ** 4) / pow(avg((v - m) ** 2), 2) AS b2
        FROM (SELECT o_totalprice AS v, avg(o_totalprice) OVER () AS m FROM orders)))))"""

QUERIES = [
    Query("ttest", on_returns(hypothesis.ttest, "irr", "product_category"), TTEST,
          sql_ttest("returns", "irr", "product_category"), "returns"),
    Query("ttest_events", _table("events", hypothesis.ttest, "value", "event_type",
                                 ["click", "error"]), TTEST,
          sql_ttest("(SELECT * FROM events WHERE event_type IN ('click', 'error'))", "value",
                    "event_type")),
    Query("anova", on_returns(hypothesis.anova, "irr", "product_category"), ANOVA,
          sql_anova("returns", "irr", "product_category"), "returns"),
    Query("anova_orders", _table("orders", hypothesis.anova, "o_totalprice", "o_orderpriority"),
          ANOVA, sql_anova("orders", "o_totalprice", "o_orderpriority")),
    Query("anova_groups", _table("orders", hypothesis.anova_groups, "o_totalprice",
                                 "o_orderpriority"), "o_orderpriority:s n:l mean:4 std:4", """
      SELECT o_orderpriority, count(*) AS n, avg(o_totalprice) AS mean,
        stddev_samp(o_totalprice) AS std FROM orders GROUP BY o_orderpriority
      HAVING count(*) >= 2"""),
    Query("dagostino_k2", _table("orders", hypothesis.normality_test, "o_totalprice",
                                 "normaltest"), NORMAL, f"""
      SELECT 'D''Agostino-Pearson检验' AS test_type, n, statistic, p_value,
        p_value >= 0.05 AS is_normal, CASE WHEN p_value >= 0.05 THEN '数据服从正态分布'
          ELSE '数据不服从正态分布' END AS conclusion FROM ({K2})"""),
    Query("skew_kurtosis_scores", skew_scores, "n:l z_skew:6 z_kurtosis:6", K2),
    Query("ks_normality", _table("orders", hypothesis.normality_test, "o_totalprice", "kstest"),
          NORMAL, sql_kolmogorov_smirnov("orders", "o_totalprice")),
    Query("ks_normality_part", _table("part", hypothesis.normality_test, "p_retailprice", "kstest"),
          NORMAL, sql_kolmogorov_smirnov("part", "p_retailprice")),
    Query("shapiro_francia", _table("part", hypothesis.normality_test, "p_retailprice", "shapiro"),
          NORMAL),
    Query("shapiro_wilk", _table("part", hypothesis.normality_test, "p_retailprice", "shapiro_wilk"),
          NORMAL, sql_shapiro_wilk("part", "p_retailprice")),
    Query("shapiro_wilk_orders", _table("orders", hypothesis.normality_test, "o_totalprice",
                                        "shapiro_wilk"),
          NORMAL, sql_shapiro_wilk("orders", "o_totalprice")),
    Query("irr_by_category", _by_category("descriptive"),
          "product_category:s n:l mean:6 std:6 median:6 min:6 max:6", """
      SELECT product_category, count(irr) AS n, avg(irr) AS mean, stddev_samp(irr) AS std,
        median(irr) AS median, min(irr) AS min, max(irr) AS max FROM returns GROUP BY ALL""",
          "returns"),
    Query("irr_category_range", _by_category("summary"),
          "highest_category:s highest_mean:6 lowest_category:s lowest_mean:6 mean_range:6", """
      SELECT arg_max(c, m) AS highest_category, max(m) AS highest_mean,
        arg_min(c, m) AS lowest_category, min(m) AS lowest_mean, max(m) - min(m) AS mean_range
      FROM (SELECT product_category AS c, avg(irr) AS m FROM returns GROUP BY ALL)""", "returns"),
    Query("pearson", on_returns(correlation.pearson, "irr", "annual_premium"), PAIR,
          sql_pair("returns", "irr", "annual_premium"), "returns"),
    Query("pearson_lines", _table("lineitem", correlation.pearson, "l_quantity",
                                  "l_extendedprice"), PAIR,
          sql_pair("lineitem", "l_quantity", "l_extendedprice")),
    Query("spearman", on_returns(correlation.spearman, "irr", "annual_premium"), PAIR,
          sql_pair(sql_ranks("returns", "irr", "annual_premium"), "irr", "annual_premium",
                   "Spearman"), "returns"),
    Query("spearman_lines", _table("lineitem", correlation.spearman, "l_quantity",
                                   "l_extendedprice"), PAIR,
          sql_pair(sql_ranks("lineitem", "l_quantity", "l_extendedprice"), "l_quantity",
                   "l_extendedprice", "Spearman")),
    Query("corr_matrix", _table("lineitem", correlation.correlation_matrix, TAX), MATRIX,
          sql_matrix("lineitem", TAX)),
    Query("corr_matrix_spearman", _table("lineitem", correlation.correlation_matrix, TAX,
                                         "spearman"), MATRIX, sql_matrix(RANKED_TAX, TAX)),
    Query("premium_irr_correlations", relationship("correlations"), PAIR,
          sql_pair("returns", "annual_premium", "irr") + " UNION ALL " + sql_pair(
              sql_ranks("returns", "annual_premium", "irr"), "annual_premium", "irr",
              "Spearman"), "returns"),
    Query("premium_irr_quartiles", relationship("quartiles"),
          "quartile:s ordinal:i mean:6 std:6 count:l", """
      SELECT ['低', '中低', '中高', '高'][ordinal] AS quartile, ordinal, avg(irr) AS mean,
        stddev_samp(irr) AS std, count(irr) AS count
      FROM (SELECT irr, 1 + CAST(annual_premium > q[1] AS INTEGER)
              + CAST(annual_premium > q[2] AS INTEGER)
              + CAST(annual_premium > q[3] AS INTEGER) AS ordinal
            FROM returns, (SELECT quantile_cont(annual_premium, [0.25, 0.5, 0.75]) AS q
                           FROM returns)) GROUP BY ordinal""", "returns"),
    Query("premium_irr_conclusion", relationship("conclusion"), "conclusion:s", f"""
      SELECT CASE WHEN significant THEN '保费与IRR之间存在显著的' || direction || '关系（' ||
          strength || '），相关系数为' || format('{{:.3f}}', correlation)
        ELSE '保费与IRR之间不存在显著的相关关系' END AS conclusion
      FROM ({sql_pair('returns', 'annual_premium', 'irr')})""", "returns"),
    Query("key_drivers", on_returns(correlation.key_drivers, "irr", FEATURES),
          "feature:s n:l correlation:6 abs_correlation:6 p_value:6 significant:b rank:i", f"""
      SELECT *, row_number() OVER (ORDER BY round(abs_correlation, 12) DESC, feature) AS rank
      FROM ({sql_drivers(FEATURES)}) QUALIFY rank <= 5""", "returns"),
    Query("driver_summary", driver_summary,
          "total_features_analyzed:l significant_features:l strong_correlations:l", f"""
      SELECT count(*) AS total_features_analyzed,
        count(*) FILTER (significant) AS significant_features,
        count(*) FILTER (abs_correlation > 0.5) AS strong_correlations
      FROM ({sql_drivers(FEATURES)})""", "returns"),
    Query("simple_ols", simple_ols, (
        "n:l intercept:4 slope:4 intercept_std_error:4 slope_std_error:4 correlation:6 "
        "r_squared:6 adjusted_r_squared:6 rmse:4 p_value:6 slope_significant:b residuals_mean:4 "
        "residuals_std:4 durbin_watson:6 interpretation:s"), f"""
      SELECT *, p_value < 0.05 AS slope_significant,
        CASE WHEN p_value >= 0.05 THEN 'l_quantity对l_extendedprice的影响不显著'
          WHEN p_value IS NOT NULL THEN 'l_quantity对l_extendedprice存在显著的'
            || CASE WHEN slope > 0 THEN '正向' ELSE '负向' END || '影响，模型'
            || CASE WHEN r_squared < 0.1 THEN '解释力较弱' WHEN r_squared < 0.3 THEN '具有一定的解释力'
                 WHEN r_squared < 0.5 THEN '具有中等解释力' ELSE '具有较强的解释力' END
            || '(R²=' || printf('%.3f', r_squared) || ')' END AS interpretation
      FROM (
        SELECT *, {sql_t_p('(slope / slope_std_error)', 'n - 2')} AS p_value,
          ({sql_durbin_watson(
              'l_extendedprice - (SELECT intercept FROM line_fit) - '
              '(SELECT slope FROM line_fit) * l_quantity', 'lineitem', LINE)}) AS durbin_watson
        FROM line_fit)""", "line_fit"),
    Query("multiple_ols_terms", multiple_ols_terms,
          "term:s coefficient:4 std_error:4 t:6 p_value:6 significant:b",
          "SELECT * FROM line_terms", "line_terms"),
    Query("multiple_ols", multiple_ols, (
        "n:l n_predictors:i r_squared:6 adjusted_r_squared:6 rmse:4 f_statistic:4 f_p_value:6 "
        "model_significant:b significant_variables:s residuals_mean:4 residuals_std:4 "
        "durbin_watson:6 interpretation:s"), f"""
      SELECT *, f_p_value < 0.05 AS model_significant,
        CASE WHEN f_p_value >= 0.05 THEN '整体模型不显著，无法有效解释l_extendedprice的变化'
          WHEN f_p_value IS NOT NULL AND significant_variables = ''
            THEN '模型整体显著但无显著变量，可能存在多重共线性'
          WHEN f_p_value IS NOT NULL THEN '模型' || CASE WHEN r_squared < 0.3 THEN '拟合效果一般'
              WHEN r_squared < 0.5 THEN '拟合效果中等' WHEN r_squared < 0.7 THEN '拟合效果较好'
              ELSE '拟合效果很好' END || '，'
            || CAST(len(string_split(significant_variables, ',')) AS VARCHAR) || '个变量显著影响l_extendedprice'
            || '，显著变量: ' || replace(significant_variables, ',', ', ') END AS interpretation
      FROM (
        SELECT *, {sql_f_p('f_statistic', '2', 'n - 3')} AS f_p_value FROM (
          SELECT n, 2 AS n_predictors, 1 - sse / syy AS r_squared,
            1 - (sse / syy) * (n - 1) / (n - 3) AS adjusted_r_squared, sqrt(mse) AS rmse,
            (syy - sse) / 2 / mse AS f_statistic, 0 AS residuals_mean,
            sqrt(sse / n) AS residuals_std,
            (SELECT coalesce(string_agg(term, ',' ORDER BY term DESC), '') FROM line_terms
             WHERE significant AND term <> 'intercept') AS significant_variables,
            ({sql_durbin_watson(
                'l_extendedprice - (SELECT b0 FROM line_model) - (SELECT b1 FROM line_model) '
                '* l_quantity - (SELECT b2 FROM line_model) * l_discount', 'lineitem', LINE)})
              AS durbin_watson
          FROM line_model))""", "line_model line_terms"),
    Query("predict_ols", predict_ols, "l_orderkey:l l_linenumber:i prediction:4", """
      SELECT l_orderkey, l_linenumber, b0 + b1 * l_quantity + b2 * l_discount AS prediction
      FROM lineitem, line_model""", "line_model"),
    Query("predict_simple", predict_simple, "l_orderkey:l l_linenumber:i prediction:4", """
      SELECT l_orderkey, l_linenumber, intercept + slope * l_quantity AS prediction
      FROM lineitem, line_fit""", "line_fit"),
    Query("irr_drivers", on_returns(regression.irr_drivers),
          "driver:s n:l r_squared:6 slope:8 p_value:6 rank:i", f"""
      SELECT *, row_number() OVER (ORDER BY round(r_squared, 12) DESC, driver) AS rank FROM (
        SELECT *, {sql_t_p('(slope / slope_std_error)', 'n - 2')} AS p_value FROM ({
          ' UNION ALL '.join(f"SELECT '{c}' AS driver, * FROM ({sql_simple_fit('returns', c, 'irr')})"
                             for c in DRIVERS)}))""", "returns"),
    Query("irr_driver_model", irr_model, "term:s coefficient:6 std_error:6 t:4 p_value:6"),
    Query("durbin_watson", durbin_watson, "durbin_watson:6",
          sql_durbin_watson("l_extendedprice - 50000", "lineitem", LINE)),
]
