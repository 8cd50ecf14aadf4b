"""Data-quality checks. Metrics are long tables (table, column, check, value, rate, bounds)."""

from functools import reduce

from pyspark.sql import Window
from pyspark.sql import functions as F

from premia.functions.columns import parse_date
from premia.functions.labels import quality_advice
from premia.operators.quantiles import long_values, quantiles
from premia.schemas import KNOWN_STATUSES, RANGE_RULES, REQUIRED_COLUMNS, numeric_columns

METRIC_COLUMNS = ["table", "column", "check", "value", "rate", "lower", "upper"]


def _metric(table, column, check, value, rate=None, lower=None, upper=None):
    def number(c):
        return (F.lit(None) if c is None else c).cast("double")

    def text(c):
        return F.lit(c) if isinstance(c, str) else c

    return F.struct(
        F.lit(table).alias("table"), text(column).cast("string").alias("column"),
        F.lit(check).alias("check"), value.cast("long").alias("value"),
        number(rate).alias("rate"), number(lower).alias("lower"), number(upper).alias("upper"))


def _rows(one_row, metrics):
    return one_row.select(F.explode(F.array(*metrics)).alias("m")).select("m.*")


def missing_required_columns(df, table):
    """Required columns the table does not have; known from the schema alone."""
    return [c for c in REQUIRED_COLUMNS.get(table, []) if c not in df.columns]


def completeness(df, table):
    """Missing count and rate of every column, and the cell count of the table."""
    counts = df.agg(F.count("*").alias("rows_"), *[
        F.count_if(F.col(c).isNull()).alias(f"m{i}") for i, c in enumerate(df.columns)])
    rows = F.col("rows_")
    metrics = [_metric(table, c, "missing", F.col(f"m{i}"),
                       F.coalesce(F.try_divide(F.col(f"m{i}"), rows), F.lit(0.0)))
               for i, c in enumerate(df.columns)]
    metrics.append(_metric(table, "*", "total_cells", rows * len(df.columns)))
    metrics.append(_metric(table, "*", "total_records", rows))
    return _rows(counts, metrics)


def critical_missing(metrics, limit=0.05):
    """Required columns with more than the allowed share of missing values."""
    required = F.lit(False)
    for table, columns in REQUIRED_COLUMNS.items():
        required = required | ((F.col("table") == table) & F.col("column").isin(*columns))
    return metrics.where(
        (F.col("check") == "missing") & (F.col("rate") > limit) & required
    ).select("table", "column", "rate")


def validity(df, table, rules=None, statuses=KNOWN_STATUSES):
    """Counts below and above the allowed range and of unknown statuses; zero counts left out."""
    rules = RANGE_RULES.get(table, {}) if rules is None else rules
    counts, metrics = [], []

    def add(column, check, condition, lower=None, upper=None):
        name = f"c{len(counts)}"
        counts.append(F.count_if(condition).alias(name))
        metrics.append(_metric(table, column, check, F.col(name), None,
                               None if lower is None else F.lit(lower),
                               None if upper is None else F.lit(upper)))

    for column, (low, high) in rules.items():
        if column in df.columns:
            add(column, "below_min", F.col(column) < low, lower=low)
            add(column, "above_max", F.col(column) > high, upper=high)
    if table == "policy" and "policy_status" in df.columns:
        known = F.coalesce(F.col("policy_status").isin(*statuses), F.lit(False))
        add("policy_status", "invalid_value", ~known)
    if not counts:
        return _rows(df.agg(F.count("*").alias("n")),
                     [_metric(table, "*", "none", F.col("n"))]).where(F.lit(False))
    return _rows(df.agg(*counts), metrics).where(F.col("value") > 0)


def duplicate_keys(df, column="policy_id"):
    """Rows beyond the first of each key: rows minus distinct keys, NULL being one key."""
    groups = df.groupBy(column).agg(F.count("*").alias("rows"))
    return groups.agg(F.coalesce(F.sum(F.col("rows") - 1), F.lit(0)).alias("duplicates"))


def date_order_issues(df, start="issue_date", end="maturity_date"):
    """Rows whose end is not after the start; 0 when any date of the table is unreadable."""
    kinds = {f.name: f.dataType for f in df.schema.fields}
    first, last = parse_date(F.col(start), kinds[start]), parse_date(F.col(end), kinds[end])
    unreadable = ((first.isNull() & F.col(start).isNotNull())
                  | (last.isNull() & F.col(end).isNotNull()))
    counts = df.agg(F.count_if(last <= first).alias("issues"),
                    F.count_if(unreadable).alias("unreadable"))
    return counts.select(
        F.when(F.col("unreadable") > 0, 0).otherwise(F.col("issues")).alias("issues"))


def ratio_issues(df, amount="sum_assured", premium="annual_premium", low=1, high=1000):
    ratio = F.try_divide(F.col(amount), F.col(premium))
    return df.agg(F.count_if((ratio < low) | (ratio > high)).alias("issues"))


def consistency(df, table="policy"):
    """Duplicate ids, date order and coverage ratio, as metric rows."""
    parts = []
    if "policy_id" in df.columns:
        parts.append(_rows(duplicate_keys(df), [
            _metric(table, "policy_id", "duplicates", F.col("duplicates"))]))
    if {"issue_date", "maturity_date"} <= set(df.columns):
        parts.append(_rows(date_order_issues(df), [
            _metric(table, "maturity_date", "date_issues", F.col("issues"))]))
    if {"sum_assured", "annual_premium"} <= set(df.columns):
        parts.append(_rows(ratio_issues(df), [
            _metric(table, "sum_assured", "ratio_issues", F.col("issues"))]))
    return reduce(lambda a, b: a.unionByName(b), parts) if parts else None


def iqr_outliers(df, table, factor=1.5, min_values=10, columns=None):
    """Values outside the quartile fences, per numeric column; zero counts left out.

    The fences are one row per column of the table, so they are broadcast.
    """
    columns = numeric_columns(df) if columns is None else columns
    if not columns:
        return None
    quartiles = quantiles(df, columns, [0.25, 0.75])
    pairs = [F.struct(F.lit(c).alias("name"), F.col(c)[0].alias("q1"), F.col(c)[1].alias("q3"))
             for c in columns]
    reach = factor * (F.col("q3") - F.col("q1"))
    fences = quartiles.select(F.explode(F.array(*pairs)).alias("p")).select("p.*").select(
        "name", (F.col("q1") - reach).alias("lower"), (F.col("q3") + reach).alias("upper"))
    outside = (F.col("v") < F.col("lower")) | (F.col("v") > F.col("upper"))
    counts = (
        long_values(df, columns).join(F.broadcast(fences), "name")
        .groupBy("name", "lower", "upper")
        .agg(F.count("*").alias("n"), F.count_if(outside).alias("outliers"))
        .where((F.col("n") >= min_values) & (F.col("outliers") > 0))
    )
    return counts.select(_metric(
        table, F.col("name"), "outliers", F.col("outliers"),
        F.col("outliers") / F.col("n"), F.col("lower"), F.col("upper")).alias("m")).select("m.*")


#: Salts over which the smallest ids of one table are first taken, so no task sorts a table's ids.
SAMPLE_SALTS = 64


def orphans(child, policy, table, samples=5):
    """Distinct child policy ids without a policy, with the smallest ids as examples (no row
    where there are none)."""
    return cross_table_integrity(policy, samples=samples, **{table: child})


def cross_table_integrity(policy, samples=5, **children):
    """Orphans of every child table in one plan; tables without any are left out.

    The distinct (id, table) pairs of all children meet the parents in one anti join. The
    ``samples`` smallest ids of a table are found within salted parts first (a window over
    (table, salt)), so the final aggregate sees at most ``samples`` ids a salt and table; it also
    counts all orphans. A NULL child id has no parent and counts, but is no example.
    """
    tagged = [child.select("policy_id", F.lit(name).alias("table"))
              for name, child in children.items()
              if child is not None and "policy_id" in child.columns]
    if not tagged:
        return policy.sparkSession.createDataFrame([], "table string, orphan_count long, "
                                                       "sample_ids array<" + policy.schema["policy_id"]
                                                       .dataType.simpleString() + ">")
    ids = reduce(lambda a, b: a.unionByName(b), tagged).distinct()
    parents = policy.select("policy_id").where(F.col("policy_id").isNotNull()).distinct()
    lost = ids.join(parents, "policy_id", "left_anti")
    salt = F.pmod(F.xxhash64("policy_id"), F.lit(SAMPLE_SALTS))
    place = F.row_number().over(Window.partitionBy("table", salt.alias("salt")).orderBy(
        F.col("policy_id").asc_nulls_last()))
    first = lost.withColumn("place", place)
    example = F.when((F.col("place") <= samples) & F.col("policy_id").isNotNull(), F.col("policy_id"))
    found = first.groupBy("table").agg(
        F.count(F.lit(1)).alias("orphan_count"),
        F.slice(F.sort_array(F.collect_list(example)), 1, samples).alias("sample_ids"))
    return found.where(F.col("orphan_count") > 0)


def table_metrics(df, table, factor=1.5, min_values=10):
    """All checks of one table as one long metric table, compiled into one aggregate.

    Missing counts, range and status rules, date order, coverage ratio, outlier counts against
    the quartile fences and the row count are all columns of a single ``agg`` over the table; the
    fences enter it as one scalar subquery (the quartiles' own passes), duplicate ids are one keyed
    count. An empty table gives one ``empty_table`` row, and each required column the table lacks
    a ``missing_column`` row with value 1. Rows with zero rule or outlier counts are left out, as
    each single check does.
    """
    columns, aggs, metrics = df.columns, [F.count(F.lit(1)).alias("rows_")], []
    rows = F.col("rows_")

    def add(expression):
        name = f"a{len(aggs)}"
        aggs.append(expression.alias(name))
        return F.col(name)

    def emit(keep, column, check, value, rate=None, lower=None, upper=None):
        metrics.append(F.struct((keep & (rows > 0)).alias("keep"), _metric(
            table, column, check, value, rate, lower, upper).alias("m")))

    for c in columns:
        missing = add(F.count_if(F.col(c).isNull()))
        emit(F.lit(True), c, "missing", missing, F.coalesce(F.try_divide(missing, rows), F.lit(0.0)))
    emit(F.lit(True), "*", "total_cells", rows * len(columns))
    emit(F.lit(True), "*", "total_records", rows)
    for column, (low, high) in RANGE_RULES.get(table, {}).items():
        if column in columns:
            below = add(F.count_if(F.col(column) < low))
            emit(below > 0, column, "below_min", below, lower=F.lit(low))
            above = add(F.count_if(F.col(column) > high))
            emit(above > 0, column, "above_max", above, upper=F.lit(high))
    if table == "policy" and "policy_status" in columns:
        unknown = add(F.count_if(~F.coalesce(F.col("policy_status").isin(*KNOWN_STATUSES),
                                             F.lit(False))))
        emit(unknown > 0, "policy_status", "invalid_value", unknown)
    if table == "policy" and {"issue_date", "maturity_date"} <= set(columns):
        kinds = {f.name: f.dataType for f in df.schema.fields}
        first = parse_date(F.col("issue_date"), kinds["issue_date"])
        last = parse_date(F.col("maturity_date"), kinds["maturity_date"])
        issues = add(F.count_if(last <= first))
        unreadable = add(F.count_if((first.isNull() & F.col("issue_date").isNotNull())
                                    | (last.isNull() & F.col("maturity_date").isNotNull())))
        emit(F.lit(True), "maturity_date", "date_issues",
             F.when(unreadable > 0, 0).otherwise(issues))
    if table == "policy" and {"sum_assured", "annual_premium"} <= set(columns):
        ratio = F.try_divide(F.col("sum_assured"), F.col("annual_premium"))
        emit(F.lit(True), "sum_assured", "ratio_issues", add(F.count_if((ratio < 1) | (ratio > 1000))))
    numeric = numeric_columns(df)
    if numeric:
        # The quartiles enter once, as one column holding the scalar subquery's struct.
        df = df.withColumn("__fences", quantiles(df, numeric, [0.25, 0.75]).select(
            F.struct(*numeric)).scalar())
        fences = F.col("__fences")
        for c in numeric:
            q1, q3 = fences[c][0], fences[c][1]
            lower, upper = q1 - factor * (q3 - q1), q3 + factor * (q3 - q1)
            v = F.col(c).cast("double")
            n = add(F.count(v))
            outliers = add(F.count_if((v < lower) | (v > upper)))
            emit((n >= min_values) & (outliers > 0), c, "outliers", outliers, F.try_divide(outliers, n),
                 add(F.max(lower)), add(F.max(upper)))
    metrics.append(F.struct((rows == 0).alias("keep"), _metric(
        table, "*", "empty_table", rows).alias("m")))
    for column in missing_required_columns(df, table):  # known from the schema, empty or not
        metrics.append(F.struct(F.lit(True).alias("keep"), _metric(
            table, column, "missing_column", F.lit(1)).alias("m")))
    found = (df.agg(*aggs).select(F.explode(F.array(*metrics)).alias("x"))
             .where(F.col("x.keep")).select("x.m.*"))
    if table == "policy" and "policy_id" in columns:
        found = found.unionByName(_rows(duplicate_keys(df), [
            _metric(table, "policy_id", "duplicates", F.col("duplicates"))]).where(
                df.agg(F.count(F.lit(1))).scalar() > 0))
    return found


def quality_scores(metrics):
    """Score of each table, 0 to 100, with the figures behind it."""
    check = F.col("check")

    def total(name):
        return F.coalesce(F.sum(F.when(check == name, F.col("value"))), F.lit(0))

    def mean_rate(name):
        return F.coalesce(F.avg(F.when(check == name, F.col("rate"))), F.lit(0.0))

    figures = metrics.groupBy("table").agg(
        total("total_records").alias("total_records"),
        mean_rate("missing").alias("mean_missing_rate"),
        F.count_if(check.isin("below_min", "above_max")).alias("range_violations"),
        total("duplicates").alias("duplicates"), total("date_issues").alias("date_issues"),
        total("ratio_issues").alias("ratio_issues"),
        total("outliers").alias("outliers"), mean_rate("outliers").alias("mean_outlier_rate"),
    )
    return figures.withColumn("quality_score", score(
        *[F.col(c) for c in ("mean_missing_rate", "range_violations", "duplicates",
                             "date_issues", "ratio_issues", "mean_outlier_rate")]))


def score(missing_rate, range_violations, duplicates, date_issues, ratio_issues, outlier_rate):
    points = (100 - 30 * missing_rate - 5 * range_violations - 0.1 * duplicates
              - 0.5 * date_issues - 0.2 * ratio_issues - 20 * outlier_rate)
    return F.least(F.greatest(points, F.lit(0.0)), F.lit(100.0))


def validate_table(df, table):
    """Metrics of one table; an empty table gives one ``empty_table`` row and no score."""
    return table_metrics(df, table)


def validate_all(policy, premium, cash_value, dividend=None):
    """Metrics of all tables and the orphan table."""
    tables = {"policy": policy, "premium": premium, "cash_value": cash_value}
    if dividend is not None:
        tables["dividend"] = dividend
    metrics = reduce(lambda a, b: a.unionByName(b),
                     [validate_table(df, name) for name, df in tables.items()])
    no_dividend = (F.col("table") == "dividend") & (F.col("check") == "empty_table")
    metrics = metrics.where(~no_dividend)
    children = {k: v for k, v in tables.items() if k != "policy"}
    return metrics, cross_table_integrity(policy, **children)


def validation_summary(metrics, orphan_table):
    """One row: mean score, counts of issues and warnings, tables, recommendation."""
    scores = quality_scores(metrics.where(F.col("check") != "empty_table"))
    tables = metrics.select("table").distinct().agg(F.count("*")).scalar()
    warned = critical_missing(metrics).select("table").distinct().agg(F.count("*")).scalar()
    issues = orphan_table.agg(F.count("*")).scalar()
    mean = F.coalesce("overall_quality_score", F.lit(0.0))
    return (
        scores.agg(F.avg("quality_score").alias("overall_quality_score"))
        .withColumn("overall_quality_score", mean)
        .select("overall_quality_score", issues.alias("critical_issues_count"),
                warned.alias("warnings_count"), tables.alias("tables_validated"),
                quality_advice(F.col("overall_quality_score")).alias("recommendation"))
    )


def acceptance(summary, threshold=70):
    return summary.select(
        "overall_quality_score",
        (F.col("overall_quality_score") >= threshold).alias("is_acceptable"),
        "critical_issues_count", "warnings_count", "tables_validated", "recommendation")
