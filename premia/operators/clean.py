"""Cleaning of the four raw tables."""

from pyspark.sql import functions as F
from pyspark.sql import types as T

from premia.functions.columns import clip_nonnegative, normalise_status, parse_date, parse_number
from premia.operators.quantiles import quantiles
from premia.schemas import IN_FORCE_STATUSES, numeric_columns, string_columns
from premia.storage import dealt, store

POLICY_DATES = ["issue_date", "effective_date", "maturity_date", "termination_date"]
POLICY_AMOUNTS = ["sum_assured", "annual_premium", "total_premium"]


def dedupe(df):
    return df.dropDuplicates()


def coerce_types(df, dates=(), numbers=()):
    """Parse the named columns that are present; unreadable values become NULL."""
    kinds = {f.name: f.dataType for f in df.schema.fields}
    parsed = {c: parse_date(F.col(c), kinds[c]) for c in dates if c in kinds}
    parsed |= {c: parse_number(F.col(c)) for c in numbers if c in kinds}
    return df.withColumns(parsed)


def filter_status(df, column="policy_status", valid=IN_FORCE_STATUSES):
    return df.where(F.col(column).isin(*valid))


def impute_numbers(df, columns=None):
    """Missing numbers: 0 in columns named like a value or an amount, else the median.

    Columns filled with a median become doubles.
    """
    columns = numeric_columns(df) if columns is None else columns
    zero = [c for c in columns if "value" in c.lower() or "amount" in c.lower()]
    rest = [c for c in columns if c not in zero]
    filled = {c: F.coalesce(F.col(c), F.lit(0).cast(df.schema[c].dataType)) for c in zero}
    if rest:
        found = quantiles(df, rest, [0.5])
        row = found.select(F.struct(*[F.col(c)[0].alias(c) for c in rest])).scalar()
        filled |= {c: F.coalesce(F.col(c).cast("double"), row[c]) for c in rest}
    return df.withColumns(filled)


def impute_strings(df, columns=None):
    """Missing text: the most frequent value, the smallest of several."""
    columns = string_columns(df) if columns is None else columns
    if not columns:
        return df
    row = modes(df, columns).select(F.struct(*columns)).scalar()
    return df.withColumns({c: F.coalesce(F.col(c), row[c]) for c in columns})


def modes(df, columns):
    """One row with the most frequent value of each text column.

    Values are counted by a keyed aggregate, so no task holds all of a column's values.
    """
    pairs = [F.struct(F.lit(c).alias("name"), F.col(c).alias("v")) for c in columns]
    counts = (
        df.select(F.explode(F.array(*pairs)).alias("pair")).select("pair.name", "pair.v")
        .where(F.col("v").isNotNull())
        .groupBy("name", "v").agg(F.count("*").alias("rows"))
    )
    best = counts.groupBy("name").agg(
        F.min(F.struct((-F.col("rows")).alias("rows"), "v"))["v"].alias("v"))
    return best.agg(*[F.max(F.when(F.col("name") == c, F.col("v"))).alias(c) for c in columns])


def filter_low_premium(df, minimum=1000):
    return df.where(F.col("annual_premium") >= minimum)


def filter_age(df, low=0, high=120):
    return df.where(F.col("insured_age").between(low, high))


def filter_positive(df, column):
    return df.where(F.col(column) > 0)


def filter_quantile_cutoff(df, column, prob=0.99, factor=10):
    """Keep rows at most ``factor`` times the exact quantile."""
    cutoff = quantiles(df, [column], [prob]).select(F.col(column)[0]).scalar()
    return df.where(F.col(column) <= cutoff * factor)


def columns_with_gaps(df, columns):
    """Those of the columns that hold a NULL: one row of counts from one pass."""
    if not columns:
        return []
    row = df.agg(*[F.count_if(F.col(c).isNull()).alias(c) for c in columns]).first()
    return [c for c in columns if row[c]]


def clean_policy(df, min_premium=1000, statuses=IN_FORCE_STATUSES):
    """Clean policy table. Every column keeps its type: a median that fills gaps of an integer
    column is rounded. Medians are only sought for columns with gaps."""
    raw = coerce_types(df, POLICY_DATES, POLICY_AMOUNTS)
    gaps = columns_with_gaps(raw, numeric_columns(raw) + string_columns(raw))
    df = coerce_types(dedupe(df), POLICY_DATES, POLICY_AMOUNTS)
    if "policy_status" in df.columns:
        df = df.withColumn("policy_status", normalise_status(F.col("policy_status")))
        df = filter_status(df, valid=statuses)
    kinds = {c: df.schema[c].dataType for c in numeric_columns(df) if c in gaps}
    df = impute_numbers(df, list(kinds))
    df = df.withColumns({c: F.round(F.col(c)).cast(kind) for c, kind in kinds.items()
                         if isinstance(kind, T.IntegralType)})
    df = impute_strings(df, [c for c in string_columns(df) if c in gaps])
    if "annual_premium" in df.columns:
        df = filter_low_premium(df, min_premium)
    if "insured_age" in df.columns:
        df = filter_age(df)
    return df


def clean_cash_value(df, ordered=False, distinct=True):
    """Values never negative; ``ordered`` sorts the result by policy and date.

    ``distinct`` off spares a shuffle where repeated rows do no harm, as for year-end values.
    """
    df = coerce_types(dedupe(df) if distinct else df, ["valuation_date"], ["cash_value"])
    if "cash_value" in df.columns:
        df = df.withColumn("cash_value", clip_nonnegative(F.col("cash_value")))
    return df.orderBy("policy_id", "valuation_date") if ordered else df


def clean_premium(df, prob=0.99, factor=10):
    """Positive premiums up to ``factor`` times their quantile; the distinct rows are stored, as
    the quantile reads them four times and the filter once more."""
    df = coerce_types(dedupe(dealt(df, *df.columns)), ["payment_date"], ["premium_amount"])
    if "premium_amount" not in df.columns:
        return df
    return filter_quantile_cutoff(store(filter_positive(df, "premium_amount"), "premium"),
                                  "premium_amount", prob, factor)


def clean_dividend(df):
    df = coerce_types(dedupe(dealt(df, *df.columns)), ["dividend_date"], ["dividend_amount"])
    if "dividend_amount" in df.columns:
        df = df.withColumn("dividend_amount", clip_nonnegative(F.col("dividend_amount")))
    return df


def cleaning_audit(df, min_premium=1000, statuses=IN_FORCE_STATUSES):
    """Rows touched by each step of ``clean_policy``: (step, affected_rows, timestamp).

    Steps that change nothing are left out, except the removal of duplicates, which is
    always listed. One scan for the row count and one pass over the deduplicated rows.
    """
    unique = coerce_types(dedupe(df), POLICY_DATES, POLICY_AMOUNTS)
    kept = F.lit(True)
    if "policy_status" in unique.columns:
        status = normalise_status(F.col("policy_status"))
        kept = F.coalesce(status.isin(*statuses), F.lit(False))
    numbers, texts = numeric_columns(unique), string_columns(unique)
    counts = [F.count("*").alias("unique_rows")]
    counts += [F.count_if(kept & F.col(c).isNull()).alias(f"missing {c}")
               for c in numbers + texts]
    if "annual_premium" in numbers:
        median = quantiles(unique.where(kept), ["annual_premium"], [0.5])
        filled = F.coalesce(F.col("annual_premium"),
                            median.select(F.col("annual_premium")[0]).scalar())
        unique = unique.withColumn("low_premium", kept & (filled < min_premium))
        counts.append(F.count_if("low_premium").alias("low"))
    row = unique.agg(*counts)
    all_rows = df.agg(F.count("*")).scalar()
    # fixed values: the names of the steps
    steps = [("删除重复行", all_rows - F.col("unique_rows"))]
    steps += [(f"填充缺失值 [{c}]", F.col(f"missing {c}")) for c in numbers + texts]
    if "annual_premium" in numbers:
        steps.append(("过滤低保费保单", F.col("low")))
    listed = [F.struct(F.lit(i).alias("i"), F.lit(name).alias("step"),
                       count.cast("long").alias("affected_rows"))
              for i, (name, count) in enumerate(steps)]
    return (
        row.select(F.explode(F.array(*listed)).alias("s")).select("s.*")
        .where((F.col("i") == 0) | (F.col("affected_rows") > 0))
        .select("step", "affected_rows", F.current_timestamp().alias("timestamp"))
    )
