"""Policy features, the annual cash-flow table and per-policy tables built from it."""

from decimal import Decimal

from pyspark.sql import Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from premia.functions.columns import prefix_category, right_closed_bins
from premia.operators.quantiles import order_key, value_of_key
from premia.schemas import (
    AGE_EDGES, AGE_LABELS, COVERAGE_EDGES, COVERAGE_LABELS, OTHER_CATEGORY, PRODUCT_CATEGORIES,
)

_STEP = Decimal(1 << 64)
_MISSING = -(1 << 63)


def policy_features(df, as_of_year, categories=PRODUCT_CATEGORIES, other=OTHER_CATEGORY,
                    keep_existing=False):
    """Category, dates, premium totals, coverage ratio and customer segments.

    ``keep_existing`` keeps a category already present instead of mapping the code again.
    """
    category = prefix_category(F.col("product_code"), categories, other)
    if keep_existing and "product_category" in df.columns:
        category = F.coalesce(F.col("product_category"), category)
    df = df.withColumns({"product_category": category, "product_sub_type": category})
    have, added = set(df.columns), {}
    if "issue_date" in have:
        issued = F.col("issue_date")
        added["issue_year"] = F.year(issued)
        added["issue_month"] = F.month(issued)
        added["issue_quarter"] = F.quarter(issued)
        added["policy_duration_years"] = F.lit(as_of_year) - F.year(issued)
    if {"annual_premium", "payment_term"} <= have:
        added["expected_total_premium"] = F.col("annual_premium") * F.col("payment_term")
    if {"sum_assured", "annual_premium"} <= have:
        added["coverage_premium_ratio"] = F.try_divide("sum_assured", "annual_premium")
    if "insured_age" in have:
        added["age_group"] = right_closed_bins(F.col("insured_age"), AGE_EDGES, AGE_LABELS)
    if "sum_assured" in have:
        added["coverage_group"] = right_closed_bins(
            F.col("sum_assured"), COVERAGE_EDGES, COVERAGE_LABELS)
    return df.withColumns(added)


def _by_year(df, date):
    return (df.withColumn("year", F.year(date))
            .where(F.col("policy_id").isNotNull() & F.col("year").isNotNull()))


def annual_premium(premium):
    return _by_year(premium, "payment_date").groupBy("policy_id", "year").agg(
        F.sum("premium_amount").alias("premium_outflow"))


def year_end_value(cash_value):
    """Last valuation of each policy and year; the largest value of several on that day.

    One aggregate by policy and year, combined before its only shuffle, so that a policy with
    very many records is summed in parts. Repeated rows change nothing, so the input need not be
    distinct.
    """
    last = _value_at(F.max("place"), cash_value.schema["cash_value"].dataType)
    return _valued(cash_value).groupBy("policy_id", "year").agg(last.alias("cash_value_eoy"))


def _valued(cash_value):
    """Each record with its place among those of its policy and year: by date, then by value, a
    missing one first. The place is one number, microseconds times 2^64 plus the value's order
    key, as Spark keeps the greatest number of a group in a hash table, but sorts all records
    for the greatest struct.
    """
    value = F.col("cash_value")
    key = F.when(value.isNull(), F.lit(_MISSING)).otherwise(order_key(value.cast("double")))
    micros = _micros(cash_value, "valuation_date").cast("decimal(18,0)")
    return _by_year(cash_value, "valuation_date").select(
        "policy_id", "year", (micros * F.lit(_STEP) + key.cast("decimal(20,0)")).alias("place"))


def _value_at(place, kind):
    key = (F.pmod(place + F.lit(_STEP / 2), F.lit(_STEP)) - F.lit(_STEP / 2)).cast("bigint")
    return F.when(key != _MISSING, value_of_key(key)).cast(kind)


def _micros(df, date):
    """Microseconds since 1970 on the date's own clock, which no change to summer time turns back."""
    if isinstance(df.schema[date].dataType, T.TimestampType):
        return F.unix_micros(date)
    since = F.col(date).cast("timestamp_ntz") - F.lit("1970-01-01").cast("timestamp_ntz")
    return since.cast("interval second").cast("decimal(18,6)") * 1_000_000


def annual_dividend(dividend):
    return _by_year(dividend, "dividend_date").groupBy("policy_id", "year").agg(
        F.sum("dividend_amount").alias("dividend_amount"))


def cashflow_annual(premium, cash_value, dividend=None):
    """One row per policy and year: flows, carried year-end value and running totals.

    A year is present if it has a premium or a value. Instead of a full outer and a left join
    the records are stacked and meet in one aggregate by policy and year, combined before its
    only shuffle; cash values are not grouped by day first, which moved them all once more. The
    window then sees one row per policy and calendar year, however many
    records a policy has.
    """
    records = (
        _by_year(premium, "payment_date")
        .select("policy_id", "year", "premium_amount", F.lit(1).alias("present"))
        .unionByName(_valued(cash_value).withColumn("present", F.lit(1)),
                     allowMissingColumns=True)
    )
    if dividend is not None:
        records = records.unionByName(_by_year(dividend, "dividend_date").select(
            "policy_id", "year", "dividend_amount"), allowMissingColumns=True)
        paid = F.coalesce(F.sum("dividend_amount"), F.lit(0.0))
    else:
        paid = F.lit(0.0)
    years = records.groupBy("policy_id", "year").agg(
        F.coalesce(F.sum("premium_amount"), F.lit(0.0)).alias("premium_outflow"),
        _value_at(F.max("place"), cash_value.schema["cash_value"].dataType)
        .alias("cash_value_eoy"),
        paid.alias("dividend_amount"), F.count("present").alias("present"),
    ).where(F.col("present") > 0)
    past = (Window.partitionBy("policy_id").orderBy("year")
            .rowsBetween(Window.unboundedPreceding, Window.currentRow))
    carried = F.last("cash_value_eoy", ignorenulls=True).over(past)
    return (
        years.select(
            "policy_id", "year", "premium_outflow",
            F.coalesce(carried, F.lit(0.0)).alias("cash_value_eoy"), "dividend_amount",
            F.sum("premium_outflow").over(past).alias("cumulative_premium"),
            F.sum("dividend_amount").over(past).alias("cumulative_dividend"),
            (F.col("dividend_amount") - F.col("premium_outflow")).alias("net_cashflow"),
        )
    )


def latest_year(cashflow):
    """Last row of each policy, by a keyed aggregate."""
    last = [F.max_by(c, "year").alias(c)
            for c in ("cumulative_premium", "cash_value_eoy", "cumulative_dividend")]
    return cashflow.groupBy("policy_id").agg(*last, F.max("year").alias("year"))


def product_summary(policy, cashflow):
    value = F.col("cash_value_eoy") + F.col("cumulative_dividend")
    return policy.join(latest_year(cashflow), "policy_id", "left").withColumns({
        "total_value": value, "absolute_return": value - F.col("cumulative_premium")})


def policy_rollup(cashflow):
    return cashflow.groupBy("policy_id").agg(
        F.sum("premium_outflow").alias("total_premium_paid"),
        F.max("cumulative_premium").alias("cumulative_premium"),
        F.sum("dividend_amount").alias("total_dividend"),
        F.max("cumulative_dividend").alias("cumulative_dividend"),
        F.max_by("cash_value_eoy", "year").alias("latest_cash_value"),
        F.min("year").alias("first_year"),
        F.max("year").alias("latest_year"),
        F.count("year").alias("observation_years"),
    )


def analysis_wide(policy, cashflow):
    zero = F.lit(0.0)
    return policy.join(policy_rollup(cashflow), "policy_id", "left").withColumn(
        "total_account_value",
        F.coalesce("latest_cash_value", zero) + F.coalesce("cumulative_dividend", zero))
