"""Cash-flow mathematics for all policies in one grouped job."""

from pyspark.sql import Window
from pyspark.sql import functions as F

from premia.functions import solvers
from premia.storage import dealt


def annual_series(cashflow):
    """Per policy: year count, first and last year-end value, and the two flow arrays.

    ``flows`` holds minus the premium of each year, ``flows_with_dividend`` adds the
    dividend; both end with the last year-end value added. The arrays have one entry per
    calendar year.
    """
    year = F.struct("year", "premium_outflow", "dividend_amount", "cash_value_eoy")
    packed = dealt(cashflow, "policy_id").groupBy("policy_id").agg(
        F.sort_array(F.collect_list(year)).alias("years"))
    last = F.size("years") - 1

    def series(flow):
        return F.transform("years", lambda y, i: flow(y) + F.when(
            i == last, y["cash_value_eoy"]).otherwise(F.lit(0.0)))

    return packed.select(
        "policy_id",
        F.size("years").alias("periods"),
        F.col("years")[0]["cash_value_eoy"].alias("first_value"),
        F.element_at("years", -1)["cash_value_eoy"].alias("last_value"),
        series(lambda y: -y["premium_outflow"]).alias("flows"),
        series(lambda y: y["dividend_amount"] - y["premium_outflow"])
        .alias("flows_with_dividend"),
    )


def flow_arrays(df, keys, order, amount):
    """Array of flows per group in order; flows of one period are summed first."""
    periods = df.groupBy(*keys, order).agg(F.sum(amount).alias("flow"))
    packed = periods.groupBy(*keys).agg(
        F.sort_array(F.collect_list(F.struct(order, "flow"))).alias("p"))
    return packed.select(*keys, F.transform("p", lambda x: x["flow"]).alias("flows"))


def irr_by_group(df, keys, order, amount):
    """IRR of every group of (order, amount) rows."""
    return flow_arrays(df, keys, order, amount).withColumn("irr", solvers.irr(F.col("flows")))


def xirr_by_group(df, keys, date, amount, tolerance=1e-6, max_iterations=1000):
    """XIRR of every group of dated flows; flows of one day are summed first."""
    day = F.to_date(date)
    daily = df.groupBy(*keys, day.alias("day")).agg(F.sum(amount).alias("flow"))
    packed = daily.groupBy(*keys).agg(
        F.sort_array(F.collect_list(F.struct("day", "flow"))).alias("p"))
    flows = F.transform("p", lambda x: x["flow"])
    years = F.transform("p", lambda x: F.datediff(x["day"], F.col("p")[0]["day"]) / F.lit(365.0))
    return packed.select(
        *keys, solvers.xirr(flows, years, tolerance, max_iterations).alias("xirr"))


def _indexed(df, keys, order, amount):
    periods = df.groupBy(*keys, order).agg(F.sum(amount).alias("flow"))
    place = F.row_number().over(Window.partitionBy(*keys).orderBy(order)) - 1
    return periods.withColumn("i", place)


def mirr_by_group(df, keys, order, amount, finance_rate=0.05, reinvest_rate=0.05):
    flow, i = F.col("flow"), F.col("i")
    sums = _indexed(df, keys, order, amount).groupBy(*keys).agg(
        F.count("*").alias("n"),
        F.sum(F.when(flow < 0, flow / F.pow(F.lit(1 + finance_rate), i)).otherwise(0.0))
        .alias("pv"),
        F.sum(F.when(flow > 0, flow / F.pow(F.lit(1 + reinvest_rate), i)).otherwise(0.0))
        .alias("gain"),
    )
    span = F.col("n") - 1
    fv = F.col("gain") * F.pow(F.lit(1 + reinvest_rate), span)
    return sums.select(*keys, F.when(
        (F.col("pv") != 0) & (F.col("gain") != 0) & (span > 0),
        F.pow(fv / F.abs("pv"), F.lit(1.0) / span) - 1).alias("mirr"))


def npv_by_group(df, keys, order, amount, rate):
    return _indexed(df, keys, order, amount).groupBy(*keys).agg(
        F.sum(F.col("flow") / F.pow(F.lit(1.0 + rate), F.col("i"))).alias("npv"))
