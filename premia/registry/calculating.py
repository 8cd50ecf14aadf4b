"""Features, annual cash flows, rates and policy returns."""

from pyspark.sql import functions as F

from premia.functions import rates
from premia.functions.columns import prefix_category
from premia.operators import cashflows, clean, features, returns
from premia.registry import base
from premia.registry.base import CATEGORY_CASE, Query, define, define_rates
from premia.sources import views


def prefix_map(spark, sf_dir):
    customer = views.given(spark, sf_dir, "customer")
    return customer.select("c_custkey", prefix_category(
        F.col("c_mktsegment"), views.CATEGORIES, "其他").alias("product_category"))


def annual_premium(spark, sf_dir):
    return features.annual_premium(clean.clean_premium(views.premium(spark, sf_dir)))


def year_end_value(spark, sf_dir):
    return features.year_end_value(clean.clean_cash_value(views.cash_value(spark, sf_dir)))


def cashflow_without_dividend(spark, sf_dir):
    return features.cashflow_annual(
        clean.clean_premium(views.premium(spark, sf_dir)),
        clean.clean_cash_value(views.cash_value(spark, sf_dir)))


def product_summary(spark, sf_dir):
    return features.product_summary(base.policy_base(spark, sf_dir),
                                    base.cashflow(spark, sf_dir))


def policy_rollup(spark, sf_dir):
    return features.policy_rollup(base.cashflow(spark, sf_dir))


def analysis_wide(spark, sf_dir):
    return features.analysis_wide(base.policy_base(spark, sf_dir), base.cashflow(spark, sf_dir))


def flows(spark, sf_dir, kind="flows_with_dividend"):
    """(policy_id, i, flow) rows of the annual series."""
    series = cashflows.annual_series(base.cashflow(spark, sf_dir))
    return series.select("policy_id", F.posexplode(kind).alias("i", "flow"))


def _irr(kind):
    def build(spark, sf_dir):
        series = cashflows.annual_series(base.cashflow(spark, sf_dir))
        return series.select("policy_id", "periods",
                             cashflows.solvers.irr(F.col(kind)).alias("irr"))
    return build


def irr_batch(spark, sf_dir):
    ages = base.clean_policy(spark, sf_dir).select("policy_id", "insured_age")
    return cashflows.irr_by_group(flows(spark, sf_dir).join(ages, "policy_id"),
                                  ["insured_age"], "i", "flow")


def xirr(spark, sf_dir):
    premium = clean.clean_premium(views.premium(spark, sf_dir))
    value = clean.clean_cash_value(views.cash_value(spark, sf_dir))
    dividend = clean.clean_dividend(views.dividend(spark, sf_dir))
    last = value.groupBy("policy_id").agg(
        F.max(F.struct("valuation_date", "cash_value")).alias("last"))
    dated = (
        premium.select("policy_id", F.col("payment_date").alias("day"),
                       (-F.col("premium_amount")).alias("flow"))
        .unionByName(dividend.select("policy_id", F.col("dividend_date").alias("day"),
                                     F.col("dividend_amount").alias("flow")))
        .unionByName(last.select("policy_id", F.col("last.valuation_date").alias("day"),
                                 F.col("last.cash_value").alias("flow")))
    )
    found = cashflows.xirr_by_group(dated, ["policy_id"], "day", "flow")
    # Newton's method may end far out on a flat curve; the logarithm compares all rates alike
    return found.select("policy_id", F.log1p("xirr").alias("log_growth"))


def mirr(spark, sf_dir):
    return cashflows.mirr_by_group(flows(spark, sf_dir), ["policy_id"], "i", "flow")


def npv(spark, sf_dir):
    return cashflows.npv_by_group(flows(spark, sf_dir), ["policy_id"], "i", "flow", 0.05)


def _of_kind(kind):
    def build(spark, sf_dir):
        return returns.returns_of_kind(*base.wide_and_cashflow(spark, sf_dir), kind)
    return build


def settlement_rates(spark, sf_dir):
    """The discounts of a policy's order lines stand for its settlement rates."""
    lines, orders = (views.given(spark, sf_dir, t) for t in ("lineitem", "orders"))
    return lines.join(orders, lines.l_orderkey == orders.o_orderkey).select(
        F.col("o_custkey").cast("string").alias("policy_id"),
        F.col("l_discount").alias("settlement_rate"))


def universal_settlement(spark, sf_dir):
    return returns.returns_of_kind(*base.wide_and_cashflow(spark, sf_dir), "universal",
                                   settlement_rates=settlement_rates(spark, sf_dir))


def annualised(spark, sf_dir):
    rollup = features.policy_rollup(base.cashflow(spark, sf_dir))
    start, end = F.col("cumulative_premium"), F.col("latest_cash_value")
    years = F.col("observation_years")
    return rollup.select(
        "policy_id", rates.annual_return(start, end, years).alias("compound"),
        rates.annual_return(start, end, years, "simple").alias("simple"))


def policy_returns(spark, sf_dir):
    return returns.policy_returns(*base.wide_and_cashflow(spark, sf_dir))


YEARS = ("policy_id:s year:i premium_outflow:2 cash_value_eoy:2 dividend_amount:4 "
         "cumulative_premium:2 cumulative_dividend:4 net_cashflow:4")
BASE = ("policy_id:s product_code:s annual_premium:6 payment_term:6 sum_assured:2 insured_age:6 "
        "product_category:s ")
FEATURES = BASE + (
    "product_sub_type:s issue_year:i issue_month:i issue_quarter:i policy_duration_years:i "
    "expected_total_premium:6 coverage_premium_ratio:6 age_group:s coverage_group:s")
ROLLUP = ("total_premium_paid:2 cumulative_premium:2 total_dividend:4 cumulative_dividend:4 "
          "latest_cash_value:2 first_year:i latest_year:i observation_years:l")
VALUE = "absolute_return:2 total_return_rate:6 annual_return_rate:6"
SHARED = ("cv_absolute_return:2 cv_total_return_rate:6 cv_annual_return_rate:6 "
          "dividend_yield_total:6 dividend_yield_annual:6 total_total_value:4 "
          "total_absolute_return:4 total_total_return_rate:6 total_annual_return_rate:6")
ACCOUNT = "account_growth_rate:6 avg_settlement_rate:6 annual_account_return:6"

define("batch_flows", "flows clean_policy", """
  SELECT CAST(insured_age AS VARCHAR) AS policy_id, 'all' AS kind, i, sum(flow) AS flow
  FROM flows JOIN clean_policy USING (policy_id) WHERE kind = 'with_dividend'
  GROUP BY insured_age, i""")
define_rates("batch_", "batch_flows")
define("dated", "clean_premium clean_cash_value clean_dividend", """
  SELECT policy_id, day, sum(flow) AS flow FROM (
    SELECT policy_id, CAST(payment_date AS DATE) AS day, -premium_amount AS flow FROM clean_premium
    UNION ALL SELECT policy_id, CAST(dividend_date AS DATE), dividend_amount FROM clean_dividend
    UNION ALL (SELECT policy_id, CAST(valuation_date AS DATE), cash_value FROM clean_cash_value
      QUALIFY row_number() OVER (PARTITION BY policy_id
                                 ORDER BY valuation_date DESC, cash_value DESC) = 1))
  GROUP BY policy_id, day""")
define("newton", "dated", """
  SELECT policy_id, list(flow ORDER BY day) AS f,
    list((day - first_day) / 365.0 ORDER BY day) AS t, CAST(0.1 AS DOUBLE) AS g, false AS done,
    0 AS step
  FROM (SELECT *, min(day) OVER (PARTITION BY policy_id) AS first_day FROM dated)
  GROUP BY policy_id
  UNION ALL
  SELECT policy_id, f, t,
    CASE WHEN abs(d) < 1e-10 THEN g ELSE g - v / d END,
    abs(d) < 1e-10 OR abs(v / d) < 1e-6 OR d IS NULL, step + 1
  FROM (SELECT *, list_sum(list_transform(f, lambda x, j: x / pow(1 + g, t[j]))) AS v,
          -list_sum(list_transform(f, lambda x, j: x * t[j] / pow(1 + g, t[j] + 1))) AS d
        FROM (SELECT * REPLACE (CASE WHEN g > -1 THEN g END AS g)
              FROM newton WHERE NOT done AND step < 1000))""")

QUERIES = [
    Query("prefix_category", prefix_map, "c_custkey:l product_category:s",
          f"SELECT c_custkey, {CATEGORY_CASE.replace('product_code', 'c_mktsegment')} "
          "AS product_category FROM customer"),
    Query("policy_features", base.policy_base, FEATURES, "SELECT * FROM policy_base",
          "policy_base"),
    Query("annual_premium", annual_premium, "policy_id:s year:i premium_outflow:2",
          "SELECT * FROM annual_premium", "annual_premium"),
    Query("year_end_value", year_end_value, "policy_id:s year:i cash_value_eoy:2",
          "SELECT * FROM year_end_value", "year_end_value"),
    Query("cashflow_annual", base.cashflow, YEARS, "SELECT * FROM cashflow", "cashflow"),
    Query("cashflow_without_dividend", cashflow_without_dividend, YEARS, """
      SELECT * REPLACE (0 AS dividend_amount, 0 AS cumulative_dividend,
                        -premium_outflow AS net_cashflow) FROM cashflow""", "cashflow"),
    Query("product_summary", product_summary, BASE + (
        "cumulative_premium:2 cash_value_eoy:2 cumulative_dividend:4 year:i total_value:4 "
        "absolute_return:4"), """
      SELECT policy_base.*, latest.* EXCLUDE (policy_id),
        cash_value_eoy + cumulative_dividend AS total_value,
        cash_value_eoy + cumulative_dividend - cumulative_premium AS absolute_return
      FROM policy_base LEFT JOIN latest USING (policy_id)""", "policy_base latest"),
    Query("policy_rollup", policy_rollup, "policy_id:s " + ROLLUP, "SELECT * FROM rollup",
          "rollup"),
    Query("analysis_wide", analysis_wide, FEATURES + " " + ROLLUP + " total_account_value:4",
          "SELECT * FROM wide", "wide"),
    Query("irr_by_policy", _irr("flows"), "policy_id:s irr:6", """
      SELECT policy_id, irr FROM flow_lists LEFT JOIN irr USING (policy_id, kind)
      WHERE kind = 'plain'""", "flow_lists irr"),
    Query("irr_with_dividend", _irr("flows_with_dividend"), "policy_id:s irr:6", """
      SELECT policy_id, irr FROM flow_lists LEFT JOIN irr USING (policy_id, kind)
      WHERE kind = 'with_dividend'""", "flow_lists irr"),
    Query("irr_batch", irr_batch, "insured_age:6 irr:6", """
      SELECT policy_id AS insured_age, irr FROM batch_flow_lists
      LEFT JOIN batch_irr USING (policy_id, kind)""", "batch_flow_lists batch_irr"),
    Query("xirr", xirr, "policy_id:s log_growth:6", """
      SELECT policy_id, CASE WHEN g > -1 THEN ln(1 + g) END AS log_growth FROM newton
      QUALIFY row_number() OVER (PARTITION BY policy_id ORDER BY step DESC) = 1""", "newton"),
    Query("mirr", mirr, "policy_id:s mirr:6", """
      SELECT policy_id, CASE WHEN pv <> 0 AND fv <> 0 AND n > 1
        THEN pow(fv / abs(pv), 1.0 / (n - 1)) - 1 END AS mirr
      FROM (SELECT policy_id, count(*) AS n,
              sum(CASE WHEN flow < 0 THEN flow / pow(1.05, i) ELSE 0 END) AS pv,
              sum(CASE WHEN flow > 0 THEN flow * pow(1.05, m - 1 - i) ELSE 0 END) AS fv
            FROM (SELECT *, count(*) OVER (PARTITION BY policy_id) AS m FROM flows
                  WHERE kind = 'with_dividend') GROUP BY policy_id)""", "flows"),
    Query("npv", npv, "policy_id:s npv:2", """
      SELECT policy_id, sum(flow / pow(1.05, i)) AS npv FROM flows
      WHERE kind = 'with_dividend' GROUP BY policy_id""", "flows"),
    Query("annualised_return", annualised, "policy_id:s compound:6 simple:6", """
      SELECT policy_id, CASE WHEN p > 0 THEN pow(v / p, 1.0 / y) - 1 END AS compound,
        CASE WHEN p > 0 THEN (v - p) / p / y END AS simple
      FROM (SELECT policy_id, nullif(cumulative_premium, 0) AS p, latest_cash_value AS v,
              observation_years AS y FROM rollup)""", "rollup"),
    Query("returns_traditional", _of_kind("traditional"), f"policy_id:s irr:6 {VALUE}",
          "SELECT * FROM returns WHERE kind = 'traditional'", "returns"),
    Query("returns_participating", _of_kind("participating"), f"policy_id:s irr:6 {SHARED}",
          "SELECT * FROM returns WHERE kind = 'participating'", "returns"),
    Query("returns_universal", _of_kind("universal"), f"policy_id:s irr:6 {ACCOUNT}",
          "SELECT * FROM returns WHERE kind = 'universal'", "returns"),
    Query("returns_universal_settlement", universal_settlement,
          "policy_id:s avg_settlement_rate:6", """
      SELECT policy_id, CASE WHEN account_growth_rate IS NOT NULL THEN rate
        END AS avg_settlement_rate
      FROM returns LEFT JOIN (SELECT CAST(o_custkey AS VARCHAR) AS policy_id,
          avg(l_discount) AS rate
        FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY o_custkey)
        USING (policy_id)
      WHERE kind = 'universal'""", "returns"),
    Query("returns_linked", _of_kind("linked"),
          "policy_id:s irr:6 nav_growth_rate:6 total_return_rate:6 annual_return_rate:6",
          "SELECT * FROM returns WHERE kind = 'linked'", "returns"),
    Query("policy_returns", policy_returns,
          f"policy_id:s product_category:s issue_year:i {ROLLUP} total_account_value:4 irr:6 "
          f"{VALUE} {SHARED} {ACCOUNT} nav_growth_rate:6", "SELECT * FROM returns", "returns"),
]
