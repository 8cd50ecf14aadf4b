"""Query records, result typing shared by both sides, and the SQL of the common tables."""

from dataclasses import dataclass
from collections.abc import Callable

from pyspark.sql import functions as F

from premia.operators import clean, features
from premia.operators.returns import policy_returns
from premia.sources import views
from premia.storage import store

_SPARK = {"s": "string", "l": "bigint", "i": "int", "b": "boolean", "t": "timestamp_ntz"}
_SQL = {"s": "VARCHAR", "l": "BIGINT", "i": "INTEGER", "b": "BOOLEAN", "t": "TIMESTAMP"}


@dataclass
class Query:
    """A named query. ``columns`` lists "name:kind"; a digit as kind rounds a double."""

    name: str
    build: Callable
    columns: str
    body: str | None = None
    tables: str = ""

    def run(self, spark, sf_dir):
        return self.build(spark, sf_dir).select(*[
            (F.round(F.col(name).cast("double"), int(kind)) + 0.0 if kind.isdigit()
             else F.col(name).cast(_SPARK[kind])).alias(name)
            for name, kind in self._columns()])

    def sql(self):
        if self.body is None:
            return None
        picked = ", ".join(
            f'round(CAST("{name}" AS DOUBLE), {kind}) + 0.0 AS "{name}"' if kind.isdigit()
            else f'CAST("{name}" AS {_SQL[kind]}) AS "{name}"' for name, kind in self._columns())
        parts = [f"{name} AS ({CTE[name]})" for name in _needed(self.tables.split())]
        parts.append(f"result_rows AS ({self.body})")
        return f"WITH RECURSIVE {', '.join(parts)} SELECT {picked} FROM result_rows"

    def _columns(self):
        return [item.rsplit(":", 1) for item in self.columns.split()]


# Spark side of the common tables -----------------------------------------------------------

def stored_policy(spark, sf_dir):
    return store(views.policy(spark, sf_dir), "policy")


def clean_policy(spark, sf_dir):
    return clean.clean_policy(stored_policy(spark, sf_dir))


def policy_base(spark, sf_dir):
    return features.policy_features(clean_policy(spark, sf_dir), views.AS_OF_YEAR,
                                    views.CATEGORIES)


def cashflow(spark, sf_dir):
    return features.cashflow_annual(
        clean.clean_premium(views.premium(spark, sf_dir)),
        clean.clean_cash_value(views.cash_value(spark, sf_dir), distinct=False),
        clean.clean_dividend(views.dividend(spark, sf_dir)))


def wide_and_cashflow(spark, sf_dir):
    flows = store(cashflow(spark, sf_dir), "cashflow")
    return features.analysis_wide(policy_base(spark, sf_dir), flows), flows


_stored_returns = {}


def returns(spark, sf_dir):
    """Returns of all policies, stored once per application and data folder.

    The analysis queries start from the output of the calculate stage, as they do in a full
    run; ``policy_returns`` and ``full_run`` compute everything anew.
    """
    key = (spark.sparkContext.applicationId, sf_dir)
    if key not in _stored_returns:
        _stored_returns[key] = store(policy_returns(*wide_and_cashflow(spark, sf_dir)), "returns")
    return _stored_returns[key]


# SQL side ----------------------------------------------------------------------------------

LINES = ("SELECT CAST(o_custkey AS VARCHAR) AS policy_id, l.* FROM lineitem l "
         "JOIN orders ON l_orderkey = o_orderkey")

CTE = {}
_USES = {}


def define(name, uses, text):
    CTE[name], _USES[name] = text, uses.split()


def _needed(names):
    order = []

    def visit(name):
        for used in _USES[name]:
            visit(used)
        if name not in order:
            order.append(name)

    for name in names:
        visit(name)
    return order


define("policy", "", """
  SELECT CAST(c_custkey AS VARCHAR) AS policy_id, c_mktsegment AS product_code, issue_date,
    annual_premium, payment_term, sum_assured,
    CAST(18 + floor((c_acctbal + 1000) / 200) AS INTEGER) AS insured_age, n_name AS region,
    CASE WHEN c_acctbal < 0 THEN ' lapsed ' ELSE ' active ' END AS policy_status
  FROM customer LEFT JOIN nation ON c_nationkey = n_nationkey
  LEFT JOIN (SELECT o_custkey, min(o_orderdate) AS issue_date, avg(o_totalprice) AS annual_premium,
      count(DISTINCT year(o_orderdate)) AS payment_term, sum(o_totalprice) AS sum_assured
    FROM orders GROUP BY o_custkey) r ON c_custkey = o_custkey""")
define("premium", "", """
  SELECT CAST(o_custkey AS VARCHAR) AS policy_id, o_orderdate AS payment_date,
    o_totalprice AS premium_amount FROM orders""")
define("cash_value", "", f"""
  SELECT policy_id, l_shipdate AS valuation_date, l_extendedprice * l_quantity AS cash_value
  FROM ({LINES})""")
define("dividend", "", f"""
  SELECT policy_id, l_shipdate AS dividend_date, l_extendedprice * l_discount AS dividend_amount
  FROM ({LINES}) WHERE l_returnflag = 'R'""")
define("status_policy", "policy", """
  SELECT * REPLACE (trim(upper(policy_status)) AS policy_status)
  FROM (SELECT DISTINCT * FROM policy)
  WHERE trim(upper(policy_status)) IN ('ACTIVE', 'INFORCE', 'PAID_UP', 'MATURED')""")


def sql_mode(table, column):
    return (f"(SELECT {column} FROM {table} WHERE {column} IS NOT NULL GROUP BY {column} "
            f"ORDER BY count(*) DESC, {column} LIMIT 1)")


define("clean_policy", "status_policy", f"""
  SELECT * FROM (SELECT policy_id,
    coalesce(product_code, {sql_mode('status_policy', 'product_code')}) AS product_code,
    issue_date,
    coalesce(annual_premium, (SELECT median(annual_premium) FROM status_policy)) AS annual_premium,
    coalesce(payment_term, (SELECT median(payment_term) FROM status_policy)) AS payment_term,
    coalesce(sum_assured, (SELECT median(sum_assured) FROM status_policy)) AS sum_assured,
    coalesce(insured_age, (SELECT median(insured_age) FROM status_policy)) AS insured_age,
    coalesce(region, {sql_mode('status_policy', 'region')}) AS region, policy_status
    FROM status_policy)
  WHERE annual_premium >= 1000 AND insured_age BETWEEN 0 AND 120""")
define("clean_premium", "premium", """
  SELECT * FROM (SELECT DISTINCT * FROM premium) WHERE premium_amount > 0 AND premium_amount <=
    10 * (SELECT quantile_cont(premium_amount, 0.99) FROM (SELECT DISTINCT * FROM premium)
          WHERE premium_amount > 0)""")
define("clean_cash_value", "cash_value", """
  SELECT policy_id, valuation_date, greatest(coalesce(cash_value, 0), 0) AS cash_value
  FROM (SELECT DISTINCT * FROM cash_value)""")
define("clean_dividend", "dividend", """
  SELECT policy_id, dividend_date, greatest(coalesce(dividend_amount, 0), 0) AS dividend_amount
  FROM (SELECT DISTINCT * FROM dividend)""")
define("annual_premium", "clean_premium", """
  SELECT policy_id, year(payment_date) AS year, sum(premium_amount) AS premium_outflow
  FROM clean_premium GROUP BY ALL""")
define("year_end_value", "clean_cash_value", """
  SELECT policy_id, year, cash_value AS cash_value_eoy FROM (
    SELECT policy_id, year(valuation_date) AS year, cash_value, row_number() OVER (
      PARTITION BY policy_id, year(valuation_date)
      ORDER BY valuation_date DESC, cash_value DESC) AS k FROM clean_cash_value) WHERE k = 1""")
define("annual_dividend", "clean_dividend", """
  SELECT policy_id, year(dividend_date) AS year, sum(dividend_amount) AS dividend_amount
  FROM clean_dividend GROUP BY ALL""")
define("joined_years", "annual_premium year_end_value annual_dividend", """
  SELECT policy_id, year, coalesce(premium_outflow, 0) AS premium_outflow, cash_value_eoy,
    coalesce(dividend_amount, 0) AS dividend_amount
  FROM annual_premium FULL JOIN year_end_value USING (policy_id, year)
  LEFT JOIN annual_dividend USING (policy_id, year)""")
define("cashflow", "joined_years", """
  SELECT policy_id, year, premium_outflow,
    coalesce(last_value(cash_value_eoy IGNORE NULLS) OVER past, 0) AS cash_value_eoy,
    dividend_amount, sum(premium_outflow) OVER past AS cumulative_premium,
    sum(dividend_amount) OVER past AS cumulative_dividend,
    dividend_amount - premium_outflow AS net_cashflow
  FROM joined_years
  WINDOW past AS (PARTITION BY policy_id ORDER BY year
                  ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)""")

CATEGORY_CASE = """CASE WHEN product_code LIKE 'AUTO%' THEN '传统寿险'
  WHEN product_code LIKE 'BUILD%' THEN '分红型寿险' WHEN product_code LIKE 'FURN%' THEN '万能险'
  WHEN product_code LIKE 'HOUSE%' THEN '投连险' ELSE '其他' END"""

define("policy_base", "clean_policy", f"""
  SELECT *, {CATEGORY_CASE} AS product_category, {CATEGORY_CASE} AS product_sub_type,
    year(issue_date) AS issue_year, month(issue_date) AS issue_month,
    quarter(issue_date) AS issue_quarter,
    2002 - year(issue_date) AS policy_duration_years,
    annual_premium * payment_term AS expected_total_premium,
    sum_assured / nullif(annual_premium, 0) AS coverage_premium_ratio,
    CASE WHEN insured_age <= 0 THEN NULL WHEN insured_age <= 30 THEN '18-30'
      WHEN insured_age <= 40 THEN '31-40' WHEN insured_age <= 50 THEN '41-50'
      WHEN insured_age <= 60 THEN '51-60' WHEN insured_age <= 100 THEN '60+' END AS age_group,
    CASE WHEN sum_assured <= 0 THEN NULL WHEN sum_assured <= 100000 THEN '<10万'
      WHEN sum_assured <= 500000 THEN '10-50万' WHEN sum_assured <= 1000000 THEN '50-100万'
      WHEN sum_assured <= 5000000 THEN '100-500万' ELSE '500万+' END AS coverage_group
  FROM clean_policy""")
define("latest", "cashflow", """
  SELECT policy_id, cumulative_premium, cash_value_eoy, cumulative_dividend, year
  FROM cashflow QUALIFY row_number() OVER (PARTITION BY policy_id ORDER BY year DESC) = 1""")
define("rollup", "cashflow", """
  SELECT policy_id, sum(premium_outflow) AS total_premium_paid,
    max(cumulative_premium) AS cumulative_premium, sum(dividend_amount) AS total_dividend,
    max(cumulative_dividend) AS cumulative_dividend,
    arg_max(cash_value_eoy, year) AS latest_cash_value, arg_min(cash_value_eoy, year) AS first_value,
    min(year) AS first_year, max(year) AS latest_year, count(year) AS observation_years
  FROM cashflow GROUP BY policy_id""")
define("wide", "policy_base rollup", """
  SELECT policy_base.*, rollup.* EXCLUDE (policy_id),
    coalesce(latest_cash_value, 0) + coalesce(cumulative_dividend, 0) AS total_account_value
  FROM policy_base LEFT JOIN rollup USING (policy_id)""")

# Flow series by policy and kind; i counts years from 0.
define("flows", "cashflow", """
  SELECT policy_id, kind, i, -premium_outflow + CASE WHEN kind = 'with_dividend'
      THEN dividend_amount ELSE 0 END + CASE WHEN i = n - 1 THEN cash_value_eoy ELSE 0 END AS flow
  FROM (SELECT *, row_number() OVER (PARTITION BY policy_id ORDER BY year) - 1 AS i,
          count(*) OVER (PARTITION BY policy_id) AS n FROM cashflow),
       (VALUES ('plain'), ('with_dividend')) kinds(kind)""")


def define_rates(prefix, source):
    """Tables that end in {prefix}irr (policy_id, kind, irr) from rows (policy_id, kind, i, flow).

    Sign changes of the present value on a grid of log growth rates from -12 to 12, each then
    halved 50 times; the rate nearest zero counts.
    """
    define(f"{prefix}grid", source, f"""
      SELECT policy_id, kind, k, sum(flow * exp(-i * k * 0.02)) AS v
      FROM {source}, range(-600, 601) steps(k) GROUP BY policy_id, kind, k""")
    define(f"{prefix}cells", f"{prefix}grid", f"""
      SELECT policy_id, kind, k, v FROM (SELECT *, lead(v) OVER (
          PARTITION BY policy_id, kind ORDER BY k) AS next FROM {prefix}grid)
      WHERE v = 0 AND next <> 0 OR sign(v) * sign(next) < 0""")
    define(f"{prefix}flow_lists", source, f"""
      SELECT policy_id, kind, list(flow ORDER BY i) AS f FROM {source} GROUP BY policy_id, kind""")
    define(f"{prefix}halving", f"{prefix}cells {prefix}flow_lists", f"""
      SELECT policy_id, kind, f, k * CAST(0.02 AS DOUBLE) AS lo,
        CASE WHEN v = 0 THEN k ELSE k + 1 END * CAST(0.02 AS DOUBLE) AS hi, sign(v) AS s, 0 AS step
      FROM {prefix}cells JOIN {prefix}flow_lists USING (policy_id, kind)
      UNION ALL
      SELECT policy_id, kind, f, CASE WHEN same THEN mid ELSE lo END,
        CASE WHEN same THEN hi ELSE mid END, s, step + 1
      FROM (SELECT *, (lo + hi) / 2 AS mid, sign(list_sum(list_transform(f,
              lambda x, j: x * exp(-(j - 1) * (lo + hi) / 2)))) = s AS same
            FROM {prefix}halving WHERE step < 50)""")
    define(f"{prefix}irr", f"{prefix}halving", f"""
      SELECT policy_id, kind, arg_min(r, abs(r)) AS irr
      FROM (SELECT policy_id, kind, exp((lo + hi) / 2) - 1 AS r FROM {prefix}halving
            WHERE step = 50) GROUP BY policy_id, kind""")


define_rates("", "flows")
define("measures", "wide irr", """
  SELECT w.* EXCLUDE (first_value), irr,
    CASE kind WHEN 'traditional' THEN latest_cash_value - paid END AS absolute_return,
    CASE kind WHEN 'traditional' THEN (latest_cash_value - paid) / paid
      WHEN 'linked' THEN growth END AS total_return_rate,
    CASE kind WHEN 'traditional' THEN pow(latest_cash_value / paid, 1.0 / y) - 1
      WHEN 'linked' THEN yearly_growth END AS annual_return_rate,
    CASE kind WHEN 'participating' THEN latest_cash_value - paid END AS cv_absolute_return,
    CASE kind WHEN 'participating' THEN (latest_cash_value - paid) / paid
      END AS cv_total_return_rate,
    CASE kind WHEN 'participating' THEN pow(latest_cash_value / paid, 1.0 / y) - 1
      END AS cv_annual_return_rate,
    CASE kind WHEN 'participating' THEN cumulative_dividend / paid END AS dividend_yield_total,
    CASE kind WHEN 'participating' THEN cumulative_dividend / paid / y END AS dividend_yield_annual,
    CASE kind WHEN 'participating' THEN latest_cash_value + cumulative_dividend
      END AS total_total_value,
    CASE kind WHEN 'participating' THEN latest_cash_value + cumulative_dividend - paid
      END AS total_absolute_return,
    CASE kind WHEN 'participating' THEN (latest_cash_value + cumulative_dividend - paid) / paid
      END AS total_total_return_rate,
    CASE kind WHEN 'participating' THEN
      pow((latest_cash_value + cumulative_dividend) / paid, 1.0 / y) - 1
      END AS total_annual_return_rate,
    CASE kind WHEN 'universal' THEN universal_growth END AS account_growth_rate,
    CAST(NULL AS DOUBLE) AS avg_settlement_rate,
    CASE kind WHEN 'universal' THEN universal_yearly END AS annual_account_return,
    CASE kind WHEN 'linked' THEN growth END AS nav_growth_rate
  FROM (SELECT *, CASE WHEN observation_years >= 2 THEN universal_growth END AS growth,
          CASE WHEN observation_years >= 2 THEN universal_yearly END AS yearly_growth
        FROM (SELECT *, CASE WHEN start > 0 THEN (latest_cash_value - start) / start
                END AS universal_growth,
              CASE WHEN start > 0 THEN pow(latest_cash_value / start, 1.0 / y) - 1
                END AS universal_yearly
              FROM (SELECT *, nullif(greatest(cumulative_premium, 0), 0) AS paid,
                      nullif(observation_years, 0) AS y, coalesce(first_value, 0) AS start,
                      CASE WHEN product_category LIKE '%分红%' THEN 'participating'
                        WHEN product_category LIKE '%万能%' THEN 'universal'
                        WHEN product_category LIKE '%投连%' THEN 'linked'
                        ELSE 'traditional' END AS kind FROM wide))) w
  LEFT JOIN (SELECT policy_id, kind AS flow_kind, irr FROM irr) rate
    ON w.policy_id = rate.policy_id
    AND flow_kind = CASE WHEN w.kind = 'participating' THEN 'with_dividend' ELSE 'plain' END""")
define("returns", "measures", "SELECT * EXCLUDE (paid, y, start, growth, yearly_growth, "
       "universal_growth, universal_yearly) FROM measures")


def sql_beta(theta, a, b):
    """I_x(a, b) with x = cos^2(theta), by Simpson's rule over the angle.

    The integrand has vanished 16 widths 1 / sqrt(2 a) past its start or at pi / 2.
    """
    step = f"(least(pi() / 2 - {theta}, 16 / sqrt(2 * {a})) / 4000)"
    return (f"(2 * exp(lgamma({a} + {b}) - lgamma({a}) - lgamma({b})) * {step} / 3 * "
            f"list_sum(list_transform(range(0, 4001), lambda k: "
            f"CASE WHEN k = 0 OR k = 4000 THEN 1 WHEN k % 2 = 1 THEN 4 ELSE 2 END * "
            f"pow(cos({theta} + k * {step}), 2 * {a} - 1) * "
            f"pow(sin({theta} + k * {step}), 2 * {b} - 1))))")


def sql_t_p(t, df):
    return sql_beta(f"atan(abs({t}) / sqrt({df}))", f"(({df}) / 2.0)", "0.5")


def sql_f_p(f, df1, df2):
    return sql_beta(f"atan(sqrt(({df1}) * {f} / ({df2})))", f"(({df2}) / 2.0)",
                    f"(({df1}) / 2.0)")
