"""Return measures of every policy, by product type."""

from pyspark.sql import functions as F

from premia.functions import rates, solvers
from premia.operators.cashflows import annual_series

MEASURES = [
    "irr", "absolute_return", "total_return_rate", "annual_return_rate",
    "cv_absolute_return", "cv_total_return_rate", "cv_annual_return_rate",
    "dividend_yield_total", "dividend_yield_annual",
    "total_total_value", "total_absolute_return", "total_total_return_rate",
    "total_annual_return_rate",
    "account_growth_rate", "avg_settlement_rate", "annual_account_return", "nav_growth_rate",
]


def product_type(category):
    """participating, universal, linked or traditional, from the category name."""
    return (F.when(category.contains("分红"), "participating")
            .when(category.contains("万能"), "universal")
            .when(category.contains("投连"), "linked")
            .otherwise("traditional"))


def policy_returns(policies, cashflow, method="compound", settlement_rates=None):
    """All policies with the measures of their product type; the others stay NULL.

    ``policies`` is the wide table (cumulative premium and dividend, latest value, years).
    ``settlement_rates`` may give (policy_id, settlement_rate) rows of universal-life policies.
    """
    df = policies.join(annual_series(cashflow), "policy_id", "left")
    mean_rate = None
    if settlement_rates is not None:
        mean = settlement_rates.groupBy("policy_id").agg(
            F.avg("settlement_rate").alias("mean_settlement_rate"))
        df, mean_rate = df.join(mean, "policy_id", "left"), F.col("mean_settlement_rate")
    kind = product_type(F.coalesce("product_category", F.lit("")))
    premium, years = F.col("cumulative_premium"), F.col("observation_years")
    cash, dividend = F.col("latest_cash_value"), F.col("cumulative_dividend")
    first = F.coalesce("first_value", F.lit(0.0))
    two_years = F.col("periods") >= 2
    one = F.lit(1.0)

    by_kind = {
        "traditional": rates.value_return(premium, cash, years, method),
        "participating": (
            {f"cv_{k}": v for k, v in rates.value_return(premium, cash, years, method).items()}
            | rates.dividend_return(premium, dividend, years)
            | {f"total_{k}": v for k, v in rates.comprehensive_return(
                premium, cash, dividend, years, method).items()}
        ),
        "universal": rates.universal_life_return(first, cash, years, mean_rate, method),
        "linked": {
            k: F.when(two_years, v) for k, v in rates.investment_linked_return(
                one, first, one, F.col("last_value"), years, method).items()
        },
    }
    columns = {"irr": F.col("irr")}
    for name in MEASURES[1:]:
        branch = None
        for product, measures in by_kind.items():
            if name in measures:
                here = F.col("product_kind") == product
                branch = (F.when(here, measures[name]) if branch is None
                          else branch.when(here, measures[name]))
        columns[name] = branch
    flows = F.when(F.col("product_kind") == "participating", F.col("flows_with_dividend")
                   ).otherwise(F.col("flows"))
    kept = [c for c in policies.columns if c not in MEASURES]
    return (
        df.withColumn("product_kind", kind)
        .withColumn("irr", solvers.irr(flows))
        .select(*kept, *[col.alias(name) for name, col in columns.items()])
    )


def returns_of_kind(policies, cashflow, kind, method="compound", settlement_rates=None):
    """The measures of one product type for the policies of that type."""
    chosen = policies.where(
        product_type(F.coalesce("product_category", F.lit(""))) == kind)
    return policy_returns(chosen, cashflow, method, settlement_rates)
