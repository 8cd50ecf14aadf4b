"""Return rates as Column expressions over premium, value and holding years."""

from pyspark.sql import functions as F


def annual_return(initial, final, years, method="compound"):
    if method == "compound":
        rate = F.pow(final / initial, F.lit(1.0) / years) - 1
    else:
        rate = (final - initial) / initial / years
    return F.when((initial > 0) & (years > 0), rate)


def _finite(col):
    return F.when(~F.isnan(col), col)


def value_return(premium, value, years, method="compound"):
    """Absolute, total and annual return of a final value over the premium paid."""
    held = (premium > 0) & (years > 0)
    return {
        "absolute_return": F.when(held, value - premium),
        "total_return_rate": F.when(held, (value - premium) / premium),
        "annual_return_rate": _finite(annual_return(premium, value, years, method)),
    }


def dividend_return(premium, dividend, years):
    total = F.when(premium > 0, dividend / premium)
    return {
        "dividend_yield_total": total,
        "dividend_yield_annual": F.when(years > 0, total / years),
    }


def universal_life_return(initial, final, years, mean_settlement_rate=None, method="compound"):
    held = (initial > 0) & (years > 0)
    rate = F.lit(None).cast("double") if mean_settlement_rate is None else mean_settlement_rate
    return {
        "account_growth_rate": F.when(held, (final - initial) / initial),
        "avg_settlement_rate": F.when(held, rate),
        "annual_account_return": _finite(annual_return(initial, final, years, method)),
    }


def investment_linked_return(units0, nav0, units1, nav1, years, method="compound"):
    initial, final = units0 * nav0, units1 * nav1
    held = (initial > 0) & (years > 0)
    return {
        "nav_growth_rate": F.when(held, (nav1 - nav0) / nav0),
        "total_return_rate": F.when(held, (final - initial) / initial),
        "annual_return_rate": _finite(annual_return(initial, final, years, method)),
    }


def comprehensive_return(premium, cash_value, dividend, years, method="compound"):
    total = cash_value + dividend
    return {"total_value": total, **value_return(premium, total, years, method)}
