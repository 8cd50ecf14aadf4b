"""The stages of a full run: extract, transform, calculate, analyze, validate, test, report.

Every stage returns lazy tables by name. Only the annual cash flows and the policy returns are
stored on the way, as each feeds several later tables.
"""

from premia import schemas
from premia.operators import (
    aggregates, clean, correlation, features, hypothesis, quality, regression, report, trends,
)
from premia.operators.returns import policy_returns
from premia.sources.tables import load_tables, write_tables
from premia.storage import store


def extract(spark, base, file_format=None):
    """The source tables that exist under ``base``."""
    return load_tables(spark, base, file_format=file_format)


def transform(tables, as_of_year, categories=schemas.PRODUCT_CATEGORIES, min_premium=1000,
              output=None):
    """Clean tables, policy features, annual cash flows, wide table and product summary."""
    policy = features.policy_features(
        clean.clean_policy(tables["policy"], min_premium), as_of_year, categories)
    dividend = tables.get("dividend")
    cashflow = store(features.cashflow_annual(
        clean.clean_premium(tables["premium"]),
        clean.clean_cash_value(tables["cash_value"], distinct=False),
        None if dividend is None else clean.clean_dividend(dividend)), "cashflow")
    result = {
        "policy_base": policy,
        "cashflow_annual": cashflow,
        "product_summary": features.product_summary(policy, cashflow),
        "analysis_wide": features.analysis_wide(policy, cashflow),
    }
    if output is not None:
        write_tables(result, output)
    return result


def calculate(processed, method="compound", output=None):
    """Returns of all policies, stored; ``output`` also writes them as CSV."""
    returns = store(policy_returns(
        processed["analysis_wide"], processed["cashflow_annual"], method), "returns")
    if output is not None:
        write_tables({"policies_with_returns": returns}, output, "csv")
    return returns


def analyze(returns, percentiles=schemas.DEFAULT_PERCENTILES):
    return {
        "by_product": aggregates.by_product(returns, percentiles=percentiles),
        "by_year": aggregates.by_year(returns),
        "by_category_year": aggregates.by_category_year(returns),
        "trends": trends.category_trends(returns),
        "summary": aggregates.summary_statistics(returns),
    }


def validate(returns):
    """Metrics of the calculated policy table and its acceptance record."""
    metrics = quality.validate_table(returns, "policy")
    none = returns.sparkSession.createDataFrame(
        [], "table string, orphan_count long, sample_ids array<string>")
    return {"validation": metrics,
            "quality_report": quality.acceptance(quality.validation_summary(metrics, none))}


def statistics(returns, order=("policy_id",)):
    return {
        "ttest_irr_by_category": hypothesis.ttest(returns, "irr", "product_category"),
        "correlation_irr_premium": correlation.pearson(returns, "irr", "annual_premium"),
        "regression_irr_premium": regression.simple_ols(
            returns, "annual_premium", "irr", order=list(order)),
    }


def reports(returns, analysis, output=None, file_format="parquet"):
    """Report tables; ``output`` writes one folder per table."""
    result = report.summary_tables(returns, analysis["by_product"])
    result["by_year"] = analysis["by_year"]
    result["category_trends"] = report.category_trend_table(analysis["trends"])
    if output is not None:
        write_tables(result, output, file_format)
    return result


def full_run(tables, as_of_year, categories=schemas.PRODUCT_CATEGORIES, output=None):
    """All stages over the given tables; the result tables by stage and name."""
    if "policy" not in tables:
        raise ValueError("the policy table is missing")
    out = (lambda name: None) if output is None else (lambda name: f"{output}/{name}")
    processed = transform(tables, as_of_year, categories, output=out("processed"))
    returns = calculate(processed, output=out("processed"))
    analysis = analyze(returns)
    return {
        "processed": processed, "returns": returns, "analysis": analysis,
        "validation": validate(returns), "statistics": statistics(returns),
        "reports": reports(returns, analysis, output=out("reports")),
    }
