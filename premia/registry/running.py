"""Whole runs over the policy model."""

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from premia.plans import stages
from premia.registry import base
from premia.registry.base import Query
from premia.registry.calculating import FEATURES, ROLLUP
from premia.registry.grouping import ALL, METRICS, measures
from premia.registry.statistics import PAIR, TTEST, sql_pair, sql_ttest
from premia.sources import views
from premia.storage import store


def _tables(spark, sf_dir):
    return views.tables(spark, sf_dir) | {"policy": base.stored_policy(spark, sf_dir)}


def full_run(spark, sf_dir):
    return stages.full_run(_tables(spark, sf_dir), views.AS_OF_YEAR, views.CATEGORIES)[
        "analysis"]["by_category_year"]


def full_run_tables(spark, sf_dir):
    """Every table of every stage of one run, each computed in full: (stage, name, rows,
    checksum), the checksum an exclusive or of the hashes of all columns of all rows."""
    found = stages.full_run(_tables(spark, sf_dir), views.AS_OF_YEAR, views.CATEGORIES)
    named = [(stage, name, df) for stage, tables in found.items() if isinstance(tables, dict)
             for name, df in tables.items()] + [("calculate", "returns", found["returns"])]
    counts = []
    for stage, name, df in named:
        # Each table is written once to the shared folder (a job of its own, so no plan holds
        # the whole run) and read back; the manifest row is a checksum of all its columns of
        # every row, so each column is computed, none pruned away.
        written = store(df, f"run-{stage}-{name}")
        content = F.xxhash64(*[F.col(f"`{c}`") for c in written.columns])
        counts.append(written.select(content.alias("content")).agg(
            F.lit(stage).alias("stage"), F.lit(name).alias("name"),
            F.count("content").alias("rows"), F.bit_xor("content").alias("checksum")))
    return reduce(DataFrame.unionByName, counts)


def transform_stage(spark, sf_dir):
    return stages.transform(_tables(spark, sf_dir), views.AS_OF_YEAR, views.CATEGORIES)[
        "analysis_wide"]


def analyze_stage(spark, sf_dir):
    return stages.analyze(base.returns(spark, sf_dir))["by_product"]


def validate_stage(spark, sf_dir):
    return stages.validate(base.returns(spark, sf_dir))["quality_report"]


def _tests(name):
    return lambda spark, sf_dir: stages.statistics(base.returns(spark, sf_dir))[name]


def report_stage(spark, sf_dir):
    found = base.returns(spark, sf_dir)
    return stages.reports(found, stages.analyze(found))["by_year"]


YEAR_STATS = ["count", "mean", "median"]
KINDS, SQL = measures(METRICS[:2], YEAR_STATS)
PRODUCT_KINDS, PRODUCT_SQL = measures(METRICS, ALL)

QUERIES = [
    Query("full_run", full_run, f"product_category:s issue_year:i {KINDS}",
          f"SELECT product_category, issue_year, {SQL} FROM returns GROUP BY ALL", "returns"),
    Query("full_run_tables", full_run_tables, "stage:s name:s rows:l checksum:l"),
    Query("transform_stage", transform_stage, f"{FEATURES} {ROLLUP} total_account_value:4",
          "SELECT * FROM wide", "wide"),
    Query("analyze_stage", analyze_stage, f"product_category:s {PRODUCT_KINDS}",
          f"SELECT product_category, {PRODUCT_SQL} FROM returns GROUP BY ALL", "returns"),
    Query("validate_stage", validate_stage,
          "overall_quality_score:4 is_acceptable:b critical_issues_count:l warnings_count:l "
          "tables_validated:l recommendation:s"),
    Query("statistics_ttest", _tests("ttest_irr_by_category"), TTEST,
          sql_ttest("returns", "irr", "product_category"), "returns"),
    Query("statistics_correlation", _tests("correlation_irr_premium"), PAIR,
          sql_pair("returns", "irr", "annual_premium"), "returns"),
    Query("report_stage", report_stage, f"issue_year:i {KINDS}",
          f"SELECT issue_year, {SQL} FROM returns GROUP BY ALL", "returns"),
]
