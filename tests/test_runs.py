"""Sources, sinks, whole runs, and registered queries against their SQL."""

import math
import os
from pathlib import Path

import duckdb
import pytest
from pyspark.sql import functions as F

from __spark_entry__ import entry, oracle_sql, queries
from premia import schemas
from premia.plans import stages
from premia.sources import tables, views
from premia.storage import release, shared_dir, store

SF_DIR = "/root/testdata/sf0.001"
# One query per kind of work; set PREMIA_ALL_QUERIES to compare all of them.
SAMPLE = [
    "scan_project_filter_limit", "scan_by_period", "csv_round_trip", "parquet_round_trip",
    "load_tables", "list_tables", "coerce_types", "impute_median_zero",
    "impute_mode", "clean_policy", "cleaning_audit", "cashflow_annual", "irr_with_dividend",
    "xirr", "mirr", "policy_returns", "agg_by_product_selection", "top_n_per_group",
    "category_trends", "compare_periods", "iqr_outliers_selection", "quality_score", "anova",
    "spearman_lines", "simple_ols", "multiple_ols", "box_stats", "report_summary_long",
]


@pytest.fixture(scope="module")
def duck():
    connection = duckdb.connect()
    for file in Path(SF_DIR).glob("*.parquet"):
        connection.sql(f"CREATE VIEW {file.stem} AS SELECT * FROM '{file}'")
    return connection


def _sorted(rows):
    return sorted(rows, key=lambda row: [(v is None, str(v)) for v in row])


@pytest.mark.parametrize("name", sorted(oracle_sql()) if os.environ.get("PREMIA_ALL_QUERIES")
                         else SAMPLE)
def test_query_equals_sql(spark, duck, name):
    df = queries()[name](spark, SF_DIR)
    columns = sorted(df.columns)
    relation = duck.sql(oracle_sql()[name])
    assert sorted(relation.columns) == columns
    places = [relation.columns.index(c) for c in columns]
    expected = _sorted([tuple(row[i] for i in places) for row in relation.fetchall()])
    found = _sorted([tuple(row) for row in df.select(*columns).collect()])
    assert len(found) == len(expected)
    for row, other in zip(found, expected):
        for value, wanted in zip(row, other):
            if isinstance(value, float) and isinstance(wanted, float):
                assert math.isclose(value, wanted, rel_tol=1e-9, abs_tol=2e-6)
            else:
                assert value == wanted


def test_every_sql_text_binds(duck):
    for name, text in oracle_sql().items():
        duck.sql(f"EXPLAIN {text}"), name
    assert set(oracle_sql()) <= set(queries())


def test_entry(spark):
    assert entry(spark).columns[:2] == ["product_category", "issue_year"]


def test_parquet_and_csv_round_trip(spark, tmp_path):
    premium = views.premium(spark, SF_DIR).withColumn(
        "payment_date", F.col("payment_date").cast("timestamp"))
    for kind in ("parquet", "csv"):
        paths = tables.write_tables({"premium": premium, "none": None}, str(tmp_path), kind)
        assert list(paths) == ["premium"]
        back = tables.read_tables(spark, str(tmp_path), ["premium", "absent"], kind)
        assert list(back) == ["premium"]
        columns = premium.columns
        same = back["premium"].select(*columns)
        assert same.exceptAll(premium).count() == 0 and premium.exceptAll(same).count() == 0
    with pytest.raises(FileNotFoundError):
        tables.read_table(spark, str(tmp_path), "absent")
    with pytest.raises(ValueError):
        tables.read_table(spark, str(tmp_path), "policy.xlsx")
    with pytest.raises(ValueError):
        tables.write_tables({"premium": premium}, str(tmp_path), "orc")


def test_csv_with_byte_order_mark(spark, tmp_path):
    text = ("policy_id,payment_date,premium_amount,extra\n"
            "P1,2020-01-02 00:00:00,12.5,x\nP2,,,y\n")
    (tmp_path / "premium.csv").write_bytes(b"\xef\xbb\xbf" + text.encode())
    df = tables.read_table(spark, str(tmp_path), "premium.csv")
    assert df.columns == ["policy_id", "payment_date", "premium_amount", "extra"]
    assert dict(df.dtypes)["premium_amount"] == "double"
    rows = df.orderBy("policy_id").collect()
    assert rows[0].premium_amount == 12.5 and rows[1].payment_date is None
    found = tables.load_tables(spark, str(tmp_path), default_format="csv", register=True)
    assert list(found) == ["premium"] and "premium" in tables.list_tables(spark)
    limited = tables.scan(df, ["policy_id"], "premium_amount IS NULL", 1, ["policy_id"])
    assert [r.policy_id for r in limited.collect()] == ["P2"]


def test_cashflow_is_partitioned_by_year(spark, tmp_path):
    cashflow = spark.createDataFrame([("a", 2020, 1.0), ("a", 2021, 2.0)],
                                     "policy_id string, year int, premium_outflow double")
    paths = tables.write_tables({"cashflow_annual": cashflow}, str(tmp_path))
    assert {p.name for p in Path(paths["cashflow_annual"]).glob("year=*")} == {
        "year=2020", "year=2021"}
    back = tables.read_tables(spark, str(tmp_path), ["cashflow_annual"])["cashflow_annual"]
    assert back.where("year = 2021").first().premium_outflow == 2


def test_store_uses_the_shared_folder_or_persists(spark):
    df = store(spark.range(3).toDF("n"), "unit")
    assert sorted(r.n for r in df.collect()) == [0, 1, 2]
    if shared_dir(spark) is None:
        assert df.is_cached
        release(df)
        assert not df.is_cached
    else:
        assert df.inputFiles() and all(shared_dir(spark) in f for f in df.inputFiles())


def test_full_run_writes_all_tables(spark, tmp_path):
    given = views.tables(spark, SF_DIR)
    found = stages.full_run(given, views.AS_OF_YEAR, views.CATEGORIES, output=str(tmp_path))
    assert found["analysis"]["by_product"].count() == 5
    assert found["validation"]["quality_report"].count() == 1
    assert found["statistics"]["regression_irr_premium"].first().durbin_watson > 0
    written = {p.name for p in (tmp_path / "reports").iterdir()}
    assert {"summary.parquet", "policies.parquet", "by_product.parquet", "yearly_trend.parquet",
            "category_trends.parquet", "by_year.parquet"} <= written
    assert (tmp_path / "processed" / "policies_with_returns.csv").exists()
    with pytest.raises(ValueError):
        stages.full_run({}, 2002)


def test_default_categories_follow_the_prefix_order(spark):
    from premia.operators.features import policy_features
    codes = spark.createDataFrame([("TL0199",), ("PA02",), ("XX",), ("AN01",)],
                                  "product_code string")
    found = [r.product_category for r in policy_features(codes, 2024).collect()]
    assert found == ["传统寿险", "分红型寿险", schemas.OTHER_CATEGORY, "年金险"]
