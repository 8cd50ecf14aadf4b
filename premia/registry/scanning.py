"""Scans and projections."""

import uuid
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from premia.registry.base import Query
from premia.sources import tables, views
from premia.storage import new_path

ORDER = "o_orderkey:l o_totalprice:2 o_orderdate:t"


def scan_project_filter_limit(spark, sf_dir):
    return tables.scan(
        views.given(spark, sf_dir, "orders"), ["o_orderkey", "o_totalprice", "o_orderdate"],
        "o_orderstatus = 'F' AND o_totalprice > 1000", 100, ["o_orderkey"])


def scan_by_period(spark, sf_dir):
    return tables.scan_period(views.given(spark, sf_dir, "orders"), "o_orderdate",
                              "1997-01-01", "1998-06-30",
                              ["o_orderkey", "o_totalprice", "o_orderdate"])


def catalog_scan(spark, sf_dir):
    views.given(spark, sf_dir, "orders").createOrReplaceTempView("premium_source")
    return tables.catalog_table(spark, "premium_source",
                                ["o_orderkey", "o_totalprice", "o_orderdate"],
                                "o_orderpriority = '1-URGENT'")


def sql_query(spark, sf_dir):
    views.given(spark, sf_dir, "orders").createOrReplaceTempView("premium_source")
    return tables.query(
        spark, "SELECT o_orderkey, o_totalprice, o_orderdate FROM premium_source "
               "WHERE o_totalprice >= :low", {"low": 250000.0})


def _folder(spark, name):
    """A folder of its own in the shared folder, else in the warehouse."""
    return new_path(spark, name) or f"{spark.conf.get('spark.sql.warehouse.dir')}/{uuid.uuid4()}"


def csv_round_trip(spark, sf_dir):
    """Orders as CSV and back: text form of every value and the given types must survive."""
    orders = views.given(spark, sf_dir, "orders").select(
        "o_orderkey", "o_totalprice", "o_orderdate")
    base = _folder(spark, "csv")
    tables.write_tables({"orders": orders}, base, "csv")
    return tables.read_tables(spark, base, ["orders"], "csv", {"orders": orders.schema})["orders"]


def parquet_round_trip(spark, sf_dir):
    """Orders in folders by status and back, read with projection and filter."""
    base = _folder(spark, "parquet")
    tables.write_tables({"orders": views.given(spark, sf_dir, "orders")}, base, "parquet",
                        {"orders": ["o_orderstatus"]})
    back = tables.read_tables(spark, base, ["orders"])["orders"]
    return tables.scan(back, ["o_orderkey", "o_totalprice", "o_orderdate"], "o_orderstatus <> 'F'")


def load_tables(spark, sf_dir):
    """Rows of each table that exists; absent ones are left out."""
    found = tables.load_tables(spark, sf_dir, ("orders", "customer", "lineitem", "absent"))
    counts = [df.agg(F.lit(name).alias("name"), F.count("*").alias("n"))
              for name, df in found.items()]
    return reduce(DataFrame.unionByName, counts)


def list_tables(spark, sf_dir):
    """Names of registered tables, with a row for each row of one of them."""
    tables.load_tables(spark, sf_dir, ("region", "nation"), register=True)
    names = [n for n in tables.list_tables(spark) if n in ("region", "nation")]
    return reduce(DataFrame.unionByName, [
        spark.table(n).agg(F.lit(n).alias("name"), F.count("*").alias("n")) for n in names])


QUERIES = [
    Query("csv_round_trip", csv_round_trip, ORDER,
          "SELECT o_orderkey, o_totalprice, o_orderdate FROM orders"),
    Query("parquet_round_trip", parquet_round_trip, ORDER, """
      SELECT o_orderkey, o_totalprice, o_orderdate FROM orders WHERE o_orderstatus <> 'F'"""),
    Query("load_tables", load_tables, "name:s n:l", """
      SELECT 'orders' AS name, count(*) AS n FROM orders UNION ALL
      SELECT 'customer', count(*) FROM customer UNION ALL
      SELECT 'lineitem', count(*) FROM lineitem"""),
    Query("list_tables", list_tables, "name:s n:l", """
      SELECT 'region' AS name, count(*) AS n FROM region UNION ALL
      SELECT 'nation', count(*) FROM nation"""),
    Query("scan_project_filter_limit", scan_project_filter_limit, ORDER, """
      SELECT o_orderkey, o_totalprice, o_orderdate FROM orders
      WHERE o_orderstatus = 'F' AND o_totalprice > 1000 ORDER BY o_orderkey LIMIT 100"""),
    Query("scan_by_period", scan_by_period, ORDER, """
      SELECT o_orderkey, o_totalprice, o_orderdate FROM orders
      WHERE o_orderdate BETWEEN TIMESTAMP '1997-01-01' AND TIMESTAMP '1998-06-30'"""),
    Query("catalog_scan", catalog_scan, ORDER, """
      SELECT o_orderkey, o_totalprice, o_orderdate FROM orders
      WHERE o_orderpriority = '1-URGENT'"""),
    Query("sql_query", sql_query, ORDER, """
      SELECT o_orderkey, o_totalprice, o_orderdate FROM orders WHERE o_totalprice >= 250000"""),
]
