"""The standard tables and the joined order-line view that most queries start from."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from basalt.functions.scalars import cents


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def net_revenue() -> Column:
    """Line revenue after discount in whole cents, rounded half up line by line: 64-bit arithmetic,
    since prices and discounts have two decimal places and sums of cents are exact."""
    price, rate = cents(F.col("l_extendedprice")), cents(F.col("l_discount"))
    return F.floor((price * (F.lit(100).cast("long") - rate) + 50) / F.lit(100.0)).cast("long")


def sales(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Order lines with order, customer, nation and region, ``revenue`` in cents. Sizes decide the
    joins, not hints."""
    t = lambda n: table(spark, sf_dir, n)
    lines = t("lineitem").withColumn("revenue", net_revenue())
    return lines.join(orders_with_places(spark, sf_dir), F.col("l_orderkey") == F.col("o_orderkey"))


def orders_with_places(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders with customer, nation and region."""
    t = lambda n: table(spark, sf_dir, n)
    orders = t("orders").select("o_orderkey", "o_custkey", "o_orderstatus", "o_orderdate", "o_orderpriority")
    customers = t("customer").select("c_custkey", "c_name", "c_nationkey", "c_mktsegment")
    places = t("nation").join(t("region"), F.col("n_regionkey") == F.col("r_regionkey")).select("n_nationkey", "n_name", "r_name")
    j = orders.join(customers, F.col("o_custkey") == F.col("c_custkey"))
    return j.join(places, F.col("c_nationkey") == F.col("n_nationkey"))


def order_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders with customer, nation and region and their lines' ``revenue`` in cents: lines are
    summed before they meet dimensions, so joins carry orders instead of lines."""
    lines = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.sum(net_revenue()).alias("revenue"))
    return lines.join(orders_with_places(spark, sf_dir), F.col("l_orderkey") == F.col("o_orderkey"))


#: The same view for DuckDB.
REVENUE_SQL = "round(CAST(l_extendedprice AS DECIMAL(12,2)) * (1 - CAST(l_discount AS DECIMAL(4,2))), 2)"
SALES_SQL = f"""sales AS (SELECT *, CAST({REVENUE_SQL} AS DECIMAL(14,2)) AS revenue
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey
  JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey)"""
