"""The retail star schema over the test tables.

Sales rows are order lines: the date from orders, the customer from customer, the product (brand)
and its cost basis from part, and the branch from the supplier's nation. Dimensions join from the
fact outward with left joins; Spark broadcasts them where their measured size allows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions.money import money


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def sales(spark: SparkSession, sf_dir: str) -> DataFrame:
    """order_key, line_number, transaction_date, customer_name, segment, product_name, category, branch_name, quantity, selling_price, discount, revenue, cost_price."""
    t = lambda n: table(spark, sf_dir, n)
    return (
        t("lineitem")
        .join(t("orders"), F.col("l_orderkey") == F.col("o_orderkey"), "left")
        .join(t("customer"), F.col("o_custkey") == F.col("c_custkey"), "left")
        .join(t("part"), F.col("l_partkey") == F.col("p_partkey"), "left")
        .join(t("supplier"), F.col("l_suppkey") == F.col("s_suppkey"), "left")
        .join(t("nation"), F.col("s_nationkey") == F.col("n_nationkey"), "left")
        .select(
            F.col("l_orderkey").alias("order_key"), F.col("l_linenumber").alias("line_number"), F.col("o_orderdate").cast("date").alias("transaction_date"),
            F.col("c_name").alias("customer_name"), F.col("c_mktsegment").alias("segment"), F.col("p_brand").alias("product_name"), F.col("p_type").alias("category"),
            F.col("n_name").alias("branch_name"), F.col("l_quantity").alias("quantity"), (F.col("l_extendedprice") / F.col("l_quantity")).alias("selling_price"),
            (F.col("l_extendedprice") * F.col("l_discount")).alias("discount"), money(F.greatest(F.col("l_extendedprice") * (1 - F.col("l_discount")), F.lit(0.0))).alias("revenue"),
            money(F.col("p_retailprice")).alias("cost_price"),
        )
    )


def expenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """expense_date, category, amount: the tax of each order line."""
    return table(spark, sf_dir, "lineitem").select(
        F.col("l_shipdate").cast("date").alias("expense_date"), F.col("l_returnflag").alias("category"), money(F.col("l_extendedprice") * F.col("l_tax")).alias("amount")
    )


def purchases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """purchase_date, supplier_key, product_name, quantity, cost (a unit's)."""
    part = table(spark, sf_dir, "part")
    return (
        table(spark, sf_dir, "lineitem")
        .join(part, F.col("l_partkey") == F.col("p_partkey"), "left")
        .select(F.col("l_shipdate").cast("date").alias("purchase_date"), F.col("l_suppkey").alias("supplier_key"), F.col("p_brand").alias("product_name"), F.col("l_quantity").alias("quantity"), money(F.col("p_retailprice")).alias("cost"))
    )


def stock(spark: SparkSession, sf_dir: str) -> DataFrame:
    """snapshot_date, product_name, warehouse, stock_qty: quantities by part, supplier and month of shipping."""
    part = table(spark, sf_dir, "part")
    month = F.trunc(F.col("l_shipdate").cast("date"), "month")
    return (
        table(spark, sf_dir, "lineitem")
        .join(part, F.col("l_partkey") == F.col("p_partkey"), "left")
        .groupBy(month.alias("snapshot_date"), F.col("p_brand").alias("product_name"), F.col("l_suppkey").alias("warehouse"))
        .agg(F.sum("l_quantity").alias("stock_qty"))
    )


#: The same frames in SQL, for the oracles.
SALES_SQL = """sales AS (
  SELECT l_orderkey AS order_key, l_linenumber AS line_number, o_orderdate::DATE AS transaction_date, c_name AS customer_name, c_mktsegment AS segment, p_brand AS product_name,
    p_type AS category, n_name AS branch_name, l_quantity AS quantity, l_extendedprice / l_quantity AS selling_price, l_extendedprice * l_discount AS discount,
    greatest(l_extendedprice * (1 - l_discount), 0)::DECIMAL(18,4) AS revenue, p_retailprice::DECIMAL(18,4) AS cost_price
  FROM lineitem LEFT JOIN orders ON l_orderkey = o_orderkey LEFT JOIN customer ON o_custkey = c_custkey LEFT JOIN part ON l_partkey = p_partkey
    LEFT JOIN supplier ON l_suppkey = s_suppkey LEFT JOIN nation ON s_nationkey = n_nationkey)"""
STOCK_SQL = """stock AS (
  SELECT date_trunc('month', l_shipdate)::DATE AS snapshot_date, p_brand AS product_name, l_suppkey AS warehouse, sum(l_quantity) AS stock_qty
  FROM lineitem LEFT JOIN part ON l_partkey = p_partkey GROUP BY ALL)"""
EXPENSES_SQL = "expenses AS (SELECT l_shipdate::DATE AS expense_date, l_returnflag AS category, (l_extendedprice * l_tax)::DECIMAL(18,4) AS amount FROM lineitem)"
