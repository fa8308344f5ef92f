"""Stock health from snapshots and trailing demand."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions import ranks

#: Days of the demand window, of lead time, and the cover of a product without demand: fixed values.
WINDOW_DAYS, LEAD_DAYS, NO_DEMAND = 30, 7, 999.0


def latest_snapshot(stock: DataFrame) -> DataFrame:
    """Rows of each product's newest snapshot date, over all warehouses that report on it. No row is older than the earliest of the newest dates, which is read first, so that older rows go before they are grouped or joined."""
    newest = ranks.saved(stock.filter(F.col("product_name").isNotNull()).groupBy("product_name").agg(F.max("snapshot_date").alias("newest")))
    oldest = newest.agg(F.min("newest").alias("d")).first()["d"]
    kind = dict(stock.dtypes)["snapshot_date"]
    return stock.filter(F.col("snapshot_date") >= F.lit(oldest).cast(kind)).join(newest, "product_name").filter(F.col("snapshot_date") == F.col("newest")).drop("newest")


def demand_rate(sales: DataFrame) -> DataFrame:
    """product_name, units_per_day over the last 30 days before the frame's last date, or over its whole span if that is shorter."""
    span = sales.agg(F.max("transaction_date").alias("hi"), F.min("transaction_date").alias("lo"))
    days = F.least(F.lit(WINDOW_DAYS), F.greatest(F.lit(1), F.datediff("hi", "lo") + 1))
    d = sales.crossJoin(F.broadcast(span)).filter(F.col("transaction_date") > F.date_sub("hi", WINDOW_DAYS))
    return d.groupBy("product_name").agg((F.sum("quantity") / F.max(days)).alias("units_per_day"))


def risk_band(days: Column) -> Column:
    return F.when(days <= 3, "critical").when(days <= 7, "high").when(days <= 21, "medium").otherwise("low")


def inventory_health(stock: DataFrame, sales: DataFrame) -> DataFrame:
    """product, stock_qty, avg_daily_sales, days_of_stock, turnover, stockout_risk, reorder_point, dead_stock of every product in the newest snapshots."""
    s = latest_snapshot(stock).groupBy("product_name").agg(F.sum("stock_qty").alias("q"))
    j = s.join(demand_rate(sales), "product_name", "left").withColumn("a", F.coalesce("units_per_day", F.lit(0.0)))
    q, a = F.col("q"), F.col("a")
    days = F.when(q <= 0, 0.0).when(a > 0, q / a).otherwise(NO_DEMAND)
    turnover = F.when(q > 0, a * WINDOW_DAYS / q).otherwise(0.0)
    return j.select(
        F.col("product_name").alias("product"), F.round(q, 2).alias("stock_qty"), F.round(a, 2).alias("avg_daily_sales"), F.round(days, 2).alias("days_of_stock"), F.round(turnover, 2).alias("turnover"),
        F.when(q <= 0, "critical").otherwise(risk_band(days)).alias("stockout_risk"), F.round(a * LEAD_DAYS, 2).alias("reorder_point"), ((a == 0) & (q > 0)).alias("dead_stock"),
    )


def newest_per_key(df: DataFrame, key: str, order: str) -> DataFrame:
    """The newest row of each key."""
    w = Window.partitionBy(key).orderBy(F.desc(order))
    return df.withColumn("_place", F.row_number().over(w)).filter("_place = 1").drop("_place")
