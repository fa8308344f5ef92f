"""Customers: RFM scores and segments, lifetime value, cohort retention, features and churn labels."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions import ranks
from tidemark.functions.money import pct


def quintile_cuts(values: DataFrame, column: str, out: str) -> DataFrame:
    """One row ``out``, array<column's type>: the greatest values of average-rank percentile up to .2, .4, .6 and .8 (null where there is none), and an empty array if all values are equal.

    Ranks come from a histogram of distinct values in range partitions, so one value may hold any
    share of the rows and the number of distinct values any size.
    """
    hist = values.groupBy(column).agg(F.count(F.lit(1)).alias("n"))
    ranked = ranks.running(hist, [column], sums={"upto": "n"})
    p = (F.col("upto") - F.col("n") + 1 + (F.col("n") - 1) / 2) / F.col("total")
    cuts = ranked.crossJoin(ranks.one_row(values, F.count(F.lit(1)).alias("total"))).agg(*[F.max(F.when(p <= q, F.col(column))).alias(f"c{i}") for i, q in enumerate((0.2, 0.4, 0.6, 0.8))], F.count(F.lit(1)).alias("kinds"))
    four = F.array(*[F.col(f"c{i}") for i in range(4)])
    return F.broadcast(cuts.select(F.when(F.col("kinds") > 1, four).otherwise(F.slice(four, 1, 0)).alias(out)))


def quintile(value: Column, cuts: Column, reverse: bool = False) -> Column:
    """1 to 5 by the cuts of ``quintile_cuts`` (right-closed), reversed on demand; all values equal: 5."""
    band = F.lit(5)
    for i in (3, 2, 1, 0):
        band = F.when(value <= F.get(cuts, F.lit(i)), i + 1).otherwise(band)
    return F.when(F.size(cuts) == 0, 5).otherwise(6 - band if reverse else band)


def segment(r: Column, f: Column, m: Column) -> Column:
    s = r + f + m
    return F.when(s >= 13, "champions").when(s >= 11, "loyal").when(r <= 2, "at_risk").when(f <= 2, "new").otherwise("potential")


def rfm(df: DataFrame, ref_date: str | None = None) -> DataFrame:
    """customer, recency_days, frequency, monetary, r_score, f_score, m_score, segment. Undated rows are left out; ``ref_date`` defaults to the last date there is."""
    d = df.filter(F.col("transaction_date").isNotNull())
    g = d.groupBy(F.col("customer_name").alias("customer")).agg(F.max("transaction_date").alias("last"), F.count(F.lit(1)).alias("frequency"), F.sum("revenue").alias("money"))
    return rfm_of(g, ref_date)


def rfm_of(g: DataFrame, ref_date: str | None = None) -> DataFrame:
    """``rfm`` from (customer, last, frequency, money), a row a customer."""
    g = ranks.saved(g)  # read for each of the three scores
    ref = F.broadcast(g.agg((F.to_date(F.lit(ref_date)) if ref_date else F.max("last")).alias("ref")))
    g = g.crossJoin(ref).select("customer", F.greatest(F.datediff("ref", "last"), F.lit(0)).alias("recency_days"), "frequency", "money")
    out = g
    for column, name in (("recency_days", "r"), ("frequency", "f"), ("money", "m")):
        out = out.crossJoin(quintile_cuts(g, column, f"cuts_{name}"))
    r, f, m = quintile(F.col("recency_days"), F.col("cuts_r"), True), quintile(F.col("frequency"), F.col("cuts_f")), quintile(F.col("money"), F.col("cuts_m"))
    out = out.select("customer", "recency_days", "frequency", F.round("money", 2).cast("double").alias("monetary"), r.alias("r_score"), f.alias("f_score"), m.alias("m_score"))
    return out.withColumn("segment", segment(F.col("r_score"), F.col("f_score"), F.col("m_score")))


def clv(df: DataFrame, ref_date: str | None = None) -> DataFrame:
    """rfm with clv = monetary x (1 + frequency / 10)."""
    return rfm(df, ref_date).withColumn("clv", F.round(F.col("monetary").cast("decimal(20,2)") * (F.col("frequency") + 10).cast("decimal(12,0)") * F.lit(0.1).cast("decimal(2,1)"), 2).cast("double"))


def segment_distribution(df: DataFrame) -> DataFrame:
    return rfm(df).groupBy("segment").agg(F.count(F.lit(1)).alias("customers"), F.round(F.sum(F.col("monetary").cast("decimal(20,2)")), 2).cast("double").alias("monetary"))


def cohort_retention(df: DataFrame) -> DataFrame:
    """cohort (month of first purchase), period_offset in months, active_customers, retention_pct of the cohort's size."""
    d = df.filter(F.col("transaction_date").isNotNull()).select("customer_name", F.trunc("transaction_date", "month").alias("month")).distinct()
    d = d.withColumn("first", F.min("month").over(Window.partitionBy("customer_name")))
    g = d.groupBy("first", F.round(F.months_between("month", "first")).cast("int").alias("period_offset")).agg(F.count(F.lit(1)).alias("active_customers"))
    base = F.max(F.when(F.col("period_offset") == 0, F.col("active_customers"))).over(Window.partitionBy("first"))
    return g.select(F.date_format("first", "yyyy-MM").alias("cohort"), "period_offset", "active_customers", pct(F.col("active_customers"), base).alias("retention_pct"))


def customer_features(df: DataFrame) -> DataFrame:
    """customer_name, total_orders, total_spending, recency, frequency, monetary, aov, tenure; days count back from the last date there is."""
    g = df.groupBy("customer_name").agg(F.count(F.lit(1)).alias("n"), F.sum("revenue").alias("r"), F.max("transaction_date").alias("last"), F.min("transaction_date").alias("first"))
    ref = F.col("ref")
    money = F.round("r", 2).cast("double")
    g = ranks.saved(g)
    return g.crossJoin(ranks.one_row(g, F.max("last").alias("ref"))).select(
        "customer_name", F.col("n").alias("total_orders"), money.alias("total_spending"), F.datediff(ref, "last").alias("recency"), F.col("n").alias("frequency"), money.alias("monetary"),
        F.round(F.col("r").cast("double") / F.col("n"), 4).alias("aov"), F.datediff(ref, "first").alias("tenure"),
    )


def churn_label(features: DataFrame) -> DataFrame:
    """features with churn: 1 if recency is over 90 days and there were at most 2 orders."""
    return features.withColumn("churn", ((F.col("recency") > 90) & (F.col("frequency") <= 2)).cast("int"))
