"""What-if scenarios and decision rules over one-row summaries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

R = lambda c, n=2: F.round(c, n)


def elasticity(df: DataFrame) -> DataFrame:
    """One row: n, slope, elasticity (slope x mean price / mean quantity, 4 digits), supported, reason."""
    q, p = F.col("quantity").cast("double"), F.col("selling_price").cast("double")
    d = df.filter(q.isNotNull() & p.isNotNull())
    m = d.agg(F.count(F.lit(1)).alias("n"), F.regr_slope(q, p).alias("slope"), F.avg(q).alias("mq"), F.avg(p).alias("mp"), F.stddev_samp(q).alias("sq"), F.stddev_samp(p).alias("sp"))
    why = (
        F.when(F.col("n") < 8, "too few rows").when((F.col("mq") <= 0) | (F.col("mp") <= 0), "mean price or quantity is not positive")
        .when((F.col("sq") == 0) | (F.col("sp") == 0) | F.col("slope").isNull(), "no variance in price or quantity").when(F.col("slope") >= 0, "slope is not negative").otherwise("")
    )
    return m.select("n", R(F.col("slope"), 6).alias("slope"), F.when(why == "", R(F.col("slope") * F.col("mp") / F.col("mq"), 4)).alias("elasticity"), (why == "").alias("supported"), why.alias("reason"))


def totals(df: DataFrame) -> DataFrame:
    return df.agg(F.sum("revenue").cast("double").alias("revenue"), F.sum("quantity").cast("double").alias("units"), F.count(F.lit(1)).alias("n"), F.count_distinct("customer_name").alias("customers"))


def price_change(df: DataFrame, pct: float) -> DataFrame:
    """Effect on revenue of a price change in per cent at the measured elasticity; unsupported where there is none."""
    j = totals(df).crossJoin(elasticity(df).select("elasticity", "supported", "reason"))
    units = F.col("elasticity") * pct
    rate = ((1 + F.lit(pct) / 100) * (1 + units / 100) - 1) * 100
    return j.select(F.lit("price_change_pct").alias("type"), "supported", "elasticity", R(units).alias("units_pct"), R(rate).alias("revenue_pct"), R(F.col("revenue") * rate / 100).alias("revenue_delta"), R(F.col("revenue")).alias("baseline_revenue"), F.round(F.least(F.lit(0.8), 0.3 + F.col("n") / 50), 3).alias("confidence"), "reason")


def inventory_change(df: DataFrame, pct: float) -> DataFrame:
    """Effect of a stock change in per cent if demand takes it up: units scale, the price of a unit stays. The interval is 1.28 deviations of daily revenue."""
    days = df.groupBy("transaction_date").agg(F.sum("revenue").cast("double").alias("r")).agg(F.coalesce(F.stddev_samp("r"), F.lit(0.0)).alias("s"))
    j = totals(df).crossJoin(days)
    ok = (F.col("revenue") > 0) & (F.col("units") > 0) & (F.col("n") >= 5)
    delta = F.try_divide(F.col("units") * pct / 100 * F.col("revenue"), F.col("units"))
    half = 1.28 * F.col("s")
    return j.select(F.lit("inventory_change_pct").alias("type"), F.coalesce(ok, F.lit(False)).alias("supported"), R(delta).alias("revenue_delta"), R(F.col("units") * pct / 100).alias("units_delta"), R(delta - half).alias("revenue_lower"), R(delta + half).alias("revenue_upper"), F.round(F.least(F.lit(0.7), 0.3 + F.col("n") / 50), 3).alias("confidence"))


def churn_rise(df: DataFrame, points: float) -> DataFrame:
    """Effect of a rise of churn in percentage points, spread evenly over customers; needs 5 customers."""
    per = df.groupBy("customer_name").agg(F.sum("revenue").cast("double").alias("r")).agg(F.coalesce(F.stddev_samp("r"), F.lit(0.0)).alias("s"))
    j = totals(df).crossJoin(per)
    delta = F.col("revenue") * (-points / 100)
    half = 1.28 * F.col("s") * (points / 100) * F.sqrt("customers")
    ok = (F.col("customers") >= 5) & (F.col("revenue") > 0)
    return j.select(F.lit("churn_rise_pp").alias("type"), F.coalesce(ok, F.lit(False)).alias("supported"), R(delta).alias("revenue_delta"), "customers", R(delta - half).alias("revenue_lower"), R(delta + half).alias("revenue_upper"), F.round(F.least(F.lit(0.7), 0.3 + F.col("customers") / 40), 3).alias("confidence"))


def clamp(c: Column) -> Column:
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), c))


def decision_score(severity: Column, mean_confidence: Column) -> Column:
    return F.round(100 * (0.6 * clamp(severity) + 0.4 * clamp(mean_confidence)), 2)


def decisions(evidence: DataFrame, *keys: str) -> DataFrame:
    """[keys,] rule, fired, severity, confidence, score of the five decision rules for each evidence row.

    Evidence: growth_pct, margin_status, n_points, n_anomalies, peak_score, n_segments, n_risky,
    first_yhat, last_yhat, kpi_confidence, anomaly_confidence, ml_confidence, forecast_confidence.
    """
    e = F.col
    decline = F.when(e("first_yhat") > 0, (e("first_yhat") - e("last_yhat")) / e("first_yhat") * 100)
    share = e("n_anomalies") / F.greatest("n_points", F.lit(1))
    rules = [
        ("revenue_drop_rule", e("growth_pct") < -5, clamp(F.abs("growth_pct") / 20), "kpi_confidence"),
        ("margin_crit_rule", e("margin_status").isin("crit", "warn"), F.when(e("margin_status") == "crit", 0.9).otherwise(0.5), "kpi_confidence"),
        ("anomaly_spike_rule", e("n_anomalies") > 0, clamp(0.5 * F.least(F.lit(1.0), share * 5) + 0.5 * F.least(F.lit(1.0), F.col("peak_score"))), "anomaly_confidence"),
        ("churn_risk_rule", e("n_risky") > 0, clamp(0.3 + 0.7 * e("n_risky") / F.greatest("n_segments", F.lit(1))), "ml_confidence"),
        ("forecast_decline_rule", decline >= 5, clamp(decline / 30), "forecast_confidence"),
    ]
    rows = F.array(*[
        F.struct(F.lit(name).alias("rule"), F.coalesce(fired, F.lit(False)).alias("fired"), F.round(F.when(fired, sev).otherwise(0.0), 3).alias("severity"), F.round(F.col(conf).cast("double"), 4).alias("confidence"))
        for name, fired, sev, conf in rules
    ])
    out = evidence.select(*keys, F.inline(rows))
    return out.withColumn("score", F.when(F.col("fired"), decision_score(F.col("severity"), F.col("confidence"))).otherwise(0.0))
