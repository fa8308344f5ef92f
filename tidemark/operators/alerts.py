"""Alert rules: conditions, transitions and ledgers, in batch form."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.sources.versions import VERSION, Change, Table

from .rollup import Rollup

#: Spellings of conditions: fixed values.
CONDITIONS = {">": ">", "gt": ">", "above": ">", ">=": ">=", "gte": ">=", "<": "<", "lt": "<", "below": "<", "<=": "<=", "lte": "<=", "==": "==", "=": "==", "eq": "==", "!=": "!=", "ne": "!="}


def normalize_condition(condition: str) -> str:
    key = str(condition).strip().lower()
    if key not in CONDITIONS:
        raise ValueError(f"unknown condition {condition!r}")
    return CONDITIONS[key]


def fires(value: Column, condition: Column, threshold: Column) -> Column:
    """Whether value, condition, threshold holds; NaN and null never do."""
    by = F.when(condition == ">", value > threshold).when(condition == ">=", value >= threshold).when(condition == "<", value < threshold).when(condition == "<=", value <= threshold).when(condition == "==", value == threshold).when(condition == "!=", value != threshold)
    return F.coalesce(by & ~F.isnan(value) & ~F.isnan(threshold), F.lit(False))


#: Metrics of rules, and the severity of an alert on each: fixed values.
METRICS = {
    "sales.revenue": "high", "sales.orders": "medium", "sales.units": "medium", "sales.aov": "low", "sales.growth_pct": "medium", "branch.revenue_max": "high", "branch.count": "low",
    "inventory.stockout_count": "critical", "inventory.dead_stock_count": "medium", "inventory.min_days_of_stock": "high", "finance.net_profit": "high", "finance.margin_pct": "high",
}


def trailing(frame: DataFrame, days: int = 1, today: str | None = None) -> DataFrame:
    """Rows of the civil days from ``days`` before today to today, both included; ``today`` defaults to the frame's last date.

    The last date is read first, so that it is a value in the filter: Spark then drops other days before it joins a
    frame's dimensions to its facts. Distinct dates need none of the dimensions that give no date.
    """
    if today is not None:
        return frame.filter(F.col("transaction_date").between(F.date_sub(F.to_date(F.lit(today)), days), F.to_date(F.lit(today))))
    last = frame.select("transaction_date").distinct().agg(F.max("transaction_date").alias("last")).first()["last"]
    return frame.filter(F.col("transaction_date") >= F.date_sub(F.lit(last).cast("date"), days))


def metric_values(frame: DataFrame, stock: DataFrame | None = None) -> DataFrame:
    """(metric, value) of every metric over a sales frame, which the caller has cut to the window, and the newest stock; without stock its counts are 0. The frame is rolled up once."""
    known = Rollup.of(frame)
    branches = known.shares("branch").agg(F.coalesce(F.max("revenue"), F.lit(0.0)).alias("top"), F.count(F.lit(1)).cast("double").alias("branches"))
    money = known.finance().select("net_profit", F.col("margin_pct").alias("net_margin"))
    row = known.kpi().crossJoin(branches).crossJoin(money)  # one row each
    if stock is not None:
        health = known.inventory(stock)
        low = F.count_if(F.col("stockout_risk").isin("critical", "high")).cast("double")
        row = row.crossJoin(health.agg(low.alias("low"), F.count_if("dead_stock").cast("double").alias("dead"), F.coalesce(F.min("days_of_stock"), F.lit(0.0)).alias("least")))
    else:
        row = row.select("*", *[F.lit(0.0).alias(c) for c in ("low", "dead", "least")])
    columns = ("revenue", "orders", "units", "aov", "growth_pct", "top", "branches", "low", "dead", "least", "net_profit", "net_margin")
    pairs = ", ".join(f"'{m}', cast({c} as double)" for m, c in zip(METRICS, columns, strict=True))
    return row.select(F.expr(f"stack({len(METRICS)}, {pairs}) as (metric, value)"))


def evaluate(rules: DataFrame, values: DataFrame) -> DataFrame:
    """rules (rule, metric, condition, threshold, is_active) that are active, with value, fires, severity and ``error``: an unknown metric or condition or a threshold that is no number spoils its own rule only, which then does not fire."""
    spelled = F.create_map(*[F.lit(x) for pair in CONDITIONS.items() for x in pair])
    condition = F.try_element_at(spelled, F.lower(F.trim("condition")))
    threshold = F.expr("try_cast(threshold as double)")
    severity = F.create_map(*[F.lit(x) for pair in METRICS.items() for x in pair])
    j = rules.filter("is_active").join(F.broadcast(values), "metric", "left")  # a row a metric
    error = F.when(F.col("value").isNull(), "unknown metric").when(condition.isNull(), "unknown condition").when(threshold.isNull() | F.isnan(threshold), "threshold is no number")
    fired = error.isNull() & fires(F.col("value"), condition, threshold)
    return j.select("rule", "metric", "value", fired.alias("fires"), F.try_element_at(severity, F.col("metric")).alias("severity"), error.alias("error"))


def transitions(observations: DataFrame, rule: str = "rule", order: str = "at") -> DataFrame:
    """observations (rule, at, fires) with ``action``: open, keep, resolve or none. An alert stays open while the rule fires, so one rule never has two open alerts."""
    before = F.coalesce(F.lag("fires").over(Window.partitionBy(rule).orderBy(order)), F.lit(False))
    now = F.col("fires")
    return observations.withColumn("action", F.when(now & ~before, "open").when(now, "keep").when(before, "resolve").otherwise("none"))


def episodes(observations: DataFrame, rule: str = "rule", order: str = "at") -> DataFrame:
    """rule, opened_at, resolved_at (null: still open), observations while open."""
    t = transitions(observations, rule, order)
    w = Window.partitionBy(rule).orderBy(order)
    t = t.withColumn("episode", F.sum((F.col("action") == "open").cast("int")).over(w)).filter("action <> 'none'")
    return t.groupBy(rule, "episode").agg(F.min(order).alias("opened_at"), F.max(F.when(F.col("action") == "resolve", F.col(order))).alias("resolved_at"), F.count_if(F.col("fires")).alias("observations")).drop("episode")


def listing(alerts: DataFrame, status: str | None = None, rule: str | None = None, limit: int = 200) -> DataFrame:
    """Newest first, at most 200."""
    for name, value in (("status", status), ("rule", rule)):
        if value is not None:
            alerts = alerts.filter(F.col(name) == value)
    return alerts.orderBy(F.desc("at"), "rule").limit(max(1, min(200, limit)))


def acknowledge(alerts: DataFrame, ids: list[int], at: str, by: str) -> DataFrame:
    """alerts (alert_id, status, ...) with the named open ones acknowledged; they still count as open for their rule, so no second one opens."""
    mine = F.col("alert_id").isin(*ids) & (F.col("status") == "open")
    for name, kind, value in (("acknowledged_at", "timestamp", at), ("acknowledged_by", "string", by)):
        old = F.col(name) if name in alerts.columns else F.lit(None).cast(kind)
        alerts = alerts.withColumn(name, F.when(mine, F.lit(value).cast(kind)).otherwise(old))
    return alerts.withColumn("status", F.when(mine, "acknowledged").otherwise(F.col("status")))


def with_history(alerts: DataFrame, events: DataFrame) -> DataFrame:
    """alerts (alert_id, ...) with ``events``, array of (event_id, event_type) of each, oldest first; none: empty."""
    trail = events.groupBy("alert_id").agg(F.sort_array(F.collect_list(F.struct("event_id", "event_type"))).alias("events"))
    none = F.array().cast("array<struct<event_id:bigint,event_type:string>>")
    return alerts.join(trail, "alert_id", "left").withColumn("events", F.coalesce("events", none))


def check_rule(name: str, metric: str, condition: str, threshold: float) -> None:
    """ValueError for a rule without a name, or with an unknown metric, a condition that cannot be spelled out or a threshold that is no finite number."""
    if not str(name).strip():
        raise ValueError("a rule needs a name")
    if metric not in METRICS:
        raise ValueError(f"unknown metric {metric!r}; known: {', '.join(sorted(METRICS))}")
    normalize_condition(condition)
    try:
        finite = abs(float(threshold)) < float("inf")
    except (TypeError, ValueError):
        finite = False
    if not finite:
        raise ValueError(f"the threshold of {name!r} is no finite number: {threshold!r}")


class Ledger:
    """Alerts as an append-only log of events in a versioned table: open, keep, resolve and acknowledge. A rule has one unresolved alert at most, with any number of observers."""

    EVENT = "alert_id long, rule string, kind string, at timestamp, value double, severity string, who string"

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.table = spark, Table(spark, f"{folder}/alerts", self.EVENT)

    def events(self, version: int | None = None) -> DataFrame:
        """Events with the id of their alert; an alert is named by the commit that opened it and its place there."""
        opened = F.when(F.col("kind") == "open", F.shiftleft(VERSION, 20) + F.col("alert_id")).otherwise(F.col("alert_id"))
        return self.table.read(version).withColumn("alert_id", opened).withColumnRenamed(VERSION, "event_id")

    def alerts(self, version: int | None = None) -> DataFrame:
        """alert_id, rule, status (open, acknowledged, resolved), severity, value (newest), opened_at, resolved_at, acknowledged_at, acknowledged_by, observations."""
        when = lambda kind, c: F.max(F.when(F.col("kind") == kind, F.col(c)))
        rows = self.events(version).groupBy("alert_id").agg(
            F.first("rule").alias("rule"), F.max("severity").alias("severity"), F.max_by("value", F.when(F.col("value").isNotNull(), F.col("event_id"))).alias("value"), when("open", "at").alias("opened_at"),
            when("resolve", "at").alias("resolved_at"), when("acknowledge", "at").alias("acknowledged_at"), when("acknowledge", "who").alias("acknowledged_by"), F.count_if(F.col("kind").isin("open", "keep")).alias("observations"),
        )
        status = F.when(F.col("resolved_at").isNotNull(), "resolved").when(F.col("acknowledged_at").isNotNull(), "acknowledged").otherwise("open")
        return rows.withColumn("status", status)

    def observe(self, evaluated: DataFrame, at: str) -> int:
        """Takes evaluated rules (rule, fires, value, severity) at a time: opens, keeps or resolves their alerts. Returns the version; two observers at once never open two alerts for a rule."""

        def plan(version: int) -> Change:
            unresolved = self.alerts(version).filter("status <> 'resolved'").select("rule", F.col("alert_id").alias("known"))
            j = evaluated.select("rule", "fires", F.col("value").cast("double").alias("value"), "severity").join(unresolved, "rule", "left")
            kind = F.when(F.col("fires"), F.when(F.col("known").isNull(), "open").otherwise("keep")).when(F.col("known").isNotNull(), "resolve")
            acts = j.withColumn("kind", kind).filter("kind is not null")
            place = F.row_number().over(Window.orderBy("rule"))  # a row a rule that fires or is open
            rows = acts.select(F.coalesce("known", place.cast("long")).alias("alert_id"), "rule", "kind", F.to_timestamp(F.lit(at)).alias("at"), "value", "severity", F.lit(None).cast("string").alias("who"))
            return Change((self.table.stage(rows, partitions=1),))

        return self.table.commit(plan)

    def acknowledge(self, ids: list[int], at: str, by: str) -> list[int]:
        """Acknowledges the named alerts that are open, and returns which were."""
        done: list[int] = []

        def plan(version: int) -> Change:
            nonlocal done
            mine = self.alerts(version).filter("status = 'open'").filter(F.col("alert_id").isin(*ids)).select("alert_id", "rule").collect()  # at most the named ones
            done = sorted(r["alert_id"] for r in mine)
            rows = [(r["alert_id"], r["rule"], "acknowledge", None, None, None, by) for r in mine]
            frame = self.spark.createDataFrame(rows, self.EVENT).withColumn("at", F.to_timestamp(F.lit(at)))
            return Change((self.table.stage(frame, partitions=1),) if rows else ())

        self.table.commit(plan)
        return done

    def listing(self, status: str | None = None, rule: str | None = None, limit: int = 200) -> DataFrame:
        return listing(self.alerts().withColumn("at", F.col("opened_at")), status, rule, limit).drop("at")
