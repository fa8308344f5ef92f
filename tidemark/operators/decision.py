"""Decision support: evidence from sales, rules, ranked and explained recommendations, and a ledger of cases."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.sources.versions import VERSION, Change, Table

from . import anomaly, kpi, scenarios, timeseries
from .rollup import Rollup

#: What to do when a rule fires, the evidence that it rests on, and the scenario to try: (action, evidence kind, scenario, change).
ADVICE = {
    "revenue_drop_rule": ("Look into prices, promotions and branches of the weaker half.", "kpi", "price_change_pct", -5.0),
    "margin_crit_rule": ("Check costs of goods and running costs; hold back lines with a low margin.", "kpi", "inventory_change_pct", 10.0),
    "anomaly_spike_rule": ("Check the flagged days for missing stock, wrong data or a jump in demand.", "anomaly", None, None),
    "churn_risk_rule": ("Win back the customers at risk.", "ml_prediction", "churn_rise_pp", 5.0),
    "forecast_decline_rule": ("Prepare demand measures and smaller stocks for the forecast window.", "forecast", "price_change_pct", -5.0),
}
LIMITATIONS = ("Only available evidence counts; a missing source is left out, not estimated.", "Scenarios hold under their stated assumptions.")
KINDS = ("kpi", "anomaly", "forecast", "ml_prediction")


def evidence(sales: DataFrame, expenses: DataFrame | None = None, horizon: int = 14, detectors: str = "all") -> DataFrame:
    """One row with the facts that ``scenarios.decisions`` reads, and four confidences (3 digits; 0: no such evidence).

    Confidences: KPI rows / 30, up to 1; anomalies .4 + days / 60, up to .9, from 6 days on; forecast
    .75, or .45 where its interval has no error spread to rest on; customers / 20, .3 to 1. Facts of a
    source without evidence are null. Customers at risk are those of the RFM segment of that name.
    Anomalies come from all four detectors, or from ``deviation`` alone. The sales are rolled up once;
    all sources of evidence read the rollup.
    """
    return evidence_of(Rollup.of(sales), expenses, horizon, detectors)


def evidence_of(rolled: Rollup, expenses: DataFrame | None = None, horizon: int = 14, detectors: str = "all") -> DataFrame:
    """``evidence`` from a rollup."""
    if detectors not in ("all", "deviation"):
        raise ValueError("detectors is all or deviation")
    name = F.col("name")
    values = kpi.evaluate(rolled.cells.sparkSession, kpi.values_of(rolled, None, expenses)).agg(
        F.max(F.when(name == "revenue", F.col("value"))).alias("revenue"), F.max(F.when(name == "growth_pct", F.col("value"))).alias("growth"), F.max(F.when(name == "margin_pct", F.col("status"))).alias("margin")
    )
    series = rolled.series()
    seen = anomaly.detect(series) if detectors == "all" else timeseries.outliers(series)
    odd = seen.agg(F.count(F.lit(1)).alias("n_points"), F.count_if("anomaly").alias("odd"), F.max(F.when(F.col("anomaly"), F.col("score"))).alias("peak"))
    spread = timeseries.walk_forward_errors(series).agg(F.coalesce(F.max("error") > F.min("error"), F.lit(False)).alias("spread"))
    ahead = timeseries.baseline_forecast(series, horizon).agg(F.min_by("yhat", "ds").alias("first_yhat"), F.max_by("yhat", "ds").alias("last_yhat"), F.count(F.lit(1)).alias("n_periods"))
    people = rolled.rfm().agg(F.count(F.lit(1)).alias("n_customers"), F.count_if(F.col("segment") == "at_risk").alias("risky"))
    row = rolled.days().agg(F.coalesce(F.sum("n"), F.lit(0).cast("long")).alias("n_rows"))
    for part in (values, odd, spread, ahead, people):
        row = row.crossJoin(part)  # each has one row
    some, points, known = F.col("n_rows") > 0, F.col("n_points") >= 6, F.col("n_customers") > 0
    conf = lambda ok, value: F.round(F.when(ok, value).otherwise(0.0), 3)
    return row.select(
        "n_rows", "n_points", "n_periods", "n_customers", F.when(some, F.col("revenue")).alias("revenue"), F.when(some, F.col("growth")).alias("growth_pct"), F.when(some, F.col("margin")).alias("margin_status"),
        F.when(points, F.col("odd")).alias("n_anomalies"), F.when(points, F.col("peak")).alias("peak_score"), F.col("n_customers").alias("n_segments"), F.when(known, F.col("risky")).alias("n_risky"), "first_yhat", "last_yhat",
        conf(some, F.least(F.lit(1.0), F.col("n_rows") / 30)).alias("kpi_confidence"), conf(points, F.least(F.lit(0.9), 0.4 + F.col("n_points") / 60)).alias("anomaly_confidence"),
        conf(F.col("n_periods") > 0, F.when(F.col("spread"), 0.75).otherwise(0.45)).alias("forecast_confidence"), conf(known, F.least(F.lit(1.0), F.greatest(F.lit(0.3), F.col("n_customers") / 20))).alias("ml_confidence"),
    )


def evidence_id(kind: str) -> str:
    return f"ev-{KINDS.index(kind) + 1:04d}"


def evidence_items(facts: DataFrame) -> DataFrame:
    """(id, kind, status, confidence, note), one row for each kind of evidence; ``note`` says what was seen, or what was missing."""
    text = F.format_string
    told: dict[str, tuple[str, Column, str]] = {
        "kpi": ("kpi_confidence", text("revenue %.2f, growth %.2f %%", F.col("revenue"), F.col("growth_pct")), "no sales rows"),
        "anomaly": ("anomaly_confidence", text("%d of %d days stand out", F.col("n_anomalies"), F.col("n_points")), "fewer than 6 days"),
        "forecast": ("forecast_confidence", text("%d periods ahead, %.2f to %.2f", F.col("n_periods"), F.col("first_yhat"), F.col("last_yhat")), "no dated sales"),
        "ml_prediction": ("ml_confidence", text("%d of %d customers at risk", F.col("n_risky"), F.col("n_segments")), "no customers with dated sales"),
    }
    rows = [
        F.struct(F.lit(evidence_id(k)).alias("id"), F.lit(k).alias("kind"), F.when(F.col(c) > 0, "available").otherwise("unavailable").alias("status"), F.col(c).alias("confidence"), F.when(F.col(c) > 0, note).otherwise(missing).alias("note"))
        for k, (c, note, missing) in told.items()
    ]
    return facts.select(F.inline(F.array(*rows)))


def recommend(facts: DataFrame) -> DataFrame:
    """Fired rules, best score first (ties by rule): rank, rule, score, severity, confidence, action, evidence_id, scenario, change, summary, limitations. No fired rule: no rows."""
    one = lambda f: F.create_map(*[F.lit(x) for rule, advice in ADVICE.items() for x in (rule, f(advice))])[F.col("rule")]
    place = F.row_number().over(Window.orderBy(F.desc("score"), "rule"))  # at most five rows
    rows = scenarios.decisions(facts).filter("fired").select(place.alias("rank"), "rule", "score", "severity", "confidence")
    return rows.select(
        "*", one(lambda a: a[0]).alias("action"), one(lambda a: evidence_id(a[1])).alias("evidence_id"), F.nullif(one(lambda a: a[2] or ""), F.lit("")).alias("scenario"),
        F.when(one(lambda a: a[2] or "") != "", one(lambda a: float(a[3] or 0))).alias("change"),
        F.format_string("%s Driven by %s (score %.2f).", one(lambda a: a[0]), one(lambda a: a[1]), F.col("score")).alias("summary"), F.array(*[F.lit(x) for x in LIMITATIONS]).alias("limitations"),
    )


class CaseLedger:
    """Decision cases as a versioned table in a folder that all executors share: evidence and recommendations by case, replaced together when a case is saved again, and audit rows that are only ever appended."""

    CASE = "case_id long, subject string, saved_at timestamp, n_recommendations int, top_rule string, top_score double"
    EVIDENCE = "case_id long, id string, kind string, status string, confidence double, note string"
    ADVICE = "case_id long, rank int, rule string, score double, severity string, confidence double, action string, evidence_id string, scenario string, change double, summary string, limitations array<string>"
    AUDIT = "case_id long, actor string, action string, note string, at timestamp"

    def __init__(self, spark: SparkSession, folder: str):
        self.spark = spark
        self.tables = {n: Table(spark, f"{folder}/{n}", s) for n, s in (("cases", self.CASE), ("evidence", self.EVIDENCE), ("recommendations", self.ADVICE), ("audits", self.AUDIT))}

    def _put(self, rows: DataFrame, name: str, case_id: int) -> None:
        table = self.tables[name]
        part = table.stage(rows.withColumn("case_id", F.lit(case_id).cast("long")), partitions=1)  # a case has a few rows

        def plan(version: int) -> Change:
            old = [p for p, e in table.parts(version).items() if e["note"].get("case") == case_id]
            return Change((part,), tuple(old), note={"case": case_id})

        table.commit(plan, restage=False)

    def save(self, case_id: int, subject: str, facts: DataFrame, at: str) -> None:
        self._put(evidence_items(facts), "evidence", case_id)
        self._put(recommend(facts), "recommendations", case_id)
        kept = self.part("recommendations", case_id)
        head = kept.agg(F.count(F.lit(1)).cast("int").alias("n_recommendations"), F.min_by("rule", "rank").alias("top_rule"), F.max("score").alias("top_score"))
        self._put(head.select(F.lit(subject).alias("subject"), F.to_timestamp(F.lit(at)).alias("saved_at"), "*"), "cases", case_id)

    def cases(self, limit: int = 50) -> DataFrame:
        """Newest first."""
        return self.tables["cases"].read().drop(VERSION).orderBy(F.desc("saved_at"), F.desc("case_id")).limit(limit)

    def part(self, name: str, case_id: int) -> DataFrame:
        """``evidence``, ``recommendations`` or ``audits`` of a case."""
        return self.tables[name].read(only=lambda e: e["note"].get("case") == case_id).drop(VERSION)

    def audit(self, case_id: int, actor: str, action: str, note: str, at: str) -> None:
        if self.part("cases", case_id).isEmpty():
            raise ValueError(f"no case {case_id}")
        row = self.spark.createDataFrame([(case_id, actor, action, note)], "case_id long, actor string, action string, note string")
        self.tables["audits"].append(row.withColumn("at", F.to_timestamp(F.lit(at))), note={"case": case_id}, partitions=1)
