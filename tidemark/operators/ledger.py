"""Ledgers: AI usage and cost, budgets, jobs, conversations, model registry."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions import ranks


def estimate_tokens(text: Column) -> Column:
    """A quarter of the characters, at least 1; no text: 0."""
    n = F.length(text)
    return F.when(F.coalesce(n, F.lit(0)) == 0, 0).otherwise(F.greatest(F.lit(1), F.floor(n / 4).cast("int")))


def record_usage(turns: DataFrame, prices: DataFrame) -> DataFrame:
    """Usage rows of answered turns (conversation_id, model, prompt, answer, prompt_tokens, completion_tokens, created_at): the provider's counts where it gave any, else the estimate from the text; the cost from prices (model, input_price, output_price for 1,000 tokens), null for a model without one."""
    n = lambda given, text: F.coalesce(F.col(given), estimate_tokens(F.col(text))).cast("long")
    t = turns.select("conversation_id", "model", n("prompt_tokens", "prompt").alias("prompt_tokens"), n("completion_tokens", "answer").alias("completion_tokens"), "created_at")
    per = prices.groupBy("model").agg(F.min("input_price").alias("_in"), F.min("output_price").alias("_out"))
    cost = (F.col("prompt_tokens") * F.col("_in") + F.col("completion_tokens") * F.col("_out")) / 1000
    return t.join(per, "model", "left").select(*t.columns, F.round(cost, 6).cast("decimal(18,6)").alias("estimated_cost"))


def documents(docs: DataFrame, chunks: DataFrame, limit: int = 100) -> DataFrame:
    """docs (doc_id, title, visibility, created_at, ...), newest first, with their effective visibility and number of chunks."""
    from .retrieval import visibility

    n = chunks.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n_chunks"))
    out = docs.join(n, "doc_id", "left").withColumn("visibility", visibility(F.col("visibility"))).withColumn("n_chunks", F.coalesce("n_chunks", F.lit(0)))
    return out.orderBy(F.desc("created_at"), F.desc("doc_id")).limit(max(1, min(500, limit)))


def _sums() -> list[Column]:
    cost = F.col("estimated_cost").cast("decimal(18,6)")
    return [
        F.count(F.lit(1)).alias("turns"), F.coalesce(F.sum("prompt_tokens"), F.lit(0)).alias("prompt_tokens"), F.coalesce(F.sum("completion_tokens"), F.lit(0)).alias("completion_tokens"),
        F.coalesce(F.sum(F.coalesce("prompt_tokens", F.lit(0)) + F.coalesce("completion_tokens", F.lit(0))), F.lit(0)).alias("total_tokens"),
        F.round(F.coalesce(F.sum(cost), F.lit(0).cast("decimal(18,6)")), 6).cast("double").alias("estimated_cost"), F.count_if(F.col("estimated_cost").isNull()).alias("unpriced_rows"),
    ]


def usage_totals(usage: DataFrame) -> DataFrame:
    """turns, prompt_tokens, completion_tokens, total_tokens, estimated_cost (priced rows only), unpriced_rows."""
    return usage.agg(*_sums())


def usage_by(usage: DataFrame, *keys: str) -> DataFrame:
    return usage.groupBy(*keys).agg(*_sums())


def budget_gate(usage: DataFrame, budget: float, as_of: str, days: int = 30) -> DataFrame:
    """One row: spent over the last ``days`` days, budget, blocked; a budget of 0 or less never blocks."""
    recent = usage.filter(F.col("created_at") >= F.date_sub(F.to_date(F.lit(as_of)), days))
    spent = F.round(F.coalesce(F.sum(F.col("estimated_cost").cast("decimal(18,6)")), F.lit(0).cast("decimal(18,6)")), 6).cast("double")
    return recent.agg(spent.alias("spent")).select("spent", F.lit(float(budget)).alias("budget"), (F.lit(budget > 0) & (F.col("spent") >= budget)).alias("blocked"))


def last_turns(conversations: DataFrame, n: int = 10) -> DataFrame:
    """The last n turns of each conversation, with ``place``, 1 for the oldest of them; oldest first."""
    w = Window.partitionBy("conv_id")
    last = conversations.withColumn("_r", F.row_number().over(w.orderBy(F.desc("turn"), F.desc("role")))).filter(F.col("_r") <= n).drop("_r")
    return last.withColumn("place", F.row_number().over(w.orderBy("turn", "role"))).orderBy("conv_id", "place")


def job_status(jobs: DataFrame, as_of: str, stuck_hours: int = 24) -> DataFrame:
    """status, jobs, stuck (running longer than ``stuck_hours``), last_day."""
    now = F.to_timestamp(F.lit(as_of))
    hours = (F.unix_timestamp(now) - F.unix_timestamp("started_at")) / 3600
    return jobs.groupBy("status").agg(F.count(F.lit(1)).alias("jobs"), F.count_if((F.col("status") == "running") & (hours > stuck_hours)).alias("stuck"), F.count_if(hours.between(0, 24)).alias("last_day"))


def latest(df: DataFrame, key: str, order: list[str], value: str, out: str) -> DataFrame:
    """(key, out): the value of each key's newest row, by ``order``."""
    return df.groupBy(key).agg(F.max_by(F.col(value), F.struct(*order)).alias(out))


def next_version(versions: DataFrame) -> DataFrame:
    """(model, next_version): the highest numeric suffix of v<number> plus 1."""
    n = F.expr("try_cast(regexp_extract(version, '^v([0-9]+)$', 1) as int)")
    return versions.groupBy("model").agg(F.concat(F.lit("v"), (F.coalesce(F.max(n), F.lit(0)) + 1).cast("string")).alias("next_version"))


def deployment_status(versions: DataFrame, events: DataFrame) -> DataFrame:
    """(model, version, status, n_events): the newest event's ``to_status``, PENDING where there is none. events: event_id, model, version, to_status."""
    last = events.groupBy("model", "version").agg(F.max_by("to_status", "event_id").alias("status"), F.count(F.lit(1)).alias("n_events"))
    return versions.select("model", "version").join(last, ["model", "version"], "left").select("model", "version", F.coalesce("status", F.lit("PENDING")).alias("status"), F.coalesce("n_events", F.lit(0)).alias("n_events"))


def event_trail(events: DataFrame, model: str) -> DataFrame:
    """A model's events, oldest first."""
    return events.filter(F.col("model") == model).orderBy("event_id")


def status_counts(datasets: DataFrame) -> DataFrame:
    """One row: datasets, rows and mean score in all, and the number of datasets by status."""
    count = lambda s: F.count_if(F.col("status") == s).alias(s)
    return datasets.agg(F.count(F.lit(1)).alias("datasets"), *[count(s) for s in ("pending", "running", "committed", "failed")], F.round(F.avg("score"), 4).alias("mean_score"))


def rank_experiments(runs: DataFrame, metric: str, higher_is_better: bool = True) -> DataFrame:
    """runs with rank 1.. by a metric, unmeasured ones last; ties by run_id."""
    order = F.desc_nulls_last(metric) if higher_is_better else F.asc_nulls_last(metric)
    return ranks.running(runs, [order, F.col("run_id")], rank="rank").withColumn("rank", F.col("rank").cast("int"))


def stale(datasets: DataFrame, as_of: str, days: int = 7) -> DataFrame:
    """Committed datasets without a score, never checked, or checked over ``days`` days ago; never checked first."""
    old = F.col("checked_at") < F.date_sub(F.to_date(F.lit(as_of)), days)
    return datasets.filter((F.col("status") == "committed") & (F.col("score").isNull() | F.col("checked_at").isNull() | old)).orderBy(F.asc_nulls_first("checked_at"), "dataset")


def contract_check(datasets: DataFrame, as_of: str) -> DataFrame:
    """dataset, schema_ok, fresh, quality_ok, passed: schema hash as agreed, age within sla_hours (default 72), score at the threshold or above."""
    age = (F.unix_timestamp(F.to_timestamp(F.lit(as_of))) - F.unix_timestamp("loaded_at")) / 3600
    s = F.coalesce(F.col("schema_hash") == F.col("agreed_hash"), F.lit(False))
    f = F.coalesce(age <= F.coalesce("sla_hours", F.lit(72)), F.lit(False))
    q = F.coalesce(F.col("score") >= F.col("min_score"), F.lit(False))
    health = F.when(s & f & q, "healthy").when(~s | (~f & ~q), "critical").otherwise("degraded")
    return datasets.select("dataset", F.round(age, 2).alias("age_hours"), s.alias("schema_ok"), f.alias("fresh"), q.alias("quality_ok"), (s & f & q).alias("passed"), health.alias("health"))
