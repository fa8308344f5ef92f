"""Dataset catalog: schema versions, column registry, quality runs and their history."""

from __future__ import annotations

import hashlib

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import quality

VERSIONS = "dataset string, version int, schema_hash string, row_count long"


def schema_hash(df: DataFrame) -> str:
    """SHA-256 of the columns as name:type lines in order of name: the order of columns makes no other schema."""
    return hashlib.sha256("\n".join(sorted(f"{c}:{t}" for c, t in df.dtypes)).encode()).hexdigest()


def register_version(versions: DataFrame, dataset: str, df: DataFrame, row_count: int) -> DataFrame:
    """versions with one more for the dataset, numbered from 1, unless its newest has the same schema already."""
    digest = schema_hash(df)
    new = F.struct(F.lit(dataset).alias("dataset"), F.lit(digest).alias("schema_hash"))
    last = versions.filter(F.col("dataset") == dataset).agg(F.max(F.struct("version", "schema_hash")).alias("last"))
    fresh = last.filter(F.col("last").isNull() | (F.col("last.schema_hash") != digest)).select(
        new["dataset"].alias("dataset"), (F.coalesce(F.col("last.version"), F.lit(0)) + 1).cast("int").alias("version"), new["schema_hash"].alias("schema_hash"), F.lit(row_count).cast("long").alias("row_count")
    )
    return versions.unionByName(fresh)


def sync_columns(registry: DataFrame, dataset: str, profile: DataFrame) -> DataFrame:
    """registry (dataset, column, and any of dtype, distinct_count, null_pct, min_value, max_value and annotations) with the statistics of a ``quality.profile``; what people have written about a column stays, and so do columns that are gone."""
    stats = profile.select(
        F.lit(dataset).alias("dataset"), "column", "dtype", F.col("distinct").cast("long").alias("distinct_count"), F.round(F.col("missing_pct") / 100, 4).alias("null_pct"), F.col("smallest").alias("min_value"), F.col("largest").alias("max_value")
    )
    fresh = [c for c in stats.columns if c not in ("dataset", "column")]
    notes = [c for c in registry.columns if c not in stats.columns]
    old = registry.select("dataset", "column", F.lit(True).alias("_old"), *[F.col(c).alias(f"_{c}") for c in registry.columns if c not in ("dataset", "column")])
    j = stats.withColumn("_new", F.lit(True)).join(old, ["dataset", "column"], "full")
    value = lambda c: F.when(F.col("_new"), F.col(c)).otherwise(F.col(f"_{c}") if c in registry.columns else F.lit(None)).alias(c)
    return j.select("dataset", "column", *[value(c) for c in fresh], *[F.col(f"_{c}").alias(c) for c in notes])


def record_run(results: DataFrame, dataset: str, run_id: int, at: str) -> tuple[DataFrame, DataFrame]:
    """(run, findings) of the results of ``quality.evaluate``: one row with score and verdict, and a row for each rule that did not pass."""
    key = [F.lit(dataset).alias("dataset"), F.lit(run_id).cast("long").alias("run_id")]
    run = quality.verdict(results).select(*key, F.to_timestamp(F.lit(at)).alias("created_at"), "score", "verdict")
    return run, results.filter(~F.col("passed")).select(*key, "rule_id", "column", F.col("failures").alias("count"))


def run_detail(runs: DataFrame, findings: DataFrame, run_id: int) -> DataFrame:
    """The run with ``findings``, array of (rule_id, column, count) in order of rule; no such run, no row."""
    found = findings.filter(F.col("run_id") == run_id).groupBy("run_id").agg(F.sort_array(F.collect_list(F.struct("rule_id", "column", "count"))).alias("findings"))
    none = F.array().cast("array<struct<rule_id:string,column:string,count:bigint>>")
    return runs.filter(F.col("run_id") == run_id).join(found, "run_id", "left").withColumn("findings", F.coalesce("findings", none))


def history(runs: DataFrame, limit: int = 50, dataset: str | None = None) -> DataFrame:
    """The newest ``limit`` (1 to 200) runs of each dataset, newest first."""
    runs = runs if dataset is None else runs.filter(F.col("dataset") == dataset)
    w = Window.partitionBy("dataset").orderBy(F.desc("run_id"))
    return runs.withColumn("_r", F.row_number().over(w)).filter(F.col("_r") <= max(1, min(200, limit))).drop("_r").orderBy("dataset", F.desc("run_id"))


def trend(runs: DataFrame, limit: int = 20) -> DataFrame:
    """(dataset, runs, first_score, last_score, delta, direction) over the newest ``limit`` runs: improving, degrading or stable; one run alone is stable with a delta of 0."""
    g = history(runs, limit).groupBy("dataset").agg(F.count(F.lit(1)).alias("runs"), F.min_by("score", "run_id").alias("first_score"), F.max_by("score", "run_id").alias("last_score"))
    delta = F.round(F.col("last_score") - F.col("first_score"), 4)
    direction = F.when(delta > 1e-9, "improving").when(delta < -1e-9, "degrading").otherwise("stable")
    return g.select("dataset", "runs", "first_score", "last_score", delta.alias("delta"), direction.alias("direction"))


def resolve_rules(profile: str | None, ad_hoc: list[quality.Rule] | None = None) -> list[quality.Rule]:
    """The rules of a named profile and then the caller's own; an unknown profile or no rules at all is a ValueError."""
    if profile and profile not in quality.PROFILES:
        raise ValueError(f"unknown profile {profile!r}; one of {', '.join(sorted(quality.PROFILES))}")
    rules = [*(quality.PROFILES[profile] if profile else ()), *(ad_hoc or ())]
    if not rules:
        raise ValueError("a profile or rules are needed")
    return rules
