"""Cleaning, row hashes and dead letters of an import."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MEASURES = ("quantity", "selling_price", "discount", "revenue", "cost", "amount", "stock_qty", "cost_price")


def blank_to_null(c: Column) -> Column:
    t = F.trim(c.cast("string"))
    return F.when(F.lower(t).isin("", "nan", "none"), F.lit(None)).otherwise(t)


def clean(df: DataFrame) -> DataFrame:
    """Names and texts trimmed, blanks and nan and None null, ``date`` columns parsed (else null), measures as numbers (else 0), revenue derived where all rows state 0."""
    out = df.select(*[F.col(f"`{c}`").alias(c.strip()) for c in df.columns])
    for c in out.columns:
        v = blank_to_null(F.col(f"`{c}`"))
        if "date" in c.lower():
            v = F.expr(f"cast(try_to_timestamp(nullif(trim(cast(`{c}` as string)), '')) as date)")
        elif c in MEASURES:
            v = F.coalesce(F.expr(f"try_cast(cast(`{c}` as string) as double)"), F.lit(0.0))
            v = F.when(F.isnan(v), 0.0).otherwise(v)
        out = out.withColumn(c, v)
    if {"quantity", "selling_price"} <= set(out.columns):
        derived = F.col("quantity") * F.col("selling_price") - (F.col("discount") if "discount" in out.columns else F.lit(0.0))
        if "revenue" not in out.columns:
            return out.withColumn("revenue", derived)
        top = out.agg(F.max(F.abs("revenue")).alias("_top"))
        out = out.crossJoin(F.broadcast(top)).withColumn("revenue", F.when(F.coalesce("_top", F.lit(0.0)) == 0, derived).otherwise(F.col("revenue"))).drop("_top")
    return out


def row_hash(df: DataFrame) -> Column:
    """SHA-256 of a row's values in column order, each led by its length, so that no two rows of different values read alike; null differs from empty."""
    text = [F.col(f"`{c}`").cast("string") for c in df.columns]
    return F.sha2(F.concat(*[F.coalesce(F.concat(F.length(t).cast("string"), F.lit(":"), t), F.lit("-")) for t in text]), 256)


def deduplicate(df: DataFrame) -> DataFrame:
    """One of each set of equal rows."""
    return df.withColumn("_h", row_hash(df)).dropDuplicates(["_h"]).drop("_h")


def split_valid(df: DataFrame, required: list[str]) -> tuple[DataFrame, DataFrame]:
    """(good, dead letters): rows with every required value, and the others as JSON with the names of what is missing."""
    gap = F.array_compact(F.array(*[F.when(F.col(f"`{c}`").isNull(), F.lit(c)) for c in required]))
    marked = df.withColumn("_gap", gap)
    good = marked.filter(F.size("_gap") == 0).drop("_gap")
    dead = marked.filter(F.size("_gap") > 0).select(F.to_json(F.struct(*[F.col(f"`{c}`") for c in df.columns])).alias("row"), F.array_join("_gap", ",").alias("missing"))
    return good, dead
