"""Exact sums and rounded shares: money is summed as decimal, ratios come last."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

MONEY = "decimal(18,4)"


def money(c: Column) -> Column:
    return c.cast(MONEY)


def total(c: Column, digits: int = 2) -> Column:
    """Sum of a decimal column, rounded, as double; no rows: 0."""
    return F.coalesce(F.round(F.sum(c), digits).cast("double"), F.lit(0.0))


def pct(part: Column, whole: Column, digits: int = 2) -> Column:
    """100 x part / whole, rounded; a whole of zero or null gives 0."""
    p, w = part.cast("double"), whole.cast("double")
    return F.when((w != 0) & p.isNotNull(), F.round(p / w * 100, digits)).otherwise(F.lit(0.0))
