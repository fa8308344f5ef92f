"""KPI values, thresholds and comparisons."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.sources.versions import VERSION, Table

from .rollup import Rollup

VALUES = ("revenue", "orders", "units", "aov", "growth_pct", "margin_pct", "total_revenue", "total_cogs", "total_expenses", "gross_profit", "net_profit")


@dataclass(frozen=True)
class Definition:
    """A KPI with thresholds. ``up``: higher is better."""

    name: str
    unit: str
    target: float
    warn: float | None
    crit: float | None
    up: bool = True

    def __post_init__(self):
        if not self.name.strip():
            raise ValueError("a KPI needs a name")


#: The built-in KPI targets and thresholds.
BUILTIN = (
    Definition("revenue", "IDR", 10000000.0, 8000000.0, 5000000.0),
    Definition("orders", "orders", 400.0, 300.0, 150.0),
    Definition("units", "units", 900.0, 700.0, 400.0),
    Definition("aov", "IDR", 10000.0, 5000.0, 2000.0),
    Definition("growth_pct", "%", 5.0, 0.0, -5.0),
    Definition("margin_pct", "%", 15.0, 8.0, 0.0),
    Definition("net_profit", "IDR", 1500000.0, 800000.0, 0.0),
    Definition("gross_profit", "IDR", 3000000.0, 2000000.0, 500000.0),
)


def registry(own: tuple[Definition, ...] = ()) -> dict[str, Definition]:
    """Built-in definitions with own ones over them."""
    return {d.name: d for d in (*BUILTIN, *own)}


def kpi_values(sales: DataFrame, purchases: DataFrame | None = None, expenses: DataFrame | None = None) -> DataFrame:
    """(name, value) of all eleven values, as a long frame, from one scan of the sales and a second of one day."""
    return values_of(Rollup.of(sales), purchases, expenses)


def values_of(known: Rollup, purchases: DataFrame | None = None, expenses: DataFrame | None = None) -> DataFrame:
    """``kpi_values`` from a rollup."""
    row = known.kpi().drop("margin_pct").crossJoin(known.finance(purchases, expenses))
    return row.select(F.expr(f"stack({len(VALUES)}, {', '.join(f'{v!r}, cast({v} as double)' for v in VALUES)}) as (name, value)"))


def status(value: Column, warn: Column, crit: Column, up: Column) -> Column:
    worse = lambda limit: F.coalesce(F.when(up, value < limit).otherwise(value > limit), F.lit(False))
    return F.when(worse(crit), "crit").when(worse(warn), "warn").otherwise("ok")


def evaluate(spark: SparkSession, values: DataFrame, own: tuple[Definition, ...] = ()) -> DataFrame:
    """name, value, target, unit, status, breach; values without a definition are ok."""
    defs = spark.createDataFrame([(d.name, d.unit, d.target, d.warn, d.crit, d.up) for d in registry(own).values()], "name string, unit string, target double, warn double, crit double, up boolean")
    s = status(F.col("value"), F.col("warn"), F.col("crit"), F.coalesce("up", F.lit(True)))
    return values.join(F.broadcast(defs), "name", "left").select("name", "value", "target", F.coalesce("unit", F.lit("")).alias("unit"), s.alias("status"), (s != "ok").alias("breach"))


def compare(current: DataFrame, previous: DataFrame) -> DataFrame:
    """name, current, previous, delta, delta_pct over the union of names; from nothing to something is 100 %."""
    j = current.select("name", F.col("value").alias("c")).join(previous.select("name", F.col("value").alias("p")), "name", "full")
    c, p = F.coalesce("c", F.lit(0.0)), F.coalesce("p", F.lit(0.0))
    rate = F.when(p != 0, (c - p) / F.abs(p) * 100).when(c == 0, 0.0).otherwise(100.0)
    return j.select("name", F.round(c, 2).alias("current"), F.round(p, 2).alias("previous"), F.round(c - p, 2).alias("delta"), F.round(rate, 2).alias("delta_pct"))


def compare_periods(df: DataFrame, current: Column, previous: Column) -> DataFrame:
    """Revenue, orders, units and aov of the rows in two conditions, from one scan, compared."""
    def measures(c: Column, tag: str) -> list[Column]:
        n = F.count(F.when(c, 1)).cast("double")
        r = F.coalesce(F.round(F.sum(F.when(c, F.col("revenue"))), 2).cast("double"), F.lit(0.0))
        u = F.coalesce(F.round(F.sum(F.when(c, F.col("quantity"))), 2), F.lit(0.0))
        return [r.alias(f"{tag}_revenue"), n.alias(f"{tag}_orders"), u.alias(f"{tag}_units"), F.when(n > 0, F.round(r / n, 2)).otherwise(0.0).alias(f"{tag}_aov")]

    row = df.agg(*measures(current, "c"), *measures(previous, "p"))
    names = ("revenue", "orders", "units", "aov")
    long = row.select(F.expr(f"stack(4, {', '.join(f'{n!r}, c_{n}, p_{n}' for n in names)}) as (name, c, p)"))
    return compare(long.select("name", F.col("c").alias("value")), long.select("name", F.col("p").alias("value")))


def history(snapshots: DataFrame, limit: int = 100) -> DataFrame:
    """Newest snapshots first, 1 to 1000."""
    return snapshots.orderBy(F.desc("taken_at"), "name").limit(max(1, min(1000, limit)))


class Store:
    """Own KPI definitions and snapshots of values, as versioned tables in a folder that all executors share."""

    DEFINITION = "name string, unit string, target double, warn double, crit double, up boolean, gone boolean"
    SNAPSHOT = "name string, value double, status string, taken_at timestamp"

    def __init__(self, spark: SparkSession, folder: str):
        self.spark = spark
        self._definitions, self._snapshots = Table(spark, f"{folder}/definitions", self.DEFINITION), Table(spark, f"{folder}/snapshots", self.SNAPSHOT)

    def define(self, *definitions: Definition) -> None:
        """Adds definitions; the newest of a name counts, and covers a built-in one."""
        rows = [(d.name, d.unit, float(d.target), d.warn, d.crit, d.up, False) for d in definitions]
        self._definitions.append(self.spark.createDataFrame(rows, self.DEFINITION), partitions=1)

    def remove(self, name: str) -> None:
        """Takes an own definition back; a built-in one of that name counts again."""
        self._definitions.append(self.spark.createDataFrame([(name, None, None, None, None, None, True)], self.DEFINITION), partitions=1)

    def own(self) -> tuple[Definition, ...]:
        newest = F.max_by(F.struct("unit", "target", "warn", "crit", "up", "gone"), VERSION).alias("d")
        rows = self._definitions.read().groupBy("name").agg(newest).select("name", "d.*").filter("not gone").orderBy("name").collect()  # a row a definition
        return tuple(Definition(r["name"], r["unit"], r["target"], r["warn"], r["crit"], r["up"]) for r in rows)

    def registry(self) -> dict[str, Definition]:
        return registry(self.own())

    def snapshot(self, values: DataFrame, at: str | None = None) -> DataFrame:
        """Evaluates (name, value[, taken_at]) by the definitions in force, keeps the outcome, and returns what was kept. ``at`` dates values that have no date of their own."""
        times = ["taken_at"] if "taken_at" in values.columns else []
        told = values.select("name", "value", *times) if times else values.select("name", "value", F.to_timestamp(F.lit(at)).alias("taken_at") if at else F.current_timestamp().alias("taken_at"))
        defs = self.spark.createDataFrame([(d.name, d.warn, d.crit, d.up) for d in self.registry().values()], "name string, warn double, crit double, up boolean")
        s = status(F.col("value"), F.col("warn"), F.col("crit"), F.coalesce("up", F.lit(True)))
        version = self._snapshots.append(told.join(F.broadcast(defs), "name", "left").select("name", "value", s.alias("status"), "taken_at"))
        return self._snapshots.read(version, only=lambda e: e["version"] == version).drop(VERSION)

    def history(self, limit: int = 100, name: str | None = None) -> DataFrame:
        """Newest snapshots first, 1 to 1000, of all values or one."""
        rows = self._snapshots.read().drop(VERSION)
        return history(rows if name is None else rows.filter(F.col("name") == name), limit)

    def trend(self) -> DataFrame:
        """name, oldest, newest, change of every value over all its snapshots."""
        return trend_direction(self._snapshots.read(), "name", "taken_at", "value")


def trend_direction(scores: DataFrame, key: str, order: str, value: str) -> DataFrame:
    """key, oldest, newest, change of a value over its history."""
    w = Window.partitionBy(key).orderBy(order).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    return scores.select(key, F.first(value).over(w).alias("oldest"), F.last(value).over(w).alias("newest")).distinct().withColumn("change", F.col("newest") - F.col("oldest"))
