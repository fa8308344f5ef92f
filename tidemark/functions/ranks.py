"""Ranks, running sums and exact quantiles over whole tables without a single-task window.

Rows are dealt by range of the order, sorted within ranges in parallel, and each range is shifted by
what the ranges before it hold. Only one row for each range (and group) meets in one task.
"""

from __future__ import annotations

import tempfile

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def shared_folder(spark: SparkSession) -> str:
    """The folder that the cluster names in spark.checkpoint.dir, or, in local mode without one, a new temporary folder."""
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        folder = sc.getConf().get("spark.checkpoint.dir", None)
        if folder is None and not (sc.master == "local" or sc.master.startswith("local[")):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        sc.setCheckpointDir(folder or tempfile.mkdtemp(prefix="tidemark-"))
    return sc.getCheckpointDir()


def saved(df: DataFrame) -> DataFrame:
    """A checkpoint in the shared folder: range numbers must not change between readers."""
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)


def _parts(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def running(df: DataFrame, order: list[str | Column], rank: str | None = None, sums: dict[str, str] | None = None, group: str | None = None) -> DataFrame:
    """df with ``rank``, the 1-based place of each row in ``order`` (a total order) within its ``group``, and for each {name: column} of ``sums`` the sum of the column up to and with the row; nulls add nothing."""
    sums = sums or {}
    order = [F.col(c) if isinstance(c, str) else c for c in order]
    keys = [group] if group else []
    cols = [*([F.col(group)] if group else []), *order]
    dealt = saved(df.repartitionByRange(_parts(df.sparkSession), *cols).withColumn("_range", F.spark_partition_id()))
    inner = Window.partitionBy("_range", *keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    add = {"_n": F.lit(1), **{f"_s_{name}": F.coalesce(F.col(c), F.lit(0)) for name, c in sums.items()}}
    ends = dealt.groupBy("_range", *keys).agg(*[F.sum(c).alias(name) for name, c in add.items()])
    earlier = Window.partitionBy(*keys).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    shift = ends.select("_range", *[F.col(k).alias("_group") for k in keys], *[F.coalesce(F.sum(name).over(earlier), F.lit(0)).alias(f"{name}_before") for name in add])
    mine = dealt.select("*", *[F.sum(c).over(inner).alias(name) for name, c in add.items()])
    match = mine["_range"] == shift["_range"]
    if group:
        match = match & mine[group].eqNullSafe(shift["_group"])
    out = mine.join(F.broadcast(shift) if not group else shift, match).drop(shift["_range"])
    named = ([(rank, "_n")] if rank else []) + [(name, f"_s_{name}") for name in sums]
    return out.select(*df.columns, *[(F.col(c) + F.col(f"{c}_before")).alias(name) for name, c in named])


def one_row(df: DataFrame, *aggregates: Column) -> DataFrame:
    """The aggregates over all rows as a broadcast row, to be joined with crossJoin."""
    return F.broadcast(df.agg(*aggregates))


def quantiles(df: DataFrame, columns: list[Column], at: list[float]) -> DataFrame:
    """One row with ``q{i}``, array<double> of exact linearly interpolated quantiles of the i-th column, and ``k{i}``, its number of values; nulls are left out, and no values give nulls and 0.

    Distinct values with their counts are ranked by range, all columns in one pass, so no task holds
    all values of a column.
    """
    pairs = df.select(F.explode(F.array(*[F.struct(F.lit(i).alias("i"), c.cast("double").alias("v")) for i, c in enumerate(columns)])).alias("x")).select("x.i", "x.v")
    rows = quantiles_of(pairs.filter("v is not null").groupBy("i", "v").agg(F.count(F.lit(1)).alias("n")), at)
    mine = lambda i, c: F.max(F.when(F.col("i") == i, F.col(c)))
    return rows.agg(*[x for i in range(len(columns)) for x in (mine(i, "q").alias(f"q{i}"), F.coalesce(mine(i, "total"), F.lit(0)).alias(f"k{i}"))])


def quantiles_of(hist: DataFrame, at: list[float]) -> DataFrame:
    """(i, total, q): for every i of a histogram (i, v, n) of distinct values, their number and the array of exact linearly interpolated quantiles."""
    ranked = running(hist, ["v"], sums={"upto": "n"}, group="i")
    totals = F.broadcast(ranked.groupBy("i").agg(F.max("upto").alias("total")))  # a row a column
    place = lambda p: F.lit(p) * (F.col("total") - 1)
    # A value covers the places upto - n to upto - 1, counted from 0.
    holds = lambda x: (x >= F.col("upto") - F.col("n")) & (x < F.col("upto"))
    picked = [F.max(F.when(holds(f(place(p))), F.col("v"))).alias(f"{name}{j}") for j, p in enumerate(at) for name, f in (("lo", F.floor), ("hi", F.ceil))]
    rows = ranked.join(totals, "i").groupBy("i", "total").agg(*picked)
    blend = [F.col(f"lo{j}") + (F.col(f"hi{j}") - F.col(f"lo{j}")) * (place(p) - F.floor(place(p))) for j, p in enumerate(at)]
    return rows.select("i", "total", F.array(*blend).alias("q"))


def row_digest(columns: list[str]) -> list[Column]:
    """Two 64-bit hashes of whole rows, nulls told apart from values in other places: rows alike share both."""
    values = [x for c in columns for x in (F.col(f"`{c}`"), F.col(f"`{c}`").isNull())]
    return [F.xxhash64(*values).alias("_h1"), F.xxhash64(F.lit("second"), *values).alias("_h2")]
