"""Connected components by alternating large-star and small-star steps, each a pair of joins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import saved


def _state(edges: DataFrame) -> tuple[int, int]:
    row = edges.agg(F.count(F.lit(1)).alias("n"), F.expr("bit_xor(xxhash64(a, b))").alias("h")).first()
    return row["n"], row["h"] or 0


def _least(pairs: DataFrame) -> DataFrame:
    """pairs (u, v) with m, the least of u and every v that u has. The minimum is pre-aggregated, and the join can be split where one u has very many rows."""
    least = pairs.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("w"), "m")
    return pairs.join(least, F.col("u") == F.col("w")).select("u", "v", F.least("u", "m").alias("m"))


def connected(links: DataFrame, rounds: int = 60) -> DataFrame:
    """(node, label): for every node of ``links`` (a, b), the least node that it is connected with.

    Each round halves paths or better; it ends when the edges no longer change, as stars around
    each component's least node. Edges are checkpointed each round, so lineage stays short.
    """
    edges = saved(links.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    state = _state(edges)
    for _ in range(rounds):
        if not state[0]:
            break
        both = edges.select(F.col("a").alias("u"), F.col("b").alias("v")).unionByName(edges.select(F.col("b").alias("u"), F.col("a").alias("v")))
        large = _least(both).filter("v > u").select(F.col("v").alias("a"), F.col("m").alias("b")).distinct()
        down = _least(large.select(F.col("a").alias("u"), F.col("b").alias("v")))
        small = down.filter("v <> m").select(F.col("v").alias("a"), F.col("m").alias("b")).unionByName(down.select(F.col("u").alias("a"), F.col("m").alias("b")))
        edges = saved(small.filter("a <> b").distinct())
        if (now := _state(edges)) == state:
            break
        state = now
    else:
        raise RuntimeError(f"components did not settle in {rounds} rounds")
    tops = edges.select(F.col("b").alias("node")).distinct().withColumn("label", F.col("node"))
    return edges.select(F.col("a").alias("node"), F.col("b").alias("label")).unionByName(tops)
