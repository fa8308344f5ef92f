"""Lineage: reachable nodes over an edge list, a join a hop."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions import ranks


def reachable(edges: DataFrame, start: DataFrame, depth: int = 10, downstream: bool = True) -> DataFrame:
    """(node, hops) within ``depth`` (1 to 10) hops of the start nodes (node), each at its least distance, cycles included once.

    ``edges`` has source and target. Every hop is one join of the frontier with the edges and one
    anti join with what was reached; the loop ends early where nothing new is reached.
    """
    a, b = ("source", "target") if downstream else ("target", "source")
    step = edges.select(F.col(a).alias("node"), F.col(b).alias("next")).distinct()
    seen = start.select("node").distinct().withColumn("hops", F.lit(0))
    frontier = seen
    for hop in range(1, max(1, min(10, depth)) + 1):
        new = frontier.select("node").join(step, "node").select(F.col("next").alias("node")).distinct().join(seen, "node", "left_anti").withColumn("hops", F.lit(hop))
        new = ranks.saved(new)  # read by the next hop and by the result, with a short lineage
        if new.isEmpty():
            break
        seen, frontier = seen.unionByName(new), new
    return seen.filter("hops > 0")


def mapping_edges(mapping: dict[str, str], source: str, target: str) -> list[tuple[str, str, str]]:
    """(source column, target column, transform) of a column mapping, sorted."""
    return sorted((f"{source}.{a}", f"{target}.{b}", "rename" if a != b else "copy") for a, b in mapping.items())


def column_lineage(spark: SparkSession, mapping: dict[str, str], source: str, target: str, run: str) -> DataFrame:
    """Edges (source, target, transform, run) of a column mapping, to be appended to a lineage table and walked with ``reachable``."""
    rows = [(a, b, how, run) for a, b, how in mapping_edges(mapping, source, target)]
    return spark.createDataFrame(rows, "source string, target string, transform string, run string")
