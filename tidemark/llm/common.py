"""Shared column helpers of the training-data operators."""

from __future__ import annotations

import tempfile

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: ASCII white space: space, tab, line feed, vertical tab, form feed, carriage return.
WHITE = " \t\n\x0b\f\r"
WORD_GAP = "[\\x20\\x09-\\x0D]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def ascii_lower(text: Column) -> Column:
    """Lower-case A-Z only. Pure ASCII strings take the fast built-in."""
    ascii_only = F.length(text) == F.octet_length(text)
    return F.when(ascii_only, F.lower(text)).otherwise(F.translate(text, UPPER, LOWER))


def words(text: Column) -> Column:
    """Runs of characters that are not ASCII white space; no words: an empty array."""
    stripped = F.btrim(text, F.lit(WHITE))
    return F.when(stripped == "", F.array().cast("array<string>")).otherwise(F.split(stripped, WORD_GAP, -1))


def bind(value: Column, body) -> Column:
    """``body(value)`` with the value computed once, even where body uses it inside a lambda."""
    return F.element_at(F.transform(F.array(value), body), 1)


def whole_text(text: str) -> Column:
    return F.coalesce(F.col(text).cast("string"), F.lit(""))


def row_key(doc_id: str, text: str) -> list[Column]:
    """Three non-null columns that name a row: rows alike in id and text share them."""
    return [
        F.col(doc_id).isNotNull().alias("td_known"),
        F.coalesce(F.col(doc_id).cast("long"), F.lit(0)).alias("td_id"),
        F.xxhash64(F.col(text)).alias("td_hash"),
    ]


KEY = ["td_known", "td_id", "td_hash"]


def packed(df: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """The whole input row as one struct ``td_row`` beside its key and text, so that no input column can clash with a computed one."""
    return df.select(F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias("td_row"), *row_key(doc_id, text), whole_text(text).alias("td_text"))


def unpacked(df: DataFrame, columns: list[str], added: dict[str, Column]) -> DataFrame:
    """Input columns again, with ``added`` in place of any of the same name."""
    taken = {name.lower() for name in added}
    kept = [F.col("td_row").getField(c).alias(c) for c in columns if c.lower() not in taken]
    return df.select(*kept, *[c.alias(name) for name, c in added.items()])


def shared_folder(spark: SparkSession) -> str:
    """The folder for checkpoints: the session's own, or in local mode a new temporary one where none is set."""
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        named = sc.getConf().get("spark.checkpoint.dir", None)
        if named is None and not (sc.master == "local" or sc.master.startswith("local[")):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        sc.setCheckpointDir(named or tempfile.mkdtemp(prefix="tidemark-"))
    return sc.getCheckpointDir()


def saved(df: DataFrame) -> DataFrame:
    """Written to the shared checkpoint folder and read from there: a lost executor costs no recomputation."""
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)


def discard(spark: SparkSession, folder: str) -> None:
    """Deletes a folder that this program wrote, through the file system that Spark writes to; a missing one is fine."""
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).delete(path, True)


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def spread(df: DataFrame) -> DataFrame:
    """df dealt evenly. A join by key then shuffles both of its sides, and Spark can split a key that has very many rows on the other one."""
    return df.repartition(shuffle_partitions(df.sparkSession))


def ranged(df: DataFrame, order: list[str]) -> DataFrame:
    """df dealt by range of ``order``, with the range's number in ``td_range``; saved, so that every reader sees the same ranges."""
    n = shuffle_partitions(df.sparkSession)
    return saved(df.repartitionByRange(n, *[F.col(c) for c in order]).withColumn("td_range", F.spark_partition_id()))


def neighbours(ids: DataFrame, order: list[str], carried: list[str]) -> DataFrame:
    """Each row's successor and predecessor in the total order, as structs ``td_next`` and ``td_prev`` (the last row's successor is the first).

    Rows are ordered within ranges in parallel; only the first and last row of each range, at most
    one pair for each shuffle partition, meet in one task to close the gaps between ranges.
    """
    whole = F.struct(*order, *carried)
    dealt = ranged(ids, order)
    inner = Window.partitionBy("td_range").orderBy(*order)
    ends = dealt.groupBy("td_range").agg(F.min(whole).alias("first"), F.max(whole).alias("last"))
    line = Window.orderBy("td_range")
    every = line.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    ends = ends.select(
        "td_range",
        F.coalesce(F.lead("first").over(line), F.first("first").over(every)).alias("after"),
        F.coalesce(F.lag("last").over(line), F.last("last").over(every)).alias("before"),
    )
    return (
        dealt.select("*", F.lead(whole).over(inner).alias("td_next"), F.lag(whole).over(inner).alias("td_prev"))
        .join(F.broadcast(ends), "td_range")
        .withColumn("td_next", F.coalesce("td_next", "after"))
        .withColumn("td_prev", F.coalesce("td_prev", "before"))
        .drop("td_range", "after", "before")
    )


def group_ranks(df: DataFrame, group: str, order: list[str]) -> DataFrame:
    """1-based rank ``td_rank`` of each row within its group, for groups of any size.

    The rows are dealt by range of (group, order), so one large group spreads over many ranges; a
    row's rank is its place within its range and group plus the group's rows in earlier ranges.
    """
    dealt = ranged(df, [group, *order])
    inner = Window.partitionBy("td_range", group).orderBy(*order)
    counts = dealt.groupBy("td_range", group).agg(F.count(F.lit(1)).alias("n"))
    earlier = Window.partitionBy(group).orderBy("td_range").rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.select(F.col("td_range").alias("r"), F.col(group).alias("g"), F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("before"))
    return (
        dealt.withColumn("place", F.row_number().over(inner))
        .join(counts, (F.col("td_range") == F.col("r")) & F.col(group).eqNullSafe(F.col("g")))
        .withColumn("td_rank", F.col("place") + F.col("before"))
        .drop("td_range", "place", "r", "g", "before")
    )
