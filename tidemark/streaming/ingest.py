"""Streaming ingestion: files in, each row once, bad rows apart, jobs replayable, cancelled between batches."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from tidemark.functions.ranks import saved
from tidemark.sources.clean import deduplicate, row_hash, split_valid
from tidemark.sources.files import append_job
from tidemark.sources.records import lines_of
from tidemark.sources.row_keys import RowKeys
from tidemark.sources.versions import Change, Table

BAD = "_corrupt_record"
METRICS = "rows long, written long, duplicates long, malformed long, incomplete long"


def read_folder(spark: SparkSession, path: str, schema: str, fmt: str = "csv", files_per_batch: int | None = None) -> DataFrame:
    """New files of a folder; lines that do not fit the schema are kept in ``_corrupt_record`` if the schema has it."""
    reader = spark.readStream.schema(schema).format(fmt).option("header", True).option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", BAD)
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    return reader.load(path)


def once(rows: DataFrame, time: str | None = None, late: str = "1 day") -> DataFrame:
    """Each distinct row once, across batches; with a time column, state is dropped once the watermark passes."""
    marked = rows.withColumn("_h", row_hash(rows))
    if time is None:
        return marked.dropDuplicates(["_h"]).drop("_h")
    return marked.withWatermark(time, late).dropDuplicatesWithinWatermark(["_h"]).drop("_h")


def load(rows: DataFrame, table: str, checkpoint: str) -> StreamingQuery:
    """Writes each micro-batch as a job of its own; a replayed batch replaces its rows."""

    def sink(batch: DataFrame, number: int) -> None:
        append_job(deduplicate(batch), table, number)

    return rows.writeStream.foreachBatch(sink).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


class Cancelled(Exception):
    """Raised between batches; the batch that was about to start is read again by the next run."""


class Changed(Exception):
    """A file of a folder is not what it was when it was first loaded."""


def digests(spark: SparkSession, path: str) -> DataFrame:
    """(file, lines, size, h1, h2): digests of the lines of every file, made where the file is read, a range of it in a task."""
    hashed = lines_of(spark, path).select("file", F.octet_length("line").alias("size"), F.xxhash64("line").alias("a"), F.xxhash64(F.lit("second"), "line").alias("b"))
    # Sums that do not overflow: the same lines in another order are the same file, repeated ones count.
    return hashed.groupBy("file").agg(F.count(F.lit(1)).alias("lines"), F.sum("size").alias("size"), F.sum(F.col("a").cast("decimal(20,0)")).alias("h1"), F.sum(F.col("b").cast("decimal(20,0)")).alias("h2"))


class Manifest:
    """What was in the files of a folder when they were first loaded, in a versioned table. A resume is bound to it."""

    ROW = "file string, lines long, size long, h1 decimal(38,0), h2 decimal(38,0)"

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.table = spark, Table(spark, f"{folder}/manifest", self.ROW)

    def bind(self, path: str) -> list[str]:
        """Takes up the files of ``path`` that are new and returns them; Changed if one that was known has other lines now. Files that are gone stay known."""
        new: list[str] = []

        def plan(version: int) -> Change:
            nonlocal new
            now = saved(digests(self.spark, path))
            known = self.table.read(version).select("file", F.struct("lines", "size", "h1", "h2").alias("was"))
            j = saved(now.join(known, "file", "left").withColumn("differs", ~F.col("was").eqNullSafe(F.struct("lines", "size", "h1", F.col("h2").cast("decimal(38,0)").alias("h2")).cast("struct<lines:long,size:long,h1:decimal(38,0),h2:decimal(38,0)>"))))
            bad = [r["file"] for r in j.filter("was is not null and differs").select("file").orderBy("file").limit(20).collect()]
            if bad:
                raise Changed(f"changed since they were loaded: {', '.join(bad)}")
            fresh = j.filter("was is null").select("file", "lines", "size", "h1", "h2")
            new = [r["file"] for r in fresh.select("file").orderBy("file").collect()]  # a row a new file
            return Change((self.table.stage(fresh, partitions=1),)) if new else Change()

        self.table.commit(plan)
        return new


def load_checked(rows: DataFrame, folder: str, required: list[str], cancelled: Callable[[], bool] = lambda: False, source: str | None = None, keys: RowKeys | None = None) -> StreamingQuery:
    """Loads a stream batch by batch into ``folder``: ``table`` for good rows, ``dead_letters`` for lines that did not parse and rows without a required value (as JSON, with the reason), ``metrics`` with a row of counts; each batch is a partition of all three.

    A batch that is replayed after a failure replaces its partitions, so a restart goes on where the
    last committed batch ended. ``cancelled`` is asked before each batch. With ``source``, the path of the stream's files, a
    start is bound to what those files held when they were first loaded (``Manifest``). The counts are observed while
    the rows are written: the batch is read once, and kept for the dead letters. With ``keys`` (of this stream alone, as
    its batches are numbered from 0), rows that an earlier batch has brought are duplicates too.
    """
    if source is not None:
        Manifest(rows.sparkSession, folder).bind(source)

    def sink(batch: DataFrame, number: int) -> None:
        if cancelled():
            raise Cancelled(f"cancelled before batch {number}")
        batch = batch.persist()
        try:
            columns = [c for c in batch.columns if c != BAD]
            lost = F.col(BAD).isNotNull() if BAD in batch.columns else F.lit(False)
            gap = F.lit(False)
            for c in required:
                gap = gap | F.col(f"`{c}`").isNull()
            seen, kept = Observation(), Observation()
            counts = [F.count(F.lit(1)).alias("rows"), F.count_if(lost).alias("malformed"), F.count_if(~lost & gap).alias("incomplete")]
            good, _ = split_valid(batch.observe(seen, *counts).filter(~lost).select(*columns), required)
            if keys is None:
                fresh = deduplicate(good)
            else:
                plain, _ = split_valid(batch.filter(~lost).select(*columns), required)  # not observed: looked up before the write
                known = keys.known_of(plain, number)
                fresh = keys.unseen(good, number, known)
            append_job(fresh.observe(kept, F.count(F.lit(1)).alias("written")), f"{folder}/table", number)
            if keys is not None:
                keys.add(keys.unseen(plain, number, known), number)
            _, incomplete = split_valid(batch.filter(~lost).select(*columns), required)
            letters = incomplete.select("row", F.concat(F.lit("missing: "), "missing").alias("reason"))
            if BAD in batch.columns:
                letters = letters.unionByName(batch.filter(lost).select(F.col(BAD).alias("row"), F.lit("malformed").alias("reason")))
            append_job(letters, f"{folder}/dead_letters", number)
            m = seen.get | kept.get
            told = (m["rows"], m["written"], m["rows"] - m["malformed"] - m["incomplete"] - m["written"], m["malformed"], m["incomplete"])
            append_job(batch.sparkSession.createDataFrame([told], METRICS).coalesce(1), f"{folder}/metrics", number)
        finally:
            batch.unpersist()

    return rows.writeStream.foreachBatch(sink).option("checkpointLocation", f"{folder}/checkpoint").trigger(availableNow=True).start()
