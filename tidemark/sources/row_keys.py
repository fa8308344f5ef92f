"""Keys of all rows that were ever loaded, so that a later job leaves out what an earlier one has brought.

Two versioned tables: the SHA-256 keys, sorted so that files hold ranges of their first byte, and a Bloom filter over them, cut
into blocks of 256 bits that are rows of four longs. A filter row stands for some sixteen keys, so a job joins
its rows with a small table; only what the filter takes for known is looked up among the keys, in the ranges where
it can be, and what is not found there was a false positive and is new. Filters add up by OR, a part a job.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions.ranks import saved

from .clean import row_hash
from .versions import Change, Table

#: Bits of the filter for a key at full capacity, bits that a key sets, and bits of a block.
PER_KEY, HASHES, BLOCK = 16, 8, 256
WORDS = [f"w{i}" for i in range(BLOCK // 64)]
#: Parts of a filter that are left side by side before they are merged.
LOOSE = 16


def _words(h: str) -> list[Column]:
    """The four longs of a key's bits within its block."""
    x = F.xxhash64(F.lit("bits"), h)
    places = [F.shiftrightunsigned(x, 8 * i).bitwiseAND(F.lit(BLOCK - 1)) for i in range(HASHES)]
    out = []
    for i, name in enumerate(WORDS):
        word = F.lit(0).cast("long")
        for p in places:
            bit = F.call_function("shiftleft", F.lit(1).cast("long"), p.bitwiseAND(F.lit(63)).cast("int"))
            word = word.bitwiseOR(F.when(F.shiftright(p, 6) == i, bit).otherwise(F.lit(0).cast("long")))
        out.append(word.alias(name))
    return out


def _range(h: str) -> Column:
    """The first byte of a key, 0 to 255."""
    return F.conv(F.hex(F.substring(h, 1, 1)), 16, 10).cast("int")


class RowKeys:
    """Durable row keys in a folder that all executors share. ``capacity``: keys for which the filter is made at first; beyond it, it is made anew at double the size.

    One job at a time; a job that failed is to be run again before the next, as its rows may stand without keys.
    """

    def __init__(self, spark: SparkSession, folder: str, capacity: int = 1_000_000):
        self.spark, self.capacity = spark, max(1, capacity)
        self.keys = Table(spark, f"{folder}/keys", "first int, h binary")
        self.filter = Table(spark, f"{folder}/filter", "block long, " + ", ".join(f"{w} long" for w in WORDS))

    def size(self) -> int:
        """Keys that are held."""
        return sum(e["note"]["n"] for e in self.keys.parts().values())

    def _blocks(self) -> int:
        notes = [e["note"]["blocks"] for e in self.filter.parts().values()]
        return notes[0] if notes else -(-self.capacity * PER_KEY // BLOCK)

    @staticmethod
    def _bits(keys: DataFrame, blocks: int) -> DataFrame:
        of = keys.select(F.pmod(F.xxhash64("h"), F.lit(blocks)).alias("block"), *_words("h"))
        return of.groupBy("block").agg(*[F.bit_or(w).alias(w) for w in WORDS])

    def suspects(self, keys: DataFrame) -> DataFrame:
        """Those of keys (h, ...) that the filter takes for known: all that are, and few that are not."""
        held = self.filter.read().groupBy("block").agg(*[F.bit_or(w).alias(f"_{w}") for w in WORDS])
        own = keys.select("*", F.pmod(F.xxhash64("h"), F.lit(self._blocks())).alias("block"), *_words("h"))
        hit = F.lit(True)
        for w in WORDS:
            hit = hit & (F.col(w).bitwiseAND(F.col(f"_{w}")) == F.col(w))
        return own.join(held, "block").filter(hit).select(*keys.columns)

    def known(self, keys: DataFrame, job: int | None = None) -> DataFrame:
        """Those of keys (h) that jobs other than ``job`` have brought, exactly."""
        few = saved(self.suspects(keys.select("h")).distinct().withColumn("first", _range("h")))
        ranges = [r["first"] for r in few.select("first").distinct().collect()]  # 256 at most
        if not ranges:
            return few.select("h")
        held = self.keys.read(only=lambda e: e["note"]["job"] != job).filter(F.col("first").isin(*ranges))
        return few.join(held.select("first", "h"), ["first", "h"], "left_semi").select("h")

    def unseen(self, rows: DataFrame, job: int, known: DataFrame | None = None) -> DataFrame:
        """One of each set of equal rows that no other job has brought. Rows are equal if all their values are, null and empty apart; what the same job brought before does not count, so it can be run again. ``known``: what ``known_of`` returned for the rows, if it is at hand."""
        known = self.known_of(rows, job) if known is None else known
        hashed = rows.withColumn("_h", F.unhex(row_hash(rows))).dropDuplicates(["_h"])
        return hashed.join(known.withColumnRenamed("h", "_h"), "_h", "left_anti").select(*[F.col(f"`{c}`") for c in rows.columns])

    def known_of(self, rows: DataFrame, job: int) -> DataFrame:
        """Keys (h) of those rows that jobs other than ``job`` have brought, saved."""
        return saved(self.known(rows.select(F.unhex(row_hash(rows)).alias("h")), job))

    def add(self, rows: DataFrame, job: int) -> int:
        """Takes up the keys of a job's rows, in place of those it had before, and returns how many they are. The filter comes first: it may know more than the keys, never less."""
        keys = saved(rows.select(F.unhex(row_hash(rows)).alias("h")).distinct().withColumn("first", _range("h")))
        n = keys.count()
        blocks = self._blocks()
        loose = self.filter.parts()
        total = n + self.size()
        if total > blocks * BLOCK // PER_KEY:
            blocks = -(-2 * total * PER_KEY // BLOCK)
            part, gone = self.filter.stage(self._bits(self.keys.read().select("h").unionByName(keys.select("h")), blocks)), tuple(loose)
        elif len(loose) >= LOOSE:
            both = self.filter.read().select("block", *WORDS).unionByName(self._bits(keys, blocks))
            part, gone = self.filter.stage(both.groupBy("block").agg(*[F.bit_or(w).alias(w) for w in WORDS])), tuple(loose)
        else:
            part, gone = self.filter.stage(self._bits(keys, blocks)), ()
        self.filter.commit(lambda _: Change((part,), gone, note={"blocks": blocks}), restage=False)
        mine = self.keys.stage(keys.repartitionByRange("h"), sort=["h"])

        def plan(version: int) -> Change:
            before = tuple(p for p, e in self.keys.parts(version).items() if e["note"]["job"] == job)
            return Change((mine,), before, note={"job": job, "n": n})

        self.keys.commit(plan, restage=False)
        return n
