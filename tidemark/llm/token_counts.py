"""Token counts as delta-maintained rollups.

Every batch writes signed rows: an insert adds its counts, a delete takes the old ones away, a
revision does both. A batch is written to a folder of its own and counts from the moment that one
row of the commit log names it, so a batch that fails half-way counts for nothing and one that is
repeated counts once. Totals by source, language and tokenizer version are sums of the batches'
small rollups; no text is read again.
"""

from __future__ import annotations

import base64
import re
import uuid
from collections.abc import Iterator
from functools import lru_cache

import pandas as pd
import tiktoken
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import saved

DEFAULT_RANKS = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: Fixed value: how the byte-level vocabulary splits text before it merges.
PATTERN = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Whole runs of very many white-space characters (Unicode's White_Space, which is what PATTERN's \s means).
LONG_RUN = re.compile("[\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]{10000,}")


@lru_cache(maxsize=4)
def encoder(ranks: bytes, pattern: str) -> tiktoken.Encoding:
    table = {base64.b64decode(a): int(b) for a, b in map(bytes.split, ranks.splitlines()) if a}
    return tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=table, special_tokens={})


def encode(enc: tiktoken.Encoding, text: str) -> list[int]:
    """The ids of a text of any length under PATTERN.

    The library's matcher looks ahead after white space with a stack that runs over on very long
    runs. PATTERN makes one token piece of such a run, but for its last character if more text
    follows, so cutting there changes no id.
    """
    out, at = [], 0
    for run in LONG_RUN.finditer(text):
        end = run.end() if run.end() == len(text) else run.end() - 1
        out += enc.encode_ordinary(text[at : run.start()])
        out += enc._encode_single_piece(text[run.start() : end])
        at = end
    return out + enc.encode_ordinary(text[at:])


def count_tokens(docs: DataFrame, version: str, ranks_path: str = DEFAULT_RANKS, pattern: str = PATTERN, doc_id: str = "doc_id", text: str = "text", source: str = "source", lang: str = "lang") -> DataFrame:
    """(doc_id, source, lang, version, n_chars, n_tokens) for every row; null and empty texts have 0 of both.

    Rows are neither dropped nor merged; other columns are not used. The vocabulary, about 1 MB, is
    broadcast. A ``pattern`` other than PATTERN must split white space alike.
    """
    with open(ranks_path, "rb") as f:
        ranks = docs.sparkSession.sparkContext.broadcast(f.read())

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        enc = encoder(ranks.value, pattern)
        for b in batches:
            yield b.assign(n_tokens=[len(encode(enc, t)) if t else 0 for t in b.pop("text")])

    rows = docs.select(
        F.col(doc_id).cast("long").alias("doc_id"), F.col(source).cast("string").alias("source"), F.col(lang).cast("string").alias("lang"),
        F.lit(version).alias("version"), F.coalesce(F.length(F.col(text).cast("string")), F.lit(0)).cast("long").alias("n_chars"), F.col(text).cast("string").alias("text"),
    )
    return rows.mapInPandas(count, "doc_id long, source string, lang string, version string, n_chars long, n_tokens long")


class TokenLedger:
    """Signed count rows and their rollups in a folder that all executors share.

    ``data/ATTEMPT/deltas`` has a row for each change (sign, doc_id, source, lang, version, n_chars,
    n_tokens), ``data/ATTEMPT/rollups`` the sums of these by source, lang and version. ``log`` has a
    row (seq, batch, kind, attempt) for each commit; a batch's attempt with the highest seq is in
    force. Batches apply in ascending id: a commit is of a new highest id, or repeats the highest
    one and replaces it whole, by nothing too; an earlier id is refused, since later batches have
    taken its counts into account. One writer at a time.

    One document is one (doc_id, version). Several rows of one such in a batch all count, as that
    many copies. Rows without a doc_id can be inserted but not revised or deleted. After every
    ``compact_every`` batches the counts in force are written as one state, so that a later batch
    reads that and the few batches since, only joined with the documents that it names.
    """

    ROW = "sign int, doc_id long, source string, lang string, version string, n_chars long, n_tokens long"
    SUM = "source string, lang string, version string, n_docs long, n_chars long, n_tokens long"
    LOG = "seq long, batch long, kind string, attempt string"
    BY = ("source", "lang", "version")
    VALUES = ("doc_id", *BY, "n_chars", "n_tokens")

    def __init__(self, spark: SparkSession, folder: str, compact_every: int = 16):
        self.spark, self.folder, self.compact_every = spark, folder, compact_every
        # Appending no rows creates the log and leaves its rows alone.
        spark.createDataFrame([], self.LOG).write.mode("append").parquet(f"{folder}/log")

    def _log(self, kind: str) -> dict[int, tuple[int, str]]:
        """{batch: (seq, attempt)} in force, ascending; a row for each batch."""
        rows = self.spark.read.schema(self.LOG).parquet(f"{self.folder}/log").filter(F.col("kind") == kind)
        last = rows.groupBy("batch").agg(F.max(F.struct("seq", "attempt")).alias("last")).orderBy("batch").collect()
        return {r["batch"]: (r["last"]["seq"], r["last"]["attempt"]) for r in last}

    def _record(self, batch: int, kind: str, attempt: str) -> None:
        seq = self.spark.read.schema(self.LOG).parquet(f"{self.folder}/log").agg(F.max("seq").alias("n")).first()["n"] or 0
        self.spark.createDataFrame([(seq + 1, batch, kind, attempt)], self.LOG).coalesce(1).write.mode("append").parquet(f"{self.folder}/log")

    def _read(self, attempts: list[str], part: str, schema: str) -> DataFrame:
        paths = [f"{self.folder}/data/{a}/{part}" for a in attempts]
        return self.spark.read.schema(schema).parquet(*paths) if paths else self.spark.createDataFrame([], schema)

    def _history(self, before: int | None) -> DataFrame:
        """Signed rows that sum to the counts in force before a batch: the newest usable state and the batches since."""
        done = {b: a for b, (_, a) in self._log("batch").items() if before is None or b < before}
        states = {b: a for b, (_, a) in self._log("state").items() if before is None or b < before}
        upto = max(states, default=None)
        since = [a for b, a in done.items() if upto is None or b > upto]
        return self._read(since if upto is None else [states[upto], *since], "deltas", self.ROW)

    def live(self, before: int | None = None, only: DataFrame | None = None) -> DataFrame:
        """Counts now in force (of batches below ``before``; of the documents ``only``, doc_id and version), with ``copies``."""
        rows = self._history(before)
        rows = rows if only is None else rows.join(only, ["doc_id", "version"], "left_semi")
        return rows.groupBy(*self.VALUES).agg(F.sum("sign").cast("int").alias("copies")).filter("copies <> 0")

    def commit(self, batch: int, counts: DataFrame | None = None, deletes: DataFrame | None = None) -> None:
        """Applies a batch: ``counts`` (rows of count_tokens) insert or revise, ``deletes`` (doc_id, version) remove; a document in both is revised. Ids that are not there are ignored."""
        done = self._log("batch")
        if batch < max(done, default=batch):
            raise ValueError(f"batch {batch} is below the last one, {max(done)}")
        attempt = f"{batch}-{uuid.uuid4().hex}"
        deltas = f"{self.folder}/data/{attempt}/deltas"
        none = self.spark.createDataFrame([], self.ROW)
        new = none if counts is None else counts.select(F.lit(1).alias("sign"), *self.VALUES)
        new.write.parquet(deltas)
        earlier = [b for b in done if b < batch]
        if earlier:
            # The ids come from the rows just written: counts are computed once.
            named = [self._read([attempt], "deltas", self.ROW)] + ([] if deletes is None else [deletes])
            only = [x.select("doc_id", "version").filter("doc_id is not null and version is not null") for x in named]
            old = self.live(batch, only[0] if deletes is None else only[0].unionByName(only[1]))
            saved(old.select((-F.col("copies")).alias("sign"), *self.VALUES)).write.mode("append").parquet(deltas)
        sums = self._read([attempt], "deltas", self.ROW).groupBy(*self.BY).agg(
            F.sum("sign").alias("n_docs"), F.sum(F.col("sign") * F.col("n_chars")).alias("n_chars"), F.sum(F.col("sign") * F.col("n_tokens")).alias("n_tokens")
        )
        sums.coalesce(1).write.parquet(f"{self.folder}/data/{attempt}/rollups")
        self._record(batch, "batch", attempt)
        state = max(self._log("state"), default=None)
        if sum(state is None or b > state for b in earlier) >= self.compact_every:
            self._compact(batch, max(earlier))

    def _compact(self, batch: int, upto: int) -> None:
        """Writes the counts in force before ``batch`` as the state of all batches up to ``upto``."""
        attempt = f"state-{upto}-{uuid.uuid4().hex}"
        rows = self.live(batch).select(F.col("copies").alias("sign"), *self.VALUES)
        rows.write.parquet(f"{self.folder}/data/{attempt}/deltas")
        self._record(upto, "state", attempt)

    def totals(self) -> DataFrame:
        """source, lang, version, n_docs, n_chars, n_tokens over all batches; groups that came to nothing are left out."""
        rows = self._read([a for _, a in self._log("batch").values()], "rollups", self.SUM)
        sums = rows.groupBy(*self.BY).agg(*[F.sum(c).alias(c) for c in ("n_docs", "n_chars", "n_tokens")])
        return sums.filter("n_docs <> 0 or n_chars <> 0 or n_tokens <> 0")
