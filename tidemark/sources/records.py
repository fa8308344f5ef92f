"""Delimited files cut into true records in parallel.

Spark deals out byte ranges of a file and cuts them at line feeds, but a line feed within quotes ends
no record. So each range is first summed up as a function: for every state in which it may begin, the
state in which it ends. Composed from the first range on, these give each range its true state,
and the ranges are then cut into records independently. A record over the border of two ranges leaves
each as a fragment; fragments are put together by the range in which their record begins.

UTF-16 is read the same way: the number of bytes before a range tells whether it begins within a
code unit, and as ranges begin after a byte 0A, the missing half is known.
"""

from __future__ import annotations

import codecs
import csv
import io
import sys
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.functions.ranks import saved

#: Where a reader of records can be: at a record's start, at a later field's, in a plain field, within quotes, after a quote within quotes.
RECORD, FIELD, PLAIN, QUOTED, AFTER = STATES = "NFUQE"
QUOTE, LF = b'"', b"\n"
#: Place of a fragment that begins a file's header.
HEADER = -1
#: Records longer than this are bad rows, a fragment each, so that an open quote cannot bring a whole file together.
MOST_BYTES = 64 << 20


def step(state: str, piece: bytes, sep: bytes) -> str:
    """The state after a piece that has a line feed at its end at most. As Python's csv module reads: a quote opens a field only at its start, two quotes within quotes are one."""
    ends = piece.endswith(LF)
    if QUOTE not in piece:
        if state == QUOTED:
            return QUOTED
        return RECORD if ends else FIELD if piece.endswith(sep) else PLAIN if piece else state
    body, at = piece[:-1] if ends else piece, 0
    if state == AFTER:
        state, at = (QUOTED, 1) if body.startswith(QUOTE) else (PLAIN, 0)
    elif state in (RECORD, FIELD):
        state, at = (QUOTED, 1) if body.startswith(QUOTE) else (PLAIN, 0)
    while True:
        if state == QUOTED:
            q = body.find(QUOTE, at)
            if q < 0:
                break
            if q + 1 == len(body):
                state = AFTER
                break
            at = q + 2 if body[q + 1 : q + 2] == QUOTE else q + 1
            state = QUOTED if at == q + 2 else PLAIN
        else:
            opened = [p for p in (body.find(sep + QUOTE, at), body.find(b"\r" + QUOTE, at)) if p >= 0]
            if not opened:
                state = FIELD if body.endswith(sep) else PLAIN
                break
            state, at = QUOTED, min(opened) + 2
    return (QUOTED if state == QUOTED else RECORD) if ends else state


def pieces(lines: Iterator[bytes], encoding: str, odd: bool) -> Iterator[bytes]:
    """The range's lines as UTF-8 or single-byte text with their line feeds; for UTF-16 decoded from the first whole code unit, which may leave a last piece without one."""
    if not encoding.startswith("UTF-16"):
        for line in lines:
            yield line + LF
        return
    decoder = codecs.getincrementaldecoder("utf-16-be" if encoding == "UTF-16BE" else "utf-16-le")("surrogatepass")
    rest, held = LF if odd else b"", ""
    for line in lines:
        held += decoder.decode(rest + line + LF)
        rest = b""
        while (cut := held.find("\n")) >= 0:
            yield held[: cut + 1].encode("utf-8", "surrogatepass")
            held = held[cut + 1 :]
    # A half code unit is the next range's, half of a pair is not.
    last = decoder.getstate()[0]
    held += last[: len(last) // 2 * 2].decode("utf-16-be" if encoding == "UTF-16BE" else "utf-16-le", "surrogatepass")
    if held:
        yield held.encode("utf-8", "surrogatepass")


def _ranges(batches: Iterator[pd.DataFrame], *names: str) -> Iterator[tuple[tuple, Iterator[bytes]]]:
    """(values of ``names``, lines) for each run of rows of the same file and range."""
    rows = ((tuple(r[:-1]), bytes(r[-1])) for b in batches for r in zip(*(b[n] for n in names), b["line"], strict=True))
    row = next(rows, None)
    while row is not None:
        key = row[0]

        def same(key: tuple = key) -> Iterator[bytes]:
            nonlocal row
            while row is not None and row[0] == key:
                line = row[1]
                row = next(rows, None)
                yield line

        lines = same()
        yield key, lines
        for _ in lines:  # what the reader of the range left
            pass


class Format:
    """What is known of the files: encoding, delimiter, names of the columns."""

    def __init__(self, encoding: str, sep: str, names: list[str]):
        self.encoding, self.sep, self.names = encoding, sep.encode(), names

    def summary(self, batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """For each range: the state after it for every state before it, and for each whether a record ends in the range."""
        for (file, start, odd), lines in _ranges(batches, "file", "start", "odd"):
            now, ended = dict(zip(STATES, STATES, strict=True)), dict.fromkeys(STATES, "0")
            for piece in pieces(lines, self.encoding, odd):
                after = {s: step(s, piece, self.sep) for s in set(now.values())}
                for s in STATES:
                    now[s] = after[now[s]]
                    ended[s] = "1" if now[s] == RECORD else ended[s]
            yield pd.DataFrame({"file": [file], "start": [start], "after": ["".join(now.values())], "ended": ["".join(ended.values())]})

    def parse(self, record: bytes) -> tuple[list[list[str | None]], list[str]]:
        """(rows, bad texts) of one record; lone carriage returns can make it several rows."""
        try:
            if self.encoding.startswith("UTF-16"):
                text = record.decode("utf-8", "surrogatepass").encode("utf-16-le", "surrogatepass").decode("utf-16-le")
            else:
                text = record.decode(self.encoding)
        except UnicodeDecodeError:
            return [], [record.decode("utf-8", "backslashreplace").rstrip("\r\n")]
        good, bad = [], []
        for row in csv.reader(io.StringIO(text, newline=""), delimiter=self.sep.decode()):
            if len(row) > len(self.names):
                bad.append(text.rstrip("\r\n"))
            elif any(row):
                good.append([x or None for x in row] + [None] * (len(self.names) - len(row)))
        return good, bad

    def out(self, rows: list, bad: list[str], parts: list[tuple]) -> pd.DataFrame:
        """Rows, then bad lines, then fragments (file, rec, start, place, data), in the columns of ``schema``."""
        width = len(self.names)
        whole = [(*r, None, None, None, None, None, None) for r in rows] + [(*[None] * width, b, None, None, None, None, None) for b in bad] + [(*[None] * width, None, *p) for p in parts]
        return pd.DataFrame(whole, columns=[*[f"c{i}" for i in range(width)], "bad", "file", "rec", "start", "place", "data"], dtype=object)

    @property
    def schema(self) -> str:
        return "".join(f"c{i} string, " for i in range(len(self.names))) + "bad string, file string, rec long, start long, place int, data binary"

    def cut(self, batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """Rows, bad lines and fragments of each range, from its true state. The first record of a file is its header."""
        csv.field_size_limit(sys.maxsize)
        for (file, start, odd, state, rec, first), lines in _ranges(batches, "file", "start", "odd", "state", "rec", "first"):
            rows, bad, held, skip = [], [], [], first
            inside = state != RECORD  # still in a record of an earlier range
            for piece in pieces(lines, self.encoding, odd):
                state = step(state, piece, self.sep)
                held.append(piece)
                if state != RECORD:
                    continue
                record, held = b"".join(held), []
                if inside:
                    yield self.out([], [], [(file, rec, start, 0, record)])
                    inside = False
                elif skip:
                    skip = False
                else:
                    more, lost = self.parse(record)
                    rows += more
                    bad += lost
                if len(rows) + len(bad) >= 5000:
                    yield self.out(rows, bad, [])
                    rows, bad = [], []
            if held:
                place = HEADER if skip and not inside else 1
                yield self.out(rows, bad, [(file, rec if inside else start, start, place, b"".join(held))])
            elif rows or bad:
                yield self.out(rows, bad, [])

    def join(self, batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """Rows and bad lines of records put together from fragments; one whose quotes never close is bad."""
        csv.field_size_limit(sys.maxsize)
        for b in batches:
            for fragments in b["fragments"]:
                if fragments[0]["place"] == HEADER:
                    continue
                record, state = b"".join(bytes(x["data"]) for x in fragments), RECORD
                for piece in record.splitlines(keepends=True) if b"\r" not in record else [x + LF for x in record.split(LF)]:
                    state = step(state, piece, self.sep)
                if state == QUOTED:
                    yield self.out([], [record.decode("utf-8", "backslashreplace").rstrip("\r\n")], [])
                else:
                    yield self.out(*self.parse(record), [])


def lines_of(spark: SparkSession, path: str) -> DataFrame:
    """(file, start, line): the bytes between line feeds, and where the range of the file begins in which a line is; rows keep their order within a range."""
    # The suffix does not matter, and folders of part files count as one input.
    return spark.read.option("lineSep", "\n").text(path).select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("start"), F.col("value").cast("binary").alias("line"))


def summed(spark: SparkSession, path: str) -> DataFrame:
    """A row a range: (file, start, lines, size, quotes, broken), where ``broken`` counts lines that are no UTF-8. Native: bytes are counted where they are read."""
    text = F.col("line").cast("string")
    counts = F.octet_length("line") - F.octet_length(F.replace(text, F.lit('"'), F.lit("")))
    return lines_of(spark, path).groupBy("file", "start").agg(F.count(F.lit(1)).alias("lines"), F.sum(F.octet_length("line") + 1).alias("size"), F.sum(counts).alias("quotes"), F.count_if(~F.is_valid_utf8(text)).alias("broken"))


def _states(splits: pd.DataFrame) -> pd.DataFrame:
    """The state in which each range of a file begins, and the range where a record begins that is open there."""
    splits = splits.sort_values("start")
    state, rec, out = RECORD, -1, []
    for start, after, ended in zip(splits["start"], splits["after"], splits["ended"], strict=True):
        out.append((state, rec))
        if after is None:  # no quotes: whole lines, which change nothing
            continue
        at = STATES.index(state)
        rec = start if state == RECORD or ended[at] == "1" else rec
        state = after[at]
    return splits[["file", "start"]].assign(odd=splits["odd"], state=[s for s, _ in out], rec=[r for _, r in out], first=splits["start"] == splits["start"].min())


def read_records(spark: SparkSession, path: str, layout: Format, splits: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(rows of strings, bad lines) of delimited files by true records; ``splits`` is the saved result of ``summed``.

    A row with too few values has nulls for the rest, one with too many is bad, and so is a record with
    bytes outside the encoding, with a quote that never closes, or over MOST_BYTES across ranges.
    """
    lines = lines_of(spark, path)
    before = Window.partitionBy("file").orderBy("start").rowsBetween(Window.unboundedPreceding, -1)
    wide = layout.encoding.startswith("UTF-16")
    splits = splits.select("file", "start", (F.coalesce(F.sum("size").over(before), F.lit(0)) % 2 == 1).alias("odd"))
    known = F.broadcast(splits)  # a row a range of the input
    told = lines if wide else lines.filter(F.contains(F.col("line").cast("string"), F.lit('"')))
    summary = told.join(known, ["file", "start"]).select("file", "start", "odd", "line").mapInPandas(layout.summary, "file string, start long, after string, ended string")
    states = saved(splits.join(summary, ["file", "start"], "left").groupBy("file").applyInPandas(_states, "file string, start long, odd boolean, state string, rec long, first boolean"))
    whole = lines.join(F.broadcast(states), ["file", "start"]).select("file", "start", "odd", "state", "rec", "first", "line").mapInPandas(layout.cut, layout.schema)
    # Only ranges at a border within a record leave fragments; the last range of a file can too, if a quote stays open.
    parts = saved(whole.filter("data is not null").select("file", "rec", "start", "place", "data"))
    sized = parts.withColumn("whole", F.sum(F.octet_length("data")).over(Window.partitionBy("file", "rec")))
    fit = sized.filter(F.col("whole") <= MOST_BYTES).groupBy("file", "rec").agg(F.sort_array(F.collect_list(F.struct("start", "place", "data"))).alias("fragments"))
    mended = fit.select("fragments").mapInPandas(layout.join, layout.schema)
    large = sized.filter(F.col("whole") > MOST_BYTES).select(F.make_valid_utf8(F.col("data").cast("string")).alias("line"))
    names = [F.col(f"c{i}").alias(n) for i, n in enumerate(layout.names)]
    good = whole.unionByName(mended).filter("bad is null and data is null").select(*names)
    return good, whole.unionByName(mended).filter("bad is not null").select(F.col("bad").alias("line")).unionByName(large)


def header(sample: bytes, encoding: str, sep: str) -> list[str]:
    """Names of the columns from the first record; unnamed ones are _c and their place, repeated ones get their place added."""
    text = sample.decode("utf-16" if encoding == "UTF-16" else encoding, "ignore").lstrip("﻿")
    row = next((r for r in csv.reader(io.StringIO(text, newline=""), delimiter=sep)), [])
    names, seen = [], set()
    for i, name in enumerate(row):
        name = name or f"_c{i}"
        name = f"{name}{i}" if name.lower() in seen else name
        seen.add(name.lower())
        names.append(name)
    return names


def typed(rows: DataFrame, bad: DataFrame, schema: T.StructType) -> tuple[DataFrame, DataFrame]:
    """Rows of strings, by place, as ``schema`` has them; a row with a value that its type cannot hold is bad, as JSON."""
    cells = [(F.col(f"`{c}`"), f) for c, f in zip(rows.columns, schema.fields, strict=False)]
    values = [(c.try_cast(f.dataType) if not isinstance(f.dataType, T.StringType) else c).alias(f.name) for c, f in cells]
    missing = [F.lit(None).cast(f.dataType).alias(f.name) for f in schema.fields[len(cells) :]]
    fails = F.lit(False)
    for (c, _), v in zip(cells, values, strict=True):
        fails = fails | (c.isNotNull() & v.isNull())
    lost = rows.filter(fails).select(F.to_json(F.struct("*")).alias("line"))
    return rows.filter(~fails).select(*values, *missing), bad.unionByName(lost)
