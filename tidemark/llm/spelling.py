"""Spelling variants: two-dimensional range reporting over word lists with a wavelet matrix.

Words that differ in one edit at position i share the prefix before it and the suffix after it. The
words of one length are sorted forwards and, reversed, backwards; a prefix is an interval of the first
order, a suffix one of the second, and the words with both are the points of a rectangle. A wavelet
matrix over the permutation between the two orders reports them.

The vocabulary is dealt to tasks by pigeonhole: an edit lies in one half of the word, so the pair
agrees on the rest, which is the key. A key with more rows than ``most`` is cut into two with half
the block and so a longer rest, again and again; at a block of one position a key holds an alphabet
of words at most. Tasks build one matrix for some tens of thousands of rows of whole keys.
"""

from __future__ import annotations

import re
import zlib
from bisect import bisect_left, bisect_right
from collections import Counter
from collections.abc import Iterator
from functools import partial

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import saved, shuffle_partitions, spread

RUN = re.compile("[a-zÀ-ÿ]+")
#: Distinct words that a task counts before it hands the counts on.
HELD = 200_000


def runs(text: str | None) -> list[str]:
    """Maximal runs of Latin-1 letters (and the two signs among them), with A-Z lower-cased."""
    return RUN.findall((text or "").encode("utf-8", "surrogatepass").lower().decode("utf-8", "surrogatepass"))


def damaged(run: str, seed: int, every: int) -> str:
    """The run without one of its code points if ``every`` divides its hash. ``seed`` is the CRC-32 of what stands before the run."""
    h = zlib.crc32(run.encode(), seed)
    if h % every:
        return run
    at = h % len(run)
    return run[:at] + run[at + 1 :]


def _counted(batches: Iterator[pd.DataFrame], every: int, shortest: int) -> Iterator[pd.DataFrame]:
    counts: Counter[str] = Counter()

    def out() -> pd.DataFrame:
        return pd.DataFrame({"word": list(counts.keys()), "n": list(counts.values())})

    for b in batches:
        for ident, text in zip(b["id"], b["text"], strict=True):
            seed = zlib.crc32(f"{ident}:".encode())
            for run, n in Counter(runs(text)).items():
                word = damaged(run, seed, every) if every else run
                if len(word) >= shortest:
                    counts[word] += n
            if len(counts) >= HELD:
                yield out()
                counts.clear()
    if counts:
        yield out()


def vocabulary(docs: DataFrame, every: int = 199, shortest: int = 6, fewest: int = 5, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(word, n): words of at least ``shortest`` code points with at least ``fewest`` occurrences in all whole texts.

    ``every`` plants misspellings: of the distinct runs of a document about one in so many loses a code
    point; 0 plants none. Rows without an id use an empty one, null texts have no words.
    """
    rows = docs.select(F.coalesce(F.col(doc_id).cast("string"), F.lit("")).alias("id"), F.col(text).cast("string").alias("text")).filter("text is not null")
    parts = rows.mapInPandas(partial(_counted, every=every, shortest=shortest), "word string, n long")
    return parts.groupBy("word").agg(F.sum("n").alias("n")).filter(F.col("n") >= fewest)


class WaveletMatrix:
    """Range reporting over a permutation of 0 .. n-1."""

    def __init__(self, values: np.ndarray):
        self.bits = max(1, int(len(values) - 1).bit_length())
        self.ones, self.zeros = [], []
        now = values.astype(np.int64)
        for level in range(self.bits - 1, -1, -1):
            bit = (now >> level) & 1
            self.ones.append(np.concatenate(([0], np.cumsum(bit))))  # ones before each place
            self.zeros.append(len(now) - int(bit.sum()))
            now = np.concatenate((now[bit == 0], now[bit == 1]))

    def report(self, lo: np.ndarray, hi: np.ndarray, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(rectangle, value) of every point with lo <= place < hi and low <= value < high; all rectangles descend together, a level at a time, and empty branches end."""
        of, value = np.arange(len(lo)), np.zeros(len(lo), np.int64)
        for k in range(self.bits):
            shift = self.bits - 1 - k
            ones, zeros = self.ones[k], self.zeros[k]
            a, b = ones[lo], ones[hi]
            left = (of, value, lo - a, hi - b)
            right = (of, value | (1 << shift), zeros + a, zeros + b)
            of, value, lo, hi = (np.concatenate(x) for x in zip(left, right, strict=True))
            open_ = (lo < hi) & (value < high[of]) & (value + (1 << shift) > low[of])
            of, value, lo, hi = of[open_], value[open_], lo[open_], hi[open_]
        return of, value


def near_pairs(groups: list[tuple[int, int, int, list[tuple[str, bool]]]]) -> Iterator[tuple[str, str]]:
    """(word, near word of the key's length) for groups of (length, a, b, rows): the pairs with exactly one replaced code point, or one inserted into the word, at a position from a to b - 1.

    A row is (word, whole): whole ones have the length and are searched in; the others are one code point
    shorter and are only looked up. All words of a group agree outside the block from a to b. An insertion into a run
    of the same letter counts at its first position, so every pair comes once.
    """
    forward: list[str] = []
    spans = []
    for _, _, _, rows in groups:
        start = len(forward)
        forward += sorted(w for w, whole in rows if whole)
        spans.append((start, len(forward)))
    if not forward:
        return
    # The second order: the same groups one after the other, each by its reversed words.
    backward = np.concatenate([np.array(sorted(range(s, e), key=lambda i: forward[i][::-1]), np.int64) for s, e in spans])
    place = np.empty(len(forward), np.int64)
    place[backward] = np.arange(len(forward))
    order = backward.tolist()

    asked: list[tuple[str, int, bool]] = []
    boxes: list[tuple[int, int, int, int]] = []
    for (length, a, b, rows), (start, end) in zip(groups, spans, strict=True):
        if end == start or len(rows) < 2:
            continue
        for word, whole in rows:
            short = 0 if whole else 1
            # Intervals of the prefixes before a, a + 1, ...: each is cut from the one before by one letter.
            prefixes, lo, hi = [], start, end
            for i in range(a, b):
                prefixes.append((lo, hi))
                if i + 1 < b:
                    c, at = word[i], lambda w, i=i: w[i]
                    lo, hi = bisect_left(forward, c, lo, hi, key=at), bisect_right(forward, c, lo, hi, key=at)
                if hi - lo < (1 if short else 2):  # only the word itself is left
                    break
            lo, hi = start, end
            for i in range(b - 1, a - 1, -1):  # suffixes after i, from the shortest
                if i - a < len(prefixes):
                    boxes.append((*prefixes[i - a], lo, hi))
                    asked.append((word, i, whole))
                if i > a:
                    c, at = word[i - short], lambda k, i=i: forward[k][i]
                    lo, hi = bisect_left(order, c, lo, hi, key=at), bisect_right(order, c, lo, hi, key=at)
                if hi - lo < (1 if short else 2):
                    break
    if not boxes:
        return
    matrix = WaveletMatrix(place)
    for at in range(0, len(boxes), HELD):
        box = np.array(boxes[at : at + HELD])
        for k, v in zip(*(x.tolist() for x in matrix.report(*box.T)), strict=True):
            word, i, whole = asked[at + k]
            near = forward[order[v]]
            if near != word if whole else not i or near[i - 1] != near[i]:
                yield word, near


def _best(counts: dict[str, int], pairs: Iterator[tuple[str, str]]) -> pd.DataFrame:
    """The pairs as rows (word, n_near, form_n, form): for each word how many near words these pairs give it and the best of them."""
    best: dict[str, tuple[int, int, str]] = {}

    def add(word: str, near: str) -> None:
        n, most, form = best.get(word, (0, 0, ""))
        other = counts[near]
        if other > most or other == most and near < form:
            most, form = other, near
        best[word] = (n + 1, most, form)

    for word, near in pairs:
        add(word, near)
        if len(word) != len(near):  # a replacement is reported from both of its words
            add(near, word)
    return pd.DataFrame([(w, *x) for w, x in best.items()], columns=["word", "n_near", "form_n", "form"])


def _found(counts: dict[str, int], groups: list[tuple[int, int, int, list[tuple[str, bool]]]]) -> Iterator[pd.DataFrame]:
    found = _best(counts, near_pairs(groups))
    if len(found):
        yield found


def _searched(batches: Iterator[pd.DataFrame], chunk: int) -> Iterator[pd.DataFrame]:
    """Near words of each run of rows of the same key; rows come sorted by it. Whole keys are searched together, about ``chunk`` rows at a time."""
    groups: list[tuple[int, int, int, list[tuple[str, bool]]]] = []
    counts: dict[str, int] = {}
    key, held = None, 0
    for batch in batches:
        for length, a, b, rest, word, n, whole in zip(*(batch[c] for c in ("length", "a", "b", "rest", "word", "n", "whole")), strict=True):
            if (length, a, b, rest) != key:
                if held >= chunk:
                    yield from _found(counts, groups)
                    groups, counts, held = [], {}, 0
                key = (length, a, b, rest)
                groups.append((length, a, b, []))
            groups[-1][3].append((word, whole))
            counts[word] = n
            held += 1
    yield from _found(counts, groups)


def _keyed(rows: DataFrame) -> DataFrame:
    """Rows with ``rest``, what every word of the key has outside the block from a to b of the key's length."""
    tail = F.substring("word", F.col("b") + F.when(F.col("whole"), 1).otherwise(0), F.length("word"))
    return rows.withColumn("rest", F.concat(F.substring("word", F.lit(1), F.col("a")), F.lit("\n"), tail))


def dealt(words: DataFrame, most: int) -> DataFrame:
    """Each word under the keys where its near words are: (length, a, b, rest, word, n, whole), with at most ``most`` rows a key or a block of one position."""
    length = F.length("word")
    half = lambda x: F.floor(x / 2).cast("int")
    blocks = lambda x: F.array(F.struct(F.lit(0).alias("a"), half(x).alias("b")), F.struct(half(x).alias("a"), x.alias("b")))
    sides = F.array(F.struct(length.alias("length"), F.lit(True).alias("whole")), F.struct((length + 1).alias("length"), F.lit(False).alias("whole")))
    rows = words.select("word", "n", F.explode(sides).alias("s")).select("word", "n", "s.*").select("*", F.explode(blocks(F.col("length"))).alias("e"))
    rows = _keyed(rows.select("word", "n", "length", "whole", F.col("e.a").alias("a"), F.col("e.b").alias("b")))
    key, done = ["length", "a", "b", "rest"], None
    while True:
        heavy = saved(rows.groupBy(*key).agg(F.count(F.lit(1)).alias("rows")).filter((F.col("rows") > most) & (F.col("b") - F.col("a") > 1)).drop("rows"))
        if heavy.isEmpty():
            return rows if done is None else done.unionByName(rows)
        light = rows.join(spread(heavy), key, "left_anti")
        done = light if done is None else done.unionByName(light)
        middle = half(F.col("a") + F.col("b"))
        cut = F.array(F.struct(F.col("a"), middle.alias("b")), F.struct(middle.alias("a"), F.col("b")))
        cut = rows.join(spread(heavy), key).select("word", "n", "length", "whole", F.explode(cut).alias("e"))
        rows = saved(_keyed(cut.select("word", "n", "length", "whole", F.col("e.a").alias("a"), F.col("e.b").alias("b"))))


def near_words(words: DataFrame, most: int = 20_000, chunk: int = 50_000) -> DataFrame:
    """(word, n_near, form_n, form) for the words that have near ones: those that differ by exactly one inserted, deleted or replaced code point, how many, and the one of largest n (ties: smallest by code point)."""
    rows = dealt(words, most).repartition(shuffle_partitions(words.sparkSession), "length", "a", "b", "rest").sortWithinPartitions("length", "a", "b", "rest")
    found = rows.mapInPandas(partial(_searched, chunk=chunk), "word string, n_near long, form_n long, form string")
    best = F.min(F.struct((-F.col("form_n")).alias("less"), "form")).alias("best")
    return found.groupBy("word").agg(F.sum("n_near").alias("n_near"), best).select("word", "n_near", (-F.col("best.less")).alias("form_n"), F.col("best.form").alias("form"))


def roots(forms: DataFrame, rounds: int = 40) -> DataFrame:
    """(word, root) for rows (word, form) whose chains end: each round doubles the steps that are followed."""
    at = saved(forms.select("word", F.col("form").alias("root")))
    for _ in range(rounds):
        further = at.select(F.col("word").alias("mid"), F.col("root").alias("next"))
        step = saved(at.join(spread(further), at["root"] == further["mid"], "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")))
        at = step.select("word", "root")
        if step.filter("moved").isEmpty():
            return at
    raise RuntimeError(f"chains of forms did not end in {rounds} rounds")


def group_variants(docs: DataFrame, every: int = 199, shortest: int = 6, fewest: int = 5, ratio: int = 5, most: int = 20_000, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row for each word of the vocabulary: ``word``, ``form``, ``root``, ``n``, ``n_near``, ``form_n``.

    ``form`` is the near word of largest n, if that is at least ``ratio`` times the word's n, and ``root``
    the end of the chain of forms (the word itself without a form). A form's n grows at every step, so chains end.
    Repeated rows count as often as they occur; null and empty texts and an empty table give no words.
    """
    words = saved(vocabulary(docs, every, shortest, fewest, doc_id, text))
    joined = words.join(near_words(words, most), "word", "left")
    good = F.col("form_n") >= ratio * F.col("n")
    named = saved(joined.select("word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.when(good, F.col("form")).alias("form"), F.when(good, F.col("form_n")).alias("form_n")))
    ends = roots(named.filter("form is not null"))
    return named.join(ends, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
