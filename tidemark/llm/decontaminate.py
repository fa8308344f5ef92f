"""Benchmark decontamination by pigeonhole edit matching.

An item within k edits of some stretch of a document, cut into k + 1 pieces, has at least one piece
there unchanged. Each task finds all piece hits of a whole text with one automaton and verifies
them with Myers' bit-parallel edit distance over the stretches that the hits imply. The benchmark
is the query set: it is broadcast in blocks of a bounded number of characters, one at a time, and
every block passes over every document.
"""

from __future__ import annotations

import re
import uuid
from collections.abc import Iterator

import ahocorasick
import pandas as pd
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import KEY, packed, row_key, saved, unpacked, whole_text

_OTHER = re.compile(r"[\W_]+")


def normal(text: str | None) -> str:
    """Lower case, letters and digits only, words parted by one space."""
    return _OTHER.sub(" ", (text or "").lower()).strip()


def pieces(item: str, budget: int) -> list[tuple[int, str]]:
    """(offset, piece): ``budget + 1`` pieces of nearly equal length that make up the item."""
    cuts = [round(i * len(item) / (budget + 1)) for i in range(budget + 2)]
    return [(a, item[a:b]) for a, b in zip(cuts, cuts[1:], strict=False) if b > a]


def best_match(item: str, text: str, budget: int) -> tuple[int, int]:
    """(distance, end): least edit distance between the item and any stretch of the text, and where the stretch ends; distances over the budget may come back as budget + 1. Myers 1999, one word of len(item) bits."""
    masks: dict[str, int] = {}
    for i, c in enumerate(item):
        masks[c] = masks.get(c, 0) | 1 << i
    m = len(item)
    full, top = (1 << m) - 1, 1 << (m - 1)
    pv, mv, now, best, end = full, 0, m, budget + 1, -1
    get = masks.get
    for j, c in enumerate(text):
        eq = get(c, 0)
        xv = eq | mv
        xh = (((eq & pv) + pv) ^ pv) | eq
        ph = mv | (full & ~(xh | pv))
        mh = pv & xh
        if ph & top:
            now += 1
        elif mh & top:
            now -= 1
        ph = (ph << 1) & full  # a match may begin anywhere: row 0 stays 0
        pv = ((mh << 1) & full) | (full & ~(xv | ph))
        mv = ph & xv
        if now < best:
            best, end = now, j + 1
            if not best:
                break
    return best, end


class Matcher:
    """Finds the items of one block in normalised texts: within their budgets, and those without a budget letter by letter between word borders.

    The hits of an item's pieces name stretches of the text where it may be. Stretches that touch are
    one, so an item's distance is computed over no place of a text twice, however often its pieces recur.
    """

    def __init__(self, items: list[tuple[int, str]], error_rate: float):
        self.items = [(i, t, int(len(t) * error_rate)) for i, t in items]
        #: piece: {item: (least, largest offset of the piece in the item)}
        found: dict[str, dict[int, tuple[int, int]]] = {}
        for k, (_, t, budget) in enumerate(self.items):
            for at, piece in pieces(t, budget) if budget else [(0, f" {t} ")]:
                where = found.setdefault(piece, {})
                lo, hi = where.get(k, (at, at))
                where[k] = (min(lo, at), max(hi, at))
        self.automaton = ahocorasick.Automaton()
        for piece, where in found.items():
            self.automaton.add_word(piece, (len(piece), [(k, lo, hi) for k, (lo, hi) in where.items()]))
        if found:
            self.automaton.make_automaton()

    def find(self, text: str) -> dict[int, int]:
        """{item id: least distance} of the items within their budgets in the normalised text."""
        hits: dict[int, int] = {}
        if not self.items or not text:
            return hits
        text = f" {text} "
        stretches: dict[int, list[list[int]]] = {}
        for end, (size, where) in self.automaton.iter(text):
            begin = end + 1 - size
            for k, lo, hi in where:
                ident, item, budget = self.items[k]
                if not budget:
                    hits[ident] = 0
                    continue
                first, last = begin - hi - budget, begin - lo + len(item) + budget
                known = stretches.get(k)
                if known is None:
                    stretches[k] = [[first, last]]
                elif first <= known[-1][1]:
                    known[-1] = [min(first, known[-1][0]), max(last, known[-1][1])]
                else:
                    known.append([first, last])
        for k, known in stretches.items():
            ident, item, budget = self.items[k]
            best = hits.get(ident, budget + 1)
            for first, last in joined(known):
                if not best:
                    break
                stretch = text[max(0, first) : last]
                best = min(best, 0 if item in stretch else best_match(item, stretch, budget)[0])
            if best <= budget:
                hits[ident] = best
        return hits


def joined(stretches: list[list[int]]) -> list[list[int]]:
    """The same places as disjoint stretches in order."""
    out: list[list[int]] = []
    for first, last in sorted(stretches):
        if out and first <= out[-1][1]:
            out[-1][1] = max(out[-1][1], last)
        else:
            out.append([first, last])
    return out


def read_blocks(benchmark: DataFrame, item_id: str, text: str, block_chars: int) -> Iterator[list[tuple[int, str]]]:
    """The benchmark's normalised items that are not empty, in blocks of about ``block_chars`` characters; the driver holds one block and one partition of the table at a time."""
    block, size = [], 0
    for r in benchmark.select(F.col(item_id).cast("long").alias("id"), whole_text(text).alias("t")).filter("id is not null").toLocalIterator():
        if t := normal(r["t"]):
            block.append((r["id"], t))
            size += len(t)
            if size >= block_chars:
                yield sorted(set(block))
                block, size = [], 0
    yield sorted(set(block))


FOUND = "hits array<struct<item:long,distance:int>>"
#: The matcher that this worker process used last, by the name of its block: tasks of one scan build it once a process.
_KNOWN: dict[str, Matcher] = {}


def _matcher(name: str, shared: Broadcast, error_rate: float) -> Matcher:
    if name not in _KNOWN:
        _KNOWN.clear()
        _KNOWN[name] = Matcher(shared.value, error_rate)
    return _KNOWN[name]


def _scan(rows: DataFrame, shared: Broadcast, error_rate: float) -> DataFrame:
    name = uuid.uuid4().hex

    def scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        matcher = _matcher(name, shared, error_rate)
        for b in batches:
            texts = b.pop("text")
            yield b.assign(hits=[[{"item": i, "distance": d} for i, d in sorted(matcher.find(t).items())] for t in texts])

    return rows.mapInPandas(scan, "td_known boolean, td_id long, td_hash long, " + FOUND)


def _normal(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for b in batches:
        yield b.assign(text=[normal(t) for t in b["text"]])


def contamination(
    docs: DataFrame, benchmark: DataFrame, error_rate: float = 0.06, block_chars: int = 2_000_000, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "text"
) -> DataFrame:
    """td_known, td_id, td_hash (each row's key) and ``hits``, array of (item, distance): items with at most ``error_rate`` x length edits, rounded down, somewhere in the whole text.

    Both sides are lower-cased and reduced to letters, digits and single spaces first. An item too
    short for one edit must occur exactly and as whole words, so a benchmark should hold no items that
    any text holds by chance. Null and empty texts and an empty benchmark give no hits; items
    without an id or a letter or digit are not searched; items with the same id count as one, by the
    best of them. One row for each input row, repeated rows included; other columns are not used.

    Every block of the benchmark passes over all documents. With several blocks the normalised texts
    are written once, as much as the input again, and each block is a job of its own
    that leaves only the rows with hits; its broadcast is destroyed before the next.
    """
    sc = docs.sparkSession.sparkContext
    rows = docs.select(*row_key(doc_id, text), F.col(text).cast("string").alias("text")).mapInPandas(_normal, "td_known boolean, td_id long, td_hash long, text string")
    blocks = read_blocks(benchmark, item_id, item_text, block_chars)
    block, after = next(blocks), next(blocks, None)
    if after is None:
        return _scan(rows, sc.broadcast(block), error_rate)
    rows, found = saved(rows), None
    while block is not None:
        shared = sc.broadcast(block)
        part = saved(_scan(rows, shared, error_rate).filter("size(hits) > 0"))
        shared.destroy()
        found = part if found is None else found.unionByName(part)
        block, after = after, next(blocks, None)
    best = found.select(*KEY, F.explode("hits").alias("h")).groupBy(*KEY, F.col("h.item").alias("item")).agg(F.min("h.distance").alias("distance"))
    several = best.groupBy(*KEY).agg(F.sort_array(F.collect_list(F.struct("item", "distance"))).alias("hits"))
    return rows.select(*KEY).join(several, KEY, "left").select(*KEY, F.coalesce("hits", F.array().cast("array<struct<item:long,distance:int>>")).alias("hits"))


def decontaminate(docs: DataFrame, benchmark: DataFrame, doc_id: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """The input rows in which no benchmark item is found. Null and empty texts stay, repeated rows stay or go alike."""
    bad = contamination(docs, benchmark, doc_id=doc_id, text=text, **options).filter(F.size("hits") > 0).select(*KEY)
    return unpacked(packed(docs, doc_id, text).join(bad, KEY, "left_anti"), docs.columns, {})
