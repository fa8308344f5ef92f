"""SimHash near-dedup: 64-bit fingerprints, pigeonhole blocks, Hamming check, linked components.

Two fingerprints that differ in at most 3 bits agree on at least 3 of 6 blocks, so each of the 20
choices of 3 blocks is a join key and some key brings every close pair together. Keys have 32 or 33
bits, so unrelated fingerprints seldom meet. Within a key the rows are compared in sorted runs and
only a spanning forest of the close pairs leaves the task, never all pairs of a group; keys shared by
very many fingerprints are compared in tiles spread over tasks, which is exact too.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial
from itertools import combinations

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import KEY, packed, row_key, saved, shuffle_partitions, spread, unpacked
from .components import connected

SEED = 42
#: Shingles hashed at a time, which bounds memory for very long texts.
SLAB = 50_000


def fingerprint(text: str | None, n: int = 3) -> int:
    """64-bit SimHash of the word n-shingles of a text (lower-cased A-Z, ASCII white space between words)."""
    parts = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not parts:
        return 0
    line = b" ".join(parts)
    ends = np.cumsum(np.fromiter(map(len, parts), np.int64, len(parts)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    width = min(n, len(parts))
    first, last = starts[: len(parts) - width + 1].tolist(), ends[width - 1 :].tolist()
    votes, digest = np.zeros(64, np.int64), xxhash.xxh64_intdigest
    for at in range(0, len(first), SLAB):
        h = np.array([digest(line[a:b], SEED) for a, b in zip(first[at : at + SLAB], last[at : at + SLAB], strict=True)], ">u8")
        votes += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(votes * 2 > len(first)).tobytes(), "big")


def _fingerprints(batches: Iterator[pd.DataFrame], n: int) -> Iterator[pd.DataFrame]:
    for b in batches:
        f = np.array([fingerprint(t, n) for t in b.pop("text")], np.uint64)
        yield b.assign(fp=f.view(np.int64))


def fingerprints(docs: DataFrame, n: int = 3, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(td_known, td_id, td_hash, fp): the row's key and its signed fingerprint."""
    rows = docs.select(*row_key(doc_id, text), F.col(text).cast("string").alias("text"))
    return rows.mapInPandas(partial(_fingerprints, n=n), "td_known boolean, td_id long, td_hash long, fp long")


def block_masks(bits: int, blocks: int) -> list[int]:
    """A mask for each choice of ``blocks - bits`` blocks: close pairs agree under at least one of them."""
    cuts = [round(i * 64 / blocks) for i in range(blocks + 1)]
    block = [((1 << (hi - lo)) - 1) << lo for lo, hi in zip(cuts, cuts[1:], strict=False)]
    masks = [sum(c) for c in combinations(block, blocks - bits)]
    return [m - (1 << 64) if m >> 63 else m for m in masks]


def forest(f: np.ndarray, bits: int, slab: int = 1024) -> list[tuple[int, int]]:
    """(member, smallest member of its group) for the groups that distances of at most ``bits`` form among distinct sorted fingerprints."""
    n = len(f)
    root = np.arange(n)

    def find(i: int) -> int:
        while root[i] != i:
            root[i] = root[root[i]]
            i = root[i]
        return i

    u = f.view(np.uint64)
    for at in range(0, n, slab):
        mine = u[at : at + slab]
        for to in range(0, at + 1, slab):
            i, j = np.nonzero(np.bitwise_count(mine[:, None] ^ u[None, to : to + slab]) <= bits)
            i, j = i + at, j + to
            below = j < i
            for a, b in zip(i[below].tolist(), j[below].tolist(), strict=True):
                a, b = find(a), find(b)
                if a != b:
                    root[max(a, b)] = min(a, b)
    return [(int(f[i]), int(f[r])) for i in range(n) if (r := find(i)) != i]


def _links(batches: Iterator[pd.DataFrame], bits: int) -> Iterator[pd.DataFrame]:
    """Spanning links of each run of rows with the same key; rows come sorted by key, then fingerprint."""
    names = ("choice", "block", "tile", "fp")
    kept = [np.empty(0, np.int64)] * 4

    def links(c: list[np.ndarray]) -> pd.DataFrame:
        out: list[tuple[int, int]] = []
        f = c[3]
        if len(f) > 1:
            same = (c[0][1:] == c[0][:-1]) & (c[1][1:] == c[1][:-1]) & (c[2][1:] == c[2][:-1])
            edge = np.flatnonzero(np.diff(np.concatenate(([False], same, [False])).astype(np.int8)))
            starts, ends = edge[::2], edge[1::2] + 1
            two = ends - starts == 2
            a, b = f[starts[two]], f[starts[two] + 1]
            near = (a != b) & (np.bitwise_count((a ^ b).view(np.uint64)) <= bits)
            out += zip(b[near].tolist(), a[near].tolist(), strict=True)
            for s, e in zip(starts[~two].tolist(), ends[~two].tolist(), strict=True):
                out += forest(np.unique(f[s:e]), bits)
        return pd.DataFrame(out, columns=["a", "b"], dtype=np.int64)

    for batch in batches:
        now = [np.concatenate((k, batch[x].to_numpy(np.int64))) for k, x in zip(kept, names, strict=True)]
        if not len(now[0]):
            continue
        last = (now[0] == now[0][-1]) & (now[1] == now[1][-1]) & (now[2] == now[2][-1])
        cut = int(np.flatnonzero(~last)[-1]) + 1 if not last.all() else 0
        kept = [x[cut:] for x in now]
        if cut:
            yield links([x[:cut] for x in now])
    yield links(kept)


def close_links(fps: DataFrame, bits: int = 3, blocks: int = 6, tile: int = 20_000) -> DataFrame:
    """(a, b): links between distinct fingerprints that connect exactly those within chains of ``bits`` differing bits.

    A key of more than ``tile`` fingerprints is cut into slots of about that many, and each pair of
    slots is compared in a task of its own.
    """
    spark = fps.sparkSession
    masks = block_masks(bits, blocks)
    keys = fps.select("fp").distinct().select("fp", F.posexplode(F.array(*[F.col("fp").bitwiseAND(F.lit(m).cast("long")) for m in masks])).alias("choice", "block"))
    heavy = saved(keys.groupBy("choice", "block").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > tile))
    dealt = keys.withColumn("tile", F.lit(0).cast("long"))
    if not heavy.isEmpty():
        slots = F.ceil(F.col("n") / tile)
        cut = keys.join(heavy, ["choice", "block"]).withColumn("slot", F.pmod(F.xxhash64("fp"), slots)).withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), slots - 1)))
        cut = cut.withColumn("tile", F.least("slot", "other") * slots + F.greatest("slot", "other"))
        dealt = keys.join(heavy, ["choice", "block"], "left_anti").withColumn("tile", F.lit(0).cast("long")).unionByName(cut.select("fp", "choice", "block", "tile"))
    runs = dealt.repartition(shuffle_partitions(spark), "choice", "block", "tile").sortWithinPartitions("choice", "block", "tile", "fp")
    return runs.mapInPandas(partial(_links, bits=bits), "a long, b long")


def near_groups(docs: DataFrame, bits: int = 3, n: int = 3, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """For each row: td_known, td_id, td_hash (its key), ``fp`` and ``component``, a fingerprint that names its group.

    Null and empty texts have fingerprint 0 and link like any other. Every row is in exactly one group.
    """
    return _components(*_rows_and_groups(docs, bits, n, doc_id, text))


def _rows_and_groups(docs: DataFrame, bits: int, n: int, doc_id: str, text: str) -> tuple[DataFrame, DataFrame]:
    rows = saved(fingerprints(docs, n, doc_id, text))
    return rows, connected(close_links(rows, bits))


def _components(rows: DataFrame, groups: DataFrame) -> DataFrame:
    # Only linked fingerprints have a row in groups; the others name themselves.
    return rows.join(groups.select(F.col("node").alias("fp"), "label"), "fp", "left").withColumn("component", F.coalesce("label", "fp")).drop("label")


def label_groups(docs: DataFrame, bits: int = 3, n: int = 3, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``doc_id``, ``fingerprint`` (16 hex digits) and ``component_id``, the smallest doc_id that links of at most ``bits`` differing bits reach.

    Rows without a doc_id take part, and a component without any doc_id has a null component_id.
    Repeated rows return repeated rows; columns other than doc_id and text are not used.
    """
    rows, groups = _rows_and_groups(docs, bits, n, doc_id, text)
    # From here to the last join there is one row for each distinct fingerprint, however many documents share it.
    fps = rows.groupBy("fp").agg(F.min(F.when(F.col("td_known"), F.col("td_id"))).alias("least"))
    named = _components(fps, groups)
    least = named.groupBy("component").agg(F.min("least").alias("component_id"))
    names = named.select("fp", "component").join(spread(least), "component", "left").select("fp", "component_id")
    return rows.join(names, "fp", "left").select(
        F.when(F.col("td_known"), F.col("td_id")).alias("doc_id"), F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id"
    )


def keep_one(docs: DataFrame, bits: int = 3, n: int = 3, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """The input rows of one document of each group: the one with the smallest doc_id (rows without one last; then by text hash)."""
    return kept_of(docs, near_groups(docs, bits, n, doc_id, text), doc_id, text)


def kept_of(docs: DataFrame, rows: DataFrame, doc_id: str, text: str) -> DataFrame:
    """The rows of docs that ``keep_one`` keeps, given the ``component`` of each row's key."""
    order = F.struct((~F.col("td_known")).alias("unknown"), "td_id", "td_hash")
    best = rows.groupBy("component").agg(F.min(order).alias("best"))
    best = best.select((~F.col("best.unknown")).alias("td_known"), F.col("best.td_id").alias("td_id"), F.col("best.td_hash").alias("td_hash"))
    kept = packed(docs, doc_id, text).join(best, KEY, "left_semi")
    # Repeated rows share a key: one of them stays.
    kept = kept.withColumn("td_copy", F.row_number().over(Window.partitionBy(*KEY).orderBy("td_hash"))).filter("td_copy = 1")
    return unpacked(kept, docs.columns, {})
