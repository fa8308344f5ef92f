"""SimHash near-dedup with full recall at a Jaccard similarity: links of close fingerprints, and pairs that MinHash bands propose and exact set similarity confirms.

Fingerprints at pigeonhole distance find half of the pairs of similarity 0.8 (README), so the bands
propose the rest. Texts of equal shingle sets are one node from the start. A band that many nodes
share is first held against its least node; afterwards only bands that still hold several components
are compared in full, by matrix products within a task, from which only a forest of links leaves.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import KEY, row_key, saved, shuffle_partitions, spread
from .components import connected
from .simhash import SEED, close_links, fingerprint, kept_of

#: A pair of similarity 0.8 shares no band with probability (1 - 0.8 ** ROWS) ** BANDS, about 1.4e-5.
BANDS, ROWS = 28, 5
#: Shingles at a time, so that a block of BANDS * ROWS values for each stays in the processor's cache.
SLAB = 1024
_RNG = np.random.default_rng(SEED)
_XOR, _ODD = (_RNG.integers(0, 1 << 64, BANDS * ROWS, np.uint64)[:, None] for _ in range(2))
_ODD |= np.uint64(1)


def shingle_set(text: str | None, n: int = 5) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the word n-shingles of a text (words as in ``simhash``; fewer than n words are one shingle)."""
    parts = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not parts:
        return np.empty(0, np.uint64)
    line, digest, width = b" ".join(parts), xxhash.xxh64_intdigest, min(n, len(parts))
    ends = np.cumsum(np.fromiter(map(len, parts), np.int64, len(parts)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    first, last = starts[: len(parts) - width + 1].tolist(), ends[width - 1 :].tolist()
    return np.unique(np.fromiter((digest(line[a:b], SEED) for a, b in zip(first, last, strict=True)), np.uint64, len(first)))


def band_keys(shingles: np.ndarray) -> np.ndarray:
    """A signed key for each band of the MinHash values of a set; an empty set has none."""
    if not len(shingles):
        return np.empty(0, np.int64)
    least = np.full(BANDS * ROWS, np.iinfo(np.uint64).max, np.uint64)
    for at in range(0, len(shingles), SLAB):
        np.minimum(least, ((shingles[None, at : at + SLAB] ^ _XOR) * _ODD).min(axis=1), out=least)
    return np.array([xxhash.xxh64_intdigest(b.tobytes(), k) for k, b in enumerate(least.reshape(BANDS, ROWS))], np.uint64).view(np.int64)


def _nodes(batches: Iterator[pd.DataFrame], n: int, simhash_n: int) -> Iterator[pd.DataFrame]:
    for b in batches:
        texts = b.pop("text")
        fp = np.array([fingerprint(t, simhash_n) for t in texts], np.uint64).view(np.int64)
        sets = [shingle_set(t, n) for t in texts]
        node = np.array([xxhash.xxh64_intdigest(s.tobytes(), SEED) for s in sets], np.uint64).view(np.int64)
        yield b.assign(fp=fp, node=node, size=[len(s) for s in sets], bands=[band_keys(s) for s in sets])


def _shingles(batches: Iterator[pd.DataFrame], n: int) -> Iterator[pd.DataFrame]:
    for b in batches:
        yield b.assign(shingles=[shingle_set(t, n).view(np.int64) for t in b.pop("text")])


def _similar(batches: Iterator[pd.DataFrame], least: float) -> Iterator[pd.DataFrame]:
    for b in batches:
        found = []
        for x, y in zip(b["set_a"], b["set_b"], strict=True):
            both = len(np.intersect1d(x, y, assume_unique=True))
            found.append(both >= least * (len(x) + len(y) - both))
        yield b.loc[found, ["a", "b"]]


def common_counts(sets: list[np.ndarray], slab: int = 4096) -> np.ndarray:
    """Number of common elements of each pair of sets, by products of incidence matrices of ``slab`` elements at a time."""
    rows = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    _, place, times = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    shared = times > 1  # an element of one set alone is in no pair
    number = np.cumsum(shared) - 1
    kept = shared[place]
    rows, columns = rows[kept], number[place[kept]]
    order = np.argsort(columns, kind="stable")
    rows, columns = rows[order], columns[order]
    out = np.zeros((len(sets), len(sets)), np.float32)
    cuts = np.searchsorted(columns, np.arange(0, int(shared.sum()) + slab, slab))
    for k, (lo, hi) in enumerate(zip(cuts, cuts[1:], strict=False)):
        x = np.zeros((len(sets), slab), np.float32)
        x[rows[lo:hi], columns[lo:hi] - k * slab] = 1
        out += x @ x.T
    return out


def bucket_forest(nodes: np.ndarray, parts: np.ndarray, sets: list[np.ndarray], least: float) -> list[tuple[int, int]]:
    """Links among the members of a bucket that join different ``parts`` into the components of all similar pairs: a forest, never all pairs."""
    _, root = np.unique(parts, return_inverse=True)
    root = root.tolist()

    def find(i: int) -> int:
        while root[i] != i:
            root[i] = root[root[i]]
            i = root[i]
        return i

    of, size = list(root), np.array([len(s) for s in sets])
    root, out = list(range(max(root) + 1)), []
    both = common_counts(sets)
    similar = np.triu(both >= least * (size[:, None] + size[None, :] - both), 1)
    for i, j in zip(*(x.tolist() for x in np.nonzero(similar)), strict=True):
        a, b = find(of[i]), find(of[j])
        if a != b:
            root[max(a, b)] = min(a, b)
            out.append((int(nodes[i]), int(nodes[j])))
    return out


def _bucket_links(batches: Iterator[pd.DataFrame], least: float) -> Iterator[pd.DataFrame]:
    """Links of each run of rows of the same (band, tile); rows come sorted by these."""
    key, nodes, parts, sets = None, [], [], []

    def links() -> pd.DataFrame:
        found = bucket_forest(np.array(nodes), np.array(parts), sets, least) if len(set(parts)) > 1 else []
        return pd.DataFrame(found, columns=["a", "b"], dtype=np.int64)

    for b in batches:
        for band, tile, node, part, s in zip(b["band"], b["tile"], b["node"], b["part"], b["shingles"], strict=True):
            if (band, tile) != key:
                if len(nodes) > 1:
                    yield links()
                key, nodes, parts, sets = (band, tile), [], [], []
            nodes.append(node)
            parts.append(part)
            sets.append(s)
    if len(nodes) > 1:
        yield links()


def near_groups(docs: DataFrame, least: float = 0.8, n: int = 5, bits: int = 3, tile: int = 1000, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """For each row: td_known, td_id, td_hash (its key) and ``component``, a node that names its group.

    Texts are linked whose SimHash fingerprints differ in at most ``bits`` bits, as in ``simhash``, and
    texts of Jaccard similarity ``least`` or more, and so are chains of them. Null and empty texts
    are one group. Every row is in exactly one group.
    """
    texts = docs.select(*row_key(doc_id, text), F.col(text).cast("string").alias("text"))
    rows = saved(texts.mapInPandas(partial(_nodes, n=n, simhash_n=3), "td_known boolean, td_id long, td_hash long, fp long, node long, size long, bands array<long>"))
    nodes = rows.groupBy("node").agg(F.first("size").alias("size"), F.first("bands").alias("bands"), F.min(F.struct(*KEY)).alias("key"))
    # Each fingerprint stands for its least node; the others of that fingerprint are linked to it.
    heads = saved(rows.groupBy("fp").agg(F.min("node").alias("head"), F.max("node").alias("other")))
    close = close_links(heads, bits).join(heads.select(F.col("fp").alias("a"), F.col("head").alias("x")), "a").join(heads.select(F.col("fp").alias("b"), F.col("head").alias("y")), "b")
    several = heads.filter("head <> other").select("fp", "head")
    same = rows.select("fp", "node").distinct().join(spread(several), "fp").filter("node <> head").select(F.col("head").alias("a"), F.col("node").alias("b"))
    links = saved(close.select(F.col("x").alias("a"), F.col("y").alias("b")).unionByName(same))

    keys = saved(nodes.select("node", "size", F.explode("bands").alias("band")))
    firsts = keys.groupBy("band").agg(F.min(F.struct("node", "size")).alias("head"), F.count(F.lit(1)).alias("n")).filter("n > 1").select("band", "head")
    members = saved(keys.join(spread(firsts), "band"))
    some = nodes.join(members.select("node").distinct(), "node", "left_semi").select("node", "key.*")
    known = texts.join(some, KEY).dropDuplicates(["node"]).select("node", "text")
    known = saved(known.mapInPandas(partial(_shingles, n=n), "node long, shingles array<long>"))

    # First every member of a band against the band's least node: as many pairs as members.
    pairs = members.filter("node <> head.node").select(F.col("head.node").alias("a"), F.col("head.size").alias("size_a"), F.col("node").alias("b"), F.col("size").alias("size_b"))
    pairs = pairs.filter(F.least("size_a", "size_b") >= least * F.greatest("size_a", "size_b")).select("a", "b").distinct()
    pairs = pairs.join(known.select(F.col("node").alias("a"), F.col("shingles").alias("set_a")), "a")
    pairs = pairs.join(known.select(F.col("node").alias("b"), F.col("shingles").alias("set_b")), "b")
    links = links.unionByName(saved(pairs.select("a", "b", "set_a", "set_b").mapInPandas(partial(_similar, least=least), "a long, b long")))

    # Then the bands whose members are not one component yet, each in one task or in tiles of several.
    parted = saved(members.select("band", "node", "size").join(connected(links).withColumnRenamed("label", "part"), "node", "left").select("band", "node", "size", F.coalesce("part", "node").alias("part")))
    # A slot has about ``tile`` sets, fewer where they are long.
    slots = F.ceil(F.greatest(F.count(F.lit(1)) / tile, F.sum("size") / (1000 * tile)))
    mixed = parted.groupBy("band").agg(F.min("part").alias("low"), F.max("part").alias("high"), slots.alias("slots")).filter("low <> high").select("band", "slots")
    dealt = parted.join(spread(mixed), "band").withColumn("slot", F.pmod(F.xxhash64("node"), F.col("slots"))).withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("slots") - 1)))
    dealt = dealt.select("band", "node", "part", (F.least("slot", "other") * F.col("slots") + F.greatest("slot", "other")).alias("tile"))
    dealt = dealt.join(known, "node").repartition(shuffle_partitions(docs.sparkSession), "band", "tile").sortWithinPartitions("band", "tile")
    links = links.unionByName(saved(dealt.mapInPandas(partial(_bucket_links, least=least), "a long, b long")))
    return rows.drop("fp", "size", "bands").join(connected(links), "node", "left").select(*KEY, F.coalesce("label", "node").alias("component"))


def keep_one(docs: DataFrame, least: float = 0.8, n: int = 5, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """The input rows of one document of each group, chosen as in ``simhash.keep_one``. Null and empty texts are one group; of repeated rows one stays."""
    return kept_of(docs, near_groups(docs, least, n, doc_id=doc_id, text=text), doc_id, text)
