"""MinHash near-dedup with sequential Bayesian verification.

Bands of MinHash values propose pairs. A pair's signatures are then compared a batch of values at a
time: with a uniform prior the similarity after m matches among n values has the Beta(m + 1, n - m + 1)
posterior, and the pair is dropped as soon as the posterior chance of ``least`` or more falls below
``miss``. What survives all batches is compared on its full sets of shingles, so every link is exact.

Texts of equal sets are one node from the start. A band that many nodes share is first held against
its least node; afterwards only bands that still hold several components are compared in full, in
tiles of bounded size spread over tasks, and only a forest of links leaves a tile.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache, partial
from math import comb

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import KEY, packed, row_key, saved, shuffle_partitions, spread, unpacked
from .components import connected
from .jaccard import common_counts, shingle_set

SEED = 43
#: A pair of similarity 0.8 shares no band with probability (1 - 0.8 ** ROWS) ** BANDS, about 1.4e-5.
BANDS, ROWS = 28, 5
VALUES = BANDS * ROWS
#: Values compared at a time.
BATCH = 28
#: Shingles at a time, so that a block of VALUES values for each stays in the processor's cache.
SLAB = 1024
_RNG = np.random.default_rng(SEED)
_XOR, _ODD = (_RNG.integers(0, 1 << 64, VALUES, np.uint64)[:, None] for _ in range(2))
_ODD |= np.uint64(1)


def min_values(shingles: np.ndarray) -> np.ndarray:
    """The MinHash values of a set that is not empty."""
    least = np.full(VALUES, np.iinfo(np.uint64).max, np.uint64)
    for at in range(0, len(shingles), SLAB):
        np.minimum(least, ((shingles[None, at : at + SLAB] ^ _XOR) * _ODD).min(axis=1), out=least)
    return least


def band_keys(values: np.ndarray) -> np.ndarray:
    return np.array([xxhash.xxh64_intdigest(b.tobytes(), k) for k, b in enumerate(values.reshape(BANDS, ROWS))], np.uint64).view(np.int64)


def short(values: np.ndarray) -> bytes:
    """Sixteen bits of each value. Different values agree by chance once in 65,536, which can only keep a pair alive."""
    return (values >> np.uint64(16)).astype(np.uint16).tobytes()


@cache
def least_matches(least: float, miss: float) -> tuple[int, ...]:
    """For 1, 2, ... batches: the fewest matches with which the posterior chance of ``least`` or more is at least ``miss``.

    P(s >= t | m of n) = 1 - I_t(m + 1, n - m + 1) = P(Binomial(n + 1, t) <= m).
    """
    out = []
    for n in range(BATCH, VALUES + 1, BATCH):
        below, m = 0.0, -1
        while below < miss:
            m += 1
            below += comb(n + 1, m) * least**m * (1 - least) ** (n + 1 - m)
        out.append(m)
    return tuple(out)


def survivors(x: np.ndarray, y: np.ndarray, least: float, miss: float) -> np.ndarray:
    """Which pairs of signatures (rows of x and y) outlast every batch."""
    alive, got = np.arange(len(x)), np.zeros(len(x), np.int64)
    for k, needed in enumerate(least_matches(least, miss)):
        cut = slice(k * BATCH, (k + 1) * BATCH)
        got = got + (x[alive, cut] == y[alive, cut]).sum(axis=1)
        alive, got = alive[got >= needed], got[got >= needed]
    return alive


def similar(x: np.ndarray, y: np.ndarray, least: float) -> bool:
    """Whether two sorted sets have a Jaccard similarity of ``least`` or more, in whole hundredths."""
    both = len(np.intersect1d(x, y, assume_unique=True))
    return 100 * both >= round(100 * least) * (len(x) + len(y) - both)


def bucket_pairs(parts: np.ndarray, sizes: np.ndarray, signatures: np.ndarray, least: float, miss: float) -> tuple[np.ndarray, np.ndarray]:
    """(i, j), i < j: the members of a bucket in different parts that sizes allow and that outlast every batch. The first batch is compared for the whole bucket at once."""
    small, large = np.minimum(sizes[:, None], sizes[None, :]), np.maximum(sizes[:, None], sizes[None, :])
    open_ = (parts[:, None] != parts[None, :]) & (100 * small >= round(100 * least) * large)
    got = np.zeros(open_.shape, np.uint8)
    for column in signatures[:, :BATCH].T:
        got += column[:, None] == column[None, :]
    i, j = np.nonzero(np.triu(open_ & (got >= least_matches(least, miss)[0]), 1))
    kept = [survivors(signatures[i[at : at + 100_000]], signatures[j[at : at + 100_000]], least, miss) + at for at in range(0, len(i), 100_000)]
    kept = np.concatenate(kept) if kept else np.empty(0, np.int64)
    return i[kept], j[kept]


def bucket_forest(nodes: np.ndarray, parts: np.ndarray, signatures: np.ndarray, sets: list[np.ndarray], least: float, miss: float) -> list[tuple[int, int]]:
    """Links that join different ``parts`` of a bucket into the components of all its similar pairs: a forest, never all pairs."""
    sizes = np.array([len(s) for s in sets])
    pairs_i, pairs_j = bucket_pairs(parts, sizes, signatures, least, miss)
    counts = None
    if len(pairs_i) > 20 * len(sets):  # many close calls: all intersections at once are cheaper
        counts = common_counts(sets)
    _, of = np.unique(parts, return_inverse=True)
    of, out = of.tolist(), []
    root = list(range(max(of) + 1))

    def find(i: int) -> int:
        while root[i] != i:
            root[i] = root[root[i]]
            i = root[i]
        return i

    for i, j in zip(pairs_i.tolist(), pairs_j.tolist(), strict=True):
        a, b = find(of[i]), find(of[j])
        if a == b:
            continue
        if similar(sets[i], sets[j], least) if counts is None else 100 * counts[i, j] >= round(100 * least) * (sizes[i] + sizes[j] - counts[i, j]):
            root[max(a, b)] = min(a, b)
            out.append((int(nodes[i]), int(nodes[j])))
    return out


def _signed(batches: Iterator[pd.DataFrame], n: int) -> Iterator[pd.DataFrame]:
    for b in batches:
        sets = [shingle_set(t, n) for t in b.pop("text")]
        values = [min_values(s) if len(s) else None for s in sets]
        yield b.assign(
            size=[len(s) for s in sets],
            node=np.array([xxhash.xxh64_intdigest(s.tobytes(), SEED) for s in sets], np.uint64).view(np.int64),
            bands=[[] if v is None else band_keys(v) for v in values],
            signature=[b"" if v is None else short(v) for v in values],
        )


def _shingles(batches: Iterator[pd.DataFrame], n: int) -> Iterator[pd.DataFrame]:
    for b in batches:
        yield b.assign(shingles=[shingle_set(t, n).view(np.int64) for t in b.pop("text")])


def _rows_of(signatures: pd.Series) -> np.ndarray:
    return np.frombuffer(b"".join(signatures), np.uint16).reshape(-1, VALUES)


def _pruned(batches: Iterator[pd.DataFrame], least: float, miss: float) -> Iterator[pd.DataFrame]:
    for b in batches:
        if len(b):
            yield b[["a", "b"]].iloc[survivors(_rows_of(b["sig_a"]), _rows_of(b["sig_b"]), least, miss)]


def _confirmed(batches: Iterator[pd.DataFrame], least: float) -> Iterator[pd.DataFrame]:
    for b in batches:
        yield b.loc[[similar(x, y, least) for x, y in zip(b["set_a"], b["set_b"], strict=True)], ["a", "b"]]


def _bucket_links(batches: Iterator[pd.DataFrame], least: float, miss: float) -> Iterator[pd.DataFrame]:
    """Links of each run of rows of the same (band, tile); rows come sorted by these."""
    key, held = None, []

    def links() -> pd.DataFrame:
        nodes, parts, signatures, sets = zip(*held, strict=True)
        found = bucket_forest(np.array(nodes), np.array(parts), _rows_of(signatures), list(sets), least, miss) if len(set(parts)) > 1 else []
        return pd.DataFrame(found, columns=["a", "b"], dtype=np.int64)

    for b in batches:
        for band, tile, *row in zip(b["band"], b["tile"], b["node"], b["part"], b["signature"], b["shingles"], strict=True):
            if (band, tile) != key:
                if len(held) > 1:
                    yield links()
                key, held = (band, tile), []
            held.append(row)
    if len(held) > 1:
        yield links()


def _links(texts: DataFrame, rows: DataFrame, least: float, n: int, miss: float, tile: int) -> DataFrame:
    """(a, b): exact links between nodes that connect exactly the components of all similar pairs which a band proposes."""
    spark = rows.sparkSession
    nodes = rows.filter("size > 0").groupBy("node").agg(F.first("size").alias("size"), F.first("bands").alias("bands"), F.first("signature").alias("signature"), F.min(F.struct(*KEY)).alias("key"))
    keys = saved(nodes.select("node", "size", F.explode("bands").alias("band")))
    heads = keys.groupBy("band").agg(F.min(F.struct("node", "size")).alias("head"), F.count(F.lit(1)).alias("n")).filter("n > 1")
    members = saved(keys.join(spread(heads), "band"))
    signed = saved(nodes.drop("bands", "size").join(members.select("node").distinct(), "node", "left_semi"))
    known = texts.join(signed.select("node", "key.*"), KEY).dropDuplicates(["node"]).select("node", "text")
    known = saved(known.mapInPandas(partial(_shingles, n=n), "node long, shingles array<long>"))

    # First every member of a band against the band's least node: as many pairs as members.
    hundredths = round(100 * least)
    sized = 100 * F.least("size", "head.size") >= hundredths * F.greatest("size", "head.size")
    pairs = members.filter("node <> head.node").filter(sized).select(F.col("head.node").alias("a"), F.col("node").alias("b")).distinct()
    side = lambda df, c, value, name: df.select(F.col("node").alias(c), F.col(value).alias(name))
    pairs = pairs.join(side(signed, "a", "signature", "sig_a"), "a").join(side(signed, "b", "signature", "sig_b"), "b")
    left = pairs.mapInPandas(partial(_pruned, least=least, miss=miss), "a long, b long")
    left = left.join(side(known, "a", "shingles", "set_a"), "a").join(side(known, "b", "shingles", "set_b"), "b")
    links = saved(left.select("a", "b", "set_a", "set_b").mapInPandas(partial(_confirmed, least=least), "a long, b long"))

    # Then the bands of three or more nodes that are not one component yet, each in one task or in tiles of several.
    parts = connected(links).withColumnRenamed("label", "part")
    parted = saved(members.filter("n > 2").select("band", "node", "size").join(parts, "node", "left").select("band", "node", "size", F.coalesce("part", "node").alias("part")))
    # A slot has about ``tile`` sets, fewer where they are long.
    slots = F.ceil(F.greatest(F.count(F.lit(1)) / tile, F.sum("size") / (1000 * tile)))
    mixed = parted.groupBy("band").agg(F.min("part").alias("low"), F.max("part").alias("high"), slots.alias("slots")).filter("low <> high").select("band", "slots")
    dealt = parted.join(spread(mixed), "band").withColumn("slot", F.pmod(F.xxhash64("node"), F.col("slots"))).withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("slots") - 1)))
    dealt = dealt.select("band", "node", "part", (F.least("slot", "other") * F.col("slots") + F.greatest("slot", "other")).alias("tile"))
    dealt = dealt.join(known.join(signed.select("node", "signature"), "node"), "node").repartition(shuffle_partitions(spark), "band", "tile").sortWithinPartitions("band", "tile")
    more = dealt.select("band", "tile", "node", "part", "signature", "shingles").mapInPandas(partial(_bucket_links, least=least, miss=miss), "a long, b long")
    return links.unionByName(saved(more))


def _rows_and_labels(docs: DataFrame, least: float, n: int, miss: float, tile: int, doc_id: str, text: str) -> tuple[DataFrame, DataFrame]:
    texts = docs.select(*row_key(doc_id, text), F.col(text).cast("string").alias("text"))
    rows = saved(texts.mapInPandas(partial(_signed, n=n), "td_known boolean, td_id long, td_hash long, size long, node long, bands array<long>, signature binary"))
    return rows, connected(_links(texts, rows, least, n, miss, tile))


def near_groups(docs: DataFrame, least: float = 0.8, n: int = 4, miss: float = 1e-6, tile: int = 1000, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """For each row: td_known, td_id, td_hash (its key), ``size`` of its set of distinct word n-shingles, ``node``, and ``component``, a node that names its group.

    Words and shingles are as in ``jaccard.shingle_set``. Texts are linked whose Jaccard similarity is
    ``least`` or more, in whole hundredths, and so are chains of them. A pair of exactly ``least`` is
    missed with probability 1.4e-5 by the bands and about ``miss`` in each of 5 batches. Null texts and
    those without words have size 0, no component and no links. Repeated rows share a node.
    """
    rows, labels = _rows_and_labels(docs, least, n, miss, tile, doc_id, text)
    some = rows.filter("size > 0").select(*KEY, "size", "node").join(labels, "node", "left")
    none = rows.filter("size = 0").select(*KEY, "size", "node", F.lit(None).cast("long").alias("component"))
    return some.select(*KEY, "size", "node", F.coalesce("label", "node").alias("component")).unionByName(none)


def label_groups(docs: DataFrame, least: float = 0.8, n: int = 4, miss: float = 1e-6, tile: int = 1000, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``doc_id``, ``n_shingles``, ``component_id``, the smallest doc_id that links reach, and ``kept``, whether that is the row's own.

    Rows without a doc_id take part; where a component has no doc_id at all, or a row has neither
    words nor doc_id, component_id is null and ``kept`` is true. Repeated rows return repeated rows.
    """
    rows, labels = _rows_and_labels(docs, least, n, miss, tile, doc_id, text)
    own = F.when(F.col("td_known"), F.col("td_id"))
    # One row for each distinct set, however many documents share it, until the last join.
    nodes = rows.filter("size > 0").groupBy("node").agg(F.min(own).alias("first"))
    named = nodes.join(labels, "node", "left").select("node", "first", F.coalesce("label", "node").alias("component"))
    least_id = named.groupBy("component").agg(F.min("first").alias("component_id"))
    names = named.select("node", "component").join(spread(least_id), "component").select("node", "component_id")
    some = rows.filter("size > 0").select(own.alias("doc_id"), "size", "node").join(names, "node", "left").select("doc_id", F.col("size").alias("n_shingles"), "component_id")
    none = rows.filter("size = 0").select(own.alias("doc_id"), F.col("size").alias("n_shingles"), own.alias("component_id"))
    return some.unionByName(none).withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))


def keep_one(docs: DataFrame, least: float = 0.8, n: int = 4, miss: float = 1e-6, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """The input rows of one document of each group: the one with the smallest doc_id (rows without one last; then by text hash). Texts without words all stay; of repeated rows with words one stays."""
    rows = near_groups(docs, least, n, miss, doc_id=doc_id, text=text)
    order = F.struct((~F.col("td_known")).alias("unknown"), "td_id", "td_hash")
    best = rows.filter("component is not null").groupBy("component").agg(F.min(order).alias("best"))
    best = best.select((~F.col("best.unknown")).alias("td_known"), F.col("best.td_id").alias("td_id"), F.col("best.td_hash").alias("td_hash"))
    whole = packed(docs, doc_id, text)
    worded = F.length(F.btrim("td_text", F.lit(" \t\n\x0b\f\r"))) > 0
    some = whole.filter(worded).join(best, KEY, "left_semi").dropDuplicates(KEY)
    return unpacked(some.unionByName(whole.filter(~worded)), docs.columns, {})
