"""Mixing sources to target weights by systematic sampling. Native DataFrame functions only.

Within a source every document expects target / source_size copies. Documents line up by size, the
expected copies are summed along the line, one random offset is added, and a document is emitted
once for each integer boundary that its stretch of the line crosses. Because the line is sorted by
size, short and long documents are drawn in proportion and the words taken come close to the target.
Ranks come from range partitions, so a source of any share of the rows spreads over many tasks.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import KEY, group_ranks, packed, row_key, saved, unpacked, whole_text, words


def n_words(text: Column) -> Column:
    return F.size(words(text)).cast("long")


def source_targets(sizes: DataFrame, weights: tuple[int, ...], share: float, most: float) -> DataFrame:
    """(source, source_size, target) from (source, source_size).

    Sources by code point, null last, take ``weights`` in turn and share ``share`` of all words;
    a target stops at ``most`` times the source's size and the excess is shared again by weight
    among the rest, until none is above. The level is found from scalars, one job a round.
    """
    place = group_ranks(sizes.select("source", "source_size", F.lit(0).alias("all"), F.col("source").isNull().alias("nameless")), "all", ["nameless", "source"])
    pick = F.array(*[F.lit(w) for w in weights])
    state = saved(place.select("source", "source_size", F.get(pick, ((F.col("td_rank") - 1) % len(weights)).cast("int")).alias("weight")))
    total = state.agg(F.sum("source_size").alias("n")).first()["n"] or 0
    pool, capped = share * total, F.lit(False)
    level = (0.0, 1)
    while True:
        row = state.agg(
            F.sum(F.when(capped, F.col("source_size"))).alias("held"), F.sum(F.when(~capped, F.col("weight"))).alias("open"), F.count(F.when(capped, 1)).alias("n")
        ).first()
        rest, open_weight = pool - most * (row["held"] or 0), row["open"] or 0
        if not open_weight:
            break
        level = (float(rest), open_weight)
        over = F.lit(level[0]) * F.col("weight") / F.lit(level[1]) > F.col("source_size") * F.lit(float(most))
        more = state.agg(F.count(F.when(capped | over, 1)).alias("n")).first()["n"]
        if more == row["n"]:
            break
        capped = capped | over
    even = F.lit(level[0]) * F.col("weight") / F.lit(level[1])
    return state.select("source", "source_size", F.when(capped, F.col("source_size") * F.lit(float(most))).otherwise(even).alias("target"))


def offset(source: Column, seed: int) -> Column:
    """A uniform number in [0, 1) for each source and seed."""
    digest = F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(source, F.lit("\x00"))))
    return F.conv(F.substring(digest, 1, 8), 16, 10).cast("double") / F.lit(4294967296.0)


def mix(
    docs: DataFrame, weights: tuple[int, ...] = (3, 1, 2), share: float = 1.5, most: float = 2.0, seed: int = 7, doc_id: str = "doc_id", text: str = "text", source: str = "source"
) -> DataFrame:
    """Columns td_known, td_id, td_hash (the row's key), size, source_size, target, copies, taken; one row for each input row.

    Sizes count words (null and empty texts: 0; such documents are never taken). ``copies`` is the
    whole number of times that the mix repeats the document, floor or ceiling of what it expects,
    so at most ``most`` rounded up. Ties in size go by doc_id, then by text; repeated rows are lined
    up one after the other. Null sources form one source, last. Reruns agree.
    """
    rows = docs.select(F.col(source).cast("string").alias("source"), *row_key(doc_id, text), n_words(whole_text(text)).alias("size"))
    rows = saved(rows)
    sizes = rows.groupBy("source").agg(F.sum("size").alias("source_size"))
    targets = source_targets(sizes, weights, share, most)
    ranked = group_ranks(rows, "source", ["size", "td_known", "td_id", "td_hash"])
    joined = ranked.join(targets.withColumnRenamed("source", "to"), F.col("source").eqNullSafe(F.col("to"))).drop("to")
    each = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    u = offset(F.col("source"), seed)
    end, start = F.floor(each * F.col("td_rank") + u), F.floor(each * (F.col("td_rank") - 1) + u)
    copies = F.when(F.col("size") > 0, end - start).otherwise(F.lit(0)).cast("long")
    return joined.withColumn("copies", copies).withColumn("taken", F.col("copies") * F.col("size")).drop("td_rank")



def mixed_corpus(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", source: str = "source", **options) -> DataFrame:
    """Input columns of every document that the mix takes, with ``copies`` and ``taken``. Repeated rows become one row that carries all their copies."""
    plan = mix(docs, doc_id=doc_id, text=text, source=source, **options)
    plan = plan.groupBy(*KEY).agg(F.sum("copies").alias("copies"), F.sum("taken").alias("taken")).filter("copies > 0")
    rows = packed(docs, doc_id, text).join(plan, KEY)
    rows = rows.withColumn("td_copy", F.row_number().over(Window.partitionBy(*KEY).orderBy("td_hash"))).filter("td_copy = 1")
    return unpacked(rows, docs.columns, {"copies": F.col("copies"), "taken": F.col("taken")})
