"""Document fingerprints: threshold-scaled sketches of word shingles. Native DataFrame functions only.

A sketch keeps every shingle hash below a fixed fraction of the hash space, so its size follows the
text's, sketches of any two texts compare hash by hash, and the sketch of a union is the union of
sketches. Containment estimates hold between a page and a book. A text that has words but no hash
below the threshold keeps its least hash apart, which takes no part in unions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import KEY, bind, neighbours, row_key, whole_text, words

#: Part of all shingle hashes that a sketch keeps. Of a text of w words that is w / 8 hashes; README has the measured error.
FRACTION = 0.125


def sketch(text: Column, n: int = 5, fraction: float = FRACTION) -> Column:
    """struct(hashes, least): the sorted distinct hashes of the n-word shingles of the lower-cased text below ``fraction`` of the hash space, and where there are none, the least hash of all.

    A text of fewer than n words is one shingle; a text without words has no hash at all. Equal
    texts have equal sketches.
    """
    limit = int(fraction * 2**63)
    # get() reads one element; slice() would copy the whole array for each shingle.
    run = lambda h, i: F.xxhash64(*[F.get(h, i + k) for k in range(n)])
    shingles = lambda h: F.when(F.size(h) < n, F.array(F.xxhash64(h))).otherwise(F.transform(F.sequence(F.lit(0), F.size(h) - n), lambda i: run(h, i)))
    kept = lambda s: F.sort_array(F.array_distinct(F.filter(s, lambda x: F.shiftrightunsigned(x, 1) < F.lit(limit))))
    made = lambda s: bind(kept(s), lambda k: F.struct(k.alias("hashes"), F.when(F.size(k) == 0, F.array_min(s)).alias("least")))
    empty = F.struct(F.array().cast("array<long>").alias("hashes"), F.lit(None).cast("long").alias("least"))
    return bind(words(F.lower(text)), lambda h: F.when(F.size(h) == 0, empty).otherwise(bind(shingles(h), made)))


def _sizes(a: Column, b: Column) -> Column:
    return F.size(a["hashes"]) + F.size(b["hashes"])


def resemblance(a: Column, b: Column) -> Column:
    """Estimated Jaccard likeness of two texts from their sketches; where neither has a hash below the threshold, 1 if they have the same least hash, else 0. Two texts without words are alike."""
    part = bind(F.size(F.array_intersect(a["hashes"], b["hashes"])), lambda shared: shared / (_sizes(a, b) - shared))
    return F.when(_sizes(a, b) == 0, a["least"].eqNullSafe(b["least"]).cast("double")).otherwise(part).cast("double")


def containment(a: Column, b: Column) -> Column:
    """Estimated part of the first text's shingles that the second has too. A first text without a hash below the threshold is contained if it has no words or the same least hash."""
    none = a["least"].isNull() | a["least"].eqNullSafe(b["least"])
    return F.when(F.size(a["hashes"]) == 0, none.cast("double")).otherwise(F.size(F.array_intersect(a["hashes"], b["hashes"])) / F.size(a["hashes"])).cast("double")


def merged(sketches: DataFrame, group: str, column: str = "sketch") -> DataFrame:
    """The sketch of each group's union, as (group, hash) rows: groups of any size stay spread over tasks. A group without a hash below the threshold has no rows."""
    return sketches.select(group, F.explode(F.col(column)["hashes"]).alias("hash")).distinct()


def sketches(docs: DataFrame, n: int = 5, fraction: float = FRACTION, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Every row's doc_id with ``sketch``; other columns are not used. Null texts count as empty; repeated rows return repeated rows."""
    return docs.select(F.col(doc_id).alias("doc_id"), sketch(whole_text(text), n, fraction).alias("sketch"))


def as_text(s: Column) -> Column:
    """The hashes in hexadecimal, 16 digits each; a least hash kept apart follows a tilde."""
    hexed = lambda h: F.lpad(F.lower(F.hex(h)), 16, "0")
    return F.when(s["least"].isNotNull(), F.concat(F.lit("~"), hexed(s["least"]))).otherwise(F.array_join(F.transform(s["hashes"], hexed), ""))


def edited_pairs(docs: DataFrame, n: int = 5, fraction: float = FRACTION, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Every document beside its edited text and its successor, compared by sketches.

    Columns: td_known, td_id (0 if null), text, edited, sketch, edited_sketch, next_sketch. The edited
    text has the last floor(length/4) code points replaced by the first as many, or all, of the
    next document by doc_id (null first, ties by text hash; after the last comes the first; a single
    document is its own successor). Repeated rows are one document in that order and return
    alike; columns other than doc_id and text are not used. Only the order of ids is global; a text
    moves once, with its sketch, and of the next text only the part that the edit needs.
    """
    base = docs.select(*row_key(doc_id, text), whole_text(text).alias("td_text"), sketch(whole_text(text), n, fraction).alias("td_sketch"))
    ids = base.select(*KEY, F.length("td_text").alias("n")).groupBy(*KEY, "n").agg(F.count(F.lit(1)).alias("copies"))
    order = neighbours(ids, KEY, ["n", "copies"])
    before = F.col("td_prev")
    given = base.join(order.select(*KEY, "td_prev"), KEY).select(
        *[before[k].alias(k) for k in KEY],
        F.substring("td_text", F.lit(1), F.floor(before["n"] / 4).cast("int")).alias("start"),
        F.col("td_sketch").alias("next_sketch"),
    )
    if (order.agg(F.max("copies").alias("most")).first()["most"] or 0) > 1:
        given = given.dropDuplicates(KEY)
    length = F.length("td_text")
    edited = F.concat(F.substring("td_text", F.lit(1), length - F.floor(length / 4).cast("int")), F.col("start"))
    return base.join(given, KEY).select(
        "td_known", "td_id", F.col("td_text").alias("text"), edited.alias("edited"), F.col("td_sketch").alias("sketch"), sketch(edited, n, fraction).alias("edited_sketch"), "next_sketch"
    )
