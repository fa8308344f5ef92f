"""The nearest texts of every text by TF-IDF cosine, for all at once and exactly, without comparing all pairs.

Equal bags of words are one class. Every class first meets the heaviest few of each of its words; its k-th best
cosine among them is a bound that any better neighbour must reach. With a class's words ordered from rare to common,
those behind the point where the rest of the vector is shorter than the bound cannot make up a neighbour on their own, so
only the words before it are looked up among all classes. What is found is held against a second bound
(the products so far, and the lengths of what is left of both vectors) before the vectors themselves are compared.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.ranks import saved
from tidemark.functions.text import tokens

#: Slack of the bounds, above the rounding errors of sums of products; cosines are ranked at nine digits.
SLACK = 2e-9
DIGITS = 9


def _bags(items: DataFrame, id: str, text: str) -> DataFrame:
    """(id, bag): words of two characters or more in order, joined; one row an id (its least text), none for texts without words."""
    words = F.sort_array(F.filter(tokens(F.col("text")), lambda w: F.length(w) > 1))
    rows = items.select(F.col(f"`{id}`").alias("id"), F.col(f"`{text}`").alias("text")).filter("id is not null").groupBy("id").agg(F.min("text").alias("text"))
    return rows.select("id", F.array_join(words, " ").alias("bag")).filter("bag <> ''")


def _vectors(classes: DataFrame) -> DataFrame:
    """(c, v, w) of classes (c, bag, members): v, an array of (n, term, w, tail) from rare to common words, with n the classes that hold the word, w its weight in the vector of unit length and tail the squared length of the vector from there on; and w, the weights by word."""
    tf = classes.select("c", "members", F.explode(F.split("bag", " ")).alias("term")).groupBy("c", "term").agg(F.first("members").alias("members"), F.count(F.lit(1)).alias("tf"))
    total = F.broadcast(classes.agg(F.sum("members").alias("total")))  # one row
    idf = tf.groupBy("term").agg(F.count(F.lit(1)).alias("n"), F.sum("members").alias("df")).crossJoin(total).select("term", "n", (F.log((1 + F.col("total")) / (1 + F.col("df"))) + 1).alias("idf"))
    raw = tf.join(idf, "term").select("c", "term", "n", (F.col("tf") * F.col("idf")).alias("w"))
    square = F.col("w") * F.col("w")
    whole = Window.partitionBy("c").orderBy(F.desc("n"), F.desc("term"))
    parts = raw.withColumn("tail", F.sum(square).over(whole.rowsBetween(Window.unboundedPreceding, 0))).withColumn("all", F.max("tail").over(Window.partitionBy("c")))
    parts = parts.select("c", F.struct("n", "term", (F.col("w") / F.sqrt("all")).alias("w"), (F.col("tail") / F.col("all")).alias("tail")).alias("e"))
    return parts.groupBy("c").agg(F.sort_array(F.collect_list("e")).alias("v")).withColumn("w", F.map_from_arrays(F.col("v.term"), F.col("v.w")))


def _cosines(pairs: DataFrame, vectors: DataFrame) -> DataFrame:
    """pairs (x, y, ...) with the cosine of their vectors."""
    dot = F.aggregate("v", F.lit(0.0), lambda s, e: s + e["w"] * F.coalesce(F.try_element_at(F.col("w"), e["term"]), F.lit(0.0)))
    j = pairs.join(vectors.select(F.col("c").alias("y"), "w"), "y").join(vectors.select(F.col("c").alias("x"), "v"), "x")
    return j.select(*pairs.columns, F.round(dot, DIGITS).alias("cosine"))


def _best(pairs: DataFrame, k: Column) -> DataFrame:
    """The first k rows of every x by cosine and y."""
    place = F.row_number().over(Window.partitionBy("x").orderBy(F.desc("cosine"), "y"))
    return pairs.withColumn("place", place).filter(F.col("place") <= k)


def _reached(pairs: DataFrame, need: DataFrame, k: int) -> DataFrame:
    """(x, need, t) for every row of need (x, need): the cosine of the need-th of the pairs (x, y, cosine), 1 for need 0, 0 where there are fewer."""
    top = _best(pairs, F.lit(k)).groupBy("x").agg(F.sort_array(F.collect_list("cosine"), asc=False).alias("top"))  # k a class
    t = F.when(F.col("need") == 0, 1.0).otherwise(F.coalesce(F.get("top", F.col("need") - 1), F.lit(0.0)))
    return need.join(top, "x", "left").select("x", "need", t.alias("t"))


def bounds(vectors: DataFrame, classes: DataFrame, k: int) -> DataFrame:
    """(x, need, t): t, a cosine that the k-th nearest neighbour of a member of class x has at least; 0 where all texts that share a word with it are fewer. need: classes wanted beside the members of x.

    With k + 1 members or more it is 1. Else it is the cosine of the k-th class (less one for each further member of x)
    among the 4 (k + 1) heaviest of each of its words.
    """
    postings = vectors.select("c", F.explode("v").alias("e")).select(F.col("e.term").alias("term"), "c", F.col("e.w").alias("w"))
    heavy = F.row_number().over(Window.partitionBy("term").orderBy(F.desc("w"), "c"))
    few = postings.withColumn("place", heavy).filter(F.col("place") <= 4 * (k + 1)).select("term", F.col("c").alias("y"), F.col("w").alias("wy"))
    # What two vectors have in common at the words where they met is at most their cosine, so it bounds as well and needs no vectors.
    met = postings.select("term", F.col("c").alias("x"), F.col("w").alias("wx")).join(few, "term").filter("x <> y").groupBy("x", "y").agg(F.sum(F.col("wx") * F.col("wy")).alias("cosine"))
    need = classes.select(F.col("c").alias("x"), F.greatest(F.lit(k + 1) - F.col("members"), F.lit(0)).cast("int").alias("need"))
    return _reached(met, need, k)


def candidates(vectors: DataFrame, bound: DataFrame, k: int, block: int = 1000) -> DataFrame:
    """(x, y, words): classes y that may be at the bound of x or above it, with the number of words by which they met.

    A word that many classes hold is cut into blocks of about ``block`` of them, so a common word is the work of many tasks.
    The words met so far give every x a second, higher bound.
    """
    shares = lambda n: F.ceil(n / block).cast("int")
    least = F.greatest(F.col("t") - SLACK, F.lit(0.0))
    asked = vectors.join(bound.withColumnRenamed("x", "c"), "c")
    asked = asked.withColumn("head", F.filter("v", lambda e: e["tail"] >= least * least - SLACK))
    asked = asked.withColumn("rest", F.coalesce(F.get("v", F.size("head"))["tail"], F.lit(0.0)))
    look = asked.select(F.col("c").alias("x"), "rest", F.explode("head").alias("e"))
    look = look.select("x", "rest", F.col("e.term").alias("term"), F.col("e.w").alias("wx"), F.explode(F.sequence(F.lit(0), shares(F.col("e.n")) - 1)).alias("b"))
    held = vectors.select(F.col("c").alias("y"), F.explode("v").alias("e"))
    held = held.select("y", F.col("e.term").alias("term"), F.col("e.w").alias("wy"), F.pmod(F.xxhash64("y"), shares(F.col("e.n"))).cast("int").alias("b"))
    met = look.join(held, ["term", "b"]).filter("x <> y").groupBy("x", "y").agg(
        F.sum(F.col("wx") * F.col("wy")).alias("cosine"), F.sum(F.col("wy") * F.col("wy")).alias("used"), F.first("rest").alias("rest"), F.count(F.lit(1)).alias("words")
    )
    met = saved(met)
    higher = _reached(met, bound.select("x", "need"), k).select("x", F.col("t").alias("t2")).join(bound, "x").select("x", F.greatest("t", "t2").alias("t"))
    left = F.sqrt(F.col("rest") * F.greatest(1 - F.col("used"), F.lit(0.0)))
    return met.join(higher, "x").filter(F.col("cosine") + left >= least - SLACK).select("x", "y", "words")


def nearest(items: DataFrame, id: str, text: str, k: int = 5) -> DataFrame:
    """(id, rank, neighbour, cosine): the k nearest other texts of every text, by cosine (rounded to nine digits) downwards and id; only those that share a word.

    Cosines are of smoothed TF-IDF weights over words of two characters or more (runs of a-z and 0-9 in lower case). Rows
    without an id are left out, of rows with one id the least text counts, and texts without words have no rows.
    Empty input gives no rows.
    """
    bags = saved(_bags(items, id, text))
    classes = saved(bags.groupBy("bag").agg(F.min("id").alias("c"), F.count(F.lit(1)).alias("members")))
    vectors = saved(_vectors(classes))
    bound = saved(bounds(vectors, classes, k))
    near = _best(_cosines(candidates(vectors, bound, k), vectors).filter("cosine > 0"), F.lit(k))

    # Of a class, the k + 1 least ids can be anyone's neighbours.
    of = bags.join(classes.select("bag", "c"), "bag").select("id", "c")
    place = F.row_number().over(Window.partitionBy("c").orderBy("id"))
    named = of.withColumn("place", place).filter(F.col("place") <= k + 1).groupBy("c").agg(F.collect_list("id").alias("ids"))
    own = named.select(F.col("c").alias("x"), F.lit(1.0).alias("cosine"), "ids")
    other = near.join(named.withColumnRenamed("c", "y"), "y").select("x", "cosine", "ids")
    rows = own.unionByName(other).select("x", "cosine", F.explode("ids").alias("id"))
    lists = rows.groupBy("x").agg(F.slice(F.sort_array(F.collect_list(F.struct((-F.col("cosine")).alias("far"), F.col("id").alias("id")))), 1, k + 1).alias("top"))
    mine = of.withColumnRenamed("c", "x").join(lists, "x").select("id", F.slice(F.filter("top", lambda e: e["id"] != F.col("id")), 1, k).alias("top"))
    out = mine.select("id", F.posexplode("top").alias("i", "e"))
    return out.select(F.col("id").alias(id), (F.col("i") + 1).cast("long").alias("rank"), F.col("e.id").alias("neighbour"), (-F.col("e.far")).alias("cosine"))
