"""Recommendations from baskets: co-occurrence, TF-IDF likeness of product texts, popularity."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions import ranks
from tidemark.functions.text import tokens


def popularity(df: DataFrame) -> DataFrame:
    return df.groupBy("product_name").agg(F.count(F.lit(1)).alias("n"))


def _baskets(df: DataFrame) -> DataFrame:
    return df.select("customer_name", "product_name").distinct()


def cooccurrence(df: DataFrame) -> DataFrame:
    """(a, b, customers): unordered pairs a < b of products that one customer bought, with the number of such customers.

    Products of a customer meet as arrays of distinct products (their number is bounded by the
    catalogue, not by rows); the counts are pre-aggregated before they shuffle.
    """
    sets = _baskets(df).groupBy("customer_name").agg(F.sort_array(F.collect_set("product_name")).alias("p"))
    first = sets.select("p", F.posexplode("p").alias("i", "a"))
    pairs = first.select("a", F.explode(F.filter("p", lambda x, j: j > F.col("i"))).alias("b"))
    return pairs.groupBy("a", "b").agg(F.count(F.lit(1)).alias("customers"))


def bought_with(df: DataFrame, product: str) -> DataFrame:
    """(product, n): customers who bought it together with one product. The rows are read once; a customer's distinct products are bounded by the catalogue."""
    sets = df.filter(F.col("customer_name").isNotNull()).groupBy("customer_name").agg(F.collect_set("product_name").alias("p"))
    with_it = sets.filter(F.array_contains("p", product)).select(F.explode("p").alias("product"))
    return with_it.filter(F.col("product") != product).groupBy("product").agg(F.count(F.lit(1)).alias("n"))


def tfidf(df: DataFrame) -> DataFrame:
    """(product, term, weight): smoothed TF-IDF of product name and category, of unit length."""
    docs = ranks.saved(df.groupBy(F.col("product_name").alias("product")).agg(F.min("category").alias("category")))  # a row a product, read for terms and their number
    t = docs.select("product", F.explode(F.filter(tokens(F.concat_ws(" ", "product", "category")), lambda w: F.length(w) > 1)).alias("term"))
    tf = t.groupBy("product", "term").agg(F.count(F.lit(1)).alias("tf"))
    n = docs.agg(F.count(F.lit(1)).alias("n"))
    idf = tf.groupBy("term").agg(F.count(F.lit(1)).alias("df")).crossJoin(F.broadcast(n)).select("term", (F.log((1 + F.col("n")) / (1 + F.col("df"))) + 1).alias("idf"))
    w = tf.join(idf, "term").select("product", "term", (F.col("tf") * F.col("idf")).alias("w"))
    norm = F.sqrt(F.sum(F.col("w") * F.col("w")).over(Window.partitionBy("product")))
    return w.select("product", "term", (F.col("w") / norm).alias("weight"))


def similar(df: DataFrame, product: str) -> DataFrame:
    """(product, cosine) of the texts of other products to one product's."""
    w = ranks.saved(tfidf(df))
    q = w.filter(F.col("product") == product).select("term", F.col("weight").alias("q"))
    return w.filter(F.col("product") != product).join(F.broadcast(q), "term").groupBy("product").agg(F.sum(F.col("weight") * F.col("q")).alias("cosine"))


def recommend(df: DataFrame, customer: str | None = None, product: str | None = None, k: int = 5) -> DataFrame:
    """(product, score): 2 x co-occurrence + 1.5 x text likeness for a product, co-occurrence with what a customer bought (without that), or .1 x popularity where neither gives any."""
    parts = []
    if product is not None:
        parts.append(bought_with(df, product).select("product", (F.col("n") * 2.0).alias("s")))
        parts.append(similar(df, product).select("product", (F.col("cosine") * 1.5).alias("s")))
    own = None
    if customer is not None:
        own = _baskets(df).filter(F.col("customer_name") == customer).select(F.col("product_name").alias("product"))
        pairs = cooccurrence(df)
        both = pairs.select(F.col("a").alias("x"), F.col("b").alias("product"), "customers").unionByName(pairs.select(F.col("b").alias("x"), F.col("a").alias("product"), "customers"))
        parts.append(both.join(own.select(F.col("product").alias("x")), "x").select("product", F.col("customers").cast("double").alias("s")))
    scores = None
    for p in parts:
        scores = p if scores is None else scores.unionByName(p)
    if scores is not None:
        scores = scores.groupBy("product").agg(F.sum("s").alias("s"))
        scores = ranks.saved(scores.join(own, "product", "left_anti") if own is not None else scores)  # a row a product, read to see whether there are any
    if scores is None or scores.isEmpty():
        scores = popularity(df).filter(F.col("product_name") != F.lit(product or "")).select(F.col("product_name").alias("product"), (F.col("n") * 0.1).alias("s"))
    return scores.select("product", F.round("s", 3).alias("score")).orderBy(F.desc("score"), "product").limit(k)
