"""Loading a star schema: dimensions by business key, facts by import job."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.functions import ranks
from tidemark.functions.text import business_key

from .files import append_job


def get_or_create(dim: DataFrame, wanted: DataFrame, key: str, id_column: str = "id") -> DataFrame:
    """dim with a row for every key of ``wanted`` (a frame with the key column) that it lacks, its other columns null, ids going on above the highest in order of the key.

    Keys are compared as business keys (123.0 is 123, blanks are no key); null keys create nothing.
    """
    keys = wanted.select(business_key(F.col(key)).alias(key)).filter(F.col(key).isNotNull()).distinct()
    new = keys.join(dim.select(business_key(F.col(key)).alias("_k")), F.col(key) == F.col("_k"), "left_anti")
    top = ranks.one_row(dim, F.coalesce(F.max(id_column), F.lit(0)).cast("long").alias("_top"))
    new = ranks.running(new, [key], rank="_i").crossJoin(top).select(key, (F.col("_i") + F.col("_top")).cast(dim.schema[id_column].dataType).alias(id_column))
    return dim.unionByName(new, allowMissingColumns=True)


def upsert(dim: DataFrame, rows: DataFrame, key: str, id_column: str = "id") -> DataFrame:
    """dim with the attributes of ``rows`` (one row a key; of several the greatest counts): known keys keep their id and any attribute that the row does not state, new keys get ids."""
    values = [c for c in rows.columns if c != key]
    row = rows.withColumn(key, business_key(F.col(key))).filter(F.col(key).isNotNull())
    one = row.groupBy(key).agg(F.max(F.struct(*values)).alias("_new")) if values else row.select(key).distinct().withColumn("_new", F.lit(None))
    whole = get_or_create(dim, one, key, id_column)
    j = whole.withColumn("_k", business_key(F.col(key))).join(one.select(F.col(key).alias("_k"), "_new"), "_k", "left")
    pick = lambda c: F.coalesce(F.col("_new")[c].cast(dim.schema[c].dataType), F.col(c)) if c in values else F.col(c)
    return j.select(*[pick(c).alias(c) for c in dim.columns])


def resolve(fact: DataFrame, dim: DataFrame, key: str, out: str, id_column: str = "id") -> DataFrame:
    """fact with ``out``, the dimension's id of its business key, in place of the key column; unknown keys give null. Of several rows with one key the least id counts, so facts are never repeated."""
    ids = dim.select(business_key(F.col(key)).alias("_k"), F.col(id_column).alias("_id")).filter("_k is not null").groupBy("_k").agg(F.min("_id").alias("_id"))
    j = fact.withColumn("_k", business_key(F.col(key))).join(ids, "_k", "left")
    return j.select(*[c for c in fact.columns if c != key], F.col("_id").alias(out))


def load(facts: DataFrame, dims: dict[str, tuple[DataFrame, str]], path: str, job: int) -> dict[str, DataFrame]:
    """Appends one job's facts to ``path`` with ids in place of business keys, and returns the grown dimensions. ``dims``: key column to (dimension, id column of the fact). Running a job again replaces its facts and, since its keys are known then, leaves the dimensions alone."""
    grown = {}
    for key, (dim, out) in dims.items():
        grown[key] = get_or_create(dim, facts, key)
        facts = resolve(facts, grown[key], key, out)
    append_job(facts, path, job)
    return grown
