"""The registered queries of the training-data operators, with SQL for those that SQL can express."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import decontaminate, fingerprints, language, licenses, line_dedup, minhash, mixing, pii, quality, simhash, spelling, token_counts, whitening
from .common import shared_folder

def doc_id() -> Column:
    return F.when(F.col("td_known"), F.col("td_id")).alias("doc_id")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pii.find_pii(table(spark, sf_dir, "documents").select("doc_id", "text"))
    names = [k.name for k in pii.BASE]
    of = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long")
    base = F.filter("spans", lambda s: s["kind"].isin(*names))
    return found.select("doc_id", *[of(n).alias(f"n_{n}") for n in names], F.sha2(pii.span_text(base), 256).alias("base_sha256"), pii.span_text(F.col("spans")).alias("spans"), F.array_join(F.transform("spans", lambda s: F.round(s["score"], 2).cast("string")), ",").alias("scores"))


def op2_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    pairs = fingerprints.edited_pairs(table(spark, sf_dir, "documents").select("doc_id", "text"))
    # One select a step: each sketch is computed once and then compared and printed.
    return pairs.select(
        doc_id(), F.length("text").cast("long").alias("n_chars"), F.sha2("edited", 256).alias("edited_sha256"),
        fingerprints.as_text(F.col("sketch")).alias("fingerprint"), fingerprints.as_text(F.col("edited_sketch")).alias("edited_fingerprint"),
        fingerprints.resemblance(F.col("sketch"), F.col("edited_sketch")).alias("near_edited"), fingerprints.resemblance(F.col("sketch"), F.col("next_sketch")).alias("near_next"),
    )


def op3_license(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = licenses.scan_licenses(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select("doc_id", "text_digest", "license", F.array_join("parts", "|").alias("parts"))


def op4_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    hits = decontaminate.contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return hits.select(
        doc_id(), (F.size("hits") > 0).alias("contaminated"), F.size("hits").cast("long").alias("n_items"), F.array_join(F.transform("hits", lambda h: h["item"].cast("string")), ",").alias("items"),
        F.array_min(F.transform("hits", lambda h: h["distance"])).cast("long").alias("least_distance"),
    )


def op5_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.label_groups(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op6_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents").select("doc_id", "text", "source")).select(doc_id(), "size", "source_size", "target", "taken")


def op7_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = line_dedup.dedup_lines(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return kept.select("doc_id", "n_lines", "n_dropped", F.sha2("kept_text", 256).alias("kept_sha256"))


def op8_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = language.train(docs)
    got = language.scores(docs.select("doc_id", "text"), model).select(doc_id(), "lang_pred", "score")
    return got.select("doc_id", language.held_out("doc_id").alias("held_out"), "lang_pred", "score")


def op9_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Totals after three batches over the whole table: all documents as they came, revised counts of every text that changes when runs of white space become one space, and the removal of toxic documents; the last is committed twice."""
    docs, version = table(spark, sf_dir, "documents"), "byte_bpe_50k"
    tidy = F.trim(F.regexp_replace("text", "[\\x20\\x09-\\x0D]+", " "))
    toxic = table(spark, sf_dir, "labels").filter("toxic = 1").select("doc_id", F.lit(version).alias("version"))
    ledger = token_counts.TokenLedger(spark, f"{shared_folder(spark)}/token-ledger-{uuid.uuid4().hex}")
    ledger.commit(1, token_counts.count_tokens(docs, version))
    ledger.commit(2, token_counts.count_tokens(docs.filter(tidy != F.col("text")).withColumn("text", tidy), version))
    for _ in range(2):
        ledger.commit(3, deletes=toxic)
    return ledger.totals()


def op10_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    ratings = table(spark, sf_dir, "labels").select("doc_id", quality.rating(F.col("quality"), F.col("toxic")).alias("grade"))
    model = quality.train(table(spark, sf_dir, "documents"), ratings, grades=3)
    got = quality.score(table(spark, sf_dir, "documents").select("doc_id", "text"), model)
    clean: Column = F.get("tails", F.lit(0))
    return got.select(doc_id(), "expected_grade", clean.alias("p_clean"), F.get("tails", F.lit(1)).alias("p_good"), (clean >= 0.5).alias("keep"))


def op11_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.label_groups(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op12_spelling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.group_variants(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op13_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.whiten(table(spark, sf_dir, "embeddings").select("vec_id", "embedding"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f for f in (op1_pii, op2_fingerprint, op3_license, op4_decontaminate, op5_simhash, op6_mix, op7_line_dedup, op8_language, op9_token_counts, op10_quality, op11_minhash, op12_spelling, op13_whitening)
}

_WHITE = "chr(32)||chr(9)||chr(10)||chr(11)||chr(12)||chr(13)"

ORACLE = {
    "op6_mix": """
WITH RECURSIVE sized AS (
  SELECT doc_id, source, CASE WHEN text IS NULL THEN 0 ELSE len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')) END::BIGINT AS size FROM documents
), sources AS (
  SELECT source, sum(size)::BIGINT AS source_size, [3, 1, 2][(row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1] AS weight FROM sized GROUP BY source
), ordered AS (
  SELECT *, 2.0 * source_size / weight AS ratio, sum(source_size) OVER () AS total, sum(weight) OVER () AS all_weight FROM sources
), held AS (
  SELECT *, coalesce(sum(2 * source_size) OVER w, 0) AS held_before, all_weight - coalesce(sum(weight) OVER w, 0) AS open_weight
  FROM ordered WINDOW w AS (ORDER BY ratio, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
), level AS (
  SELECT (1.5 * total - held_before)::DOUBLE AS rest, open_weight FROM held
  WHERE (1.5 * total - held_before)::DOUBLE / open_weight <= ratio ORDER BY ratio, source NULLS LAST LIMIT 1
), targets AS (
  SELECT source, source_size, CASE WHEN rest * weight / open_weight > 2.0 * source_size THEN 2.0 * source_size ELSE rest * weight / open_weight END::DOUBLE AS target
  FROM sources, level
), ranked AS (
  SELECT s.doc_id, s.size, t.source_size, t.target, CASE WHEN t.source_size > 0 THEN t.target / t.source_size ELSE 0 END::DOUBLE AS each_copies,
    row_number() OVER (PARTITION BY s.source ORDER BY s.size, s.doc_id) AS r,
    ('0x' || substr(md5('7:' || coalesce(s.source, chr(0))), 1, 8))::UBIGINT::DOUBLE / 4294967296.0::DOUBLE AS u
  FROM sized s JOIN targets t ON s.source IS NOT DISTINCT FROM t.source
)
SELECT doc_id, size, source_size, target, CASE WHEN size > 0 THEN (floor(each_copies * r + u) - floor(each_copies * (r - 1) + u))::BIGINT * size ELSE 0 END::BIGINT AS taken FROM ranked
""",
    "op7_line_dedup": f"""
WITH lines AS (
  SELECT doc_id, generate_subscripts(parts, 1) AS pos, unnest(parts) AS line FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS parts FROM documents)
), keyed AS (
  SELECT doc_id, pos, line, translate(trim(line, {_WHITE}), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS k FROM lines
), shared AS (
  SELECT k FROM keyed WHERE length(k) >= 1 GROUP BY k HAVING count(DISTINCT doc_id) >= 10
), marked AS (
  SELECT doc_id, pos, line, k IN (SELECT k FROM shared) AS gone FROM keyed
)
SELECT doc_id, count(*)::BIGINT AS n_lines, count(*) FILTER (gone)::BIGINT AS n_dropped,
  sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (NOT gone), '')) AS kept_sha256
FROM marked GROUP BY doc_id
""",
}
