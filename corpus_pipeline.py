"""The corpus pipeline: documents in, a weighted training mix out.

Each stage takes (spark, docs, sf_dir), works on every row that its predecessor kept, and returns a
DataFrame that is written as Parquet and read again as the next one's docs. All but the last return
the columns of documents; the last adds ``copies`` and ``taken``.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from tidemark.llm import decontaminate, jaccard, language, line_dedup, mixing
from tidemark.llm.common import discard, shared_folder


def known_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents without letters (null and empty texts too) and those that look like no language of the rows' own labels, from which it learns. Repeated rows stay or go alike."""
    return language.in_learned_languages(docs, language.train(docs))


def without_shared_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops lines that at least 10 documents share; ``n_chars`` follows the text. No row goes: null and empty texts become empty ones, repeated rows stay."""
    return line_dedup.drop_lines(docs)


def one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the document with the smallest doc_id of each group of near copies: SimHash fingerprints within 3 bits, or five-word shingles of Jaccard similarity of at least 0.8. Empty texts are one group; of repeated rows one stays."""
    return jaccard.keep_one(docs)


def without_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that hold an item of the benchmark table with at most 6 % edits. Empty texts and those of an empty benchmark stay."""
    return decontaminate.decontaminate(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that the mix takes, with the number of copies of each. Texts without words are not taken; repeated rows become one with all their copies; null sources are one source."""
    return mixing.mixed_corpus(docs)


STAGES = [
    ("language", known_language),
    ("line_dedup", without_shared_lines),
    ("near_dedup", one_of_each_group),
    ("decontaminate", without_benchmark),
    ("mix", mixed),
]

#: The classifier and the edit distances have no SQL form; tests hold the stages against plain Python.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of the last stage. Each stage's folder goes when the next one is written; the last one's stays, as the result is read from it."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    folder = f"{shared_folder(spark)}/corpus-{uuid.uuid4().hex}"
    before = None
    for k, (name, stage) in enumerate(STAGES):
        path = f"{folder}/{k}-{name}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
        if before:
            discard(spark, before)
        before = path
    return docs
