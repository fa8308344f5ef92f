"""Texts of document files: word-processing documents, web pages and plain text."""

from __future__ import annotations

import io
import zipfile
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

_WORD = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"


def docx_text(content: bytes) -> str:
    """Paragraphs of a document's body, a line each; tabs and line breaks within them are kept, tables, notes and deleted text are not read."""
    with zipfile.ZipFile(io.BytesIO(content)) as z:
        body = ElementTree.fromstring(z.read("word/document.xml")).find(f"{_WORD}body")
    lines = []
    for p in body.findall(f"{_WORD}p") if body is not None else ():
        signs = {f"{_WORD}tab": "\t", f"{_WORD}br": "\n", f"{_WORD}cr": "\n"}
        runs = (piece for run in p.iter(f"{_WORD}r") for piece in run)
        lines.append("".join(x.text or "" if x.tag == f"{_WORD}t" else signs.get(x.tag, "") for x in runs))
    return "\n".join(lines)


@F.pandas_udf(T.StructType([T.StructField("text", T.StringType()), T.StructField("error", T.StringType())]))
def _docx(content: pd.Series) -> pd.DataFrame:
    def one(c):
        if c is None:
            return None, None
        try:
            return docx_text(bytes(c)), None
        except (zipfile.BadZipFile, KeyError, ElementTree.ParseError) as e:
            return "", f"unreadable document: {type(e).__name__}"

    return pd.DataFrame([one(c) for c in content], columns=["text", "error"])


def read_documents(spark: SparkSession, path: str) -> DataFrame:
    """(title, source, doc_type, content, error) of the files of a folder or pattern, whole, a file a row.

    By suffix: docx by its paragraphs, html and htm with every tag a blank, anything else as UTF-8 without the bytes that are none.
    A document that cannot be read, and any PDF, has empty content and says why; a file of no bytes has no row, as Spark's
    file source passes over those. Only DOCX files go through Python.
    """
    files = spark.read.format("binaryFile").load(path).select("path", "content")
    title = F.element_at(F.split("path", "/"), -1)
    suffix = F.lower(F.regexp_extract(title, r"\.([^.]+)$", 1))
    kind = F.when(suffix == "", "txt").otherwise(suffix)
    rows = files.select("path", title.alias("title"), kind.alias("doc_type"), "content", _docx(F.when(kind == "docx", F.col("content"))).alias("d"))
    text = F.replace(F.make_valid_utf8(F.col("content").cast("string")), F.lit("�"), F.lit(""))
    content = (
        F.when(F.col("doc_type") == "docx", F.col("d.text"))
        .when(F.col("doc_type") == "pdf", "")
        .when(F.col("doc_type").isin("html", "htm"), F.regexp_replace(text, "<[^>]+>", " "))
        .otherwise(text)
    )
    error = F.when(F.col("doc_type") == "pdf", "PDF is not read").otherwise(F.col("d.error"))
    return rows.select("title", F.col("path").alias("source"), "doc_type", F.coalesce(content, F.lit("")).alias("content"), error.alias("error"))
