"""Checks of an uploaded file before it is read."""

from __future__ import annotations

from pathlib import PurePosixPath

from pyspark.sql import SparkSession

from .files import SUFFIXES, detect_encoding, head, opened, sniff_delimiter

#: First bytes of file formats: fixed values.
MAGIC = {b"PAR1": "parquet", b"PK\x03\x04": "zip", b"\xd0\xcf\x11\xe0": "xls", b"%PDF": "pdf", b"\x1f\x8b": "gzip"}


def sha256(spark: SparkSession, path: str) -> str:
    """Digest of a file of any size, read as a stream through a buffer."""
    fs, where, _ = opened(spark, path)
    digest = spark._jvm.java.security.MessageDigest.getInstance("SHA-256")
    stream = spark._jvm.java.security.DigestInputStream(fs.open(where), digest)
    try:
        spark._jvm.org.apache.commons.io.IOUtils.consume(stream)
    finally:
        stream.close()
    return bytes(digest.digest()).hex()


def validate(spark: SparkSession, path: str, most_bytes: int = 1 << 30) -> dict:
    """size, sha256, suffix, kind, encoding, delimiter, errors of one file in any store that Spark reads."""
    file = opened(spark, path)
    if file is None:
        return {"errors": ["empty or no such file"]}
    start, suffix, errors = head(spark, path), PurePosixPath(path).suffix.lower().lstrip("."), []
    kind = next((k for m, k in MAGIC.items() if start.startswith(m)), "text")
    if suffix not in SUFFIXES:
        errors.append(f"unsupported file type: {suffix or 'none'}")
    elif (suffix == "parquet") != (kind == "parquet") or (suffix in ("zip", "xlsx")) != (kind == "zip"):
        errors.append(f"the content is {kind}, the name says {suffix}")
    if file[2] > most_bytes:
        errors.append(f"over {most_bytes} bytes")
    out = {"size": file[2], "sha256": sha256(spark, path), "suffix": suffix, "kind": kind, "errors": errors}
    if kind == "text" and start:
        enc = detect_encoding(start)
        out |= {"encoding": enc, "delimiter": sniff_delimiter(start, enc) if suffix in ("csv", "tsv", "txt") else None}
    return out
