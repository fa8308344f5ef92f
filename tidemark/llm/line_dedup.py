"""Line dedup: lines that many documents share go from all of them. Native DataFrame functions only.

Lines are exploded, normalised and hashed to 128 bits; distinct documents are counted by hash; the
positions of lines over the threshold are gathered by document; and each text is put together again
from the positions that are left. The text itself moves once, to meet its dropped positions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import KEY, WHITE, ascii_lower, bind, packed, spread, unpacked


def line_key(line: Column) -> Column:
    return ascii_lower(F.btrim(line, F.lit(WHITE)))


def _dropped(docs: DataFrame, min_docs: int, min_chars: int, doc_id: str, text: str) -> tuple[DataFrame, dict[str, Column]]:
    """The packed rows beside the positions of their dropped lines, and the columns ``kept_text``, ``n_lines`` and ``n_dropped`` over them."""
    rows = packed(docs, doc_id, text)
    lines = rows.select(*KEY, F.posexplode(F.split("td_text", "\n", -1)).alias("pos", "line"))
    lines = lines.withColumn("line", line_key(F.col("line"))).filter(F.length("line") >= max(min_chars, 0))
    lines = lines.select(*KEY, "pos", F.xxhash64("line").alias("h1"), F.xxhash64(F.lit(1), "line").alias("h2"))
    document = F.when(F.col("td_known"), F.col("td_id")).otherwise(F.col("td_hash")).alias("document")
    shared = (
        lines.select("h1", "h2", "td_known", document)
        .distinct()
        .groupBy("h1", "h2")
        .agg(F.count(F.lit(1)).alias("n"))
        .filter(F.col("n") >= min_docs)
        .select("h1", "h2")
    )
    drops = lines.join(spread(shared), ["h1", "h2"]).groupBy(*KEY).agg(F.collect_set("pos").alias("dropped"))
    parts = F.split("td_text", "\n", -1)
    joined = rows.join(drops, KEY, "left")
    left = F.array_except(F.sequence(F.lit(0), F.size(parts) - 1), F.col("dropped"))
    kept = F.array_join(bind(parts, lambda p: F.transform(left, lambda i: F.get(p, i))), "\n")
    kept = F.when(F.col("dropped").isNull(), F.col("td_text")).otherwise(kept)
    n_lines = F.size(parts).cast("long")
    n_dropped = F.coalesce(F.size("dropped"), F.lit(0)).cast("long")
    return joined, {"kept_text": kept, "n_lines": n_lines, "n_dropped": n_dropped}


def dedup_lines(docs: DataFrame, min_docs: int = 10, min_chars: int = 1, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Input columns plus ``kept_text``, ``n_lines`` and ``n_dropped``.

    A line's key is the line stripped of ASCII white space and with A-Z lower-cased. Keys of at
    least ``min_chars`` code points found in at least ``min_docs`` documents lose every line.
    Null and empty texts are one empty line (kept). Rows that share a doc_id count as one document;
    rows without a doc_id count by their text. Repeated rows return repeated rows. A column of the
    input named like an output is replaced.
    """
    joined, found = _dropped(docs, min_docs, min_chars, doc_id, text)
    return unpacked(joined, docs.columns, found)


def drop_lines(docs: DataFrame, min_docs: int = 10, min_chars: int = 1, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """The input rows and columns with the text as ``dedup_lines`` keeps it, and ``n_chars``, if there is such a column, as its length; all other columns stay as they are, whatever their names."""
    joined, found = _dropped(docs, min_docs, min_chars, doc_id, text)
    out = joined.withColumn("td_kept", found["kept_text"])
    new = {text: F.col("td_kept")} | ({"n_chars": F.length("td_kept").cast("long")} if "n_chars" in docs.columns else {})
    return out.select(*[(new[c] if c in new else F.col("td_row").getField(c)).alias(c) for c in docs.columns])
