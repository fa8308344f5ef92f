"""License scans: canonical digests of whole texts and of their parts, hash-joined to known ones. Native DataFrame functions only."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import KEY, bind, packed, unpacked
from .license_texts import KNOWN

#: Spellings that count as equal: fixed values, (variant, canonical), applied to whole words in this order.
SPELLINGS = (
    ("licence", "license"), ("licences", "licenses"), ("licenced", "licensed"), ("sublicence", "sublicense"), ("sub license", "sublicense"), ("organisation", "organization"),
    ("organisations", "organizations"), ("authorisation", "authorization"), ("authorised", "authorized"), ("favour", "favor"), ("behaviour", "behavior"), ("analyse", "analyze"),
    ("noncommercial", "non commercial"), ("fulfil", "fulfill"), ("labour", "labor"), ("honour", "honor"), ("https", "http"), ("copyright owner", "copyright holder"),
    ("initialise", "initialize"), ("modernise", "modernize"), ("recognise", "recognize"), ("realise", "realize"), ("utilisation", "utilization"), ("whilst", "while"), ("wilful", "willful"),
)
_MARKS = r"[^\p{L}\p{N}\n]*"
#: Words after "copyright" that make it a word of the license, not the start of a notice.
_NO_NAME = r"(?:notices?|holders?|owners?|ownership|laws?|licen[cs]es?|acts?|interests?|statements?|treat(?:y|ies)|protections?|permissions?|rights?|infringements?|disclaimers?|status|claims?|doctrines?|and|or|in|on|to|of|for|is|are|as|under|that|which|if|has|have|may|can|shall|will|does|with|not|from|this|these)\b"
_YEAR = r"(?:19|20)\d\d\b|[\[<{(]+(?:yyyy|xxxx|year)\b"
#: Notices: "copyright" or "(c)" with a year, "(c)", "by" or a name (and a next line that is only an address), a line that begins with the sign, and reserved
#: rights. A line of a wrapped license may begin with "copyright" too, so a bare name counts only at the start of a
#: paragraph or if capitalised names fill the line. "(c) Name" looks like a list item and must be a short paragraph.
COPYRIGHT = (
    rf"(?im)^{_MARKS}(?:"
    rf"(?:portions\s+)?copyright\b[ \t:,]*(?:\(c\)|©|&copy;|{_YEAR}|by\b)|\(c\)[ \t]*(?:copyright\b[ \t:,]*)?(?:{_YEAR})|©|all rights reserved"
    rf"|(?:portions\s+)?(?-i:Copyright)[ \t:]+(?!{_NO_NAME})(?-i:\p{{Lu}}[\p{{L}}\p{{N}}.&'’-]*(?:[ \t,]+(?:\p{{Lu}}[\p{{L}}\p{{N}}.&'’-]*|and|of|the|et|de|van|von)){{0,8}})(?:[ \t]*<[^>\n]*>)?[ \t\r.,]*$"
    r")[^\n]*$(?:\n[ \t*#/]*<[^>\n]+>[ \t\r]*$)?"
    rf"|(?:\A|^{_MARKS}\n){_MARKS}(?:(?:portions\s+)?copyright[ \t:]+(?!{_NO_NAME})[\p{{L}}\p{{N}}][^\n]*$|\(c\)[ \t]+[^\n]{{1,45}}(?=\n{_MARKS}(?:\n|\z)|\z))"
)


def canonical(text: Column) -> Column:
    """A text without copyright lines, in lower case, words parted by one space, variant spellings replaced."""
    plain = F.regexp_replace(text, COPYRIGHT, "\n")
    plain = F.btrim(F.regexp_replace(F.lower(plain), r"[^\p{L}\p{N}]+", " "))
    some = "|".join(variant for variant, _ in SPELLINGS)

    def respelled(words: Column) -> Column:
        for variant, spelling in SPELLINGS:
            words = F.regexp_replace(words, rf"\b{variant}\b", spelling)
        return words

    return bind(plain, lambda p: F.when(p.rlike(rf"\b(?:{some})\b"), respelled(p)).otherwise(p))


def digest(text: Column) -> Column:
    return F.sha2(canonical(text), 256)


def known_digests(spark: SparkSession, known: dict[str, str] = KNOWN) -> DataFrame:
    """(license, digest), one row for each distinct digest; a few dozen fixed texts, so it can be broadcast."""
    rows = spark.createDataFrame(sorted(known.items()), "license string, text string")
    return rows.groupBy(digest(F.col("text")).alias("digest")).agg(F.min("license").alias("license"))


def telling_words(spark: SparkSession, known: dict[str, str] = KNOWN) -> str:
    """An expression of few words of which every known text has one, in any spelling that counts as equal."""
    table = spark.createDataFrame([(t,) for t in known.values()], "text string").select(F.array_distinct(F.split(canonical(F.col("text")), " ")).alias("words"))
    left = [{w for w in r["words"] if w} for r in table.collect()]
    # Words that only appear where a spelling is split or joined could be written as another number of words.
    unsure = {w for _, spelling in SPELLINGS if " " in spelling for w in spelling.split()}
    written: dict[str, set[str]] = {}
    for variant, spelling in SPELLINGS:
        written.setdefault(spelling, set()).add(variant)
    chosen = []
    while left := [words for words in left if words]:
        counts: dict[str, int] = {}
        for words in left:
            for w in words:
                counts[w] = counts.get(w, 0) + 1
        # Of the words in most texts the longest, since it is in fewest others.
        best = max(counts, key=lambda w: (w not in unsure, counts[w] * min(len(w), 7), len(w), w))
        chosen.append(best)
        left = [words for words in left if best not in words]
    spelled = sorted({v for w in chosen for v in {w, *written.get(w, ())}})
    return "(?iu)" + ("|".join(re.escape(v).replace(r"\ ", r"[^\p{L}\p{N}]+") for v in spelled) or "(?!)")


def scan_licenses(docs: DataFrame, known: dict[str, str] = KNOWN, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Input columns plus ``text_digest``, ``license`` (of the entire text, or null) and ``parts``, sorted distinct licenses of whole lines and whole paragraphs.

    Every known text is looked up as an entire text, as a paragraph (lines up to a blank one) and as
    a line. Only parts that hold one of ``telling_words`` are digested, since no other can match.
    Null and empty texts have the digest of the empty string, which no license has. Rows are neither
    dropped nor merged, so repeated rows return repeated rows. Columns of the input named like an
    output are replaced.
    """
    spark = docs.sparkSession
    table = F.broadcast(known_digests(spark, known))  # a row a known text
    rows = packed(docs, doc_id, text)
    hint = telling_words(spark, known)
    lines = F.split("td_text", "\n", -1)
    paragraphs = F.split("td_text", r"\n[ \t\r]*\n\s*", -1)
    some = F.array_distinct(F.filter(F.concat(lines, paragraphs), lambda x: x.rlike(hint)))
    units = rows.filter(F.col("td_text").rlike(hint)).select(*KEY, F.explode(some).alias("part")).select(*KEY, digest(F.col("part")).alias("digest"))
    hits = units.join(table, "digest").groupBy(*KEY).agg(F.array_sort(F.collect_set("license")).alias("td_parts"))
    whole = rows.withColumn("digest", digest(F.col("td_text"))).join(table, "digest", "left")
    parts = F.coalesce("td_parts", F.array().cast("array<string>"))
    return unpacked(whole.join(hits, KEY, "left"), docs.columns, {"text_digest": F.col("digest"), "license": F.col("license"), "parts": parts})
