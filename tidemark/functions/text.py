"""Text functions: tokens, masks, HTML, redaction."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def tokens(text: Column) -> Column:
    """Lower-case runs of a-z and 0-9."""
    return F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit("([a-z0-9]+)"), F.lit(1))


def strip_html(html: Column) -> Column:
    """Text of a page: tags become blanks, white space collapses."""
    return F.trim(F.regexp_replace(F.regexp_replace(html, "<[^>]+>", " "), r"\s+", " "))


def mask_email(text: Column) -> Column:
    """First character of the name, stars, and the domain."""
    return F.regexp_replace(text, r"([A-Za-z0-9])[A-Za-z0-9._%+\-]*@([A-Za-z0-9.\-]+\.[A-Za-z]{2,})", "$1***@$2")


def mask_partial(text: Column, keep: int = 4) -> Column:
    """Stars for all but the last ``keep`` characters; shorter texts are stars only."""
    n = F.length(text)
    return F.when(n <= keep, F.repeat(F.lit("*"), n)).otherwise(F.concat(F.repeat(F.lit("*"), n - keep), F.right(text, F.lit(keep))))


def mask_full(text: Column) -> Column:
    return F.repeat(F.lit("*"), F.length(text))


def mask_phone(text: Column, keep: int = 2) -> Column:
    """Every digit but the last ``keep`` becomes a star; separators stay."""
    digits_after = F.length(F.regexp_replace(text, "[^0-9]", ""))
    chars = F.filter(F.split(text, ""), lambda c: c != "")
    step = lambda acc, c: F.when(c.rlike("[0-9]"), F.struct((acc["n"] + 1).alias("n"), F.concat(acc["s"], F.when(acc["n"] < digits_after - keep, F.lit("*")).otherwise(c)).alias("s"))).otherwise(
        F.struct(acc["n"].alias("n"), F.concat(acc["s"], c).alias("s"))
    )
    return F.aggregate(chars, F.struct(F.lit(0).alias("n"), F.lit("").alias("s")), step, lambda acc: acc["s"])


def mask_text(text: Column) -> Column:
    """Free text with e-mail addresses masked, and in runs of 8 to 16 digits with single separators every digit but the last two."""
    plain, run = mask_email(text), r"\+?(?:\d[\s\-.()]?){8,16}"
    gaps, found = F.split(plain, run, -1), F.regexp_extract_all(plain, F.lit(run), F.lit(0))
    masked = F.array_join(F.transform(F.arrays_zip(gaps.alias("g"), F.concat(F.transform(found, lambda x: mask_phone(x)), F.array(F.lit(""))).alias("m")), lambda x: F.concat(x["g"], x["m"])), "")
    return F.when(plain.rlike(run), masked).otherwise(plain)


def mask_payload(value: Column, dtype: T.DataType, name: str = "") -> Column:
    """A value of any nested type with its strings masked: whole e-mail or phone cells by the name of their field or key, other strings as free text; other types stay."""
    if isinstance(dtype, T.StructType):
        fields = [mask_payload(value.getField(f.name), f.dataType, f.name).alias(f.name) for f in dtype.fields]
        return F.when(value.isNotNull(), F.struct(*fields))
    if isinstance(dtype, T.ArrayType):
        return F.transform(value, lambda x: mask_payload(x, dtype.elementType, name))
    if isinstance(dtype, T.MapType):
        if not isinstance(dtype.valueType, T.StringType):
            return F.transform_values(value, lambda k, v: mask_payload(v, dtype.valueType))
        low = lambda k: F.lower(k.cast("string"))
        return F.transform_values(value, lambda k, v: F.when(F.contains(low(k), F.lit("email")), mask_email(v)).when(low(k).rlike("phone|telepon|telp"), mask_phone(v)).otherwise(mask_text(v)))
    if not isinstance(dtype, T.StringType):
        return value
    low = name.lower()
    return mask_email(value) if "email" in low else mask_phone(value) if any(x in low for x in ("phone", "telepon", "telp")) else mask_text(value)


def masked_rows(df: DataFrame) -> DataFrame:
    """Every column through ``mask_payload``."""
    return df.select(*[mask_payload(F.col(f"`{f.name}`"), f.dataType, f.name).alias(f.name) for f in df.schema.fields])


def parse_structured(text: Column, required: list[str]) -> Column:
    """struct(value, error): the JSON object in an answer, fenced or with words around it, as a variant, if it has every required key; else the error not_json, not_object or missing_keys:a,b."""
    bare = F.regexp_replace(F.trim(F.coalesce(text, F.lit(""))), r"(?s)^```[a-zA-Z]*\s*|\s*```$", "")
    value = F.try_parse_json(F.nullif(F.regexp_extract(bare, r"(?s)\{.*\}", 0), F.lit("")))
    gaps = F.array_compact(F.array(*[F.when(F.try_variant_get(value, f"$.{k}", "variant").isNull(), F.lit(k)) for k in required])) if required else F.array().cast("array<string>")
    error = F.when(value.isNull(), "not_json").when(~F.startswith(F.schema_of_variant(value), F.lit("OBJECT")), "not_object").when(F.size(gaps) > 0, F.concat(F.lit("missing_keys:"), F.array_join(gaps, ",")))
    return F.struct(F.when(error.isNull(), value).alias("value"), error.alias("error"))


def redact(text: Column) -> Column:
    """Connection strings, key=value secrets and file paths become marks."""
    out = F.regexp_replace(text, r"(?i)\b[a-z][a-z0-9+.\-]*://[^\s:@/]+:[^\s@/]+@\S+", "[dsn]")
    out = F.regexp_replace(out, r"(?i)\b(password|passwd|pwd|secret|token|api_?key)\s*[=:]\s*\S+", "$1=[redacted]")
    return F.regexp_replace(out, r"(?<![\w])/(?:[\w.\-]+/)+[\w.\-]+", "[path]")


def numbers_in(text: Column) -> Column:
    """Number tokens without thousands separators; a per-cent sign stays."""
    found = F.regexp_extract_all(text, F.lit(r"(\d+(?:,\d{3})*(?:\.\d+)?%?)"), F.lit(1))
    return F.transform(found, lambda n: F.regexp_replace(n, ",", ""))


def unverified_numbers(answer: Column, evidence: Column) -> Column:
    """Numbers of an answer that do not occur in its evidence."""
    plain = F.regexp_replace(evidence, r"(?<=\d),(?=\d{3})", "")
    return F.filter(F.array_distinct(numbers_in(answer)), lambda n: ~F.contains(plain, n))


def business_key(c: Column) -> Column:
    """Trimmed text; integral floats collapse (123.0 to 123); blank, nan and None are null."""
    t = F.regexp_replace(F.trim(c.cast("string")), r"^(-?\d+)\.0+$", "$1")
    return F.when(F.lower(t).isin("", "nan", "none"), F.lit(None)).otherwise(t)
