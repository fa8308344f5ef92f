"""Rule-based data quality: two scans for any number of rules, and states of batches that add up."""

from __future__ import annotations

from dataclasses import dataclass, field
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.functions import ranks
from tidemark.sources.versions import Change, Table

KINDS = ("required", "nullable", "unique", "duplicate", "regex", "range", "enum", "referential", "datatype", "freshness", "completeness", "consistency", "validity", "schema_drift", "anomaly_ref")
SEVERITIES = ("error", "warn")


@dataclass(frozen=True)
class Rule:
    id: str
    type: str
    column: str | None = None
    params: dict[str, Any] = field(default_factory=dict)
    severity: str = "error"

    def __post_init__(self):
        if self.type not in KINDS:
            raise ValueError(f"rule {self.id}: unknown type {self.type!r}")
        if self.severity not in SEVERITIES:
            raise ValueError(f"rule {self.id}: severity is error or warn")
        if self.type not in ("duplicate", "completeness", "schema_drift") and not self.column:
            raise ValueError(f"rule {self.id}: {self.type} needs a column")


def text(c: str) -> Column:
    return F.col(f"`{c}`").cast("string")


def number(c: str) -> Column:
    return F.expr(f"try_cast(cast(`{c}` as string) as double)")


def day(c: str) -> Column:
    return F.expr(f"cast(try_to_timestamp(cast(`{c}` as string)) as date)")


def blank(c: str) -> Column:
    return F.col(f"`{c}`").isNull() | (F.trim(text(c)) == "")


def count_if(c: Column) -> Column:
    return F.coalesce(F.count_if(c), F.lit(0))


#: Text forms of each type: fixed values.
TYPE_PATTERNS = {"int": r"^\s*[+-]?\d+(\.0+)?\s*$", "bool": r"(?i)^\s*(true|false|0|1|yes|no)\s*$"}


def of_type(c: str, kind: str) -> Column:
    if kind in TYPE_PATTERNS:
        return text(c).rlike(TYPE_PATTERNS[kind])
    if kind in ("float", "number"):
        return number(c).isNotNull()
    if kind in ("date", "datetime"):
        return day(c).isNotNull()
    return F.lit(True)


def failing(rule: Rule) -> Column | None:
    """Condition of a failing row, for rules that look at one row at a time."""
    c, p = rule.column, rule.params
    there = F.col(f"`{c}`").isNotNull() if c else None
    if rule.type == "required":
        return blank(c) if p.get("blank_is_missing", True) else ~there
    if rule.type == "nullable":
        return ~there
    if rule.type == "regex":
        return there & ~text(c).rlike(f"^(?:{p['pattern']})$")
    if rule.type == "range":
        v = number(c)
        bad = v.isNull()
        if p.get("min") is not None:
            bad = bad | (v < p["min"] if p.get("inclusive", True) else v <= p["min"])
        if p.get("max") is not None:
            bad = bad | (v > p["max"] if p.get("inclusive", True) else v >= p["max"])
        return there & bad
    if rule.type in ("enum", "referential") and (listed := next((p[k] for k in ("allowed", "allowed_values", "values") if k in p), None)) is not None:
        return there & ~text(c).isin([str(v) for v in listed])
    if rule.type == "datatype":
        return ~blank(c) & ~of_type(c, p.get("dtype", p.get("type")))
    if rule.type == "validity":
        bad = {"no_negative": number(c) < 0, "parse_date": day(c).isNull(), "parse_number": number(c).isNull()}[p["check"]]
        return there & F.coalesce(bad, F.lit(False))
    return None


#: A state: counts by slot (a rule's id, ``values of`` a column, or the rows of a batch) and what was seen: a digest, a text or a number. States of several batches are merged by adding counts up.
STATE = "slot string, h1 long, h2 long, key string, value double, n long"
SEEN = ("slot", "h1", "h2", "key", "value")
ROWS = "*rows"


def _values(column: str) -> str:
    return f"values of {column}"


def _digest(df: DataFrame, columns: list[str]) -> list[Column]:
    """128 bits of the values in columns; a negative zero is a zero."""
    fine = {c: F.col(f"`{c}`") + F.lit(0.0).cast(df.schema[c].dataType) if df.schema[c].dataType.typeName() in ("double", "float") else F.col(f"`{c}`") for c in columns}
    values = [x for v in fine.values() for x in (v, v.isNull())]
    return [F.xxhash64(*values), F.xxhash64(F.lit("second"), *values)]


def state(df: DataFrame, rules: list[Rule]) -> DataFrame:
    """What the rules need to know of a batch, in two scans whatever their number: one sums up conditions on single rows, one counts what unique, duplicate, referential, freshness, consistency and anomaly_ref look at. Equal values are told by 128-bit digests."""
    columns, n = set(df.columns), F.count(F.lit(1))
    sums: list[tuple[str, Column]] = [(ROWS, n)]
    drift: list[tuple] = []
    slots: dict[str, Column] = {}
    kinds = (("h1", "long"), ("h2", "long"), ("key", "string"), ("value", "double"))

    def seen(slot: str, ok: Column, **what: Column) -> None:
        if slot not in slots:
            slots[slot] = F.when(ok, F.struct(F.lit(len(slots)).alias("i"), *[what.get(c, F.lit(None)).cast(t).alias(c) for c, t in kinds]))

    for r in rules:
        if r.type == "schema_drift":
            drift += [(r.id, None, None, c, None, 1) for c in sorted(set(r.params["columns"]) ^ columns)]
        elif r.column and r.column not in columns:
            sums.append((r.id, n))
        elif (bad := failing(r)) is not None:
            sums.append((r.id, count_if(bad)))
        elif r.type == "completeness":
            cols = [r.column] if r.column else df.columns
            sums.append((r.id, sum((count_if(F.col(f"`{c}`").isNull()) for c in cols[1:]), count_if(F.col(f"`{cols[0]}`").isNull()))))
        elif r.type in ("duplicate", "unique"):
            one, two = _digest(df, [r.column] if r.type == "unique" else r.params.get("subset") or df.columns)
            seen(r.id, F.col(f"`{r.column}`").isNotNull() if r.type == "unique" else F.lit(True), h1=one, h2=two)
        elif r.type == "referential":
            t = text(r.column)
            seen(r.id, t.isNotNull(), h1=F.xxhash64(t), h2=F.xxhash64(F.lit("second"), t))
        elif r.type == "freshness":
            seen(r.id, F.lit(True), key=day(r.column))
        else:  # consistency, anomaly_ref
            v = number(r.column)
            seen(_values(r.column), v.isNotNull(), value=v)
    pairs = ", ".join(f"'{slot}', f{i}" for i, (slot, _) in enumerate(sums))
    out = df.agg(*[c.cast("long").alias(f"f{i}") for i, (_, c) in enumerate(sums)]).select(F.expr(f"stack({len(sums)}, {pairs}) as (slot, n)"))
    out = out.select("slot", *[F.lit(None).cast(t).alias(c) for c, t in kinds], "n")
    if slots:
        rows = df.select(F.explode(F.array_compact(F.array(*slots.values()))).alias("x")).select("x.*").groupBy("i", *[c for c, _ in kinds]).agg(n.alias("n"))
        out = out.unionByName(rows.select(F.get(F.array(*[F.lit(s) for s in slots]), F.col("i")).alias("slot"), *[c for c, _ in kinds], "n"))
    return out.unionByName(df.sparkSession.createDataFrame(drift, STATE)) if drift else out


def merged(states: DataFrame) -> DataFrame:
    return states.groupBy(*SEEN).agg(F.sum("n").alias("n"))


def _allowed(r: Rule, width: int) -> float:
    """The share of failures with which a rule still passes."""
    if r.type == "completeness":
        return (1 - r.params.get("min_ratio", 1.0)) * (1 if r.column else width)
    return float({"nullable": r.params.get("max_null_ratio", 0.0), "consistency": r.params.get("max_ratio", 0.05), "anomaly_ref": r.params.get("max_ratio", 0.05)}.get(r.type, 0.0))


def results(known: DataFrame, rules: list[Rule], columns: int, as_of: str | None = None) -> DataFrame:
    """Outcomes of the rules, as ``evaluate`` has them, from the merged state of all batches. The rows of the batches are not read; ``columns`` is their number of columns."""
    spark = known.sparkSession
    known = ranks.saved(known)
    slot, n, zero = F.col("slot"), F.col("n"), F.lit(0).cast("long")
    of = lambda *types: [r.id for r in rules if r.type in types]
    # A rule on a missing column has a count of its own instead of what was seen.
    told, d = F.col("h1").isNotNull(), F.col("key").cast("date")
    ages = F.create_map(*[F.lit(x) for r in rules if r.type == "freshness" for x in (r.id, int(r.params["max_age_days"]))]) if of("freshness") else None
    last = F.date_sub(F.to_date(F.lit(as_of)) if as_of else F.current_date(), ages[slot]) if ages is not None else F.lit(None).cast("date")
    fails = F.when(slot.isin(*of("unique")) & told, F.when(n > 1, n).otherwise(zero)).when(slot.isin(*of("duplicate")) & told, n - 1).when(slot.isin(*of("schema_drift")), 1)
    fails = fails.when(slot.isin(*of("freshness")) & (d >= last), zero).when(slot.isin(*of("referential")) & told, zero).otherwise(n)
    fresh = F.max(F.when(slot.isin(*of("freshness")) & (d >= last), 1))
    frames = [known.filter("value is null").groupBy("slot").agg(F.when(fresh == 1, zero).otherwise(F.sum(fails)).alias("failures"))]
    for r in rules:
        if r.type == "referential" and "frame" in r.params:
            t = F.col(r.params["key"]).cast("string")
            there = r.params["frame"].select(F.xxhash64(t).alias("h1"), F.xxhash64(F.lit("second"), t).alias("h2")).distinct()
            frames.append(known.filter((slot == r.id) & told).join(there, ["h1", "h2"], "left_anti").groupBy("slot").agg(F.sum("n").alias("failures")))
    measured = sorted({r.column for r in rules if r.type in ("consistency", "anomaly_ref")})
    if measured:
        hist = ranks.saved(known.filter(F.col("value").isNotNull()).select(slot.alias("i"), F.col("value").alias("v"), "n"))
        fences = [_values(r.column) for r in rules if r.type == "consistency"]
        q = ranks.quantiles_of(hist.filter(F.col("i").isin(*fences)), [0.25, 0.75]).select("i", "total", F.get("q", F.lit(0)).alias("q1"), F.get("q", F.lit(1)).alias("q3")) if fences else spark.createDataFrame([], "i string, total long, q1 double, q3 double")
        m = hist.groupBy("i").agg((F.sum(F.col("v") * n) / F.sum("n")).alias("m"), F.sum("n").alias("k"))
        far = hist.join(F.broadcast(m), "i")  # a row a column
        sd = far.groupBy("i").agg(F.sqrt(F.try_divide(F.sum(n * (F.col("v") - F.col("m")) ** 2), F.max("k") - 1)).alias("sd"))
        spread = F.col("q3") - F.col("q1")
        out = (F.col("total") >= 8) & (spread != 0) & ((F.col("v") < F.col("q1") - 1.5 * spread) | (F.col("v") > F.col("q3") + 1.5 * spread))
        off = (F.col("k") >= 3) & (F.col("sd") > 0)
        asked = [(r.id, _values(r.column), r.type == "consistency", float(r.params.get("sensitivity", 3.0))) for r in rules if r.type in ("consistency", "anomaly_ref")]
        each = [F.sum(F.when(F.col("i") == i, F.when(out if fence else off & (F.abs(F.try_divide(F.col("v") - F.col("m"), F.col("sd"))) > sense), n))).alias(f"f{j}") for j, (_, i, fence, sense) in enumerate(asked)]
        row = far.join(F.broadcast(sd), "i").join(F.broadcast(q), "i", "left").agg(*each)
        pairs = ", ".join(f"'{rid}', f{j}" for j, (rid, *_) in enumerate(asked))
        frames.append(row.select(F.expr(f"stack({len(asked)}, {pairs}) as (slot, failures)")))
    found = frames[0]
    for f in frames[1:]:
        found = found.unionByName(f)
    found = found.groupBy(F.col("slot").alias("rule_id")).agg(F.sum("failures").alias("failures"), F.max(F.when(slot == ROWS, F.col("failures"))).alias("rows"))
    meta = spark.createDataFrame([(r.id, r.type, r.column, r.severity, _allowed(r, columns)) for r in rules], "rule_id string, type string, column string, severity string, allowed double")
    found = ranks.saved(found)  # a row a rule
    rows = found.agg(F.coalesce(F.max("rows"), zero).alias("rows"))
    whole = meta.join(F.broadcast(found.drop("rows")), "rule_id", "left").crossJoin(F.broadcast(rows)).withColumn("failures", F.coalesce("failures", zero))
    ratio = F.col("failures") / F.greatest("rows", F.lit(1))
    drift = F.col("type") == "schema_drift"
    passed = F.when(drift, F.col("failures") == 0).otherwise(ratio <= F.col("allowed"))
    score = F.when(F.col("rows") == 0, 0.0).when(drift, (F.col("failures") == 0).cast("double")).otherwise(F.greatest(F.lit(0.0), 1 - ratio))
    return whole.select("rule_id", "type", "column", "severity", F.col("failures").cast("long").alias("failures"), F.col("rows").cast("long").alias("rows"), passed.alias("passed"), F.round(score, 6).alias("score"))


def evaluate(df: DataFrame, rules: list[Rule], as_of: str | None = None) -> DataFrame:
    """rule_id, type, column, severity, failures, rows, passed, score; one row a rule.

    The rows are read twice, whatever the number of rules; everything else comes from their ``state``. A rule on a
    missing column fails for every row.
    """
    return results(state(df, rules), rules, len(df.columns), as_of)


class Incremental:
    """Quality of a table that grows by batches: each batch's state is kept in a versioned table, and outcomes come from the merged states without reading old rows."""

    def __init__(self, spark: SparkSession, folder: str, rules: list[Rule]):
        self.rules, self.table = rules, Table(spark, folder, STATE + ", columns int")

    def add(self, batch: DataFrame) -> int:
        return self.table.append(state(batch, self.rules).withColumn("columns", F.lit(len(batch.columns))))

    def results(self, as_of: str | None = None, version: int | None = None) -> DataFrame:
        rows = self.table.read(version)
        width = rows.agg(F.max("columns")).first()[0] or 0
        return results(merged(rows), self.rules, width, as_of)

    def compact(self) -> int:
        """One merged state in place of those of all batches."""

        def plan(version: int) -> Change:
            rows = self.table.read(version)
            whole = merged(rows).crossJoin(F.broadcast(rows.agg(F.max("columns").alias("columns"))))
            return Change((self.table.stage(whole),), tuple(self.table.parts(version)))

        return self.table.commit(plan)


def verdict(results: DataFrame) -> DataFrame:
    """One row: score (mean over rules), verdict: fail if an error rule failed, warn if only warnings did, else pass."""
    bad = lambda s: F.coalesce(F.max((~F.col("passed") & (F.col("severity") == s)).cast("int")), F.lit(0)) == 1
    return results.agg(F.round(F.coalesce(F.avg("score"), F.lit(0.0)), 6).alias("score"), F.when(bad("error"), "fail").when(bad("warn"), "warn").otherwise("pass").alias("verdict"))


#: Built-in rule sets: fixed values (ids, columns, types, parameters, severities).
PROFILES = {
    "sales_strict": [
        Rule("customer_required", "required", "customer", {}, "error"),
        Rule("product_required", "required", "product", {}, "error"),
        Rule("quantity_valid", "validity", "quantity", {"check": "no_negative"}, "error"),
        Rule("price_valid", "validity", "price", {"check": "parse_number"}, "error"),
        Rule("date_fresh", "freshness", "date", {"max_age_days": 90}, "warn"),
        Rule("no_exact_duplicates", "duplicate", None, {}, "warn"),
        Rule("branch_known", "referential", "branch", {"allowed_values": ["Jakarta", "Bandung", "Surabaya"]}, "warn"),
    ],
    "inventory_standard": [
        Rule("product_required", "required", "product", {}, "error"),
        Rule("warehouse_required", "required", "warehouse", {}, "error"),
        Rule("stock_valid", "validity", "stock_qty", {"check": "no_negative"}, "error"),
        Rule("stock_range", "range", "stock_qty", {"min": 0, "max": 1000000}, "warn"),
        Rule("no_exact_duplicates", "duplicate", None, {}, "error"),
    ],
    "customers_pii_aware": [
        Rule("customer_required", "required", "customer", {}, "error"),
        Rule("email_format", "regex", "email", {"pattern": r"^[^@\s]+@[^@\s]+\.[^@\s]+$"}, "error"),
        Rule("phone_type", "datatype", "phone", {"dtype": "string"}, "warn"),
        Rule("segment_known", "enum", "segment", {"allowed": ["new", "regular", "vip", "churned"]}, "warn"),
        Rule("customer_unique", "unique", "customer", {}, "error"),
    ],
}


def import_score(df: DataFrame) -> DataFrame:
    """One row: completeness, uniqueness, validity, consistency, score (their mean), passed at 0.6 with no dimension at 0.

    Validity counts negatives in quantity and stock columns and text that is no number in measures;
    consistency counts 1.5 x IQR outliers of columns with at least 8 numbers.
    """
    cols = df.columns
    n = F.count(F.lit(1))
    zero = F.lit(0).cast("long")
    nulls = sum((count_if(F.col(f"`{c}`").isNull()) for c in cols), zero)
    invalid = zero
    for c in cols:
        low = c.lower()
        unread = count_if(F.col(f"`{c}`").isNotNull() & number(c).isNull())
        if any(k in low for k in ("quantity", "qty", "stock")):
            invalid = invalid + count_if(number(c) < 0) + unread
        if any(k in low for k in ("price", "harga", "revenue", "amount", "cost", "total")):
            invalid = invalid + unread
    numeric = [f.name for f in df.schema.fields if f.dataType.typeName() in ("double", "float", "integer", "long", "short", "decimal")]
    dup = df.groupBy(*ranks.row_digest(cols)).agg(n.alias("_n")).agg(F.coalesce(F.sum(F.col("_n") - 1), zero).alias("dup"))
    row = df.agg(n.alias("n"), nulls.alias("nulls"), invalid.alias("invalid")).crossJoin(dup)
    if numeric:
        q = ranks.quantiles(df, [number(c) for c in numeric], [0.25, 0.75])
        q = q.select(*[F.col(f"{x}{i}").alias(f"_{x}{i}") for i in range(len(numeric)) for x in "qk"])

        def out(i: int, c: str) -> Column:
            q1, q3 = F.get(f"_q{i}", F.lit(0)), F.get(f"_q{i}", F.lit(1))
            return count_if((F.col(f"_k{i}") >= 8) & (q3 != q1) & ((number(c) < q1 - 1.5 * (q3 - q1)) | (number(c) > q3 + 1.5 * (q3 - q1))))

        row = row.crossJoin(df.crossJoin(F.broadcast(q)).agg(sum((out(i, c) for i, c in enumerate(numeric)), zero).alias("odd")))
    else:
        row = row.withColumn("odd", zero)
    cells = F.col("n") * len(cols)
    part = lambda x, of: F.round(F.greatest(F.lit(0.0), 1 - F.try_divide(F.col(x), of)), 4)
    out_row = row.select(part("nulls", cells).alias("completeness"), part("dup", F.col("n")).alias("uniqueness"), part("invalid", cells).alias("validity"), part("odd", cells).alias("consistency"))
    four = [F.coalesce(F.col(c), F.lit(0.0)) for c in ("completeness", "uniqueness", "validity", "consistency")]
    out_row = out_row.select(*[c.alias(k) for c, k in zip(four, ("completeness", "uniqueness", "validity", "consistency"), strict=True)])
    score = F.round((F.col("completeness") + F.col("uniqueness") + F.col("validity") + F.col("consistency")) / 4, 4)
    return out_row.withColumn("score", score).withColumn("passed", (F.col("score") >= 0.6) & (F.least("completeness", "uniqueness", "validity", "consistency") > 0))


def profile(df: DataFrame, samples: int = 3) -> DataFrame:
    """column, dtype, missing, missing_pct, distinct, smallest, largest (as text), samples (the ``samples`` smallest distinct values as text), over_30_pct_missing; one row a column.

    Values are counted as (column, value) pairs, so no aggregate holds the distinct values of a column.
    """
    long = df.select(F.explode(F.array(*[F.struct(F.lit(i).alias("i"), F.col(f"`{c}`").cast("string").alias("v")) for i, c in enumerate(df.columns)])).alias("x")).select("x.i", "x.v")
    pairs = long.groupBy("i", "v").agg(F.count(F.lit(1)).alias("n"))
    # Few smallest values from each task's part before they meet.
    first = pairs.filter("v is not null").withColumn("_part", F.pmod(F.xxhash64("v"), F.lit(64)))
    few = Window.partitionBy("i", "_part").orderBy("v")
    first = first.withColumn("_r", F.row_number().over(few)).filter(F.col("_r") <= samples).groupBy("i").agg(F.slice(F.sort_array(F.collect_list("v")), 1, samples).alias("samples"))
    counts = pairs.groupBy("i").agg(F.sum(F.when(F.col("v").isNull(), F.col("n"))).alias("m"), F.count("v").alias("distinct"), F.sum("n").alias("n"))
    ends = df.agg(*[x for i, c in enumerate(df.columns) for x in (F.min(F.col(f"`{c}`")).cast("string").alias(f"lo{i}"), F.max(F.col(f"`{c}`")).cast("string").alias(f"hi{i}"))])
    parts = ", ".join(f"{i}, '{c}', '{t}', lo{i}, hi{i}" for i, (c, t) in enumerate(df.dtypes))
    ends = ends.select(F.expr(f"stack({len(df.columns)}, {parts}) as (i, column, dtype, smallest, largest)"))
    missing = F.coalesce("m", F.lit(0))
    rate = F.when(F.col("n") > 0, F.round(missing / F.col("n") * 100, 2)).otherwise(0.0)
    out = ends.join(counts, "i", "left").join(first, "i", "left")
    return out.select(
        "column", "dtype", missing.alias("missing"), rate.alias("missing_pct"), F.coalesce("distinct", F.lit(0)).alias("distinct"), "smallest", "largest",
        F.coalesce("samples", F.array().cast("array<string>")).alias("samples"), (rate > 30).alias("over_30_pct_missing"),
    )


def preview(df: DataFrame, rows: int = 20) -> tuple[list[dict], int]:
    """(the first ``rows`` rows, number of rows that repeat another one)."""
    repeats = df.groupBy(*ranks.row_digest(df.columns)).agg(F.count(F.lit(1)).alias("_n")).agg(F.coalesce(F.sum(F.col("_n") - 1), F.lit(0)).alias("n"))
    return [r.asDict(recursive=True) for r in df.limit(rows).collect()], repeats.first()["n"]


#: Patterns of personal data in cells: fixed values.
PII_PATTERNS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}",
    "phone": r"(?:\+?62[\s-]?|0)(?:\d[\s-]?){8,12}\d",
    "credit_card": r"\b(?:\d[ -]?){13,19}\b",
    "national_id": r"\b\d{16}\b",
}


def pii_cells(df: DataFrame, columns: list[str], extra: dict[str, str] | None = None) -> DataFrame:
    """column, kind, count of cells that match a pattern and are credible as a whole (digit counts, Luhn, not one digit throughout)."""
    checks = []
    for c in columns:
        digits = F.regexp_replace(text(c), r"\D", "")
        varied = F.size(F.array_distinct(F.filter(F.split(digits, ""), lambda d: d != ""))) > 1
        credible = {
            "credit_card": F.length(digits).between(13, 19) & varied & F.coalesce(F.call_function("luhn_check", digits), F.lit(False)),
            "national_id": (F.length(digits) == 16) & varied,
            "phone": varied,
        }
        for kind, pattern in {**PII_PATTERNS, **(extra or {})}.items():
            checks.append((c, kind, count_if(text(c).rlike(pattern) & credible.get(kind, F.lit(True)))))
    row = df.agg(*[x.alias(f"c{i}") for i, (_, _, x) in enumerate(checks)])
    parts = ", ".join(f"'{c}', '{k}', c{i}" for i, (c, k, _) in enumerate(checks))
    return row.select(F.expr(f"stack({len(checks)}, {parts}) as (column, kind, count)")).filter("count > 0")


def mask_found(df: DataFrame, found: list[tuple[str, str]]) -> DataFrame:
    """Masks the columns named in (column, kind) findings: e-mail cells keep one character and the domain, others their last four characters."""
    from tidemark.functions.text import mask_email, mask_partial

    kinds: dict[str, set[str]] = {}
    for c, k in found:
        kinds.setdefault(c, set()).add(k)
    for c, ks in kinds.items():
        masked = mask_partial(text(c))
        df = df.withColumn(c, F.when(F.contains(text(c), F.lit("@")), mask_email(text(c))).otherwise(masked) if "email" in ks else masked)
    return df


def schema_changes(old: DataFrame, new: DataFrame) -> DataFrame:
    """(column, change): added, removed or type_changed, from two (column, dtype) frames."""
    j = old.select("column", F.col("dtype").alias("a")).join(new.select("column", F.col("dtype").alias("b")), "column", "full")
    change = F.when(F.col("a").isNull(), "added").when(F.col("b").isNull(), "removed").when(F.col("a") != F.col("b"), "type_changed")
    return j.select("column", change.alias("change")).filter("change is not null")


def merge_scores(parts: DataFrame, passing: float = 0.8) -> DataFrame:
    """One row from parts (n, completeness, uniqueness, validity, consistency): each score weighted by rows (4 digits), their mean as ``score``, and ``passed``. No rows at all: zeros, not passed."""
    names = ("completeness", "uniqueness", "validity", "consistency")
    n = F.sum("n")
    means = parts.agg(*[F.coalesce(F.round(F.try_divide(F.sum(F.col(c) * F.col("n")), n), 4), F.lit(0.0)).alias(c) for c in names])
    mean = F.round(sum((F.col(c) for c in names[1:]), F.col(names[0])) / len(names), 4)
    return means.withColumn("score", mean).withColumn("passed", F.col("score") >= passing)
