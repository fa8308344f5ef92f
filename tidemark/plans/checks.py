"""Data quality, profile, PII-in-cells and governance queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.functions import text
from tidemark.operators import catalog, ledger, lineage, quality
from tidemark.operators.quality import Rule
from tidemark.registry import register
from tidemark.sources import clean, files, warehouse
from tidemark.sources.star import table

#: Rules over a copy of orders with blanks, gaps and bad values put in by key.
DIRTY_SQL = """dirty AS (SELECT o_orderkey, CASE WHEN o_orderkey % 7 = 0 THEN NULL WHEN o_orderkey % 11 = 0 THEN ' ' ELSE o_orderstatus END AS status, CASE WHEN o_orderkey % 13 = 0 THEN -o_totalprice ELSE o_totalprice END AS price,
  CASE WHEN o_orderkey % 17 = 0 THEN 'n/a' ELSE o_custkey::VARCHAR END AS cust, o_orderpriority AS priority, o_orderdate::DATE AS day FROM orders)"""


def dirty(spark, sf_dir):
    k = F.col("o_orderkey")
    return table(spark, sf_dir, "orders").select(
        k, F.when(k % 7 == 0, F.lit(None)).when(k % 11 == 0, " ").otherwise(F.col("o_orderstatus")).alias("status"), F.when(k % 13 == 0, -F.col("o_totalprice")).otherwise(F.col("o_totalprice")).alias("price"),
        F.when(k % 17 == 0, "n/a").otherwise(F.col("o_custkey").cast("string")).alias("cust"), F.col("o_orderpriority").alias("priority"), F.col("o_orderdate").cast("date").alias("day"),
    )


def rules(spark, sf_dir):
    return [
        Rule("required_status", "required", "status"), Rule("nullable_status", "nullable", "status", {"max_null_ratio": 0.2}, "warn"), Rule("unique_cust", "unique", "cust", severity="warn"), Rule("unique_key", "unique", "o_orderkey"),
        Rule("duplicate_rows", "duplicate"), Rule("duplicate_cust_day", "duplicate", None, {"subset": ["cust", "day"]}, "warn"), Rule("regex_priority", "regex", "priority", {"pattern": "[1-5]-[A-Z ]+"}), Rule("range_price", "range", "price", {"min": 0, "max": 400000}),
        Rule("enum_status", "enum", "status", {"values": ["O", "F"]}, "warn"), Rule("referential_cust", "referential", "cust", {"frame": table(spark, sf_dir, "customer"), "key": "c_custkey"}), Rule("datatype_cust", "datatype", "cust", {"type": "int"}),
        Rule("freshness_day", "freshness", "day", {"max_age_days": 30}, "warn"), Rule("complete_frame", "completeness", None, {"min_ratio": 0.95}), Rule("complete_status", "completeness", "status", {"min_ratio": 0.9}), Rule("consistent_price", "consistency", "price"),
        Rule("valid_price", "validity", "price", {"check": "no_negative"}), Rule("valid_cust", "validity", "cust", {"check": "parse_number"}), Rule("schema", "schema_drift", None, {"columns": ["o_orderkey", "status", "price", "cust", "priority", "day", "extra"]}, "warn"),
        Rule("anomaly_price", "anomaly_ref", "price", {"sensitivity": 2.0}, "warn"), Rule("missing_column", "required", "absent", severity="warn"),
    ]


_N = "(SELECT count(*) FROM dirty)"
#: rule id: (type, column, severity, failures, allowed ratio or null for schema drift)
_RULE_SQL = {
    "required_status": ("required", "status", "error", "(SELECT count(*) FROM dirty WHERE status IS NULL OR trim(status) = '')", "0"),
    "nullable_status": ("nullable", "status", "warn", "(SELECT count(*) FROM dirty WHERE status IS NULL)", "0.2"),
    "unique_cust": ("unique", "cust", "warn", "(SELECT coalesce(sum(n), 0) FROM (SELECT count(*) AS n FROM dirty WHERE cust IS NOT NULL GROUP BY cust HAVING count(*) > 1))", "0"),
    "unique_key": ("unique", "o_orderkey", "error", "(SELECT coalesce(sum(n), 0) FROM (SELECT count(*) AS n FROM dirty GROUP BY o_orderkey HAVING count(*) > 1))", "0"),
    "duplicate_rows": ("duplicate", None, "error", f"({_N} - (SELECT count(*) FROM (SELECT DISTINCT * FROM dirty)))", "0"),
    "duplicate_cust_day": ("duplicate", None, "warn", f"({_N} - (SELECT count(*) FROM (SELECT DISTINCT cust, day FROM dirty)))", "0"),
    "regex_priority": ("regex", "priority", "error", "(SELECT count(*) FROM dirty WHERE NOT regexp_full_match(priority, '[1-5]-[A-Z ]+'))", "0"),
    "range_price": ("range", "price", "error", "(SELECT count(*) FROM dirty WHERE price < 0 OR price > 400000)", "0"),
    "enum_status": ("enum", "status", "warn", "(SELECT count(*) FROM dirty WHERE status NOT IN ('O', 'F'))", "0"),
    "referential_cust": ("referential", "cust", "error", "(SELECT count(*) FROM dirty WHERE cust NOT IN (SELECT c_custkey::VARCHAR FROM customer))", "0"),
    "datatype_cust": ("datatype", "cust", "error", "(SELECT count(*) FROM dirty WHERE NOT regexp_matches(cust, '^\\s*[+-]?\\d+(\\.0+)?\\s*$'))", "0"),
    "freshness_day": ("freshness", "day", "warn", "(SELECT CASE WHEN max(day) >= DATE '2002-01-01' - 30 THEN 0 ELSE count(*) FILTER (day < DATE '2002-01-01' - 30) END FROM dirty)", "0"),
    "complete_frame": ("completeness", None, "error", "(SELECT count(*) FROM dirty WHERE status IS NULL)", "0.3"),
    "complete_status": ("completeness", "status", "error", "(SELECT count(*) FROM dirty WHERE status IS NULL)", "0.1"),
    "consistent_price": ("consistency", "price", "error", "(SELECT count(*) FROM dirty, (SELECT quantile_cont(price, 0.25) AS a, quantile_cont(price, 0.75) AS b FROM dirty) WHERE price < a - 1.5 * (b - a) OR price > b + 1.5 * (b - a))", "0.05"),
    "valid_price": ("validity", "price", "error", "(SELECT count(*) FROM dirty WHERE price < 0)", "0"),
    "valid_cust": ("validity", "cust", "error", "(SELECT count(*) FROM dirty WHERE try_cast(cust AS DOUBLE) IS NULL)", "0"),
    "schema": ("schema_drift", None, "warn", "1", None),
    "anomaly_price": ("anomaly_ref", "price", "warn", "(SELECT count(*) FROM dirty, (SELECT avg(price) AS m, stddev_samp(price) AS s FROM dirty) WHERE abs((price - m) / s) > 2)", "0.05"),
    "missing_column": ("required", "absent", "warn", _N, "0"),
}
_q = lambda v: "NULL" if v is None else f"'{v}'"
_ROWS = " UNION ALL ".join(
    f"SELECT '{i}' AS rule_id, {_q(t)} AS type, {_q(c)} AS \"column\", {_q(s)} AS severity, {f}::BIGINT AS failures, {_N}::BIGINT AS rows, {a or 'NULL'}::DOUBLE AS allowed" for i, (t, c, s, f, a) in _RULE_SQL.items()
)
_RESULTS = f"""WITH {DIRTY_SQL}, r AS ({_ROWS}), results AS (SELECT rule_id, type, "column", severity, failures, rows, CASE WHEN allowed IS NULL THEN failures = 0 ELSE failures / rows <= allowed END AS passed,
  round(CASE WHEN allowed IS NULL THEN (failures = 0)::DOUBLE ELSE greatest(0, 1 - failures / rows) END, 6) AS score FROM r)"""


@register("quality_rules_results", f"{_RESULTS} SELECT * FROM results")
def quality_rules_results(spark, sf_dir):
    return quality.evaluate(dirty(spark, sf_dir), rules(spark, sf_dir), as_of="2002-01-01")


@register("quality_verdict", f"{_RESULTS} SELECT round(avg(score), 6) AS score, CASE WHEN bool_or(NOT passed AND severity = 'error') THEN 'fail' WHEN bool_or(NOT passed) THEN 'warn' ELSE 'pass' END AS verdict FROM results")
def quality_verdict(spark, sf_dir):
    return quality.verdict(quality_rules_results(spark, sf_dir))


@register(
    "quality_score_import",
    f"""WITH {DIRTY_SQL}, n AS (SELECT count(*) AS n, count(*) FILTER (status IS NULL) AS nulls FROM dirty), d AS (SELECT count(*) AS distinct_rows FROM (SELECT DISTINCT * FROM dirty)),
    q AS (SELECT quantile_cont(o_orderkey, 0.25) AS a, quantile_cont(o_orderkey, 0.75) AS b, quantile_cont(price, 0.25) AS c, quantile_cont(price, 0.75) AS e FROM dirty),
    o AS (SELECT count(*) FILTER (o_orderkey < a - 1.5 * (b - a) OR o_orderkey > b + 1.5 * (b - a)) + count(*) FILTER (price < c - 1.5 * (e - c) OR price > e + 1.5 * (e - c)) AS odd FROM dirty, q),
    s AS (SELECT round(1 - nulls / (n * 6), 4) AS completeness, round(1 - (n - distinct_rows) / n, 4) AS uniqueness, 1.0::DOUBLE AS validity, round(greatest(0, 1 - odd / (n * 6)), 4) AS consistency FROM n, d, o)
    SELECT *, round((completeness + uniqueness + validity + consistency) / 4, 4) AS score, round((completeness + uniqueness + validity + consistency) / 4, 4) >= 0.6 AND least(completeness, uniqueness, validity, consistency) > 0 AS passed FROM s""",
)
def quality_score_import(spark, sf_dir):
    return quality.import_score(dirty(spark, sf_dir))


_COLS = ("o_orderkey", "status", "price", "cust", "priority", "day")


@register(
    "profile_columns",
    f"WITH {DIRTY_SQL} "
    + " UNION ALL ".join(
        f"SELECT '{c}' AS \"column\", count(*) FILTER ({c} IS NULL) AS missing, round(count(*) FILTER ({c} IS NULL)::DOUBLE / count(*) * 100, 2) AS missing_pct, count(DISTINCT {c}) AS \"distinct\", count(*) FILTER ({c} IS NULL)::DOUBLE / count(*) * 100 > 30 AS over_30_pct_missing, array_to_string(list_slice(list_sort(list(DISTINCT {c}::VARCHAR)), 1, 3), '|') AS samples FROM dirty" for c in _COLS
    ),
)
def profile_columns(spark, sf_dir):
    return quality.profile(dirty(spark, sf_dir)).drop("smallest", "largest", "dtype").withColumn("samples", F.array_join("samples", "|"))


@register("duplicate_rows", "SELECT l_orderkey, l_linenumber, count(*) - 1 AS extra FROM lineitem GROUP BY 1, 2 HAVING count(*) > 1")
def duplicate_rows(spark, sf_dir):
    return table(spark, sf_dir, "lineitem").groupBy("l_orderkey", "l_linenumber").agg((F.count(F.lit(1)) - 1).alias("extra")).filter("extra > 0")


_CARD = "regexp_replace(text, '\\D', '', 'g')"


_LUHN = "list_sum(list_transform(range(0, length(d)), lambda i: CASE WHEN i % 2 = 0 THEN substr(reverse(d), i + 1, 1)::INT ELSE CASE WHEN 2 * substr(reverse(d), i + 1, 1)::INT > 9 THEN 2 * substr(reverse(d), i + 1, 1)::INT - 9 ELSE 2 * substr(reverse(d), i + 1, 1)::INT END END)) % 10 = 0"


@register(
    "pii_cells",
    f"""WITH c AS (SELECT text, regexp_replace(text, '\\D', '', 'g') AS d FROM documents), v AS (SELECT *, len(list_distinct(string_split(d, ''))) > 1 AS varied FROM c), k AS (
      SELECT 'email' AS kind, count(*) FILTER (regexp_matches(text, '[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\\.[A-Za-z]{{2,}}')) AS count FROM v
      UNION ALL SELECT 'phone', count(*) FILTER (varied AND regexp_matches(text, '(\\+?62[\\s-]?|0)(\\d[\\s-]?){{8,12}}\\d')) FROM v
      UNION ALL SELECT 'credit_card', count(*) FILTER (varied AND length(d) BETWEEN 13 AND 19 AND regexp_matches(text, '\\b(\\d[ -]?){{13,19}}\\b') AND {_LUHN}) FROM v
      UNION ALL SELECT 'national_id', count(*) FILTER (varied AND length(d) = 16 AND regexp_matches(text, '\\b\\d{{16}}\\b')) FROM v)
    SELECT 'text' AS "column", kind, count FROM k WHERE count > 0""",
)
def pii_cells(spark, sf_dir):
    return quality.pii_cells(table(spark, sf_dir, "documents"), ["text"])


@register("pii_masked", "SELECT event_id, concat(repeat('*', length(user_id::VARCHAR) - 2), right(user_id::VARCHAR, 2)) AS masked FROM events WHERE length(user_id::VARCHAR) > 2")
def pii_masked(spark, sf_dir):
    u = F.col("user_id").cast("string")
    return table(spark, sf_dir, "events").filter(F.length(u) > 2).select("event_id", text.mask_partial(u, 2).alias("masked"))


_SCHEMA_SQL = "now AS (SELECT column_name AS \"column\", CASE data_type WHEN 'BIGINT' THEN 'bigint' WHEN 'INTEGER' THEN 'int' WHEN 'DOUBLE' THEN 'double' WHEN 'VARCHAR' THEN 'string' ELSE lower(data_type) END AS dtype FROM information_schema.columns WHERE table_name = 'customer')"


@register(
    "schema_drift",
    f"""WITH {_SCHEMA_SQL}, agreed("column", dtype) AS (VALUES ('c_custkey', 'bigint'), ('c_name', 'string'), ('c_nationkey', 'int'), ('c_acctbal', 'float'), ('c_phone', 'string'))
    SELECT "column", CASE WHEN a.dtype IS NULL THEN 'added' WHEN n.dtype IS NULL THEN 'removed' ELSE 'type_changed' END AS change FROM agreed a FULL JOIN now n USING ("column") WHERE a.dtype IS DISTINCT FROM n.dtype""",
)
def schema_drift(spark, sf_dir):
    now = spark.createDataFrame(table(spark, sf_dir, "customer").dtypes, "column string, dtype string")
    agreed = spark.createDataFrame([("c_custkey", "bigint"), ("c_name", "string"), ("c_nationkey", "int"), ("c_acctbal", "float"), ("c_phone", "string")], "column string, dtype string")
    return quality.schema_changes(agreed, now)


@register("dtype_histogram", f"WITH {_SCHEMA_SQL} SELECT dtype, count(*) AS n FROM now GROUP BY 1")
def dtype_histogram(spark, sf_dir):
    return spark.createDataFrame(table(spark, sf_dir, "customer").dtypes, "column string, dtype string").groupBy("dtype").agg(F.count(F.lit(1)).alias("n"))


_DATASETS = "datasets AS (SELECT p_partkey AS dataset, CASE WHEN p_partkey % 3 = 0 THEN 'draft' ELSE 'committed' END AS status, CASE WHEN p_partkey % 5 = 0 THEN NULL ELSE (p_size * 2) / 100.0 END::DOUBLE AS score, CASE WHEN p_partkey % 4 = 0 THEN NULL ELSE DATE '2024-01-01' + p_size END AS checked_at FROM part)"


def _datasets(spark, sf_dir):
    k = F.col("p_partkey")
    return table(spark, sf_dir, "part").select(
        k.alias("dataset"), F.when(k % 3 == 0, "draft").otherwise("committed").alias("status"), F.when(k % 5 != 0, F.col("p_size") * 2 / 100).alias("score"), F.when(k % 4 != 0, F.date_add(F.lit("2024-01-01").cast("date"), F.col("p_size"))).alias("checked_at")
    )


@register("stale_quality", f"WITH {_DATASETS} SELECT * FROM datasets WHERE status = 'committed' AND (score IS NULL OR checked_at IS NULL OR checked_at < DATE '2024-02-01' - 7)")
def stale_quality(spark, sf_dir):
    return ledger.stale(_datasets(spark, sf_dir), "2024-02-01")


@register(
    "contract_check",
    f"""WITH {_DATASETS}, c AS (SELECT dataset, round(epoch(TIMESTAMP '2024-02-01' - checked_at::TIMESTAMP) / 3600, 2) AS age_hours, coalesce(status = 'committed', false) AS schema_ok,
      coalesce(epoch(TIMESTAMP '2024-02-01' - checked_at::TIMESTAMP) / 3600 <= 72, false) AS fresh, coalesce(score >= 0.5, false) AS quality_ok FROM datasets)
    SELECT *, schema_ok AND fresh AND quality_ok AS passed, CASE WHEN schema_ok AND fresh AND quality_ok THEN 'healthy' WHEN NOT schema_ok OR (NOT fresh AND NOT quality_ok) THEN 'critical' ELSE 'degraded' END AS health FROM c""",
)
def contract_check(spark, sf_dir):
    d = _datasets(spark, sf_dir).select("dataset", F.col("status").alias("schema_hash"), F.lit("committed").alias("agreed_hash"), F.col("checked_at").cast("timestamp").alias("loaded_at"), F.lit(72).alias("sla_hours"), "score", F.lit(0.5).alias("min_score"))
    return ledger.contract_check(d, "2024-02-01 00:00:00")


@register(
    "lineage_downstream",
    """WITH RECURSIVE edges AS (SELECT DISTINCT p_size AS a, (p_size * 7 + 3) % 50 + 1 AS b FROM part WHERE p_size % 3 <> 0), walk(node, hops) AS (SELECT 1, 0 UNION SELECT b, hops + 1 FROM walk JOIN edges ON node = a WHERE hops < 10)
    SELECT node::VARCHAR AS node, min(hops)::INTEGER AS hops FROM walk WHERE node <> 1 GROUP BY 1""",
)
def lineage_downstream(spark, sf_dir):
    s = F.col("p_size")
    edges = table(spark, sf_dir, "part").filter(s % 3 != 0).select(s.cast("string").alias("source"), ((s * 7 + 3) % 50 + 1).cast("string").alias("target"))
    return lineage.reachable(edges, spark.createDataFrame([("1",)], "node string"))


@register("content_dedup", "SELECT min(doc_id) AS doc_id, count(*) AS copies FROM documents GROUP BY sha256(text)")
def content_dedup(spark, sf_dir):
    return table(spark, sf_dir, "documents").groupBy(F.sha2("text", 256)).agg(F.min("doc_id").alias("doc_id"), F.count(F.lit(1)).alias("copies")).select("doc_id", "copies")


@register("row_dedup", "SELECT count(*) AS n FROM (SELECT DISTINCT l_orderkey, l_linenumber, l_partkey FROM lineitem)")
def row_dedup(spark, sf_dir):
    return clean.deduplicate(table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey")).agg(F.count(F.lit(1)).alias("n"))


@register("dead_letters", f"WITH {DIRTY_SQL} SELECT count(*) FILTER (status IS NOT NULL) AS good, count(*) FILTER (status IS NULL) AS dead FROM dirty")
def dead_letters(spark, sf_dir):
    good, dead = clean.split_valid(dirty(spark, sf_dir), ["status"])
    return good.agg(F.count(F.lit(1)).alias("good")).crossJoin(dead.agg(F.count(F.lit(1)).alias("dead")))


# Warehouse loading

_DIM_SQL = """dim AS (SELECT (s_suppkey * 10)::BIGINT AS id, s_name AS code, s_acctbal AS balance FROM supplier WHERE s_suppkey <= 40), new AS (SELECT DISTINCT s_name AS code FROM supplier WHERE s_name NOT IN (SELECT code FROM dim))"""


def _dim(spark, sf_dir):
    s = table(spark, sf_dir, "supplier")
    return s.filter("s_suppkey <= 40").select((F.col("s_suppkey") * 10).alias("id"), F.col("s_name").alias("code"), F.col("s_acctbal").alias("balance")), s


@register("warehouse_get_or_create", f"WITH {_DIM_SQL} SELECT * FROM dim UNION ALL SELECT (SELECT max(id) FROM dim) + row_number() OVER (ORDER BY code), code, NULL FROM new")
def warehouse_get_or_create(spark, sf_dir):
    dim, s = _dim(spark, sf_dir)
    return warehouse.get_or_create(dim, s.select(F.concat(F.lit(" "), "s_name").alias("code")), "code")


@register(
    "warehouse_upsert",
    f"WITH {_DIM_SQL}, grown AS (SELECT id, code FROM dim UNION ALL SELECT (SELECT max(id) FROM dim) + row_number() OVER (ORDER BY code), code FROM new) SELECT g.id, g.code, s_acctbal + 1 AS balance FROM grown g JOIN supplier ON g.code = s_name",
)
def warehouse_upsert(spark, sf_dir):
    dim, s = _dim(spark, sf_dir)
    return warehouse.upsert(dim, s.select(F.col("s_name").alias("code"), (F.col("s_acctbal") + 1).alias("balance")), "code")


@register("warehouse_resolve", f"WITH {_DIM_SQL} SELECT l_orderkey, l_linenumber, l_quantity, id AS supplier_id FROM lineitem JOIN supplier ON l_suppkey = s_suppkey LEFT JOIN dim ON s_name = code")
def warehouse_resolve(spark, sf_dir):
    dim, s = _dim(spark, sf_dir)
    facts = table(spark, sf_dir, "lineitem").join(s, F.col("l_suppkey") == F.col("s_suppkey")).select("l_orderkey", "l_linenumber", "l_quantity", F.col("s_name").alias("code"))
    return warehouse.resolve(facts, dim, "code", "supplier_id")


@register("paged_rows", "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 50 OFFSET 150")
def paged_rows(spark, sf_dir):
    return files.page(table(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice"), [F.desc("o_totalprice"), "o_orderkey"], 4, 50)


# Catalog and quality history

_VERSIONS = """cols AS (SELECT table_name AS dataset, column_name || ':' || CASE data_type WHEN 'BIGINT' THEN 'bigint' WHEN 'INTEGER' THEN 'int' WHEN 'DOUBLE' THEN 'double' WHEN 'VARCHAR' THEN 'string' WHEN 'TIMESTAMP' THEN 'timestamp' ELSE lower(data_type) END AS c
  FROM information_schema.columns WHERE table_name IN ('customer', 'supplier', 'part', 'nation', 'region'))"""


@register("schema_versions", f"WITH {_VERSIONS} SELECT dataset, 1 AS version, sha256(string_agg(c, chr(10) ORDER BY c)) AS schema_hash FROM cols GROUP BY 1")
def schema_versions(spark, sf_dir):
    names = ("customer", "supplier", "part", "nation", "region")
    none = spark.createDataFrame([], catalog.VERSIONS)
    out = none
    for n in names:
        out = catalog.register_version(out, n, table(spark, sf_dir, n), 0)
        out = catalog.register_version(out, n, table(spark, sf_dir, n).select(*reversed(table(spark, sf_dir, n).columns)), 0)  # the same schema in another order: no new version
    return out.select("dataset", "version", "schema_hash")


@register(
    "column_registry",
    f"WITH {DIRTY_SQL}, reg AS ("
    + " UNION ALL ".join(f"SELECT 'dirty' AS dataset, '{c}' AS \"column\", count(DISTINCT {c}) AS distinct_count, round(count(*) FILTER ({c} IS NULL)::DOUBLE / count(*), 4) AS null_pct FROM dirty" for c in _COLS)
    + ") SELECT *, CASE \"column\" WHEN 'cust' THEN 'the customer' WHEN 'gone' THEN 'kept' END AS description FROM (SELECT * FROM reg UNION ALL SELECT 'dirty', 'gone', NULL, NULL)",
)
def column_registry(spark, sf_dir):
    old = spark.createDataFrame([("dirty", "cust", 5, 0.5, "the customer"), ("dirty", "gone", None, None, "kept")], "dataset string, column string, distinct_count long, null_pct double, description string")
    return catalog.sync_columns(old, "dirty", quality.profile(dirty(spark, sf_dir))).select("dataset", "column", "distinct_count", "null_pct", "description")


_RUNS = """runs AS (SELECT o_orderpriority AS dataset, (year(o_orderdate) * 100 + month(o_orderdate))::BIGINT AS run_id, round(count(*) FILTER (o_orderstatus <> 'P') / count(*), 4)::DOUBLE AS score FROM orders GROUP BY 1, 2)"""


def _runs(spark, sf_dir):
    run = (F.year("o_orderdate") * 100 + F.month("o_orderdate")).cast("long").alias("run_id")
    return table(spark, sf_dir, "orders").groupBy(F.col("o_orderpriority").alias("dataset"), run).agg(F.round(F.count_if(F.col("o_orderstatus") != "P") / F.count(F.lit(1)), 4).alias("score"))


@register("quality_history", f"WITH {_RUNS} SELECT dataset, run_id, score FROM runs QUALIFY row_number() OVER (PARTITION BY dataset ORDER BY run_id DESC) <= 5")
def quality_history(spark, sf_dir):
    return catalog.history(_runs(spark, sf_dir), 5)


@register(
    "quality_trend",
    f"""WITH {_RUNS}, l AS (SELECT * FROM runs QUALIFY row_number() OVER (PARTITION BY dataset ORDER BY run_id DESC) <= 20), t AS (SELECT dataset, count(*) AS runs, arg_min(score, run_id) AS first_score, arg_max(score, run_id) AS last_score FROM l GROUP BY 1)
    SELECT *, round(last_score - first_score, 4) AS delta, CASE WHEN last_score > first_score THEN 'improving' WHEN last_score < first_score THEN 'degrading' ELSE 'stable' END AS direction FROM t""",
)
def quality_trend(spark, sf_dir):
    return catalog.trend(_runs(spark, sf_dir), 20)
