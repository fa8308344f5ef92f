from tidemark.operators import quality
from tidemark.operators.quality import Rule


def rules(spark):
    return [
        Rule("a", "required", "s"), Rule("b", "nullable", "s", {"max_null_ratio": 0.3}), Rule("c", "unique", "f"), Rule("d", "duplicate"), Rule("e", "regex", "s", {"pattern": "[a-c]+"}), Rule("f", "range", "x", {"min": 1, "max": 9}), Rule("g", "enum", "s", {"allowed": ["a", "b"]}),
        Rule("h", "referential", "s", {"frame": spark.createDataFrame([("a",), ("a",), ("q" * 80,)], "k string"), "key": "k"}), Rule("i", "datatype", "s", {"dtype": "int"}), Rule("j", "freshness", "day", {"max_age_days": 10}), Rule("k", "completeness"), Rule("l", "consistency", "x"),
        Rule("m", "validity", "x", {"check": "no_negative"}), Rule("n", "schema_drift", None, {"columns": ["s", "x", "f", "day", "more"]}), Rule("o", "anomaly_ref", "x", {"sensitivity": 2.0}), Rule("p", "unique", "none"), Rule("q", "referential", "s", {"values": ["a"]}), Rule("r", "consistency", "none"),
    ]


ROWS = [(s, x, f, day) for s, x, f, day in zip(["a", "b", None, " ", "q" * 80, "1"] * 7, [1.0, 2.0, 3.0, 4.0, 5.0, 6.0, 90.0] * 6, [0.0, -0.0, 1.0, None, 2.0, 3.0] * 7, ["2024-01-01", "2023-06-01", None, "bad"] * 10 + ["2024-01-02"] * 2)]
SCHEMA = "s string, x double, f double, day string"


def outcome(df):
    return {r["rule_id"]: tuple(r) for r in df.collect()}


def test_states_of_batches_add_up_for_every_kind_of_rule(spark, tmp_path):
    mine = rules(spark)
    assert {r.type for r in mine} == set(quality.KINDS)
    whole = outcome(quality.evaluate(spark.createDataFrame(ROWS, SCHEMA), mine, "2024-01-05"))
    known = quality.Incremental(spark, str(tmp_path), mine)
    for batch in (ROWS[:5], ROWS[5:30], ROWS[30:]):
        known.add(spark.createDataFrame(batch, SCHEMA))
    assert outcome(known.results("2024-01-05")) == whole
    n = known.table.read().count()
    known.compact()
    assert outcome(known.results("2024-01-05")) == whole and known.table.read().count() < n
    assert outcome(known.results("2024-01-05", version=1)) == outcome(quality.evaluate(spark.createDataFrame(ROWS[:5], SCHEMA), mine, "2024-01-05"))


def test_counts_of_known_rows(spark):
    got = {k: v[4] for k, v in outcome(quality.evaluate(spark.createDataFrame(ROWS, SCHEMA), rules(spark), "2024-01-05")).items()}
    assert got["a"] == 14 and got["b"] == 7 and got["c"] == 35 and got["n"] == 1 and got["p"] == got["r"] == 42 and got["m"] == 0
    assert got["h"] == 21 and got["q"] == 28 and got["j"] == 0 and got["f"] == 6 and got["l"] == 6 and got["o"] == 6
    assert got["d"] == 42 - len({tuple(0.0 if v == 0 else v for v in r) for r in ROWS}) or got["d"] == 42 - len({tuple(map(str, r)) for r in ROWS})
    empty = outcome(quality.evaluate(spark.createDataFrame([], SCHEMA), rules(spark), "2024-01-05"))
    assert all(v[4] == 0 or k == "n" for k, v in empty.items()) and len(empty) == 18 and all(v[7] == 0.0 for v in empty.values())


#: Fixed values, as stated for the built-in rule sets.
EXPECTED = {
    "sales_strict": [("customer_required", "customer", "required", {}, "error"), ("product_required", "product", "required", {}, "error"), ("quantity_valid", "quantity", "validity", {"check": "no_negative"}, "error"), ("price_valid", "price", "validity", {"check": "parse_number"}, "error"), ("date_fresh", "date", "freshness", {"max_age_days": 90}, "warn"), ("no_exact_duplicates", None, "duplicate", {}, "warn"), ("branch_known", "branch", "referential", {"allowed_values": ["Jakarta", "Bandung", "Surabaya"]}, "warn")],
    "inventory_standard": [("product_required", "product", "required", {}, "error"), ("warehouse_required", "warehouse", "required", {}, "error"), ("stock_valid", "stock_qty", "validity", {"check": "no_negative"}, "error"), ("stock_range", "stock_qty", "range", {"min": 0, "max": 1000000}, "warn"), ("no_exact_duplicates", None, "duplicate", {}, "error")],
    "customers_pii_aware": [("customer_required", "customer", "required", {}, "error"), ("email_format", "email", "regex", {"pattern": r"^[^@\s]+@[^@\s]+\.[^@\s]+$"}, "error"), ("phone_type", "phone", "datatype", {"dtype": "string"}, "warn"), ("segment_known", "segment", "enum", {"allowed": ["new", "regular", "vip", "churned"]}, "warn"), ("customer_unique", "customer", "unique", {}, "error")],
}


def test_built_in_profiles(spark):
    assert {name: [(r.id, r.column, r.type, r.params, r.severity) for r in rules] for name, rules in quality.PROFILES.items()} == EXPECTED
    row = spark.createDataFrame([("c", "p", 1.0, "x", "2024-01-01", "Bandung")], "customer string, product string, quantity double, price string, date string, branch string")
    got = {r["rule_id"]: r["failures"] for r in quality.evaluate(row, quality.PROFILES["sales_strict"], "2024-02-01").collect()}
    assert got == {"customer_required": 0, "product_required": 0, "quantity_valid": 0, "price_valid": 1, "date_fresh": 0, "no_exact_duplicates": 0, "branch_known": 0}
