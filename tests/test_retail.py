"""Retail operators on small frames with known answers, and every SQL-checked query against DuckDB."""

import datetime as dt
import math

import duckdb
import pytest
from pyspark.sql import functions as F

import __spark_entry__
from tidemark.functions import text
from tidemark.operators import alerts, customers, finance, inventory, kpi, ledger, lineage, ml, quality, recommend, retrieval, sales, scenarios, timeseries
from tidemark.operators.quality import Rule
from tidemark.plans import glossary, guard
from tidemark.registry import ORACLE, QUERIES
from tidemark.sources import clean, files, mapping
from tidemark.streaming import alerts as stream_alerts
from tidemark.streaming import ingest

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def frame(spark, rows):
    schema = "order_key long, line_number int, transaction_date date, customer_name string, product_name string, category string, branch_name string, quantity double, selling_price double, revenue decimal(18,4), cost_price decimal(18,4)"
    return spark.createDataFrame(rows, "order_key long, line_number int, transaction_date date, customer_name string, product_name string, category string, branch_name string, quantity double, selling_price double, revenue double, cost_price double").select(
        *[F.col(c.split()[0]).cast(c.split()[1]) for c in schema.replace("decimal(18,4)", "decimal(18,4)").split(", ")]
    )


@pytest.fixture(scope="module")
def mini(spark):
    d = dt.date
    return frame(spark, [
        (1, 1, d(2025, 1, 1), "a", "x", "c1", "north", 1.0, 100.0, 100.0, 60.0),
        (2, 1, d(2025, 1, 2), "b", "y", "c1", "south", 2.0, 75.0, 150.0, 50.0),
        (3, 1, d(2025, 2, 3), "a", "y", "c1", "north", 2.0, 100.0, 200.0, 50.0),
        (4, 1, None, "a", "x", "c1", "north", 1.0, 0.0, 0.0, 60.0),
    ])


def one(df):
    return df.first().asDict()


def test_kpi_by_hand(mini):
    r = one(sales.sales_kpi(mini))
    assert (r["revenue"], r["orders"], r["units"], r["aov"], r["margin_pct"]) == (450.0, 4, 6.0, 112.5, 0.0)
    assert r["growth_pct"] == round((200 - 250) / 250 * 100, 2)


def test_kpi_of_an_empty_frame(mini):
    r = one(sales.sales_kpi(mini.limit(0)))
    assert (r["revenue"], r["orders"], r["aov"], r["growth_pct"]) == (0.0, 0, 0.0, 0.0)
    assert one(finance.finance_summary(mini.limit(0)))["margin_pct"] == 0.0


def test_trend_periods(mini):
    assert [r["period"] for r in sales.sales_trend(mini, "monthly").collect()] == ["2025-01", "2025-02"]
    assert sales.sales_trend(mini, "weekly").first()["period"] == "2024-12-30/2025-01-05"
    assert sales.sales_trend(mini, "odd").count() == 3


def test_filters_skip_what_they_cannot_use(mini):
    assert sales.apply_filters(mini, "2025-01-02", "no date", branch="south").count() == 1
    assert sales.apply_filters(mini.drop("branch_name"), branch="south").count() == 4


def test_aliases_by_priority(spark):
    df = spark.createDataFrame([("2025-01-05", "5", "3", "x")], "Tgl string, Total string, Jml string, `Nm Brg` string")
    r = one(sales.canonicalize(df))
    assert r["transaction_date"] == dt.date(2025, 1, 5) and float(r["revenue"]) == 5 and r["quantity"] == 3 and r["product_name"] == "x"


def test_finance(mini, spark):
    r = one(finance.finance_summary(mini, None, spark.createDataFrame([(30.0,), (-10.0,)], "amount double")))
    assert (r["total_revenue"], r["total_cogs"], r["total_expenses"], r["net_profit"]) == (450.0, 320.0, 20.0, 110.0)
    with pytest.raises(ValueError):
        sales.profitability(mini.drop("cost_price"))


def test_single_product_over_95_percent_is_c(mini):
    assert sales.abc_analysis(mini.filter("product_name = 'x'")).first()["grade"] == "C"


def test_equal_values_score_five(mini):
    rows = customers.rfm(mini.filter("customer_name = 'a'")).collect()
    assert [(r["r_score"], r["f_score"], r["m_score"], r["segment"]) for r in rows] == [(5, 5, 5, "champions")]


def test_stock_without_demand(spark, mini):
    stock = spark.createDataFrame([("z", dt.date(2025, 1, 1), 1, 5.0), ("z", dt.date(2025, 2, 1), 1, 4.0), ("x", dt.date(2025, 2, 1), 1, 0.0)], "product_name string, snapshot_date date, warehouse int, stock_qty double")
    got = {r["product"]: r for r in inventory.inventory_health(stock, mini).collect()}
    assert (got["z"]["days_of_stock"], got["z"]["dead_stock"], got["z"]["stock_qty"]) == (999.0, True, 4.0)
    assert got["x"]["stockout_risk"] == "critical" and got["x"]["days_of_stock"] == 0.0


def test_kpi_comparison(spark):
    v = lambda *rows: spark.createDataFrame(rows, "name string, value double")
    got = {r["name"]: r["delta_pct"] for r in kpi.compare(v(("a", 5.0), ("b", 1.0)), v(("a", 4.0), ("c", 2.0))).collect()}
    assert got == {"a": 25.0, "b": 100.0, "c": -100.0}


@pytest.mark.parametrize("rule, failures, passed", [
    (Rule("r", "required", "s"), 2, False), (Rule("r", "nullable", "s", {"max_null_ratio": 0.2}), 1, True), (Rule("r", "unique", "n"), 2, False), (Rule("r", "duplicate"), 0, True),
    (Rule("r", "regex", "s", {"pattern": "[a-z]+"}), 1, False), (Rule("r", "range", "n", {"min": 1, "inclusive": False}), 3, False), (Rule("r", "enum", "s", {"values": ["ab", " "]}), 1, False),
    (Rule("r", "datatype", "n", {"type": "int"}), 1, False), (Rule("r", "completeness", None, {"min_ratio": 0.8}), 1, True), (Rule("r", "consistency", "n"), 0, True),
    (Rule("r", "validity", "n", {"check": "parse_number"}), 1, False), (Rule("r", "schema_drift", None, {"columns": ["s", "n"]}), 0, True), (Rule("r", "anomaly_ref", "n"), 0, True), (Rule("r", "required", "gone"), 5, False),
])
def test_quality_rules(spark, rule, failures, passed):
    df = spark.createDataFrame([("ab", "1"), (None, "2"), (" ", "1"), ("cd", "3"), ("ab", "x")], "s string, n string")
    r = one(quality.evaluate(df, [rule]))
    assert (r["failures"], r["passed"]) == (failures, passed)


def test_rules_are_validated():
    for bad in ({"type": "odd"}, {"type": "range"}, {"type": "duplicate", "severity": "loud"}):
        with pytest.raises(ValueError):
            Rule("r", **bad)


def test_pii_cells_and_masks(spark):
    df = spark.createDataFrame([("a.b@x.org", "4111 1111 1111 1111"), ("none", "1111111111111111"), (None, "081234567890")], "m string, c string")
    got = {(r["column"], r["kind"]): r["count"] for r in quality.pii_cells(df, ["m", "c"]).collect()}
    assert got[("m", "email")] == 1 and got[("c", "credit_card")] == 1 and got[("c", "phone")] == 1
    masked = [tuple(r) for r in quality.mask_found(df, [("m", "email"), ("c", "credit_card")]).collect()]
    assert masked[0] == ("a***@x.org", "*" * 15 + "1111") and masked[2][0] is None
    assert one(spark.range(1).select(text.mask_phone(F.lit("+62 812-345")).alias("p")))["p"] == "+** ***-*45"


def test_empty_frame_scores_zero(spark):
    r = one(quality.import_score(spark.createDataFrame([], "a int, quantity double")))
    assert r["score"] == 0.0 and not r["passed"]


def test_calendar_fills_only_moderate_gaps(spark):
    d = lambda *days: spark.createDataFrame([(dt.date(2025, 1, 1) + dt.timedelta(days=n), 1.0) for n in days], "ds date, y double")
    assert timeseries.densify(d(0, 2, 5)).count() == 6
    assert timeseries.densify(d(0, 100)).count() == 2


def test_forecasts_do_not_invent_history(spark):
    s = spark.createDataFrame([], "ds date, y double")
    assert timeseries.baseline_forecast(s, 7).count() == 0 and ml.gbt_forecast(s).count() == 0
    one_day = spark.createDataFrame([(dt.date(2025, 1, 1), 10.0)], s.schema)
    rows = timeseries.baseline_forecast(one_day, 3).collect()
    assert [r["yhat"] for r in rows] == [10.0] * 3 and all(r["lower"] <= r["yhat"] <= r["upper"] for r in rows)


def test_elasticity_is_refused_without_a_demand_curve(mini, spark):
    assert one(scenarios.elasticity(mini))["reason"] == "too few rows"
    rows = [(i, 1, dt.date(2025, 1, 1), "a", "x", "c", "n", 20.0 - i, float(i + 1), 5.0, 1.0) for i in range(12)]
    r = one(scenarios.elasticity(frame(spark, rows)))
    assert r["supported"] and r["slope"] == -1.0 and r["elasticity"] < 0


@pytest.mark.parametrize("value, condition, threshold, want", [(2.0, ">", 1.0, True), (1.0, ">=", 1.0, True), (1.0, "<", 1.0, False), (1.0, "!=", 1.0, False), (math.nan, ">", 1.0, False), (None, "<", 1.0, False)])
def test_conditions(spark, value, condition, threshold, want):
    r = spark.createDataFrame([(value,)], "v double").select(alerts.fires(F.col("v"), F.lit(condition), F.lit(threshold)).alias("f"))
    assert one(r)["f"] is want
    assert alerts.normalize_condition("gt") == ">"


def test_one_open_alert_per_rule_in_batch_and_stream(spark, tmp_path):
    rows = [("r", dt.datetime(2025, 1, i + 1), f) for i, f in enumerate([True, True, False, True])]
    obs = spark.createDataFrame(rows, "rule string, at timestamp, fires boolean")
    want = ["open", "keep", "resolve", "open"]
    assert [r["action"] for r in alerts.transitions(obs).orderBy("at").collect()] == want
    obs.coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = stream_alerts.transitions(spark.readStream.schema(obs.schema).parquet(str(tmp_path / "in")))
    q = stream.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert [r["action"] for r in spark.read.parquet(str(tmp_path / "out")).orderBy("at").collect()] == want


def test_stream_ingest_is_idempotent(spark, tmp_path):
    spark.createDataFrame([(1, "a"), (1, "a"), (2, "b")], "k int, v string").coalesce(1).write.option("header", True).csv(str(tmp_path / "in"))
    rows = ingest.read_folder(spark, str(tmp_path / "in"), "k int, v string")
    ingest.load(rows, str(tmp_path / "t"), str(tmp_path / "cp")).awaitTermination(120)
    ingest.load(rows, str(tmp_path / "t"), str(tmp_path / "cp")).awaitTermination(120)
    assert spark.read.parquet(str(tmp_path / "t")).count() == 2


def test_lineage_with_a_cycle(spark):
    edges = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "a"), ("c", "d"), ("x", "y")], "source string, target string")
    start = spark.createDataFrame([("a",)], "node string")
    assert {r["node"]: r["hops"] for r in lineage.reachable(edges, start).collect()} == {"b": 1, "c": 2, "d": 3}
    assert {r["node"] for r in lineage.reachable(edges, start, 1, downstream=False).collect()} == {"c"}


GUARD = {"fact_sales", "dim_product"}


@pytest.mark.parametrize("sql, reason", [
    ("", "empty"), (None, "empty"), ("SELECT * FROM fact_sales" + " " * 8000, "too_long"), ("SELECT 1; SELECT 2", "multi_statement"), ("SELECT * FROM fact_sales; DROP TABLE dim_product", "multi_statement"),
    ("SELECT * FROM fact_sales LIMIT 1; SELECT * FROM dim_branch", "multi_statement"), ("DELETE FROM fact_sales", "not_select"), ("DROP TABLE fact_sales", "not_select"), ("EXPLAIN SELECT * FROM fact_sales", "not_select"),
    ("INSERT INTO fact_sales (revenue) VALUES (1)", "not_select"), ("UPDATE fact_sales SET revenue = 0", "not_select"), ("TABLE fact_sales", "not_select"), ("VALUES (1)", "not_select"), ("SELECT * FROM users", "blocked_table"),
    ("SELECT 1", "no_table"), ("WITH x AS (SELECT 1) SELECT * FROM x", "no_table"), ("SELECT * FROM fact_sales LIMIT 0", "bad_limit"), ("SELECT * FROM fact_sales LIMIT 5 + 5", "bad_limit"), ("SELECT * FROM fact_sales WHERE drop = 1", "blocked_keyword"),
    ("SELECT * FROM fact_sales INTO OUTFILE '/tmp/x.csv'", "file_access"), ("SELECT a b c d FROM fact_sales", "not_parsed"),
    # Every way of reading another table.
    ("SELECT * FROM fact_sales, secret", "blocked_table"), ("SELECT * FROM fact_sales JOIN `secret` s ON 1 = 1", "blocked_table"), ("SELECT * FROM fact_sales, LATERAL (TABLE secret)", "blocked_table"),
    ("WITH fact_sales AS (TABLE secret) SELECT * FROM fact_sales", "blocked_table"), ("SELECT * FROM other.fact_sales", "blocked_table"), ("SELECT * FROM parquet.`/tmp/fact_sales`", "blocked_table"),
    ("SELECT (SELECT max(a) FROM secret) FROM fact_sales", "blocked_table"), ("SELECT * FROM fact_sales WHERE a IN (SELECT b FROM secret)", "blocked_table"), ("SELECT * FROM fact_sales WHERE EXISTS (FROM secret)", "blocked_table"),
    ("SELECT * FROM fact_sales UNION TABLE secret", "blocked_table"), ("WITH x AS (WITH secret AS (SELECT 1 FROM fact_sales) SELECT * FROM secret) SELECT * FROM x, secret", "blocked_table"),
    ("WITH x AS (SELECT * FROM y), y AS (SELECT * FROM fact_sales) SELECT * FROM x", "blocked_table"),
    ("SELECT * FROM IDENTIFIER('sec' || 'ret')", "blocked_node"), ("SELECT * FROM fact_sales, read_files('/tmp')", "blocked_node"), ("SELECT TRANSFORM(a) USING 'cat' FROM fact_sales", "blocked_node"),
    ("SELECT reflect('java.lang.System', 'getenv') FROM fact_sales", "blocked_keyword"), ("SELECT * FROM fact_sales WHERE upper(java_method('a', 'b')) = 'c'", "blocked_keyword"),
])
def test_guard_refuses(spark, sql, reason):
    verdict = guard.check(spark, sql, GUARD)
    assert verdict.reason == f"refused:{reason}" and not verdict.allowed and verdict.sql == ""


@pytest.mark.parametrize("sql, limit, limited", [
    ("SELECT revenue FROM fact_sales LIMIT 10", 10, False), ("select a from fact_sales where a > 1 limit 5;", 5, False), ("SELECT * FROM fact_sales WHERE a = 'drop table users; --' LIMIT 3", 3, False),
    ("SELECT p.n, sum(f.r) FROM fact_sales f JOIN dim_product p ON f.i = p.i GROUP BY p.n LIMIT 20", 20, False), ("SELECT revenue FROM fact_sales", 200, True), ("SELECT revenue FROM fact_sales LIMIT 999999", 5000, True),
    ("SELECT * FROM (SELECT * FROM fact_sales LIMIT 1) x", 200, True), ("(SELECT a FROM fact_sales LIMIT 3) UNION ALL SELECT b FROM dim_product", 200, True), ("SELECT a FROM fact_sales LIMIT ALL", 200, True),
    ("SELECT a FROM fact_sales OFFSET 3", 200, True), ("SELECT a FROM fact_sales LIMIT 10 OFFSET 3", 10, False), ("WITH x AS (SELECT a FROM fact_sales), y AS (SELECT * FROM x) SELECT * FROM y LIMIT 6", 6, False),
    ("/* c; */ SELECT ';', '-- drop' FROM fact_sales s JOIN dim_product p ON 1=1; -- end;", 200, True),
])
def test_guard_limits(spark, sql, limit, limited):
    v = guard.check(spark, sql, GUARD)
    assert (v.reason, v.allowed, v.limit, v.limited) == ("ok", True, limit, limited) and set(v.tables) <= GUARD
    if limited and "LIMIT ALL" not in sql:
        assert v.sql.endswith(f"LIMIT {limit}") and guard.check(spark, v.sql, GUARD).limit == limit


def test_guard_lets_only_known_functions_pass(spark):
    spark.udf.register("own_function", lambda x: x)
    table = sorted(GUARD)[0]
    ok = lambda call: guard.check(spark, f"SELECT {call} FROM {table}", GUARD).reason
    assert ok("count(*), upper(trim(both ' ' from cast(1 as string))), coalesce(null, date_add(current_date(), 1)), row_number() over (order by 1)") == "ok"
    assert ok("own_function(1)") == ok("read_files('/x')") == ok("spark_catalog.default.f(1)") == "refused:blocked_function"
    other = spark.newSession()
    other.udf.register("soundex", lambda x: x)  # in the place of a built-in one
    assert guard.check(other, f"SELECT soundex('a') FROM {table}", GUARD).reason == "refused:blocked_function" and ok("soundex('a')") == "ok"
    assert guard.check(spark, f"SELECT e FROM {table} LATERAL VIEW explode(array(1, 2)) t AS e", GUARD).allowed
    assert guard.check(spark, f"SELECT e FROM {table} LATERAL VIEW own_function(array(1, 2)) t AS e", GUARD).reason == "refused:blocked_function"


def test_guarded_statements_run_with_their_limits(spark):
    spark.range(6000).createOrReplaceTempView("guarded_numbers")
    count = lambda sql: guard.run(spark, sql, {"guarded_numbers"}).count()
    assert count("SELECT * FROM guarded_numbers -- all;") == 200
    assert count("SELECT * FROM guarded_numbers ORDER BY id LIMIT 5999;") == 5000
    assert count("SELECT * FROM (SELECT * FROM guarded_numbers LIMIT 1) UNION ALL SELECT * FROM guarded_numbers") == 200
    assert count("SELECT * FROM guarded_numbers OFFSET 5990") == 10
    with pytest.raises(PermissionError):
        guard.run(spark, "SELECT * FROM guarded_numbers, other", {"guarded_numbers"})


@pytest.mark.parametrize("dataset", mapping.FIELDS)
def test_no_alias_escapes_its_dataset(dataset):
    for r in mapping.suggest([a for names in mapping.ALIASES.values() for a in names] + ["Tgl Beli", "qtty", "zzz"], dataset):
        assert r["target_field"] is None or r["target_field"] in mapping.FIELDS[dataset]


def test_mapping(spark):
    got = {r["source_column"]: (r["target_field"], r["method"]) for r in mapping.suggest(["Tanggal Transaksi", "Nm Brg", "Jumlahh", "zzz"])}
    assert got["Tanggal Transaksi"] == ("transaction_date", "exact") and got["Nm Brg"] == ("product_name", "exact") and got["Jumlahh"] == ("quantity", "fuzzy") and got["zzz"] == (None, "none")
    df = spark.createDataFrame([(1, 2, 3)], "a int, b int, c int")
    assert mapping.apply(df, {"a": "x", "b": "x"}).columns == ["x", "c"]


def test_readers(spark, tmp_path):
    p = tmp_path / "s.csv"
    p.write_bytes("name;n\nä;1\n;\nb;2;3;4\n".encode("latin-1"))
    good, bad = files.read_csv(spark, str(p))
    assert [tuple(r) for r in good.collect()] == [("ä", "1")] and bad.count() == 1
    j = tmp_path / "s.jsonl"
    j.write_text('{"a": 1}\nnot json\n{"a": 2}\n')
    good, bad = files.read_json(spark, str(j), "a int")
    assert sorted(r["a"] for r in good.collect()) == [1, 2] and bad.first()["line"] == "not json"
    x = tmp_path / "s.xml"
    x.write_text("<rows><row><a>1</a></row><row><a>2</a></row></rows>")
    assert files.read_xml(spark, str(x), "row", "a int").count() == 2
    with pytest.raises(ValueError):
        files.read_any(spark, "file.doc")
    assert files.detect_encoding("a".encode("utf-16-le")) == "UTF-16LE" and files.sniff_delimiter(b"a|b\n1|2\n") == "|"


def test_workbook(spark, tmp_path):
    import zipfile

    ns = "http://schemas.openxmlformats.org/spreadsheetml/2006/main"
    cell = lambda ref, v: f'<c r="{ref}" t="inlineStr"><is><t>{v}</t></is></c>' if v else ""
    body = "".join(f'<row r="{i}">{cell(f"A{i}", a)}{cell(f"C{i}", c)}</row>' for i, (a, c) in enumerate([("h1", "h3"), ("1", "2"), ("", ""), ("3", "")], 1))
    with zipfile.ZipFile(tmp_path / "b.xlsx", "w") as z:
        z.writestr("xl/worksheets/sheet1.xml", f'<worksheet xmlns="{ns}"><sheetData>{body.replace("</c><c r=\"C1\"", "</c><c r=\"B1\" t=\"inlineStr\"><is><t>h2</t></is></c><c r=\"C1\"")}</sheetData></worksheet>')
    assert [tuple(r) for r in files.read_xlsx(spark, str(tmp_path / "b.xlsx")).collect()] == [("1", None, "2"), ("3", None, None)]


def test_cleaning_and_dead_letters(spark):
    df = spark.createDataFrame([(" x ", "2025-01-01", "2", "5", "0"), ("nan", "bad", "", "1", "0"), (" x ", "2025-01-01", "2", "5", "0")], "product_name string, sale_date string, quantity string, selling_price string, revenue string")
    c = clean.clean(df)
    rows = clean.deduplicate(c).orderBy("product_name").collect()
    assert [(r["product_name"], r["sale_date"], r["quantity"], r["revenue"]) for r in rows] == [(None, None, 0.0, 0.0), ("x", dt.date(2025, 1, 1), 2.0, 10.0)]
    good, dead = clean.split_valid(c, ["product_name", "sale_date"])
    assert good.count() == 2 and dead.first()["missing"] == "product_name,sale_date"


def test_csv_export(spark):
    assert list(files.csv_lines(spark.createDataFrame([(1, True, None)], "a int, b boolean, c string"))) == ["a,b,c\r\n", "1,true,\r\n"]


def test_job_rerun_replaces(spark, tmp_path):
    for n in (3, 2):
        files.append_job(spark.range(n), str(tmp_path / "t"), 7)
    files.append_job(spark.range(1), str(tmp_path / "t"), 8)
    assert spark.read.parquet(str(tmp_path / "t")).count() == 3


def test_chunks_cover_the_text(spark):
    body = " ".join(f"Sentence number {i} ends here." for i in range(200))
    got = [r["content"] for r in retrieval.chunk(spark.createDataFrame([(1, body), (2, None)], "doc_id long, text string")).orderBy("chunk_no").collect()]
    assert all(len(c) <= 800 for c in got) and got[0].endswith(".") and body.startswith(got[0]) and body.endswith(got[-1][-50:])


def test_retrieval_prefers_the_phrase(spark):
    df = spark.createDataFrame([(1, "net profit of the quarter"), (2, "profit and loss"), (3, "weather")], "chunk_id long, content string")
    got = retrieval.hybrid(df, "net profit", 5).collect()
    assert [r["chunk_id"] for r in got] == [1, 2]
    ranked = retrieval.rerank(df.withColumn("fused", F.lit(0.5)), "net profit").orderBy(F.desc("rerank")).first()
    assert ranked["chunk_id"] == 1 and ranked["phrase"] == 1.0


def test_private_needs_its_owner(spark):
    df = spark.createDataFrame([(1, "private", "me"), (2, "private", None), (3, "weird", None), (4, "internal", None)], "id int, visibility string, owner string")
    assert {r["id"] for r in retrieval.allowed(df, ["public", "private"], "me").collect()} == {1, 3}
    assert retrieval.allowed(df, ["private"], None).count() == 0 and retrieval.allowed(df, None).count() == 4


def test_content_changes(spark):
    f = lambda *rows: spark.createDataFrame(rows, "source string, title string, content string")
    got = {r["title"]: r["status"] for r in retrieval.content_changes(f(("s", "a", "x  y"), ("s", "b", "x")), f(("s", "a", "x y"), ("s", "b", "z"), ("s", "c", "n"), ("s", "d", " "))).collect()}
    assert got == {"a": "unchanged", "b": "updated", "c": "created", "d": "empty"}


def test_recommendations(mini):
    got = [r["product"] for r in recommend.recommend(mini, product="x").collect()]
    assert got == ["y"]
    assert recommend.recommend(mini, customer="b").first()["product"] == "x"
    assert recommend.recommend(mini, customer="a").count() == 2  # bought everything: popularity


def test_next_version(spark):
    v = spark.createDataFrame([("m", "v1"), ("m", "v10"), ("m", "odd")], "model string, version string")
    assert one(ledger.next_version(v))["next_version"] == "v11"


def test_segments_of_alike_customers(spark):
    rows = [(f"c{i}", 1, 1.0, 1, 1, 1.0, 1.0, 1) for i in range(5)]
    df = spark.createDataFrame(rows, "customer_name string, total_orders int, total_spending double, recency int, frequency int, monetary double, aov double, tenure int")
    got, score = ml.segments(df)
    assert {r["segment"] for r in got.collect()} == {"all"} and score is None
    assert ml.churn_scores(df.withColumn("churn", F.lit(0)))[1] == "constant"


def test_text_helpers(spark):
    r = one(spark.range(1).select(
        text.redact(F.lit("mysql://u:p@h/db password=abc /etc/app/x.conf")).alias("r"), text.unverified_numbers(F.lit("1,200 and 7%"), F.lit("total 1200")).alias("u"), text.business_key(F.lit("123.0")).alias("k")
    ))
    assert r["r"] == "[dsn] password=[redacted] [path]" and r["u"] == ["7%"] and r["k"] == "123"
    q = spark.createDataFrame([("Berapa omzet dan laba bersih?",), ("preorder",)], "text string")
    assert [x["metrics"] for x in glossary.match(q).collect()] == [["net_profit", "revenue"], []]


@pytest.fixture(scope="module")
def duck(sf):
    c = duckdb.connect()
    for t in TABLES:
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    return c


def plain(v):
    if isinstance(v, dt.datetime):
        return v.date().isoformat() if v.time() == dt.time() else v.isoformat()
    if isinstance(v, dt.date):
        return v.isoformat()
    return round(v, 6) if isinstance(v, float) else v


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_query_matches_sql(spark, duck, sf, name):
    got = QUERIES[name](spark, sf)
    want = duck.sql(ORACLE[name])
    columns = sorted(got.columns)
    assert columns == sorted(want.columns)
    key = lambda r: tuple((x is None, str(x)) for x in r)
    a = sorted(([plain(r[c]) for c in columns] for r in got.collect()), key=key)
    at = [want.columns.index(c) for c in columns]
    b = sorted(([plain(r[i]) for i in at] for r in want.fetchall()), key=key)
    assert a == b


def test_entry_points(spark):
    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
