import pytest
from pyspark.errors import StreamingQueryException
from pyspark.sql import functions as F

from tidemark.functions import ranks, text
from tidemark.operators import catalog, ledger, lineage, quality, retrieval
from tidemark.plans import tools
from tidemark.sources import star
from tidemark.streaming import ingest


def test_every_tool_has_its_three_outcomes(spark, sf):
    frames = {"sales": star.sales(spark, sf), "stock": star.stock(spark, sf)}
    for name in tools.TOOLS:
        got = tools.execute(spark, name, frames)
        assert got.outcome == "data" and got.data.limit(1).count() == 1, name
        assert tools.evidence(got.data).limit(1).count() == 1
        assert tools.execute(spark, name, {k: v.limit(0) for k, v in frames.items()}).outcome == "no_data"
        assert tools.execute(spark, name, {}).outcome == "error"
    assert tools.execute(spark, "query_sales", {"sales": frames["sales"].select("revenue")}).outcome == "error"
    assert tools.execute(spark, "get_forecast", frames, {"horizon": 999}).outcome == "error"
    assert tools.execute(spark, "query_sql", {}, {"sql": "DROP TABLE x"}, {"x"}).reason.startswith("refused:not_select")
    assert tools.execute(spark, "query_sql", {}, {"sql": "SELECT * FROM nowhere"}, {"nowhere"}).outcome == "error"


def test_evidence_has_no_impossible_numbers(spark):
    df = spark.sql("SELECT double('NaN') AS a, double('Infinity') AS b, 1.5BD AS c, DATE '2025-01-02' AS d, array(double('NaN'), 2D) AS e, named_struct('f', float('NaN'), 'g', 1) AS h, CAST(NULL AS STRING) AS i")
    assert tools.evidence(df).first()["evidence"] == '{"a":null,"b":null,"c":1.5,"d":"2025-01-02","e":[null,2.0],"h":{"f":null,"g":1},"i":null}'


def test_structured_answers(spark):
    rows = [('{"a": 1, "b": null}', None), ('```json\n{"a": 1, "b": 2}\n```', None), ("x {\"a\": {\"b\": 1}, \"b\": 1} y", None), ("[1]", "not_json"), ("{a", "not_json"), (None, "not_json"), ('{"a": 1}', "missing_keys:b"), ("{}", "missing_keys:a,b")]
    got = spark.createDataFrame([r[:1] for r in rows], "t string").select(text.parse_structured(F.col("t"), ["a", "b"]).alias("r")).select("r.error").collect()
    assert [r["error"] for r in got] == [e for _, e in rows]


def test_nested_payloads_are_masked(spark):
    df = spark.createDataFrame([(1, {"user_email": "ann@x.org", "phone": "+49 30 1234567", "note": "mail ann@x.org or 030 1234567"}, [{"k": ["call 030-1234567"]}], None, "2024 and 12345")], "id int, m map<string,string>, a array<map<string,array<string>>>, s struct<email:string>, t string")
    r = text.masked_rows(df).first()
    assert r["m"] == {"user_email": "a***@x.org", "phone": "+** ** *****67", "note": "mail a***@x.org or *** *****67"}
    assert r["a"] == [{"k": ["call ***-*****67"]}] and r["s"] is None and (r["id"], r["t"]) == (1, "2024 and 12345")


def test_nearest_neighbours_of_many_queries(spark):
    import numpy as np

    rng = np.random.default_rng(2)
    rows = [(i, [float(x) for x in rng.integers(-3, 4, 4)]) for i in range(90)] + [(90, [1.0, 2.0]), (91, [2.0, 4.0]), (92, None), (93, []), (None, [1.0, 1.0]), (94, [0.0] * 4)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(5)
    want = {}
    for q, v in rows:
        if q is None or not v or q % 10:
            continue
        cos = lambda x: round(float(np.dot(x, v) / n), 6) if (n := np.linalg.norm(x) * np.linalg.norm(v)) else 0.0
        near = sorted((-cos(x), i) for i, x in rows if i is not None and x and len(x) == len(v))[:4]
        want[q] = [(i, -c + 0.0) for c, i in near]
    for block in (4096, 3):
        got = {}
        for r in retrieval.cosine_topk_of(df, df.filter("vec_id % 10 = 0"), 4, block=block).orderBy("query_id", "rank").collect():
            got.setdefault(r["query_id"], []).append((r["vec_id"], r["cosine"]))
        assert got == want


def test_ranks_sums_and_quantiles(spark):
    import numpy as np

    rows = [(i % 3 if i % 3 else None, float(i * 7 % 50) if i % 4 else None, i) for i in range(200)]
    df = spark.createDataFrame(rows, "g int, v double, i int")
    got = ranks.running(df, [F.asc_nulls_last("v"), F.col("i")], rank="r", sums={"s": "v"}, group="g").collect()
    for g in (None, 1, 2):
        mine = sorted((r for r in got if r["g"] == g), key=lambda r: r["r"])
        order = sorted((r for r in rows if r[0] == g), key=lambda r: (r[1] is None, r[1] or 0, r[2]))
        assert [r["i"] for r in mine] == [r[2] for r in order] and [r["r"] for r in mine] == list(range(1, len(order) + 1))
        assert [r["s"] for r in mine] == list(np.cumsum([r[1] or 0 for r in order]))
    values = [r[1] for r in rows if r[1] is not None]
    q = ranks.quantiles(df, [F.col("v"), F.col("i"), F.lit(None).cast("double")], [0.0, 0.1, 0.25, 0.5, 0.99, 1.0]).first()
    assert np.allclose(q["q0"], np.quantile(values, [0.0, 0.1, 0.25, 0.5, 0.99, 1.0])) and q["k0"] == len(values)
    assert np.allclose(q["q1"], np.quantile(range(200), [0.0, 0.1, 0.25, 0.5, 0.99, 1.0])) and q["k2"] == 0 and q["q2"] is None
    rows = spark.createDataFrame([(None, "a"), ("a", None), ("a", "a"), ("a", "a")], "x string, y string")
    assert rows.select(*ranks.row_digest(["x", "y"])).distinct().count() == 3


def test_quality_runs_and_rules(spark):
    rules = catalog.resolve_rules("customers_pii_aware", [quality.Rule("own", "required", "city")])
    assert [r.id for r in rules][-1] == "own" and len(rules) == len(quality.PROFILES["customers_pii_aware"]) + 1
    for profile, own in (("nothing", None), (None, None), ("", [])):
        with pytest.raises(ValueError):
            catalog.resolve_rules(profile, own)
    df = spark.createDataFrame([("a", "1", None), (None, "2", "x")], "customer_name string, customer_code string, city string")
    run, findings = catalog.record_run(quality.evaluate(df, rules), "d", 3, "2025-01-01 00:00:00")
    detail = catalog.run_detail(run, findings, 3).first()
    assert detail["verdict"] == "fail" and {"own", "customer_required"} <= {f["rule_id"] for f in detail["findings"]}
    assert catalog.run_detail(run, findings, 4).count() == 0
    one = spark.createDataFrame([("d", 1, 0.5)], "dataset string, run_id long, score double")
    assert catalog.trend(one).first()["direction"] == "stable"


def test_schema_versions_follow_changes(spark):
    v = spark.createDataFrame([], catalog.VERSIONS)
    a, b = spark.createDataFrame([(1, "x")], "a int, b string"), spark.createDataFrame([("x", 1)], "b string, a int")
    for df in (a, b, a.withColumn("c", F.lit(1)), a):
        v = catalog.register_version(v, "d", df, 1)
    assert [r["version"] for r in v.orderBy("version").collect()] == [1, 2, 3] and catalog.schema_hash(a) == catalog.schema_hash(b)


def test_profile_and_preview(spark):
    df = spark.createDataFrame([("b", 1), ("a", None), ("b", 1), ("c", None), ("d", None)], "x string, n int")
    got = {r["column"]: r for r in quality.profile(df).collect()}
    assert (got["x"]["samples"], got["x"]["distinct"], got["x"]["dtype"]) == (["a", "b", "c"], 4, "string") and (got["n"]["missing_pct"], got["n"]["over_30_pct_missing"]) == (60.0, True)
    rows, repeats = quality.preview(df, 2)
    assert len(rows) == 2 and repeats == 1
    assert quality.profile(df.limit(0)).count() == 2


def test_usage_and_mapping_edges(spark):
    turns = spark.createDataFrame([(1, "m", "a" * 9, None, None, 7, "d"), (2, "x", None, "", 5, None, "d")], "conversation_id int, model string, prompt string, answer string, prompt_tokens long, completion_tokens long, created_at string")
    prices = spark.createDataFrame([("m", 1.0, 2.0)], "model string, input_price double, output_price double")
    got = {r["conversation_id"]: (r["prompt_tokens"], r["completion_tokens"], r["estimated_cost"]) for r in ledger.record_usage(turns, prices).collect()}
    assert (got[1][0], got[1][1], float(got[1][2])) == (2, 7, 0.016) and got[2] == (5, 0, None)
    edges = lineage.column_lineage(spark, {"a": "x", "b": "b"}, "upload", "fact", "job-1")
    start = spark.createDataFrame([("upload.a",)], "node string")
    assert [r["node"] for r in lineage.reachable(edges, start).collect()] == ["fact.x"]


def test_checked_stream_resumes_after_a_cancel(spark, tmp_path):
    src, out = tmp_path / "in", str(tmp_path / "out")
    src.mkdir()
    for i in range(3):
        (src / f"{i}.csv").write_text(f"k,v\n{i},a\n{i},a\n{i},\n{i},b,too many\n")
    schema = "k int, v string, _corrupt_record string"
    asked = []

    def cancelled():
        asked.append(1)
        return len(asked) == 2

    with pytest.raises(StreamingQueryException, match="cancelled"):
        ingest.load_checked(ingest.read_folder(spark, str(src), schema, files_per_batch=1), out, ["v"], cancelled).awaitTermination(180)
    assert spark.read.parquet(f"{out}/table").count() == 1
    ingest.load_checked(ingest.read_folder(spark, str(src), schema, files_per_batch=1), out, ["v"]).awaitTermination(180)
    assert sorted(r["k"] for r in spark.read.parquet(f"{out}/table").collect()) == [0, 1, 2]
    letters = spark.read.parquet(f"{out}/dead_letters")
    assert {r["reason"]: r["n"] for r in letters.groupBy("reason").agg(F.count(F.lit(1)).alias("n")).collect()} == {"malformed": 3, "missing: v": 3}
    m = spark.read.parquet(f"{out}/metrics").agg(*[F.sum(c).alias(c) for c in ("rows", "written", "duplicates", "malformed", "incomplete")]).first()
    assert tuple(m) == (12, 3, 3, 3, 3)
