"""Evidence, recommendations, cases, reports, model ledgers and the paged source on small inputs."""

import datetime as dt
import json
import threading
from http.server import BaseHTTPRequestHandler, HTTPServer
from urllib.parse import parse_qs, urlparse

import pytest

from tidemark.operators import decision, ledger, quality, sales
from tidemark.plans import dashboards, glossary
from tidemark.sources import rest

COLUMNS = "order_key long, line_number int, transaction_date date, customer_name string, product_name string, category string, branch_name string, quantity double, selling_price double, revenue double, cost_price double"


def shop(spark, days):
    """Revenue falls from 100 a day to about 20, with some noise."""
    rows = [(i, 1, dt.date(2025, 1, 1) + dt.timedelta(days=i), f"c{i % 6}", "p", "k", "b", 1.0, 10.0, 100.0 - 80.0 * i / max(1, days) + i % 3, 150.0) for i in range(days)]
    return spark.createDataFrame(rows, COLUMNS).selectExpr("* except (revenue, cost_price)", "cast(revenue as decimal(18,4)) revenue", "cast(cost_price as decimal(18,4)) cost_price")


def test_evidence_and_ranked_recommendations(spark):
    facts = decision.evidence(shop(spark, 20))
    row = facts.first()
    assert (row["n_rows"], row["n_points"], row["n_customers"], row["n_periods"]) == (20, 20, 6, 14)
    assert (row["kpi_confidence"], row["anomaly_confidence"], row["forecast_confidence"], row["ml_confidence"]) == (0.667, 0.733, 0.75, 0.3)
    got = decision.recommend(facts).collect()
    assert [r["rank"] for r in got] == list(range(1, len(got) + 1))
    assert {"revenue_drop_rule", "margin_crit_rule"} <= {r["rule"] for r in got}
    assert [r["score"] for r in got] == sorted((r["score"] for r in got), reverse=True)
    first = next(r for r in got if r["rule"] == "revenue_drop_rule")
    assert first["evidence_id"] == "ev-0001" and first["scenario"] == "price_change_pct" and first["change"] == -5.0 and "score" in first["summary"]


def test_no_sales_give_no_evidence_and_no_advice(spark):
    facts = decision.evidence(shop(spark, 0))
    assert {r["status"] for r in decision.evidence_items(facts).collect()} == {"unavailable"}
    assert decision.recommend(facts).count() == 0


def test_few_days_give_a_floored_interval_and_no_anomalies(spark):
    row = decision.evidence(shop(spark, 5)).first()
    assert row["anomaly_confidence"] == 0.0 and row["n_anomalies"] is None and row["forecast_confidence"] == 0.45


def test_cases_are_replaced_and_audits_append(spark, tmp_path):
    cases = decision.CaseLedger(spark, str(tmp_path))
    assert cases.cases().count() == 0
    facts = decision.evidence(shop(spark, 20))
    facts = spark.createDataFrame(facts.collect(), facts.schema)
    for at in ("2025-02-01", "2025-02-02"):
        cases.save(1, "all branches", facts, at)
    cases.save(2, "north", facts, "2025-01-01")
    assert [(r["case_id"], r["subject"]) for r in cases.cases().collect()] == [(1, "all branches"), (2, "north")]
    assert cases.part("evidence", 1).count() == 4
    cases.audit(1, "me", "accept", "", "2025-02-03")
    cases.audit(1, "you", "reject", "why", "2025-02-04")
    assert cases.part("audits", 1).count() == 2
    with pytest.raises(ValueError):
        cases.audit(9, "me", "accept", "", "2025-02-03")


def test_deployment_status(spark):
    v = spark.createDataFrame([("m", "v1"), ("m", "v2"), ("n", "v1")], "model string, version string")
    e = spark.createDataFrame([(1, "m", "v1", "DEPLOYING"), (2, "m", "v1", "ACTIVE")], "event_id int, model string, version string, to_status string")
    status = {(r["model"], r["version"]): (r["status"], r["n_events"]) for r in ledger.deployment_status(v, e).collect()}
    assert status[("m", "v1")] == ("ACTIVE", 2) and status[("m", "v2")] == ("PENDING", 0)


def test_merged_scores_weigh_by_rows(spark):
    names = "n long, completeness double, uniqueness double, validity double, consistency double"
    got = quality.merge_scores(spark.createDataFrame([(10, 1.0, 1.0, 1.0, 1.0), (30, 0.5, 1.0, 1.0, 1.0)], names)).first()
    assert got["completeness"] == 0.625 and got["score"] == 0.9063
    none = quality.merge_scores(spark.createDataFrame([], names)).first()
    assert none["score"] == 0.0 and none["passed"] is False


def test_enrichment_never_repeats_rows(spark):
    left = spark.createDataFrame([("Tea  Pot",), ("cup",), (None,)], "product_name string")
    right = spark.createDataFrame([("tea pot", "b"), (" TEA POT", "a"), (None, "x")], "product_name string, brand string")
    assert sorted(((r["product_name"], r["brand"]) for r in sales.enrich(left, right, ["brand"]).collect()), key=str) == sorted([("Tea  Pot", "a"), ("cup", None), (None, None)], key=str)


def test_routes(spark):
    q = spark.createDataFrame([("Show revenue and stock",), (None,), ("hello",), (" ".join(w[0] for w in glossary.INTENTS.values()),)], "text string")
    got = [r["tools"] for r in glossary.route(q).collect()]
    assert got[0] == ["get_kpi", "query_inventory"] and got[1] == got[2] == list(glossary.DEFAULT_TOOLS) and len(got[3]) == 8


def test_summary_without_sales_says_zero(spark):
    got = dashboards.executive_summary(shop(spark, 0)).collect()
    assert len(got) == 7 and "revenue 0.00" in got[0]["line"]


@pytest.fixture
def server():
    seen = []

    class Pages(BaseHTTPRequestHandler):
        def do_GET(self):
            q = parse_qs(urlparse(self.path).query)
            page, size = int(q["page"][0]), int(q["per_page"][0])
            seen.append((page, self.headers.get("Authorization"), q.get("kind")))
            rows = [{"id": i, "name": f"n{i}"} for i in range(23)][(page - 1) * size : page * size]
            body = json.dumps({"data": rows} if "bad" not in self.path else {"rows": rows}).encode()
            self.send_response(200)
            self.end_headers()
            self.wfile.write(body)

        def log_message(self, *_):
            pass

    http = HTTPServer(("127.0.0.1", 0), Pages)
    threading.Thread(target=http.serve_forever, daemon=True).start()
    yield f"http://127.0.0.1:{http.server_port}", seen
    http.shutdown()


def test_paged_source(spark, server):
    url, seen = server
    df = rest.read_rest(spark, f"{url}/rows", "id long, name string", pageSize=5, readers=3, token="t", params={"kind": "x"})
    assert sorted(r["id"] for r in df.collect()) == list(range(23))
    assert {page for page, *_ in seen} >= {1, 2, 3, 4, 5} and all(a == "Bearer t" and k == ["x"] for _, a, k in seen)
    with pytest.raises(Exception, match="could not be read"):
        rest.read_rest(spark, f"{url}/bad", "id long").collect()


def test_rows_of():
    assert rest.rows_of([1]) == rest.rows_of({"data": [1]}) == rest.rows_of({"items": [1]}) == [1]
    with pytest.raises(ValueError):
        rest.rows_of({"data": 1})
