"""Decision, report and ledger queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.operators import decision, ledger, quality, sales
from tidemark.plans import dashboards, glossary
from tidemark.plans import retail, series  # noqa: F401  their SQL is reused here
from tidemark.registry import ORACLE, register
from tidemark.sources import star
from tidemark.sources.star import table

_FACTS = f"""WITH k AS ({ORACLE['kpi_evaluate']}), z AS ({ORACLE['zscore_iqr_outliers']}), f AS ({ORACLE['seasonal_naive_forecast']}), r AS ({ORACLE['rfm']}),
facts AS (SELECT (SELECT value FROM k WHERE name = 'revenue') AS revenue, (SELECT value FROM k WHERE name = 'growth_pct') AS growth, (SELECT status FROM k WHERE name = 'margin_pct') AS margin,
  (SELECT count(*) FROM lineitem) AS n_rows, (SELECT count(*) FROM z) AS n_points, (SELECT count(*) FILTER (anomaly) FROM z) AS odd, (SELECT max(score) FILTER (anomaly) FROM z) AS peak,
  (SELECT count(*) FROM f) AS n_periods, (SELECT arg_min(yhat, ds) FROM f) AS y1, (SELECT arg_max(yhat, ds) FROM f) AS y2, (SELECT count(*) FROM r) AS n_customers, (SELECT count(*) FILTER (segment = 'at_risk') FROM r) AS risky),
conf AS (SELECT *, round(least(1, n_rows / 30.0), 3)::DOUBLE AS kc, round(least(0.9, 0.4 + n_points / 60.0), 3)::DOUBLE AS ac, 0.75::DOUBLE AS fc, round(least(1, greatest(0.3, n_customers / 20.0)), 3)::DOUBLE AS mc FROM facts)"""


def facts(spark, sf_dir):
    return decision.evidence(star.sales(spark, sf_dir), star.expenses(spark, sf_dir), 28, detectors="deviation")


@register(
    "decision_evidence",
    f"""{_FACTS} SELECT 'ev-0001' AS id, 'kpi' AS kind, 'available' AS status, kc AS confidence, printf('revenue %.2f, growth %.2f %%', revenue, growth) AS note FROM conf
    UNION ALL SELECT 'ev-0002', 'anomaly', 'available', ac, printf('%d of %d days stand out', odd, n_points) FROM conf
    UNION ALL SELECT 'ev-0003', 'forecast', 'available', fc, printf('%d periods ahead, %.2f to %.2f', n_periods, y1, y2) FROM conf
    UNION ALL SELECT 'ev-0004', 'ml_prediction', 'available', mc, printf('%d of %d customers at risk', risky, n_customers) FROM conf""",
)
def decision_evidence(spark, sf_dir):
    return decision.evidence_items(facts(spark, sf_dir))


@register(
    "decision_recommendations",
    f"""{_FACTS}, rules AS (
      SELECT 'revenue_drop_rule' AS rule, growth < -5 AS fired, least(1, abs(growth) / 20) AS severity, kc AS confidence FROM conf
      UNION ALL SELECT 'margin_crit_rule', margin IN ('crit', 'warn'), CASE WHEN margin = 'crit' THEN 0.9 ELSE 0.5 END, kc FROM conf
      UNION ALL SELECT 'anomaly_spike_rule', odd > 0, 0.5 * least(1, odd * 5.0 / n_points) + 0.5 * least(1, peak), ac FROM conf
      UNION ALL SELECT 'churn_risk_rule', risky > 0, 0.3 + 0.7 * risky / n_customers, mc FROM conf
      UNION ALL SELECT 'forecast_decline_rule', y1 > 0 AND (y1 - y2) / y1 * 100 >= 5, least(1, (y1 - y2) / y1 * 100 / 30), fc FROM conf),
    scored AS (SELECT rule, round(severity, 3)::DOUBLE AS severity, confidence, round(100 * (0.6 * round(severity, 3) + 0.4 * confidence), 2)::DOUBLE AS score FROM rules WHERE fired)
    SELECT row_number() OVER (ORDER BY score DESC, rule)::INTEGER AS rank, rule, severity, confidence, score FROM scored""",
)
def decision_recommendations(spark, sf_dir):
    return decision.recommend(facts(spark, sf_dir)).select("rank", "rule", "severity", "confidence", "score")


_WIDE = ", ".join(f"max(value) FILTER (name = '{n}') AS {n}" for n in ("revenue", "orders", "units", "aov", "growth_pct", "margin_pct", "net_profit"))


@register(
    "executive_summary",
    f"""WITH k AS ({ORACLE['kpi_values_long']}), v AS (SELECT {_WIDE} FROM k),
    t AS (SELECT unnest([
      {{'section': 'narrative', 'line': printf('Period all: revenue %.2f from %.0f orders, %.2f units, %.2f an order; growth %.2f %%, margin %.2f %%, net profit %.2f.', revenue, orders, units, aov, growth_pct, margin_pct, net_profit)}},
      {{'section': 'highlight', 'line': printf('Revenue %.2f from %.0f orders.', revenue, orders)}}, {{'section': 'highlight', 'line': printf('Mean order %.2f, %.2f units sold.', aov, units)}},
      {{'section': 'risk', 'line': printf('Growth stands at %.2f %%.', growth_pct)}}, {{'section': 'risk', 'line': printf('Margin stands at %.2f %%.', margin_pct)}},
      {{'section': 'advice', 'line': CASE WHEN growth_pct < 0 THEN 'Look into the weaker half of the period.' ELSE 'Keep up what made the period grow.' END}},
      {{'section': 'advice', 'line': CASE WHEN net_profit < 0 THEN 'Bring costs below revenue.' ELSE 'Watch the largest costs.' END}}]) AS s, generate_subscripts([1, 2, 3, 4, 5, 6, 7], 1)::INTEGER AS position FROM v)
    SELECT s.section AS section, position, s.line AS line FROM t""",
)
def executive_summary(spark, sf_dir):
    return dashboards.executive_summary(star.sales(spark, sf_dir), star.expenses(spark, sf_dir))


@register(
    "intent_route",
    "SELECT conv_id, turn, CASE WHEN len(t) > 0 THEN array_to_string(t[1:8], ',') ELSE 'get_kpi,query_sales' END AS tools FROM (SELECT conv_id, turn, list_filter(["
    + ", ".join(f"CASE WHEN regexp_matches(lower(coalesce(text, '')), '{'|'.join(words)}') THEN '{tool}' END" for tool, words in glossary.INTENTS.items())
    + "], lambda x: x IS NOT NULL) AS t FROM conversations)",
)
def intent_route(spark, sf_dir):
    return glossary.route(table(spark, sf_dir, "conversations")).select("conv_id", "turn", F.array_join("tools", ",").alias("tools"))


@register(
    "quality_merge",
    """WITH p AS (SELECT o_orderstatus, count(*) AS n, avg((o_orderkey % 10 <> 0)::INTEGER) AS c, avg((o_orderkey % 7 <> 0)::INTEGER) AS u, avg((o_orderkey % 3 <> 0)::INTEGER) AS v FROM orders GROUP BY 1),
    m AS (SELECT round(sum(c * n) / sum(n), 4) AS completeness, round(sum(u * n) / sum(n), 4) AS uniqueness, round(sum(v * n) / sum(n), 4) AS validity, 1.0::DOUBLE AS consistency FROM p)
    SELECT *, round((completeness + uniqueness + validity + consistency) / 4, 4) AS score, round((completeness + uniqueness + validity + consistency) / 4, 4) >= 0.8 AS passed FROM m""",
)
def quality_merge(spark, sf_dir):
    share = lambda k: F.avg((F.col("o_orderkey") % k != 0).cast("int"))
    parts = table(spark, sf_dir, "orders").groupBy("o_orderstatus").agg(F.count(F.lit(1)).alias("n"), share(10).alias("completeness"), share(7).alias("uniqueness"), share(3).alias("validity"), F.lit(1.0).alias("consistency"))
    return quality.merge_scores(parts)


@register("deployment_status", "WITH e AS (SELECT event_type AS model, user_id AS version, arg_max(props, event_id) AS status, count(*) AS n FROM events WHERE event_type <> 'click' GROUP BY 1, 2), v AS (SELECT DISTINCT event_type AS model, user_id AS version FROM events) SELECT v.model, v.version, coalesce(status, 'PENDING') AS status, coalesce(n, 0) AS n_events FROM v LEFT JOIN e ON v.model = e.model AND v.version = e.version")
def deployment_status(spark, sf_dir):
    e = table(spark, sf_dir, "events").select("event_id", F.col("event_type").alias("model"), F.col("user_id").alias("version"), F.col("props").alias("to_status"))
    return ledger.deployment_status(e.select("model", "version").distinct(), e.filter("model <> 'click'"))


@register("product_enrichment", "WITH p AS (SELECT lower(p_brand) AS b, min(p_size) AS size FROM part GROUP BY 1) SELECT p_brand AS product_name, size, count(*) AS n FROM lineitem JOIN part ON l_partkey = p_partkey JOIN p ON lower(p_brand) = b GROUP BY 1, 2")
def product_enrichment(spark, sf_dir):
    products = table(spark, sf_dir, "part").select(F.col("p_brand").alias("product_name"), F.col("p_size").alias("size"))
    return sales.enrich(star.sales(spark, sf_dir).select("product_name"), products, ["size"]).groupBy("product_name", "size").agg(F.count(F.lit(1)).alias("n"))
