"""Model registry, experiment, batch scoring and domain forecast queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.operators import customers, models, timeseries
from tidemark.registry import register
from tidemark.sources import star
from tidemark.sources.star import SALES_SQL, table

#: A model log from the events: a model a user group, a version a user, statuses by value.
_LOG = """log AS (SELECT event_id, concat('m', user_id % 10) AS model, concat('v', user_id) AS version,
  CASE event_type WHEN 'click' THEN 'lifecycle' WHEN 'view' THEN 'deployment' WHEN 'purchase' THEN 'run' WHEN 'signup' THEN 'rollback' ELSE 'audit' END AS kind,
  ['DRAFT', 'VALIDATED', 'PRODUCTION', 'ARCHIVED', 'FAILED'][(floor(value)::BIGINT % 5)::INTEGER + 1] AS to_status, ts, CASE WHEN event_id % 3 = 0 THEN concat('/models/', event_id) END AS path, CASE WHEN event_id % 4 = 0 THEN concat('d', event_id) END AS dataset_version, value AS mae FROM events),
states AS (SELECT model, version, coalesce(arg_max(to_status, event_id) FILTER (kind IN ('lifecycle', 'rollback')), 'DRAFT') AS status, coalesce(arg_max(to_status, event_id) FILTER (kind = 'deployment'), 'PENDING') AS deployment,
  arg_max(path, event_id) FILTER (kind = 'run' AND path IS NOT NULL) AS any_path, max(event_id) FILTER (kind = 'run') AS last_run, min(ts) AS created_at, max(ts) AS changed_at FROM log GROUP BY 1, 2),
full_states AS (SELECT s.model, s.version, status, deployment, l.path, created_at, changed_at FROM states s LEFT JOIN log l ON l.event_id = s.last_run)"""


def log(spark, sf_dir):
    e = F.col
    kind = F.when(e("event_type") == "click", "lifecycle").when(e("event_type") == "view", "deployment").when(e("event_type") == "purchase", "run").when(e("event_type") == "signup", "rollback").otherwise("audit")
    status = F.get(F.array(*[F.lit(s) for s in ("DRAFT", "VALIDATED", "PRODUCTION", "ARCHIVED", "FAILED")]), (F.floor("value") % 5).cast("int"))
    return table(spark, sf_dir, "events").select(
        "event_id", F.concat(F.lit("m"), (e("user_id") % 10).cast("string")).alias("model"), F.concat(F.lit("v"), e("user_id").cast("string")).alias("version"), kind.alias("kind"), status.alias("to_status"), e("ts").alias("at"),
        F.when(e("event_id") % 3 == 0, F.concat(F.lit("/models/"), e("event_id").cast("string"))).alias("path"), F.when(e("event_id") % 4 == 0, F.concat(F.lit("d"), e("event_id").cast("string"))).alias("dataset_version"),
        F.array(F.lit("x")).alias("features"), F.create_map(F.lit("mae"), e("value"), F.lit("_seed"), F.lit(7.0)).alias("metrics"), F.create_map(F.lit("event"), e("event_id").cast("string")).alias("params"),
    )


@register("registry_states", f"WITH {_LOG} SELECT * FROM full_states")
def registry_states(spark, sf_dir):
    return models.states(log(spark, sf_dir))


@register(
    "registry_production",
    f"WITH {_LOG} SELECT model, arg_max(version, (status = 'PRODUCTION', created_at, version)) AS version, arg_max(coalesce(path, ''), (status = 'PRODUCTION', created_at, version)) AS path FROM full_states WHERE status <> 'ARCHIVED' GROUP BY 1",
)
def registry_production(spark, sf_dir):
    return models.production(log(spark, sf_dir)).select("model", "version", F.coalesce("path", F.lit("")).alias("path"))


@register(
    "registry_detail",
    f"""WITH {_LOG}, r AS (SELECT model, version, arg_max(dataset_version, event_id) FILTER (kind = 'run' AND dataset_version IS NOT NULL) AS dataset_version, arg_max(mae, event_id) FILTER (kind = 'run') AS mae, max(event_id) FILTER (kind = 'run')::VARCHAR AS event FROM log GROUP BY 1, 2)
    SELECT s.model, s.version, status, deployment, dataset_version, mae, CASE WHEN mae IS NULL THEN NULL ELSE 'mae' END AS metric_names, event FROM full_states s JOIN r ON s.model = r.model AND s.version = r.version""",
)
def registry_detail(spark, sf_dir):
    d = models.detail(log(spark, sf_dir))
    return d.select("model", "version", "status", "deployment", "dataset_version", d["metrics"]["mae"].alias("mae"), F.array_join(F.map_keys("metrics"), ",").alias("metric_names"), d["params"]["event"].alias("event"))


@register(
    "stratified_split",
    """WITH h AS (SELECT o_orderkey, o_orderstatus, row_number() OVER (PARTITION BY o_orderstatus ORDER BY md5(concat('42:', o_orderkey)), o_orderkey) AS i, count(*) OVER (PARTITION BY o_orderstatus) AS n FROM orders)
    SELECT o_orderkey, o_orderstatus, CASE WHEN i <= greatest(1, round(n * 0.7)) THEN 'train' WHEN i <= greatest(1, round(n * 0.7)) + round(n * 0.15) THEN 'validate' ELSE 'test' END AS split FROM h""",
)
def stratified_split(spark, sf_dir):
    return models.split(table(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus"), "churn", "o_orderkey", "o_orderstatus")[0]


_SERIES = f"{SALES_SQL}, series AS (SELECT transaction_date AS ds, round(sum(revenue), 2)::DOUBLE AS y FROM sales WHERE transaction_date IS NOT NULL GROUP BY 1)"


@register(
    "experiment_error_metrics",
    f"""WITH {_SERIES}, n AS (SELECT ds, y, lag(y, 7) OVER (ORDER BY ds) AS guess, row_number() OVER (ORDER BY ds) AS i, count(*) OVER () AS n FROM series),
    s AS (SELECT y - guess AS e, CASE WHEN i <= greatest(1, round(n * 0.7)) THEN 'train' WHEN i <= greatest(1, round(n * 0.7)) + round(n * 0.15) THEN 'validate' ELSE 'test' END AS split FROM n WHERE guess IS NOT NULL)
    SELECT split, count(*) AS n, round(avg(abs(e)), 4) AS mae, round(sqrt(avg(e * e)), 4) AS rmse FROM s GROUP BY 1""",
)
def experiment_error_metrics(spark, sf_dir):
    """The value of a week before as the guess, measured on each part of a split by time."""
    from pyspark.sql import Window

    parted, _ = models.split(timeseries.daily(star.sales(spark, sf_dir)), "forecast", "ds", date="ds")
    return models.error_metrics(parted.withColumn("guess", F.lag("y", 7).over(Window.orderBy("ds"))), "y", "guess")  # a row a day


_LABELS = """f AS (SELECT o_orderkey, (o_totalprice > 150000)::INTEGER AS truth, (o_orderpriority IN ('1-URGENT', '2-HIGH'))::INTEGER AS guess, o_orderstatus AS split FROM orders)"""


@register(
    "experiment_label_metrics",
    f"""WITH {_LABELS}, c AS (SELECT split, count(*) AS n, count(*) FILTER (truth = 1 AND guess = 1) AS tp, count(*) FILTER (truth = 0 AND guess = 1) AS fp, count(*) FILTER (truth = 1 AND guess = 0) AS fn FROM f GROUP BY 1), r AS (SELECT *, tp / (tp + fp) AS p, tp / (tp + fn) AS r FROM c)
    SELECT split, n, round((n - fp - fn) / n, 4) AS accuracy, round(p, 4) AS precision, round(r, 4) AS recall, round(2 * p * r / (p + r), 4) AS f1 FROM r""",
)
def experiment_label_metrics(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    f = o.select("o_orderkey", (F.col("o_totalprice") > 150000).cast("int").alias("truth"), F.col("o_orderpriority").isin("1-URGENT", "2-HIGH").cast("int").alias("guess"), F.col("o_orderstatus").alias("split"))
    return models.label_metrics(f, "truth", "guess")


@register(
    "batch_churn_summary",
    f"""WITH {SALES_SQL}, f AS (SELECT customer_name, count(*) AS n, (SELECT max(transaction_date) FROM sales) - max(transaction_date) AS recency FROM sales GROUP BY 1),
    p AS (SELECT CASE WHEN n >= 20 THEN round(least(1.0, recency / 365), 6) END AS proba, n < 20 AS bad FROM f)
    SELECT count(*) AS n_rows, count(*) FILTER (bad) AS n_errors, count(*) FILTER (NOT bad) AS n_scored, round(avg(proba), 4)::DOUBLE AS mean_proba, count(*) FILTER (proba > 0.5) AS n_flagged FROM p""",
)
def batch_churn_summary(spark, sf_dir):
    """The summary of a batch of scores: here a share of a year without orders, for customers with 20 rows or more."""
    f = customers.customer_features(star.sales(spark, sf_dir))
    known = F.col("total_orders") >= 20
    p = F.when(known, F.round(F.least(F.lit(1.0), F.col("recency") / 365), 6))
    return models.batch_summary(f.select("customer_name", p.alias("churn_proba"), (p > 0.5).alias("churn"), F.when(~known, "too few orders").alias("error")), "churn")


def _forecast_sql(days: str, horizon: int) -> str:
    """The envelope of a baseline forecast over ``days``, a common table of (ds, y) by day without gaps."""
    return f"""errors AS (SELECT ds, round(y - (lag(y) OVER w * 0.6::DOUBLE + avg(y) OVER (ORDER BY ds ROWS BETWEEN 7 PRECEDING AND 1 PRECEDING) * 0.4::DOUBLE), 4) AS error FROM {days} WINDOW w AS (ORDER BY ds) QUALIFY row_number() OVER w > 7),
    tail AS (SELECT ds, y, row_number() OVER (ORDER BY ds DESC) AS r FROM {days}), l AS (SELECT avg(y) AS level, max(ds) AS last FROM tail WHERE r <= 7), h AS (SELECT unnest(generate_series(1, {horizon})) AS step),
    p AS (SELECT last + step::INTEGER AS ds, round(greatest(0, y * 0.6::DOUBLE + level * 0.4::DOUBLE), 2) AS yhat FROM h, l, tail WHERE r = 7 - (step - 1) % 7)"""


@register(
    "domain_forecast_demand",
    f"""WITH {SALES_SQL}, raw AS (SELECT transaction_date AS ds, round(sum(quantity::DECIMAL(20,4)), 2)::DOUBLE AS y FROM sales WHERE transaction_date IS NOT NULL GROUP BY 1), days AS (SELECT d.ds, coalesce(y, 0) AS y FROM (SELECT unnest(generate_series((SELECT min(ds) FROM raw), (SELECT max(ds) FROM raw), INTERVAL 1 DAY))::DATE AS ds) d LEFT JOIN raw r ON d.ds = r.ds), {_forecast_sql('days', 14)}
    SELECT 'demand' AS domain, 'quantity' AS value_column, 'seasonal_naive' AS method, (SELECT count(*) FROM days) AS n_obs, (SELECT count(*) FROM days) - (SELECT count(*) FROM raw) AS n_gap_days, (SELECT round(avg(abs(error)), 2) FROM errors) AS mae_baseline,
      (SELECT count(*) FROM p) AS periods, (SELECT arg_min(yhat, ds) FROM p) AS first_yhat, (SELECT arg_max(yhat, ds) FROM p) AS last_yhat""",
)
def domain_forecast_demand(spark, sf_dir):
    row = timeseries.domain_forecast(star.sales(spark, sf_dir), "demand", 14)
    f = F.col("forecast")
    return row.select("domain", "value_column", "method", "n_obs", F.col("n_gap_days").cast("long").alias("n_gap_days"), "mae_baseline", F.size(f).cast("long").alias("periods"), F.get(f, F.lit(0))["yhat"].alias("first_yhat"), F.element_at(f, -1)["yhat"].alias("last_yhat"))


@register(
    "domain_forecast_unsupported",
    "SELECT 'inventory' AS domain, 'unsupported_shape' AS method, 'no column for inventory (looked for stock_qty/stock/inventory/quantity/y/value); the frame has ' || string_agg(column_name, ', ' ORDER BY column_name) AS reason, 0 AS periods FROM information_schema.columns WHERE table_name = 'customer'",
)
def domain_forecast_unsupported(spark, sf_dir):
    row = timeseries.domain_forecast(table(spark, sf_dir, "customer"), "inventory", 14)
    return row.select("domain", "method", "reason", F.size("forecast").alias("periods"))


@register(
    "forecast_by_branch",
    f"""WITH {SALES_SQL}, series AS (SELECT branch_name, transaction_date AS ds, round(sum(revenue), 2)::DOUBLE AS y FROM sales WHERE transaction_date IS NOT NULL GROUP BY 1, 2),
    errors AS (SELECT branch_name, round(y - (lag(y) OVER w * 0.6::DOUBLE + avg(y) OVER (PARTITION BY branch_name ORDER BY ds ROWS BETWEEN 7 PRECEDING AND 1 PRECEDING) * 0.4::DOUBLE), 4) AS error FROM series WINDOW w AS (PARTITION BY branch_name ORDER BY ds) QUALIFY row_number() OVER w > 7),
    q AS (SELECT branch_name, quantile_cont(error, 0.1) AS lo, quantile_cont(error, 0.9) AS hi FROM errors GROUP BY 1),
    tail AS (SELECT *, row_number() OVER (PARTITION BY branch_name ORDER BY ds DESC) AS r FROM series), l AS (SELECT branch_name, avg(y) AS level, max(ds) AS last FROM tail WHERE r <= 7 GROUP BY 1), h AS (SELECT unnest(generate_series(1, 7)) AS step),
    p AS (SELECT l.branch_name, last + step::INTEGER AS ds, greatest(0, y * 0.6::DOUBLE + level * 0.4::DOUBLE) AS p, lo, hi FROM l JOIN q ON l.branch_name = q.branch_name JOIN tail t ON t.branch_name = l.branch_name, h WHERE t.r = 8 - step)
    SELECT branch_name, ds, round(p, 2) AS yhat, round(least(p, greatest(0, p + lo)), 2) AS lower, round(greatest(p, p + hi), 2) AS upper FROM p""",
)
def forecast_by_branch(spark, sf_dir):
    return timeseries.baseline_forecast(timeseries.daily(star.sales(spark, sf_dir), "branch_name"), 7, "branch_name")


