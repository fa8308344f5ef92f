"""Time series, anomaly, forecast and model queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.operators import anomaly, customers, ml, timeseries
from tidemark.registry import register
from tidemark.sources import star
from tidemark.sources.star import SALES_SQL

S = f"WITH {SALES_SQL}, series AS (SELECT transaction_date AS ds, round(sum(revenue), 2)::DOUBLE AS y FROM sales WHERE transaction_date IS NOT NULL GROUP BY 1)"


def series(spark, sf_dir):
    return timeseries.daily(star.sales(spark, sf_dir))


@register("daily_series", f"{S} SELECT * FROM series")
def daily_series(spark, sf_dir):
    return series(spark, sf_dir)


@register("densify_calendar", f"{S}, d AS (SELECT unnest(generate_series((SELECT min(ds) FROM series), (SELECT max(ds) FROM series), INTERVAL 1 DAY))::DATE AS ds) SELECT d.ds, coalesce(y, 0) AS y FROM d LEFT JOIN series s ON d.ds = s.ds")
def densify_calendar(spark, sf_dir):
    return timeseries.densify(series(spark, sf_dir))


for _g, _end in {"weekly": "(date_trunc('week', ds)::DATE + 6)", "monthly": "last_day(ds)"}.items():

    @register(f"resample_{_g}", f"{S} SELECT {_end} AS ds, round(sum(y::DECIMAL(20,4)), 2)::DOUBLE AS y FROM series GROUP BY 1")
    def _resample(spark, sf_dir, granularity=_g):
        return timeseries.resample(series(spark, sf_dir), granularity)


_LAGS = ", ".join(f"coalesce(lag(y, {n}) OVER (ORDER BY ds), 0) AS lag_{n}" for n in (1, 7, 14, 30))
_ROLLS = ", ".join(
    f"round(avg(y) OVER (ORDER BY ds ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW), 4) AS roll_mean_{n}, round(coalesce(stddev_samp(y) OVER (ORDER BY ds ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW), 0), 3) AS roll_std_{n}" for n in (7, 14, 30)
)


@register("ts_features", f"{S} SELECT ds, y, (isodow(ds) - 1)::INTEGER AS dow, month(ds)::INTEGER AS month, day(ds)::INTEGER AS day, (isodow(ds) >= 6)::INTEGER AS is_weekend, {_LAGS}, {_ROLLS} FROM series")
def ts_features(spark, sf_dir):
    return timeseries.features(series(spark, sf_dir))


_ERRORS = "errors AS (SELECT ds, y, round(y - (lag(y) OVER w * 0.6::DOUBLE + avg(y) OVER (ORDER BY ds ROWS BETWEEN 7 PRECEDING AND 1 PRECEDING) * 0.4::DOUBLE), 4) AS error FROM series WINDOW w AS (ORDER BY ds) QUALIFY row_number() OVER w > 7)"


@register("walk_forward_errors", f"{S}, {_ERRORS} SELECT * FROM errors")
def walk_forward_errors(spark, sf_dir):
    return timeseries.walk_forward_errors(series(spark, sf_dir))


@register(
    "seasonal_naive_forecast",
    f"""{S}, {_ERRORS}, tail AS (SELECT ds, y, row_number() OVER (ORDER BY ds DESC) AS r FROM series), l AS (SELECT avg(y) AS level, max(ds) AS last FROM tail WHERE r <= 7),
    q AS (SELECT quantile_cont(error, 0.1) AS lo, quantile_cont(error, 0.9) AS hi FROM errors), h AS (SELECT unnest(generate_series(1, 28)) AS step),
    p AS (SELECT last + step::INTEGER AS ds, greatest(0, y * 0.6::DOUBLE + level * 0.4::DOUBLE) AS p, lo, hi FROM h, l, q, tail WHERE r = 7 - (step - 1) % 7)
    SELECT ds, round(p, 2) AS yhat, round(least(p, greatest(0, p + lo)), 2) AS lower, round(greatest(p, p + hi), 2) AS upper FROM p""",
)
def seasonal_naive_forecast(spark, sf_dir):
    return timeseries.baseline_forecast(series(spark, sf_dir), 28)


@register(
    "zscore_iqr_outliers",
    f"""{S}, m AS (SELECT avg(y) AS m, stddev_pop(y) AS s, quantile_cont(y, 0.25) AS q1, quantile_cont(y, 0.75) AS q3 FROM series), z AS (SELECT ds, y, (y - m) / s AS z, q1, q3, q3 - q1 AS iqr FROM series, m)
    SELECT ds, y, round(z, 4) AS z, y < q1 - 1.5 * iqr OR y > q3 + 1.5 * iqr AS iqr_flag, round(least(1, abs(z) / 4) * 0.5, 4) AS score, abs(z) > 2.5 AS anomaly,
    CASE WHEN abs(z) <= 2.5 THEN 'low' WHEN least(1, abs(z) / 4) * 0.5 >= 0.85 THEN 'critical' WHEN least(1, abs(z) / 4) * 0.5 >= 0.7 THEN 'high' WHEN least(1, abs(z) / 4) * 0.5 >= 0.55 THEN 'medium' ELSE 'low' END AS severity FROM z""",
)
def zscore_iqr_outliers(spark, sf_dir):
    return timeseries.outliers(series(spark, sf_dir))


@register(
    "time_split",
    f"""{S}, n AS (SELECT ds, y, row_number() OVER (ORDER BY ds) AS i, count(*) OVER () AS n FROM series)
    SELECT ds, y, CASE WHEN n < 3 OR i <= greatest(1, round(n * 0.7)) THEN 'train' WHEN i <= greatest(1, round(n * 0.7)) + round(n * 0.15) THEN 'validate' ELSE 'test' END AS split FROM n""",
)
def time_split(spark, sf_dir):
    return ml.split_by_time(series(spark, sf_dir))


@register("gbt_forecast")
def gbt_forecast(spark, sf_dir):
    return ml.gbt_forecast(series(spark, sf_dir))


@register("kmeans_segments")
def kmeans_segments(spark, sf_dir):
    return ml.segments(customers.customer_features(star.sales(spark, sf_dir)))[0]


@register("churn_model_scores")
def churn_model_scores(spark, sf_dir):
    f = customers.customer_features(star.sales(spark, sf_dir))
    return ml.churn_scores(f.withColumn("churn", (F.col("recency") > 90).cast("int")))[0]


_NB = "(-5), (-4), (-3), (-2), (-1), (1), (2), (3), (4), (5)"


@register(
    "local_outlier_factor",
    f"""{S}, s AS (SELECT ds, y, row_number() OVER (ORDER BY y, ds) AS i FROM series), o(o) AS (VALUES {_NB}),
    nb AS (SELECT a.i, b.i AS j, abs(b.y - a.y) AS d FROM s a, o JOIN s b ON b.i = a.i + o QUALIFY row_number() OVER (PARTITION BY a.i ORDER BY abs(b.y - a.y), b.i) <= 5), kd AS (SELECT i, max(d) AS kd FROM nb GROUP BY 1),
    lrd AS (SELECT nb.i, 1 / (avg(greatest(d, kd)) + 1e-10) AS lrd FROM nb JOIN kd ON kd.i = nb.j GROUP BY 1), f AS (SELECT nb.i, avg(n.lrd) / any_value(m.lrd) AS lof FROM nb JOIN lrd n ON n.i = nb.j JOIN lrd m ON m.i = nb.i GROUP BY 1)
    SELECT ds, y, round(lof, 3) AS lof FROM s JOIN f ON s.i = f.i""",
)
def local_outlier_factor(spark, sf_dir):
    return anomaly.local_outlier_factor(series(spark, sf_dir)).withColumn("lof", F.round("lof", 3))


@register("anomaly_detectors")
def anomaly_detectors(spark, sf_dir):
    """All four detectors; the forest's random cuts have no SQL form."""
    return anomaly.detect(series(spark, sf_dir))
