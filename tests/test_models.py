import datetime as dt

import pytest
from pyspark.sql import functions as F

from tidemark.operators import models, timeseries

FEATURES = "customer_name string, total_orders long, total_spending double, recency int, frequency long, monetary double, aov double, tenure int, churn int"


@pytest.fixture(scope="module")
def features(spark):
    rows = [(f"c{i}", i % 7 + 1, 10.0 * i, i * 3 % 200, i % 7 + 1, 10.0 * i, 5.0 + i, 200 + i, int(i * 3 % 200 > 90)) for i in range(80)]
    return spark.createDataFrame(rows, FEATURES)


def status(registry, model="m"):
    return {r["version"]: (r["status"], r["deployment"]) for r in models.states(registry.log()).filter(F.col("model") == model).collect()}


def test_lifecycle_keeps_to_its_moves(spark, tmp_path):
    r = models.Registry(spark, str(tmp_path / "registry"))
    assert r.create("m") == "v1" and r.create("m", "/p2") == "v2" and r.create("m", "/p3") == "v3" and r.create("n") == "v1"
    assert status(r) == {"v1": ("DRAFT", "PENDING"), "v2": ("VALIDATED", "PENDING"), "v3": ("VALIDATED", "PENDING")}
    before = r.log().count()
    for version, to, error in (("v1", "PRODUCTION", ValueError), ("v9", "PRODUCTION", KeyError), ("v1", "NOWHERE", ValueError)):
        with pytest.raises(error):
            r.promote("m", version, to)
    with pytest.raises(KeyError):
        r.promote("unknown", "v1")
    r.promote("m", "v1", "DRAFT")
    assert r.log().count() == before
    r.promote("m", "v2")
    r.promote("m", "v3", "STAGED")
    r.promote("m", "v3")
    assert status(r) == {"v1": ("DRAFT", "PENDING"), "v2": ("ARCHIVED", "RETIRED"), "v3": ("PRODUCTION", "SERVING")}
    with pytest.raises(ValueError):
        r.promote("m", "v2")
    assert {x["model"]: (x["version"], x["path"]) for x in models.production(r.log()).collect()} == {"m": ("v3", "/p3"), "n": ("v1", None)}


def test_promote_rollback_cycle_restores_the_predecessor(spark, tmp_path):
    r = models.Registry(spark, str(tmp_path / "registry"))
    for i in range(2):
        r.create("m", f"/p{i}")
    with pytest.raises(ValueError):
        r.rollback("m")
    r.promote("m", "v1")
    with pytest.raises(ValueError):
        r.rollback("m")
    r.promote("m", "v2")
    assert r.rollback("m") == "v1"
    assert status(r) == {"v1": ("PRODUCTION", "SERVING"), "v2": ("ARCHIVED", "RETIRED")}
    assert r.rollback("m") == "v2" and status(r)["v2"] == ("PRODUCTION", "SERVING")
    with pytest.raises(ValueError):
        r.deploy("m", "v2", "STAGING")
    r.deploy("m", "v2", "FAILED")
    assert status(r)["v2"] == ("PRODUCTION", "FAILED")


def test_detail_shows_what_was_recorded_and_guesses_nothing(spark, tmp_path):
    r = models.Registry(spark, str(tmp_path / "registry"))
    r.create("m", "/p", {"f1": 0.5, "_seed": 1.0}, {"k": "4"}, "data-7", ["a", "b"])
    r.create("m")
    rows = {x["version"]: x for x in models.detail(r.log(), "m").collect()}
    v = rows["v1"]
    assert (v["metrics"], v["params"], v["dataset_version"], v["features"], v["path"], v["status"]) == ({"f1": 0.5}, {"k": "4"}, "data-7", ["a", "b"], "/p", "VALIDATED")
    assert rows["v2"]["metrics"] is None and rows["v2"]["dataset_version"] is None and v["created_at"] is not None


@pytest.mark.parametrize("kind, key", [("churn", "churn_proba"), ("segmentation", "segment")])
def test_training_scoring_and_summary(spark, tmp_path, features, kind, key):
    r = models.Registry(spark, str(tmp_path / "registry"))
    done = models.experiment(r, kind, "m", features, {"n_clusters": "3"} if kind == "segmentation" else None, "d1")
    assert done["status"] == "DONE" and done["version"] == "v1" and done["metrics"]
    r.promote("m", "v1")
    model = r.load("m", strict=True)
    some = features.withColumn("aov", F.when(F.col("customer_name") == "c5", None).otherwise(F.col("aov")))
    scored = models.score_batch(model, kind, some)
    rows = {x["customer_name"]: x for x in scored.collect()}
    assert len(rows) == 80 and rows["c5"]["error"] == "missing features" and rows["c5"][key] is None and rows["c6"][key] is not None
    s = models.batch_summary(scored, kind).first()
    assert (s["n_rows"], s["n_errors"], s["n_scored"]) == (80, 1, 79)
    if kind == "churn":
        assert 0 < s["mean_proba"] < 1 and s["n_flagged"] == sum(bool(x["churn"]) for x in rows.values())
    else:
        assert sum(s["segment_distribution"].values()) == 80


def test_experiments_without_result(spark, tmp_path, features):
    r = models.Registry(spark, str(tmp_path / "registry"))
    assert models.experiment(r, "churn", "m", features.limit(0))["status"] == "PLANNED"
    failed = models.experiment(r, "nonsense", "m", features)
    assert failed["status"] == "FAILED" and "nonsense" in failed["reason"]
    assert r.load("m") is None
    r.create("m", str(tmp_path / "missing"))
    assert r.load("m") is None
    with pytest.raises(Exception):  # noqa: B017  whatever the reader says
        r.load("m", strict=True)


def test_stratified_split_keeps_both_classes_in_train(spark):
    df = spark.createDataFrame([(i, int(i < 4)) for i in range(100)] + [(200, None)], "id int, y int")
    got = models.split_stratified(df, "id", "y").collect()
    assert len(got) == 101
    count = {}
    for x in got:
        count[(x["y"], x["split"])] = count.get((x["y"], x["split"]), 0) + 1
    assert count[(1, "train")] == 3 and count[(0, "train")] == 67 and count[(0, "validate")] == 14 and count[(0, "test")] == 15 and count[(None, "train")] == 1
    assert models.split(df.limit(2), "churn", "id", "y")[1] == "too_small_to_split"
    assert models.split(df, "churn", "id", "y")[1] == "random" and models.split(df.filter("y is not null"), "churn", "id", "y")[1] == "stratified"


def test_forecast_says_what_it_lacks(spark):
    day = dt.date(2025, 1, 1)
    none = timeseries.forecast(spark.createDataFrame([], "ds date, y double"), 7).first()
    assert none["method"] == "insufficient_data" and none["forecast"] == [] and none["reason"]
    series = spark.createDataFrame([(day + dt.timedelta(days=i), 100.0 + i % 7) for i in range(30) if i != 10], "ds date, y double")
    got = timeseries.forecast(series, 5).first()
    assert got["method"] == "seasonal_naive" and len(got["forecast"]) == 5 and got["n_obs"] == 30 and got["n_gap_days"] == 1 and got["forecast"][0]["ds"] == dt.date(2025, 1, 31)
    assert timeseries.forecast(series, 0).first()["method"] == "insufficient_data"
    assert len(timeseries.forecast(series, 2, "weekly").first()["forecast"]) == 2
    for bad in ({"horizon": 366}, {"granularity": "hourly"}):
        with pytest.raises(ValueError):
            timeseries.forecast(series, **bad)
    named = series.select(F.col("ds").alias("date"), F.col("y").alias("Stock_Qty"))
    row = timeseries.domain_forecast(named, "inventory", 3).first()
    assert row["value_column"] == "Stock_Qty" and len(row["forecast"]) == 3
    bad = timeseries.domain_forecast(named, "revenue", 3).first()
    assert bad["method"] == "unsupported_shape" and "Stock_Qty" in bad["reason"]
    with pytest.raises(ValueError):
        timeseries.domain_forecast(named, "weather")


def brute_lof(y, k=5):
    import numpy as np

    order = sorted(range(len(y)), key=lambda i: (y[i], i))
    at = {i: p for p, i in enumerate(order)}
    near = {i: sorted((j for j in range(len(y)) if j != i), key=lambda j: (abs(y[j] - y[i]), at[j]))[:k] for i in range(len(y))}
    kd = {i: max(abs(y[j] - y[i]) for j in near[i]) for i in near}
    lrd = {i: 1 / (np.mean([max(kd[j], abs(y[j] - y[i])) for j in near[i]]) + 1e-10) for i in near}
    return [np.mean([lrd[j] for j in near[i]]) / lrd[i] for i in range(len(y))]


def test_outlier_factor_is_the_textbook_one(spark):
    import numpy as np

    from tidemark.operators import anomaly

    rng = np.random.default_rng(5)
    day = dt.date(2025, 1, 1)
    for y in ([float(v) for v in rng.normal(100, 10, 40)] + [300.0], [1.0, 2.0, 4.0]):
        df = spark.createDataFrame([(day + dt.timedelta(days=i), v) for i, v in enumerate(y)], "ds date, y double")
        got = [r["lof"] for r in anomaly.local_outlier_factor(df).orderBy("ds").collect()]
        assert np.allclose(got, brute_lof(y))


def test_detectors_find_the_planted_days(spark):
    import numpy as np

    from tidemark.operators import anomaly

    rng, day = np.random.default_rng(6), dt.date(2025, 1, 1)
    rows = [("a", day + dt.timedelta(days=i), float(v)) for i, v in enumerate(rng.normal(100, 5, 60))] + [("b", day + dt.timedelta(days=i), 7.0) for i in range(10)] + [("c", day, 1.0), ("d", day, None)]
    rows[20] = ("a", rows[20][1], 400.0)
    df = spark.createDataFrame(rows, "s string, ds date, y double")
    got = {(r["s"], r["ds"]): r for r in anomaly.detect(df, key="s").collect()}
    top = got[("a", rows[20][1])]
    assert top["anomaly"] and top["severity"] == "critical" and top["score"] > 0.95 and top["detectors"].count(",") == 3
    assert not any(r["anomaly"] or r["score"] is not None for (s, _), r in got.items() if s in "bc") and len(got) == 71
    strict = {k for k, r in ((k, r) for k, r in ((x["ds"], x) for x in anomaly.detect(df.filter("s = 'a'").drop("s"), 5.0).collect())) if r["anomaly"]}
    assert rows[20][1] in strict and len(strict) <= sum(r["anomaly"] for (s, _), r in got.items() if s == "a")
    again = anomaly.detect(df, key="s").orderBy("s", "ds").collect()
    assert again == sorted(got.values(), key=lambda r: (r["s"], r["ds"]))
