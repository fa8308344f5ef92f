"""MLlib pipelines: customer segments, churn models, boosted forecasts, splits and metrics."""

from __future__ import annotations

from pyspark.ml import Pipeline
from pyspark.ml.classification import LogisticRegression, RandomForestClassifier
from pyspark.ml.clustering import KMeans
from pyspark.ml.evaluation import ClusteringEvaluator
from pyspark.ml.feature import StandardScaler, VectorAssembler
from pyspark.ml.regression import GBTRegressor
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions import ranks

FEATURES = ("total_orders", "total_spending", "recency", "frequency", "monetary", "aov", "tenure")
#: Names of segments from the highest spending to the lowest: fixed values.
NAMES = ("high_value", "loyal", "regular", "low_value")


def segments(customers: DataFrame, k: int = 4, seed: int = 42) -> tuple[DataFrame, float | None]:
    """(customer_name, cluster, segment) and the silhouette. Features without variance are left out; k is at most the number of distinct profiles; fewer than 2 of them give one segment and None."""
    stats = customers.agg(*[F.count_distinct(f).alias(f) for f in FEATURES]).first()
    used = [f for f in FEATURES if stats[f] > 1]
    distinct = customers.select(*used).distinct().limit(k).count() if used else 0
    if distinct < 2:
        return customers.select("customer_name", F.lit(0).alias("cluster"), F.lit("all").alias("segment")), None
    pipe = Pipeline(stages=[VectorAssembler(inputCols=used, outputCol="raw"), StandardScaler(inputCol="raw", outputCol="features", withMean=True), KMeans(k=min(k, distinct), seed=seed, featuresCol="features", predictionCol="cluster")])
    got = pipe.fit(customers).transform(customers)
    by_money = got.groupBy("cluster").agg(F.avg("monetary").alias("m")).select("cluster", F.row_number().over(Window.orderBy(F.desc("m"))).alias("place"))
    label = F.get(F.array(*[F.lit(n) for n in NAMES]), F.least(F.col("place") - 1, F.lit(len(NAMES) - 1)))
    score = ClusteringEvaluator(featuresCol="features", predictionCol="cluster").evaluate(got)
    return got.join(F.broadcast(by_money), "cluster").select("customer_name", "cluster", label.alias("segment")), score


def confusion(df: DataFrame, truth: str, guess: str) -> DataFrame:
    """One row: n, accuracy, precision, recall, f1 of a 0/1 guess."""
    t, g = F.col(truth) == 1, F.col(guess) == 1
    c = df.agg(F.count(F.lit(1)).alias("n"), F.count_if(t & g).alias("tp"), F.count_if(~t & g).alias("fp"), F.count_if(t & ~g).alias("fn"))
    p = F.when(F.col("tp") + F.col("fp") > 0, F.col("tp") / (F.col("tp") + F.col("fp"))).otherwise(0.0)
    r = F.when(F.col("tp") + F.col("fn") > 0, F.col("tp") / (F.col("tp") + F.col("fn"))).otherwise(0.0)
    f1 = F.when(p + r > 0, 2 * p * r / (p + r)).otherwise(0.0)
    return c.select("n", F.round(F.try_divide(F.col("n") - F.col("fp") - F.col("fn"), F.col("n")), 4).alias("accuracy"), F.round(p, 4).alias("precision"), F.round(r, 4).alias("recall"), F.round(f1, 4).alias("f1"))


def churn_scores(features: DataFrame, seed: int = 42) -> tuple[DataFrame, str]:
    """(customer_name, probability, error) and the model's name: of logistic regression and random forest the one of better F1 on a held-out fifth. One class only: its base rate. Rows with missing features get an error, not a score."""
    whole = features
    for f in FEATURES:
        whole = whole.filter(F.col(f).isNotNull())
    rate = whole.agg(F.avg("churn").alias("r"), F.count_distinct("churn").alias("k")).first()
    incomplete = features.join(whole.select("customer_name"), "customer_name", "left_anti").select("customer_name", F.lit(None).cast("double").alias("probability"), F.lit("missing features").alias("error"))
    if (rate["k"] or 0) < 2:
        return whole.select("customer_name", F.lit(rate["r"]).cast("double").alias("probability"), F.lit(None).cast("string").alias("error")).unionByName(incomplete), "constant"
    split = split_hash(whole, "customer_name", seed)
    train, test = split.filter("split <> 'test'"), split.filter("split = 'test'")
    assembler = VectorAssembler(inputCols=list(FEATURES), outputCol="features")
    best = None
    for name, model in (("logistic_regression", LogisticRegression(labelCol="churn", maxIter=50)), ("random_forest", RandomForestClassifier(labelCol="churn", numTrees=50, seed=seed))):
        fitted = Pipeline(stages=[assembler, model]).fit(train)
        f1 = confusion(fitted.transform(test), "churn", "prediction").first()["f1"] or 0.0
        if best is None or f1 > best[0]:
            best = (f1, name, fitted)
    from pyspark.ml.functions import vector_to_array

    got = best[2].transform(whole).select("customer_name", F.round(F.get(vector_to_array("probability"), F.lit(1)), 6).alias("probability"), F.lit(None).cast("string").alias("error"))
    return got.unionByName(incomplete), best[1]


def split_hash(df: DataFrame, key: str, seed: int = 42, train: float = 0.7, validate: float = 0.15) -> DataFrame:
    """df with ``split``: train, validate or test by a hash of the key; the same key always lands in the same part."""
    u = F.pmod(F.xxhash64(key, F.lit(seed)), F.lit(10_000)) / 10_000
    return df.withColumn("split", F.when(u < train, "train").when(u < train + validate, "validate").otherwise("test"))


def split_by_time(series: DataFrame, train: float = 0.7, validate: float = 0.15) -> DataFrame:
    """A series (ds, y) with ``split``: the first rows train, the last test; fewer than 3 rows all train."""
    n = F.count(F.lit(1)).over(Window.partitionBy())
    i = F.row_number().over(Window.orderBy(F.asc_nulls_last("ds")))
    t = F.greatest(F.lit(1), F.round(n * train).cast("int"))
    v = F.round(n * validate).cast("int")
    return series.withColumn("split", F.when(n < 3, "train").when(i <= t, "train").when(i <= t + v, "validate").otherwise("test"))


def gbt_forecast(series: DataFrame, horizon: int = 14, seed: int = 42) -> DataFrame:
    """(ds, yhat): boosted trees over calendar and lag features, one step after another; needs 14 days, else no rows.

    The series is one row a day; each step scores one row, whose lags come from the days before it. It is
    saved, as training reads it again and again.
    """
    from .timeseries import features

    series = ranks.saved(series)
    if series.limit(14).count() < 14:
        return series.sparkSession.createDataFrame([], "ds date, yhat double")
    cols = ["dow", "month", "day", "is_weekend", "lag_1", "lag_7", "lag_14"]
    model = Pipeline(stages=[VectorAssembler(inputCols=cols, outputCol="features"), GBTRegressor(labelCol="y", maxIter=20, maxDepth=4, seed=seed)]).fit(features(series))
    trees = model.stages[-1]
    from pyspark.ml.linalg import Vectors
    import datetime as dt

    tail = [(r["ds"], r["y"]) for r in series.orderBy(F.desc("ds")).limit(14).collect()][::-1]
    for _ in range(horizon):
        day = tail[-1][0] + dt.timedelta(days=1)
        y = [v for _, v in tail]
        x = Vectors.dense([day.weekday(), day.month, day.day, float(day.weekday() >= 5), y[-1], y[-7], y[-14]])
        tail.append((day, max(0.0, float(trees.predict(x)))))
    return series.sparkSession.createDataFrame(tail[14:], "ds date, yhat double")
