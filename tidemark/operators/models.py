"""Model lifecycle as an append-only log, experiments, training and batch scoring.

The state of every version is an aggregate over the log; nothing is updated in place. Log rows:
event_id, model, version, kind (lifecycle, deployment, rollback, run), to_status, at, and for runs
metrics and params (maps), path, dataset_version and features.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.clustering import KMeans
from pyspark.ml.feature import StandardScaler, VectorAssembler
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions import ranks
from tidemark.sources.versions import VERSION, Change, Table

from . import ml, timeseries

#: Lifecycle and deployment states and the moves between them: fixed values.
MOVES = {
    "DRAFT": ("TRAINING", "VALIDATED", "FAILED", "ARCHIVED"),
    "TRAINING": ("VALIDATED", "FAILED", "ARCHIVED"),
    "VALIDATED": ("PRODUCTION", "STAGED", "FAILED", "ARCHIVED"),
    "PRODUCTION": ("ARCHIVED",),
    "STAGED": ("PRODUCTION", "ARCHIVED"),
    "FAILED": ("ARCHIVED",),
    "ARCHIVED": (),
}
DEPLOYMENT_MOVES = {"PENDING": ("STAGING", "FAILED"), "STAGING": ("SERVING", "FAILED"), "SERVING": ("RETIRED", "FAILED"), "FAILED": ("STAGING", "RETIRED"), "RETIRED": ()}
LOG = "event_id long, model string, version string, kind string, to_status string, at timestamp, note string, path string, dataset_version string, features array<string>, metrics map<string,double>, params map<string,string>"


def states(log: DataFrame) -> DataFrame:
    """(model, version, status, deployment, path, created_at, changed_at): newest lifecycle status (DRAFT without one), newest deployment status (PENDING without one) and newest path of every version in the log."""
    newest = lambda kinds, value: F.max_by(F.when(F.col("kind").isin(*kinds), F.col(value)), F.when(F.col("kind").isin(*kinds), F.col("event_id")))
    return log.groupBy("model", "version").agg(
        F.coalesce(newest(("lifecycle", "rollback"), "to_status"), F.lit("DRAFT")).alias("status"), F.coalesce(newest(("deployment",), "to_status"), F.lit("PENDING")).alias("deployment"),
        newest(("run",), "path").alias("path"), F.min("at").alias("created_at"), F.max("at").alias("changed_at"),
    )


def detail(log: DataFrame, model: str | None = None) -> DataFrame:
    """states with dataset_version, features, metrics and params, newest version first: each from the newest run of the version that names it, null where none does; nothing is guessed. Metrics whose name begins with an underscore are internal and left out."""
    mine = log if model is None else log.filter(F.col("model") == model)
    named = lambda c: F.max_by(c, F.when(c.isNotNull(), F.col("event_id")))
    runs = mine.filter("kind = 'run'").groupBy("model", "version").agg(*[named(F.col(c)).alias(c) for c in ("dataset_version", "features", "metrics", "params")])
    out = states(mine).join(runs, ["model", "version"], "left")
    return out.withColumn("metrics", F.map_filter("metrics", lambda k, _: ~k.startswith("_"))).orderBy("model", F.desc("created_at"), F.desc("version"))


def production(log: DataFrame) -> DataFrame:
    """(model, version, path) that serves each model: the one in production, else the newest that is not archived; models without either have no row."""
    live = states(log).filter("status <> 'ARCHIVED'")
    best = F.max_by(F.struct("version", "path"), F.struct((F.col("status") == "PRODUCTION").alias("p"), "created_at", "version")).alias("b")
    return live.groupBy("model").agg(best).select("model", "b.version", "b.path")


class Registry:
    """The log as a versioned table in a folder that all executors share; of two writers at once the second decides anew on what the first has left."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder
        self.table = Table(spark, f"{folder}/registry", LOG)

    def log(self, version: int | None = None) -> DataFrame:
        """Rows with event ids that grow with every commit, as of a version of the log (default: the newest)."""
        return self.table.read(version).withColumn("event_id", F.shiftleft(VERSION, 20) + F.col("event_id")).drop(VERSION)

    def _commit(self, decide: Callable[[DataFrame], list[dict]]) -> None:
        """Appends the rows that ``decide`` makes of the log; all of one call appear together, none if it makes none or raises."""
        names = [c.split()[0] for c in LOG.split(", ")]

        def plan(version: int) -> Change:
            rows = decide(self.log(version))
            if not rows:
                return Change()
            data = [tuple({"event_id": i, **r}.get(n) for n in names) for i, r in enumerate(rows, 1)]
            frame = self.spark.createDataFrame(data, LOG).withColumn("at", F.coalesce("at", F.current_timestamp()))
            return Change((self.table.stage(frame, partitions=1),))

        self.table.commit(plan)

    @staticmethod
    def _states(log: DataFrame, model: str) -> dict[str, dict]:
        found = {r["version"]: r.asDict() for r in states(log.filter(F.col("model") == model)).collect()}  # a row a version of one model
        if not found:
            raise KeyError(f"no model {model!r}")
        return found

    def create(self, model: str, path: str | None = None, metrics: dict[str, float] | None = None, params: dict[str, str] | None = None, dataset_version: str | None = None, features: list[str] | None = None) -> str:
        """A new version, v1 or one above the highest number, with its training run; VALIDATED if it has a path, else DRAFT."""
        made = ""

        def decide(log: DataFrame) -> list[dict]:
            nonlocal made
            numbers = log.filter(F.col("model") == model).select(F.expr("try_cast(regexp_extract(version, '^v([0-9]+)$', 1) as int)").alias("n"))
            made = f"v{(numbers.agg(F.max('n').alias('n')).first()['n'] or 0) + 1}"
            row = {"model": model, "version": made}
            run = row | {"kind": "run", "to_status": "done", "path": path, "metrics": metrics, "params": params, "dataset_version": dataset_version, "features": features}
            return [row | {"kind": "lifecycle", "to_status": "VALIDATED" if path else "DRAFT"}, run]

        self._commit(decide)
        return made

    def promote(self, model: str, version: str, to: str = "PRODUCTION") -> None:
        """Moves a version on. A version that enters production archives the one that serves. Staying is no move; an unknown version is a KeyError, a move that is not allowed a ValueError, and the log keeps as it is."""

        def decide(log: DataFrame) -> list[dict]:
            now = self._states(log, model)
            if version not in now:
                raise KeyError(f"no version {version!r} of {model!r}")
            if to not in MOVES:
                raise ValueError(f"unknown status {to!r}")
            at = now[version]["status"]
            if at == to:
                return []
            if to not in MOVES[at]:
                raise ValueError(f"a version in {at} cannot move to {to}")
            rows = [{"model": model, "version": version, "kind": "lifecycle", "to_status": to}]
            if to == "PRODUCTION":
                for old, s in now.items():
                    if s["status"] == "PRODUCTION":
                        rows += [{"model": model, "version": old, "kind": k, "to_status": t, "note": f"superseded by {version}"} for k, t in (("lifecycle", "ARCHIVED"), ("deployment", "RETIRED"))]
                rows.append({"model": model, "version": version, "kind": "deployment", "to_status": "SERVING"})
            return rows

        self._commit(decide)

    def deploy(self, model: str, version: str, to: str) -> None:
        def decide(log: DataFrame) -> list[dict]:
            now = self._states(log, model)
            if version not in now:
                raise KeyError(f"no version {version!r} of {model!r}")
            if to not in DEPLOYMENT_MOVES[now[version]["deployment"]]:
                raise ValueError(f"a deployment in {now[version]['deployment']} cannot move to {to}")
            return [{"model": model, "version": version, "kind": "deployment", "to_status": to}]

        self._commit(decide)

    def rollback(self, model: str) -> str:
        """Archives the version in production and restores the newest archived one, whose name is returned; ValueError where either is missing."""
        back = ""

        def decide(log: DataFrame) -> list[dict]:
            nonlocal back
            now = self._states(log, model)
            serving = next((v for v, s in now.items() if s["status"] == "PRODUCTION"), None)
            if serving is None:
                raise ValueError(f"{model!r} has no version in production")
            archived = {v: s for v, s in now.items() if s["status"] == "ARCHIVED"}
            if not archived:
                raise ValueError(f"{model!r} has no archived version to restore")
            back = max(archived, key=lambda v: (archived[v]["created_at"], v))
            rows = [(serving, "lifecycle", "ARCHIVED"), (serving, "deployment", "RETIRED"), (back, "rollback", "PRODUCTION"), (back, "deployment", "SERVING")]
            return [{"model": model, "version": v, "kind": k, "to_status": t, "note": f"rollback {serving} to {back}"} for v, k, t in rows]

        self._commit(decide)
        return back

    def load(self, model: str, strict: bool = False) -> PipelineModel | None:
        """The fitted pipeline that serves a model; None if there is none, or if it cannot be read (with ``strict``: an error)."""
        row = production(self.log().filter(F.col("model") == model)).first()
        if row is None or row["path"] is None:
            return None
        try:
            return PipelineModel.load(row["path"])
        except Exception:
            if strict:
                raise
            return None


# Experiments


def split_stratified(df: DataFrame, key: str, label: str, seed: int = 42, train: float = 0.7, validate: float = 0.15) -> DataFrame:
    """df with ``split``, in which every label has its share: its rows in the order of a hash of their keys, the first part train, the last test. A label of one row trains; null labels are a label of their own."""
    hashed = df.withColumn("_h", F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(key).cast("string"), F.lit("")))))
    ranked = ranks.running(hashed, ["_h", key], rank="_i", group=label)
    sizes = df.groupBy(F.col(label).alias("_label")).agg(F.count(F.lit(1)).alias("_n"))
    j = ranked.join(F.broadcast(sizes), F.col(label).eqNullSafe(F.col("_label")))  # a row a label
    t = F.greatest(F.lit(1), F.round(F.col("_n") * train))
    v = F.round(F.col("_n") * validate)
    return j.select(*df.columns, F.when(F.col("_i") <= t, "train").when(F.col("_i") <= t + v, "validate").otherwise("test").alias("split"))


def split(df: DataFrame, kind: str, key: str, label: str | None = None, date: str | None = None, seed: int = 42) -> tuple[DataFrame, str]:
    """(df with ``split``, strategy): too_small_to_split below 3 rows, time_aware for series, stratified for labels with 2 rows or more each, else random by a hash."""
    if len(df.select(key).limit(3).collect()) < 3:
        return df.withColumn("split", F.lit("train")), "too_small_to_split"
    if date is not None and kind in ("forecast", "anomaly"):
        ordered = ranks.running(df, [F.asc_nulls_last(date), F.col(key)], rank="_i").crossJoin(ranks.one_row(df, F.count(F.lit(1)).alias("_n")))
        t = F.greatest(F.lit(1), F.round(F.col("_n") * 0.7))
        cut = F.when(F.col("_i") <= t, "train").when(F.col("_i") <= t + F.round(F.col("_n") * 0.15), "validate").otherwise("test")
        return ordered.select(*df.columns, cut.alias("split")), "time_aware"
    if label is not None and df.groupBy(label).count().agg(F.min("count").alias("n")).first()["n"] >= 2:
        return split_stratified(df, key, label, seed), "stratified"
    return ml.split_hash(df, key, seed), "random"


def error_metrics(df: DataFrame, truth: str, guess: str, by: str = "split") -> DataFrame:
    """(split, n, mae, rmse) of a numeric guess; rows without either value are left out."""
    e = F.col(truth) - F.col(guess)
    return df.filter(e.isNotNull()).groupBy(by).agg(F.count(F.lit(1)).alias("n"), F.round(F.avg(F.abs(e)), 4).alias("mae"), F.round(F.sqrt(F.avg(e * e)), 4).alias("rmse"))


def label_metrics(df: DataFrame, truth: str, guess: str, by: str = "split") -> DataFrame:
    """(split, n, accuracy, precision, recall, f1) of a 0/1 guess."""
    t, g = F.col(truth) == 1, F.col(guess) == 1
    c = df.groupBy(by).agg(F.count(F.lit(1)).alias("n"), F.count_if(t & g).alias("tp"), F.count_if(~t & g).alias("fp"), F.count_if(t & ~g).alias("fn"))
    ratio = lambda a, b: F.when(b > 0, a / b).otherwise(0.0)
    p, r = ratio(F.col("tp"), F.col("tp") + F.col("fp")), ratio(F.col("tp"), F.col("tp") + F.col("fn"))
    return c.select(by, "n", F.round((F.col("n") - F.col("fp") - F.col("fn")) / F.col("n"), 4).alias("accuracy"), F.round(p, 4).alias("precision"), F.round(r, 4).alias("recall"), F.round(ratio(2 * p * r, p + r), 4).alias("f1"))


KINDS = ("forecast", "churn", "segmentation", "anomaly", "recommendation")


def train(registry: Registry, kind: str, name: str, frame: DataFrame, params: dict[str, str] | None = None, dataset_version: str | None = None) -> tuple[str, dict[str, float]]:
    """(version, metrics) of a model of one of KINDS, fitted on the frame, saved in the registry's folder and VALIDATED. Kinds that keep no fitted pipeline (forecast, anomaly, recommendation) save their parameters only, as a DRAFT."""
    params = dict(params or {})
    features = None
    fitted: PipelineModel | None = None
    if kind == "churn":
        features = list(ml.FEATURES)
        parted, strategy = split(frame, kind, "customer_name", "churn")
        fitted = Pipeline(stages=[VectorAssembler(inputCols=features, outputCol="features", handleInvalid="skip"), LogisticRegression(labelCol="churn", maxIter=50)]).fit(parted.filter("split = 'train'"))
        got = {r["split"]: r for r in label_metrics(fitted.transform(parted), "churn", "prediction").collect()}
        metrics = {f"{s}_{m}": float(got[s][m]) for s in got for m in ("accuracy", "f1")}
        params["split"] = strategy
    elif kind == "segmentation":
        features = list(ml.FEATURES)
        k = int(params.get("n_clusters", 4))
        fitted = Pipeline(stages=[VectorAssembler(inputCols=features, outputCol="raw", handleInvalid="skip"), StandardScaler(inputCol="raw", outputCol="features", withMean=True), KMeans(k=k, seed=42, featuresCol="features", predictionCol="cluster")]).fit(frame)
        metrics = {"n_clusters": float(k), "cost": float(fitted.stages[-1].summary.trainingCost)}
    elif kind == "forecast":
        row = timeseries.forecast(frame, int(params.get("horizon", 30))).first()
        metrics = {"n_obs": float(row["n_obs"]), "mae_baseline": float(row["mae_baseline"]), "resid_std": float(row["resid_std"])}
    elif kind == "anomaly":
        row = timeseries.outliers(frame, float(params.get("sensitivity", 2.5))).agg(F.count(F.lit(1)).alias("n"), F.count_if("anomaly").alias("k")).first()
        metrics = {"n": float(row["n"]), "n_anomalies": float(row["k"])}
    elif kind == "recommendation":
        metrics = {"n_transactions": float(frame.count())}
    else:
        raise ValueError(f"unknown kind of model {kind!r}; one of {', '.join(KINDS)}")
    path = None
    if fitted is not None:
        path = f"{registry.folder}/models/{name}-{uuid.uuid4().hex}"
        fitted.write().save(path)
    return registry.create(name, path, metrics, params | {"kind": kind}, dataset_version, features), metrics


def experiment(registry: Registry, kind: str, name: str, frame: DataFrame, params: dict[str, str] | None = None, dataset_version: str | None = None) -> dict:
    """Trains and records an experiment: name, kind, status (PLANNED without rows, FAILED with its reason, DONE), version and metrics. A failure is a result, not an exception."""
    row = {"name": name, "kind": kind, "status": "PLANNED", "version": None, "metrics": {}, "reason": "no dataset rows"}
    if frame.isEmpty():
        return row
    try:
        version, metrics = train(registry, kind, name, frame, params, dataset_version)
    except (ValueError, AnalysisException) as e:
        return row | {"status": "FAILED", "reason": str(e)[:500]}
    return row | {"status": "DONE", "version": version, "metrics": metrics, "reason": None}


# Batch scoring


def score_batch(model: PipelineModel, kind: str, frame: DataFrame, key: str = "customer_name") -> DataFrame:
    """The whole frame scored: (key, churn_proba, churn, error) or (key, segment, error). Rows with a missing feature get an error, not a score."""
    whole = F.lit(True)
    for f in ml.FEATURES:
        whole = whole & F.col(f).isNotNull()
    scored = model.transform(frame.filter(whole))
    none = F.lit(None).cast("string")
    if kind == "churn":
        from pyspark.ml.functions import vector_to_array

        p = F.round(F.get(vector_to_array("probability"), F.lit(1)), 6)
        values: list[Column] = [p.alias("churn_proba"), (F.col("prediction") == 1).alias("churn")]
        empty = [F.lit(None).cast("double").alias("churn_proba"), F.lit(None).cast("boolean").alias("churn")]
    else:
        values, empty = [F.concat(F.lit("cluster "), F.col("cluster").cast("string")).alias("segment")], [F.lit(None).cast("string").alias("segment")]
    return scored.select(key, *values, none.alias("error")).unionByName(frame.filter(~whole).select(key, *empty, F.lit("missing features").alias("error")))


def batch_summary(predictions: DataFrame, kind: str) -> DataFrame:
    """One row: n_rows, n_errors, n_scored, and for churn mean_proba and n_flagged, for anomalies n_anomalies, for segments a map of their sizes."""
    n, bad = F.count(F.lit(1)), F.count_if(F.col("error").isNotNull()) if "error" in predictions.columns else F.lit(0).cast("long")
    base = [n.alias("n_rows"), bad.alias("n_errors"), (n - bad).alias("n_scored")]
    if kind == "churn":
        return predictions.agg(*base, F.round(F.avg("churn_proba"), 4).alias("mean_proba"), F.count_if("churn").alias("n_flagged"))
    if kind == "anomaly":
        return predictions.agg(*base, F.count_if("anomaly").alias("n_anomalies"))
    row = predictions.agg(*base)
    if kind == "segmentation":
        sizes = predictions.groupBy(F.coalesce("segment", F.lit("unknown")).alias("s")).agg(n.alias("k"))
        return row.crossJoin(sizes.agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct("s", "k")))).alias("segment_distribution")))
    return row
