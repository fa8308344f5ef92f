"""Four anomaly detectors over daily series, and their combined score.

Deviations and fences are aggregates, local outlier factors are window expressions over the values
in order; only the isolation forest is Python, a series in a task, as a series has a row a day.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import timeseries

#: Trees and rows a tree of the forest, neighbours of the outlier factor, and weights of the scores: fixed values.
TREES, SAMPLE, NEIGHBOURS = 100, 256, 5
WEIGHTS = {"deviation": 0.5, "forest": 0.3, "lof": 0.2}


def local_outlier_factor(series: DataFrame, key: str | None = None, k: int = NEIGHBOURS) -> DataFrame:
    """series ([key,] ds, y) with ``lof``: the mean density around the k values nearest to y over the density around y; ties by place in the order of y and ds. At most n - 1 neighbours; a series of one row has none and gets null."""
    w = Window.partitionBy(*([key] if key else [])).orderBy("y", "ds")
    offsets = [*range(-k, 0), *range(1, k + 1)]
    near = lambda column: [F.lag(column, -o).over(w) for o in offsets]
    rows = series.select("*", F.array(*near("y")).alias("_y"))
    apart = F.array(*[F.struct(F.abs(F.get("_y", F.lit(i)) - F.col("y")).alias("d"), F.lit(i).alias("i")) for i in range(2 * k)])
    rows = rows.withColumn("_near", F.slice(F.sort_array(F.filter(apart, lambda x: x["d"].isNotNull())), 1, k)).drop("_y")
    rows = rows.withColumn("_kd", F.array_max(F.transform("_near", lambda x: x["d"])))
    mean = lambda a: F.aggregate(a, F.lit(0.0), lambda s, x: s + x) / F.size(a)
    reach = F.transform("_near", lambda x: F.greatest(x["d"], F.get("_kds", x["i"])))
    rows = rows.withColumn("_kds", F.array(*near("_kd"))).withColumn("_lrd", F.when(F.size("_near") > 0, 1 / (mean(reach) + 1e-10))).drop("_kds", "_kd")
    rows = rows.withColumn("_lrds", F.array(*near("_lrd")))
    return rows.withColumn("lof", mean(F.transform("_near", lambda x: F.get("_lrds", x["i"]))) / F.col("_lrd")).drop("_near", "_lrd", "_lrds")


def _usual_depth(n: int) -> float:
    return 2.0 * (np.log(n - 1.0) + np.euler_gamma) - 2.0 * (n - 1.0) / n if n > 2 else float(n == 2)


def forest_scores(y: np.ndarray, seed: int = 42) -> np.ndarray:
    """Isolation scores of values in (0, 1]: 2 to the minus mean depth at which random cuts isolate a value, over the usual depth. Same values, same scores."""
    rng, n = np.random.default_rng(seed), len(y)
    size = min(SAMPLE, n)
    most = int(np.ceil(np.log2(max(size, 2))))
    depths = np.zeros(n)
    for _ in range(TREES):
        stack = [(np.sort(rng.choice(y, size, replace=False)), np.arange(n), 0)]
        while stack:
            sample, rows, depth = stack.pop()
            if not len(rows):
                continue
            if depth >= most or len(sample) <= 1 or sample[0] == sample[-1]:
                depths[rows] += depth + _usual_depth(len(sample))
                continue
            cut = rng.uniform(sample[0], sample[-1])
            left, at = y[rows] <= cut, np.searchsorted(sample, cut, side="right")
            stack += [(sample[:at], rows[left], depth + 1), (sample[at:], rows[~left], depth + 1)]
    return 2.0 ** (-depths / TREES / max(_usual_depth(size), 1e-9))


def detect(series: DataFrame, sensitivity: float = 2.5, key: str | None = None) -> DataFrame:
    """[key,] ds, y, z, iqr_flag, forest and lof (each over its span, 0 to 1), score, anomaly, severity, detectors.

    The score is .5 x deviation + .3 x forest + .2 x factor. A day is an anomaly if its deviation is
    over the sensitivity, if it is among the forest's most isolated (5 days, 2 to 15 per cent of
    them, scaled by the sensitivity), or if its score is over .65. Series of less than 6 days have no
    factor; those without variance, or of one day, are not scored: null scores and no anomaly.
    """
    keys = [key] if key else []
    usable = series.filter("y is not null and ds is not null").select(*keys, "ds", "y")
    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in usable.schema.fields)
    deviation = timeseries.outliers(usable, sensitivity, key).select(*keys, "ds", "z", "iqr_flag")
    names = usable.columns

    def isolated(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values("ds")
        y = part["y"].to_numpy(float)
        return part[names].assign(forest=forest_scores(y) if len(y) > 1 else np.zeros(len(y)))

    forest = usable.groupBy(*keys).applyInPandas(isolated, f"{kinds}, forest double")
    whole = forest.join(local_outlier_factor(usable, key).select(*keys, "ds", "lof"), [*keys, "ds"]).join(deviation, [*keys, "ds"])
    m = whole.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("_n"), F.min("forest").alias("_f0"), F.max("forest").alias("_f1"), F.min("lof").alias("_l0"), F.max("lof").alias("_l1"), F.stddev_pop("y").alias("_s"), F.max(F.abs("y")).alias("_top")
    )
    j = whole.join(m, keys) if keys else whole.crossJoin(F.broadcast(m))
    span = lambda c, lo, hi: F.when(F.col(hi) > F.col(lo), (F.col(c) - F.col(lo)) / (F.col(hi) - F.col(lo) + 1e-9)).otherwise(0.0)
    share = F.least(F.lit(0.5), F.greatest(F.lit(0.005), F.least(F.lit(0.15), F.greatest(F.lit(0.02), 5 / F.col("_n"))) * (2.5 / sensitivity)))
    place = F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc("forest"), "ds"))
    scored: Column = (F.col("_n") > 1) & (F.col("_s") > 1e-9 * F.greatest(F.col("_top"), F.lit(1e-300)))
    j = j.select("*", span("forest", "_f0", "_f1").alias("_f"), F.when(F.col("_n") >= 6, span("lof", "_l0", "_l1")).otherwise(0.0).alias("_l"), (place <= F.round(share * F.col("_n"))).alias("_isolated"), scored.alias("_scored"))
    raw = WEIGHTS["deviation"] * F.least(F.lit(1.0), F.abs("z") / (sensitivity + 1.5)) + WEIGHTS["forest"] * F.col("_f") + WEIGHTS["lof"] * F.col("_l")
    flag = F.col("_scored") & ((F.abs("z") > sensitivity) | F.col("_isolated") | (raw > 0.65))
    given = lambda c, n=4: F.when(F.col("_scored"), F.round(c, n))
    used = F.when(~F.col("_scored"), "none").when(F.col("_n") >= 6, "zscore,iqr,isolation_forest,lof").otherwise("zscore,iqr,isolation_forest")
    return j.select(
        *keys, "ds", "y", given(F.col("z")).alias("z"), (F.col("_scored") & F.col("iqr_flag")).alias("iqr_flag"), given(F.col("_f")).alias("forest"), given(F.col("_l")).alias("lof"), given(raw).alias("score"), flag.alias("anomaly"), timeseries.severity(raw, flag).alias("severity"),
        used.alias("detectors"),
    )
