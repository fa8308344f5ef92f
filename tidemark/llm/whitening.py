"""Embedding whitening by matrix-free block subspace iteration.

Entries become whole numbers, so means and deviations are exact. Each pass over the rows computes
Y'(YQ) for centred rows Y and a block Q of a few columns; the driver holds only blocks of that
shape, never the covariance matrix or any row. After QR and Rayleigh-Ritz the residuals of the k
leading pairs decide whether another pass is needed.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import saved

SCALE, SHIFT, EDGE = 64, 1_000_000, float(1 << 52)
LONG_MAX = (1 << 63) - 1
#: Bytes of rows that a task of a pass reads at least, as it hands on a whole matrix.
TASK_BYTES = 8 << 20


@dataclass(frozen=True)
class Whitening:
    """``sums`` and ``n`` of the fit list, ``vectors`` (width x k, unit columns) and their ``values``, the ``trace`` of the covariance, and the largest entry of the whitened rows' covariance minus the identity."""

    n: int
    sums: tuple[int, ...]
    vectors: np.ndarray
    values: np.ndarray
    trace: float
    identity_error: float
    passes: int

    def centred(self, x: np.ndarray) -> np.ndarray:
        return centred(x, self.n, self.sums)


def integer_rows(vectors: DataFrame, embedding: str, kept: list[str]) -> DataFrame:
    """``x``, array<long> floor(64 * entry) + 1000000, beside the ``kept`` columns, for the rows whose vector is not null and has only finite entries."""
    value = F.col(embedding).cast("array<double>")
    finite = F.forall(value, lambda e: e.isNotNull() & ~F.isnan(e) & (F.abs(e) < F.lit(float("inf"))))
    whole = lambda e: F.floor(F.greatest(F.least(e * SCALE, F.lit(EDGE)), F.lit(-EDGE))).cast("long") + SHIFT
    return vectors.filter(value.isNotNull() & finite).select(*kept, F.transform(value, whole).alias("x"))


def _matrix(column: pa.Array) -> np.ndarray:
    width = len(column[0].values)
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), width)


def _divided(n: int, sums: tuple[int, ...]) -> tuple[np.ndarray, np.ndarray]:
    return np.array([s // n for s in sums], np.int64), np.array([s % n for s in sums], np.int64)


def centred(x: np.ndarray, n: int, sums: tuple[int, ...]) -> np.ndarray:
    """x - sums / n, subtracted as whole numbers first, so nothing is lost to the size of the mean."""
    whole, rest = _divided(n, sums)
    return (x - whole) - rest / n


def deviations(x: np.ndarray, n: int, sums: tuple[int, ...]) -> list[int | None]:
    """Exact sum over dimensions of (n * x - sums) ** 2 for each row; null where it does not fit a long."""
    whole, rest = _divided(n, sums)
    off = x - whole
    if (int(np.abs(off).max(initial=0)) + 1) ** 2 * n * n * x.shape[1] < LONG_MAX:
        return ((n * off - rest) ** 2).sum(axis=1).tolist()
    exact = ((off.astype(object) * n - rest.astype(object)) ** 2).sum(axis=1)
    return [v if v <= LONG_MAX else None for v in exact.tolist()]


Partial = Callable[[np.ndarray], np.ndarray]
ENTRIES = "i int, j int, v double"


def _partials(batches: Iterator[pa.RecordBatch], body: Partial) -> Iterator[pa.RecordBatch]:
    """One matrix a task: the sum of ``body(x)`` over its batches of rows, as entries."""
    total = None
    for b in batches:
        if b.num_rows:
            part = body(_matrix(b.column("x")))
            total = part if total is None else total + part
    if total is not None:
        i, j = np.indices(total.shape, np.int32)
        yield pa.RecordBatch.from_arrays([pa.array(i.ravel()), pa.array(j.ravel()), pa.array(total.ravel())], ["i", "j", "v"])


def _summed(fit: DataFrame, body: Partial, shape: tuple[int, int]) -> np.ndarray:
    """The sum of ``body(x)`` over all rows of the fit list: a matrix a task, added up by entry before the driver sees it."""
    entries = fit.mapInArrow(partial(_partials, body=body), ENTRIES).groupBy("i", "j").agg(F.sum("v").alias("v"))
    out = np.zeros(shape)
    for r in entries.toLocalIterator():
        out[r["i"], r["j"]] = r["v"]
    return out


def _exact_sums(fit: DataFrame) -> tuple[int, tuple[int, ...]]:
    """Rows of the fit list and the exact sum of each dimension."""
    n = fit.count()
    cells = fit.select(F.posexplode("x").alias("i", "v")).groupBy("i").agg(F.sum(F.col("v").cast("decimal(20,0)")).alias("s")).orderBy("i").collect()  # a row a dimension
    return n, tuple(int(r["s"]) for r in cells)


def fit(rows: DataFrame, k: int = 16, block: int = 64, tolerance: float = 1e-13, most_passes: int = 500) -> Whitening | None:
    """The k leading components of the distinct rows of ``x``; fewer where the rows have fewer dimensions with any variance, none (None) for no rows.

    ``block`` columns are iterated (all dimensions, if there are fewer). A pair (value, vector) counts as
    found when |V vector - value * vector| is at most ``tolerance`` times the largest value; if some
    pair is not found after ``most_passes`` passes the result would be wrong, so an error is raised.
    """
    points = saved(rows.select("x").distinct())
    n, sums = _exact_sums(points)
    d = len(sums)
    if not n or not d:
        return None
    width = min(d, max(block, k))
    points = points.coalesce(max(1, 8 * n * d // TASK_BYTES))
    middle = partial(centred, n=n, sums=sums)
    trace = float(_summed(points, lambda x: np.array([[(middle(x) ** 2).sum()]]), (1, 1))[0, 0]) / n
    if not trace:
        return Whitening(n, sums, np.zeros((d, 0)), np.zeros(0), 0.0, 0.0, 0)
    q = np.linalg.qr(np.random.default_rng(7).standard_normal((d, width)))[0]
    for passes in range(1, most_passes + 1):
        z = _summed(points, lambda x, q=q: (y := middle(x)).T @ (y @ q), (d, width)) / n
        inner = q.T @ z
        values, turn = np.linalg.eigh((inner + inner.T) / 2)
        values, turn = values[::-1], turn[:, ::-1]
        vectors, images = q @ turn, z @ turn  # Ritz vectors and, without another pass, the covariance times them
        kept = values[:k] > 1e-12 * values[0]
        lead = vectors[:, :k][:, kept]
        off = np.linalg.norm(images[:, :k][:, kept] - lead * values[:k][kept], axis=0).max()
        if off <= tolerance * values[0]:
            break
        q = np.linalg.qr(images)[0]
    else:
        raise RuntimeError(f"residual {off / values[0]:.1e} after {most_passes} passes; a larger block converges faster")
    lead /= np.linalg.norm(lead, axis=0)
    values = values[:k][kept]
    scaled = lead / np.sqrt(values)
    moments = _summed(points, lambda x: np.vstack([(w := middle(x) @ scaled).T @ w, w.sum(axis=0)[None]]), (len(values) + 1, len(values))) / n
    mean = moments[-1]
    error = float(np.abs(moments[:-1] - np.outer(mean, mean) - np.eye(len(values))).max())
    return Whitening(n, sums, lead, values, trace, error, passes)


def _transformed(batches: Iterator[pa.RecordBatch], model: Whitening) -> Iterator[pa.RecordBatch]:
    scaled = model.vectors / np.sqrt(model.values)
    for b in batches:
        if b.num_rows:
            x = _matrix(b.column("x"))
            w = model.centred(x) @ scaled
            parts = [b.column(c) for c in b.schema.names if c != "x"]
            names = [c for c in b.schema.names if c != "x"]
            spans = np.arange(len(w) + 1, dtype=np.int32) * w.shape[1]
            whitened = pa.ListArray.from_arrays(pa.array(spans), pa.array(w.ravel()))
            yield pa.RecordBatch.from_arrays([*parts, pa.array(deviations(x, model.n, model.sums), pa.int64()), whitened], [*names, "deviation", "whitened"])


def common_width(rows: DataFrame) -> DataFrame:
    """The rows whose ``x`` has the most common width; of equally common ones the largest. Empty vectors count as none."""
    widths = rows.groupBy(F.size("x").alias("width")).agg(F.count(F.lit(1)).alias("n")).filter("width > 0")
    top = widths.orderBy(F.desc("n"), F.desc("width")).first()
    return rows.filter(F.size("x") == (top["width"] if top else -1))


def whiten(vectors: DataFrame, k: int = 16, block: int = 64, key: str = "vec_id", embedding: str = "embedding") -> DataFrame:
    """For each row with a usable vector and each component: ``vec_id``, ``component`` (from 1), ``n`` (distinct vectors), ``deviation``, ``whitened``, ``explained`` (share of the variance), ``identity_error``.

    Rows whose vector is null, empty, holds a null or an entry that is not finite, or has another width
    than the most common one are left out. Entries beyond 2 ** 46 count as 2 ** 46. Equal vectors count once in the fit and all have
    rows in the result, null keys too. Directions without variance are no components: a table of one
    distinct vector gives no rows, and neither does an empty one. Other columns are not used.
    """
    rows = common_width(integer_rows(vectors, embedding, [F.col(key).cast("long").alias("vec_id")]))
    model = fit(rows, k, block)
    spark = vectors.sparkSession
    if model is None or not len(model.values):
        return spark.createDataFrame([], "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double")
    got = rows.mapInArrow(partial(_transformed, model=model), "vec_id long, deviation long, whitened array<double>")
    shares = F.array(*[F.lit(float(v) / model.trace) for v in model.values])
    long = got.select("vec_id", "deviation", F.posexplode("whitened").alias("at", "value"))
    return long.select(
        "vec_id", (F.col("at") + 1).alias("component"), F.lit(model.n).cast("long").alias("n"), "deviation",
        F.col("value").alias("whitened"), F.get(shares, F.col("at")).alias("explained"), F.lit(model.identity_error).alias("identity_error"),
    )
