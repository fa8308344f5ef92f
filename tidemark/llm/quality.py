"""Quality classifier: ordinal cumulative-link regression on graded ratings.

P(grade <= j) is logistic in threshold_j - w.x: all grades share the weights of hashed words and a
few shape features, and the thresholds are ordered. The expected grade ranks documents and a tail
probability selects them. Weights are fitted with FTRL-Proximal to the likelihood of the grades on a
bounded sample of rated documents; every whole text is scored where it lies.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import row_key
from .ngram_lr import Ftrl

DIMS = 1 << 17
PUNCTUATION = "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"
#: Shape features after the hashed words: shares of words in capitals, with a run of marks, with digits, without letters; mean word length / 10; log length / 10; constant.
SHAPES = 7


@lru_cache(maxsize=200_000)
def _word(word: str) -> tuple[int, int]:
    """(bucket, shape bits) of a word."""
    core = word.strip(PUNCTUATION)
    marks = len(word) - len(core) >= 2
    bits = (core.isupper() and len(core) > 1) | marks << 1 | any(c.isdigit() for c in core) << 2 | (not any(c.isalpha() for c in core)) << 3
    return zlib.crc32(core.lower().encode("utf-8", "surrogatepass")) % DIMS, int(bits)


def features(text: str | None) -> tuple[np.ndarray, np.ndarray]:
    """(distinct indices, values): each distinct word's bucket once, whatever the text's length, and the shapes."""
    words = (text or "").split()
    seen: dict[str, int] = {}
    for w in words:
        seen[w] = seen.get(w, 0) + 1
    found, shape = set(), [0, 0, 0, 0]
    for w, n in seen.items():
        bucket, bits = _word(w)
        found.add(bucket)
        for i in range(4):
            if bits >> i & 1:
                shape[i] += n
    total = len(words) or 1
    dense = [*(s / total for s in shape), min(3.0, sum(map(len, words)) / total / 10), np.log1p(len(words)) / 10, 1.0]
    at = np.fromiter(sorted(found), np.int64, len(found))
    return np.concatenate((at, np.arange(DIMS, DIMS + SHAPES))), np.concatenate((np.ones(len(at)), dense))


def _sigmoid(x):
    return 1.0 / (1.0 + np.exp(-np.clip(x, -40, 40)))


@dataclass
class QualityModel:
    weights: np.ndarray
    thresholds: np.ndarray

    def tails(self, text: str | None) -> np.ndarray:
        """P(grade > j) for each threshold j."""
        at, v = features(text)
        return _sigmoid(v @ self.weights[at] - self.thresholds)


def cumulative_link(s: float, cuts: np.ndarray, y: int) -> tuple[float, float, np.ndarray]:
    """(loss, its derivative by s, its derivatives by the cuts) of -log(F(cuts[y] - s) - F(cuts[y - 1] - s)) with logistic F; the outermost cuts are infinite."""
    upper = _sigmoid(cuts[y] - s) if y < len(cuts) else 1.0
    lower = _sigmoid(cuts[y - 1] - s) if y else 0.0
    p = max(upper - lower, 1e-12)
    by_cut = np.zeros(len(cuts))
    if y < len(cuts):
        by_cut[y] = -upper * (1 - upper) / p
    if y:
        by_cut[y - 1] = lower * (1 - lower) / p
    return -float(np.log(p)), 1.0 - upper - lower, by_cut


def _cuts(shape: np.ndarray) -> np.ndarray:
    """Ordered thresholds from free parameters: the first cut and the logarithms of the gaps."""
    return np.cumsum(np.concatenate((shape[:1], np.exp(shape[1:]))))


def fit_sample(sample: list[tuple[str, int]], grades: int, epochs: int = 10, alpha: float = 1.0, beta: float = 1.0, l1_rate: float = 1 / 100, l2: float = 0.01, seed: int = 7) -> QualityModel:
    """The model of (text, grade) rows by the cumulative-link likelihood; same rows, same model, in any order.

    The L1 penalty is ``l1_rate`` for each row, so that words without a steady effect weigh nothing
    and long texts do not add up noise. Grades weigh alike, however many rows each has; repeated
    rows count as often as they occur. No rows: every tail is one half.
    """
    model = QualityModel(np.zeros(DIMS + SHAPES), np.zeros(grades - 1))
    rows = [(features(t), y) for t, y in sorted(sample, key=lambda r: (r[0] or "", r[1]))]
    if not rows:
        return model
    counts = np.bincount([y for _, y in rows], minlength=grades)
    weight = np.where(counts > 0, len(rows) / np.maximum(counts, 1) / (counts > 0).sum(), 0.0)
    seen = np.zeros(DIMS + SHAPES, np.int64)
    for (at, _), _ in rows:
        seen[at] += 1
    common = seen >= max(3, len(rows) // 1000)  # rarer words tell nothing about other documents
    rows = [((at[common[at]], v[common[at]]), y) for (at, v), y in rows]
    learner = Ftrl(DIMS + SHAPES, 1, alpha, beta, max(0.5, l1_rate * len(rows)), l2)
    shape, past = np.concatenate(([-1.0 if grades > 2 else 0.0], np.zeros(grades - 2))), np.ones(grades - 1)
    rng = np.random.default_rng(seed)
    for _ in range(epochs):
        for i in rng.permutation(len(rows)):
            (at, v), y = rows[i]
            w = learner.weights(at)
            cuts = _cuts(shape)
            _, by_s, by_cut = cumulative_link(float(v @ w[:, 0]), cuts, y)
            learner.step(at, w, (v * (by_s * weight[y]))[:, None])
            # A cut moves all later ones; a gap's logarithm moves those from its end on.
            tail = np.cumsum(by_cut[::-1])[::-1] * weight[y]
            step = tail * np.concatenate(([1.0], np.diff(cuts)))
            past += step * step
            shape = np.clip(shape - 0.5 * step / np.sqrt(past), -20, 20)
    model.weights, model.thresholds = learner.weights()[:, 0], _cuts(shape)
    return model


def train(docs: DataFrame, ratings: DataFrame, grades: int, max_docs: int = 9000, max_chars: int = 20_000, doc_id: str = "doc_id", text: str = "text") -> QualityModel:
    """Learns from the texts of ``docs`` and ``ratings`` (doc_id, grade), grade 0 to grades - 1; other ratings and rows without an id are ignored.

    The sample is about ``max_docs`` ratings (twice that at most), in equal parts by grade as far as
    there are any, chosen by a hash of the id; those whose text is longer than ``max_chars``
    characters are left out. Only the sample's ids are broadcast, so no other text is shuffled.
    Repeated ratings count once; of several texts under one id the least counts. Reruns agree.
    """
    rows = ratings.select(F.col(doc_id).alias("id"), "grade").filter(F.col("grade").between(0, grades - 1) & F.col(doc_id).isNotNull())
    sizes = {r["grade"]: r["n"] for r in rows.groupBy("grade").agg(F.count(F.lit(1)).alias("n")).collect()}
    part = F.coalesce(*[F.when(F.col("grade") == g, F.lit(min(1.0, max_docs / grades / n))) for g, n in sizes.items()], F.lit(0.0)) if sizes else F.lit(0.0)
    even = F.pmod(F.xxhash64("id", F.lit("sample")), F.lit(1_000_003)) / F.lit(1_000_003.0)
    chosen = rows.filter(even < part).distinct().orderBy(even, "id", "grade").limit(2 * max_docs)
    texts = docs.select(F.col(doc_id).alias("id"), F.col(text).cast("string").alias("text")).filter(F.length("text") <= max_chars)
    sample = texts.join(F.broadcast(chosen), "id").groupBy("id", "grade").agg(F.min("text").alias("text")).select("text", "grade").collect()
    return fit_sample([(r["text"], r["grade"]) for r in sample], grades)


def score(docs: DataFrame, model: QualityModel, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """td_known, td_id, td_hash (each row's key), ``expected_grade`` and ``tails``, array of P(grade > j).

    Only the text is used, so other columns may have any name. Null and empty texts are scored as
    texts without words. Rows are neither dropped nor merged: equal texts score alike, repeated rows
    return repeated rows.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)  # a fixed number of weights

    def predict(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            got = [shared.value.tails(t) for t in b.pop("text")]
            yield b.assign(expected_grade=[float(g.sum()) for g in got], tails=[g.tolist() for g in got])

    rows = docs.select(*row_key(doc_id, text), F.col(text).cast("string").alias("text"))
    return rows.mapInPandas(predict, "td_known boolean, td_id long, td_hash long, expected_grade double, tails array<double>")


def rating(quality: Column, toxic: Column) -> Column:
    """Grade of a rated document: 0 toxic, 1 clean but poor, 2 clean and good; null where a rating is missing."""
    return F.when(toxic == 1, 0).when((toxic == 0) & (quality == 0), 1).when((toxic == 0) & (quality == 1), 2)
