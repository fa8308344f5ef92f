"""Language ID: sparse multinomial logistic regression on TF-IDF character n-grams.

Document frequencies are counted over every training document. The classifier is fitted with
FTRL-Proximal under an elastic net on a bounded sample of labelled rows, and its scores are
calibrated by one temperature on a part of the sample that training does not see. Every whole text
is scored where it lies; nothing shuffles but the counts of n-gram buckets.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import packed, row_key, unpacked
from .ngram_lr import Ftrl, softmax, temperature

UNKNOWN = "und"
#: Characters hashed at a time.
SLAB = 1 << 18
#: Part of the training documents in which an n-gram counts as common, n-grams of a text from which its share of common ones is steady, and how far that may lie below the hundredth part of the texts with the lowest.
COMMON, LONG, SLACK = 0.02, 600, 0.05


@cache
def _letters() -> np.ndarray:
    return np.fromiter((chr(c).isalpha() for c in range(0x110000)), np.bool_, 0x110000)


def gram_counts(text: str | None, dims: int, orders: int = 3) -> tuple[np.ndarray, np.ndarray] | None:
    """(buckets, counts) of the character 1- to n-grams of the letters of a text, lower-cased, one space between words; None without letters."""
    c = np.frombuffer((text or "").lower().encode("utf-32-le", "surrogatepass"), np.uint32)
    letter = _letters()[c]
    if not letter.any():
        return None
    before = np.concatenate(([True], letter[:-1]))
    c = np.where(letter, c, 32)[letter | before].astype(np.uint64)
    c = np.concatenate(([np.uint64(32)], c, [np.uint64(32)]))
    total = np.zeros(dims, np.int64)
    shift = np.uint64(64 - (dims - 1).bit_length())
    for n in range(1, orders + 1):
        for at in range(0, len(c) - n + 1, SLAB):
            part = c[at : at + SLAB + n - 1]
            h = np.full(len(part) - n + 1, n, np.uint64)
            for i in range(n):
                h = h * np.uint64(0x100000001B3) + part[i : i + len(h)]
            total += np.bincount(((h * np.uint64(0x9E3779B97F4A7C15)) >> shift).astype(np.int64), minlength=dims)
    at = np.flatnonzero(total)
    return at, total[at]


def document_frequencies(texts: DataFrame, dims: int) -> tuple[int, np.ndarray]:
    """(documents, documents by bucket) over all rows of ``texts`` (text); summed by task before the shuffle, ``dims`` + 1 rows reach the driver."""

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        df, n = np.zeros(dims, np.int64), 0
        for b in batches:
            for t in b["text"]:
                n += 1
                if found := gram_counts(t, dims):
                    df[found[0]] += 1
        at = np.flatnonzero(df)
        yield pd.DataFrame({"bucket": np.append(at, -1), "n": np.append(df[at], n)})

    rows = texts.select("text").mapInPandas(count, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n")).collect()
    out = np.zeros(dims, np.int64)
    for r in rows:
        if r["bucket"] >= 0:
            out[r["bucket"]] = r["n"]
    return next((r["n"] for r in rows if r["bucket"] == -1), 0), out


@dataclass
class LanguageModel:
    labels: list[str]
    idf: np.ndarray
    weights: np.ndarray
    bias: np.ndarray
    heat: float = 1.0
    common: np.ndarray | None = None
    usual: float = 0.0

    def vector(self, found: tuple[np.ndarray, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        """(buckets, TF-IDF values of length 1) of the result of gram_counts."""
        v = np.log1p(found[1]) * self.idf[found[0]]
        return found[0], v / (np.sqrt(v @ v) or 1.0)

    def learned(self, found: tuple[np.ndarray, np.ndarray]) -> bool:
        """Whether a text could be in a language that the model has seen: the share of its n-grams that are common among training texts is not far below what is usual there, chance in short texts allowed for. Any number of labels gives the same answer."""
        n = found[1].sum()
        share = found[1][self.common[found[0]]].sum() / n
        chance = np.sqrt(self.usual * (1 - self.usual) / n)
        return bool(share + 4 * chance >= self.usual - SLACK)

    def predict(self, text: str | None) -> tuple[str, float, bool]:
        """(label, calibrated probability, learned)."""
        found = gram_counts(text, len(self.idf)) if self.labels else None
        if found is None:
            return UNKNOWN, 0.0, False
        at, v = self.vector(found)
        p = softmax((v @ self.weights[at] + self.bias) / self.heat)
        k = int(p.argmax())
        return self.labels[k], float(p[k]), self.learned(found)


def fit_sample(sample: list[tuple[str, str]], n_docs: int, df: np.ndarray, epochs: int = 3, alpha: float = 0.6, beta: float = 1.0, l1: float = 0.02, l2: float = 0.02, seed: int = 7) -> LanguageModel:
    """The model of (text, label) rows; a fifth of them, which training does not see, sets the temperature and the usual share of common n-grams. Same rows, same model, in any order."""
    labels = sorted({y for _, y in sample})
    idf = np.log((1 + n_docs) / (1 + df)) + 1.0
    dims, k = len(idf), len(labels)
    model = LanguageModel(labels, idf, np.zeros((dims, k)), np.zeros(k), common=df >= COMMON * n_docs)
    place = {y: i for i, y in enumerate(labels)}
    # Only counts are kept, in narrow numbers; a row's vector is made when it is used, so the driver holds no second copy.
    counts = [((c[0].astype(np.int32), c[1].astype(np.int32)), place[y]) for t, y in sorted(sample) if (c := gram_counts(t, dims)) is not None]
    order = np.random.default_rng(seed).permutation(len(counts))
    held, used = order[: len(order) // 5], order[len(order) // 5 :]
    learner = Ftrl(dims + 1, k, alpha, beta, l1, l2)
    rng = np.random.default_rng(seed + 1)
    for _ in range(epochs):
        for i in rng.permutation(used):
            (at, v), y = model.vector(counts[i][0]), counts[i][1]
            at, v = np.append(at, dims), np.append(v, 1.0)
            w = learner.weights(at)
            g = softmax(v @ w)
            g[y] -= 1.0
            learner.step(at, w, np.outer(v, g))
    w = learner.weights()
    model.weights, model.bias = w[:dims], w[dims]
    if len(held):
        logits = np.array([v @ model.weights[at] + model.bias for at, v in (model.vector(counts[i][0]) for i in held)])
        model.heat = temperature(logits, np.array([counts[i][1] for i in held]))
        shares = [c[1][model.common[c[0]]].sum() / c[1].sum() for c in (counts[i][0] for i in held) if c[1].sum() >= LONG]
        model.usual = float(np.quantile(shares, 0.01)) if shares else 0.0
    return model


def held_out(doc_id: str) -> Column:
    """Documents that no model learns from: crc32 of the id as text is 2 mod 4. Rows without an id are not held out, nor learned from."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string")) % 4 == 2, F.lit(False))


def train(docs: DataFrame, dims: int = 1 << 15, max_docs: int = 4000, max_chars: int = 20_000, doc_id: str = "doc_id", text: str = "text", label: str = "lang") -> LanguageModel:
    """Learns from text and label of the rows that are not held out and have an id and a label.

    Document frequencies come from all of them. The classifier's sample is about ``max_docs`` rows
    (twice that at most), in equal parts by label as far as there are rows, of texts of at most
    ``max_chars`` characters, chosen by a hash of the id; its ids are broadcast, its texts collected.
    Rows alike in id and label count once, by the least text. Reruns agree. Each label that has a
    text in the sample can be predicted; the model has ``dims`` x labels weights. No such rows: a
    model that answers ``und``.
    """
    rows = docs.filter(F.col(label).isNotNull() & F.col(doc_id).isNotNull() & ~held_out(doc_id))
    rows = rows.select(F.col(doc_id).alias("id"), F.col(text).cast("string").alias("text"), F.col(label).cast("string").alias("label"))
    n_docs, df = document_frequencies(rows, dims)
    short = rows.filter(F.length("text") <= max_chars)
    sizes = short.groupBy("label").agg(F.count(F.lit(1)).alias("n"))
    labels = sizes.count()
    quota = max_docs / max(1, labels)
    sizes = F.broadcast(sizes) if labels <= 10_000 else sizes
    even = F.pmod(F.xxhash64("id", F.lit("sample")), F.lit(1_000_003)) / F.lit(1_000_003.0)
    chosen = short.select("id", "label").join(sizes, "label").filter(even < F.lit(quota) / F.col("n")).select("id", "label").distinct()
    chosen = chosen.orderBy(even, "id", "label").limit(2 * max_docs)
    sample = short.join(F.broadcast(chosen), ["id", "label"]).groupBy("id", "label").agg(F.min("text").alias("text")).select("text", "label").collect()
    return fit_sample([(r["text"], r["label"]) for r in sample], n_docs, df)


def scores(docs: DataFrame, model: LanguageModel, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """td_known, td_id, td_hash (each row's key), ``lang_pred``, ``score``, the calibrated probability, and ``learned``; only the text is used.

    Null texts and texts without a letter are ``und`` with score 0. Rows are neither dropped nor
    merged: equal texts are scored alike, repeated rows return repeated rows.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)  # dims x labels numbers

    def predict(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        m = shared.value
        for b in batches:
            got = [m.predict(t) for t in b.pop("text")]
            yield b.assign(lang_pred=[g[0] for g in got], score=[g[1] for g in got], learned=[g[2] for g in got])

    rows = docs.select(*row_key(doc_id, text), F.col(text).cast("string").alias("text"))
    return rows.mapInPandas(predict, "td_known boolean, td_id long, td_hash long, lang_pred string, score double, learned boolean")


def _identified(docs: DataFrame, model: LanguageModel, text: str) -> DataFrame:
    """Packed rows with ``td_lang``, struct(lang_pred, score, learned)."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("lang_pred string, score double, learned boolean")
    def predict(texts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for t in texts:
            yield pd.DataFrame([shared.value.predict(x) for x in t], columns=["lang_pred", "score", "learned"])

    return packed(docs, docs.columns[0], text).withColumn("td_lang", predict(F.col("td_row").getField(text).cast("string")))


def identify(docs: DataFrame, model: LanguageModel, text: str = "text") -> DataFrame:
    """Input columns plus ``lang_pred``, ``score`` and ``learned``, whether the text looks like any language that the model has seen; input columns of these names are replaced.

    Null texts and texts without a letter are ``und`` with score 0. Rows are neither dropped nor merged.
    """
    names = ("lang_pred", "score", "learned")
    return unpacked(_identified(docs, model, text), docs.columns, {n: F.col("td_lang").getField(n) for n in names})


def in_learned_languages(docs: DataFrame, model: LanguageModel, text: str = "text") -> DataFrame:
    """The input rows whose text has a letter and looks like a language that the model has seen; columns stay as they are, whatever their names."""
    return unpacked(_identified(docs, model, text).filter((F.col("td_lang.lang_pred") != UNKNOWN) & F.col("td_lang.learned")), docs.columns, {})
