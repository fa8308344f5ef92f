"""MinHash near-dedup, spelling variants and whitening against brute force."""

import random
import re
import zlib
from collections import Counter
from itertools import combinations

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.llm import minhash, queries, spelling, whitening

from .conftest import EDGE


def word_sets(text, n=4):
    lower = (text or "").translate({c: c + 32 for c in range(65, 91)})
    words = [w for w in re.split("[\x20\x09-\x0d]+", lower) if w]
    return {tuple(words[i : i + n]) for i in range(max(1, len(words) - n + 1))} if words else set()


def brute_components(docs, hundredths=80):
    """{index: index of the smallest doc_id reachable} over (doc_id, text), every pair compared."""
    sets = [word_sets(t) for _, t in docs]
    root = list(range(len(docs)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, j in combinations(range(len(docs)), 2):
        x, y = sets[i], sets[j]
        if x and y and 5 * min(len(x), len(y)) >= 4 * max(len(x), len(y)) and 100 * len(x & y) >= hundredths * len(x | y):
            a, b = find(i), find(j)
            root[max(a, b)] = min(a, b)
    return [find(i) for i in range(len(docs))], sets


def near_copies(seed, groups=12, members=14):
    """Groups of texts of 30 to 200 words whose members differ from a base in a few words each, so that links form chains."""
    rng, out = random.Random(seed), []
    for g in range(groups):
        base = [f"w{rng.randrange(10_000)}" for _ in range(rng.randrange(30, 200))]
        for m in range(members):
            text = list(base)
            for _ in range(rng.randrange(0, max(2, len(base) // 12))):
                text[rng.randrange(len(text))] = f"x{rng.randrange(10_000)}"
            out.append((1000 * g + m, " ".join(text)))
    rng.shuffle(out)
    return out


@pytest.mark.parametrize("tile", [1000, 5])
def test_links_are_those_of_brute_force(spark, tile):
    docs = sorted(near_copies(5))
    roots, sets = brute_components(docs)
    got = {r["doc_id"]: r for r in minhash.label_groups(spark.createDataFrame(docs, "doc_id long, text string"), tile=tile).collect()}
    assert {i: docs[r][0] for (i, _), r in zip(docs, roots)} == {i: r["component_id"] for i, r in got.items()}
    assert all(got[i]["n_shingles"] == len(s) for (i, _), s in zip(docs, sets))
    assert all(r["kept"] == (i == r["component_id"]) for i, r in got.items())
    assert len(set(roots)) > 20  # some groups are linked, some are not


def test_whole_table_matches_brute_force(spark, small):
    docs = sorted((r["doc_id"], r["text"]) for r in spark.read.parquet(f"{small}/documents.parquet").collect())
    roots, _ = brute_components(docs)
    got = {r["doc_id"]: r["component_id"] for r in queries.op11_minhash(spark, small).collect()}
    assert {i: docs[r][0] for (i, _), r in zip(docs, roots)} == got


def test_posterior_bounds():
    bounds = minhash.least_matches(0.8, 1e-6)
    assert list(bounds) == sorted(bounds) and len(bounds) == 5
    rng = np.random.default_rng(2)
    same = rng.random((200_000, minhash.VALUES)) < 0.8  # matches of pairs of similarity 0.8
    assert len(minhash.survivors(same, np.ones_like(same), 0.8, 1e-6)) >= 200_000 - 5
    apart = rng.random((20_000, minhash.VALUES)) < 0.4
    assert len(minhash.survivors(apart, np.ones_like(apart), 0.8, 1e-6)) == 0


def test_minhash_edge_rows(spark, edge, empty, clashing):
    got = minhash.label_groups(edge).collect()
    assert len(got) == len(EDGE)
    by = {(r["doc_id"], r["n_shingles"]): r for r in got}
    assert by[(1, 0)]["component_id"] == 1 and by[(2, 0)]["component_id"] == 2 and by[(2, 0)]["kept"]
    assert by[(7, 1)]["component_id"] == 7 and by[(None, 2)]["kept"] and by[(None, 2)]["component_id"] is None
    assert minhash.label_groups(empty).count() == 0 and minhash.keep_one(empty).columns == empty.columns
    kept = minhash.keep_one(edge)
    assert kept.columns == edge.columns and kept.count() == len(EDGE) - 1  # the repeated row of 4
    assert minhash.keep_one(clashing).columns == clashing.columns


def test_exact_copies_are_one_node(spark):
    docs = [(i, "one two three four five six" if i % 3 else f"other text number {i} of many") for i in range(3000)]
    got = minhash.label_groups(spark.createDataFrame(docs, "doc_id long, text string"))
    assert got.filter("doc_id % 3 <> 0 and component_id <> 1").count() == 0
    assert got.filter("kept").count() == 1001


# Spelling variants


def brute_vocabulary(docs):
    counts = Counter()
    for ident, text in docs:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = run.translate({c: c + 32 for c in range(65, 91)})
            h = zlib.crc32(f"{'' if ident is None else ident}:{run}".encode())
            if h % 199 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            counts[run] += 1
    return {w: n for w, n in counts.items() if len(w) >= 6 and n >= 5}


def near(x, y):
    if len(x) == len(y):
        return sum(a != b for a, b in zip(x, y)) == 1
    x, y = sorted((x, y), key=len)
    return len(y) == len(x) + 1 and any(y[:i] + y[i + 1 :] == x for i in range(len(y)))


def brute_variants(counts):
    out = {}
    by_length = {}
    for w in counts:
        by_length.setdefault(len(w), []).append(w)
    for w, n in counts.items():
        others = [x for k in (-1, 0, 1) for x in by_length.get(len(w) + k, []) if near(w, x)]
        best = min(others, key=lambda x: (-counts[x], x), default=None)
        out[w] = [best if best is not None and counts[best] >= 5 * n else None, n, len(others)]
    full = {}
    for w, (form, n, k) in out.items():
        root = w
        while out[root][0] is not None:
            root = out[root][0]
        full[w] = (form, root, n, k, counts[form] if form else None)
    return full


def variants_of(frame):
    return {r["word"]: (r["form"], r["root"], r["n"], r["n_near"], r["form_n"]) for r in frame.collect()}


def test_variants_match_brute_force(spark, small):
    for folder in (small, "/root/testdata/sf0.01"):
        docs = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{folder}/documents.parquet").collect()]
        want = brute_variants(brute_vocabulary(docs))
        assert variants_of(queries.op12_spelling(spark, folder)) == want
    assert any(v[0] for v in want.values())


@pytest.mark.parametrize("most", [20_000, 30, 1])
def test_hot_keys_are_cut(spark, most):
    """Words over three letters in lengths 6 to 8: dense neighbourhoods, runs of equal letters, chains of forms."""
    rng = random.Random(9)
    words = {"".join(rng.choice("abé") for _ in range(rng.choice((6, 7, 7, 8)))) for _ in range(700)}
    counts = {w: int(5 * 1.6 ** rng.randrange(16)) for w in words}
    frame = spark.createDataFrame(list(counts.items()), "word string, n long")
    got = {r["word"]: (r["n_near"], r["form"]) for r in spelling.near_words(frame, most, chunk=100).collect()}
    want = brute_variants(counts)
    assert {w: got.get(w, (0, None))[0] for w in words} == {w: v[3] for w, v in want.items()}
    assert all(got[w][1] == v[0] for w, v in want.items() if v[0])
    keys = spelling.dealt(frame, most).groupBy("length", "a", "b", "rest").count()
    assert keys.filter(F.col("count") > most).filter("b - a > 1").isEmpty()


def test_wavelet_matrix_reports_rectangles():
    rng = np.random.default_rng(4)
    for n in (1, 2, 3, 17, 1000):
        p = rng.permutation(n)
        m = spelling.WaveletMatrix(p)
        lo, hi = np.sort(rng.integers(0, n + 1, (2, 50)), axis=0)
        low, high = np.sort(rng.integers(0, n + 1, (2, 50)), axis=0)
        got = {(int(k), int(v)) for k, v in zip(*m.report(lo, hi, low, high))}
        assert got == {(k, int(v)) for k in range(50) for v in p[lo[k] : hi[k]] if low[k] <= v < high[k]}


def test_chains_of_forms_and_edge_rows(spark, edge, empty):
    texts = [(i, w) for i, (w, n) in enumerate([("chains", 5), ("chainss", 30), ("chainsss", 200), ("lonely", 7)]) for _ in range(n)]
    docs = spark.createDataFrame([(k, w) for k, (_, w) in enumerate(texts)], "doc_id long, text string")
    got = variants_of(spelling.group_variants(docs, every=0))
    assert got["chains"] == ("chainss", "chainsss", 5, 1, 30) and got["lonely"] == (None, "lonely", 7, 0, None)
    assert spelling.group_variants(empty).count() == 0
    assert variants_of(spelling.group_variants(edge.unionByName(edge).unionByName(edge))) == brute_variants(brute_vocabulary([r[:2] for r in EDGE] * 3))
    long = "ab" * 40_000
    docs = spark.createDataFrame([(i, long if i % 2 else long + "a") for i in range(40)], "doc_id long, text string")
    assert {len(w): v[3] for w, v in variants_of(spelling.group_variants(docs, every=0)).items()} == {80_000: 1, 80_001: 1}


# Whitening


def brute_whitening(rows):
    """(usable rows as integers, exact S and n, eigenvectors and values of the covariance of the distinct rows)."""
    usable = [(i, [int(np.floor(64 * float(np.float32(c)))) + 1_000_000 for c in v]) for i, v in rows if v is not None and all(c is not None and np.isfinite(c) for c in v)]
    points = sorted({tuple(v) for _, v in usable})
    n, sums = len(points), [sum(c) for c in zip(*points)]
    y = np.array([[n * a - s for a, s in zip(p, sums)] for p in points], object)
    cov = (y.T @ y).astype(float) / n**3
    values, vectors = np.linalg.eigh(cov)
    return usable, n, sums, values[::-1], vectors[:, ::-1], cov


def check_whitening(rows, got, k=16):
    usable, n, sums, values, vectors, cov = brute_whitening(rows)
    k = min(k, len(values))
    by = {}
    for r in got:
        by.setdefault(r["vec_id"], {})[r["component"]] = r
    assert set(by) == {i for i, _ in usable} and all(sorted(v) == list(range(1, k + 1)) for v in by.values())
    exact = {i: np.array([n * a - s for a, s in zip(x, sums)], object) for i, x in usable}
    w = np.array([[by[i][c]["whitened"] for c in range(1, k + 1)] for i, _ in usable])
    want = np.array([exact[i].astype(float) / n @ vectors[:, :k] for i, _ in usable]) / np.sqrt(values[:k])
    for c in range(k):
        assert min(np.abs(w[:, c] - want[:, c]).max(), np.abs(w[:, c] + want[:, c]).max()) < 1e-7
    for i, x in by.items():
        assert x[1]["n"] == n and x[1]["deviation"] == int((exact[i] ** 2).sum())
    assert np.allclose([by[usable[0][0]][c]["explained"] for c in range(1, k + 1)], values[:k] / np.trace(cov), rtol=1e-9)
    error = {r["identity_error"] for r in got}
    assert len(error) == 1 and error.pop() < 1e-9


def test_whitening_matches_eigenvectors(spark):
    folder = "/root/testdata/sf0.01"
    rows = [(r["vec_id"], r["embedding"]) for r in spark.read.parquet(f"{folder}/embeddings.parquet").collect()]
    check_whitening(rows, queries.op13_whitening(spark, folder).collect())


def table_of(spark, n, d, seed=1):
    rng = np.random.default_rng(seed)
    x = rng.standard_normal((n, d)) @ np.diag(2.0 ** -np.arange(d) + 0.05)
    return [(i, [float(np.float32(c)) for c in v]) for i, v in enumerate(x)]


def test_blocks_narrower_than_the_vectors_converge(spark):
    rows = table_of(spark, 400, 40)
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    check_whitening(rows, whitening.whiten(frame, k=3, block=8).collect(), k=3)
    model = whitening.fit(whitening.integer_rows(frame, "embedding", []), k=3, block=8)
    assert model.passes > 2
    with pytest.raises(RuntimeError):
        whitening.fit(whitening.integer_rows(frame, "embedding", []), k=3, block=4, most_passes=1)


def test_whitening_edge_rows(spark):
    rows = table_of(spark, 60, 5)
    odd = [(100, None), (101, [1.0, None, 0.0, 0.0, 0.0]), (102, [float("nan")] * 5), (103, [float("inf")] * 5), (104, []), (105, [1.0, 2.0]), (60, rows[0][1]), (0, rows[0][1])]
    schema = "vec_id long, embedding array<float>, label int, n int, component string"
    frame = spark.createDataFrame([(*r, 1, 2, "c") for r in rows + odd], schema)
    got = whitening.whiten(frame).collect()
    check_whitening([*rows, (60, rows[0][1])], [r for r in got if r["vec_id"] != 0] + [r for r in got if r["vec_id"] == 0][:5])
    assert sum(r["vec_id"] == 0 for r in got) == 10
    assert whitening.whiten(frame.limit(0)).count() == 0
    assert whitening.whiten(frame.filter("vec_id = 0")).count() == 0  # one distinct vector has no variance
    flat = spark.createDataFrame([(i, [float(i), 2.0 * i, 0.0]) for i in range(9)], "vec_id long, embedding array<float>")
    assert {r["component"] for r in whitening.whiten(flat).collect()} == {1}
    large = whitening.deviations(np.array([[10**12, -(10**12)]]), 3, (10, 10))
    assert large == [None] and whitening.deviations(np.array([[10**9, 5]]), 3, (10, 10)) == [(3 * 10**9 - 10) ** 2 + 25]
