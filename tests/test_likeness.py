"""Nearest texts against all pairs in plain Python."""

import math
import random
import re
from collections import Counter

import pytest

from tidemark.functions.ranks import saved
from tidemark.operators import likeness


def brute(rows, k):
    texts = {}
    for i, t in rows:
        if i is not None:
            texts[i] = min([x for x in (texts.get(i), t) if x is not None], default=None)
    bags = {i: Counter(w for w in re.findall("[a-z0-9]+", (t or "").lower()) if len(w) > 1) for i, t in texts.items()}
    bags = {i: b for i, b in bags.items() if b}
    df = Counter(w for b in bags.values() for w in b)
    vec = {}
    for i, b in bags.items():
        v = {w: n * (math.log((1 + len(bags)) / (1 + df[w])) + 1) for w, n in b.items()}
        length = math.sqrt(sum(x * x for x in v.values()))
        vec[i] = {w: x / length for w, x in v.items()}
    out = set()
    for i, v in vec.items():
        found = sorted((-round(sum(x * u.get(w, 0) for w, x in v.items()), 9), j) for j, u in vec.items() if j != i and v.keys() & u.keys())
        out |= {(i, r + 1, j, -c) for r, (c, j) in enumerate(found[:k])}
    return out


def collected(spark, rows, k):
    items = spark.createDataFrame(rows, "c long, w string, x string").select("c", "w", "x")
    return {(r["c"], r["rank"], r["neighbour"], r["cosine"]) for r in likeness.nearest(items, "c", "w", k).collect()}


@pytest.mark.parametrize("k", [1, 4])
def test_equals_all_pairs(spark, k):
    rng = random.Random(k)
    words = [f"w{i}" for i in range(60)]
    rows = [(i, " ".join(rng.choices(words, weights=[60 / (j + 1) for j in range(60)], k=rng.randint(1, 7)))) for i in range(150)]
    rows += [(1000 + i, "Hot, hot ring") for i in range(9)] + [(2000 + i, "ring HOT hot") for i in range(3)]  # one class
    rows += [(3000, "alone here"), (3001, None), (3002, ""), (3003, "a b c"), (None, "w1 w2"), (5, "w0"), (5, "w0"), (3004, "x" * 50_000), (3005, "hot hot"), (3006, "hot")]
    got = collected(spark, [(i, t, "extra") for i, t in rows], k)
    assert {g[:3] for g in got} == {w[:3] for w in brute(rows, k)}
    want = {w[:3]: w[3] for w in brute(rows, k)}
    assert all(abs(want[g[:3]] - g[3]) < 2e-9 for g in got)
    assert len(got) == len(want)


def test_common_words_are_cut_and_few_pairs_compared(spark):
    rows = [(i, f"common name{i % 40} kind{i // 40}") for i in range(400)]
    items = spark.createDataFrame(rows, "id long, text string")
    bags = saved(likeness._bags(items, "id", "text"))
    classes = saved(bags.selectExpr("bag", "id as c", "1L as members"))
    vectors = saved(likeness._vectors(classes))
    bound = saved(likeness.bounds(vectors, classes, 3))
    pairs = [{(r["x"], r["y"]) for r in likeness.candidates(vectors, bound, 3, block).collect()} for block in (7, 1000)]
    assert pairs[0] == pairs[1] and len(pairs[0]) < 400 * 399 / 4


def test_empty(spark):
    assert collected(spark, [], 3) == set()
    assert collected(spark, [(1, "one text", ""), (2, None, "")], 3) == set()
