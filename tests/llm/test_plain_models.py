"""The learned operators against plain Python: dictionaries, loops and the formulas as they are written in papers."""

import math
import random

import numpy as np

from tidemark.llm import language, quality
from tidemark.llm.ngram_lr import Ftrl

MASK = (1 << 64) - 1


def plain_grams(text, dims):
    """Counts by bucket of the 1- to 3-grams of a text whose runs of other characters are one space."""
    line, gap = [" "], True
    for c in text.lower():
        if c.isalpha():
            line.append(c)
            gap = False
        elif not gap:
            line.append(" ")
            gap = True
    # The text's own leading and trailing gaps stand beside the spaces at its ends.
    body = "".join(line)
    if text and not text.lower()[0].isalpha():
        body = " " + body
    body += " "
    out = {}
    for n in (1, 2, 3):
        for i in range(len(body) - n + 1):
            h = n
            for c in body[i : i + n]:
                h = (h * 0x100000001B3 + ord(c)) & MASK
            b = ((h * 0x9E3779B97F4A7C15) & MASK) >> (64 - (dims - 1).bit_length())
            out[b] = out.get(b, 0) + 1
    return out


TEXTS = [("the cat sat on the mat, and the dog", "en"), ("die katze sitzt auf der matte", "de"), ("le chat est sur le tapis", "fr"), ("A. b! c? the end", "en"), ("und der hund, auch", "de"), ("où est le chien", "fr")] * 6


def test_grams_and_vectors():
    dims = 1 << 10
    for text in ["the cat", "Ä b, c", "x", "one  two\nthree", "end."] + [t for t, _ in TEXTS]:
        at, n = language.gram_counts(text, dims)
        assert dict(zip(at.tolist(), n.tolist())) == plain_grams(text, dims)
    df = np.zeros(dims, np.int64)
    for t, _ in TEXTS:
        for b in plain_grams(t, dims):
            df[b] += 1
    model = language.fit_sample(TEXTS, len(TEXTS), df)
    at, v = model.vector(language.gram_counts("the cat", dims))
    raw = {b: math.log1p(n) * (math.log((1 + len(TEXTS)) / (1 + int(df[b]))) + 1) for b, n in plain_grams("the cat", dims).items()}
    norm = math.sqrt(sum(x * x for x in raw.values()))
    assert all(abs(x - raw[int(b)] / norm) < 1e-12 for b, x in zip(at, v))


class PlainFtrl:
    """FTRL-Proximal, a coordinate at a time."""

    def __init__(self, alpha, beta, l1, l2):
        self.z, self.n, self.p = {}, {}, (alpha, beta, l1, l2)

    def weight(self, i):
        alpha, beta, l1, l2 = self.p
        z, n = self.z.get(i, 0.0), self.n.get(i, 0.0)
        return 0.0 if abs(z) <= l1 else -(z - math.copysign(l1, z)) / ((beta + math.sqrt(n)) / alpha + l2)

    def step(self, i, w, g):
        n = self.n.get(i, 0.0)
        sigma = (math.sqrt(n + g * g) - math.sqrt(n)) / self.p[0]
        self.z[i], self.n[i] = self.z.get(i, 0.0) + g - sigma * w, n + g * g


def test_a_pass_of_ftrl_and_the_temperature():
    rng = random.Random(3)
    fast, slow = Ftrl(50, 3, 0.6, 1.0, 0.02, 0.02), PlainFtrl(0.6, 1.0, 0.02, 0.02)
    for _ in range(300):
        at = sorted(rng.sample(range(50), 5))
        x, y = [rng.random() for _ in at], rng.randrange(3)
        w = [[slow.weight((i, k)) for k in range(3)] for i in at]
        s = [sum(a * r[k] for a, r in zip(x, w)) for k in range(3)]
        e = [math.exp(v - max(s)) for v in s]
        p = [v / sum(e) - (k == y) for k, v in enumerate(e)]
        got = fast.weights(np.array(at))
        assert np.allclose(got, w, atol=1e-12)
        fast.step(np.array(at), got, np.outer(x, p))
        for i, a, r in zip(at, x, w):
            for k in range(3):
                slow.step((i, k), r[k], a * p[k])
    logits = np.array([[rng.gauss(0, 3) for _ in range(3)] for _ in range(400)])
    truth = np.array([int(np.argmax(r + np.random.default_rng(i).gumbel(size=3) * 2)) for i, r in enumerate(logits)])

    def loss(t):
        return sum(-math.log(math.exp(r[y] / t) / sum(math.exp(v / t) for v in r)) for r, y in zip(logits.tolist(), truth.tolist()))

    from tidemark.llm.ngram_lr import temperature

    best = min((loss(math.exp(k / 100)), math.exp(k / 100)) for k in range(-200, 300))[1]
    assert abs(math.log(temperature(logits, truth) / best)) < 0.02


def test_grades_against_gradient_descent():
    """The same likelihood fitted by plain gradient descent: order of cuts, signs of the telling words, and tails agree."""
    rng = random.Random(8)
    telling = {"awful": -2.0, "bad": -1.0, "good": 1.0, "great": 2.0}
    rows = []
    for _ in range(500):
        words = rng.sample(sorted(telling), rng.randrange(3)) + [f"w{rng.randrange(12)}" for _ in range(4)]
        s = sum(telling.get(w, 0) for w in words) + math.log((u := rng.random()) / (1 - u))
        rows.append((" ".join(words), 0 if s < -1 else 1 if s < 1 else 2))
    model = quality.fit_sample(rows, 3)
    vocabulary = sorted({w for t, _ in rows for w in t.split()})
    sizes = [sum(y == g for _, y in rows) for g in range(3)]
    w, first, gap = dict.fromkeys(vocabulary, 0.0), -1.0, 0.0
    sig = lambda x: 1 / (1 + math.exp(-x))
    for _ in range(300):
        gw, g1, g2 = dict.fromkeys(vocabulary, 0.0), 0.0, 0.0
        cuts = (first, first + math.exp(gap))
        for t, y in rows:
            words, k = set(t.split()), len(rows) / sizes[y] / 3 / len(rows)
            s = sum(w[x] for x in words)
            upper, lower = sig(cuts[1] - s) if y == 1 else sig(cuts[0] - s) if y == 0 else 1.0, sig(cuts[0] - s) if y == 1 else sig(cuts[1] - s) if y == 2 else 0.0
            p = max(upper - lower, 1e-12)
            du, dl = upper * (1 - upper) / p, lower * (1 - lower) / p
            for x in words:
                gw[x] += k * (du - dl)
            by = [0.0, 0.0]
            if y < 2:
                by[y] -= k * du
            if y > 0:
                by[y - 1] += k * dl
            g1, g2 = g1 + by[0] + by[1], g2 + by[1] * math.exp(gap)
        w = {x: w[x] - 3 * gw[x] for x in vocabulary}
        first, gap = first - 3 * g1, gap - 3 * g2
    assert model.thresholds[0] < model.thresholds[1] and first < first + math.exp(gap)
    for x, sign in telling.items():
        mine = model.weights[quality._word(x)[0]]
        assert mine * sign > 0 and w[x] * sign > 0
    texts = sorted({t for t, _ in rows})
    plain = [sig(sum(w[x] for x in set(t.split())) - first) for t in texts]
    got = [float(model.tails(t)[0]) for t in texts]
    assert np.corrcoef(plain, got)[0, 1] > 0.95 and np.abs(np.array(plain) - got).mean() < 0.1
