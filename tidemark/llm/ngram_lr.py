"""Sparse linear learners on hashed features, trained with follow-the-regularised-leader (FTRL-Proximal)."""

from __future__ import annotations

import numpy as np


class Ftrl:
    """Per-coordinate FTRL-Proximal state for weights of shape (dims, outputs), with L1 and L2 penalties (elastic net)."""

    def __init__(self, dims: int, outputs: int, alpha: float, beta: float, l1: float, l2: float):
        self.z, self.n = np.zeros((dims, outputs)), np.zeros((dims, outputs))
        self.alpha, self.beta, self.l1, self.l2 = alpha, beta, l1, l2

    def weights(self, rows: np.ndarray | slice = slice(None)) -> np.ndarray:
        z, n = self.z[rows], self.n[rows]
        shrunk = np.sign(z) * np.maximum(np.abs(z) - self.l1, 0.0)
        return -shrunk / ((self.beta + np.sqrt(n)) / self.alpha + self.l2)

    def step(self, rows: np.ndarray, w: np.ndarray, g: np.ndarray) -> None:
        """Gradient g at the weights w of distinct rows."""
        n = self.n[rows]
        grown = n + g * g
        self.z[rows] += g - (np.sqrt(grown) - np.sqrt(n)) / self.alpha * w
        self.n[rows] = grown


def softmax(x: np.ndarray) -> np.ndarray:
    e = np.exp(x - x.max(axis=-1, keepdims=True))
    return e / e.sum(axis=-1, keepdims=True)


def temperature(logits: np.ndarray, truth: np.ndarray) -> float:
    """The divisor of the logits that makes held-out log loss least, by golden-section search on its logarithm."""
    if not len(truth):
        return 1.0
    loss = lambda t: -np.log(softmax(logits / np.exp(t))[np.arange(len(truth)), truth] + 1e-12).mean()
    lo, hi, r = -4.0, 3.0, (5**0.5 - 1) / 2
    for _ in range(40):
        a, b = hi - r * (hi - lo), lo + r * (hi - lo)
        if loss(a) < loss(b):
            hi = b
        else:
            lo = a
    return float(np.exp((lo + hi) / 2))
