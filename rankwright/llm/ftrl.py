"""Follow-the-regularised-leader training of sparse linear models on hashed features.

Models are small (a bounded sample of documents, a fixed number of hashed
features), so the updates run in one process; featurising and scoring, which
see every document, are distributed by the callers.
"""

from __future__ import annotations

import numpy as np


class Ftrl:
    """FTRL-proximal with elastic-net penalties, one weight vector a class.

    ``z`` and ``n`` are the usual sums; a weight is zero unless ``|z| > l1``.
    With one class the model is logistic, with more it is softmax.
    """

    def __init__(self, features: int, classes: int = 1, alpha: float = 0.3, beta: float = 1.0, l1: float = 0.5, l2: float = 1.0) -> None:
        self.alpha, self.beta, self.l1, self.l2 = alpha, beta, l1, l2
        self.z = np.zeros((features, classes))
        self.n = np.zeros((features, classes))
        self.bias_z = np.zeros(classes)
        self.bias_n = np.zeros(classes)

    def _weights(self, z: np.ndarray, n: np.ndarray, l1: float, l2: float) -> np.ndarray:
        w = -(z - np.sign(z) * l1) / ((self.beta + np.sqrt(n)) / self.alpha + l2)
        return np.where(np.abs(z) <= l1, 0.0, w)

    def weights(self) -> np.ndarray:
        return self._weights(self.z, self.n, self.l1, self.l2)

    def bias(self) -> np.ndarray:
        return self._weights(self.bias_z, self.bias_n, 0.0, 0.0)

    def step(self, idx: np.ndarray, x: np.ndarray, target: int) -> None:
        """One example: distinct feature indices, their values, the label."""
        z, n = self.z[idx], self.n[idx]
        w = self._weights(z, n, self.l1, self.l2)
        bias = self.bias()
        raw = x @ w + bias
        if len(raw) == 1:
            error = 1.0 / (1.0 + np.exp(-np.clip(raw, -35, 35))) - target
        else:
            error = softmax(raw[None, :])[0]
            error[target] -= 1.0
        g = x[:, None] * error[None, :]
        self.n[idx] = n + g * g
        self.z[idx] = z + g - (np.sqrt(n + g * g) - np.sqrt(n)) / self.alpha * w
        new = self.bias_n + error * error
        self.bias_z += error - (np.sqrt(new) - np.sqrt(self.bias_n)) / self.alpha * bias
        self.bias_n = new

    def fit(self, rows: list[tuple[np.ndarray, np.ndarray, int]], epochs: int, seed: int = 7) -> Ftrl:
        order = np.random.default_rng(seed)
        for _ in range(epochs):
            for k in order.permutation(len(rows)):
                self.step(*rows[k])
        return self


def softmax(raw: np.ndarray) -> np.ndarray:
    e = np.exp(raw - raw.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


def temperature(raw: np.ndarray, target: np.ndarray) -> float:
    """The temperature of least log loss on held-back rows: golden-section search on its logarithm."""
    if not len(raw):
        return 1.0

    def loss(log_t: float) -> float:
        p = softmax(raw / np.exp(log_t))
        return -np.log(np.maximum(p[np.arange(len(target)), target], 1e-12)).mean()

    lo, hi, g = np.log(0.02), np.log(20.0), (np.sqrt(5) - 1) / 2
    for _ in range(60):
        a, b = hi - g * (hi - lo), lo + g * (hi - lo)
        lo, hi = (lo, b) if loss(a) < loss(b) else (a, hi)
    return float(np.exp((lo + hi) / 2))


def mix32(h: np.ndarray) -> np.ndarray:
    """A 32-bit finaliser over an unsigned 32-bit array."""
    h = h.astype(np.uint32, copy=True)
    h ^= h >> np.uint32(16)
    h *= np.uint32(0x85EBCA6B)
    h ^= h >> np.uint32(13)
    h *= np.uint32(0xC2B2AE35)
    h ^= h >> np.uint32(16)
    return h
