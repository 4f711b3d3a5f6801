"""Gradient-boosted trees on binned features, trained on a bounded sample."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np


@dataclass
class BoostedTrees:
    """Logistic boosting. Each tree is complete to its depth: arrays of feature and threshold by node, and of values by leaf."""

    base: float
    features: np.ndarray
    thresholds: np.ndarray
    values: np.ndarray
    depth: int

    def predict(self, x: np.ndarray) -> np.ndarray:
        """Probability of class 1 of each row."""
        score = np.full(len(x), self.base)
        rows = np.arange(len(x))
        for f, t, v in zip(self.features, self.thresholds, self.values):
            node = np.zeros(len(x), dtype=np.int64)
            for _ in range(self.depth):
                node = 2 * node + 1 + (x[rows, f[node]] > t[node])
            score += v[node - (2**self.depth - 1)]
        return 1 / (1 + np.exp(-np.clip(score, -30, 30)))


def fit(x: np.ndarray, y: np.ndarray, *, rounds: int = 40, depth: int = 3, rate: float = 0.25, bins: int = 32, smooth: float = 1.0) -> BoostedTrees:
    """Trees for the 0/1 labels ``y``. One class only gives a model that always answers it."""
    n, m = x.shape
    p = (y.sum() + 0.5) / (n + 1)
    base = float(np.log(p / (1 - p)))
    edges = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, bins + 1)[1:-1])) if n else np.zeros(0) for j in range(m)]
    code = np.stack([np.searchsorted(e, x[:, j], side="left") for j, e in enumerate(edges)], axis=1) if n else np.zeros((0, m), int)
    offsets = np.arange(m) * bins
    score = np.full(n, base)
    fs, ts, vs = [], [], []
    inner, leaves = 2**depth - 1, 2**depth
    for _ in range(rounds if 0 < y.sum() < n else 0):
        q = 1 / (1 + np.exp(-score))
        g, h = y - q, q * (1 - q)
        feature, threshold = np.zeros(inner, dtype=np.int64), np.full(inner, np.inf)
        node = np.zeros(n, dtype=np.int64)
        for level in range(depth):
            first, width = 2**level - 1, 2**level
            local = node - first
            flat = (local[:, None] * (m * bins) + offsets[None, :] + code).ravel()
            size = width * m * bins
            hist_g = np.bincount(flat, np.repeat(g, m), size).reshape(width, m, bins).cumsum(axis=2)
            hist_h = np.bincount(flat, np.repeat(h, m), size).reshape(width, m, bins).cumsum(axis=2)
            all_g, all_h = hist_g[:, :1, -1:], hist_h[:, :1, -1:]
            gain = hist_g**2 / (hist_h + smooth) + (all_g - hist_g) ** 2 / (all_h - hist_h + smooth) - all_g**2 / (all_h + smooth)
            gain[(hist_h < 1e-3) | (all_h - hist_h < 1e-3)] = 0
            best = gain.reshape(width, -1).argmax(axis=1)
            for k in range(width):
                j, cut = divmod(int(best[k]), bins)
                if gain[k, j, cut] > 1e-6 and cut < len(edges[j]):
                    feature[first + k], threshold[first + k] = j, edges[j][cut]
            node = 2 * node + 1 + (x[np.arange(n), feature[node]] > threshold[node])
        leaf = node - inner
        value = rate * np.bincount(leaf, g, leaves) / (np.bincount(leaf, h, leaves) + smooth)
        score += value[leaf]
        fs.append(feature)
        ts.append(threshold)
        vs.append(value)
    empty = np.zeros((0, inner))
    return BoostedTrees(base, np.array(fs, dtype=np.int64) if fs else empty.astype(np.int64), np.array(ts) if ts else empty, np.array(vs) if vs else np.zeros((0, leaves)), depth)
