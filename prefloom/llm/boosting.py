"""Gradient-boosted trees and isotonic calibration on a bounded matrix of features."""

from __future__ import annotations

import numpy as np

BINS = 48


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1.0 / (1.0 + np.exp(-np.clip(x, -40, 40)))


class BoostedTrees:
    """Logistic boosting of small trees over binned features."""

    def __init__(self, rounds: int = 60, depth: int = 3, rate: float = 0.2, ridge: float = 1.0, least: float = 1.0):
        self.rounds, self.depth, self.rate, self.ridge, self.least = rounds, depth, rate, ridge, least
        self.base, self.trees, self.cuts = 0.0, [], []

    def fit(self, x: np.ndarray, y: np.ndarray) -> BoostedTrees:
        positive = (y.sum() + 0.5) / (len(y) + 1.0)
        self.base = float(np.log(positive / (1 - positive)))
        self.trees = []
        self.cuts = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, BINS + 1)[1:-1])) if len(x) else np.zeros(0)
                     for j in range(x.shape[1])]
        if not 0 < y.sum() < len(y):
            return self
        binned = self._bin(x)
        margin = np.full(len(y), self.base)
        for _ in range(self.rounds):
            p = sigmoid(margin)
            tree, leaf = self._tree(binned, p - y, p * (1 - p))
            self.trees.append(tree)
            margin += tree[2][leaf]
        return self

    def _bin(self, x: np.ndarray) -> np.ndarray:
        return np.stack([np.searchsorted(c, x[:, j], side="left") for j, c in enumerate(self.cuts)], axis=1)

    def _tree(self, binned: np.ndarray, grad: np.ndarray, hess: np.ndarray):
        """Feature and cut of each inner node, value of each leaf; the leaf of each row."""
        inner = (1 << self.depth) - 1
        feature, cut = np.zeros(inner, np.int64), np.full(inner, BINS + 1, np.int64)
        node = np.zeros(len(grad), np.int64)
        for level in range(self.depth):
            low, n = (1 << level) - 1, 1 << level
            best = np.full(n, 1e-6)
            for j in range(binned.shape[1]):
                slot = (node - low) * (BINS + 1) + binned[:, j]
                g = np.cumsum(np.bincount(slot, grad, n * (BINS + 1)).reshape(n, -1), axis=1)
                h = np.cumsum(np.bincount(slot, hess, n * (BINS + 1)).reshape(n, -1), axis=1)
                rest_g, rest_h = g[:, -1:] - g, h[:, -1:] - h
                gain = g**2 / (h + self.ridge) + rest_g**2 / (rest_h + self.ridge) - g[:, -1:]**2 / (h[:, -1:] + self.ridge)
                gain[(h < self.least) | (rest_h < self.least)] = 0
                top = gain.argmax(axis=1)
                value = gain[np.arange(n), top]
                better = value > best
                best[better] = value[better]
                feature[low + np.flatnonzero(better)], cut[low + np.flatnonzero(better)] = j, top[better]
            node = 2 * node + 1 + (binned[np.arange(len(node)), feature[node]] > cut[node])
        leaf = node - inner
        g, h = np.bincount(leaf, grad, inner + 1), np.bincount(leaf, hess, inner + 1)
        return (feature, cut, -self.rate * g / (h + self.ridge)), leaf

    def margin(self, x: np.ndarray) -> np.ndarray:
        out = np.full(len(x), self.base)
        if not self.trees or not len(x):
            return out
        binned = self._bin(x)
        rows = np.arange(len(x))
        inner = (1 << self.depth) - 1
        for feature, cut, value in self.trees:
            node = np.zeros(len(x), np.int64)
            for _ in range(self.depth):
                node = 2 * node + 1 + (binned[rows, feature[node]] > cut[node])
            out += value[node - inner]
        return out


def isotonic(score: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Knots of the non-decreasing fit of ``y`` over ``score``, by pooling adjacent violators."""
    order = np.argsort(score, kind="stable")
    levels: list[list[float]] = []
    for s, v in zip(score[order].tolist(), y[order].tolist()):
        levels.append([v, 1.0, s, s])
        while len(levels) > 1 and levels[-2][0] >= levels[-1][0]:
            v2, w2, _, high = levels.pop()
            v1, w1, low, _ = levels.pop()
            levels.append([(v1 * w1 + v2 * w2) / (w1 + w2), w1 + w2, low, high])
    xs = [x for v, w, low, high in levels for x in (low, high)]
    ys = [v for v, w, low, high in levels for _ in (0, 1)]
    return np.array(xs), np.array(ys)


class CalibratedTrees:
    """Boosted trees whose margins are mapped to probabilities by an isotonic fit on held-back parts."""

    def fit(self, x: np.ndarray, y: np.ndarray, parts: int = 3, **options) -> CalibratedTrees:
        self.model = BoostedTrees(**options).fit(x, y)
        part = np.arange(len(y)) % parts
        margin = np.zeros(len(y))
        for k in range(parts):
            if (part == k).any():
                margin[part == k] = BoostedTrees(**options).fit(x[part != k], y[part != k]).margin(x[part == k])
        self.xs, self.ys = isotonic(margin, y.astype(float))
        return self

    def probability(self, x: np.ndarray) -> np.ndarray:
        """Calibrated scores; a small share of the plain score keeps the order within a level."""
        margin = self.model.margin(x)
        plain = sigmoid(margin)
        level = np.interp(margin, self.xs, self.ys) if len(self.xs) else plain
        return np.clip(0.98 * level + 0.02 * plain, 0.0, 1.0)
