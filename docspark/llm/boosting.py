"""Gradient-boosted trees for two classes, and isotonic calibration, in numpy."""

from __future__ import annotations

import numpy as np


class Trees:
    """Trees of one depth over binned features, fitted to logistic loss by second-order steps."""

    def __init__(self, trees: int = 80, depth: int = 4, rate: float = 0.15, bins: int = 64, ridge: float = 2.0, least: float = 1.0):
        self.trees, self.depth, self.rate, self.bins, self.ridge, self.least = trees, depth, rate, bins, ridge, least

    def fit(self, x: np.ndarray, y: np.ndarray) -> Trees:
        n, f = x.shape
        self.edges = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, self.bins + 1)[1:-1])) for j in range(f)]
        binned = self._binned(x)
        mean = np.clip(y.mean(), 1e-3, 1 - 1e-3)
        self.base = float(np.log(mean / (1 - mean)))
        nodes = (1 << self.depth) - 1
        self.feature = np.zeros((self.trees, nodes), np.int64)
        self.cut = np.full((self.trees, nodes), self.bins, np.int64)  # all go left where nothing is gained
        self.value = np.zeros((self.trees, nodes + 1))
        score = np.full(n, self.base)
        cells = np.arange(f) * self.bins + binned
        for t in range(self.trees):
            p = 1 / (1 + np.exp(-score))
            g, h = y - p, np.maximum(p * (1 - p), 1e-6)
            at = np.zeros(n, np.int64)
            for level in range(self.depth):
                k = 1 << level
                flat = (at[:, None] * (f * self.bins) + cells).ravel()
                gs = np.bincount(flat, np.repeat(g, f), k * f * self.bins).reshape(k, f, self.bins).cumsum(axis=2)
                hs = np.bincount(flat, np.repeat(h, f), k * f * self.bins).reshape(k, f, self.bins).cumsum(axis=2)
                ga, ha = gs[:, :, -1:], hs[:, :, -1:]
                gain = gs**2 / (hs + self.ridge) + (ga - gs) ** 2 / (ha - hs + self.ridge) - ga**2 / (ha + self.ridge)
                gain[(hs < self.least) | (ha - hs < self.least)] = 0
                best = gain.reshape(k, -1).argmax(axis=1)
                some = gain.reshape(k, -1)[np.arange(k), best] > 1e-6
                first = k - 1
                self.feature[t, first : first + k] = np.where(some, best // self.bins, 0)
                self.cut[t, first : first + k] = np.where(some, best % self.bins, self.bins)
                at = at * 2 + (binned[np.arange(n), self.feature[t, first + at]] > self.cut[t, first + at])
            self.value[t] = self.rate * np.bincount(at, g, nodes + 1) / (np.bincount(at, h, nodes + 1) + self.ridge)
            score += self.value[t, at]
        return self

    def _binned(self, x: np.ndarray) -> np.ndarray:
        return np.stack([np.searchsorted(e, x[:, j], side="left") for j, e in enumerate(self.edges)], axis=1)

    def margin(self, x: np.ndarray) -> np.ndarray:
        binned, rows = self._binned(x), np.arange(len(x))
        score = np.full(len(x), self.base)
        for feature, cut, value in zip(self.feature, self.cut, self.value, strict=True):
            at = np.zeros(len(x), np.int64)
            for level in range(self.depth):
                node = (1 << level) - 1 + at
                at = at * 2 + (binned[rows, feature[node]] > cut[node])
            score += value[at]
        return score


class Isotonic:
    """The non-decreasing step function of least squares, joined by straight lines."""

    def fit(self, x: np.ndarray, y: np.ndarray) -> Isotonic:
        order = np.argsort(x, kind="stable")
        blocks: list[list[float]] = []  # sum of y, weight, sum of x
        for a, b in zip(x[order].tolist(), y[order].tolist(), strict=True):
            blocks.append([b, 1.0, a])
            while len(blocks) > 1 and blocks[-2][0] * blocks[-1][1] >= blocks[-1][0] * blocks[-2][1]:
                last = blocks.pop()
                blocks[-1] = [p + q for p, q in zip(blocks[-1], last, strict=True)]
        weight = np.array([b[1] for b in blocks])
        self.x = np.array([b[2] for b in blocks]) / weight
        self.y = np.array([b[0] for b in blocks]) / weight
        return self

    def __call__(self, x: np.ndarray) -> np.ndarray:
        return np.interp(x, self.x, self.y)
