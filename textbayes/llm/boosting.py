"""Gradient-boosted trees for a binary label, and isotonic calibration, on a dense matrix that fits the driver."""

from __future__ import annotations

import numpy as np

BINS = 32


class Boosted:
    """Trees of fixed depth on binned features with logistic loss; ties in gain go to the lower feature and bin, so fits repeat exactly."""

    def __init__(self, trees: int = 60, depth: int = 3, rate: float = 0.15, ridge: float = 1.0, leaf: float = 2.0):
        self.trees, self.depth, self.rate, self.ridge, self.leaf = trees, depth, rate, ridge, leaf

    def _bin(self, x: np.ndarray) -> np.ndarray:
        return np.stack([np.searchsorted(cut, x[:, j], "right") for j, cut in enumerate(self.cuts)], 1)

    def fit(self, x: np.ndarray, y: np.ndarray) -> Boosted:
        self.cuts = [np.unique(np.quantile(x[:, j], np.arange(1, BINS) / BINS)) for j in range(x.shape[1])]
        self.cuts = [np.unique(np.append(c, np.nextafter(x[:, j].min(), np.inf))) for j, c in enumerate(self.cuts)]
        b = self._bin(x)
        n, m = b.shape
        width = BINS + 1
        cell = b + np.arange(m) * width
        p = np.clip(y.mean(), 1e-6, 1 - 1e-6)
        self.base = float(np.log(p / (1 - p)))
        raw = np.full(n, self.base)
        self.splits, self.values = [], []
        for _ in range(self.trees):
            p = 1 / (1 + np.exp(-raw))
            g, h = np.repeat(y - p, m), np.repeat(p * (1 - p), m)
            node, splits = np.zeros(n, np.int64), []
            for level in range(self.depth):
                k = 1 << level
                at = (node[:, None] * (m * width) + cell).ravel()
                gs, hs = (np.bincount(at, w, k * m * width).reshape(k, m, width).cumsum(2) for w in (g, h))
                total_g, total_h = gs[:, :, -1:], hs[:, :, -1:]
                gain = gs**2 / (hs + self.ridge) + (total_g - gs) ** 2 / (total_h - hs + self.ridge) - total_g**2 / (total_h + self.ridge)
                gain[(hs < self.leaf) | (total_h - hs < self.leaf)] = -1
                best = gain[:, :, :-1].reshape(k, -1).argmax(1)
                feature, cut = best // (width - 1), best % (width - 1)
                none = gain[:, :, :-1].reshape(k, -1).max(1) <= 1e-9
                cut[none] = width  # everything goes left
                splits.append((feature, cut))
                node = node * 2 + (b[np.arange(n), feature[node]] > cut[node])
            k = 1 << self.depth
            gs, hs = np.bincount(node, y - p, k), np.bincount(node, p * (1 - p), k)
            value = self.rate * gs / (hs + self.ridge)
            raw += value[node]
            self.splits.append(splits)
            self.values.append(value)
        return self

    def raw(self, x: np.ndarray) -> np.ndarray:
        b, rows = self._bin(x), np.arange(len(x))
        out = np.full(len(x), self.base)
        for splits, value in zip(self.splits, self.values, strict=True):
            node = np.zeros(len(x), np.int64)
            for feature, cut in splits:
                node = node * 2 + (b[rows, feature[node]] > cut[node])
            out += value[node]
        return out


class Isotonic:
    """The non-decreasing step function nearest to the labels (pool adjacent violators), joined by lines between its blocks."""

    def fit(self, score: np.ndarray, y: np.ndarray) -> Isotonic:
        order = np.argsort(score, kind="stable")
        stack: list[list[float]] = []  # sum of labels, count, sum of scores
        for s, label in zip(score[order].tolist(), y[order].tolist(), strict=True):
            stack.append([label, 1, s])
            while len(stack) > 1 and stack[-2][0] * stack[-1][1] >= stack[-1][0] * stack[-2][1]:
                last = stack.pop()
                stack[-1] = [a + b for a, b in zip(stack[-1], last, strict=True)]
        self.x = np.array([s / n for _, n, s in stack])
        self.y = np.array([a / n for a, n, _ in stack])
        return self

    def __call__(self, score: np.ndarray) -> np.ndarray:
        return np.interp(score, self.x, self.y)
