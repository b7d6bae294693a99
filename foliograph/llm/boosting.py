"""Gradient-boosted regression trees for two classes, small enough to travel with a task."""

from __future__ import annotations

import math

import numpy as np


class Boosted:
    """Logistic boosting of shallow trees over quantile-binned features."""

    def __init__(self, trees: int = 60, depth: int = 3, rate: float = 0.2, bins: int = 24, least: float = 2.0) -> None:
        self.n_trees, self.depth, self.rate, self.bins, self.least = trees, depth, rate, bins, least
        self.trees: list[list[tuple[int, float, float]]] = []
        self.start = 0.0

    def fit(self, x: np.ndarray, y: np.ndarray) -> Boosted:
        """Learns from rows x with labels y in {0, 1}; one class only gives a constant."""
        x, y = np.asarray(x, float), np.asarray(y, float)
        p = np.clip(y.mean() if len(y) else 0.0, 1e-4, 1 - 1e-4)
        self.start = float(np.log(p / (1 - p)))
        if not len(y) or y.min() == y.max():
            return self
        cuts = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, self.bins + 1)[1:-1])) for j in range(x.shape[1])]
        raw = np.full(len(y), self.start)
        for _ in range(self.n_trees):
            p = 1 / (1 + np.exp(-raw))
            tree = self._grow(x, p - y, p * (1 - p), cuts)
            self.trees.append(tree)
            raw += self._walk(tree, x)
        return self

    def _grow(self, x: np.ndarray, g: np.ndarray, h: np.ndarray, cuts: list[np.ndarray]) -> list[tuple[int, float, float]]:
        """Nodes in heap order as (feature or -1, cut, value)."""
        tree: list[tuple[int, float, float]] = [(-1, 0.0, 0.0)] * (2 ** (self.depth + 1) - 1)
        rows = {0: np.arange(len(g))}
        for node in range(len(tree)):
            if node not in rows:
                continue
            r = rows.pop(node)
            gs, hs = g[r].sum(), h[r].sum()
            value = float(-self.rate * gs / (hs + 1))
            tree[node] = (-1, 0.0, value)
            if 2 * node + 2 >= len(tree) or len(r) < 4:
                continue
            best = (1e-6, -1, 0.0)
            for j, edges in enumerate(cuts):
                if not len(edges):
                    continue
                k = np.searchsorted(edges, x[r, j], side="left")
                gl = np.cumsum(np.bincount(k, g[r], len(edges) + 1))[:-1]
                hl = np.cumsum(np.bincount(k, h[r], len(edges) + 1))[:-1]
                gain = gl**2 / (hl + 1) + (gs - gl) ** 2 / (hs - hl + 1) - gs**2 / (hs + 1)
                gain[(hl < self.least / 8) | (hs - hl < self.least / 8)] = 0
                i = int(gain.argmax())
                if gain[i] > best[0]:
                    best = (float(gain[i]), j, float(edges[i]))
            if best[1] >= 0:
                tree[node] = (best[1], best[2], value)
                left = x[r, best[1]] <= best[2]
                rows[2 * node + 1], rows[2 * node + 2] = r[left], r[~left]
        return tree

    def _walk(self, tree: list[tuple[int, float, float]], x: np.ndarray) -> np.ndarray:
        at = np.zeros(len(x), int)
        feature, cut, value = (np.array(c) for c in zip(*tree))
        for _ in range(self.depth):
            f = feature[at]
            inner = f >= 0
            right = x[np.arange(len(x)), np.maximum(f, 0)] > cut[at]
            at = np.where(inner, 2 * at + 1 + right, at)
        return value[at]

    def _one(self, row) -> float:
        raw = self.start
        for tree in self.trees:
            at = 0
            feature, cut, value = tree[0]
            while feature >= 0:
                at = 2 * at + (2 if row[feature] > cut else 1)
                feature, cut, value = tree[at]
            raw += value
        return 1 / (1 + math.exp(-raw))

    def predict(self, x: np.ndarray) -> np.ndarray:
        """Probability of class 1."""
        if len(x) <= 32:  # a few rows cost less without arrays
            return np.array([self._one(row) for row in x])
        x = np.asarray(x, float)
        raw = np.full(len(x), self.start)
        for tree in self.trees:
            raw += self._walk(tree, x)
        return 1 / (1 + np.exp(-raw))
