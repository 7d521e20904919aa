"""Gradient-boosted trees for a yes-or-no decision, on small dense feature matrices."""

from __future__ import annotations

import numpy as np


class BoostedTrees:
    """Logistic boosting of shallow trees over features cut at quantiles; every step is deterministic."""

    def __init__(self, rounds: int = 40, depth: int = 3, rate: float = 0.3, bins: int = 32, least: float = 1.0) -> None:
        self.rounds, self.depth, self.rate, self.bins, self.least = rounds, depth, rate, bins, least
        self.base, self.trees = 0.0, []
        self.threshold = 0.5

    def _cut(self, x: np.ndarray) -> np.ndarray:
        return np.stack([np.searchsorted(c, x[:, j], "left") for j, c in enumerate(self.cuts)], 1)

    def fit(self, x: np.ndarray, y: np.ndarray) -> BoostedTrees:
        """Fits on rows ``x`` with labels ``y`` of 0 and 1; one class alone gives a constant."""
        share = float(np.clip(y.mean() if len(y) else 0.5, 1e-3, 1 - 1e-3))
        self.base = float(np.log(share / (1 - share)))
        self.cuts = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, self.bins)))[:-1] if len(x) else np.zeros(0) for j in range(x.shape[1])]
        binned = self._cut(x)
        score = np.full(len(y), self.base)
        for _ in range(self.rounds if 0 < y.sum() < len(y) else 0):
            p = 1 / (1 + np.exp(-score))
            grad, hess = y - p, np.maximum(p * (1 - p), 1e-6)
            nodes = np.zeros(len(y), np.int64)
            tree = []
            for _ in range(self.depth):
                level = {}
                for node in np.unique(nodes):
                    rows = nodes == node
                    split = self._split(binned[rows], grad[rows], hess[rows])
                    if split:
                        level[int(node)] = split
                tree.append(level)
                nodes = self._go(binned, nodes, level)
            size = 1 << self.depth
            g, h = np.bincount(nodes, grad, size), np.bincount(nodes, hess, size)
            leaf = self.rate * g / (h + self.least)
            self.trees.append((tree, leaf))
            score += leaf[nodes]
        return self

    def _split(self, b: np.ndarray, g: np.ndarray, h: np.ndarray) -> tuple[int, int] | None:
        best, found = 1e-4, None
        total_g, total_h = g.sum(), h.sum()
        whole = total_g**2 / (total_h + self.least)
        for j in range(b.shape[1]):
            n = len(self.cuts[j])
            if not n:
                continue
            left_g, left_h = np.cumsum(np.bincount(b[:, j], g, n + 1))[:-1], np.cumsum(np.bincount(b[:, j], h, n + 1))[:-1]
            gain = left_g**2 / (left_h + self.least) + (total_g - left_g) ** 2 / (total_h - left_h + self.least) - whole
            k = int(np.argmax(gain))
            if gain[k] > best:
                best, found = gain[k], (j, k)
        return found

    @staticmethod
    def _go(binned: np.ndarray, nodes: np.ndarray, level: dict[int, tuple[int, int]]) -> np.ndarray:
        out = nodes * 2
        for node, (j, k) in level.items():
            rows = nodes == node
            out[rows] += binned[rows, j] > k
        return out

    def probability(self, x: np.ndarray) -> np.ndarray:
        binned = self._cut(x)
        score = np.full(len(x), self.base)
        for tree, leaf in self.trees:
            nodes = np.zeros(len(x), np.int64)
            for level in tree:
                nodes = self._go(binned, nodes, level)
            score += leaf[nodes]
        return 1 / (1 + np.exp(-score))

    def calibrate(self, x: np.ndarray, y: np.ndarray) -> BoostedTrees:
        """Sets ``threshold`` to the middle of the probabilities with the best F1 on held-out rows."""
        if len(y) and 0 < y.sum() < len(y):
            p = self.probability(x)
            order = np.argsort(-p, kind="stable")
            hits = np.cumsum(y[order])
            f1 = 2 * hits / (np.arange(1, len(y) + 1) + y.sum())
            k = int(np.argmax(np.round(f1, 9)))
            below = p[order[k + 1]] if k + 1 < len(y) else 0.0
            self.threshold = float(np.clip((p[order[k]] + below) / 2, 0.05, 0.95))
        return self
