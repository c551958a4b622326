"""Gradient-boosted regression trees on the logistic loss, for small feature tables."""

from __future__ import annotations

import numpy as np


class BoostedTrees:
    """Depth-limited trees over quantile bins, second-order leaf values, fixed shrinkage.

    The model is a few kilobytes whatever it was trained on, so tasks may carry it.
    """

    def __init__(self, rounds: int = 60, depth: int = 3, rate: float = 0.2, bins: int = 24, ridge: float = 1.0):
        self.rounds, self.depth, self.rate, self.bins, self.ridge = rounds, depth, rate, bins, ridge

    def fit(self, x: np.ndarray, y: np.ndarray) -> "BoostedTrees":
        levels = np.linspace(0, 1, self.bins + 1)[1:-1]
        self.edges = [np.unique(np.quantile(column, levels)) for column in x.T]
        binned = self._binned(x)
        mean = float(np.clip(y.mean(), 1e-3, 1 - 1e-3))
        self.start = float(np.log(mean / (1 - mean)))
        margin, self.trees = np.full(len(y), self.start), []
        for _ in range(self.rounds):
            p = 1 / (1 + np.exp(-margin))
            tree: dict[int, tuple] = {}
            self._grow(tree, 1, binned, p - y, p * (1 - p), np.arange(len(y)), margin)
            self.trees.append(tree)
        return self

    def _binned(self, x: np.ndarray) -> np.ndarray:
        return np.stack([np.searchsorted(e, c, side="left") for e, c in zip(self.edges, x.T)], axis=1)

    def _grow(self, tree, node, binned, slope, curve, rows, margin):
        g, h = slope[rows].sum(), curve[rows].sum()
        best, base = None, g * g / (h + self.ridge)
        if node < 2**self.depth and len(rows) >= 20:
            for f, edges in enumerate(self.edges):
                n = len(edges) + 1
                gs = np.bincount(binned[rows, f], slope[rows], n).cumsum()[:-1]
                hs = np.bincount(binned[rows, f], curve[rows], n).cumsum()[:-1]
                if not len(gs):
                    continue
                gain = gs**2 / (hs + self.ridge) + (g - gs) ** 2 / (h - hs + self.ridge) - base
                k = int(gain.argmax())
                if gain[k] > 1e-3 and (best is None or gain[k] > best[0]):
                    best = (gain[k], f, k)
        if best is None:
            value = -self.rate * g / (h + self.ridge)
            tree[node] = (value,)
            margin[rows] += value
            return
        _, f, k = best
        tree[node] = (f, k)
        left = binned[rows, f] <= k
        self._grow(tree, 2 * node, binned, slope, curve, rows[left], margin)
        self._grow(tree, 2 * node + 1, binned, slope, curve, rows[~left], margin)

    def predict(self, x: np.ndarray) -> np.ndarray:
        """Probability of the positive class."""
        if not len(x):
            return np.zeros(0)
        binned, margin = self._binned(x), np.full(len(x), self.start)
        for tree in self.trees:
            at = np.ones(len(x), dtype=int)
            for node in sorted(tree):
                rows = np.flatnonzero(at == node)
                if len(tree[node]) == 1:
                    margin[rows] += tree[node][0]
                else:
                    f, k = tree[node]
                    at[rows] = 2 * node + (binned[rows, f] > k)
        return 1 / (1 + np.exp(-margin))
