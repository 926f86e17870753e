"""Gradient-boosted regression trees for a logistic loss, in numpy; for models of a few features and bounded samples."""

from __future__ import annotations

import numpy as np


class Boosted:
    """Additive trees fitted on gradients of the log loss; `score` gives probabilities."""

    def __init__(self, trees: int = 60, depth: int = 3, rate: float = 0.2, bins: int = 24, least: int = 8) -> None:
        self.size, self.depth, self.rate, self.bins, self.least = trees, depth, rate, bins, least
        self.base, self.trees = 0.0, []

    def fit(self, x: np.ndarray, y: np.ndarray) -> Boosted:
        share = min(max(float(y.mean()), 1e-3), 1 - 1e-3)
        self.base = float(np.log(share / (1 - share)))
        cuts = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, self.bins + 1)[1:-1])) for j in range(x.shape[1])]
        f = np.full(len(y), self.base)
        for _ in range(self.size):
            p = 1 / (1 + np.exp(-f))
            tree = self._grow(x, y - p, p * (1 - p), np.arange(len(y)), cuts, self.depth)
            self.trees.append(tree)
            f += self.rate * self._walk(tree, x)
        return self

    def _grow(self, x, g, h, rows, cuts, depth):
        value = float(g[rows].sum() / (h[rows].sum() + 1.0))
        if depth == 0 or len(rows) < 2 * self.least:
            return value
        total_g, total_h, best = g[rows].sum(), h[rows].sum(), (1e-6, None)
        for j, at in enumerate(cuts):
            if not len(at):
                continue
            k = np.searchsorted(at, x[rows, j], side="left")
            n = np.cumsum(np.bincount(k, minlength=len(at) + 1))[:-1]
            a = np.cumsum(np.bincount(k, g[rows], len(at) + 1))[:-1]
            b = np.cumsum(np.bincount(k, h[rows], len(at) + 1))[:-1]
            gain = a * a / (b + 1) + (total_g - a) ** 2 / (total_h - b + 1) - total_g**2 / (total_h + 1)
            gain[(n < self.least) | (len(rows) - n < self.least)] = -1
            i = int(gain.argmax())
            if gain[i] > best[0]:
                best = (gain[i], (j, float(at[i])))
        if best[1] is None:
            return value
        j, at = best[1]
        left = x[rows, j] <= at
        return (j, at, self._grow(x, g, h, rows[left], cuts, depth - 1), self._grow(x, g, h, rows[~left], cuts, depth - 1))

    def _walk(self, tree, x: np.ndarray) -> np.ndarray:
        if not isinstance(tree, tuple):
            return np.full(len(x), tree)
        j, at, low, high = tree
        left = x[:, j] <= at
        out = np.empty(len(x))
        out[left], out[~left] = self._walk(low, x[left]), self._walk(high, x[~left])
        return out

    def score(self, x: np.ndarray) -> np.ndarray:
        f = np.full(len(x), self.base)
        for tree in self.trees:
            f += self.rate * self._walk(tree, x)
        return 1 / (1 + np.exp(-f))
