"""Gradient-boosted trees for two classes, small enough to fit on the driver and to ship to workers."""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np

BINS = 32


@dataclass
class BoostedTrees:
    """Depth-limited trees on binned features, fitted to the logistic loss by second-order gains."""

    rounds: int = 60
    depth: int = 3
    rate: float = 0.2
    least: float = 1.0
    trees: list[list[tuple[int, float, int, int, float]]] = field(default_factory=list)
    base: float = 0.0

    def fit(self, x: np.ndarray, y: np.ndarray) -> BoostedTrees:
        """x: rows by features, without NaN; y: 0 or 1. With one class or no rows it predicts that share."""
        self.trees = []
        n = len(y)
        share = (y.sum() + 0.5) / (n + 1)
        self.base = float(np.log(share / (1 - share)))
        if n == 0 or y.min() == y.max():
            return self
        cuts = [np.unique(np.quantile(c, np.linspace(0, 1, BINS + 1)[1:-1])) for c in x.T]
        binned = np.stack([np.searchsorted(c, v, side="left") for c, v in zip(cuts, x.T)], axis=1)
        score = np.full(n, self.base)
        for _ in range(self.rounds):
            p = 1 / (1 + np.exp(-score))
            tree: list[tuple[int, float, int, int, float]] = []
            step = np.zeros(n)
            self._grow(tree, binned, cuts, y - p, p * (1 - p), np.arange(n), 0, step)
            self.trees.append(tree)
            score += step
        return self

    def _grow(self, tree, binned, cuts, grad, hess, rows, depth, step) -> int:
        at = len(tree)
        g, h = grad[rows].sum(), hess[rows].sum()
        value = self.rate * g / (h + 1)
        tree.append((-1, 0.0, 0, 0, float(value)))
        best = (1e-6, -1, 0)
        if depth < self.depth and len(rows) > 1:
            for f in range(binned.shape[1]):
                size = len(cuts[f]) + 1
                if size < 2:
                    continue
                b = binned[rows, f]
                gl = np.cumsum(np.bincount(b, grad[rows], size))[:-1]
                hl = np.cumsum(np.bincount(b, hess[rows], size))[:-1]
                ok = (hl >= self.least) & (h - hl >= self.least)
                gain = np.where(ok, gl**2 / (hl + 1) + (g - gl) ** 2 / (h - hl + 1) - g * g / (h + 1), 0)
                k = int(gain.argmax())
                if gain[k] > best[0]:
                    best = (float(gain[k]), f, k)
        if best[1] < 0:
            step[rows] = value
            return at
        _, f, k = best
        left = binned[rows, f] <= k
        a = self._grow(tree, binned, cuts, grad, hess, rows[left], depth + 1, step)
        b = self._grow(tree, binned, cuts, grad, hess, rows[~left], depth + 1, step)
        tree[at] = (f, float(cuts[f][k]), a, b, 0.0)
        return at

    def predict(self, x: np.ndarray) -> np.ndarray:
        """The probability of class 1 of every row."""
        score = np.full(len(x), self.base)
        for tree in self.trees:
            f = np.array([t[0] for t in tree])
            cut = np.array([t[1] for t in tree])
            kids = np.array([[t[2], t[3]] for t in tree])
            value = np.array([t[4] for t in tree])
            at = np.zeros(len(x), int)
            for _ in range(self.depth):
                inner = f[at] >= 0
                right = x[np.arange(len(x)), np.maximum(f[at], 0)] > cut[at]
                at = np.where(inner, kids[at, right.astype(int)], at)
            score += value[at]
        return 1 / (1 + np.exp(-score))
