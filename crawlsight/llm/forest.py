"""A small random forest on numbers, fitted on a bounded table and applied inside tasks."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np


@dataclass
class Forest:
    """Trees as arrays: feature (-1 at a leaf), threshold, children and share of label 1."""

    trees: list[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]

    def probabilities(self, x: np.ndarray) -> np.ndarray:
        total = np.zeros(len(x))
        for feature, threshold, child, share in self.trees:
            at = np.zeros(len(x), np.int64)
            while (inner := feature[at] >= 0).any():
                rows = np.flatnonzero(inner)
                right = x[rows, feature[at[rows]]] > threshold[at[rows]]
                at[rows] = child[at[rows]] + right
            total += share[at]
        return total / max(len(self.trees), 1)


def _split(x: np.ndarray, y: np.ndarray, features: np.ndarray) -> tuple[int, float] | None:
    """The feature and threshold that lower Gini impurity most."""
    n, ones = len(y), y.sum()
    best, found = 1e-9, None
    parent = n - (ones ** 2 + (n - ones) ** 2) / n
    for f in features:
        order = np.argsort(x[:, f], kind="stable")
        values, left = x[order, f], np.cumsum(y[order])[:-1]
        k = np.arange(1, n)
        gini = n - (left ** 2 + (k - left) ** 2) / k - ((ones - left) ** 2 + (n - k - ones + left) ** 2) / (n - k)
        gain = np.where(values[1:] > values[:-1], parent - gini, 0)
        i = int(gain.argmax()) if len(gain) else 0
        if len(gain) and gain[i] > best:
            best, found = float(gain[i]), (int(f), float(values[i] + values[i + 1]) / 2)
    return found


def grow(x: np.ndarray, y: np.ndarray, trees: int = 40, depth: int = 10, least: int = 2, seed: int = 11) -> Forest:
    """Bootstrap trees over random thirds of the features; without rows none, so every share is 0."""
    draw, out = np.random.default_rng(seed), []
    n, width = x.shape
    tried = max(2, width // 3)
    for _ in range(trees if n else 0):
        sample = draw.integers(0, n, n)
        feature, threshold, child, share, todo = [-1], [0.0], [0], [0.0], [(0, sample, 0)]
        while todo:
            node, rows, level = todo.pop()
            share[node] = float(y[rows].mean())
            if level == depth or len(rows) < 2 * least or share[node] in (0.0, 1.0):
                continue
            cut = _split(x[rows], y[rows], draw.choice(width, tried, replace=False))
            if cut is None:
                continue
            feature[node], threshold[node], child[node] = cut[0], cut[1], len(feature)
            right = x[rows, cut[0]] > cut[1]
            for part in (rows[~right], rows[right]):
                todo.append((len(feature), part, level + 1))
                feature.append(-1), threshold.append(0.0), child.append(0), share.append(0.0)
        out.append(tuple(np.array(a) for a in (feature, threshold, child, share)))
    return Forest(out)
