"""Histogram gradient-boosted trees on a small matrix of features, flattened into arrays.

A tree of depth d is complete: node i has children 2i + 1 and 2i + 2. `feature` and `cut` hold the inner nodes
of all trees, `leaf` the leaves, so scoring is d array steps a tree for all rows at once. A node that is not
worth splitting keeps an infinite cut: all rows go left.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np


@dataclass(frozen=True)
class Trees:
    feature: np.ndarray  # (trees, inner nodes)
    cut: np.ndarray
    leaf: np.ndarray  # (trees, leaves)
    start: float

    def score(self, x: np.ndarray) -> np.ndarray:
        """Probabilities of label 1."""
        depth, rows = int(np.log2(self.leaf.shape[1])), np.arange(len(x))
        total = np.full(len(x), self.start)
        for feature, cut, leaf in zip(self.feature, self.cut, self.leaf, strict=True):
            node = np.zeros(len(x), np.int64)
            for _ in range(depth):
                node = 2 * node + 1 + (x[rows, feature[node]] > cut[node])
            total += leaf[node - (2**depth - 1)]
        return 1 / (1 + np.exp(-total))


def fit(x: np.ndarray, y: np.ndarray, trees: int = 40, depth: int = 4, rate: float = 0.2, bins: int = 64, least: int = 20, ridge: float = 1.0) -> Trees:
    """Newton boosting of the logistic loss. No rows give a constant score of 1/2."""
    inner, leaves = 2**depth - 1, 2**depth
    n, m = x.shape if len(x) else (0, x.shape[1])
    share = (y.sum() + 0.5) / (n + 1)
    start = float(np.log(share / (1 - share)))
    edges = [np.unique(np.quantile(x[:, f], np.linspace(0, 1, bins + 1)[1:-1])) if n else np.zeros(0) for f in range(m)]
    codes = np.stack([np.searchsorted(e, x[:, f], side="left") for f, e in enumerate(edges)], axis=1) if n else np.zeros((0, m), int)
    features, cuts, values = [], [], []
    total = np.full(n, start)
    for _ in range(trees if n else 0):
        p = 1 / (1 + np.exp(-total))
        g, h = y - p, p * (1 - p)
        feature, cut = np.zeros(inner, np.int64), np.full(inner, np.inf)
        node = np.zeros(n, np.int64)
        for level in range(depth):
            first, width = 2**level - 1, 2**level
            at = node - first
            best = np.full(width, 1e-6)
            for f in range(m):
                size = len(edges[f]) + 1
                cell = at * size + codes[:, f]
                sums = [np.bincount(cell, weights=w, minlength=width * size).reshape(width, size) for w in (g, h, np.ones(n))]
                left = [np.cumsum(s, axis=1)[:, :-1] for s in sums]
                if not left[0].shape[1]:
                    continue
                whole = [s.sum(axis=1, keepdims=True) for s in sums]
                gain = left[0] ** 2 / (left[1] + ridge) + (whole[0] - left[0]) ** 2 / (whole[1] - left[1] + ridge) - whole[0] ** 2 / (whole[1] + ridge)
                gain[(left[2] < least) | (whole[2] - left[2] < least)] = 0
                place = gain.argmax(axis=1)
                top = gain[np.arange(width), place]
                better = top > best
                best[better] = top[better]
                feature[first : first + width][better] = f
                cut[first : first + width][better] = edges[f][place[better]]
            node = 2 * node + 1 + (x[np.arange(n), feature[node]] > cut[node])
        at = node - inner
        value = rate * np.bincount(at, weights=g, minlength=leaves) / (np.bincount(at, weights=h, minlength=leaves) + ridge)
        total += value[at]
        features.append(feature)
        cuts.append(cut)
        values.append(value)
    return Trees(np.array(features, np.int64).reshape(-1, inner), np.array(cuts).reshape(-1, inner), np.array(values).reshape(-1, leaves), start)
