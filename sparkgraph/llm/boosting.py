"""Gradient-boosted trees for two classes, in NumPy: binned features, level-wise trees, logistic loss."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np


@dataclass(frozen=True)
class Trees:
    """Complete binary trees; ``feature`` and ``cut`` by tree and inner node, ``value`` by tree and leaf."""

    base: float
    feature: np.ndarray
    cut: np.ndarray
    value: np.ndarray

    def margin(self, x: np.ndarray) -> np.ndarray:
        """The log-odds of each row."""
        out = np.full(len(x), self.base)
        rows = np.arange(len(x))
        levels = int(np.log2(self.value.shape[1]))
        for feature, cut, value in zip(self.feature, self.cut, self.value, strict=True):
            at = np.zeros(len(x), np.int64)
            for _ in range(levels):
                at = 2 * at + 1 + (x[rows, feature[at]] > cut[at])
            out += value[at - len(feature)]
        return out


def fit(x: np.ndarray, y: np.ndarray, n_trees: int = 60, depth: int = 4, rate: float = 0.25, n_bins: int = 32, l2: float = 2.0, least: float = 1.0) -> Trees:
    """Fit to rows ``x`` (floats) and classes ``y`` (0 or 1)."""
    n, width = x.shape
    cuts = [np.unique(np.quantile(x[:, f], np.linspace(0, 1, n_bins + 1)[1:-1])) for f in range(width)]
    binned = np.stack([np.searchsorted(c, x[:, f], "left") for f, c in enumerate(cuts)], axis=1)
    share = min(max(float(y.mean()), 1e-3), 1 - 1e-3)
    base = float(np.log(share / (1 - share)))
    margin = np.full(n, base)
    inner = (1 << depth) - 1
    features, thresholds, values = [], [], []
    for _ in range(n_trees):
        p = 1 / (1 + np.exp(-margin))
        g, h = p - y, p * (1 - p)
        at = np.zeros(n, np.int64)
        feature, cut = np.zeros(inner, np.int64), np.full(inner, np.inf)
        for level in range(depth):
            first, count = (1 << level) - 1, 1 << level
            node = at - first
            gain = np.zeros(count)
            pick = np.full((count, 2), -1)
            for f in range(width):
                if not len(cuts[f]):
                    continue
                size = len(cuts[f]) + 1
                place = node * size + binned[:, f]
                gs = np.bincount(place, g, count * size).reshape(count, size).cumsum(1)
                hs = np.bincount(place, h, count * size).reshape(count, size).cumsum(1)
                gt, ht = gs[:, -1:], hs[:, -1:]
                gl, hl = gs[:, :-1], hs[:, :-1]
                score = gl**2 / (hl + l2) + (gt - gl) ** 2 / (ht - hl + l2) - gt**2 / (ht + l2)
                score[(hl < least) | (ht - hl < least)] = 0
                best = score.argmax(1)
                value = score[np.arange(count), best]
                better = value > gain
                gain[better] = value[better]
                pick[better, 0], pick[better, 1] = f, best[better]
            right = np.zeros(n, np.int64)
            for k in np.flatnonzero(pick[:, 0] >= 0):
                f, b = pick[k]
                feature[first + k], cut[first + k] = f, cuts[f][b]
                mine = node == k
                right[mine] = binned[mine, f] > b
            at = 2 * at + 1 + right
        leaf = at - inner
        gs, hs = np.bincount(leaf, g, inner + 1), np.bincount(leaf, h, inner + 1)
        value = -rate * gs / (hs + l2)
        margin += value[leaf]
        features.append(feature)
        thresholds.append(cut)
        values.append(value)
    return Trees(base, np.array(features), np.array(thresholds), np.array(values))
