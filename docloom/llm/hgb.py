"""Histogram gradient-boosted trees for two classes, trained with numpy and held as flat arrays.

Features are cut into at most `bins` quantile bins; each level of a tree sums gradients and
hessians per (node, bin) with one bincount per feature. Trees are complete binary trees of a
fixed depth: node i has children 2i+1 and 2i+2, a node that does not split sends every row
left. Scoring walks all trees of all rows at once, one gather per level, with no branches.
Training is deterministic: no sampling, ties go to the first feature and bin.
"""

from __future__ import annotations

import numpy as np


class Trees:
    """`feature`, `threshold`: (trees, inner nodes); `value`: (trees, leaves); `base`: log-odds."""

    def __init__(self, feature, threshold, value, base, depth):
        self.feature, self.threshold, self.value, self.base, self.depth = feature, threshold, value, base, depth

    def raw(self, x: np.ndarray) -> np.ndarray:
        out = np.full(len(x), self.base)
        trees = np.arange(len(self.feature))
        for lo in range(0, len(x), 4096):
            part = x[lo : lo + 4096]
            rows = np.arange(len(part))[:, None]
            at = np.zeros((len(part), len(trees)), np.int64)
            for _ in range(self.depth):
                right = part[rows, self.feature[trees, at]] > self.threshold[trees, at]
                at = 2 * at + 1 + right
            out[lo : lo + 4096] += self.value[trees, at - (2**self.depth - 1)].sum(axis=1)
        return out

    def score(self, x: np.ndarray) -> np.ndarray:
        return 1.0 / (1.0 + np.exp(-np.clip(self.raw(x), -30, 30)))


def fit(x, y, trees: int = 60, depth: int = 4, rate: float = 0.2, bins: int = 48, l2: float = 1.0, min_rows: int = 5) -> Trees:
    """No rows give the constant score 0.5; one class gives its smoothed share."""
    x, y = np.asarray(x, np.float64), np.asarray(y, np.float64)
    share = (y.sum() + 0.5) / (len(y) + 1.0)
    base = float(np.log(share / (1 - share)))
    inner, leaves = 2**depth - 1, 2**depth
    if len(y) == 0 or y.min() == y.max():
        return Trees(np.zeros((0, inner), np.int64), np.zeros((0, inner)), np.zeros((0, leaves)), base, depth)
    n, f = x.shape
    edges = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, bins + 1)[1:-1])) for j in range(f)]
    code = np.stack([np.searchsorted(e, x[:, j], side="left") for j, e in enumerate(edges)])
    raw = np.full(n, base)
    feature, threshold, value = np.zeros((trees, inner), np.int64), np.full((trees, inner), np.inf), np.zeros((trees, leaves))
    for t in range(trees):
        p = 1 / (1 + np.exp(-raw))
        g, h = p - y, p * (1 - p)
        node = np.zeros(n, np.int64)
        for level in range(depth):
            width, first = 2**level, 2**level - 1
            best_gain, best_f, best_b = np.full(width, 1e-9), np.zeros(width, np.int64), np.full(width, -1)
            for j in range(f):
                if not len(edges[j]):
                    continue
                key, size = node * bins + code[j], width * bins
                gl = np.bincount(key, g, size).reshape(width, bins).cumsum(1)
                hl = np.bincount(key, h, size).reshape(width, bins).cumsum(1)
                cl = np.bincount(key, minlength=size).reshape(width, bins).cumsum(1)
                gt, ht, ct = gl[:, -1:], hl[:, -1:], cl[:, -1:]
                gain = gl**2 / (hl + l2) + (gt - gl) ** 2 / (ht - hl + l2) - gt**2 / (ht + l2)
                gain[(cl < min_rows) | (ct - cl < min_rows)] = -1
                gain = gain[:, : len(edges[j])]
                b = gain.argmax(1)
                top = gain[np.arange(width), b]
                better = top > best_gain
                best_gain[better], best_f[better], best_b[better] = top[better], j, b[better]
            split = best_b >= 0
            for k in np.flatnonzero(split):
                feature[t, first + k], threshold[t, first + k] = best_f[k], edges[best_f[k]][best_b[k]]
            right = split[node] & (code[best_f[node], np.arange(n)] > best_b[node])
            node = 2 * node + right
        leaf = -rate * np.bincount(node, g, leaves) / (np.bincount(node, h, leaves) + l2)
        value[t] = leaf
        raw += leaf[node]
    return Trees(feature, threshold, value, base, depth)
