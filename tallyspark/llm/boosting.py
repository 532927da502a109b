"""Histogram gradient-boosted trees for two classes, kept as flat arrays."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np


@dataclass
class BoostedTrees:
    """All trees in one set of arrays: node i splits on `feature[i]` at `threshold[i]` (value <=
    threshold goes to `left[i]`, else to `left[i] + 1`); a leaf has feature -1 and adds `value[i]`."""

    feature: np.ndarray
    threshold: np.ndarray
    left: np.ndarray
    value: np.ndarray
    roots: np.ndarray
    bias: float
    depth: int

    def margins(self, x: np.ndarray) -> np.ndarray:
        """Log odds of class 1 for the rows of x: all rows step down all trees together."""
        node = np.repeat(self.roots[None, :], len(x), axis=0)
        rows = np.arange(len(x))[:, None]
        for _ in range(self.depth):
            f = self.feature[node]
            inner = f >= 0
            down = self.left[node] + (x[rows, np.maximum(f, 0)] > self.threshold[node])
            node = np.where(inner, down, node)
        return self.bias + self.value[node].sum(axis=1)

    def probabilities(self, x: np.ndarray) -> np.ndarray:
        out = np.empty(len(x))
        for at in range(0, len(x), 4096):
            out[at : at + 4096] = 1 / (1 + np.exp(-np.clip(self.margins(x[at : at + 4096]), -30, 30)))
        return out


def fit(x: np.ndarray, y: np.ndarray, weight: np.ndarray | None = None, trees: int = 80, depth: int = 4, rate: float = 0.15, bins: int = 64, l2: float = 1.0, least: float = 5.0) -> BoostedTrees:
    """Fit to the rows of x with classes y (0 or 1). Without rows, or with one class only, the result
    is the constant share of class 1, smoothed by one row of each class."""
    weight = np.ones(len(y)) if weight is None else weight.astype(float)
    positive = (float((weight * y).sum()) + 1) / (float(weight.sum()) + 2)
    bias = float(np.log(positive / (1 - positive)))
    nodes: list[list[float]] = []  # feature, threshold, left, value
    roots: list[int] = []
    if len(y) and 0 < y.mean() < 1:
        edges = [np.unique(np.quantile(x[:, f], np.linspace(0, 1, bins + 1)[1:-1])) for f in range(x.shape[1])]
        binned = np.stack([np.searchsorted(e, x[:, f], side="left") for f, e in enumerate(edges)], axis=1)
        margin = np.full(len(y), bias)
        for _ in range(trees):
            p = 1 / (1 + np.exp(-margin))
            grad, hess = weight * (y - p), weight * p * (1 - p)
            roots.append(len(nodes))
            nodes.append([-1, 0.0, 0, 0.0])
            node = np.full(len(y), len(nodes) - 1)
            frontier = [len(nodes) - 1]
            for level in range(depth + 1):
                following = []
                for n in frontier:
                    own = np.flatnonzero(node == n)
                    g, h = grad[own].sum(), hess[own].sum()
                    nodes[n][3] = rate * g / (h + l2)
                    best = (1e-6, -1, 0)
                    for f in range(x.shape[1]) if level < depth else ():
                        size = len(edges[f]) + 1
                        gl = np.cumsum(np.bincount(binned[own, f], grad[own], size))[:-1]
                        hl = np.cumsum(np.bincount(binned[own, f], hess[own], size))[:-1]
                        wl = np.cumsum(np.bincount(binned[own, f], weight[own], size))[:-1]
                        gain = gl**2 / (hl + l2) + (g - gl) ** 2 / (h - hl + l2) - g**2 / (h + l2)
                        gain[(wl < least) | (weight[own].sum() - wl < least)] = 0
                        if len(gain) and gain.max() > best[0]:
                            best = (float(gain.max()), f, int(np.argmax(gain)))
                    if best[1] >= 0:
                        _, f, b = best
                        nodes[n][:3] = [f, float(edges[f][b]), len(nodes)]
                        node[own] = len(nodes) + (binned[own, f] > b)
                        following += [len(nodes), len(nodes) + 1]
                        nodes += [[-1, 0.0, 0, 0.0], [-1, 0.0, 0, 0.0]]
                frontier = following
            values = np.array([n[3] for n in nodes])
            margin += values[node]
    if not roots:
        roots, nodes = [0], [[-1, 0.0, 0, 0.0]]
    table = np.array(nodes)
    value = np.where(table[:, 0] < 0, table[:, 3], 0.0)
    return BoostedTrees(table[:, 0].astype(np.int64), table[:, 1], table[:, 2].astype(np.int64), value, np.array(roots), bias, depth)
