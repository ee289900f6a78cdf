"""Histogram decision trees: bagged classifiers and gradient boosting, trained on a bounded sample on
the driver (numpy only) and applied vectorised on the executors."""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np

BINS = 64


@dataclass
class Tree:
    feature: list[int] = field(default_factory=list)
    threshold: list[float] = field(default_factory=list)
    left: list[int] = field(default_factory=list)
    right: list[int] = field(default_factory=list)
    value: list[float] = field(default_factory=list)

    def add(self, value: float) -> int:
        for column, x in ((self.feature, -1), (self.threshold, 0.0), (self.left, -1), (self.right, -1), (self.value, value)):
            column.append(x)
        return len(self.value) - 1

    def predict(self, x: np.ndarray) -> np.ndarray:
        at = np.zeros(len(x), int)
        feature, threshold, left, right = (np.array(c) for c in (self.feature, self.threshold, self.left, self.right))
        while True:
            inner = feature[at] >= 0
            if not inner.any():
                return np.array(self.value)[at]
            rows = np.flatnonzero(inner)
            node = at[rows]
            at[rows] = np.where(x[rows, feature[node]] <= threshold[node], left[node], right[node])


def _edges(x: np.ndarray) -> list[np.ndarray]:
    return [np.unique(np.quantile(x[:, j], np.linspace(0, 1, BINS + 1)[1:-1])) for j in range(x.shape[1])]


def _binned(x: np.ndarray, edges: list[np.ndarray]) -> np.ndarray:
    return np.stack([np.searchsorted(e, x[:, j], "left") for j, e in enumerate(edges)], 1)


def grow(bins: np.ndarray, edges: list[np.ndarray], g: np.ndarray, h: np.ndarray, depth: int, least: float, penalty: float) -> Tree:
    """A tree whose leaves hold sum(g) / (sum(h) + penalty), split for the largest gain."""
    tree = Tree()
    width = BINS + 1

    def split(rows: np.ndarray, level: int) -> int:
        sg, sh = g[rows].sum(), h[rows].sum()
        node = tree.add(float(sg / (sh + penalty)))
        if level == depth or sh < 2 * least:
            return node
        best = (1e-9, -1, -1)
        for j in range(bins.shape[1]):
            if not len(edges[j]):
                continue
            b = bins[rows, j]
            gl, hl = np.cumsum(np.bincount(b, g[rows], width))[:-1], np.cumsum(np.bincount(b, h[rows], width))[:-1]
            gain = gl**2 / (hl + penalty + 1e-12) + (sg - gl) ** 2 / (sh - hl + penalty + 1e-12) - sg**2 / (sh + penalty + 1e-12)
            gain[(hl < least) | (sh - hl < least)] = 0
            k = int(np.argmax(gain[: len(edges[j])]))
            if gain[k] > best[0]:
                best = (gain[k], j, k)
        if best[1] < 0:
            return node
        _, j, k = best
        goes = bins[rows, j] <= k
        tree.feature[node], tree.threshold[node] = j, float(edges[j][k])
        tree.left[node], tree.right[node] = split(rows[goes], level + 1), split(rows[~goes], level + 1)
        return node

    split(np.arange(len(g)), 0)
    return tree


@dataclass
class BaggedTrees:
    """Trees on bootstrap samples; the score is the mean share of positives in the leaves."""

    trees: list[Tree]

    @classmethod
    def fit(cls, x: np.ndarray, y: np.ndarray, count: int = 25, depth: int = 6, seed: int = 7) -> BaggedTrees:
        edges = _edges(x)
        bins, rng = _binned(x, edges), np.random.default_rng(seed)
        trees = []
        for _ in range(count):
            w = rng.poisson(1.0, len(y)).astype(float)
            trees.append(grow(bins, edges, w * y, w, depth, 5.0, 1e-9))
        return cls(trees)

    def score(self, x: np.ndarray) -> np.ndarray:
        return np.mean([t.predict(x) for t in self.trees], 0) if len(x) else np.zeros(0)


@dataclass
class BoostedTrees:
    """Gradient boosting with logistic loss."""

    trees: list[Tree]
    bias: float
    rate: float

    @classmethod
    def fit(cls, x: np.ndarray, y: np.ndarray, weights: np.ndarray | None = None, rounds: int = 60, depth: int = 4, rate: float = 0.2) -> BoostedTrees:
        w = np.ones(len(y)) if weights is None else weights
        p = np.clip(np.average(y, weights=w), 1e-3, 1 - 1e-3)
        model = cls([], float(np.log(p / (1 - p))), rate)
        edges = _edges(x)
        bins, f = _binned(x, edges), np.full(len(y), model.bias)
        for _ in range(rounds):
            q = 1 / (1 + np.exp(-f))
            tree = grow(bins, edges, w * (y - q), w * np.maximum(q * (1 - q), 1e-6), depth, 2.0, 1.0)
            model.trees.append(tree)
            f = f + rate * tree.predict(x)
        return model

    def score(self, x: np.ndarray) -> np.ndarray:
        f = np.full(len(x), self.bias)
        for t in self.trees:
            f = f + self.rate * t.predict(x)
        return 1 / (1 + np.exp(-f))
