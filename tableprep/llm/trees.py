"""Histogram decision trees in numpy: boosted (logistic loss, optional monotonic
constraints) and bagged.  Trained models are flat node arrays, walked for all rows at once.

Training takes a bounded feature matrix; what bounds it is the callers' ``max_rows``.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np


@dataclass
class Forest:
    """Nodes of all trees in one set of arrays; a leaf points at itself."""

    roots: np.ndarray
    feature: np.ndarray
    threshold: np.ndarray
    left: np.ndarray
    right: np.ndarray
    value: np.ndarray
    depth: int
    base: float = 0.0

    def sums(self, x: np.ndarray) -> np.ndarray:
        """base + the sum of leaf values over all trees, row by row."""
        rows, total = np.arange(len(x)), np.full(len(x), self.base)
        for root in self.roots:
            node = np.full(len(x), root)
            for _ in range(self.depth):
                low = x[rows, self.feature[node]] <= self.threshold[node]
                node = np.where(low, self.left[node], self.right[node])
            total += self.value[node]
        return total

    def probability(self, x: np.ndarray) -> np.ndarray:
        return 1.0 / (1.0 + np.exp(-self.sums(x)))

    def mean(self, x: np.ndarray) -> np.ndarray:
        return self.sums(x) / max(1, len(self.roots))


def bin_edges(x: np.ndarray, bins: int) -> list[np.ndarray]:
    """Cut points of each feature, midway between neighbouring distinct quantiles."""
    out = []
    for j in range(x.shape[1]):
        q = np.unique(np.quantile(x[:, j], np.linspace(0, 1, bins + 1), method="nearest")) if len(x) else np.zeros(0)
        out.append((q[:-1] + q[1:]) / 2)
    return out


def to_bins(x: np.ndarray, edges: list[np.ndarray]) -> np.ndarray:
    return np.stack([np.searchsorted(e, x[:, j], "left") for j, e in enumerate(edges)], 1).astype(np.int64) if len(edges) else np.zeros((len(x), 0), np.int64)


class _Grower:
    def __init__(self):
        self.feature, self.threshold, self.left, self.right, self.value, self.roots = [], [], [], [], [], []

    def node(self, value: float) -> int:
        i = len(self.feature)
        self.feature.append(0)
        self.threshold.append(0.0)
        self.left.append(i)
        self.right.append(i)
        self.value.append(value)
        return i

    def grow(self, binned, edges, g, h, depth, penalty, least, monotone, columns, rate=1.0):
        """One tree on gradients ``g`` and weights ``h``; returns each row's leaf value."""
        width = max((len(e) for e in edges), default=0) + 1
        out = np.zeros(len(g))
        weight = lambda a, b, lo, hi: float(np.clip(-a / (b + penalty), lo, hi))
        root = self.node(rate * weight(g.sum(), h.sum(), -np.inf, np.inf))
        self.roots.append(root)
        todo = [(root, np.flatnonzero(h > 0), -np.inf, np.inf, 0)]
        while todo:
            node, rows, lo, hi, level = todo.pop()
            a, b = g[rows], h[rows]
            out[rows] = self.value[node]
            if level == depth or len(rows) < 2:
                continue
            best = (1e-9, -1, 0, 0.0, 0.0)
            total_a, total_b = a.sum(), b.sum()
            whole = total_a * total_a / (total_b + penalty)
            for j in columns():
                if not len(edges[j]):
                    continue
                k = binned[rows, j]
                ga = np.cumsum(np.bincount(k, a, width))[:-1]
                hb = np.cumsum(np.bincount(k, b, width))[:-1]
                ok = (hb >= least) & (total_b - hb >= least)
                if not ok.any():
                    continue
                with np.errstate(divide="ignore", invalid="ignore"):
                    wl, wr = np.clip(-ga / (hb + penalty), lo, hi), np.clip(-(total_a - ga) / (total_b - hb + penalty), lo, hi)
                    gain = ga * ga / (hb + penalty) + (total_a - ga) ** 2 / (total_b - hb + penalty) - whole
                if monotone[j]:
                    ok &= monotone[j] * (wr - wl) >= 0
                gain = np.where(ok, gain, -np.inf)
                c = int(np.argmax(gain))
                if gain[c] > best[0]:
                    best = (float(gain[c]), j, c, float(wl[c]), float(wr[c]))
            _, j, c, wl, wr = best
            if j < 0:
                continue
            mid = (wl + wr) / 2
            bounds = {1: ((lo, mid), (mid, hi)), -1: ((mid, hi), (lo, mid)), 0: ((lo, hi), (lo, hi))}[monotone[j]]
            low = binned[rows, j] <= c
            self.feature[node], self.threshold[node] = j, float(edges[j][c])
            self.left[node], self.right[node] = self.node(rate * wl), self.node(rate * wr)
            todo += [(self.left[node], rows[low], *bounds[0], level + 1), (self.right[node], rows[~low], *bounds[1], level + 1)]
        return out

    def forest(self, depth: int, base: float) -> Forest:
        return Forest(np.array(self.roots, np.int64), np.array(self.feature, np.int64), np.array(self.threshold), np.array(self.left, np.int64),
                      np.array(self.right, np.int64), np.array(self.value), depth, base)


def boost(x: np.ndarray, y: np.ndarray, trees: int = 60, depth: int = 4, rate: float = 0.15, bins: int = 64, penalty: float = 1.0,
          least: float = 1.0, monotone: dict[int, int] | None = None) -> Forest:
    """Gradient-boosted trees for 0/1 labels.  ``monotone``: feature -> +1 (score may only rise with it) or -1.
    With no rows, or one class only, the score is constant."""
    signs = [(monotone or {}).get(j, 0) for j in range(x.shape[1])]
    # smoothed by one row, so that a single class gives a finite base
    p = (y.sum() + 0.5) / (len(y) + 1.0)
    base, grower = float(np.log(p / (1 - p))), _Grower()
    if 0 < y.sum() < len(y):
        edges = bin_edges(x, bins)
        binned, f = to_bins(x, edges), np.full(len(y), base)
        every = list(range(x.shape[1]))
        for _ in range(trees):
            q = 1.0 / (1.0 + np.exp(-f))
            f += grower.grow(binned, edges, q - y, np.maximum(q * (1 - q), 1e-6), depth, penalty, least, signs, lambda: every, rate)
    return grower.forest(depth, base)


def bag(x: np.ndarray, y: np.ndarray, trees: int = 60, depth: int = 10, bins: int = 64, least: float = 2.0, seed: int = 7) -> Forest:
    """Random forest for 0/1 labels: a bootstrap of the rows for each tree, a third of the features at each split.
    ``mean`` of the result is the share of positives."""
    rng, grower, n = np.random.default_rng(seed), _Grower(), x.shape[1]
    if not len(y):
        return grower.forest(depth, 0.0)
    edges = bin_edges(x, bins)
    binned, some = to_bins(x, edges), max(1, n // 3)
    for _ in range(trees):
        times = np.bincount(rng.integers(0, len(y), len(y)), minlength=len(y)).astype(float)
        grower.grow(binned, edges, -y * times, times, depth, 1e-9, least, [0] * n, lambda: rng.choice(n, some, replace=False))
    return grower.forest(depth, 0.0)
