"""Gradient-boosted trees over dense features, and isotonic calibration, in NumPy."""

from __future__ import annotations

import numpy as np


class Boosted:
    """Logistic boosting of histogram trees; made on a bounded sample, applied anywhere."""

    def __init__(self, trees: int = 60, depth: int = 3, rate: float = 0.15, bins: int = 32, least: float = 5.0):
        self.n, self.depth, self.rate, self.bins, self.least = trees, depth, rate, bins, least
        self.base, self.edges, self.trees = 0.0, [], []

    def _binned(self, x: np.ndarray) -> np.ndarray:
        return np.stack([np.searchsorted(e, x[:, j], "left") for j, e in enumerate(self.edges)], 1) if len(self.edges) else np.zeros((len(x), 0), np.int64)

    def fit(self, x: np.ndarray, y: np.ndarray, weight: np.ndarray | None = None) -> Boosted:
        w = np.ones(len(y)) if weight is None else weight
        self.edges = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, self.bins + 1)[1:-1])) for j in range(x.shape[1])] if len(x) else [np.zeros(1)] * x.shape[1]
        rate = (np.sum(w * y) + 1) / (np.sum(w) + 2)
        self.base, self.trees = float(np.log(rate / (1 - rate))), []
        if not len(x) or y.min() == y.max():
            return self
        b, f = self._binned(x), np.full(len(y), self.base)
        for _ in range(self.n):
            p = 1 / (1 + np.exp(-f))
            g, h = w * (y - p), w * p * (1 - p)
            tree, node = [], np.zeros(len(y), np.int64)
            for level in range(self.depth):
                for k in range(2**level):
                    tree.append(self._split(b, g, h, np.flatnonzero(node == k)))
                split = tree[2**level - 1 :]
                feature, cut = np.array([s[0] for s in split]), np.array([s[1] for s in split])
                node = 2 * node + (b[np.arange(len(y)), feature[node]] > cut[node])
            gain, size = np.bincount(node, g, 2**self.depth), np.bincount(node, h, 2**self.depth)
            leaf = self.rate * gain / (size + 1.0)
            self.trees.append((np.array([s[0] for s in tree]), np.array([s[1] for s in tree]), leaf))
            f += leaf[node]
        return self

    def _split(self, b, g, h, rows) -> tuple[int, int]:
        """(feature, last bin on the left) of the best split; everything to the left if none helps."""
        best, out = 1e-9, (0, self.bins)
        if not len(rows):
            return out
        gr, hr = g[rows], h[rows]
        gt, ht = gr.sum(), hr.sum()
        for j in range(b.shape[1]):
            col = b[rows, j]
            gl, hl = np.cumsum(np.bincount(col, gr, self.bins)), np.cumsum(np.bincount(col, hr, self.bins))
            gain = gl**2 / (hl + 1) + (gt - gl) ** 2 / (ht - hl + 1) - gt**2 / (ht + 1)
            gain[(hl < self.least / 10) | (ht - hl < self.least / 10)] = 0
            k = int(np.argmax(gain))
            if gain[k] > best:
                best, out = gain[k], (j, k)
        return out

    def raw(self, x: np.ndarray) -> np.ndarray:
        f = np.full(len(x), self.base)
        if not self.trees:
            return f
        b = self._binned(x)
        row = np.arange(len(x))
        for feature, cut, leaf in self.trees:
            node = np.zeros(len(x), np.int64)
            for level in range(self.depth):
                at = 2**level - 1 + node
                node = 2 * node + (b[row, feature[at]] > cut[at])
            f += leaf[node]
        return f


class Isotonic:
    """Pool adjacent violators; between knots the fit is linear. A trace of the raw score keeps the order inside pools."""

    def fit(self, raw: np.ndarray, y: np.ndarray) -> Isotonic:
        order = np.argsort(raw, kind="stable")
        value, weight, low, high = [], [], [], []
        for s, t in zip(raw[order].tolist(), y[order].tolist()):
            value.append(float(t))
            weight.append(1.0)
            low.append(s)
            high.append(s)
            while len(value) > 1 and (value[-2] >= value[-1] or high[-2] == low[-1]):
                w = weight[-2] + weight[-1]
                value[-2:] = [(value[-2] * weight[-2] + value[-1] * weight[-1]) / w]
                weight[-2:] = [w]
                del low[-1]
                high[-2:] = [high[-1]]
        x, p = [], []
        for v, w, a, b in zip(value, weight, low, high):
            v = (v * w + 0.5) / (w + 1)  # pools of few rows are not certain
            x += [a] if a == b else [a, b]
            p += [v] if a == b else [v, v]
        self.x, self.p = np.array(x or [0.0]), np.maximum.accumulate(np.array(p or [0.5]))
        return self

    def __call__(self, raw: np.ndarray) -> np.ndarray:
        trace = 1 / (1 + np.exp(-np.clip(raw, -30, 30)))
        return np.clip(0.999 * np.interp(raw, self.x, self.p) + 0.001 * trace, 0.0, 1.0)
