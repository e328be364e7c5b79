"""Gradient-boosted trees in numpy: fitting with monotonic constraints, flat node arrays, vectorised scores."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np


@dataclass
class Forest:
    """Every tree is a full binary one of the same depth: node i has the children 2i + 1 and 2i + 2.
    ``feature`` and ``cut`` are (trees, inner nodes), ``value`` is (trees, leaves)."""

    base: float
    feature: np.ndarray
    cut: np.ndarray
    value: np.ndarray

    def score(self, x: np.ndarray) -> np.ndarray:
        """Probability of class 1 for every row."""
        total = np.full(len(x), self.base)
        rows = np.arange(len(x))
        inner = self.feature.shape[1]
        for feature, cut, value in zip(self.feature, self.cut, self.value, strict=True):
            node = np.zeros(len(x), dtype=np.int64)
            for _ in range(inner.bit_length()):
                node = 2 * node + 1 + (x[rows, feature[node]] > cut[node])
            total += value[node - inner]
        return 1 / (1 + np.exp(-total))


def fit(x: np.ndarray, y: np.ndarray, monotone: np.ndarray, trees: int = 60, depth: int = 3, rate: float = 0.2, bins: int = 32, l2: float = 5.0, least: int = 5, weight: np.ndarray | None = None) -> Forest:
    """Logistic boosting on binned features. ``monotone`` has +1, -1 or 0 for each feature: the score never moves
    against that sign as the feature grows. ``weight`` counts rows more or less, 1 on average. One class only, or no rows:
    a constant."""
    n, wide = x.shape if x.ndim == 2 else (0, len(monotone))
    inner = 2**depth - 1
    weight = np.ones(n) if weight is None else weight
    share = ((weight * y).sum() + 1) / (weight.sum() + 2)
    base = float(np.log(share / (1 - share)))
    out = Forest(base, np.zeros((0, inner), np.int64), np.zeros((0, inner)), np.zeros((0, inner + 1)))
    if n == 0 or y.min() == y.max():
        return out
    cuts = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, bins + 1)[1:-1])) for j in range(wide)]
    code = np.stack([np.searchsorted(c, x[:, j], side="left") for j, c in enumerate(cuts)], axis=1)  # code <= k iff x <= cuts[k]
    raw = np.full(n, base)
    made = []
    for _ in range(trees):
        p = 1 / (1 + np.exp(-raw))
        g, h = weight * (y - p), weight * p * (1 - p)
        feature, cut = np.zeros(inner, np.int64), np.full(inner, np.inf)
        rows = {0: np.arange(n)}
        limit = {0: (-np.inf, np.inf)}
        for node in range(inner):
            at, (low, high) = rows[node], limit[node]
            best = (1e-9, None)
            gt, ht = g[at].sum(), h[at].sum()
            for j in range(wide):
                size = len(cuts[j]) + 1
                gl = np.cumsum(np.bincount(code[at, j], g[at], size))[:-1]
                hl = np.cumsum(np.bincount(code[at, j], h[at], size))[:-1]
                nl = np.cumsum(np.bincount(code[at, j], minlength=size))[:-1]
                left, right = np.clip(gl / (hl + l2), low, high), np.clip((gt - gl) / (ht - hl + l2), low, high)
                gain = 2 * (left * gl + right * (gt - gl)) - left**2 * (hl + l2) - right**2 * (ht - hl + l2)
                whole = np.clip(gt / (ht + l2), low, high)
                gain -= 2 * whole * gt - whole**2 * (ht + l2)
                ok = (nl >= least) & (len(at) - nl >= least) & ((right - left) * monotone[j] >= 0)
                if ok.any() and (top := np.where(ok, gain, -np.inf).max()) > best[0]:
                    k = int(np.argmax(np.where(ok, gain, -np.inf)))
                    best = (top, (j, k, left[k], right[k]))
            a, b = 2 * node + 1, 2 * node + 2
            if best[1] is None:
                rows[a], rows[b], limit[a], limit[b] = at, at[:0], (low, high), (low, high)
                continue
            j, k, left, right = best[1]
            feature[node], cut[node] = j, cuts[j][k]
            goes = code[at, j] <= k
            rows[a], rows[b] = at[goes], at[~goes]
            middle = (left + right) / 2
            limit[a] = limit[b] = (low, high)
            if monotone[j] > 0:
                limit[a], limit[b] = (low, middle), (middle, high)
            elif monotone[j] < 0:
                limit[a], limit[b] = (middle, high), (low, middle)
        value = np.zeros(inner + 1)
        for leaf in range(inner + 1):
            at = rows[inner + leaf]
            value[leaf] = rate * np.clip(g[at].sum() / (h[at].sum() + l2), *limit[inner + leaf])
            raw[at] += value[leaf]
        made.append((feature, cut, value))
    return Forest(base, *(np.stack(x) for x in zip(*made, strict=True)))
