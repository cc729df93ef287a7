"""Gradient-boosted trees for a binary label, flattened into numpy node arrays, and isotonic calibration.

Models are fitted on the driver over a bounded sample and sent to the tasks as a few small arrays.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np


@dataclass
class Trees:
    """All nodes of all trees in one set of arrays; a leaf is its own child, so a walk of `depth` steps ends in one."""

    base: float
    roots: np.ndarray
    feature: np.ndarray
    threshold: np.ndarray
    left: np.ndarray
    right: np.ndarray
    value: np.ndarray
    depth: int

    def margin(self, x: np.ndarray) -> np.ndarray:
        """The log-odds of label 1 for each row of x: (rows, trees) walk down together, level by level."""
        if not len(x) or not len(self.roots):
            return np.full(len(x), self.base)
        out = np.empty(len(x))
        for at in range(0, len(x), 4096):
            part = x[at : at + 4096]
            node = np.broadcast_to(self.roots, (len(part), len(self.roots)))
            row = np.arange(len(part))[:, None]
            for _ in range(self.depth):
                goes = part[row, self.feature[node]] <= self.threshold[node]
                node = np.where(goes, self.left[node], self.right[node])
            out[at : at + 4096] = self.base + self.value[node].sum(axis=1)
        return out

    def probability(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-self.margin(x)))


def fit(x: np.ndarray, y: np.ndarray, monotone: dict[int, int] | None = None, trees: int = 60, depth: int = 4, rate: float = 0.2, bins: int = 64, least: float = 2.0, l2: float = 1.0) -> Trees:
    """Boosting on the logistic loss with histogram splits. monotone: feature -> 1 or -1, the only direction in which the
    score may follow it: a split that goes against it is refused, and its children are bounded by its midpoint. Without
    rows of both labels the model is a constant (0 for no rows)."""
    n = len(y)
    signs = np.array([(monotone or {}).get(i, 0) for i in range(x.shape[1])])
    share = (y.sum() + 0.5) / (n + 1) if n else 0.5
    nodes: list[list] = []  # feature, threshold, left, right, value
    roots: list[int] = []
    base = float(np.log(share / (1 - share)))
    margin = np.full(n, base)
    cuts = [np.unique(np.quantile(x[:, f], np.linspace(0, 1, bins + 1)[1:-1])) for f in range(x.shape[1])] if n else []
    binned = np.stack([np.searchsorted(c, x[:, f], side="left") for f, c in enumerate(cuts)], axis=1) if n else None

    def leaf(v: float) -> int:
        nodes.append([0, np.inf, len(nodes), len(nodes), v])
        return len(nodes) - 1

    def grow(rows: np.ndarray, g: np.ndarray, h: np.ndarray, low: float, high: float, level: int) -> int:
        sum_g, sum_h = g[rows].sum(), h[rows].sum()
        own = float(np.clip(-sum_g / (sum_h + l2), low, high))
        best = (1e-6, None)
        if level < depth and sum_h >= 2 * least:
            for f, c in enumerate(cuts):
                if not len(c):
                    continue
                b = binned[rows, f]
                lg = np.cumsum(np.bincount(b, g[rows], len(c) + 1))[:-1]
                lh = np.cumsum(np.bincount(b, h[rows], len(c) + 1))[:-1]
                rg, rh = sum_g - lg, sum_h - lh
                wl, wr = np.clip(-lg / (lh + l2), low, high), np.clip(-rg / (rh + l2), low, high)
                gain = lg**2 / (lh + l2) + rg**2 / (rh + l2) - sum_g**2 / (sum_h + l2)
                gain[(lh < least) | (rh < least) | (signs[f] * (wr - wl) < 0)] = -1
                k = int(np.argmax(gain))
                if gain[k] > best[0]:
                    best = (gain[k], (f, k, wl[k], wr[k]))
        if best[1] is None:
            return leaf(rate * own)
        f, k, wl, wr = best[1]
        at, mid = leaf(0.0), (wl + wr) / 2
        goes = binned[rows, f] <= k
        l_high, r_low = (min(high, mid), max(low, mid)) if signs[f] > 0 else (high, low)
        l_low, r_high = (max(low, mid), min(high, mid)) if signs[f] < 0 else (low, high)
        a = grow(rows[goes], g, h, l_low, l_high, level + 1)
        b = grow(rows[~goes], g, h, r_low, r_high, level + 1)
        nodes[at] = [f, float(cuts[f][k]), a, b, 0.0]
        return at

    made = None
    if n and 0 < y.sum() < n:
        for _ in range(trees):
            p = 1 / (1 + np.exp(-margin))
            roots.append(grow(np.arange(n), p - y, p * (1 - p), -np.inf, np.inf, 0))
            made = _flat(base, roots[-1:], nodes, depth)
            margin += made.margin(x) - base
    return _flat(base, roots, nodes, depth)


def _flat(base: float, roots: list[int], nodes: list[list], depth: int) -> Trees:
    f, t, a, b, v = zip(*nodes) if nodes else ((), (), (), (), ())
    return Trees(base, np.array(roots, dtype=np.int32), np.array(f, dtype=np.int32), np.array(t), np.array(a, dtype=np.int32), np.array(b, dtype=np.int32), np.array(v), depth)


@dataclass
class Isotonic:
    """A non-decreasing map from margins to probabilities, linear between the middles of its blocks."""

    at: np.ndarray
    value: np.ndarray

    def __call__(self, margin: np.ndarray) -> np.ndarray:
        if not len(self.at):
            return 1 / (1 + np.exp(-margin))
        return np.clip(np.interp(margin, self.at, self.value), 0.0, 1.0)


def isotonic(margin: np.ndarray, y: np.ndarray) -> Isotonic:
    """Pool adjacent violators; without rows of both labels, the logistic map."""
    if not len(y) or y.min() == y.max():
        return Isotonic(np.array([]), np.array([]))
    order = np.argsort(margin, kind="stable")
    blocks: list[list[float]] = []  # sum of labels, count, sum of margins
    for m, v in zip(margin[order].tolist(), y[order].tolist()):
        blocks.append([v, 1, m])
        while len(blocks) > 1 and blocks[-2][0] * blocks[-1][1] >= blocks[-1][0] * blocks[-2][1]:
            last = blocks.pop()
            blocks[-1] = [p + q for p, q in zip(blocks[-1], last)]
    return Isotonic(np.array([b[2] / b[1] for b in blocks]), np.array([b[0] / b[1] for b in blocks]))
