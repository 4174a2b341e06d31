"""Gradient-boosted trees on histograms with monotonic constraints, scored as flat node arrays.

Training runs over a bounded sample that the caller collects; scoring is a few array
operations per tree level over any number of rows.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np


@dataclass
class Forest:
    """Nodes of all trees behind one another; a leaf points to itself."""

    roots: np.ndarray
    feature: np.ndarray
    threshold: np.ndarray
    left: np.ndarray
    right: np.ndarray
    value: np.ndarray
    depth: int
    base: float

    def margin(self, x: np.ndarray) -> np.ndarray:
        node = np.tile(self.roots, (len(x), 1))
        rows = np.arange(len(x))[:, None]
        for _ in range(self.depth):
            node = np.where(x[rows, self.feature[node]] <= self.threshold[node], self.left[node], self.right[node])
        return self.base + self.value[node].sum(axis=1)

    def probability(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-self.margin(x)))


def fit_forest(
    x: np.ndarray, y: np.ndarray, monotone: np.ndarray, trees: int = 60, depth: int = 3, rate: float = 0.15, bins: int = 64, penalty: float = 1.0, least: float = 2.0
) -> Forest:
    """Logistic boosting. ``monotone`` is -1, 0 or 1 per feature.

    A constrained split whose children are in the wrong order is not made, and the
    middle of the two bounds everything below it, so the whole tree is monotone. Without
    rows, or with one class only, the forest is a constant.
    """
    nodes: list[list[float]] = []  # feature, threshold, left, right, value
    roots: list[int] = []
    if not len(y) or y.min() == y.max():
        share = float(y.mean()) if len(y) else 0.5
        base = float(np.log((share * len(y) + 1) / ((1 - share) * len(y) + 1)))
        return Forest(*(np.zeros(0, t) for t in (int, int, float, int, int, float)), 0, base)
    cuts = [np.unique(np.quantile(x[:, k], np.linspace(0, 1, bins + 1)[1:-1])) for k in range(x.shape[1])]
    coded = np.stack([np.searchsorted(c, x[:, k], "left") for k, c in enumerate(cuts)], axis=1)
    base = float(np.log(y.mean() / (1 - y.mean())))
    margin = np.full(len(y), base)

    def weight(g: np.ndarray, h: np.ndarray, low: float, high: float) -> np.ndarray:
        return np.clip(-g / (h + penalty), low, high)

    def gain(g: np.ndarray, h: np.ndarray, w: np.ndarray) -> np.ndarray:
        return -(g * w + 0.5 * (h + penalty) * w * w)

    def grow(rows: np.ndarray, level: int, low: float, high: float) -> int:
        g, h = grad[rows], hess[rows]
        own = float(weight(g.sum(), h.sum(), low, high))
        at = len(nodes)
        nodes.append([0, np.inf, at, at, rate * own])
        if level == depth or len(rows) < 2 * least:
            margin[rows] += rate * own
            return at
        best, found = 1e-6 + float(gain(g.sum(), h.sum(), own)), None
        for k, cut in enumerate(cuts):
            if not len(cut):
                continue
            gl = np.cumsum(np.bincount(coded[rows, k], g, len(cut) + 1))[:-1]
            hl = np.cumsum(np.bincount(coded[rows, k], h, len(cut) + 1))[:-1]
            nl = np.cumsum(np.bincount(coded[rows, k], minlength=len(cut) + 1))[:-1]
            gr, hr = g.sum() - gl, h.sum() - hl
            wl, wr = weight(gl, hl, low, high), weight(gr, hr, low, high)
            score = gain(gl, hl, wl) + gain(gr, hr, wr)
            score[(nl < least) | (len(rows) - nl < least) | (monotone[k] * (wr - wl) < 0)] = -np.inf
            s = int(np.argmax(score))
            if score[s] > best:
                best, found = float(score[s]), (k, s, float(wl[s]), float(wr[s]))
        if found is None:
            margin[rows] += rate * own
            return at
        k, s, wl, wr = found
        middle = (wl + wr) / 2
        bounds = {0: ((low, high), (low, high)), 1: ((low, middle), (middle, high)), -1: ((middle, high), (low, middle))}[int(monotone[k])]
        goes = coded[rows, k] <= s
        left = grow(rows[goes], level + 1, *bounds[0])
        right = grow(rows[~goes], level + 1, *bounds[1])
        nodes[at] = [k, cuts[k][s], left, right, 0.0]
        return at

    for _ in range(trees):
        p = 1 / (1 + np.exp(-margin))
        grad, hess = p - y, np.maximum(p * (1 - p), 1e-6)
        roots.append(len(nodes))
        grow(np.arange(len(y)), 0, -np.inf, np.inf)
    flat = np.array(nodes)
    whole = [flat[:, k].astype(int) for k in (0, 2, 3)]
    return Forest(np.array(roots), whole[0], flat[:, 1], whole[1], whole[2], flat[:, 4], depth, base)
