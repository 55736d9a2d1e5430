"""Gradient-boosted trees for binary labels on a bounded matrix (logistic loss), in numpy.

Small on purpose: the training sample is bounded by its caller, the fitted trees are plain
arrays that travel to the tasks, and scoring is vectorised over a batch of rows.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np


@dataclass
class BoostedTrees:
    base: float = 0.0
    rate: float = 0.3
    #: per tree: feature, threshold and value arrays of a complete binary tree (feature -1: leaf)
    trees: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = field(default_factory=list)

    def scores(self, x: np.ndarray) -> np.ndarray:
        out = np.full(len(x), self.base)
        for feature, threshold, value in self.trees:
            node = np.zeros(len(x), int)
            for _ in range(int(np.log2(len(feature) + 1)) - 1):
                inner = feature[node] >= 0
                right = x[np.arange(len(x)), feature[node]] > threshold[node]
                node = np.where(inner, 2 * node + 1 + right, node)
            out += self.rate * value[node]
        return out

    def probabilities(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.scores(x), -30, 30)))


def _grow(x: np.ndarray, grad: np.ndarray, hess: np.ndarray, depth: int, least: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    n = 2 ** (depth + 1) - 1
    feature, threshold, value = np.full(n, -1), np.zeros(n), np.zeros(n)
    rows_of = {0: np.arange(len(x))}
    for node in range(n):
        rows = rows_of.pop(node, None)
        if rows is None:
            continue
        g, h = grad[rows].sum(), hess[rows].sum()
        value[node] = g / (h + 1.0)
        if 2 * node + 2 >= n or len(rows) < 2 * least:
            continue
        best = (1e-6, -1, 0.0)
        for f in range(x.shape[1]):
            order = np.argsort(x[rows, f], kind="stable")
            v, cg, ch = x[rows, f][order], np.cumsum(grad[rows][order]), np.cumsum(hess[rows][order])
            cut = np.flatnonzero(v[1:] > v[:-1])
            cut = cut[(cut + 1 >= least) & (len(rows) - cut - 1 >= least)]
            if len(cut):
                gain = cg[cut] ** 2 / (ch[cut] + 1) + (g - cg[cut]) ** 2 / (h - ch[cut] + 1) - g * g / (h + 1)
                k = int(np.argmax(gain))
                if gain[k] > best[0]:
                    best = (gain[k], f, (v[cut[k]] + v[cut[k] + 1]) / 2)
        if best[1] >= 0:
            feature[node], threshold[node] = best[1], best[2]
            side = x[rows, best[1]] > best[2]
            rows_of[2 * node + 1], rows_of[2 * node + 2] = rows[~side], rows[side]
    return feature, threshold, value


def fit_boosted_trees(x: np.ndarray, y: np.ndarray, rounds: int = 20, depth: int = 3, rate: float = 0.3, least: int = 5) -> BoostedTrees:
    p = min(max(y.mean(), 1e-3), 1 - 1e-3)
    model = BoostedTrees(float(np.log(p / (1 - p))), rate)
    score = np.full(len(y), model.base)
    for _ in range(rounds):
        prob = 1 / (1 + np.exp(-score))
        tree = _grow(x, y - prob, prob * (1 - prob), depth, least)
        model.trees.append(tree)
        score += rate * BoostedTrees(0.0, 1.0, [tree]).scores(x)
    return model


def calibrated_threshold(prob: np.ndarray, y: np.ndarray, precision: float) -> float | None:
    """Smallest probability above which held-out rows are positive with at least ``precision``; None if there is none."""
    order = np.argsort(-prob, kind="stable")
    p, hits = prob[order], np.cumsum(y[order])
    good = (hits >= precision * np.arange(1, len(p) + 1)) & np.append(p[1:] < p[:-1], True) & (hits > 0)
    return float(p[np.flatnonzero(good)[-1]]) if good.any() else None
