"""Gradient-boosted regression trees for two classes, in NumPy: small training sets, vectorised prediction."""

from __future__ import annotations

import numpy as np


class Tree:
    """A complete binary tree: inner node i splits at values[i] of features[i]; leaves hold the steps."""

    def __init__(self, depth: int):
        self.depth, self.features, self.values, self.leaves = depth, np.zeros(2**depth - 1, np.int64), np.full(2**depth - 1, np.inf), np.zeros(2**depth)

    def leaf(self, x: np.ndarray) -> np.ndarray:
        at = np.zeros(len(x), np.int64)
        for _ in range(self.depth):
            at = 2 * at + 1 + (x[np.arange(len(x)), self.features[at]] > self.values[at])
        return at - (2**self.depth - 1)


def _split(x: np.ndarray, g: np.ndarray, h: np.ndarray, least: int, ridge: float) -> tuple[int, float]:
    """The feature and value of the largest gain; (0, inf) sends everything to the left."""
    best, found = 1e-6, (0, np.inf)
    whole = g.sum() ** 2 / (h.sum() + ridge)
    for f in range(x.shape[1]):
        order = np.argsort(x[:, f], kind="stable")
        v, gl, hl = x[order, f], np.cumsum(g[order]), np.cumsum(h[order])
        ok = np.flatnonzero((v[1:] > v[:-1]))
        ok = ok[(ok + 1 >= least) & (len(v) - ok - 1 >= least)]
        if len(ok):
            gain = gl[ok] ** 2 / (hl[ok] + ridge) + (gl[-1] - gl[ok]) ** 2 / (hl[-1] - hl[ok] + ridge) - whole
            i = int(gain.argmax())
            if gain[i] > best:
                best, found = gain[i], (f, (v[ok[i]] + v[ok[i] + 1]) / 2)
    return found


class Boosted:
    def __init__(self, trees: int = 40, depth: int = 3, rate: float = 0.3, least: int = 10, ridge: float = 1.0):
        self.count, self.depth, self.rate, self.least, self.ridge = trees, depth, rate, least, ridge
        self.trees: list[Tree] = []

    def fit(self, x: np.ndarray, y: np.ndarray) -> Boosted:
        score = np.zeros(len(x))
        for _ in range(self.count):
            p = 1 / (1 + np.exp(-score))
            g, h = p - y, p * (1 - p)
            tree, at = Tree(self.depth), np.zeros(len(x), np.int64)
            for node in range(2**self.depth - 1):
                mine = at == node
                if mine.sum() >= 2 * self.least:
                    tree.features[node], tree.values[node] = _split(x[mine], g[mine], h[mine], self.least, self.ridge)
                at[mine] = 2 * node + 1 + (x[mine, tree.features[node]] > tree.values[node])
            leaf = at - (2**self.depth - 1)
            sums = np.bincount(leaf, g, 2**self.depth), np.bincount(leaf, h, 2**self.depth)
            tree.leaves = -self.rate * sums[0] / (sums[1] + self.ridge)
            score += tree.leaves[leaf]
            self.trees.append(tree)
        return self

    def raw(self, x: np.ndarray) -> np.ndarray:
        return sum((t.leaves[t.leaf(x)] for t in self.trees), np.zeros(len(x)))


def calibrate(raw: np.ndarray, y: np.ndarray, precision: float) -> float:
    """The least score from which on the share of positives is at least `precision`, with one negative added to be safe."""
    order = np.argsort(-raw, kind="stable")
    good = np.cumsum(y[order])
    share = good / (np.arange(1, len(y) + 1) + 1)
    # Equal scores stand or fall together.
    ends = np.append(raw[order][1:] != raw[order][:-1], True)
    ok = np.flatnonzero(ends & (share >= precision))
    return float(raw[order][ok[-1]]) if len(ok) else np.inf
