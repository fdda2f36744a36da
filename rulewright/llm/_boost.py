"""Gradient-boosted trees, isotonic calibration and cyclic additive models in numpy, for bounded training sets on the driver."""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np


def bin_edges(x: np.ndarray, bins: int) -> list[np.ndarray]:
    """Upper edges of at most bins quantile bins for each column."""
    out = []
    for j in range(x.shape[1]):
        values = np.unique(x[:, j])
        if len(values) > bins:
            values = np.unique(np.quantile(x[:, j], np.linspace(0, 1, bins + 1)))
        out.append((values[1:] + values[:-1]) / 2)
    return out


def to_bins(x: np.ndarray, edges: list[np.ndarray]) -> np.ndarray:
    return np.stack([np.searchsorted(e, x[:, j], side="left") for j, e in enumerate(edges)], axis=1) if len(edges) else np.zeros((len(x), 0), int)


def sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -35, 35)))


@dataclass
class Tree:
    """Node i splits on feature[i] <= threshold[i] (children 2i+1, 2i+2); feature -1 is a leaf with value[i]."""

    feature: np.ndarray
    threshold: np.ndarray
    value: np.ndarray

    def predict(self, x: np.ndarray) -> np.ndarray:
        at = np.zeros(len(x), dtype=np.int64)
        for _ in range(int(np.log2(len(self.feature) + 1)) - 1):
            f = self.feature[at]
            inner = f >= 0
            right = inner & (x[np.arange(len(x)), np.maximum(f, 0)] > self.threshold[at])
            at = np.where(inner, 2 * at + 1 + right, at)
        return self.value[at]


@dataclass
class Boosted:
    """Logistic gradient boosting with Newton leaf values on quantile bins."""

    trees: int = 60
    depth: int = 3
    rate: float = 0.2
    bins: int = 32
    l2: float = 1.0
    min_weight: float = 1.0
    base: float = 0.0
    fitted: list[Tree] = field(default_factory=list)

    def fit(self, x: np.ndarray, y: np.ndarray) -> Boosted:
        x, y = np.asarray(x, float), np.asarray(y, float)
        p = (y.sum() + 0.5) / (len(y) + 1)
        self.base, self.fitted = float(np.log(p / (1 - p))), []
        if len(y) == 0 or x.shape[1] == 0:
            return self
        edges = bin_edges(x, self.bins)
        b = to_bins(x, edges)
        z = np.full(len(y), self.base)
        for _ in range(self.trees):
            q = sigmoid(z)
            tree = self._grow(b, y - q, q * (1 - q), edges)
            z += tree.predict(x)
            self.fitted.append(tree)
        return self

    def _grow(self, b: np.ndarray, g: np.ndarray, h: np.ndarray, edges: list[np.ndarray]) -> Tree:
        size = 2 ** (self.depth + 1) - 1
        feature, threshold, value = np.full(size, -1), np.zeros(size), np.zeros(size)
        node = np.zeros(len(g), dtype=np.int64)
        for i in range(size):
            here = np.flatnonzero(node == i)
            if i and len(here) == 0:
                continue
            gs, hs = g[here].sum(), h[here].sum()
            value[i] = self.rate * gs / (hs + self.l2)
            if 2 * i + 2 >= size or len(here) < 2:
                continue
            best, gain = None, 1e-6
            for j, e in enumerate(edges):
                if len(e) == 0:
                    continue
                gl = np.cumsum(np.bincount(b[here, j], g[here], len(e) + 1))[:-1]
                hl = np.cumsum(np.bincount(b[here, j], h[here], len(e) + 1))[:-1]
                gr, hr = gs - gl, hs - hl
                s = gl**2 / (hl + self.l2) + gr**2 / (hr + self.l2) - gs**2 / (hs + self.l2)
                s[(hl < self.min_weight * 0.1) | (hr < self.min_weight * 0.1)] = 0
                k = int(np.argmax(s))
                if s[k] > gain:
                    best, gain = (j, k), s[k]
            if best is None:
                continue
            feature[i], threshold[i] = best[0], edges[best[0]][best[1]]
            node[here] = 2 * i + 1 + (b[here, best[0]] > best[1])
        return Tree(feature, threshold, value)

    def margin(self, x: np.ndarray) -> np.ndarray:
        z = np.full(len(x), self.base)
        for t in self.fitted:
            z += t.predict(x)
        return z

    def sql(self, names: list[str]) -> str:
        """The margin as a SQL expression over named features."""

        def node(t: Tree, i: int) -> str:
            if t.feature[i] < 0:
                return f"{t.value[i]:.9e}D"
            return f"CASE WHEN {names[t.feature[i]]} <= {t.threshold[i]:.9e}D THEN {node(t, 2 * i + 1)} ELSE {node(t, 2 * i + 2)} END"

        return " + ".join([f"{self.base:.9e}D", *(f"({node(t, 0)})" for t in self.fitted)])


RISE = 0.02


@dataclass
class Isotonic:
    """A rising function from margins to probabilities: steps by pool adjacent violators, linear between them.

    A step itself rises by RISE of the way to its neighbours (0 and 1 at the ends), so margins of one step stay in order.
    """

    x: np.ndarray = field(default_factory=lambda: np.array([0.0]))
    y: np.ndarray = field(default_factory=lambda: np.array([0.5]))
    steps: tuple[np.ndarray, np.ndarray] = ()

    def fit(self, margin: np.ndarray, y: np.ndarray, prior: float = 1.0) -> Isotonic:
        """prior: pseudo-observations of the overall rate's odds added at either end, so no probability is exactly 0 or 1."""
        order = np.argsort(margin, kind="stable")
        m, t = np.asarray(margin, float)[order], np.asarray(y, float)[order]
        if len(m) == 0:
            return self
        m = np.concatenate([[m[0]], m, [m[-1]]])
        t = np.concatenate([[0.0], t, [1.0]])
        w = np.ones(len(m))
        w[[0, -1]] = 0.5 * prior
        blocks: list[list[float]] = []  # sum, weight, least and greatest margin
        for a, b, c in zip(m, t, w, strict=True):
            blocks.append([b * c, c, a, a])
            while len(blocks) > 1 and blocks[-2][0] * blocks[-1][1] >= blocks[-1][0] * blocks[-2][1]:
                last = blocks.pop()
                blocks[-1] = [blocks[-1][0] + last[0], blocks[-1][1] + last[1], blocks[-1][2], last[3]]
        self.x = np.array([x for k in blocks for x in k[2:]])
        rate = np.clip([k[0] / k[1] for k in blocks], 1e-4, 1 - 1e-4)
        gap = RISE * np.diff(np.concatenate([[0.0], rate, [1.0]]))
        self.y = np.stack([rate - gap[:-1], rate + gap[1:]], axis=1).ravel()
        self.steps = np.array([k[2] for k in blocks]), rate
        return self

    def least(self, probability: float) -> float:
        """Where the first step begins that has this probability, or the highest one where none has."""
        x, rate = self.steps
        return float(x[np.argmax(rate >= min(probability, rate.max()))])

    def __call__(self, margin: np.ndarray) -> np.ndarray:
        return np.interp(margin, self.x, self.y)
