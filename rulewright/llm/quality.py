"""Quality by a generalised additive model with pairwise interactions.

Each feature is cut into bins. Cyclic boosting visits the features in turn and adds a shallow tree of that feature alone,
so the sum of a feature's trees is a lookup table over its bins; then the pairs of features whose grids explain most of
what is left get tables of their own, boosted in the same way. A text's margin is a sum of table entries; isotonic
calibration on out-of-fold margins turns it into a probability.

The tables are fitted on a bounded sample of labelled rows, of which only the features come to the driver; every row is
scored over its whole text, however long. Null and empty texts get the score of their (all zero) features, repeated rows get
equal scores, and rows without an id are scored like others. A table without labels of both classes gives every row the
smoothed rate; an empty table gives no rows. Labels, language, source and id are never inputs of a score, and other columns,
whatever their names, are not read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from rulewright.llm._boost import Isotonic, bin_edges, sigmoid, to_bins
from rulewright.llm._features import QUALITY, Texts, quality_features
from rulewright.llm._labelled import feature_rows, sampled, score_rows
from rulewright.llm._store import discard
from rulewright.llm._text import slices, utf8

#: Labelled rows that the tables are fitted on, at most.
SAMPLE = 6_000
BINS, GRID, ROUNDS, PAIRS, PAIR_ROUNDS, RATE, LEAVES = 32, 8, 60, 6, 30, 0.1, 3


def _shallow(bins: np.ndarray, n: int, g: np.ndarray, h: np.ndarray, leaves: int, l2: float = 1.0) -> np.ndarray:
    """Best tree of a few leaves over ordered bins, as a value for each bin (greedy splits, Newton values)."""
    gs, hs = np.bincount(bins, g, n), np.bincount(bins, h, n)
    cg, ch = np.concatenate([[0], np.cumsum(gs)]), np.concatenate([[0], np.cumsum(hs)])
    value = lambda a, b: (cg[b] - cg[a]) ** 2 / (ch[b] - ch[a] + l2)
    parts = [(0, n)]
    while len(parts) < leaves:
        best = (1e-9, None, None)
        for i, (a, b) in enumerate(parts):
            if b - a < 2:
                continue
            c = np.arange(a + 1, b)
            gain = value(a, c) + value(c, b) - value(a, b)
            k = int(np.argmax(gain))
            if gain[k] > best[0]:
                best = (gain[k], i, c[k])
        if best[1] is None:
            break
        a, b = parts[best[1]]
        parts[best[1] : best[1] + 1] = [(a, best[2]), (best[2], b)]
    out = np.zeros(n)
    for a, b in parts:
        out[a:b] = (cg[b] - cg[a]) / (ch[b] - ch[a] + l2)
    return out


class Additive:
    """Lookup tables of single features and of pairs."""

    def fit(self, x: np.ndarray, y: np.ndarray) -> Additive:
        p = (y.sum() + 0.5) / (len(y) + 1)
        self.base = float(np.log(p / (1 - p)))
        self.edges, self.coarse = bin_edges(x, BINS), bin_edges(x, GRID)
        b, c = to_bins(x, self.edges), to_bins(x, self.coarse)
        self.tables = [np.zeros(len(e) + 1) for e in self.edges]
        z = np.full(len(y), self.base)
        for _ in range(ROUNDS):
            for j, table in enumerate(self.tables):
                q = sigmoid(z)
                step = RATE * _shallow(b[:, j], len(table), y - q, q * (1 - q), LEAVES)
                table += step
                z += step[b[:, j]]
        q = sigmoid(z)
        gains = []
        for i in range(x.shape[1]):
            for j in range(i + 1, x.shape[1]):
                m = len(self.coarse[j]) + 1
                cell = c[:, i] * m + c[:, j]
                size = (len(self.coarse[i]) + 1) * m
                g, h = np.bincount(cell, y - q, size), np.bincount(cell, q * (1 - q), size)
                gains.append((float((g**2 / (h + 1)).sum()), i, j))
        self.pairs = [(i, j) for _, i, j in sorted(gains, reverse=True)[:PAIRS]]
        self.grids = [np.zeros((len(self.coarse[i]) + 1, len(self.coarse[j]) + 1)) for i, j in self.pairs]
        for _ in range(PAIR_ROUNDS):
            for (i, j), grid in zip(self.pairs, self.grids, strict=True):
                q = sigmoid(z)
                # A shallow tree in one feature of the pair, whose halves are split by the other.
                rows = _shallow(c[:, i], grid.shape[0], y - q, q * (1 - q), 2)
                upper = rows[c[:, i]] == rows[-1]
                step = np.zeros_like(grid)
                for side in (False, True):
                    at = upper == side
                    line = _shallow(c[at, j], grid.shape[1], (y - q)[at], (q * (1 - q))[at], 2)
                    step[(rows == rows[-1]) == side] = RATE * line
                grid += step
                z += step[c[:, i], c[:, j]]
        return self

    def margin(self, x: np.ndarray) -> np.ndarray:
        b, c = to_bins(x, self.edges), to_bins(x, self.coarse)
        z = np.full(len(x), self.base)
        for j, table in enumerate(self.tables):
            z += table[b[:, j]]
        for (i, j), grid in zip(self.pairs, self.grids, strict=True):
            z += grid[c[:, i], c[:, j]]
        return z


class Model:
    def __init__(self, x: np.ndarray, y: np.ndarray):
        self.tables, rate = None, (y.sum() + 0.5) / (len(y) + 1)
        self.calibrated = Isotonic(np.array([0.0]), np.array([rate]))
        if 0 < y.sum() < len(y):
            half, out = np.arange(len(y)) % 2, np.zeros(len(y))
            for f in (0, 1):
                out[half == f] = Additive().fit(x[half != f], y[half != f]).margin(x[half == f])
            self.tables, self.calibrated = Additive().fit(x, y), Isotonic().fit(out, y)

    def __call__(self, texts: pa.Array) -> np.ndarray:
        if self.tables is None:
            return self.calibrated(np.zeros(len(texts)))
        return self.calibrated(self.tables.margin(quality_features(Texts(*utf8(texts)))))


def fit(docs: DataFrame, labels: DataFrame, modulus: int = 4, remainder: int = 2, limit: int = SAMPLE, text: str = "text", id_col: str = "doc_id") -> Model:
    rows = sampled(docs, labels, "quality", modulus, remainder, limit, text, id_col)
    _, x, y = feature_rows(rows, lambda texts: quality_features(Texts(*utf8(texts))))
    discard(rows)
    return Model(x, y)


def score(docs: DataFrame, labels: DataFrame, modulus: int = 4, remainder: int = 2, threshold: float = 0.7, limit: int = SAMPLE, text: str = "text", id_col: str = "doc_id") -> DataFrame:
    """(doc_id, held_out, score, predicted) for each row of docs."""
    return score_rows(docs, fit(docs, labels, modulus, remainder, limit, text, id_col), modulus, remainder, threshold, text, id_col)


def keep_good(docs: DataFrame, labels: DataFrame, threshold: float = 0.7, text: str = "text", id_col: str = "doc_id") -> DataFrame:
    """The rows of docs whose score reaches the threshold, with all their columns; one pass, no join."""
    model = fit(docs, labels, text=text, id_col=id_col)
    names = docs.columns

    def work(batches):
        for batch in slices(batches, text):
            yield batch.filter(pa.array(model(batch.column(names.index(text))) >= threshold))

    return docs.mapInArrow(work, docs.schema)
