"""Toxicity by gradient-boosted trees over dense features, with isotonic calibration.

Features: densities of a fixed and of a learnt lexicon (words and word beginnings that labelled toxic texts use and others
do not), nearness of hits to words of the second person, capitals, punctuation, and obfuscation (look-alike characters,
letters mixed with digits or symbols, repeated letters). The lexicon is learnt and the trees are fitted on a bounded sample
of labelled rows: words are counted where the texts are, and only the lexicon and the features come to the driver. Every row
is scored over its whole text, however long.

Null and empty texts get the score of their (all zero) features. Repeated rows get equal scores, rows without an id are scored
like others; a table without labels of both classes gives every row the smoothed rate, an empty table gives no rows. Labels,
language, source and id are never inputs of a score, and other columns, whatever their names, are not read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rulewright.llm._boost import Boosted, Isotonic
from rulewright.llm._features import Lexicon, Texts, toxic_features
from rulewright.llm._labelled import feature_rows, sampled, score_rows
from rulewright.llm._store import discard
from rulewright.llm._text import slices, utf8

#: Labelled rows that the model is fitted on, at most.
SAMPLE = 6_000
#: A word or beginning is learnt if this many toxic texts have it and it is this many times as frequent among them.
MIN_TEXTS, MIN_RATIO = 3, 12.0


def _word_counts(rows: DataFrame) -> DataFrame:
    """(kind, value, t0, t1, o0, o1): toxic and other texts of either half of the sample that have a word (kind 0) or a beginning."""

    def work(batches):
        for batch in slices(batches, "__text"):
            t = Texts(*utf8(batch.column(1)))
            y, half = (batch.column(i).to_numpy(zero_copy_only=False) for i in (2, 3))
            row = np.repeat(np.arange(t.n), np.diff(t.first)).astype(np.uint64)
            for kind in (0, 4, 5):
                pair = np.unique(np.stack([row, t.core if kind == 0 else t.prefixes(kind)]), axis=1)
                pair = pair[:, pair[1] != 0]
                at = pair[0].astype(np.int64)
                cell = np.array(["o0", "o1", "t0", "t1"])[2 * y[at] + half[at]] if len(at) else np.zeros(0, "<U2")
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(at), kind, np.int32)), pa.array(pair[1].view(np.int64)), pa.array(cell, pa.string())], names=["kind", "value", "cell"])

    each = rows.mapInArrow(work, "kind int, value long, cell string")
    return each.groupBy("kind", "value").agg(*[F.sum((F.col("cell") == c).cast("long")).alias(c) for c in ("t0", "t1", "o0", "o1")])


def learn_lexicons(rows: DataFrame) -> list[Lexicon]:
    """Lexicons from the second half of the sample, from the first, and from all of it."""
    n = {(r["__y"], r["__h"]): r["n"] for r in rows.groupBy("__y", "__h").agg(F.count(F.lit(1)).alias("n")).collect()}
    one = lambda y, h: n.get((y, h), 0)
    sides = [("t1", "o1", one(1, 1), one(0, 1)), ("t0", "o0", one(1, 0), one(0, 0)), (None, None, one(1, 0) + one(1, 1), one(0, 0) + one(0, 1))]
    counts = _word_counts(rows)
    rules = []
    for t, o, n1, n0 in sides:
        toxic, other = (F.col(t), F.col(o)) if t else (F.col("t0") + F.col("t1"), F.col("o0") + F.col("o1"))
        rules.append((toxic >= MIN_TEXTS) & (toxic / max(1.0, n1) >= MIN_RATIO * (other + 0.5) / max(1.0, n0)))
    # What is learnt is as small as a lexicon: words that many toxic texts share and others hardly have.
    got = counts.select("kind", "value", *[r.alias(f"in{i}") for i, r in enumerate(rules)]).where("in0 OR in1 OR in2").toArrow()
    kind, value = got.column("kind").to_numpy(), got.column("value").to_numpy().view(np.uint64)
    out = []
    for i in range(3):
        inside = np.array(got.column(f"in{i}").to_pylist(), dtype=bool) if len(kind) else np.zeros(0, bool)
        of = lambda k: np.sort(value[inside & (kind == k)])  # noqa: B023, E731
        out.append(Lexicon(of(0), {4: of(4), 5: of(5)}))
    return out


class Model:
    """Fitted in two folds: each half's features come from the lexicon of the other half, as they will for new texts."""

    def __init__(self, rows: DataFrame):
        rows = rows.withColumn("__h", F.pmod(F.xxhash64("__id"), F.lit(2)).cast("int"))
        *others, self.lexicon = learn_lexicons(rows)
        parts = [feature_rows(rows.where(F.col("__h") == f).drop("__h"), lambda texts, lexicon=others[f]: toxic_features(Texts(*utf8(texts)), lexicon)) for f in (0, 1)]
        y = np.concatenate([p[2] for p in parts])
        if 0 < y.sum() < len(y):
            x, half = np.concatenate([p[1] for p in parts if len(p[1])]), np.repeat([0, 1], [len(p[2]) for p in parts])
            out = np.zeros(len(y))
            for f in (0, 1):
                out[half == f] = Boosted(trees=60, depth=3, rate=0.15).fit(x[half != f], y[half != f]).margin(x[half == f])
            self.trees = Boosted(trees=60, depth=3, rate=0.15).fit(x, y)
            self.calibrated = Isotonic().fit(out, y)
        else:
            rate = (y.sum() + 0.5) / (len(y) + 1)
            self.trees = Boosted().fit(np.zeros((len(y), 0)), y)
            self.calibrated = Isotonic(np.array([0.0]), np.array([rate]))

    def __call__(self, texts: pa.Array) -> np.ndarray:
        x = toxic_features(Texts(*utf8(texts)), self.lexicon)
        return self.calibrated(self.trees.margin(x))


def score(docs: DataFrame, labels: DataFrame, modulus: int = 3, remainder: int = 1, threshold: float = 0.7, limit: int = SAMPLE, text: str = "text", id_col: str = "doc_id") -> DataFrame:
    """(doc_id, held_out, score, predicted) for each row of docs."""
    rows = sampled(docs, labels, "toxic", modulus, remainder, limit, text, id_col)
    model = Model(rows)
    discard(rows)
    return score_rows(docs, model, modulus, remainder, threshold, text, id_col)
