"""Connected components of an edge table, as joins and aggregates (no graph is ever held by one task or the driver)."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rulewright.llm._store import discard, settle

#: Edges that a task reduces to a forest at once.
PIECE = 1 << 20


def label_pairs(n: int, a: np.ndarray, b: np.ndarray, label: np.ndarray | None = None) -> np.ndarray:
    """Smallest index reachable over the pairs, for each of n vertices (continues from label)."""
    label = np.arange(n) if label is None else label
    while True:
        la, lb = label[a], label[b]
        if np.array_equal(la, lb):
            return label
        low, high = np.minimum(la, lb), np.maximum(la, lb)
        np.minimum.at(label, high, low)
        while True:
            up = label[label]
            if np.array_equal(up, label):
                break
            label = up


def _forest(batches):
    """Edges replaced by stars with the same components, a piece of at most about PIECE edges at a time."""

    def star(held):
        a, b = (np.concatenate(x) for x in zip(*held, strict=True))
        ids, where = np.unique(np.concatenate([a, b]), return_inverse=True)
        label = label_pairs(len(ids), where[: len(a)], where[len(a) :])
        far = np.flatnonzero(label != np.arange(len(ids)))
        return ids[label[far]], ids[far]

    held, size = [], 0
    for batch in batches:
        held.append(tuple(batch.column(i).to_numpy(zero_copy_only=False) for i in (0, 1)))
        size += batch.num_rows
        if size >= PIECE:
            held = [star(held)]
            size = len(held[0][0])
            if size >= PIECE // 2:
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in held[0]], names=["a", "b"])
                held, size = [], 0
    if size:
        yield pa.RecordBatch.from_arrays([pa.array(x) for x in star(held)], names=["a", "b"])


def _roots(e: DataFrame) -> DataFrame:
    """(v, p): each vertex with the root of its tree, where every vertex has chosen its smallest neighbour.

    Two steps along smallest neighbours never lead to a larger id, so the only cycles are pairs that chose each other; the
    smaller one becomes the root, and it is the smallest id of its tree. Pointers are doubled until none moves, which takes
    as many steps as the logarithm of the deepest tree.
    """
    both = e.union(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
    choice = settle(both.groupBy(F.col("a").alias("v")).agg(F.min("b").alias("p")), "choice")
    of = choice.select(F.col("v").alias("p"), F.col("p").alias("pp"))
    mutual = (F.col("pp") == F.col("v")) & (F.col("v") < F.col("p"))
    hook = choice.join(of, "p").select("v", F.when(mutual, F.col("v")).otherwise(F.col("p")).alias("p"))
    while True:
        settled = settle(_doubled(hook), "hook")
        discard(choice, hook)
        hook = settled
        if settled.where("moved").isEmpty():
            return hook


def _doubled(hook: DataFrame) -> DataFrame:
    """Every pointer replaced by that of its target; moved tells whether it differs."""
    far = hook.select(F.col("v").alias("p"), F.col("p").alias("pp"))
    return hook.join(far, "p").select("v", F.col("pp").alias("p"), (F.col("pp") != F.col("p")).alias("moved"))


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(id, component): the smallest id reachable from each id that has an edge.

    In every round each task reduces its edges to a forest, each vertex joins the tree of its smallest neighbour and trees
    are contracted to their roots. Every vertex that still has an edge is in a tree of two at least, so half of them vanish
    and the rounds are at most the logarithm of the number of vertices; there is no cap. Hot vertices only meet in
    aggregates with partial results and in joins that adaptive execution can split. Self-loops, nulls and repeated edges
    are allowed. No edges give no rows.
    """
    e = edges.select(F.col(a).cast("long").alias("a"), F.col(b).cast("long").alias("b")).where("a IS NOT NULL AND b IS NOT NULL")
    first = settle(e, "edges")
    labels = first.select(F.explode(F.array("a", "b")).alias("id")).distinct().select("id", F.col("id").alias("component"))
    e = settle(first.where("a <> b").mapInArrow(_forest, "a long, b long").distinct(), "edges")
    used = [first]
    while not e.isEmpty():
        hook = _roots(e)
        left = hook.select(F.col("v").alias("a"), F.col("p").alias("pa"))
        right = hook.select(F.col("v").alias("b"), F.col("p").alias("pb"))
        contracted = e.join(left, "a").join(right, "b").select("pa", "pb").where("pa <> pb")
        new = settle(contracted.mapInArrow(_forest, "a long, b long").distinct(), "edges")
        step = hook.select(F.col("v").alias("component"), "p")
        moved = settle(labels.join(step, "component", "left").select("id", F.coalesce("p", "component").alias("component")), "labels")
        discard(*used, e, hook)
        e, labels, used = new, moved, [moved]
    discard(e)
    return labels
