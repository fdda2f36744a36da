"""A bounded, deterministic sample of labelled documents for fitting on the driver."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rulewright.llm._store import settle
from rulewright.llm._text import slices


def held_out(doc_id: Column, modulus: int, remainder: int) -> Column:
    """crc32 of the id as text, modulo modulus, equals remainder."""
    return F.crc32(doc_id.cast("string")) % modulus == remainder


def sampled(docs: DataFrame, labels: DataFrame, label: str, modulus: int, remainder: int, limit: int, text: str = "text", id_col: str = "doc_id") -> DataFrame:
    """(__id, __text, __y) of at most limit labelled rows that are not held out: those with the least hash of their id.

    Rows without an id or a label are left out; of several labels of one id the largest counts, and repeated ids give repeated
    rows. Only the ids (at most limit of them) are broadcast; the texts stay on the executors.
    """
    own = labels.select(labels[id_col].alias("__id"), labels[label].alias("__y")).where("__id IS NOT NULL AND __y IS NOT NULL")
    own = own.where(~held_out(F.col("__id"), modulus, remainder)).groupBy("__id").agg(F.max("__y").cast("int").alias("__y"))
    ids = own.orderBy(F.xxhash64("__id"), "__id").limit(limit)
    picked = docs.select(docs[id_col].alias("__id"), F.coalesce(docs[text], F.lit("")).alias("__text")).join(F.broadcast(ids), "__id")
    return settle(picked.select(F.col("__id").cast("long").alias("__id"), "__text", "__y"), "labelled")


def feature_rows(rows: DataFrame, make: Callable[[pa.Array], np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(ids, features, labels) of the sampled rows in the order of their ids; the numbers alone come to the driver."""

    def work(batches):
        for batch in slices(batches, "__text"):
            x = np.ascontiguousarray(make(batch.column(1)), dtype="<f8")
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([r.tobytes() for r in x], pa.binary()), batch.column(2)], names=["__id", "x", "__y"])

    got = rows.mapInArrow(work, "__id long, x binary, __y int").toArrow()
    x = [np.frombuffer(b, "<f8") for b in got.column("x").to_pylist()]
    ids, y = got.column("__id").to_numpy(), got.column("__y").to_numpy().astype(float)
    order = sorted(range(len(ids)), key=lambda i: (ids[i], x[i].tobytes()))
    return ids[order], np.stack([x[i] for i in order]) if order else np.zeros((0, 0)), y[order]


def score_rows(docs: DataFrame, make: Callable[[pa.Array], np.ndarray], modulus: int, remainder: int, threshold: float, text: str = "text", id_col: str = "doc_id") -> DataFrame:
    """(doc_id, held_out, score, predicted) for each row; make is the scorer of a batch of texts."""
    schema = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("held_out", T.BooleanType()), T.StructField("score", T.DoubleType())])

    def work(batches):
        for batch in slices(batches, "__text"):
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(make(batch.column(2)), pa.float64())], names=["doc_id", "held_out", "score"])

    source = docs.select(docs[id_col].cast("long").alias("doc_id"), held_out(docs[id_col], modulus, remainder).alias("held_out"), docs[text].alias("__text"))
    return source.mapInArrow(work, schema).withColumn("predicted", (F.col("score") >= threshold).cast("int"))
