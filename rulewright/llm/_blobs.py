"""Packed shuffles: a map task sends one binary row to each bucket instead of one row for each key."""

from __future__ import annotations

import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rulewright.llm._memory import tidy


def buckets_of(mixed: np.ndarray, n: int) -> np.ndarray:
    """Bucket of each (mixed) 64-bit key from its upper 32 bits."""
    return ((mixed >> np.uint64(32)) * np.uint64(n)) >> np.uint64(32)


def pack(columns: list[np.ndarray], bucket: np.ndarray, n: int) -> Iterator[tuple[int, bytes]]:
    """(bucket, blob) for each bucket that has rows; a blob holds the columns one after the other."""
    order = np.argsort(bucket, kind="stable")
    columns = [c[order] for c in columns]
    edges = np.searchsorted(bucket[order], np.arange(n + 1, dtype=bucket.dtype))
    for b in np.flatnonzero(np.diff(edges)):
        lo, hi = edges[b], edges[b + 1]
        yield int(b), struct.pack("<q", hi - lo) + b"".join(c[lo:hi].tobytes() for c in columns)


def unpack(blobs: list[bytes], kinds: list[str]) -> list[np.ndarray]:
    """The columns of all blobs together."""
    parts: list[list[np.ndarray]] = [[] for _ in kinds]
    for blob in blobs:
        (count,) = struct.unpack_from("<q", blob)
        at = 8
        for i, kind in enumerate(kinds):
            parts[i].append(np.frombuffer(blob, dtype=kind, count=count, offset=at))
            at += count * np.dtype(kind).itemsize
    return [np.concatenate(p) if p else np.zeros(0, k) for p, k in zip(parts, kinds, strict=True)]


def by_bucket(df: DataFrame, n: int) -> DataFrame:
    """Rows (bucket, blob) dealt so that bucket b is partition b."""
    return df.select("bucket", "blob").repartitionById(n, F.col("bucket"))


def read_blobs(batches: Iterator[pa.RecordBatch]) -> tuple[int | None, list[bytes]]:
    """Bucket and blobs of a partition."""
    bucket, blobs = None, []
    for batch in batches:
        if batch.num_rows:
            bucket = batch.column(0)[0].as_py()
            blobs += batch.column(1).to_pylist()
    tidy()
    return bucket, blobs


class Bloom:
    """A bit set over integer ids: no id that is in it is missed. At most max_bits, whatever the number of ids."""

    def __init__(self, bits: int, words: np.ndarray):
        self.bits, self.words = bits, words

    @classmethod
    def of(cls, ids: DataFrame, column: str, max_bits: int = 1 << 26) -> Bloom:
        """Built by an aggregate; only the set itself, of a size bounded by max_bits (8 MB), comes to the driver."""
        count = ids.count()
        bits = int(min(max_bits, max(1 << 16, 1 << int(16 * count).bit_length())))
        slot = F.pmod(F.col(column), F.lit(bits))
        rows = ids.select(F.floor(slot / 64).cast("int").alias("w"), F.pmod(slot, F.lit(64)).cast("int").alias("s")).groupBy("w").agg(F.bit_or(F.expr("shiftleft(1L, s)")).alias("m")).toArrow()
        words = np.zeros(bits // 64, dtype=np.uint64)
        words[rows.column("w").to_numpy()] = rows.column("m").to_numpy().view(np.uint64)
        return cls(bits, words)

    def __contains__(self, ids: np.ndarray):
        raise TypeError("use hits()")

    def hits(self, ids: np.ndarray) -> np.ndarray:
        slot = np.mod(ids, self.bits)
        return (self.words[slot >> 6] >> (slot & 63).astype(np.uint64)) & np.uint64(1) == 1
