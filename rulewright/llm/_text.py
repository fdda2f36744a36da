"""Vectorised text primitives over Arrow string columns: all of them work on the UTF-8 buffer of a whole batch."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

from rulewright.llm._memory import tidy

#: Documents are taken in slices of about this many bytes, so memory follows the slice and not the Arrow batch.
SLICE_BYTES = 1 << 20

_MULT = np.uint64(0x9E3779B97F4A7C15)
_powers: dict[str, np.ndarray] = {}


def _power_table(n: int) -> tuple[np.ndarray, np.ndarray]:
    """base**i and base**-i modulo 2**64 for i < n (grown on demand, kept by the worker up to the size of a slice)."""
    if n > 4 * SLICE_BYTES:
        kept, out = dict(_powers), None
        _powers.clear()
        out = _grow(n)
        _powers.clear()
        _powers.update(kept)
        return out
    return _grow(n)


def _grow(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_powers.get("p", ())) < n:
        size = max(1 << 16, 1 << int(n - 1).bit_length()) if n else 1 << 16
        base = 0x2545F4914F6CDD1D
        inverse = pow(base, -1, 1 << 64)
        for name, b in (("p", base), ("q", inverse)):
            table = np.ones(size, dtype=np.uint64)
            table[1:] = np.uint64(b)
            with np.errstate(over="ignore"):
                _powers[name] = np.multiply.accumulate(table)
    return _powers["p"], _powers["q"]


def mix64(x: np.ndarray) -> np.ndarray:
    """The splitmix64 finaliser: a bijection of 64-bit integers."""
    with np.errstate(over="ignore"):
        x = x ^ (x >> np.uint64(30))
        x = x * np.uint64(0xBF58476D1CE4E5B9)
        x ^= x >> np.uint64(27)
        x = x * np.uint64(0x94D049BB133111EB)
        x ^= x >> np.uint64(31)
    return x


def slices(batches: Iterator[pa.RecordBatch], text: str = "text", limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Cut record batches so that the text of each piece is about limit bytes (one document at least)."""
    tidy()
    for batch in batches:
        if batch.num_rows == 0:
            continue
        _, offsets = utf8(batch.column(batch.schema.get_field_index(text)))
        start = 0
        while start < batch.num_rows:
            stop = int(np.searchsorted(offsets, offsets[start] + limit, side="right")) - 1
            stop = min(max(stop, start + 1), batch.num_rows)
            yield batch.slice(start, stop - start)
            start = stop
    tidy()


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of a string column and the n + 1 offsets of its rows; null is empty."""
    if column.null_count:
        column = column.fill_null("")
    wide = pa.types.is_large_string(column.type)
    _, off, data = column.buffers()
    n = len(column)
    if off is None:
        return np.zeros(0, np.uint8), np.zeros(n + 1, np.int64)
    offsets = np.frombuffer(off, dtype=np.int64 if wide else np.int32)[column.offset : column.offset + n + 1].astype(np.int64)
    raw = np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[offsets[0] : offsets[-1]], offsets - offsets[0]


def lower_ascii(data: np.ndarray) -> np.ndarray:
    """A-Z to a-z; other bytes stay."""
    return data + (((data >= 65) & (data <= 90)).astype(np.uint8) << 5)


def word_bounds(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the words [^\\x20\\x09-\\x0D]+ and, for each row, the index of its first word (n + 1 values)."""
    n = len(data)
    if n == 0:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(offsets), np.int64)
    solid = (data != 32) & ((data < 9) | (data > 13))
    edge = np.zeros(n + 1, dtype=bool)
    edge[offsets] = True
    before = np.empty(n, dtype=bool)
    before[0] = False
    before[1:] = solid[:-1]
    starts = np.flatnonzero(solid & (~before | edge[:n]))
    after = np.empty(n, dtype=bool)
    after[-1] = False
    after[:-1] = solid[1:]
    ends = np.flatnonzero(solid & (~after | edge[1:])) + 1
    return starts, ends, np.searchsorted(starts, offsets)


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hashes of byte spans from one prefix sum (polynomial, then mixed with the length)."""
    if len(starts) == 0:
        return np.zeros(0, np.uint64)
    p, q = _power_table(len(data) + 1)
    with np.errstate(over="ignore"):
        total = np.zeros(len(data) + 1, dtype=np.uint64)
        np.cumsum((data.astype(np.uint64) + np.uint64(1)) * p[: len(data)], out=total[1:])
        h = (total[ends] - total[starts]) * q[starts]
        return mix64(h + (ends - starts).astype(np.uint64) * _MULT)


def shingle_hashes(words: np.ndarray, first: np.ndarray, k: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the k-word windows of each row, and the n + 1 offsets of the rows; a shorter row gives its whole sequence as one."""
    counts = np.diff(first)
    out_counts = np.where(counts >= k, counts - k + 1, (counts > 0).astype(np.int64))
    out_offsets = np.concatenate([[0], np.cumsum(out_counts)]).astype(np.int64)
    out = np.zeros(out_offsets[-1], dtype=np.uint64)
    if len(words) == 0:
        return out, out_offsets
    with np.errstate(over="ignore"):
        factor = [mix64(np.array([j + 1], np.uint64) * _MULT)[0] | np.uint64(1) for j in range(k)]
        if len(words) >= k:
            total = np.zeros(len(words) - k + 1, dtype=np.uint64)
            for j in range(k):
                total += words[j : len(words) - k + 1 + j] * factor[j]
            mixed = mix64(total)
            rows = np.repeat(np.arange(len(counts)), np.where(counts >= k, out_counts, 0))
            full = np.where(counts >= k)[0]
            if len(full):
                shift = np.repeat(first[:-1][full] - out_offsets[:-1][full], out_counts[full])
                at = np.flatnonzero(np.repeat(counts >= k, out_counts))
                out[at] = mixed[at + shift]
            del rows
        for r in np.flatnonzero((counts > 0) & (counts < k)):
            w = words[first[r] : first[r + 1]]
            out[out_offsets[r]] = mix64(np.array([np.sum(w * np.array(factor[: len(w)], dtype=np.uint64)) + np.uint64(len(w)) * _MULT], np.uint64))[0]
    return out, out_offsets


def distinct_sorted(values: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each row's distinct values in order, and their offsets."""
    parts = [np.unique(values[a:b]) for a, b in zip(offsets[:-1], offsets[1:], strict=True)]
    sizes = np.array([len(x) for x in parts], dtype=np.int64)
    return (np.concatenate(parts) if parts else np.zeros(0, np.uint64)), np.concatenate([[0], np.cumsum(sizes)]).astype(np.int64)


def reduce_rows(op: np.ufunc, values: np.ndarray, offsets: np.ndarray, empty) -> np.ndarray:
    """op over each row's values; empty rows give empty."""
    out = np.full(len(offsets) - 1, empty, dtype=values.dtype)
    full = np.flatnonzero(np.diff(offsets) > 0)
    if len(full):
        out[full] = op.reduceat(values, offsets[:-1][full])
    return out


def binary_column(blobs: list[bytes]) -> pa.Array:
    return pa.array(blobs, type=pa.binary())
