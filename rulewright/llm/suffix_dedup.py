"""Exact substring deduplication by difference-cover suffix sorting.

Every byte that is covered by a WIDTH-byte string which also starts in a document with a smaller id is removed. Strings are
judged on the input; they never cross documents; repetitions within one document do not count.

Suffixes are dealt to tasks by content: each WIDTH-byte window is named by its minimizer (the K-gram with the least hash,
leftmost of equals), so equal windows meet in one task.

1. A first pass counts the documents of every minimizer; those of one document only cannot repeat. What repeats becomes a
   bit set as large as its keys need, up to a bound; it only saves work where it is loose.
2. A second pass sends each occurrence of a repeated minimizer with one hash of all windows that it names. Where all
   occurrences agree, the windows of every document but that with the least id are repeats.
3. A third pass sends the bytes around the other occurrences (mostly the ends of repeated passages). Each task sorts their
   suffixes by the difference-cover algorithm: sort sampled triples, recurse on their names, merge the remaining suffixes.
   Neighbours that share a prefix of WIDTH bytes form a run, in which all documents but the least repeat.
4. The windows found are merged to spans, and only documents that have some are joined with their text.

Ids are unique integers; rows without one are left out. Null is the empty text. An empty table gives no rows; other columns
are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rulewright.llm._blobs import Bloom, buckets_of, pack, unpack
from rulewright.llm._dc3 import suffix_order
from rulewright.llm._memory import tidy
from rulewright.llm._store import partitions_for, settle, shuffle_partitions
from rulewright.llm._text import _power_table, mix64, slices, utf8

WIDTH, K = 50, 20
SPAN = WIDTH - K + 1  # windows that one gram can name
CONTEXT = WIDTH + SPAN - 1
SIDE = (WIDTH - K) // 2  # every window reaches so far to one side of its gram
HALF = WIDTH + SIDE  # bytes of SIDE + 1 windows
FLUSH = 1 << 18
#: Bits for each key of a bit set, and bits of a whole set at most (64 MB); beyond it a set only lets more rows through.
KEY_BITS, MAX_BITS = 12, 1 << 29
#: Bytes whose suffixes are sorted together (more if one minimizer has more).
SORT_BYTES = 1 << 20


def _prefix_sums(data: np.ndarray) -> np.ndarray:
    p, _ = _power_table(len(data) + 1)
    total = np.zeros(len(data) + 1, dtype=np.uint64)
    with np.errstate(over="ignore"):
        np.cumsum((data.astype(np.uint64) + np.uint64(1)) * p[: len(data)], out=total[1:])
    return total


def _hash_between(total: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    _, q = _power_table(len(total))
    with np.errstate(over="ignore"):
        return mix64((total[b] - total[a]) * q[a] + (b - a).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))


def minimizers(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """key, row, first window, last window, place and prefix sums: for each minimizer the run of windows that it names."""
    n = len(data)
    none = np.zeros(0, np.int64)
    total = _prefix_sums(data)
    if n < WIDTH:
        return np.zeros(0, np.uint64), none, none, none, none, total
    _, q = _power_table(n + 1)
    with np.errstate(over="ignore"):
        gram = mix64((total[K:] - total[: n - K + 1]) * q[: n - K + 1] + np.uint64(K) * np.uint64(0x9E3779B97F4A7C15))
    place_bits = max(1, int(n).bit_length())
    low = np.uint64((1 << place_bits) - 1)
    m = (gram & ~low) | np.arange(n - K + 1, dtype=np.uint64)
    reach = 1
    while 2 * reach <= SPAN:
        m = np.minimum(m[: len(m) - reach], m[reach:])
        reach *= 2
    if reach < SPAN:
        m = np.minimum(m[: len(m) - (SPAN - reach)], m[SPAN - reach :])
    where = m & low  # for each window start, the place of its minimizer
    length = np.diff(offsets)
    own = np.maximum(length - WIDTH + 1, 0)
    inside = np.repeat(np.tile([True, False], len(length)), np.stack([own, length - own], axis=1).ravel())[: len(where)]
    new, end = inside.copy(), inside.copy()  # windows of two rows are apart, so a run ends with its row
    if len(where) > 1:
        moved = where[1:] != where[:-1]
        new[1:] &= moved | ~inside[:-1]
        end[:-1] &= moved | ~inside[1:]
    first, last = np.flatnonzero(new), np.flatnonzero(end)
    place = where[first].astype(np.int64)
    return mix64(gram[place]), np.searchsorted(offsets, first, side="right") - 1, first, last, place, total


class _Segments:
    """A bit set in one segment for each bucket, so that each task makes its own segment, as large as its keys need."""

    def __init__(self, n_buckets: int, parts: dict[int, bytes]):
        self.n = n_buckets
        empty = bytes(8)
        segments = [parts.get(b, empty) for b in range(n_buckets)]
        self.bits = np.array([8 * len(x) for x in segments], dtype=np.int64)
        self.base = np.cumsum(self.bits) - self.bits
        self.words = np.frombuffer(b"".join(segments), dtype=np.uint8)

    @staticmethod
    def probes(key: np.ndarray, bits: np.ndarray | int) -> tuple[np.ndarray, np.ndarray]:
        return key.astype(np.int64) % bits, ((key.astype(np.uint64) * np.uint64(2654435761)) & np.uint64(0xFFFFFFFF)).astype(np.int64) % bits

    @staticmethod
    def make(keys: np.ndarray, n_buckets: int) -> bytes:
        bits = 64 * max(1, min(-(-KEY_BITS * len(np.unique(keys)) // 64), MAX_BITS // n_buckets // 64))
        flags = np.zeros(bits, dtype=np.uint8)
        for p in _Segments.probes(keys, bits):
            flags[p] = 1
        return np.packbits(flags, bitorder="little").tobytes()

    def hits(self, mixed: np.ndarray) -> np.ndarray:
        bucket = buckets_of(mixed, self.n).astype(np.int64)
        base, out = self.base[bucket], np.ones(len(mixed), dtype=bool)
        for p in _Segments.probes((mixed & np.uint64(0xFFFFFFFF)).astype(np.uint32), self.bits[bucket]):
            i = base + p
            out &= (self.words[i >> 3] >> (i & 7).astype(np.uint8)) & 1 == 1
        return out


_SCHEMA = "bucket int, base long, blob binary, found boolean"


def _send(columns: list[np.ndarray], bucket: np.ndarray, n_buckets: int, doc: np.ndarray | None = None, found: bool = False) -> Iterator[pa.RecordBatch]:
    """Packed rows; document ids travel as their lower half, the upper half with the row. found: windows that are known to repeat."""
    high = np.zeros(len(bucket), np.int64) if doc is None else doc >> 32
    for h in np.unique(high):
        at = np.flatnonzero(high == h)
        own = [c[at] for c in columns] + ([] if doc is None else [(doc[at] & 0xFFFFFFFF).astype(np.uint32)])
        got = list(pack(own, bucket[at], n_buckets))
        yield pa.RecordBatch.from_arrays([pa.array([g[0] for g in got], pa.int32()), pa.array([int(h) << 32] * len(got), pa.int64()), pa.array([g[1] for g in got], pa.binary()), pa.array([found] * len(got), pa.bool_())], names=["bucket", "base", "blob", "found"])


def _receive(batches: Iterator[pa.RecordBatch], kinds: list[str], doc: bool = True, passing: list | None = None) -> tuple[int | None, list[np.ndarray]]:
    """Bucket and columns of a partition; with doc, the last column is the whole document id. Windows found before go to passing."""
    bucket, parts = None, []
    for batch in batches:
        for b, base, blob, found in zip(*(batch.column(i).to_pylist() for i in range(4)), strict=True):
            if found and passing is not None:
                passing.append((b, base, blob))
                continue
            bucket = b
            got = unpack([blob], kinds + ["<u4"] * doc)
            if doc:
                got[-1] = got[-1].astype(np.int64) + base
            parts.append(got)
    tidy()
    return bucket, [np.concatenate(x) for x in zip(*parts, strict=True)] if parts else []


def _dealt(df: DataFrame, n: int) -> DataFrame:
    return df.select("bucket", "base", "blob", "found").repartitionById(n, F.col("bucket"))


def _passed(passing: list) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([x[0] for x in passing], pa.int32()), pa.array([x[1] for x in passing], pa.int64()), pa.array([x[2] for x in passing], pa.binary()), pa.array([True] * len(passing), pa.bool_())], names=["bucket", "base", "blob", "found"])


def _groups(key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    starts = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
    return starts, np.diff(np.append(starts, len(key)))


def _repeated(docs: DataFrame, n: int) -> _Segments:
    """Minimizers of two documents at least."""

    def work(batches):
        held, size = [], 0

        def flush():
            keys, times = np.unique(np.concatenate(held), return_counts=True)
            keys = np.repeat(keys, np.minimum(times, 2))  # a key of very many documents sends no more than another
            return _send([(keys & np.uint64(0xFFFFFFFF)).astype(np.uint32)], buckets_of(keys, n), n)

        for batch in slices(batches, "text"):
            key, row, *_ = minimizers(*utf8(batch.column(1)))
            if len(key):
                order = np.lexsort((key, row))
                key, row = key[order], row[order]
                held.append(key[np.concatenate([[True], (key[1:] != key[:-1]) | (row[1:] != row[:-1])])])
                size += len(held[-1])
            if size >= 4 * FLUSH:
                yield from flush()
                held, size = [], 0
        if held:
            yield from flush()

    def count(batches):
        bucket, got = _receive(batches, ["<u4"], doc=False)
        if got:
            keys = np.sort(got[0])
            again = keys[1:][keys[1:] == keys[:-1]]
            yield pa.RecordBatch.from_arrays([pa.array([bucket], pa.int32()), pa.array([_Segments.make(again, n)], pa.binary())], names=["bucket", "bits"])

    rows = _dealt(docs.mapInArrow(work, _SCHEMA), n).mapInArrow(count, "bucket int, bits binary").collect()
    return _Segments(n, {r["bucket"]: bytes(r["bits"]) for r in rows})


def _to_documents(doc: np.ndarray, first: np.ndarray, count: np.ndarray, n: int) -> Iterator[pa.RecordBatch]:
    """Found windows (first start and number of starts), dealt by document."""
    yield from _send([first.astype(np.uint32), count.astype(np.uint32)], buckets_of(mix64(doc.astype(np.uint64)), n), n, doc, found=True)


def _agreeing(docs: DataFrame, repeated: _Segments, n: int) -> DataFrame:
    """Window rows of minimizers whose occurrences agree (bits null), and the bit set of those that do not."""
    shared = docs.sparkSession.sparkContext.broadcast(repeated)

    def work(batches):
        held, size = [], 0

        def flush():
            key, whole, first, count, doc = (np.concatenate(x) for x in zip(*held, strict=True))
            # Of equal windows in this task only those of the least document travel; the others repeat it.
            order = np.lexsort((doc, whole, key))
            key, whole, first, count, doc = key[order], whole[order], first[order], count[order], doc[order]
            starts = np.flatnonzero(np.concatenate([[True], (key[1:] != key[:-1]) | (whole[1:] != whole[:-1])]))
            later = doc != np.repeat(doc[starts], np.diff(np.append(starts, len(doc))))
            if later.any():
                yield from _to_documents(doc[later], first[later], count[later], n)
            key, whole, first, count, doc = key[~later], whole[~later], first[~later], count[~later], doc[~later]
            yield from _send([(key & np.uint64(0xFFFFFFFF)).astype(np.uint32), whole, first, count], buckets_of(key, n), n, doc)

        for batch in slices(batches, "text"):
            ids = batch.column(0).to_numpy(zero_copy_only=False)
            data, offsets = utf8(batch.column(1))
            key, row, first, last, _, total = minimizers(data, offsets)
            at = np.flatnonzero(shared.value.hits(key))
            if len(at):
                key, row, first, last = key[at], row[at], first[at], last[at]
                held.append((key, _hash_between(total, first, last + WIDTH), (first - offsets[row]).astype(np.uint32), (last - first + 1).astype(np.uint8), ids[row]))
                size += len(at)
            if size >= FLUSH:
                yield from flush()
                held, size = [], 0
        if held:
            yield from flush()

    def decide(batches):
        passing: list = []
        bucket, got = _receive(batches, ["<u4", "<u8", "<u4", "u1"], passing=passing)
        if passing:
            out = _passed(passing)
            yield pa.RecordBatch.from_arrays([*out.columns, pa.nulls(out.num_rows, pa.binary())], names=["bucket", "base", "blob", "found", "bits"])
        if not got:
            return
        key, whole, first, count, doc = got
        order = np.argsort(key, kind="stable")
        key, whole, first, count, doc = key[order], whole[order], first[order], count[order], doc[order]
        starts, sizes = _groups(key)
        least = np.minimum.reduceat(doc, starts)
        several = least != np.maximum.reduceat(doc, starts)
        agree = np.minimum.reduceat(whole, starts) == np.maximum.reduceat(whole, starts)
        mixed = key[starts[several & ~agree]]
        found = np.repeat(several & agree, sizes) & (doc != np.repeat(least, sizes))
        for out in _to_documents(doc[found], first[found], count[found], n):
            yield pa.RecordBatch.from_arrays([*out.columns, pa.nulls(out.num_rows, pa.binary())], names=["bucket", "base", "blob", "found", "bits"])
        yield pa.RecordBatch.from_arrays([pa.array([bucket], pa.int32()), pa.nulls(1, pa.int64()), pa.nulls(1, pa.binary()), pa.nulls(1, pa.bool_()), pa.array([_Segments.make(mixed, n)], pa.binary())], names=["bucket", "base", "blob", "found", "bits"])

    return settle(_dealt(docs.mapInArrow(work, _SCHEMA), n).mapInArrow(decide, _SCHEMA + ", bits binary"), "suffix-agree")


def _meeting(group: np.ndarray, doc: np.ndarray) -> np.ndarray:
    """Places of the rows whose group has several documents, group by group."""
    order = np.argsort(group, kind="stable")
    if len(order) == 0:
        return order
    starts, sizes = _groups(group[order])
    d = doc[order]
    return order[np.repeat(np.minimum.reduceat(d, starts) != np.maximum.reduceat(d, starts), sizes)]


def _bytes_hash(rows: np.ndarray) -> np.ndarray:
    """64-bit hash of each row of a byte matrix."""
    with np.errstate(over="ignore"):
        h = np.zeros(len(rows), dtype=np.uint64)
        for k in range(rows.shape[1]):
            h = h * np.uint64(0x9E3779B97F4A7C15) + rows[:, k]
        return mix64(h)


def _half(key, first, count, place, context, doc, left: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(group, first, count, context, doc) of the windows that reach SIDE bytes to the left of the gram, or of the others.

    The others reach SIDE bytes to its right, so windows that are equal agree in those bytes as well: they refine the group.
    Where a repeated passage ends, the text behind it differs, so the groups there are small however common the passage is.
    """
    if left:
        low, high, side = np.zeros_like(place), np.minimum(count - 1, place - SIDE), place - SIDE
    else:
        low, high, side = np.maximum(0, place - SIDE + 1), count - 1, place + K
    at = np.flatnonzero(high >= low)
    key, first, count, context, doc, low, side = key[at], first[at] + low[at], high[at] - low[at] + 1, context[at], doc[at], low[at], side[at]
    beside = np.take_along_axis(context, side[:, None] + np.arange(SIDE), axis=1)
    group = mix64(_bytes_hash(beside) + key + np.uint64(left))
    reach = np.arange(HALF)
    padded = np.concatenate([context, np.zeros((len(context), HALF), np.uint8)], axis=1)
    part = np.take_along_axis(padded, low[:, None] + reach, axis=1)
    part = np.where(reach < (count + WIDTH - 1)[:, None], part, 0).astype(np.uint8)
    return group, first, count, part, doc


def _without_equal(group, first, count, context, doc) -> tuple[list[np.ndarray], list[np.ndarray]]:
    """Rows of which none equals another of a smaller document, and (doc, first, count) of the others, which repeat."""
    order = np.lexsort((doc, _bytes_hash(context), group))
    group, first, count, context, doc = group[order], first[order], count[order], context[order], doc[order]
    starts = np.flatnonzero(np.concatenate([[True], (group[1:] != group[:-1]) | (context[1:] != context[:-1]).any(axis=1) | (count[1:] != count[:-1])]))
    later = doc != np.repeat(doc[starts], np.diff(np.append(starts, len(doc))))
    return [group[~later], first[~later], count[~later], context[~later], doc[~later]], [doc[later], first[later], count[later]]


def repeats_in(context: np.ndarray, count: np.ndarray, doc: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(index, offset) of the windows whose WIDTH bytes also occur for a smaller document; context has the bytes of each row from its first window on."""
    width = context.shape[1]
    text = context.ravel()
    order = suffix_order(text.astype(np.int64) + 1, WIDTH)
    row, offset = order // width, order % width
    use = offset < count[row]
    row, offset, at = row[use], offset[use], order[use]
    if len(at) == 0:
        return row, offset
    padded = np.concatenate([text, np.zeros(8, np.uint8)])
    words = np.lib.stride_tricks.as_strided(padded.view(np.uint8)[:8].view("<u8"), shape=(len(text) + 1,), strides=(1,))
    new = np.zeros(len(at), dtype=bool)
    new[0] = True
    for k in [*range(0, WIDTH - 7, 8), WIDTH - 8]:  # neighbours that differ within the first WIDTH bytes
        value = words[at + k]
        new[1:] |= value[1:] != value[:-1]
    starts = np.flatnonzero(new)
    least = np.minimum.reduceat(doc[row], starts)
    found = doc[row] != np.repeat(least, np.diff(np.append(starts, len(at))))
    return row[found], offset[found]


def _disagreeing(docs: DataFrame, mixed: _Segments, n: int) -> DataFrame:
    """Window rows of the minimizers in mixed, from suffix sorting."""
    shared = docs.sparkSession.sparkContext.broadcast(mixed)

    def work(batches):
        held, size = [], 0

        def flush():
            rows = [np.concatenate(x) for x in zip(*held, strict=True)]
            for left in (True, False):
                half = _half(*rows, left)
                if len(half[0]) == 0:
                    continue
                (group, first, count, context, doc), repeated = _without_equal(*half)
                if len(repeated[0]):
                    yield from _to_documents(*repeated, n)
                yield from _send([(group & np.uint64(0xFFFFFFFF)).astype(np.uint32), first.astype(np.uint32), count.astype(np.uint8), np.ascontiguousarray(context).view(f"V{HALF}").ravel()], buckets_of(group, n), n, doc)

        for batch in slices(batches, "text"):
            ids = batch.column(0).to_numpy(zero_copy_only=False)
            data, offsets = utf8(batch.column(1))
            key, row, first, last, place, _ = minimizers(data, offsets)
            at = np.flatnonzero(shared.value.hits(key))
            if len(at):
                key, row, first, count, place = key[at], row[at], first[at], last[at] - first[at] + 1, (place - first)[at]
                padded = np.concatenate([data, np.zeros(CONTEXT, np.uint8)])
                around = np.lib.stride_tricks.sliding_window_view(padded, CONTEXT)[first]
                around = np.where(np.arange(CONTEXT) < (count + WIDTH - 1)[:, None], around, 0).astype(np.uint8)
                held.append((key, first - offsets[row], count, place, around, ids[row]))
                size += len(at)
            if size >= FLUSH // 4:
                yield from flush()
                held, size = [], 0
        if held:
            yield from flush()

    def sort(batches):
        passing: list = []
        _, got = _receive(batches, ["<u4", "<u4", "u1", f"V{HALF}"], passing=passing)
        if passing:
            yield _passed(passing)
        if got:
            group, first, count, context, doc = got
            keep = _meeting(group, doc)  # a group of one document only has come through the looseness of the bit set
            group, first, count, context, doc = group[keep], first[keep].astype(np.int64), count[keep].astype(np.int64), context[keep].view(np.uint8).reshape(-1, HALF), doc[keep]
            del got
            if len(group) == 0:
                return
            (group, first, count, context, doc), repeated = _without_equal(group, first, count, context, doc)
            if len(repeated[0]):
                yield from _to_documents(*repeated, n)
            keep = _meeting(group, doc)
            group, first, count, context, doc = group[keep], first[keep], count[keep], context[keep], doc[keep]
            if len(group) == 0:
                return
            starts, _ = _groups(group)
            edges = [0]
            for s in [*starts[1:].tolist(), len(group)]:
                if (s - edges[-1]) * HALF >= SORT_BYTES or s == len(group):
                    edges.append(s)
            for a, b in zip(edges[:-1], edges[1:], strict=True):
                row, offset = repeats_in(context[a:b], count[a:b], doc[a:b])
                if len(row):
                    order = np.lexsort((offset, row))
                    row, offset = row[order], offset[order]
                    new = np.flatnonzero(np.concatenate([[True], (row[1:] != row[:-1]) | (offset[1:] != offset[:-1] + 1)]))
                    length = np.diff(np.append(new, len(row)))
                    yield from _to_documents(doc[a:b][row[new]], first[a:b][row[new]] + offset[new], length, n)

    return _dealt(docs.mapInArrow(work, _SCHEMA), n).mapInArrow(sort, _SCHEMA)


def _spans(windows: DataFrame, n: int) -> DataFrame:
    """(doc_id, spans): removed byte spans of each document that has some, as pairs of 64-bit integers."""

    def work(batches):
        _, got = _receive(batches, ["<u4", "<u4"])
        if not got:
            return
        first, count, doc = got
        a = first.astype(np.int64)
        b = a + count - 1 + WIDTH
        order = np.lexsort((a, doc))
        a, b, doc = a[order], b[order], doc[order]
        starts, sizes = _groups(doc)
        shift = np.repeat(np.arange(len(starts)), sizes) << 40  # documents one after the other on one line
        top = np.maximum.accumulate(b + shift)
        new = np.flatnonzero(np.concatenate([[True], (a + shift)[1:] > top[:-1]]))
        end = top[np.append(new[1:], len(a)) - 1] - shift[new]
        pairs = np.stack([a[new], end], axis=1).astype("<i8")
        own, sizes = _groups(doc[new])
        for i in range(0, len(own), 4096):
            part = range(i, min(i + 4096, len(own)))
            yield pa.RecordBatch.from_arrays([pa.array(doc[new][own[i : i + 4096]]), pa.array([pairs[own[j] : own[j] + sizes[j]].tobytes() for j in part], pa.binary())], names=["doc_id", "spans"])

    return _dealt(windows, n).mapInArrow(work, "doc_id long, spans binary")


_RESULT = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string"


def _result(ids: list[int], texts: list[bytes], spans: list[bytes | None]) -> pa.RecordBatch:
    rows = []
    for raw, span in zip(texts, spans, strict=True):
        pairs = np.frombuffer(span or b"", dtype="<i8").reshape(-1, 2)
        digest, at = hashlib.sha256(), 0
        for a, b in pairs.tolist():
            digest.update(raw[at:a])
            at = b
        digest.update(raw[at:])
        rows.append((len(raw), int((pairs[:, 1] - pairs[:, 0]).sum()), len(pairs), digest.hexdigest()))
    columns = list(zip(*rows, strict=True)) if rows else [[]] * 4
    kinds = [pa.int64()] * 3 + [pa.string()]
    return pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), *[pa.array(c, k) for c, k in zip(columns, kinds, strict=True)]], names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"])


def removed_spans(df: DataFrame, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, spans): the byte spans to remove, as pairs of little-endian 64-bit integers, for documents that have some."""
    docs = df.select(df[id_col].cast("long").alias("doc_id"), df[text].alias("text")).where("doc_id IS NOT NULL")
    n = partitions_for([docs], "text")
    agreed = _agreeing(docs, _repeated(docs, n), n)
    bits = {r["bucket"]: bytes(r["bits"]) for r in agreed.where("bits IS NOT NULL").select("bucket", "bits").collect()}
    found = agreed.where("bits IS NULL").select("bucket", "base", "blob", "found").union(_disagreeing(docs, _Segments(n, bits), n))
    return settle(_spans(found, n), "suffix-spans")


def sorted_spans(df: DataFrame, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """removed_spans from one distributed difference-cover sort of all suffixes, without the minimizers.

    It shuffles some hundred times the text (see the README for measured figures), so it is for small corpora and for checks.
    """
    from rulewright.llm._dcsort import repeated_windows

    n = shuffle_partitions(df.sparkSession)

    def symbols(batches):
        for batch in slices(batches, "text"):
            data, offsets = utf8(batch.column(1))
            wide = (data.astype("<i8") + 1).view(np.uint8)
            rows = [wide[8 * a : 8 * b].tobytes() for a, b in zip(offsets[:-1], offsets[1:], strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(rows, pa.binary())], names=["doc", "symbols"])

    docs = df.select(df[id_col].cast("long").alias("doc_id"), df[text].alias("text")).where("doc_id IS NOT NULL")
    texts = settle(docs.mapInArrow(symbols, "doc long, symbols binary"), "dc-texts")

    def found(batches):
        for batch in batches:
            doc, first = (batch.column(i).to_numpy(zero_copy_only=False) for i in (0, 1))
            if len(doc):
                yield from _to_documents(doc, first, np.ones(len(doc), np.uint32), n)

    return settle(_spans(repeated_windows(texts, WIDTH, n).mapInArrow(found, _SCHEMA), n), "suffix-sorted")


def dedup_digest(df: DataFrame, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept_sha256) for each row with an id."""
    spans = removed_spans(df, id_col, text)
    docs = df.select(df[id_col].cast("long").alias("doc_id"), df[text].alias("text")).where("doc_id IS NOT NULL")
    shared = docs.sparkSession.sparkContext.broadcast(Bloom.of(spans, "doc_id"))

    def rows(batch):
        raw, offsets = utf8(batch.column(1))
        raw = raw.tobytes()
        return batch.column(0).to_pylist(), [raw[a:b] for a, b in zip(offsets[:-1], offsets[1:], strict=True)]

    def untouched(batches):
        for batch in slices(batches, "text"):
            hit = shared.value.hits(batch.column(0).to_numpy(zero_copy_only=False))
            ids, texts = rows(batch.filter(pa.array(~hit)))
            yield _result(ids, texts, [None] * len(ids))

    def touched(batches):
        for batch in batches:
            yield batch.filter(pa.array(shared.value.hits(batch.column(0).to_numpy(zero_copy_only=False))))

    def cut(batches):
        for batch in slices(batches, "text"):
            ids, texts = rows(batch)
            yield _result(ids, texts, batch.column(2).to_pylist())

    some = docs.mapInArrow(touched, "doc_id long, text string").join(spans, "doc_id", "left")
    return docs.mapInArrow(untouched, _RESULT).union(some.mapInArrow(cut, _RESULT))
