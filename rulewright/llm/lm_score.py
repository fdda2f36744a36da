"""Language-model scoring by cross-entropy difference.

A target and a background n-gram model over one vocabulary, all words `[^\\x20\\x09-\\x0D]+` of the target table and of the
documents, are counted from whole texts; the documents are the background. The models are matched: words and pairs of words,
same smoothing, and background counts scaled to the target's number of tokens, so that neither profits from its size.
A document is left out of the background that scores it: its own counts are taken off. A token's probability interpolates its
orders, p_k = (c(w_1..w_k) + BETA p_{k-1}) / (c(w_1..w_{k-1}) + BETA), from p_1 = (c + ALPHA) / (N + (V + 1) ALPHA) with V words
in the vocabulary; ORDER is the highest. Each document gets its mean loss in nats per token under both models and the difference target -
background: lower is closer to the target.

All n-grams are counted, none is dropped or merged on purpose: an n-gram is a 64-bit hash that tells its order, so what is
gathered grows with the corpus (two of 10 million n-grams share a hash with a probability of about 1 in 100,000). Nothing of it
is broadcast. Documents are packed into chunks; a chunk sends its distinct n-grams with their counts to buckets of the hash
range, as many as the bytes of all texts ask for, where all counts are added up, and gets both totals back in the order of its
n-grams (rows shuffled: chunks times ranges at most; from some TB on give larger chunks). The documents are read twice, once
to count and once to score, and a chunk is the same rows both times: that of a plain scan of files is by itself, other rows are
written to the shared folder first, and a checksum of the chunk refuses anything else. N-grams never cross texts; the first
tokens of a text use the orders that fit. Case is kept.

Null, empty and blank texts have no tokens and null losses. An empty target is the uniform model. Repeated rows count each
time, so a text that occurs twice is well known to the background. Very long texts are taken whole. Other columns are not
read; a kept column that is called like a result gives way to it.
"""

from __future__ import annotations

import zlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rulewright.llm._blobs import buckets_of
from rulewright.llm._memory import tidy
from rulewright.llm._store import partitions_for, settle
from rulewright.llm._text import SLICE_BYTES, mix64, reduce_rows, slices, span_hashes, utf8, word_bounds

ORDER, ALPHA, BETA = 2, 0.5, 4.0
#: Bytes of text at which a chunk ends.
CHUNK_BYTES = 8 << 20
#: Bytes of text for each range of the hash: a task holds the n-grams of one range.
RANGE_BYTES = 16 << 20
_TAG = np.uint64(3)


def grams(data: np.ndarray, offsets: np.ndarray) -> tuple[list[np.ndarray], np.ndarray]:
    """For each order the key of the n-gram that ends at each token (0 where the text has too few before it), and the n + 1 offsets
    of the rows in tokens. The lowest bits of a key are its order."""
    starts, ends, first = word_bounds(data, offsets)
    h = span_hashes(data, starts, ends)
    place = np.arange(len(h)) - np.repeat(first[:-1], np.diff(first))
    out, total = [], np.zeros(len(h), dtype=np.uint64)
    with np.errstate(over="ignore"):
        for k in range(1, ORDER + 1):
            factor = mix64(np.array([k], np.uint64))[0] | np.uint64(1)
            total[k - 1 :] += h[: len(h) - k + 1] * factor
            key = (mix64(total) & ~_TAG) | np.uint64(k)
            out.append(np.where(place >= k - 1, key, np.uint64(0)))
    return out, first


def add_up(keys: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys in order and the sums of their counts."""
    if len(keys) == 0:
        return keys, counts
    order = np.argsort(keys, kind="stable")
    keys, counts = keys[order], counts[order]
    new = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
    return keys[new], np.add.reduceat(counts, new)


def _squeezed(x: np.ndarray) -> bytes:
    """Integers as compressed byte planes; small ones cost next to nothing."""
    planes = np.ascontiguousarray(np.ascontiguousarray(x, dtype="<u8").view(np.uint8).reshape(-1, 8).T)
    return np.int64(len(x)).tobytes() + pa.compress(planes.tobytes(), codec="zstd", asbytes=True)


def _spread(blob: bytes) -> np.ndarray:
    n = int(np.frombuffer(blob, "<i8", 1)[0])
    planes = np.frombuffer(pa.decompress(blob[8:], 8 * n, codec="zstd", asbytes=True), np.uint8)
    return np.ascontiguousarray(planes.reshape(8, n).T).view("<u8").ravel()


def pack_counts(keys: np.ndarray, counts: np.ndarray) -> tuple[bytes, bytes]:
    """Sorted keys as steps, and their counts."""
    return _squeezed(np.diff(keys, prepend=np.uint64(0))), _squeezed(counts.astype(np.uint64))


def unpack_counts(keys: bytes, counts: bytes) -> tuple[np.ndarray, np.ndarray]:
    with np.errstate(over="ignore"):
        return np.cumsum(_spread(keys), dtype=np.uint64), _spread(counts).astype(np.int64)


_CHUNK = "chunk long, part int, bucket int, check long, keys binary, counts binary, docs binary"
_NAMES = ["chunk", "part", "bucket", "check", "keys", "counts", "docs"]
_KINDS = [pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.binary(), pa.binary(), pa.binary()]


def _rows(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), _KINDS, strict=True)], names=_NAMES)


def _is_scan(df: DataFrame) -> bool:
    """Whether df is rows of files, with columns and filters at most, so its partitions are the same whenever it runs."""
    plan = df._jdf.queryExecution().optimizedPlan().toString()
    return all(line.lstrip(" :+-").startswith(("Project", "Filter", "Relation")) for line in plan.strip().split("\n"))


def _chunks(docs: DataFrame, buckets: int, chunk_bytes: int, count: bool, target: bool = False) -> DataFrame:
    """With count, rows (chunk, part, bucket, check, keys, counts) of a chunk's distinct n-grams; else one row of its documents,
    whose bucket is buckets. Buckets are ranges of the key, so the keys of a chunk are its buckets one after the other. Chunks
    of the target are -1.
    """

    def work(batches):
        task, serial = TaskContext.get().partitionId(), 0
        for chunk in pieces(batches):
            number, part, check = (-1 if target else (task << 32) + serial), (task + serial) % buckets, 0
            serial += 1
            for b in chunk:
                check = zlib.crc32(utf8(b.column(b.num_columns - 1))[0], check)
            if count:
                every = [k for b in chunk for k in grams(*utf8(b.column(b.num_columns - 1)))[0]]
                flat = np.concatenate(every)
                keys, counts = np.unique(flat[flat != 0], return_counts=True)
                del every, flat
                edges = np.searchsorted(buckets_of(keys, buckets), np.arange(buckets + 1, dtype=np.uint64))
                full = np.flatnonzero(np.diff(edges)).tolist() or [0]
                yield _rows([(number, part, b, check, *pack_counts(keys[edges[b] : edges[b + 1]], counts[edges[b] : edges[b + 1]]), None) for b in full])
            else:
                sink = pa.BufferOutputStream()
                with pa.ipc.new_stream(sink, chunk[0].schema, options=pa.ipc.IpcWriteOptions(compression=pa.Codec("zstd", compression_level=3))) as writer:
                    for b in chunk:
                        writer.write_batch(b)
                yield _rows([(number, part, buckets, check, None, None, sink.getvalue().to_pybytes())])
        tidy()

    def pieces(batches):
        held, size = [], 0
        for batch in slices(batches, "__text", min(SLICE_BYTES, chunk_bytes)):
            held.append(batch)
            size += len(utf8(batch.column(batch.num_columns - 1))[0])
            if size >= chunk_bytes:
                yield held
                held, size = [], 0
        if held:
            yield held

    return docs.mapInArrow(work, _CHUNK)


_ANSWER = _CHUNK + ", tokens_target long, tokens long, words long"


def _answers(asked: DataFrame, target: DataFrame, buckets: int) -> DataFrame:
    """For each chunk and bucket the totals of its n-grams in the target (keys) and in all documents (counts), in their order; and
    one row for each bucket: tokens of either table and words of both."""

    def work(batches):
        rows: list[tuple] = []
        for batch in batches:
            rows += zip(*(c.to_pylist() for c in batch.columns[:6]), strict=True)
        if not rows:
            return
        totals, tokens, words, read = [], [], [], {}
        for own in (False, True):  # target, documents
            keys, counts = [], []
            for i, r in enumerate(rows):
                if (r[0] >= 0) == own:
                    k, c = unpack_counts(r[4], r[5])
                    keys.append(k)
                    counts.append(c)
                    if own:
                        read[i] = r[4]
            k, c = add_up(np.concatenate([*keys, np.zeros(0, np.uint64)]), np.concatenate([*counts, np.zeros(0, np.int64)]))
            del keys, counts
            one = (k & _TAG) == 1
            totals.append((k, c))
            tokens.append(int(c[one].sum()))
            words.append(k[one])
        nothing = [pa.nulls(1, t) for t in _KINDS]
        yield pa.RecordBatch.from_arrays([*nothing, *(pa.array([x], pa.int64()) for x in (*tokens, len(np.union1d(*words))))], names=[*_NAMES, "tokens_target", "tokens", "words"])
        for i, blob in read.items():
            with np.errstate(over="ignore"):
                asked_keys = np.cumsum(_spread(blob), dtype=np.uint64)
            out = []
            for known, counts in totals:
                at = np.minimum(np.searchsorted(known, asked_keys), max(len(known) - 1, 0))
                out.append(_squeezed(np.where(known[at] == asked_keys, counts[at], 0) if len(known) else np.zeros(len(asked_keys))))
            batch = _rows([(*rows[i][:4], *out, None)])
            yield pa.RecordBatch.from_arrays([*batch.columns, *(pa.nulls(1, pa.int64()) for _ in range(3))], names=[*_NAMES, "tokens_target", "tokens", "words"])
        tidy()

    return asked.unionByName(target).repartitionById(buckets, F.col("bucket")).mapInArrow(work, _ANSWER)


@dataclass
class Losses:
    """Losses of the tokens of a chunk's documents, from both totals of the chunk's n-grams in their order."""

    target: np.ndarray
    background: np.ndarray
    n_target: int
    n_background: int
    vocabulary: int

    def of(self, batches: list[pa.RecordBatch]) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """Tokens and sums of the losses of the texts (last column) of all batches of the chunk, batch by batch."""
        scale = self.n_target / self.n_background if self.n_background and self.n_target else 1.0
        parts = [grams(*utf8(b.column(b.num_columns - 1))) for b in batches]
        sizes = [len(every[0]) for every, _ in parts]
        flat = np.concatenate([k for every, _ in parts for k in every] or [np.zeros(0, np.uint64)])
        known = np.flatnonzero(flat)
        place = np.zeros(len(flat), dtype=np.int64)
        place[known] = np.unique(flat[known], return_inverse=True)[1]
        out, at = [], 0
        for (every, first), m in zip(parts, sizes, strict=True):
            n = np.diff(first)
            row = np.repeat(np.arange(len(n)), n)
            t, b = [], []
            for key in every:
                i, at = place[at : at + m], at + m
                own = np.zeros(m, dtype=np.int64)
                some = np.flatnonzero(key)
                _, where, times = np.unique(row[some] * (len(self.target) + 1) + i[some], return_inverse=True, return_counts=True)
                own[some] = times[where]
                t.append(np.where(key != 0, self.target[i], 0).astype(np.float64) if m else np.zeros(0))
                b.append(np.where(key != 0, (self.background[i] - own) * scale, 0.0) if m else np.zeros(0))
            rest = (self.n_background - n) * scale
            out.append((n, self._loss(every, t, np.full(m, float(self.n_target)), first), self._loss(every, b, rest[row], first)))
        return out

    def _loss(self, every: list[np.ndarray], counts: list[np.ndarray], total: np.ndarray, first: np.ndarray) -> np.ndarray:
        p = (counts[0] + ALPHA) / (total + (self.vocabulary + 1) * ALPHA)
        for k in range(1, ORDER):
            fits = np.flatnonzero(every[k])
            own, context = counts[k][fits], counts[k - 1][fits - 1]
            p[fits] = (own + BETA * p[fits]) / (np.maximum(context, own) + BETA)
        return reduce_rows(np.add, -np.log(p), first, 0.0)


def score(docs: DataFrame, target: DataFrame, keep: list[str], text: str = "text", chunk_bytes: int = CHUNK_BYTES) -> DataFrame:
    """keep columns, n_tokens, target_loss, background_loss and difference of each row of docs, which are the background."""
    names = ["n_tokens", "target_loss", "background_loss", "difference"]
    keep = [c for c in keep if c not in names]
    schema = T.StructType([*[docs.schema[c] for c in keep], T.StructField("n_tokens", T.LongType()), *[T.StructField(n, T.DoubleType()) for n in names[1:]]])
    source = docs.select(*[docs[c] for c in keep], docs[text].alias("__text"))
    source = source if _is_scan(source) else settle(source, "scored")
    goal = target.select(target[text].alias("__text"))
    buckets = partitions_for([source, goal], "__text", RANGE_BYTES)
    goal = _chunks(goal, buckets, CHUNK_BYTES, True, target=True)
    answers = settle(_answers(_chunks(source, buckets, chunk_bytes, True), goal, buckets), "totals")
    sums = answers.where("words IS NOT NULL").agg(F.sum("tokens_target"), F.sum("tokens"), F.sum("words")).first()
    totals = tuple(int(x or 0) for x in sums)

    def work(batches):
        held: list[tuple[np.ndarray, np.ndarray]] = []
        checks: set[int] = set()
        for batch in batches:
            for bucket, check, keys, counts, blob in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                checks.add(check)
                if bucket < buckets:
                    held.append((_spread(keys).astype(np.int64), _spread(counts).astype(np.int64)))
                    continue
                if len(checks) > 1:
                    raise RuntimeError("the documents changed between the two passes")
                mine, theirs = (np.concatenate([*x, np.zeros(0, np.int64)]) for x in zip(*held, strict=True))
                held, checks = [], set()
                own = list(pa.ipc.open_stream(blob))
                for rows, (count, a, b) in zip(own, Losses(mine, theirs, *totals).of(own), strict=True):
                    mean = lambda x: pa.array(x / np.maximum(count, 1), mask=count == 0)  # noqa: B023, E731
                    yield pa.RecordBatch.from_arrays([*rows.columns[: len(keep)], pa.array(count), mean(a), mean(b), mean(a - b)], names=[*keep, *names])
        tidy()

    rows = _chunks(source, buckets, chunk_bytes, False).unionByName(answers.where("words IS NULL").select(*_NAMES))
    # A chunk's documents come behind the totals of its n-grams, bucket by bucket.
    dealt = rows.repartitionById(buckets, F.col("part")).sortWithinPartitions("chunk", "bucket")
    return dealt.select("bucket", "check", "keys", "counts", "docs").mapInArrow(work, schema)
