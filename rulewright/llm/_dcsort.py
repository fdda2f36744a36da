"""Distributed difference-cover suffix sorting (modulo 3) of many texts at once.

A level holds one row of symbols for each text. The triples at the places 1 and 2 modulo 3 are sorted over all tasks (ranges by
sampled splitters, packed rows) and named by their rank; where names repeat, the strings of names are sorted by recursion,
until a name stands for `depth` bytes; then the remaining suffixes (places 0 modulo 3) are merged in by their first symbol and
the rank behind it, range by range. Texts end in symbol 0, which is less than all others, so suffixes never run into the next
text. Suffixes that agree in `depth` bytes may stand in any order among themselves.

Equal leading symbols meet in one range, so a symbol pair that very many suffixes begin with makes one large range; nothing of
a range is held but its packed records.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rulewright.llm._blobs import buckets_of, by_bucket, pack, read_blobs, unpack
from rulewright.llm._memory import tidy
from rulewright.llm._store import discard, settle
from rulewright.llm._text import mix64

#: Keys that a task gives to the choice of splitters; records that are packed together.
SAMPLES, FLUSH = 256, 1 << 18
_TEXTS = "doc long, symbols binary"


def _key(a: np.ndarray, b: np.ndarray, width: int) -> np.ndarray:
    """The leading 63 bits of two symbols of `width` bits each: equal pairs have equal keys, and keys keep their order."""
    if 2 * width <= 63:
        return (a << width) | b
    return (a << (63 - width)) | (b >> (2 * width - 63))


def _splitters(keys: DataFrame, n: int) -> np.ndarray:
    """n - 1 quantiles of sampled keys (at most SAMPLES from each task)."""
    got = np.sort(keys.toArrow().column("key").to_numpy())
    return got[(np.arange(1, n) * len(got)) // n] if len(got) else np.zeros(0, np.int64)


def _symbols(blob: bytes) -> np.ndarray:
    return np.concatenate([np.frombuffer(blob, "<i8"), np.zeros(3, np.int64)])


def _sample_places(n: int) -> np.ndarray:
    """Places 1 modulo 3, then 2 modulo 3, of a text of n symbols."""
    return np.concatenate([np.arange(1, n, 3), np.arange(2, n, 3)])


def _dealt(texts: DataFrame, records, width: int, n: int) -> DataFrame:
    """records(row) -> (keys, columns) of each text, packed by range: (bucket, blob). Two passes: splitters, then records."""

    def sampled(batches):
        rng = np.random.default_rng(0)
        held = []
        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                keys = records(row)[0]
                if len(keys):
                    held.append(rng.choice(keys, min(len(keys), 16)))
        every = np.concatenate(held) if held else np.zeros(0, np.int64)
        yield pa.RecordBatch.from_arrays([pa.array(rng.choice(every, min(len(every), SAMPLES)) if len(every) else every)], names=["key"])

    cuts = _splitters(texts.mapInArrow(sampled, "key long"), n)

    def work(batches):
        held: list[tuple] = []
        size = 0

        def flush() -> Iterator[pa.RecordBatch]:
            keys, *columns = (np.concatenate(x) for x in zip(*held, strict=True))
            got = list(pack(columns, np.searchsorted(cuts, keys, side="right").astype(np.uint64), n))
            yield pa.RecordBatch.from_arrays([pa.array([g[0] for g in got], pa.int32()), pa.array([g[1] for g in got], pa.binary())], names=["bucket", "blob"])

        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                keys, columns = records(row)
                held.append((keys, *columns))
                size += len(keys)
                if size >= FLUSH:
                    yield from flush()
                    held, size = [], 0
        if size:
            yield from flush()
        tidy()

    return by_bucket(texts.mapInArrow(work, "bucket int, blob binary"), n)


def _ranked(dealt: DataFrame, rank, kinds: list[str], n: int) -> tuple[DataFrame, dict[int, int], bool]:
    """(doc, place, rank inside its range) of every range, the ranks before each range, and whether all ranks differ."""

    def work(batches):
        bucket, blobs = read_blobs(batches)
        if not blobs:
            return
        doc, place, local, distinct = rank(*unpack(blobs, kinds))
        got = list(pack([doc, place, local], buckets_of(mix64(doc.astype(np.uint64)), n), n))
        yield pa.RecordBatch.from_arrays([pa.array([bucket] * len(got), pa.int32()), pa.array([distinct] + [0] * (len(got) - 1)), pa.array([len(doc)] + [0] * (len(got) - 1)), pa.array([g[0] for g in got], pa.int32()), pa.array([g[1] for g in got], pa.binary())], names=["range", "distinct", "rows", "home", "blob"])
        tidy()

    out = settle(dealt.mapInArrow(work, "range int, distinct long, rows long, home int, blob binary"), "dc-ranks")
    sizes = sorted(tuple(r) for r in out.groupBy("range").agg(F.sum("distinct"), F.sum("rows")).collect())
    before, total = {}, 0
    for r, distinct, _ in sizes:
        before[r] = total
        total += distinct
    return out, before, total == sum(r for _, _, r in sizes)


def _home(ranked: DataFrame, before: dict[int, int], n: int) -> DataFrame:
    """(doc, ranks): for each text the ranks (from 1) of its places in order of the place."""

    def work(batches):
        docs, places, ranks = [], [], []
        for batch in batches:
            for r, blob in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                d, p, local = unpack([blob], ["<i8", "<i8", "<i8"])
                docs.append(d)
                places.append(p)
                ranks.append(local + before[r] + 1)
        if not docs:
            return
        doc, place, rank = np.concatenate(docs), np.concatenate(places), np.concatenate(ranks)
        order = np.lexsort((place, doc))
        doc, rank = doc[order], rank[order]
        starts = np.flatnonzero(np.concatenate([[True], doc[1:] != doc[:-1]]))
        for a, b in zip(starts, np.append(starts[1:], len(doc)), strict=True):
            yield pa.RecordBatch.from_arrays([pa.array([doc[a]]), pa.array([rank[a:b].astype("<i8").tobytes()], pa.binary())], names=["doc", "ranks"])

    rows = ranked.select("home", "range", "blob").repartitionById(n, F.col("home"))
    return rows.mapInArrow(work, "doc long, ranks binary")


def sample_ranks(texts: DataFrame, width: int, depth: int, n: int, cover: int = 1) -> DataFrame:
    """(doc, symbols, ranks): each text with the ranks of its sample places (those 1 modulo 3 first). A symbol stands for `cover` bytes."""

    def triples(row):
        doc, blob = row
        s = _symbols(blob)
        at = _sample_places(len(s) - 3)
        a, b, c = s[at], s[at + 1], s[at + 2]
        # The place in the string of names, so the ranks come home in its order.
        return _key(a, b, width), [a, b, c, np.full(len(at), doc), np.arange(len(at))]

    def name(a, b, c, doc, place):
        order = np.lexsort((c, b, a))
        a, b, c, doc, place = a[order], b[order], c[order], doc[order], place[order]
        new = np.concatenate([[True], (a[1:] != a[:-1]) | (b[1:] != b[:-1]) | (c[1:] != c[:-1])])
        local = np.cumsum(new) - 1
        return doc, place, local, int(local[-1]) + 1

    ranked, before, unique = _ranked(_dealt(texts, triples, width, n), name, ["<i8"] * 5, n)
    named = texts.join(settle(_home(ranked, before, n), "dc-names"), "doc", "left")
    discard(ranked)
    if unique or 3 * cover >= depth:
        return named

    def strings(batches):
        """The names of the places 1 modulo 3, a separator, and those of the places 2 modulo 3, as a text of the next level."""
        for batch in batches:
            out = []
            for blob, ranks in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                r, half = np.frombuffer(ranks or b"", "<i8"), len(range(1, len(blob) // 8, 3))
                out.append(np.concatenate([r[:half], [0], r[half:]]).astype("<i8").tobytes())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.binary())], names=["doc", "symbols"])

    next_width = max(2, (named.agg(F.sum(F.length("ranks"))).first()[0] or 0).bit_length())  # names are at most the places
    inner = settle(named.mapInArrow(strings, _TEXTS), "dc-strings")
    whole = all_ranks(sample_ranks(inner, next_width, depth, n, 3 * cover), next_width, n)

    def taken(batches):
        """Ranks of a whole string without that of its separator."""
        for batch in batches:
            out = []
            for blob, ranks in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                r = np.frombuffer(ranks or b"", "<i8")
                out.append(np.delete(r, len(range(1, len(blob) // 8, 3))).astype("<i8").tobytes() if len(r) else b"")
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(out, pa.binary())], names=["doc", "symbols", "ranks"])

    return settle(texts.join(whole, "doc", "left").select("doc", "symbols", "ranks").mapInArrow(taken, _TEXTS + ", ranks binary"), "dc-sample")


def _suffixes(row, width: int, wanted=None) -> tuple[np.ndarray, list[np.ndarray]]:
    """Records of the suffixes of a text: two symbols, the ranks one and two places on, and their own rank (0 if unknown)."""
    doc, blob, ranks = row
    s = _symbols(blob)
    m = len(s) - 3
    rank = np.zeros(m + 3, dtype=np.int64)
    rank[_sample_places(m)] = np.frombuffer(ranks or b"", "<i8")
    at = np.arange(m) if wanted is None else wanted(m)
    return _key(s[at], s[at + 1], width), [s[at], s[at + 1], rank[at], rank[at + 1], rank[at + 2], np.full(len(at), doc), at]


def merged_order(s0, s1, r0, r1, r2, place) -> np.ndarray:
    """Order of the suffixes of a range: the sample by rank, and the places 0 modulo 3 merged in."""
    kind = place % 3
    zero, sample = np.flatnonzero(kind == 0), np.flatnonzero(kind != 0)
    sample = sample[np.argsort(r0[sample], kind="stable")]
    zero = zero[np.lexsort((r1[zero], s0[zero]))]
    one, two = sample[kind[sample] == 1], sample[kind[sample] == 2]
    before = _rank_in((s0, r1), one, zero) + _rank_in((s0, s1, r2), two, zero)
    spot = np.maximum.accumulate(before) + np.arange(len(zero)) if len(zero) else np.zeros(0, np.int64)
    out = np.empty(len(place), dtype=np.int64)
    free = np.ones(len(place), dtype=bool)
    free[spot] = False
    out[spot], out[free] = zero, sample
    return out


def _rank_in(columns: tuple[np.ndarray, ...], known: np.ndarray, asked: np.ndarray) -> np.ndarray:
    """How many of the known rows come before each asked row in the order of the columns."""
    both = np.concatenate([asked, known])
    mine = np.concatenate([np.zeros(len(asked), np.int8), np.ones(len(known), np.int8)])  # asked rows before equal known ones
    order = np.lexsort((mine, *(c[both] for c in reversed(columns))))
    upto = np.cumsum(mine[order])
    out = np.empty(len(asked), dtype=np.int64)
    at = np.flatnonzero(mine[order] == 0)
    out[order[at]] = upto[at]
    return out


def all_ranks(sampled: DataFrame, width: int, n: int) -> DataFrame:
    """(doc, symbols of the string, ranks) of all places of each text."""

    def rank(s0, s1, r0, r1, r2, doc, place):
        order = merged_order(s0, s1, r0, r1, r2, place)
        return doc[order], place[order], np.arange(len(order)), len(order)

    ranked, before, _ = _ranked(_dealt(sampled, lambda row: _suffixes(row, width), width, n), rank, ["<i8"] * 7, n)
    return settle(_home(ranked, before, n), "dc-all")


def repeated_windows(texts: DataFrame, width: int, n: int) -> DataFrame:
    """(bucket, blob of doc and place) of the windows of `width` bytes that also start in a text with a smaller id.

    texts: (doc, symbols), a symbol is a byte plus one. Neighbours of the sorted suffixes that share a prefix of width bytes
    form a run, in which all texts but the least repeat.
    """
    bits = 9
    sampled = sample_ranks(texts, bits, width, n)

    def windows(row):
        keys, columns = _suffixes(row, bits, lambda m: np.arange(max(0, m - width + 1)))
        if len(keys) == 0:
            return keys, [*columns, np.zeros(0, f"V{width}")]
        data = (np.frombuffer(row[1], "<i8") - 1).astype(np.uint8)
        prefix = np.ascontiguousarray(np.lib.stride_tricks.sliding_window_view(data, width)).view(f"V{width}").ravel()
        return keys, [*columns, prefix]

    def work(batches):
        _, blobs = read_blobs(batches)
        if not blobs:
            return
        s0, s1, r0, r1, r2, doc, place, prefix = unpack(blobs, ["<i8"] * 7 + [f"V{width}"])
        order = merged_order(s0, s1, r0, r1, r2, place)
        doc, place, prefix = doc[order], place[order], prefix[order].view(np.uint8).reshape(-1, width)
        new = np.concatenate([[True], (prefix[1:] != prefix[:-1]).any(axis=1)])
        starts = np.flatnonzero(new)
        least = np.minimum.reduceat(doc, starts)
        again = doc != np.repeat(least, np.diff(np.append(starts, len(doc))))
        yield pa.RecordBatch.from_arrays([pa.array(doc[again]), pa.array(place[again])], names=["doc", "place"])
        tidy()

    return _dealt(sampled.select("doc", "symbols", "ranks"), windows, bits, n).mapInArrow(work, "doc long, place long")
