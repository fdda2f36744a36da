"""N-gram Jaccard join: size-banded tiles with hashed bitmap signatures.

Two documents link when their sets of distinct word 5-grams have a Jaccard similarity of at least 0.8 (compared in
integers: 100 * intersection >= 80 * union). Words are ASCII-lower-cased runs of bytes other than ASCII white space; a
document with fewer words than five has its whole sequence as one gram; null, empty and blank texts have none and link
with nothing. Grams are 64-bit hashes.

1. One pass finds grams that many documents share. They come last in the order used below, the most frequent at the very
   end; the order only saves work.
2. A second pass gives each document its set size, a 128-bit fingerprint of the set, a bitmap signature, and the prefix
   keys of the set: two sets that link must share one of their first n - ceil(0.8 n) + 1 grams in the common order. Of sets
   that link, the first gram that both have stands at most at places i and j with min(n - i, m - j) >= 4 (n + m) / 9, so a
   key at place i reaches partners of at most (5 n - 9 i) / 4 grams.
3. Documents that share a key meet in tiles of a key and a size band: a band ends where no document reaches the next size,
   and documents without a partner that both reach leave. So pages of one template meet nobody, as their own grams come
   before those of the template. Bit counts of the signatures bound the overlap from above; pairs that could still reach
   the threshold make a candidate graph. A band of very many documents is a candidate group; its signatures are compared in
   the blocks of step 4.
4. Candidate components are verified by exact intersection of sorted arrays: first within blocks of a component, then
   between the classes found (one representative each), and where classes stay apart, every document outside the
   largest class against every other. A pair whose documents are connected already needs no test, so a group of n near
   copies costs about n intersections and no task holds more than a few blocks.
5. Connected components of the verified links, carried to exact copies through the fingerprints.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401  (pa.compute)
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rulewright.llm._blobs import Bloom, buckets_of, by_bucket, pack, read_blobs, unpack
from rulewright.llm._components import components, label_pairs
from rulewright.llm._store import partitions_for, settle
from rulewright.llm._text import distinct_sorted, lower_ascii, mix64, reduce_rows, shingle_hashes, slices, span_hashes, utf8, word_bounds

K = 5
#: Documents of a band beyond which its signatures are compared in blocks of verification, and documents of such a block.
TILE, BLOCK = 512, 128
#: A gram is put last in the order if windows of map tasks that see it in HOT_LOCAL documents at least see it in HOT_TOTAL
#: documents together; at most HOT_MAX of them, the most frequent (1 MB).
HOT_LOCAL, HOT_TOTAL, HOT_MAX = 2, 24, 1 << 17
FLUSH_KEYS = 1 << 19
SIG_LOW, SIG_HIGH = 64, 1 << 17


def _sets(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """doc ids, distinct sorted gram hashes of all rows, and their offsets."""
    data, offsets = utf8(batch.column(1))
    data = lower_ascii(data)
    starts, ends, first = word_bounds(data, offsets)
    grams, at = shingle_hashes(span_hashes(data, starts, ends), first, K)
    return (batch.column(0).to_numpy(zero_copy_only=False), *distinct_sorted(grams, at))


def _prefix(n: np.ndarray) -> np.ndarray:
    """Prefix lengths: a partner has at least 0.8 n grams."""
    return n - -(-4 * n // 5) + 1


def _size_code(n: np.ndarray) -> np.ndarray:
    """Sizes on a scale of ratio 1.02 (exact up to 50), rounded down; the order of sizes is kept."""
    return np.floor(np.log(np.maximum(n, 1)) / np.log(1.02)).astype(np.uint16)


def _frequent(docs: DataFrame) -> np.ndarray:
    """Grams that many documents of a map task share, the most frequent up to HOT_MAX, rarest first."""

    def work(batches):
        held, size = [], 0

        def flush():
            keys, counts = np.unique(np.concatenate(held), return_counts=True)
            keep = counts >= HOT_LOCAL
            return pa.RecordBatch.from_arrays([pa.array(keys[keep].view(np.int64)), pa.array(counts[keep])], names=["key", "n"])

        for batch in slices(batches, "text"):
            _, grams, _ = _sets(batch)
            held.append(grams)
            size += len(grams)
            if size >= 2 * FLUSH_KEYS:
                yield flush()
                held, size = [], 0
        if held:
            yield flush()

    top = docs.mapInArrow(work, "key long, n long").groupBy("key").agg(F.sum("n").alias("n")).where(F.col("n") >= HOT_TOTAL).orderBy(F.col("n").desc(), "key").limit(HOT_MAX)
    return top.select("key").toArrow().column("key").to_numpy().view(np.uint64)[::-1].copy()


def _rank(values: np.ndarray, table: np.ndarray, rank: np.ndarray) -> np.ndarray:
    """Place of each value in the order of frequent grams, from 1; 0 for grams that are not frequent."""
    if len(table) == 0:
        return np.zeros(len(values), dtype=np.int32)
    at = np.minimum(np.searchsorted(table, values), len(table) - 1)
    return np.where(table[at] == values, rank[at], 0).astype(np.int32)


def _signature(grams: np.ndarray) -> bytes:
    """A bitmap with two to four bits for each gram: bit (hash mod m) is set, m a power of two."""
    m = min(SIG_HIGH, max(SIG_LOW, 2 << int(len(grams) - 1).bit_length()))
    bits = np.zeros(m, dtype=np.uint8)
    bits[(grams >> np.uint64(7)) & np.uint64(m - 1)] = 1
    return np.packbits(bits, bitorder="little").tobytes()


def _scan(docs: DataFrame, hot: np.ndarray, n_buckets: int) -> DataFrame:
    """Document rows (doc_id, n, f1, f2, sig) and blob rows (bucket, blob) of prefix keys."""
    order = np.argsort(hot)
    shared = docs.sparkSession.sparkContext.broadcast((hot[order], (order + 1).astype(np.int32)))
    names = ["doc_id", "n", "f1", "f2", "sig", "bucket", "blob"]

    def rows(ids, n, f1, f2, sig, bucket, blob, count):
        fill = lambda x, kind: pa.nulls(count, kind) if x is None else pa.array(x, type=kind)
        return pa.RecordBatch.from_arrays([fill(ids, pa.int64()), fill(n, pa.int64()), fill(f1, pa.int64()), fill(f2, pa.int64()), fill(sig, pa.binary()), fill(bucket, pa.int32()), fill(blob, pa.binary())], names=names)

    def work(batches):
        late = shared.value
        held: list[tuple[np.ndarray, ...]] = []
        seen: set[tuple[int, int]] = set()
        size = 0

        def flush():
            key, *rest = (np.concatenate(x) for x in zip(*held, strict=True))
            got = list(pack([(key & np.uint64(0xFFFFFFFF)).astype(np.uint32), *rest], buckets_of(key, n_buckets), n_buckets))
            return rows(None, None, None, None, None, [g[0] for g in got], [g[1] for g in got], len(got))

        for batch in slices(batches, "text"):
            ids, grams, at = _sets(batch)
            n = np.diff(at)
            with np.errstate(over="ignore"):
                f1 = reduce_rows(np.add, mix64(grams ^ np.uint64(0x5851F42D4C957F2D)), at, 0)
                f2 = reduce_rows(np.add, mix64(grams ^ np.uint64(0x14057B7EF767814F)), at, 0)
            late_rank = _rank(grams, *late)
            sigs = [_signature(grams[a:b]) if b > a else None for a, b in zip(at[:-1], at[1:], strict=True)]
            yield rows(ids, n, f1.view(np.int64), f2.view(np.int64), sigs, None, None, len(ids))
            whole = _prefix(n)
            keys, taken = [], []
            for i in np.flatnonzero(n):
                mark = (int(f1[i]), int(f2[i]))
                if mark in seen:
                    continue
                seen.add(mark)
                g, l = grams[at[i] : at[i + 1]], late_rank[at[i] : at[i + 1]]
                if l.any():
                    g = g[np.argsort(l, kind="stable")]
                keys.append(g[: whole[i]])
                taken.append(i)
            if keys:
                count = whole[taken]
                place = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
                size_of = np.repeat(n[taken], count)
                reach = (5 * size_of - 9 * place) // 4
                held.append((mix64(np.concatenate(keys)), np.repeat(ids[taken], count), _size_code(size_of), _size_code(reach)))
                size += len(held[-1][0])
            if size >= FLUSH_KEYS:
                yield flush()
                held, size = [], 0
                seen.clear()
        if held:
            yield flush()

    return docs.mapInArrow(work, "doc_id long, n long, f1 long, f2 long, sig binary, bucket int, blob binary")


def _bands(group: np.ndarray, doc: np.ndarray, size: np.ndarray, reach: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(band, doc) of the documents of each key that have a partner, where two are partners if each reaches the other's size."""
    none = np.zeros(0, np.int64)
    if len(group) == 0:
        return none, none
    order = np.lexsort((doc, size, group))
    group, doc, size, reach = group[order], doc[order], size[order], reach[order]
    line = group << 16  # the keys one after the other on one line
    top = np.maximum.accumulate(line + reach)
    last = np.searchsorted(line + size, line + np.minimum(size, reach), side="right") - 1
    partner = (last >= 0) & (top[last] >= line + size)  # the smaller of two partners reaches the larger one's size, and its own
    group, doc, size, reach, line = group[partner], doc[partner], size[partner], reach[partner], line[partner]
    if len(group) == 0:
        return none, none
    top = np.maximum.accumulate(line + reach)
    cut = np.concatenate([[True], (line + size)[1:] > top[:-1]])
    band = np.cumsum(cut) - 1
    counts = np.diff(np.append(np.flatnonzero(cut), len(band)))
    some = np.repeat(counts > 1, counts)
    return band[some], doc[some]


def _groups(blobs: DataFrame, n_buckets: int) -> DataFrame:
    """(t1, t2, docs, a, b): the documents of a band's tile, or candidate edges a - b of a band of very many documents.

    Near copies share most of their keys, so the same documents meet again and again: a tile is named by a 128-bit hash of
    its documents, by which repetitions are dropped.
    """
    names = ["t1", "t2", "docs", "a", "b"]

    def work(batches):
        bucket, parts = read_blobs(batches)
        if not parts:
            return
        key, doc, size, reach = unpack(parts, ["<u4", "<i8", "<u2", "<u2"])
        del parts
        order = np.argsort(key, kind="stable")
        key, doc, size, reach = key[order], doc[order], size[order], reach[order]
        new = np.concatenate([[True], key[1:] != key[:-1]])
        counts = np.diff(np.append(np.flatnonzero(new), len(key)))
        many = np.repeat(counts > 1, counts)
        group, doc, size, reach = (np.cumsum(new) - 1)[many], doc[many], size[many].astype(np.int64), reach[many].astype(np.int64)
        key, doc = _bands(group, doc, size, reach)
        if len(key) == 0:
            return
        starts = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
        counts = np.diff(np.append(starts, len(key)))
        big = counts > TILE
        kept = np.flatnonzero(~big)
        with np.errstate(over="ignore"):
            t1 = np.add.reduceat(mix64(doc.astype(np.uint64)), starts)[kept]
            t2 = np.add.reduceat(mix64(doc.astype(np.uint64) ^ np.uint64(0x2545F4914F6CDD1D)), starts)[kept]
        first = np.unique(np.stack([t1, t2]), axis=1, return_index=True)[1]
        kept, t1, t2 = kept[first], t1[first].view(np.int64), t2[first].view(np.int64)
        inside = np.zeros(len(starts), bool)
        inside[kept] = True
        order = np.argsort(kept)
        lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(counts[np.sort(kept)])]).astype(np.int32)), pa.array(doc[np.repeat(inside, counts)]))
        none = pa.nulls(len(kept), pa.int64())
        yield pa.RecordBatch.from_arrays([pa.array(t1[order]), pa.array(t2[order]), lists, none, none], names=names)
        edges = [np.stack([np.full(c, doc[s : s + c].min()), doc[s : s + c]]) for s, c in zip(starts[big], counts[big], strict=True)]
        if edges:
            pairs = np.unique(np.concatenate(edges, axis=1), axis=1)
            none = pa.nulls(pairs.shape[1], pa.int64())
            yield pa.RecordBatch.from_arrays([none, none, pa.nulls(pairs.shape[1], pa.list_(pa.int64())), pa.array(pairs[0]), pa.array(pairs[1])], names=names)

    return by_bucket(blobs, n_buckets).mapInArrow(work, "t1 long, t2 long, docs array<long>, a long, b long")


def _pairs_within(starts: np.ndarray, counts: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Index pairs of all groups, a bounded number at a time."""
    for size in np.unique(counts[counts > 1]):
        first = starts[counts == size]
        i, j = np.triu_indices(size, 1)
        step = max(1, (1 << 20) // len(i))
        for k in range(0, len(first), step):
            base = first[k : k + step, None]
            yield (base + i).ravel(), (base + j).ravel()


class _Signatures:
    """Bitmaps of documents, folded to every smaller width (or-ing halves keeps the bound)."""

    def __init__(self, sigs: list[bytes], sizes: np.ndarray):
        self.sizes = sizes
        self.width = np.array([len(s) * 8 for s in sigs], dtype=np.int64)
        self.row = {}
        self.bits = {}
        level = SIG_HIGH
        carried: np.ndarray | None = None
        carried_at = np.zeros(0, np.int64)
        while level >= SIG_LOW:
            own = np.flatnonzero(self.width == level)
            now = np.frombuffer(b"".join(sigs[i] for i in own), dtype=np.uint64).reshape(len(own), level // 64)
            if carried is not None and len(carried):
                half = carried.shape[1] // 2
                now = np.concatenate([carried[:, :half] | carried[:, half:], now])
            at = np.concatenate([carried_at, own])
            row = np.full(len(sigs), -1, dtype=np.int64)
            row[at] = np.arange(len(at))
            self.row[level], self.bits[level], carried, carried_at = row, now, now, at
            level //= 2

    def may_link(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Whether the bound on the overlap lets a pair reach the threshold: 9 * overlap >= 4 * (|a| + |b|)."""
        na, nb = self.sizes[a], self.sizes[b]
        out = (5 * na >= 4 * nb) & (5 * nb >= 4 * na)
        width = np.minimum(self.width[a], self.width[b])
        for level, bits in self.bits.items():
            at = np.flatnonzero(out & (width == level))
            if len(at) == 0:
                continue
            x, y = bits[self.row[level][a[at]]], bits[self.row[level][b[at]]]
            only_a = np.bitwise_count(x & ~y).sum(axis=1, dtype=np.int64)
            only_b = np.bitwise_count(y & ~x).sum(axis=1, dtype=np.int64)
            bound = np.minimum(na[at] - only_a, nb[at] - only_b)
            out[at] = 9 * bound >= 4 * (na[at] + nb[at])
        return out


def _candidate_edges(members: DataFrame, sigs: DataFrame, parts: int) -> DataFrame:
    """Candidate edges (a, b): a spanning forest of the pairs in tiles that pass the bound, for each task."""
    full = members.join(sigs, members["a"] == sigs["doc_id"]).select("tile", "doc_id", "n", "sig").repartition(parts, "tile")

    def work(batches):
        tiles, ids, sizes, sig_of = [], [], [], {}
        for batch in batches:
            doc = batch.column(1).to_numpy(zero_copy_only=False)
            tiles.append(batch.column(0).to_numpy(zero_copy_only=False))
            ids.append(doc)
            sizes.append(batch.column(2).to_numpy(zero_copy_only=False))
            column = batch.column(3)
            for i in np.unique(doc, return_index=True)[1]:
                sig_of.setdefault(int(doc[i]), column[int(i)].as_py())
        if not tiles:
            return
        tile, doc, size = np.concatenate(tiles), np.concatenate(ids), np.concatenate(sizes)
        uniq, at, local = np.unique(doc, return_index=True, return_inverse=True)
        table = _Signatures([sig_of[int(d)] for d in uniq], size[at])
        order = np.lexsort((local, tile))
        tile, local = tile[order], local[order]
        starts = np.flatnonzero(np.concatenate([[True], tile[1:] != tile[:-1]]))
        label = np.arange(len(uniq))
        for i, j in _pairs_within(starts, np.diff(np.append(starts, len(tile)))):
            a, b = local[i], local[j]
            apart = label[a] != label[b]
            pair = np.unique(a[apart] * len(uniq) + b[apart])
            a, b = pair // len(uniq), pair % len(uniq)
            ok = table.may_link(a, b)
            label = label_pairs(len(uniq), a[ok], b[ok], label)
        out = np.flatnonzero(label != np.arange(len(uniq)))
        yield pa.RecordBatch.from_arrays([pa.array(uniq[label[out]]), pa.array(uniq[out])], names=["a", "b"])

    return full.mapInArrow(work, "a long, b long")


def _exact_labels(ids: np.ndarray, sets: list[np.ndarray], against: np.ndarray | None = None) -> np.ndarray:
    """Index of the smallest connected member (by position), by exact intersections within one tile.

    against: class of each member known so far; members of one class are not compared again.
    """
    n = len(ids)
    sizes = np.array([len(s) for s in sets], dtype=np.int64)
    table = _Signatures([_signature(s) for s in sets], sizes)
    label = np.arange(n)
    if against is not None:
        _, first, inverse = np.unique(against, return_index=True, return_inverse=True)
        label = first[inverse]
    order = np.argsort(sizes, kind="stable")
    ranked = sizes[order]
    for r in range(n):
        i = order[r]
        js = order[r + 1 : np.searchsorted(ranked, sizes[i] * 5 // 4, side="right")]
        js = js[label[js] != label[i]]
        if len(js) == 0:
            continue
        js = js[table.may_link(np.full(len(js), i), js)]
        for j in js:
            if label[j] == label[i]:
                continue
            common = len(np.intersect1d(sets[i], sets[j], assume_unique=True))
            if 100 * common >= 80 * (sizes[i] + sizes[j] - common):
                low, high = sorted((label[i], label[j]))
                label[label == high] = low
    return label


def _verify(rows: DataFrame, parts: int, known: bool = False) -> DataFrame:
    """rows (tile, doc_id, set[, cls]): verified edges (a, b) within each tile, a spanning forest; every member once more as (a, a)."""
    names = ["tile", "doc_id", "set"] + ["cls"] * known

    def work(batches):
        tile, ids, sets, cls = [], [], [], []
        for batch in batches:
            tile.append(batch.column(0).to_numpy(zero_copy_only=False))
            ids.append(batch.column(1).to_numpy(zero_copy_only=False))
            sets += [np.frombuffer(x, dtype=np.uint64) for x in batch.column(2).to_pylist()]
            if known:
                cls.append(batch.column(3).to_numpy(zero_copy_only=False))
        if not tile:
            return
        tile, ids = np.concatenate(tile), np.concatenate(ids)
        cls = np.concatenate(cls) if known else None
        order = np.lexsort((ids, tile))
        starts = np.flatnonzero(np.concatenate([[True], tile[order][1:] != tile[order][:-1]]))
        for s, e in zip(starts, np.append(starts[1:], len(order)), strict=True):
            at = order[s:e]
            label = _exact_labels(ids[at], [sets[k] for k in at], cls[at] if known else None)
            yield pa.RecordBatch.from_arrays([pa.array(ids[at][label]), pa.array(ids[at])], names=["a", "b"])

    return rows.select(names).repartition(parts, "tile").mapInArrow(work, "a long, b long")


def _set_rows(docs: DataFrame, wanted: Bloom) -> DataFrame:
    shared = docs.sparkSession.sparkContext.broadcast(wanted)

    def work(batches):
        bloom = shared.value
        for batch in batches:
            hit = bloom.hits(batch.column(0).to_numpy(zero_copy_only=False))
            for piece in slices(iter([batch.filter(pa.array(hit))]), "text"):
                ids, grams, at = _sets(piece)
                yield pa.RecordBatch.from_arrays([pa.array(ids), pa.array([grams[a:b].tobytes() for a, b in zip(at[:-1], at[1:], strict=True)], pa.binary())], names=["doc_id", "set"])

    return docs.mapInArrow(work, "doc_id long, set binary")


def jaccard_classes(df: DataFrame, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, n_shingles, component_id) for each row of df with an id: component_id is the smallest id reachable by links.

    Ids are unique integers; rows with a null id are left out. Repeated texts link with each other; an empty table gives
    no rows. Other columns, whatever their names, are not read.
    """
    docs = df.select(df[id_col].cast("long").alias("doc_id"), df[text].alias("text")).where("doc_id IS NOT NULL")
    parts = partitions_for([docs], "text")
    scanned = settle(_scan(docs, _frequent(docs), parts), "ngram-scan")
    rows = scanned.where("doc_id IS NOT NULL").select("doc_id", "n", "f1", "f2", "sig")
    groups = settle(_groups(scanned.where("bucket IS NOT NULL"), parts), "ngram-groups")
    members = groups.where("b IS NULL").dropDuplicates(["t1", "t2"]).select(F.col("t1").alias("tile"), F.explode("docs").alias("a"))
    near = _candidate_edges(members, rows.where("n > 0").select("doc_id", "n", "sig"), parts)
    candidates = components(near.union(groups.where("b IS NOT NULL").select("a", "b")))
    verified = settle(_verified(docs, candidates, parts), "ngram-links")
    copies = settle(rows.where("n > 0").groupBy("f1", "f2").agg(F.min("doc_id").alias("rep")), "ngram-copies")
    member = settle(rows.select("doc_id", "n", "f1", "f2").join(copies, ["f1", "f2"], "left").select("doc_id", "n", F.when(F.col("n") > 0, F.col("rep")).otherwise(F.col("doc_id")).alias("rep")), "ngram-member")
    first = member.select(F.col("doc_id").alias("a"), F.col("rep").alias("ra"))
    second = member.select(F.col("doc_id").alias("b"), F.col("rep").alias("rb"))
    links = verified.where("a <> b").join(first, "a").join(second, "b").select(F.col("ra").alias("a"), F.col("rb").alias("b"))
    found = components(links).withColumnRenamed("id", "rep")
    return member.join(found, "rep", "left").select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("component", "rep").alias("component_id"))


def _verified(docs: DataFrame, candidates: DataFrame, parts: int) -> DataFrame:
    """Verified links (a, b) that connect exactly what exact intersections connect inside each candidate component."""
    sizes = candidates.groupBy("component").agg(F.count(F.lit(1)).alias("m"))
    # The blocks of a component are numbered by a hash of the document.
    member = candidates.join(sizes, "component").select(F.col("id").alias("doc_id"), "component", "m", F.pmod(F.xxhash64("id"), F.ceil(F.col("m") / BLOCK)).alias("block"))
    member = settle(member, "ngram-blocks")
    sets = settle(_set_rows(docs, Bloom.of(member, "doc_id")).join(member, "doc_id"), "ngram-sets")
    within = settle(_verify(sets.withColumn("tile", F.xxhash64("component", "block")), parts), "ngram-within")
    large = sets.where(F.col("m") > BLOCK)
    if large.isEmpty():
        return within
    # One representative of each class of a block; then classes of the component.
    reps = large.join(within.select("a").distinct(), F.col("doc_id") == F.col("a"), "left_semi")
    few = reps.groupBy("component").agg(F.count(F.lit(1)).alias("r"))
    reps = settle(reps.join(few, "component").withColumn("block", F.pmod(F.xxhash64("doc_id", F.lit(1)), F.ceil(F.col("r") / BLOCK))), "ngram-reps")
    between = settle(_verify(reps.withColumn("tile", F.xxhash64("component", "block")), parts), "ngram-between")
    classes = components(within.union(between)).select(F.col("id").alias("doc_id"), F.col("component").alias("cls"))
    state = large.select("doc_id", "component", "m").join(classes, "doc_id")
    count = state.groupBy("component", "cls").agg(F.count(F.lit(1)).alias("c"))
    top = count.groupBy("component").agg(F.max(F.struct("c", "cls")).alias("top"), F.count(F.lit(1)).alias("k")).where("k > 1")
    open_ = settle(state.join(top, "component").select("doc_id", "component", "m", "cls", (F.col("cls") != F.col("top.cls")).alias("minor")), "ngram-open")
    if open_.isEmpty():
        return within.union(between)
    # Every document outside the largest class against every document of the component, block by block.
    minors = open_.where("minor").groupBy("component").agg(F.ceil(F.count(F.lit(1)) / BLOCK).alias("mk"))
    both = open_.join(minors, "component").withColumn("vk", F.ceil(F.col("m") / BLOCK))
    as_minor = both.where("minor").select("doc_id", "component", "cls", F.pmod(F.xxhash64("doc_id"), F.col("mk")).alias("mb"), F.explode(F.sequence(F.lit(0).cast("long"), F.col("vk") - 1)).alias("vb"))
    as_any = both.select("doc_id", "component", "cls", F.explode(F.sequence(F.lit(0).cast("long"), F.col("mk") - 1)).alias("mb"), F.pmod(F.xxhash64("doc_id"), F.col("vk")).alias("vb"))
    tiles = as_minor.union(as_any).select(F.xxhash64("component", "mb", "vb").alias("tile"), "doc_id", "cls").distinct()
    rest = _verify(tiles.join(sets.select("doc_id", "set"), "doc_id"), parts, known=True)
    return within.union(between).union(rest.where("a <> b"))


def drop_copies(df: DataFrame, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of df of which each class of linked documents keeps one, that with the smallest id; rows without an id stay.

    Texts are not shuffled: a Bloom set of the dropped ids lets the rows it misses pass at once, and only the others are
    compared with the dropped ids in an anti join.
    """
    found = settle(jaccard_classes(df, id_col, text), "ngram-classes")
    dropped = found.where("doc_id <> component_id").select(F.col("doc_id").alias("__dropped"))
    shared = df.sparkSession.sparkContext.broadcast(Bloom.of(dropped, "__dropped"))
    at = df.columns.index(id_col)

    def where(hit: bool):
        def work(batches):
            for batch in batches:
                ids = batch.column(at)
                some = pa.compute.is_valid(ids).to_numpy(zero_copy_only=False)
                got = some & shared.value.hits(pa.compute.fill_null(ids, 0).to_numpy(zero_copy_only=False).astype(np.int64))
                yield batch.filter(pa.array(got == hit))

        return work

    sure = df.mapInArrow(where(False), df.schema)
    open_ = df.mapInArrow(where(True), df.schema)
    return sure.union(open_.join(dropped, open_[id_col] == dropped["__dropped"], "left_anti"))
