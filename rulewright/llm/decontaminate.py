"""Benchmark decontamination by the q-gram lemma.

A region of a document leaks a benchmark item of m characters if it can be turned into the item by at most e edits (insert,
delete or replace a character), e = floor(error_rate * m). By the q-gram lemma such a region shares at least m - q + 1 - q e
of the item's q-grams, all on diagonals that lie at most e apart. So q-grams shared by document and item are counted in
diagonal bands of width 2 (e + 1) that overlap by half, bands that reach the bound are retained, and banded alignment
verifies them and finds where the region starts and ends. A q-gram of very many items tells nothing of any of them: it is left
out for every item whose bound exceeds the number of such grams that it has, and the bound is lowered by that number, so no
region is lost.

Characters are code points; upper-case ASCII and Latin-1 letters are lowered and white space of any kind is a space. Each
item has its own q, the largest up to Q for which e edits leave a q-gram for sure: min(Q, floor(m / (e + 1))). So an item
of fewer than Q characters without edits is a single gram, and matches where it occurs. Null and empty items match nothing;
repeated items match each on their own. Null and empty documents match nothing. Only the two columns named are read; rows
without an id are left out.

The items are broadcast in blocks of at most BLOCK_CHARS characters; a larger benchmark takes one pass for each block.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from rulewright.llm._text import mix64, slices, utf8

Q, ERROR_RATE, BLOCK_CHARS, TABLE_BITS = 10, 0.08, 4 << 20, 22
#: Shared q-grams that are counted at once, and cells of bands that are aligned at once.
HITS, ALIGN_CELLS = 1 << 21, 1 << 18
#: Items that may share a q-gram before the gram is left out of the count (the bound is lowered by as many grams).
COMMON = 16
BIG = 1 << 28
_FOLD = np.arange(256, dtype=np.uint32)
_FOLD[65:91] += 32
_FOLD[0xC0:0xDF] += 32
_FOLD[0xD7] = 0xD7
_FOLD[[9, 10, 11, 12, 13, 0x85, 0xA0]] = 32


def code_points(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Folded code points of a batch of UTF-8 texts, and the offsets of its rows."""
    points = np.frombuffer(data.tobytes().decode("utf-8", "replace").encode("utf-32-le"), dtype=np.uint32).copy()
    starts = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)])
    low = points < 256
    points[low] = _FOLD[points[low]]
    return points, starts[offsets]


def _grams(points: np.ndarray, q: int) -> np.ndarray:
    """Hash of the q-gram at each position, from hashes of halves."""
    if len(points) < q:
        return np.zeros(0, np.uint64)
    m = 0x9E3779B97F4A7C15
    with np.errstate(over="ignore"):
        level, size, out, used = points.astype(np.uint64), 1, None, 0
        rest = q
        n = len(points) - q + 1
        while rest:
            if rest & 1:
                part = level[used : used + n]
                out = part.copy() if out is None else out * np.uint64(pow(m, size, 1 << 64)) + part
                used += size
            rest >>= 1
            if rest:
                level = level[: len(level) - size] * np.uint64(pow(m, size, 1 << 64)) + level[size:]
                size *= 2
        return mix64(out)


class _Table:
    """The q-grams of the items that have one q."""

    def __init__(self, q: int, items: list[tuple[int, np.ndarray]]):
        self.q = q
        grams = [_grams(p, q) for _, p in items]
        h = np.concatenate(grams)
        item = np.repeat([i for i, _ in items], [len(g) for g in grams])
        place = np.concatenate([np.arange(len(g)) for g in grams])
        order = np.argsort(h, kind="stable")
        self.hash, self.item, self.place = h[order], item[order], place[order]

    def without_common(self, needed: np.ndarray) -> None:
        """Drop grams that more than COMMON items have from every item whose bound the others can still meet; needed is lowered."""
        new = np.concatenate([[True], self.hash[1:] != self.hash[:-1]])
        counts = np.diff(np.append(np.flatnonzero(new), len(self.hash)))
        common = np.repeat(counts > COMMON, counts)
        number = np.bincount(self.item[common], minlength=len(needed))
        lowered = (number > 0) & (needed - number >= 1)
        needed[lowered] -= number[lowered]
        keep = ~(common & lowered[self.item])
        self.hash, self.item, self.place = self.hash[keep], self.item[keep], self.place[keep]
        self.table = np.zeros(1 << TABLE_BITS, dtype=bool)
        self.table[(self.hash >> np.uint64(64 - TABLE_BITS)).astype(np.int64)] = True

    def hits(self, points: np.ndarray, offsets: np.ndarray):
        """Position, row, item and place in the item of each gram that a batch shares with an item, at most about HITS at once."""
        h = _grams(points, self.q)
        at = np.flatnonzero(self.table[(h >> np.uint64(64 - TABLE_BITS)).astype(np.int64)]) if len(h) else np.zeros(0, np.int64)
        lo = np.searchsorted(self.hash, h[at], side="left")
        hi = np.searchsorted(self.hash, h[at], side="right")
        found = hi > lo
        at, lo, hi = at[found], lo[found], hi[found]
        row = np.searchsorted(offsets, at, side="right") - 1
        inside = at + self.q <= offsets[row + 1]
        at, lo, hi, row = at[inside], lo[inside], hi[inside], row[inside]
        total = np.concatenate([[0], np.cumsum(hi - lo)])
        start = 0
        while start < len(at):
            stop = max(start + 1, int(np.searchsorted(total, total[start] + HITS, side="right")) - 1)
            times = (hi - lo)[start:stop]
            entry = np.repeat(lo[start:stop] - (np.cumsum(times) - times), times) + np.arange(times.sum())
            yield np.repeat(at[start:stop], times), np.repeat(row[start:stop], times), self.item[entry], self.place[entry]
            start = stop


def _summed(r: np.ndarray, i: np.ndarray, b: np.ndarray, c: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Sums of the counts of each (row, item, band)."""
    if len(r) == 0:
        return r, i, b, c
    order = np.lexsort((b, i, r))
    r, i, b, c = r[order], i[order], b[order], c[order]
    new = np.flatnonzero(np.concatenate([[True], (r[1:] != r[:-1]) | (i[1:] != i[:-1]) | (b[1:] != b[:-1])]))
    return r[new], i[new], b[new], np.add.reduceat(c, new)


class Items:
    """Benchmark items and the tables of their q-grams."""

    def __init__(self, rows: list[tuple[int, str]], q: int = Q, error_rate: float = ERROR_RATE):
        self.ids, self.points, self.edits, self.least, own = [], [], [], [], []
        for i, text in rows:
            raw = np.frombuffer((text or "").encode(), dtype=np.uint8)
            points, _ = code_points(raw, np.array([0, len(raw)]))
            m = len(points)
            if m == 0:
                continue
            e = min(int(error_rate * m), m - 1)
            own.append(min(q, m // (e + 1)))
            self.ids.append(i)
            self.points.append(points)
            self.edits.append(e)
            self.least.append(m - own[-1] + 1 - own[-1] * e)
        self.edits = np.array(self.edits, dtype=np.int64)
        self.width = self.edits + 1
        self.needed = np.array(self.least, dtype=np.int64)
        self.lengths = np.array([len(p) for p in self.points], dtype=np.int64)
        self.longest = int(self.lengths.max(initial=0))
        self.text = np.concatenate([*self.points, np.zeros(0, np.uint32)])
        self.at = np.cumsum(self.lengths) - self.lengths
        self.tables = [_Table(k, [(i, p) for i, (p, x) in enumerate(zip(self.points, own, strict=True)) if x == k]) for k in sorted(set(own))]
        for table in self.tables:
            table.without_common(self.needed)

    def regions(self, points: np.ndarray, offsets: np.ndarray) -> list[tuple[int, int, int, int, int]]:
        """(row, item, start, end, edits) of all regions of a batch."""
        counted = [(np.zeros(0, np.int64),) * 4]
        for table in self.tables:
            for at, row, item, place in table.hits(points, offsets):
                # Diagonals are counted from the row's start, plus the longest item so that none is negative. Band b holds
                # the diagonals [b w, (b + 2) w), so each diagonal is in two bands.
                band = (at - offsets[row] - place + self.longest) // self.width[item]
                r, i, b, c = _summed(row, item, band, np.ones(len(row), dtype=np.int64))
                counted += [(r, i, b, c), (r, i, b - 1, c)]
        r, i, b, c = _summed(*(np.concatenate(x) for x in zip(*counted, strict=True)))
        keep = c >= self.needed[i]
        return self._verified(points, offsets, r[keep], i[keep], b[keep])

    def _verified(self, points: np.ndarray, offsets: np.ndarray, row: np.ndarray, item: np.ndarray, band: np.ndarray) -> list[tuple[int, int, int, int, int]]:
        """Banded alignment of all retained bands, in pieces of bounded size, those of like shape together."""
        out = set()
        order = np.lexsort((self.lengths[item], self.width[item]))
        row, item, band = row[order], item[order], band[order]
        cells = np.cumsum(4 * self.width[item] + self.lengths[item])
        start = 0
        while start < len(row):
            limit = int(np.searchsorted(cells, cells[start] + ALIGN_CELLS, side="right"))
            at = slice(start, max(start + 1, limit))
            out.update(self._align(points, offsets, row[at], item[at], band[at]))
            start = at.stop
        return sorted(out)

    def _align(self, points: np.ndarray, offsets: np.ndarray, row: np.ndarray, item: np.ndarray, band: np.ndarray) -> list[tuple[int, int, int, int, int]]:
        """(row, item, start, end, edits) of the best region near the diagonals of each band, where it is within the budget."""
        edits, width, length = self.edits[item], self.width[item], self.lengths[item]
        low, span = band * width - self.longest - edits, 2 * width + 2 * edits
        first, size = offsets[row], offsets[row + 1] - offsets[row]
        begin = np.where(np.arange(int(span.max())) < span[:, None], 0, BIG)
        best, k, kept = _banded(points, first, size, False, self.text, self.at[item], length, low, begin, edits)
        row, item, first, edits, length, low = (x[kept] for x in (row, item, first, edits, length, low))
        end = low + k + length
        # The same backwards from that end, to find the start.
        begin = np.where(np.arange(2 * int(edits.max(initial=0)) + 1) == edits[:, None], 0, BIG)
        _, back, again = _banded(points, first, end, True, self.text, self.at[item], length, -edits, begin, edits)
        row, item, end, edits, length, best = (x[again] for x in (row, item, end, edits, length, best))
        start = np.maximum(0, end - (back - edits + length))
        return list(zip(*(x.tolist() for x in (row, item, start, end, best)), strict=True))


def _banded(points, first, size, backwards: bool, pattern, at, length, low, d, budget) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Least edits of each pattern near its diagonals low, low + 1, .., the diagonal (from low) where it ends, and which
    alignments stay within their budget (the others are dropped on the way).

    Row k is text points[first : first + size] against pattern[at : at + length], both reversed if backwards; d holds the
    costs of starting on each diagonal. A region may not start before the text or end behind it.
    """
    d = d.astype(np.int32)
    step = np.arange(d.shape[1])
    place = low[:, None] + step
    d = np.where((place < 0) | (place > size[:, None]), BIG, d)
    kept = np.arange(len(length))
    best, where = np.full(len(length), BIG, dtype=np.int64), np.zeros(len(length), dtype=np.int64)
    for j in range(int(length.max(initial=0))):
        done = length[kept] == j
        over = d.min(axis=1) > budget[kept]
        if done.any() or (j % 8 == 0 and over.any()):
            good = np.flatnonzero(done & ~over)
            where[kept[good]] = np.argmin(d[good], axis=1)
            best[kept[good]] = d[good].min(axis=1)
            stay = ~done & ~over
            kept, d, place = kept[stay], d[stay], place[stay]
            if len(kept) == 0:
                break
        letter = pattern[at[kept] + (length[kept] - 1 - j if backwards else j)]
        spot = place + j
        inside = (spot >= 0) & (spot < size[kept, None])
        source = first[kept, None] + (size[kept, None] - 1 - spot if backwards else spot)
        same = inside & (points[np.where(inside, source, 0)] == letter[:, None])
        x = d + ~same
        x[:, :-1] = np.minimum(x[:, :-1], d[:, 1:] + 1)
        x[(spot + 1 < 0) | (spot + 1 > size[kept, None])] = BIG
        d = (np.minimum.accumulate(x - step, axis=1) + step).astype(np.int32)
    if len(kept):
        where[kept], best[kept] = np.argmin(d, axis=1), d.min(axis=1)
    good = np.flatnonzero(best <= budget)
    return best[good], where[good], good


def find_leaks(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text: str = "text", item_col: str = "item_id", item_text: str = "text", q: int = Q, error_rate: float = ERROR_RATE) -> DataFrame:
    """(doc_id, item_id, region_start, region_end, edits) of every region, in code points, end exclusive."""
    source = docs.select(docs[id_col].cast("long").alias("doc_id"), docs[text].alias("text")).where("doc_id IS NOT NULL")
    out = None
    for items in _item_blocks(benchmark, item_col, item_text, q, error_rate):
        shared = docs.sparkSession.sparkContext.broadcast(items)

        def work(batches, shared=shared):
            for batch in slices(batches, "text"):
                ids = batch.column(0).to_numpy(zero_copy_only=False)
                points, offsets = code_points(*utf8(batch.column(1)))
                found = shared.value.regions(points, offsets)
                r, i, s, e, k = (np.array(x, dtype=np.int64) for x in zip(*found, strict=True)) if found else (np.zeros(0, np.int64),) * 5
                known = np.array(shared.value.ids, dtype=np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(ids[r]), pa.array(known[i]), pa.array(s), pa.array(e), pa.array(k)], names=["doc_id", "item_id", "region_start", "region_end", "edits"])

        part = source.mapInArrow(work, "doc_id long, item_id long, region_start long, region_end long, edits long")
        out = part if out is None else out.union(part)
    return out


def _item_blocks(benchmark: DataFrame, item_col: str, item_text: str, q: int, error_rate: float):
    """Items in blocks of bounded size, taken one after the other from an iterator over partitions."""
    own = benchmark.select(benchmark[item_col].cast("long").alias("i"), benchmark[item_text].alias("t")).where("i IS NOT NULL AND t IS NOT NULL")
    held, size, any_ = [], 0, False
    for row in own.orderBy("i", "t").toLocalIterator():
        held.append((row["i"], row["t"]))
        size += len(row["t"])
        if size >= BLOCK_CHARS:
            yield Items(held, q, error_rate)
            held, size, any_ = [], 0, True
    if held or not any_:
        yield Items(held, q, error_rate)


def drop_leaks(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text: str = "text", q: int = Q, error_rate: float = ERROR_RATE) -> DataFrame:
    """The rows of docs in which no item leaks, with all their columns; rows without an id are judged like the others. One pass for each block of items, no join."""
    out, names = docs, docs.columns
    for items in _item_blocks(benchmark, "item_id", "text", q, error_rate):
        shared = docs.sparkSession.sparkContext.broadcast(items)

        def work(batches, shared=shared):
            for batch in slices(batches, text):
                points, offsets = code_points(*utf8(batch.column(names.index(text))))
                clean = np.ones(batch.num_rows, dtype=bool)
                clean[[r[0] for r in shared.value.regions(points, offsets)]] = False
                yield batch.filter(pa.array(clean))

        out = out.mapInArrow(work, docs.schema)
    return out
