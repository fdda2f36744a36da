"""Embedding near-dedup by int8 tile products with rigorous quantisation bounds.

Each unit vector u is written as s * q + e with q of int8 and a known |e|. For two vectors the exact int8 product gives
S = s_u s_v (q_u . q_v), and the cosine differs from S by at most E = |s_u q_u| |e_v| + |e_u| |s_v q_v| + |e_u| |e_v|.
Pairs with S + E below the threshold are none, pairs with S - E above it are links, and only pairs in between are computed
again in double precision.

1. Exact copies are collapsed. The distinct vectors are dealt to cells of the nearest pivot and each cell to blocks of
   bounded size; a block is one row of int8 values, scales and bounds.
2. A tile is a pair of blocks. A block goes to a tile without the vectors which, by the triangle inequality of angles,
   can reach no member of the other block; where none is left there is no tile.
3. A tile counts its sure links and returns a spanning forest of them, and names the vectors of its pairs in between.
4. Only those vectors travel in full precision, to the tiles that named them, where the pairs in between are decided.

Vectors that are null or zero, or hold null or non-finite components, link with nothing; so do vectors of different
lengths. Repeated vectors link with each other. Rows without an id are left out; an empty table gives no rows; other
columns, whatever their names, are not read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from rulewright.llm._components import components, label_pairs
from rulewright.llm._memory import tidy
from rulewright.llm._store import discard, settle, shuffle_partitions
from rulewright.llm._text import mix64

#: Vectors of a block; pivots of a length (one for each block, within these bounds); lengths that get pivots, the most
#: frequent ones (vectors of other lengths share one cell, which changes blocks and no result); rows of a product strip.
BLOCK, PIVOTS, MAX_PIVOTS, LENGTHS, STRIP = 2048, 16, 512, 16, 256
#: Centres of blocks that are broadcast at once; more blocks take several passes over the blocks.
CENTRES = 1 << 13
#: Room for the rounding of single-precision products and bounds.
SLACK = 1e-5


def _rows_of(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Values, offsets and validity of a list<double> column; a list with a null component is invalid."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    sizes = np.array(column.value_lengths().fill_null(0), dtype=np.int64)
    flat = column.flatten()
    values = flat.fill_null(float("nan")).to_numpy(zero_copy_only=False).astype(np.float64)
    return values, np.concatenate([[0], np.cumsum(sizes)]).astype(np.int64), sizes > 0


def _prepare(df: DataFrame, id_col: str, vector: str) -> DataFrame:
    """(vec_id, dim, f1, f2, raw): fingerprint of the components and the components as doubles; dim 0 if it links with nothing."""

    def work(batches):
        tidy()
        for batch in batches:
            values, at, ok = _rows_of(batch.column(1))
            values = values + 0.0
            with np.errstate(all="ignore"):
                finite = np.array([bool(np.isfinite(values[a:b]).all()) for a, b in zip(at[:-1], at[1:], strict=True)], dtype=bool)
                bits = values.view(np.uint64)
                place = np.concatenate([np.arange(n, dtype=np.uint64) for n in np.diff(at)]) if len(values) else np.zeros(0, np.uint64)
                prints = []
                for salt in (0x9E3779B97F4A7C15, 0xD1B54A32D192ED03):
                    h = np.concatenate([[np.uint64(0)], np.cumsum(mix64(mix64(bits ^ np.uint64(salt)) + place * np.uint64(salt)))])
                    prints.append(mix64(h[at[1:]] - h[at[:-1]]).view(np.int64))
            # A vector whose squares leave the range of doubles is scaled before its norm is taken.
            peak = np.array([np.abs(values[a:b]).max() if b > a else 0.0 for a, b in zip(at[:-1], at[1:], strict=True)])
            good = ok & finite & (peak > 0)
            raw = [(values[a:b] / p).tobytes() if g and not 1e-100 < p < 1e100 else values[a:b].tobytes() if g else None for a, b, g, p in zip(at[:-1], at[1:], good, peak, strict=True)]
            dim = np.where(good, np.diff(at), 0).astype(np.int32)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(dim), pa.array(prints[0]), pa.array(prints[1]), pa.array(raw, pa.binary())], names=["vec_id", "dim", "f1", "f2", "raw"])

    source = df.select(df[id_col].cast("long").alias("vec_id"), df[vector].cast("array<double>").alias("v")).where("vec_id IS NOT NULL")
    return source.mapInArrow(work, "vec_id long, dim int, f1 long, f2 long, raw binary")


def _unit(raw: list[bytes]) -> np.ndarray:
    x = np.stack([np.frombuffer(r, dtype=np.float64) for r in raw])
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def _pivots(reps: DataFrame) -> dict[int, np.ndarray]:
    """Unit vectors with the least hash of their id, for the most frequent lengths; they only shape the blocks."""
    sizes = reps.groupBy("dim").agg(F.count(F.lit(1)).alias("m")).orderBy(F.col("m").desc(), "dim").limit(LENGTHS)
    sizes = sizes.withColumn("k", F.least(F.greatest(F.ceil(F.col("m") / BLOCK), F.lit(PIVOTS)), F.lit(MAX_PIVOTS)))
    few = reps.join(F.broadcast(sizes), "dim").where(F.pmod(F.xxhash64("vec_id"), F.greatest(F.lit(1), F.floor(F.col("m") / (4 * F.col("k"))))) == 0)
    order = Window.partitionBy("dim").orderBy(F.xxhash64("vec_id"), "vec_id")
    rows = few.withColumn("r", F.row_number().over(order)).where("r <= k").select("dim", "raw").collect()
    return {d: _unit([bytes(r["raw"]) for r in rows if r["dim"] == d]) for d in {r["dim"] for r in rows}}


def _cells(reps: DataFrame, pivots: dict[int, np.ndarray]) -> DataFrame:
    """reps with the number of the nearest pivot of their length."""
    shared = reps.sparkSession.sparkContext.broadcast(pivots)

    def work(batches):
        for batch in batches:
            dim = batch.column(1).to_numpy()
            cell = np.zeros(len(dim), dtype=np.int32)
            raw = batch.column(3).to_pylist()
            for d in np.unique(dim):
                if int(d) in shared.value:
                    at = np.flatnonzero(dim == d)
                    cell[at] = np.argmax(_unit([raw[i] for i in at]) @ shared.value[int(d)].T, axis=1)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(cell)], names=["vec_id", "dim", "copies", "raw", "cell"])

    return reps.mapInArrow(work, "vec_id long, dim int, copies long, raw binary, cell int")


class Quantised:
    """Unit vectors as int8 values with a scale, the norm of what the values stand for and the norm of what they miss."""

    def __init__(self, q: np.ndarray, scale: np.ndarray, norm: np.ndarray, error: np.ndarray):
        self.q, self.scale, self.norm, self.error = q, scale, norm, error

    @classmethod
    def of(cls, unit: np.ndarray) -> Quantised:
        scale = (np.abs(unit).max(axis=1) / 127).astype(np.float32)
        q = np.clip(np.rint(unit / scale[:, None].astype(np.float64)), -127, 127).astype(np.int8)
        near = q * scale[:, None].astype(np.float64)
        up = lambda x: np.nextafter((x + 1e-12).astype(np.float32), np.float32(2))
        return cls(q, scale, up(np.sqrt((near**2).sum(axis=1))), up(np.sqrt(((unit - near) ** 2).sum(axis=1))))

    def take(self, at: np.ndarray | slice) -> Quantised:
        return Quantised(self.q[at], self.scale[at], self.norm[at], self.error[at])

    def blob(self) -> bytes:
        return self.q.tobytes() + b"".join(x.tobytes() for x in (self.scale, self.norm, self.error))

    @classmethod
    def load(cls, blob: bytes, n: int, dim: int) -> Quantised:
        q = np.frombuffer(blob, np.int8, n * dim).reshape(n, dim)
        return cls(q, *(np.frombuffer(blob, np.float32, n, n * dim + 4 * n * k) for k in range(3)))


def _blocks(cells: DataFrame, parts: int) -> DataFrame:
    """(block, dim, n, ids, copies, q, centre, radius): packed blocks of about BLOCK vectors of one cell at most."""
    sizes = cells.groupBy("dim", "cell").agg(F.count(F.lit(1)).alias("m"))
    dealt = cells.join(sizes, ["dim", "cell"]).withColumn("part", F.pmod(F.xxhash64("vec_id"), F.ceil(F.col("m") / BLOCK)))

    def pack(batches):
        tidy()
        held: dict[tuple, list] = {}
        for batch in batches:
            cols = [c.to_pylist() for c in batch.columns]
            for key, *row in zip(zip(*cols[:3], strict=True), *cols[3:], strict=True):
                held.setdefault(key, []).append(row)
        for (dim, cell, part), rows in held.items():
            rows.sort(key=lambda r: r[0])
            unit = _unit([r[2] for r in rows])
            centre = unit.sum(axis=0)
            norm = np.sqrt(centre @ centre)
            centre = centre / norm if norm > 0 else unit[0]
            radius = float(np.arccos(np.clip(unit @ centre, -1, 1)).max())
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([f"{dim}:{cell}:{part}"]), pa.array([dim], pa.int32()), pa.array([len(rows)], pa.int64()),
                    pa.array([np.array([r[0] for r in rows], dtype="<i8").tobytes()], pa.binary()), pa.array([np.array([r[1] for r in rows], dtype="<i8").tobytes()], pa.binary()),
                    pa.array([Quantised.of(unit).blob()], pa.binary()), pa.array([centre.tobytes()], pa.binary()), pa.array([radius]),
                ],
                names=["block", "dim", "n", "ids", "copies", "q", "centre", "radius"],
            )

    source = dealt.select("dim", "cell", "part", "vec_id", "copies", "raw").repartition(parts, "dim", "cell", "part")
    return source.mapInArrow(pack, "block string, dim int, n long, ids binary, copies binary, q binary, centre binary, radius double")


_MEMBERS = "tile string, side int, dim int, ids binary, copies binary, q binary"


def _members(blocks: DataFrame, threshold: float) -> DataFrame:
    """(tile, side, ...): the part of each block that may reach the other block of a tile; one pass for each CENTRES blocks."""
    reach = float(np.arccos(np.clip(threshold, -1, 1))) + 1e-6
    total = blocks.count()
    passes = -(-total // CENTRES) if total else 0
    out = None
    for k in range(passes):
        own = blocks.where(F.pmod(F.xxhash64("block"), F.lit(passes)) == k).select("block", "dim", "centre", "radius")
        known: dict[int, list] = {}
        for name, dim, centre, radius in own.toLocalIterator():
            known.setdefault(dim, []).append((name, np.frombuffer(centre), radius))
        table = {d: ([x[0] for x in v], np.stack([x[1] for x in v]), np.array([x[2] for x in v])) for d, v in known.items()}
        shared = blocks.sparkSession.sparkContext.broadcast(table)

        def work(batches, shared=shared):
            for batch in batches:
                for name, dim, n, ids, copies, blob, centre, radius in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                    if dim not in shared.value:
                        continue
                    names, centres, radii = shared.value[dim]
                    angle = np.arccos(np.clip(centres @ np.frombuffer(centre), -1, 1))
                    near = np.flatnonzero(angle - radii - radius <= reach)
                    if len(near) == 0:
                        continue
                    block = Quantised.load(blob, n, dim)
                    ids, copies = np.frombuffer(ids, "<i8"), np.frombuffer(copies, "<i8")
                    for j in near:
                        if names[j] == name:
                            at = slice(None)
                        else:
                            towards = (block.q.astype(np.float32) @ centres[j].astype(np.float32)) * block.scale + block.error + SLACK
                            at = np.flatnonzero(np.arccos(np.clip(towards, -1, 1)) - radii[j] <= reach + SLACK)
                            if len(at) == 0:
                                continue
                        row = ["|".join(sorted((name, names[j]))), int(name > names[j]), dim, ids[at].tobytes(), copies[at].tobytes(), block.take(at).blob()]
                        kinds = [pa.string(), pa.int32(), pa.int32(), pa.binary(), pa.binary(), pa.binary()]
                        yield pa.RecordBatch.from_arrays([pa.array([x], t) for x, t in zip(row, kinds, strict=True)], names=["tile", "side", "dim", "ids", "copies", "q"])
            tidy()

        part = blocks.mapInArrow(work, _MEMBERS)
        out = part if out is None else out.union(part)
    return out if out is not None else blocks.sparkSession.createDataFrame([], _MEMBERS)


def near_pairs(a: Quantised, b: Quantised | None, threshold: float):
    """(i, j, sure) of the pairs of a and b, or of i < j within a, that the bounds do not exclude, a strip at a time."""
    own = b is None
    b = a if own else b
    # Products of int8 values and their sums are exact in single precision up to 1040 components.
    kind = np.float32 if a.q.shape[1] <= 1040 else np.float64
    right = b.q.astype(kind).T
    for lo in range(0, len(a.q), STRIP):
        left = a.take(slice(lo, lo + STRIP))
        first = lo if own else 0
        s = (left.q.astype(kind) @ right[:, first:]).astype(np.float32) * left.scale[:, None] * b.scale[None, first:]
        e = left.norm[:, None] * b.error[None, first:] + left.error[:, None] * (b.norm + b.error)[None, first:]
        i, j = np.nonzero(s + e >= threshold - SLACK)
        sure = s[i, j] - e[i, j] >= threshold + SLACK
        i, j = i + lo, j + first
        if own:
            keep = j > i
            i, j, sure = i[keep], j[keep], sure[keep]
        for k in range(0, len(i), 1 << 16):
            yield i[k : k + (1 << 16)], j[k : k + (1 << 16)], sure[k : k + (1 << 16)]


class _Links:
    """Link counts and a spanning forest over the vectors of a tile."""

    def __init__(self, ids: np.ndarray, copies: np.ndarray):
        self.ids, self.copies = ids, copies
        self.counts, self.label = np.zeros(len(ids), dtype=np.int64), np.arange(len(ids))

    def add(self, x: np.ndarray, y: np.ndarray) -> None:
        np.add.at(self.counts, x, self.copies[y])
        np.add.at(self.counts, y, self.copies[x])
        self.label = label_pairs(len(self.ids), x, y, self.label)


_FOUND = "vec_id long, links long, root long, tile string, side int"


def _found(links: _Links) -> pa.RecordBatch:
    at = np.flatnonzero(links.counts)
    return pa.RecordBatch.from_arrays([pa.array(links.ids[at]), pa.array(links.counts[at]), pa.array(links.ids[links.label[at]]), pa.nulls(len(at), pa.string()), pa.nulls(len(at), pa.int32())], names=["vec_id", "links", "root", "tile", "side"])


def _tiles(members: DataFrame, threshold: float, parts: int) -> DataFrame:
    """(vec_id, links, root): partial counts and forest of sure links; (vec_id, tile, side): vectors of pairs in between."""

    def work(batches):
        tidy()
        waiting: tuple[str, tuple] | None = None
        for batch in batches:
            for i in range(batch.num_rows):  # a row is a block, up to megabytes; the two of a tile come one after the other
                tile, side, dim, ids, copies, blob = (c[i].as_py() for c in batch.columns)
                one = (side, np.frombuffer(ids, "<i8"), np.frombuffer(copies, "<i8"), Quantised.load(blob, len(ids) // 8, dim))
                left, right = tile.split("|")
                if left != right:
                    if waiting is None or waiting[0] != tile:  # a block may wait for one that has no vector in reach
                        waiting = (tile, one)
                        continue
                    one, two, waiting = waiting[1], one, None
                else:
                    two = None
                links = _Links(one[1], one[2]) if two is None else _Links(np.concatenate([one[1], two[1]]), np.concatenate([one[2], two[2]]))
                shift = 0 if two is None else len(one[1])
                open_ = np.zeros(len(links.ids), dtype=bool)
                for x, y, sure in near_pairs(one[3], None if two is None else two[3], threshold):
                    links.add(x[sure], y[sure] + shift)
                    open_[x[~sure]] = open_[y[~sure] + shift] = True
                yield _found(links)
                at = np.flatnonzero(open_)
                if len(at):
                    none = pa.nulls(len(at), pa.int64())
                    side = pa.array((at >= shift).astype(np.int32) if two is not None else np.zeros(len(at), np.int32))
                    yield pa.RecordBatch.from_arrays([pa.array(links.ids[at]), none, none, pa.array([tile] * len(at)), side], names=["vec_id", "links", "root", "tile", "side"])
        tidy()

    return members.repartition(parts, "tile").sortWithinPartitions("tile", "side").mapInArrow(work, _FOUND)


def _recomputed(open_: DataFrame, reps: DataFrame, threshold: float, parts: int) -> DataFrame:
    """Partial counts and forest of the pairs in between, from their full-precision vectors."""
    rows = open_.join(reps.select("vec_id", "copies", "raw"), "vec_id").select("tile", "side", "vec_id", "copies", "raw")

    def tile_rows(batches):
        """The rows of one tile after the other; they come sorted."""
        name, held = None, []
        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if row[0] != name and held:
                    yield name, held
                    held = []
                name = row[0]
                held.append(row[1:])
        if held:
            yield name, held

    def work(batches):
        tidy()
        for tile, held in tile_rows(batches):
            side, ids, copies = (np.array(x) for x in zip(*(r[:3] for r in held), strict=True))
            raw = np.stack([np.frombuffer(r[3], dtype=np.float64) for r in held])
            length = np.sqrt((raw * raw).sum(axis=1))
            unit = raw / length[:, None]
            links = _Links(ids, copies)
            one = np.flatnonzero(side == 0)
            left, right = tile.split("|")
            two = one if left == right else np.flatnonzero(side == 1)
            # The same values and bounds as before, so the same pairs are in between.
            pairs = near_pairs(Quantised.of(unit[one]), None if left == right else Quantised.of(unit[two]), threshold)
            for x, y, sure in pairs:
                u, v = one[x[~sure]], two[y[~sure]]
                good = (raw[u] * raw[v]).sum(axis=1) / (length[u] * length[v]) >= threshold
                links.add(u[good], v[good])
            yield _found(links)
        tidy()

    return rows.repartition(parts, "tile").sortWithinPartitions("tile", "side", "vec_id").mapInArrow(work, _FOUND)


def near_duplicates(df: DataFrame, threshold: float = 0.9, id_col: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """(vec_id, n_links, component_id, kept) for each row with an id."""
    parts = shuffle_partitions(df.sparkSession)
    rows = settle(_prepare(df, id_col, vector), "vectors")
    good = rows.where("dim > 0")
    copies = settle(good.groupBy("dim", "f1", "f2").agg(F.min("vec_id").alias("rep"), F.count(F.lit(1)).alias("copies")), "vector-copies")
    reps = settle(good.join(copies.select(F.col("rep").alias("vec_id"), "copies"), "vec_id").select("vec_id", "dim", "copies", "raw"), "vector-reps")
    blocks = settle(_blocks(_cells(reps, _pivots(reps)), parts), "vector-blocks")
    found = settle(_tiles(_members(blocks, threshold), threshold, parts), "vector-links")
    again = settle(_recomputed(found.where("tile IS NOT NULL").select("tile", "side", "vec_id"), reps, threshold, parts), "vector-open")
    linked = found.where("tile IS NULL").union(again)
    counts = settle(linked.groupBy("vec_id").agg(F.sum("links").alias("links")), "vector-counts")
    classes = components(linked.select(F.col("root").alias("a"), F.col("vec_id").alias("b")).where("a <> b"))
    discard(blocks, reps, found, again)
    member = rows.select("vec_id", "dim", "f1", "f2").join(copies, ["dim", "f1", "f2"], "left")
    out = member.join(counts.withColumnRenamed("vec_id", "rep"), "rep", "left").join(classes.select(F.col("id").alias("rep"), "component"), "rep", "left")
    component = F.coalesce("component", "rep", "vec_id")
    return out.select("vec_id", (F.coalesce("links", F.lit(0)) + F.coalesce("copies", F.lit(1)) - 1).alias("n_links"), component.alias("component_id"), (F.col("vec_id") == component).alias("kept"))
