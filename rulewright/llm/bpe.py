"""BPE encoding and decoding by content-defined chunk reuse.

A text is cut at white space where a rolling hash of the bytes before it hits a mask, so the cut depends on content only
and equal passages of different documents give equal chunks. A chunk is encoded once by each worker (in pieces at the
white space inside it, which are reused likewise) and looked up afterwards. A cut is certified when the tokenizer's
pre-tokenizer starts a new piece there whatever stands around it: before a space or line feed that follows a solid
character. Cuts that must be made elsewhere (long runs without such a place) are repaired: the tokens on both sides are
decoded and encoded again together, over a growing window, until the outer tokens agree exactly.

A worker keeps two generations of chunks: when the young one is full it becomes the old one, and a chunk of the old one that
is met again is young again. So chunks that come again and again are never encoded twice by a worker, whatever lies between.

Nulls and empty texts have no tokens. Repeated rows give repeated results, and very long texts are encoded whole. Other
columns pass through untouched, but one that is called like a result gives way to it. The vocabulary file is a parameter and
is read by each worker.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from rulewright.llm._text import slices, utf8

#: Chunks of a generation and pieces that a worker keeps; memory is bounded, and results are equal whatever is kept.
CACHE_CHUNKS, CACHE_PIECES = 20_000, 250_000
#: Longest chunk that is worth keeping, and the longest run without a certified cut before it is cut anywhere.
KEEP_BYTES, RUN_BYTES = 4_096, 65_536
MASK = 31


def vocabulary(name: str = "byte_bpe_50k.json") -> str:
    """Path of a public tokenizer file."""
    import public_tokenizers

    return public_tokenizers.path(name)


class ChunkEncoder:
    """Encodes UTF-8 texts with one tokenizers.Tokenizer; ids are little-endian unsigned 32-bit integers in bytes."""

    def __init__(self, path: str, mask: int = MASK, run_bytes: int = RUN_BYTES):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.mask, self.run_bytes = mask, run_bytes
        self.chunks: dict[bytes, tuple[bytes, bytes]] = {}
        self.older: dict[bytes, tuple[bytes, bytes]] = {}
        self.pieces: dict[bytes, bytes] = {}  # ids of pieces; each decodes to itself but those in odd
        self.odd: dict[bytes, bytes] = {}
        # White space certifies a cut only for a byte-level pre-tokenizer with its own pattern, no normalizer and no prefix space.
        with open(path, encoding="utf-8") as f:
            said = json.load(f)
        pre = said.get("pre_tokenizer") or {}
        strips = any(t.get("lstrip") or t.get("rstrip") or t["content"] != t["content"].strip() for t in said.get("added_tokens", ()))
        self.certified = said.get("normalizer") is None and pre.get("type") == "ByteLevel" and not pre.get("add_prefix_space") and pre.get("use_regex", True) and not strips
        special = {t["id"] for t in said.get("added_tokens", ())}
        size = self.tokenizer.get_vocab_size(with_added_tokens=True)
        names = [self.tokenizer.id_to_token(i) or "" for i in range(size)]
        # A byte-level token has one character for each byte; an added token is spelt as it is.
        self.token_bytes = np.array([len(t.encode()) if i in special else len(t) for i, t in enumerate(names)], dtype=np.int64)

    def anchors(self, data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Certified places (a space or line feed after a solid character), and which of them end a chunk."""
        n = len(data)
        if n < 16 or not self.certified:
            return np.zeros(0, np.int64), np.zeros(0, bool)
        at = np.flatnonzero((data[8:] == 32) | (data[8:] == 10)) + 8
        last = data[at - 1]
        at = at[((last > 32) & (last < 127)) | ((last >= 128) & (last < 192) & (data[at - 2] >= 0xC3) & (data[at - 2] < 0xE0))]
        h = np.zeros(len(at), dtype=np.uint32)
        for j in range(8, 0, -1):
            h = h * np.uint32(0x01000193) + data[at - j]
        h ^= h >> np.uint32(15)
        return at, (h & np.uint32(self.mask)) == 0

    def encode_batch(self, column: pa.Array) -> list[tuple[bytes, bytes]]:
        """(ids, decoded UTF-8) of each row."""
        data, offsets = utf8(column)
        at, ends = self.anchors(data)
        raw, where = data.tobytes(), np.searchsorted(at, offsets)
        rows, fresh = [], {}  # the chunks of each row; the pieces of chunks that are met for the first time
        for i in range(len(offsets) - 1):
            a, b = int(offsets[i]), int(offsets[i + 1])
            lo, hi = int(where[i]), int(where[i + 1])
            while lo < hi and at[lo] < a + 8:  # the hash there would cover bytes of the row before
                lo += 1
            own, closing = at[lo:hi].tolist(), np.flatnonzero(ends[lo:hi]).tolist()
            chunks, begin, k = [], a, 0
            for c in [*closing, len(own)]:
                stop = own[c] if c < len(own) else b
                if stop > begin:
                    chunks.append(chunk := raw[begin:stop])
                    if chunk not in self.chunks and chunk not in fresh and not self._again(chunk):
                        cut = [begin, *own[k:c], stop] if k < c or own[k:c] else [begin, stop]
                        fresh[chunk] = [raw[x:y] for x, y in zip(cut[:-1], cut[1:], strict=True)]
                begin, k = stop, c + 1
            rows.append(chunks)
        made = self._encode_chunks(fresh)
        ready = self.chunks
        out = []
        for chunks in rows:
            got = [ready.get(x) or made[x] for x in chunks]
            out.append((b"".join([x[0] for x in got]), b"".join([x[1] for x in got])))
        ready.update((k, v) for k, v in made.items() if len(k) <= KEEP_BYTES)
        if len(ready) > CACHE_CHUNKS:
            self.older, self.chunks = ready, {}
        return out

    def _again(self, chunk: bytes) -> bool:
        """Whether the chunk is of the old generation; it is young from now on."""
        got = self.older.get(chunk)
        if got is not None:
            self.chunks[chunk] = got
        return got is not None

    def _encode_chunks(self, fresh: dict[bytes, list[bytes]]) -> dict[bytes, tuple[bytes, bytes]]:
        known, odd = self.pieces, self.odd
        used: set[bytes] = set()
        for ps in fresh.values():
            used.update(ps)
        wanted = used.difference(known)
        # Pieces that begin and end at certified cuts stay apart in a longer text, so one call encodes them all.
        inner = [p for p in wanted if p[0] in b" \n" and (32 < p[-1] < 127 or (0x80 <= p[-1] < 0xC0 and 0xC3 <= p[-2] < 0xE0)) and len(p) <= self.run_bytes] if self.certified else []
        local = self._encode_joined(inner)
        for p in wanted.difference(local) if len(local) < len(wanted) else ():
            local[p], back = self.long_run(p) if len(p) > self.run_bytes else self._encode_one(p)
            if back != p:
                odd[p] = back
        known.update(local)
        find = known.__getitem__
        out = {c: (b"".join(map(find, ps)), c) for c, ps in fresh.items()}
        if odd:
            for c, ps in fresh.items():
                if not odd.keys().isdisjoint(ps):
                    out[c] = (out[c][0], b"".join([odd.get(p, p) for p in ps]))
        for p in local:
            if len(p) > 64:
                del known[p]
        if len(known) > CACHE_PIECES:  # what these chunks use is likely to come again
            self.pieces = {p: known[p] for p in used if p in known}
        if len(odd) > 1000:
            odd.clear()
            self.pieces = {}
            self.chunks.clear()
            self.older.clear()
        return out

    def _encode_one(self, piece: bytes) -> tuple[bytes, bytes]:
        ids = self.tokenizer.encode(piece.decode("utf-8", "replace"), add_special_tokens=False).ids
        return np.array(ids, dtype="<u4").tobytes(), self.tokenizer.decode(ids, skip_special_tokens=False).encode()

    def _encode_joined(self, pieces: list[bytes]) -> dict[bytes, bytes]:
        """Encode and decode the pieces as one text, then split its ids by the byte length of its tokens; none if they do not come back."""
        if not pieces:
            return {}
        joined = b"".join(pieces)
        ids = np.array(self.tokenizer.encode_batch_fast([joined.decode()], add_special_tokens=False)[0].ids, dtype="<u4")
        ends = np.cumsum([len(p) for p in pieces])
        reach = np.cumsum(self.token_bytes[ids])
        cut = np.searchsorted(reach, ends)
        if len(ids) == 0 or reach[-1] != ends[-1] or not np.array_equal(reach[cut], ends) or self.tokenizer.decode(ids.tolist(), skip_special_tokens=False).encode() != joined:
            return {}
        raw, cut = ids.tobytes(), ((cut + 1) * 4).tolist()
        return {p: raw[a:b] for p, a, b in zip(pieces, [0, *cut[:-1]], cut, strict=True)}

    def long_run(self, text: bytes) -> tuple[bytes, bytes]:
        """A run without a certified cut: forced cuts at code points, each join repaired until exact agreement."""
        bounds = [0]
        while bounds[-1] < len(text):
            end = min(bounds[-1] + self.run_bytes, len(text))
            while end < len(text) and 0x80 <= text[end] < 0xC0:
                end -= 1
            bounds.append(end)
        done: list[int] = []
        for a, b in zip(bounds[:-1], bounds[1:], strict=True):
            right = self.tokenizer.encode(text[a:b].decode("utf-8", "replace"), add_special_tokens=False).ids
            done = self._join(done, right) if done else right
        ids = np.array(done, dtype="<u4").tobytes()
        return ids, self.tokenizer.decode(done, skip_special_tokens=False).encode()

    def _join(self, left: list[int], right: list[int]) -> list[int]:
        """Re-encode a window around the join, growing it until its outer halves come back unchanged."""
        n = 64
        while True:
            l, r = left[-n:], right[:n]
            whole = n >= len(left) and n >= len(right)
            text = self.tokenizer.decode(l + r, skip_special_tokens=False)
            again = self.tokenizer.encode(text, add_special_tokens=False).ids
            k = n // 2
            if whole or ("�" not in text and again[:k] == l[:k] and again[-k:] == r[-k:]):
                return left[: max(0, len(left) - n)] + again + right[n:]
            n *= 4


_encoders: dict[str, ChunkEncoder] = {}


def encoder(path: str) -> ChunkEncoder:
    """The worker's encoder of this vocabulary; its chunk tables last as long as the worker."""
    if path not in _encoders:
        _encoders[path] = ChunkEncoder(path)
    return _encoders[path]


def map_tokens(df: DataFrame, fields: list[T.StructField], make: Callable[[bytes, bytes], tuple], keep: list[str], text: str = "text", path: str | None = None) -> DataFrame:
    """keep columns plus make(ids, decoded) for each row."""
    path = path or vocabulary()
    names = [f.name for f in fields]
    keep = [c for c in keep if c not in names]
    schema = T.StructType([df.schema[c] for c in keep] + fields)

    def work(batches):
        import os

        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        enc = encoder(path)
        for batch in slices(batches, "__text"):
            rows = [make(*x) for x in enc.encode_batch(batch.column(batch.schema.get_field_index("__text")))]
            columns = [batch.column(batch.schema.get_field_index(c)) for c in keep]
            for i, f in enumerate(fields):
                columns.append(pa.array([r[i] for r in rows], type=_arrow(f.dataType)))
            yield pa.RecordBatch.from_arrays(columns, names=[*keep, *names])

    return df.select(*[df[c] for c in keep], df[text].alias("__text")).mapInArrow(work, schema)


def _arrow(kind: T.DataType) -> pa.DataType:
    if isinstance(kind, T.ArrayType):
        return pa.list_(_arrow(kind.elementType))
    return {"bigint": pa.int64(), "string": pa.string(), "int": pa.int32(), "binary": pa.binary()}[kind.simpleString()]


def encode(df: DataFrame, text: str = "text", path: str | None = None, out: str = "ids") -> DataFrame:
    """df with the token ids of its text as array<int> (null and empty text: an empty array)."""
    return map_tokens(df, [T.StructField(out, T.ArrayType(T.IntegerType(), False))], lambda ids, _: (np.frombuffer(ids, "<i4"),), df.columns, text, path)


def decode(df: DataFrame, ids: str = "ids", path: str | None = None, out: str = "decoded") -> DataFrame:
    """df with the text of its token ids (null ids: null)."""
    path = path or vocabulary()
    df = df.drop(out) if out != ids else df.withColumnRenamed(ids, "__ids")
    ids = ids if out != ids else "__ids"
    keep = df.columns
    schema = T.StructType([*df.schema.fields, T.StructField(out, T.StringType())])

    def work(batches):
        tokenizer = encoder(path).tokenizer
        for batch in batches:
            rows = batch.column(batch.schema.get_field_index(ids)).to_pylist()
            texts = tokenizer.decode_batch([r or [] for r in rows], skip_special_tokens=False)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array([None if r is None else t for r, t in zip(rows, texts, strict=True)], pa.string())], names=[*keep, out])

    return df.mapInArrow(work, schema)


def token_counts(df: DataFrame, keep: list[str], text: str = "text", path: str | None = None, out: str = "n_tokens") -> DataFrame:
    """keep columns and the number of tokens of each row's text."""
    return map_tokens(df, [T.StructField(out, T.LongType())], lambda ids, _: (len(ids) // 4,), keep, text, path)


def round_trip(df: DataFrame, keep: list[str], text: str = "text", path: str | None = None) -> DataFrame:
    """keep columns, n_tokens, ids_sha256 (ids as little-endian unsigned 32-bit integers) and decoded_sha256."""
    fields = [T.StructField("n_tokens", T.LongType()), T.StructField("ids_sha256", T.StringType()), T.StructField("decoded_sha256", T.StringType())]
    return map_tokens(df, fields, lambda ids, back: (len(ids) // 4, hashlib.sha256(ids).hexdigest(), hashlib.sha256(back).hexdigest()), keep, text, path)
