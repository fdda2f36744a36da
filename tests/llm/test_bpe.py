import hashlib
import random

import numpy as np
import pyarrow as pa
from tokenizers import Tokenizer

from rulewright.llm import bpe
from rulewright.llm.length_report import context_limits, histogram, quantile_lengths


def plain(texts):
    t = Tokenizer.from_file(bpe.vocabulary())
    ids = [e.ids for e in t.encode_batch([x or "" for x in texts], add_special_tokens=False)]
    return [(np.array(i, dtype="<u4").tobytes(), t.decode(i, skip_special_tokens=False).encode()) for i in ids]


def texts():
    rnd = random.Random(1)
    parts = ["a", "b", " ", "  ", "\n", "\t", " ", " ", "é", "<|endoftext|>", "'s", "12", ".", " you", " the same passage again", "😀", "x" * 9, "\r\n"]
    return ["".join(rnd.choice(parts) for _ in range(rnd.randint(0, 80))) for _ in range(800)] + ["", None, "a" * 150_000 + " b", "é" * 70_000]


def test_equals_the_library():
    enc = bpe.ChunkEncoder(bpe.vocabulary())
    assert enc.certified
    data = texts()
    got = []
    for i in range(0, len(data), 100):
        got += enc.encode_batch(pa.array(data[i : i + 100], pa.string()))
    assert got == plain(data)


def test_equals_the_library_without_certified_cuts(monkeypatch):
    enc = bpe.ChunkEncoder(bpe.vocabulary(), run_bytes=64)
    enc.certified = False
    data = texts()[:200]
    assert enc.encode_batch(pa.array(data, pa.string())) == plain(data)


def test_caches_do_not_change_results(monkeypatch):
    monkeypatch.setattr(bpe, "CACHE_PIECES", 5)
    monkeypatch.setattr(bpe, "CACHE_CHUNKS", 5)
    enc = bpe.ChunkEncoder(bpe.vocabulary())
    data = texts()[:300]
    got = []
    for i in range(0, len(data), 10):
        got += enc.encode_batch(pa.array(data[i : i + 10], pa.string()))
    assert got == plain(data)


def test_columns(docs, edge):
    rows = bpe.round_trip(docs(edge), ["doc_id"]).collect()
    want = {d: p for (d, _), p in zip(edge, plain([t for _, t in edge]), strict=True)}
    assert {r["doc_id"]: (r["n_tokens"], r["ids_sha256"], r["decoded_sha256"]) for r in rows} == {d: (len(i) // 4, hashlib.sha256(i).hexdigest(), hashlib.sha256(b).hexdigest()) for d, (i, b) in want.items()}
    back = bpe.decode(bpe.encode(docs(edge)))
    assert {r["doc_id"]: r["decoded"] for r in back.collect()} == {d: t or "" for d, t in edge}


def test_length_report(docs, edge):
    lengths = sorted(len(i) // 4 for i, _ in plain([t for _, t in edge]))
    limits = context_limits(histogram(docs(edge)))
    rows = {r["context_limit"]: r for r in limits.collect()}
    assert sorted(rows) == sorted(set(lengths))
    for limit, r in rows.items():
        assert r["n_docs"] == lengths.count(limit) and r["docs_upto"] == sum(x <= limit for x in lengths)
        assert r["tokens_total"] == sum(lengths) and r["tokens_truncated"] == sum(min(x, limit) for x in lengths)
    got = {r["share"]: r["n_tokens"] for r in quantile_lengths(limits, [0.5, 1.0]).collect()}
    assert got == {0.5: lengths[(len(lengths) + 1) // 2 - 1], 1.0: lengths[-1]}
    assert context_limits(histogram(docs(edge).where("false"))).count() == 0


def test_clashing_columns_null_ids_and_repeated_rows(spark):
    """A column that is called like a result gives way to it; every row is encoded, whatever its id."""
    long = "some words again " * 70_000
    rows = [(None, "one two"), (2, None), (3, long), (3, long), (4, "")]
    df = spark.createDataFrame([(i, t, "old", 9, "x") for i, t in rows], "doc_id long, text string, ids string, n_tokens int, decoded string")
    want = [len(i) // 4 for i, _ in plain([t for _, t in rows])]
    got = bpe.round_trip(df, ["doc_id", "n_tokens"])
    assert got.columns == ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"] and sorted(r["n_tokens"] for r in got.collect()) == sorted(want)
    coded = bpe.encode(df)
    assert coded.columns.count("ids") == 1 and sorted(len(r["ids"]) for r in coded.collect()) == sorted(want)
    assert sorted(r["decoded"] for r in bpe.decode(coded).collect()) == sorted(t or "" for _, t in rows)
    hist = histogram(df)
    assert sum(r["n_docs"] for r in hist.collect()) == 5 and {r["n_tokens"] for r in hist.collect()} == set(want)


def test_chunks_come_again_from_the_old_generation(monkeypatch):
    monkeypatch.setattr(bpe, "CACHE_CHUNKS", 3)
    enc = bpe.ChunkEncoder(bpe.vocabulary())
    calls = []
    real = enc._encode_chunks
    monkeypatch.setattr(enc, "_encode_chunks", lambda fresh: calls.append(len(fresh)) or real(fresh))
    text = "the very same passage, told and told again, until it ends. " * 3
    for i in range(6):
        enc.encode_batch(pa.array([text, f"something else {i} " * 4], pa.string()))
    assert sum(calls) < 6 * calls[0]
