import math
import random
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from rulewright.llm import lm_score as L


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def counts(texts):
    c = Counter()
    for t in texts:
        w = words(t)
        for i in range(len(w)):
            for k in (1, 2):
                if i >= k - 1:
                    c[tuple(w[i - k + 1 : i + 1])] += 1
    return c


def loss(w, c, n, v, scale=1.0):
    out = 0
    for i in range(len(w)):
        p = (c[(w[i],)] * scale + 0.5) / (n * scale + 0.5 * (v + 1))
        if i:
            own, context = c[tuple(w[i - 1 : i + 1])] * scale, c[(w[i - 1],)] * scale
            p = (own + 4 * p) / (max(context, own) + 4)
        out -= math.log(p)
    return out


def check(rows, target, background):
    """Every row against plain dictionaries; a document's own counts are taken off the background."""
    ct, cb = counts(t for _, t in target), counts(t for _, t in background)
    one = lambda c: {k: n for k, n in c.items() if len(k) == 1}
    nt, nb, v = sum(one(ct).values()), sum(one(cb).values()), len(one(ct).keys() | one(cb).keys())
    scale = nt / nb if nt and nb else 1.0
    texts = dict(background)
    assert sorted(r["doc_id"] for r in rows) == sorted(texts)
    for r in rows:
        w = words(texts[r["doc_id"]])
        assert r["n_tokens"] == len(w)
        if not w:
            assert r["target_loss"] is None and r["background_loss"] is None and r["difference"] is None
            continue
        rest = cb.copy()
        rest.subtract(counts([texts[r["doc_id"]]]))
        assert abs(r["target_loss"] - loss(w, ct, nt, v) / len(w)) < 1e-9
        assert abs(r["background_loss"] - loss(w, rest, nb - len(w), v, scale) / len(w)) < 1e-9


@pytest.mark.parametrize("chunk", [L.CHUNK_BYTES, 300])
def test_matches_plain_counts(docs, edge, chunk):
    rnd = random.Random(1)
    make = lambda n: [(i, " ".join(rnd.choice(("a", "b", "é", "B", "long")) for _ in range(rnd.randint(0, 30)))) for i in range(n)] + [(900, None), (901, " \t")]
    target, background = make(30), make(60) + edge
    check(L.score(docs(background), docs(target), ["doc_id", "n"], chunk_bytes=chunk).collect(), target, background)


def test_fifty_thousand_random_words(docs):
    rnd = random.Random(2)
    pool = [f"{rnd.choice('klmnöp')}{rnd.randrange(10**6)}" for _ in range(50_000)]
    make = lambda n: [(i, " ".join(rnd.choice(pool) for _ in range(rnd.randint(500, 1500)))) for i in range(n)]
    target, background = make(40), make(60)
    check(L.score(docs(background), docs(target), ["doc_id"], chunk_bytes=100_000).collect(), target, background)


def test_texts_that_occur_twice_are_known_to_the_background(docs):
    rnd = random.Random(3)
    rows = [(i, " ".join(f"w{rnd.randrange(5000)}" for _ in range(60))) for i in range(200)]
    rows += [(1000 + i, t) for i, t in rows[:10]]
    target = [(0, "w1 w2 w3")]
    got = {r["doc_id"]: r["background_loss"] for r in L.score(docs(rows), docs(target), ["doc_id"]).collect()}
    twice = {i for i, _ in rows[:10]} | set(range(1000, 1010))
    assert max(got[i] for i in twice) < min(v for i, v in got.items() if i not in twice)


def test_empty_models_long_texts_and_clashing_columns(docs, edge):
    none = docs(edge).where("false")
    r = {x["doc_id"]: x for x in L.score(docs(edge), none, ["doc_id"]).collect()}
    check(r.values(), [], edge)
    assert r[9001]["n_tokens"] == 0 and r[9001]["difference"] is None
    assert L.score(none, none, ["doc_id"]).count() == 0
    rnd = random.Random(4)
    long = [(1, " ".join(f"w{rnd.randrange(10**6)}" for _ in range(140_000))), (2, None), (3, "w1")]
    df = docs(long).withColumn("target_loss", F.lit("kept out"))
    check(L.score(df, df, ["doc_id"]).collect(), long, long)
    again = L.score(df, df, ["doc_id", "target_loss"])
    assert again.columns == ["doc_id", "n_tokens", "target_loss", "background_loss", "difference"] and again.where("doc_id = 1").first()["target_loss"] > 0


def test_more_ranges_than_shuffle_partitions(spark, monkeypatch):
    monkeypatch.setattr(L, "RANGE_BYTES", 300)
    rows = [(i, " ".join(f"w{(i * k) % 17}" for k in range(40))) for i in range(30)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    goal = df.where("doc_id < 3")
    many = {r.doc_id: r.difference for r in L.score(df, goal, ["doc_id"], chunk_bytes=500).collect()}
    monkeypatch.undo()
    few = {r.doc_id: r.difference for r in L.score(df, goal, ["doc_id"]).collect()}
    assert many == pytest.approx(few) and len(many) == 30
