import hashlib
import random

import numpy as np

from rulewright.llm._dc3 import suffix_order
from rulewright.llm.suffix_dedup import dedup_digest


def brute(rows):
    first = {}
    for d, t in sorted(rows):
        b = (t or "").encode()
        for i in range(len(b) - 49):
            first.setdefault(b[i : i + 50], d)
    out = {}
    for d, t in rows:
        b = (t or "").encode()
        m = np.zeros(len(b) + 2, bool)
        for i in range(len(b) - 49):
            if first[b[i : i + 50]] < d:
                m[i + 1 : i + 51] = True
        kept = bytes(x for x, y in zip(b, m[1:], strict=False) if not y)
        out[d] = (len(b), int(m.sum()), int((m[1:] & ~m[:-1]).sum()), hashlib.sha256(kept).hexdigest())
    return out


def test_suffix_order():
    rnd = random.Random(1)
    for _ in range(200):
        s = bytes(rnd.choice(b"ab" if rnd.random() < 0.7 else b"abc") for _ in range(rnd.randint(1, 60)))
        assert suffix_order(np.frombuffer(s, dtype=np.uint8).astype(np.int64) + 1, 10**9).tolist() == sorted(range(len(s)), key=lambda i: s[i:])


def test_matches_brute_force(docs, edge):
    rnd = random.Random(5)
    passages = ["".join(rnd.choice("abcdefgh ") for _ in range(rnd.randint(30, 200))) for _ in range(9)]
    rows = [(10**6 + d, t) for d, t in edge if d != 9003]
    for i in range(90):
        parts = [rnd.choice(passages)[rnd.randint(0, 20) : rnd.randint(40, 200)] if rnd.random() < 0.5 else "".join(rnd.choice("abcé ") for _ in range(rnd.randint(0, 70))) for _ in range(rnd.randint(0, 6))]
        rows.append((3 * i + (1 << 33) * (i % 2), "".join(parts)))
    rows += [(10**7, "a" * 300), (10**7 + 1, "a" * 400), (5, "ab" * 100), (7, "ab" * 120)]
    rows = [(d, t) for d, t in {d: t for d, t in rows}.items()]
    rows = [(d, t if t is None or t else t) for d, t in sorted(rows, key=lambda r: r[0])]
    got = {r[0]: tuple(r)[1:5] for r in dedup_digest(docs(rows)).collect()}
    assert got == brute([(d, t or "") for d, t in rows])


def test_empty(docs):
    assert dedup_digest(docs([(1, "a")]).where("false")).count() == 0


def _spans(df):
    return {r["doc_id"]: np.frombuffer(r["spans"], "<i8").tolist() for r in df.collect()}


def test_the_distributed_sort_finds_the_same_spans(docs, edge):
    from rulewright.llm.suffix_dedup import removed_spans, sorted_spans

    rnd = random.Random(6)
    passages = ["".join(rnd.choice("abcd ") for _ in range(rnd.randint(40, 120))) for _ in range(5)]
    rows = [(10**6 + d, t) for d, t in edge] + [(10**7, "a" * 120), (10**7 + 1, "a" * 150), (5, "ab" * 60), (7, "ab" * 70), (8, "x"), (9, "xy")]
    rows += [(20 + i, "".join(rnd.choice(passages)[rnd.randint(0, 20) :] if rnd.random() < 0.6 else "".join(rnd.choice("abcé ") for _ in range(rnd.randint(0, 40))) for _ in range(3))) for i in range(25)]
    got = _spans(sorted_spans(docs(rows)))
    assert got == _spans(removed_spans(docs(rows))) and len(got) > 10
    assert sorted_spans(docs(rows).where("false")).count() == 0


def test_long_texts_null_ids_and_clashing_columns(spark):
    rnd = random.Random(7)
    long = "".join(rnd.choice("abcdefghijklmnop ") for _ in range(1_000_000))
    rows = [(3, long), (None, long), (4, "y" * 10 + long[500_000:]), (1, None), (2, long[:60])]
    df = spark.createDataFrame([(i, t, 1, "s") for i, t in rows], "doc_id long, text string, n_bytes long, spans string")
    got = {r[0]: tuple(r)[1:5] for r in dedup_digest(df).collect()}
    assert set(got) == {1, 2, 3, 4} and got[4] == (500_010, 500_000, 1, hashlib.sha256(b"y" * 10).hexdigest()) and got[3][1:3] == (60, 1) and got[1] == (0, 0, 0, hashlib.sha256(b"").hexdigest())
