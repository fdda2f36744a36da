import random
import re
from collections import Counter

import pytest

from rulewright.llm import ngram_join


def brute(rows):
    sets = {}
    for d, t in rows:
        w = re.findall(rb"[^\x20\x09-\x0D]+", re.sub(rb"[A-Z]", lambda m: m.group(0).lower(), (t or "").encode()))
        sets[d] = frozenset(tuple(w[i : i + 5]) for i in range(len(w) - 4)) if len(w) >= 5 else (frozenset([tuple(w)]) if w else frozenset())
    parent = {d: d for d in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    where, shared = {}, Counter()
    for d, s in sets.items():
        for g in s:
            where.setdefault(g, []).append(d)
    for ds in where.values():
        for i in range(len(ds)):
            for j in range(i):
                shared[(ds[j], ds[i])] += 1
    for (a, b), k in shared.items():
        if 100 * k >= 80 * (len(sets[a]) + len(sets[b]) - k):
            x, y = find(a), find(b)
            parent[max(x, y)] = min(x, y)
    return {d: (len(sets[d]), find(d)) for d in sets}


def rows(seed):
    rnd = random.Random(seed)
    base = [f"w{rnd.randint(0, 300)}" for _ in range(90)]
    out = []
    for i in range(160):
        w = list(base)
        for _ in range(rnd.choice([0, 1, 2, 3, 4, 8])):
            w[rnd.randrange(len(w))] = f"x{rnd.randint(0, 10**6)}"
        out.append((i + 5, " ".join(w)))
    for i in range(80):
        out.append((5000 + i, " ".join(rnd.choice("abC") for _ in range(rnd.randint(0, 8)))))
    passage = " ".join(base[:50])
    for i in range(80):
        out.append((10000 + i, " ".join(f"y{rnd.randint(0, 10**6)}" for _ in range(rnd.randint(5, 60))) + " " + passage))
    return out


@pytest.mark.parametrize("tile, block", [(512, 256), (16, 8)])
def test_matches_brute_force(docs, edge, monkeypatch, tile, block):
    monkeypatch.setattr(ngram_join, "TILE", tile)
    monkeypatch.setattr(ngram_join, "BLOCK", block)
    data = rows(3) + edge
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in ngram_join.jaccard_classes(docs(data)).collect()}
    assert got == brute(data)


def test_drop_copies_keeps_one_of_each_class(docs, edge):
    data = rows(4) + edge
    want = {d for d, (_, c) in brute(data).items() if c == d}
    df = docs(data)
    out = ngram_join.drop_copies(df)
    assert out.columns == df.columns
    assert {r["doc_id"] for r in out.collect()} == want


def test_empty_and_null_tables(docs):
    assert ngram_join.jaccard_classes(docs([(1, "a")]).where("false")).count() == 0
    assert [tuple(r) for r in ngram_join.jaccard_classes(docs([(3, None)])).collect()] == [(3, 0, 3)]


def _counted(monkeypatch):
    """Counts the set rows that are sent to verification."""
    from rulewright.llm._store import settle

    sent, real = [], ngram_join._verify

    def verify(rows, parts, known=False):
        rows = settle(rows, "counted")
        sent.append(rows.count())
        return real(rows, parts, known)

    monkeypatch.setattr(ngram_join, "_verify", verify)
    return sent


@pytest.mark.parametrize("own", [4, 9])
def test_pages_of_one_template_are_not_compared(spark, monkeypatch, own):
    """2,000 pages share 22 words and differ in the others, too much to link; the frequent grams come last, so no page meets another."""
    rnd = random.Random(1)
    shared = [f"t{i}" for i in range(22)]
    data = [(i, " ".join(shared + [f"o{rnd.randrange(10**9)}" for _ in range(own)])) for i in range(2000)]
    sent = _counted(monkeypatch)
    got = ngram_join.jaccard_classes(spark.createDataFrame(data, "doc_id long, text string").repartition(8))
    assert got.where("doc_id = component_id").count() == 2000
    assert sum(sent) <= 200


def test_chain_of_near_copies(spark):
    """Each text links with the next one only; the chain is one class."""
    words = [f"w{i}" for i in range(1060)]
    data = [(i + 3, " ".join(words[2 * i : 2 * i + 60])) for i in range(500)]
    got = ngram_join.jaccard_classes(spark.createDataFrame(data, "doc_id long, text string").repartition(8)).collect()
    assert {r["component_id"] for r in got} == {3} and {r["n_shingles"] for r in got} == {56}
    assert {d: (r, c) for d, r, c in got} == brute(data)


def test_long_texts_null_ids_and_clashing_columns(spark):
    """Texts of a megabyte link like others; rows without an id are left out; columns named like the result's are ignored."""
    rnd = random.Random(9)
    long = " ".join(f"w{rnd.randrange(10**6)}" for _ in range(140_000))
    data = [(1, long), (2, long + " one more word"), (3, None), (None, long), (None, None), (4, long[: len(long) // 2])]
    df = spark.createDataFrame([(i, t, 0, 7) for i, t in data], "doc_id long, text string, n_shingles long, component_id long")
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in ngram_join.jaccard_classes(df).collect()}
    assert got == brute([r for r in data if r[0] is not None])
    kept = ngram_join.drop_copies(df)
    assert kept.columns == df.columns and sorted((r["doc_id"] or 0) for r in kept.collect()) == [0, 0, 1, 3, 4]
