import random

import numpy as np
import pytest

from rulewright.llm.decontaminate import Items, code_points, drop_leaks, find_leaks


def least_edits(pattern, text):
    row = [0] * (len(text) + 1)
    for j, c in enumerate(pattern):
        new = [j + 1]
        for k, x in enumerate(text):
            new.append(min(row[k] + (c != x), row[k + 1] + 1, new[k] + 1))
        row = new
    return min(row)


def edited(rnd, s, n):
    s = list(s)
    for _ in range(n):
        i, o = rnd.randrange(len(s)), rnd.randrange(3)
        if o == 0:
            s[i] = rnd.choice("xyz")
        elif o == 1:
            del s[i]
        else:
            s.insert(i, rnd.choice("xyz"))
    return "".join(s)


@pytest.mark.parametrize("seed", range(3))
def test_regions_match_brute_force(seed):
    rnd = random.Random(seed)
    word = lambda n: "".join(rnd.choice("abcdefghij klmno") for _ in range(n))
    items = [(i, word(rnd.randint(8, 120))) for i in range(12)]
    table = Items(items)
    for _ in range(40):
        texts = []
        for _ in range(3):
            t = word(rnd.randint(0, 100))
            if rnd.random() < 0.7:
                leak = rnd.choice(items)[1]
                at = rnd.randint(0, len(t))
                t = t[:at] + edited(rnd, leak, rnd.randint(0, len(leak) // 10 + 1)) + t[at:]
            texts.append(t)
        raw = [t.encode() for t in texts]
        points, offsets = code_points(np.frombuffer(b"".join(raw), dtype=np.uint8), np.concatenate([[0], np.cumsum([len(r) for r in raw])]))
        found = table.regions(points, offsets)
        assert {(r, i) for r, i, *_ in found} == {(r, i) for r, t in enumerate(texts) for i in range(len(table.ids)) if least_edits(items[table.ids[i]][1], t) <= table.edits[i]}
        for r, i, start, end, edits in found:
            assert least_edits(items[table.ids[i]][1], texts[r][start:end]) <= edits


def test_documents(spark, docs, edge):
    item = "A passage of the benchmark, Ünïcode and all, that must not be in training data."
    bench = spark.createDataFrame([(1, item), (2, None), (3, ""), (4, "short"), (5, item)], "item_id long, text string")
    data = [(1, "before " + item.upper().replace("Ü", "ü") + " after"), (2, "clean text " * 20), (3, item.replace("benchmark", "bench mark").replace(" ", "\n"))] + edge
    got = {(r["doc_id"], r["item_id"], r["edits"]) for r in find_leaks(docs(data), bench).collect()}
    assert {(d, i) for d, i, _ in got} == {(1, 1), (1, 5), (3, 1), (3, 5)}
    kept = drop_leaks(docs(data), bench)
    assert {r["doc_id"] for r in kept.collect()} == {2} | {d for d, _ in edge}
    assert find_leaks(docs(data), bench.where("false")).count() == 0
    assert find_leaks(docs(data).where("false"), bench).count() == 0


def test_short_items_get_the_whole_budget():
    """Edits are counted here from the rate alone, not taken from the table."""
    rnd = random.Random(5)
    word = lambda n: "".join(rnd.choice("abcdefghijklmnopqrstuvw") for _ in range(n))
    items = [(m, word(m)) for m in range(1, 45)]
    table = Items(items)
    assert table.ids == [m for m, _ in items]
    for m, item in items:
        budget = 8 * m // 100
        for n in range(budget + 2):
            for _ in range(4):
                text = word(rnd.randint(0, 30)) + edited(rnd, item, n) + word(rnd.randint(0, 30))
                raw = text.encode()
                points, offsets = code_points(np.frombuffer(raw, dtype=np.uint8), np.array([0, len(raw)]))
                assert {table.ids[i] for _, i, *_ in table.regions(points, offsets)} == {i for i, t in items if least_edits(t, text) <= 8 * i // 100}


def test_items_of_one_template(monkeypatch):
    """Items and texts share an opening that alone meets the bound of the lemma: nothing leaks, and it takes no alignment for each pair."""
    import time

    rnd = random.Random(3)
    word = lambda n: "".join(rnd.choice("abcdefghijklmnopqrstuvw ") for _ in range(n))
    opening = word(22)
    items = [(i, opening + word(61)) for i in range(60)]
    table = Items(items)
    texts = [opening + word(61) for _ in range(500)] + [word(30) + edited(rnd, items[7][1], 5) + word(9)]
    raw = [t.encode() for t in texts]
    points, offsets = code_points(np.frombuffer(b"".join(raw), dtype=np.uint8), np.concatenate([[0], np.cumsum([len(r) for r in raw])]))
    began = time.perf_counter()
    found = table.regions(points, offsets)
    assert {(r, i) for r, i, *_ in found} == {(500, 7)}
    assert time.perf_counter() - began < 5


def test_common_grams_and_pieces_lose_nothing(monkeypatch):
    """Near-identical items: most grams are common, the counts come in small pieces, and every leak is still found."""
    from rulewright.llm import decontaminate

    monkeypatch.setattr(decontaminate, "COMMON", 3)
    monkeypatch.setattr(decontaminate, "HITS", 50)
    monkeypatch.setattr(decontaminate, "ALIGN_CELLS", 200)
    rnd = random.Random(8)
    word = lambda n: "".join(rnd.choice("abcdef ghi") for _ in range(n))
    base = word(70)
    items = [(i, edited(rnd, base, rnd.randint(0, 12))) for i in range(25)] + [(30 + i, word(40)) for i in range(5)]
    table = Items(items)
    texts = [word(20) + edited(rnd, rnd.choice(items)[1], rnd.randint(0, 6)) + word(20) for _ in range(30)]
    raw = [t.encode() for t in texts]
    points, offsets = code_points(np.frombuffer(b"".join(raw), dtype=np.uint8), np.concatenate([[0], np.cumsum([len(r) for r in raw])]))
    found = table.regions(points, offsets)
    assert {(r, i) for r, i, *_ in found} == {(r, k) for r, t in enumerate(texts) for k, (_, item) in enumerate(items) if least_edits(item, t) <= int(0.08 * len(item))}


def test_long_texts_null_ids_and_clashing_columns(spark):
    rnd = random.Random(6)
    item = "The quick survey of every benchmark passage asks whether it was seen before, and where."
    long = " ".join(f"w{rnd.randrange(10**6)}" for _ in range(140_000))
    rows = [(1, long[:600_000] + item + long[600_000:]), (2, long), (None, item), (3, None), (4, item), (4, item)]
    df = spark.createDataFrame([(i, t, 5, 6) for i, t in rows], "doc_id long, text string, item_id long, edits long")
    bench = spark.createDataFrame([(9, item, 0), (None, item, 0)], "item_id long, text string, doc_id long")
    got = sorted((r["doc_id"], r["item_id"], r["region_start"], r["region_end"], r["edits"]) for r in find_leaks(df, bench).collect())
    assert got == [(1, 9, 600_000, 600_000 + len(item), 0), (4, 9, 0, len(item), 0), (4, 9, 0, len(item), 0)]
    kept = drop_leaks(df, bench)
    assert kept.columns == df.columns and sorted((r["doc_id"] or 0) for r in kept.collect()) == [2, 3]
