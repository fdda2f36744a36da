import numpy as np
import pytest
from pyspark.sql import functions as F

from rulewright.llm import embedding_dedup


def brute(rows):
    good = [(i, v) for i, v in rows if v and all(x is not None and np.isfinite(x) for x in v) and any(v)]
    parent, links = {i: i for i, _ in rows}, {i: 0 for i, _ in rows}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for k, (i, v) in enumerate(good):
        for j, w in good[k + 1 :]:
            if len(v) == len(w) and np.dot(v, w) / np.sqrt(np.dot(v, v) * np.dot(w, w)) >= 0.9:
                links[i] += 1
                links[j] += 1
                x, y = find(i), find(j)
                parent[max(x, y)] = min(x, y)
    return {i: (links[i], find(i), find(i) == i) for i, _ in rows}


@pytest.mark.parametrize("block", [2048, 40])
def test_matches_brute_force(spark, monkeypatch, block):
    monkeypatch.setattr(embedding_dedup, "BLOCK", block)
    rnd = np.random.default_rng(1)
    c = rnd.normal(size=(12, 8))
    rows = [(i, [float(x) for x in c[i % 12] + rnd.normal(size=8) * rnd.choice([0, 0.2, 0.4])]) for i in range(300)]
    rows += [(1000, None), (1001, [0.0] * 8), (1002, [1.0, None] + [0.0] * 6), (1003, [float("nan")] * 8), (1004, [1.0, 2.0]), (1005, [2.0, 4.0]), (1006, []), (1009, [float("inf")] * 8)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumn("label", F.lit(1)).withColumn("cell", F.lit(2)).repartition(3)
    assert {r[0]: tuple(r)[1:] for r in embedding_dedup.near_duplicates(df).collect()} == brute(rows)


def test_empty(spark):
    assert embedding_dedup.near_duplicates(spark.createDataFrame([], "vec_id long, embedding array<float>")).count() == 0


@pytest.mark.parametrize("centres", [8192, 3])
def test_pairs_near_the_threshold_and_several_passes(spark, monkeypatch, centres):
    """Vectors around one direction whose cosines lie at 0.9, so that most pairs need full precision; lengths beyond LENGTHS."""
    monkeypatch.setattr(embedding_dedup, "BLOCK", 30)
    monkeypatch.setattr(embedding_dedup, "CENTRES", centres)
    monkeypatch.setattr(embedding_dedup, "LENGTHS", 1)
    rnd = np.random.default_rng(3)
    base = rnd.normal(size=24)
    rows = []
    for i in range(150):
        v = rnd.normal(size=24)
        v -= v @ base / (base @ base) * base
        rows.append((i, [float(x) for x in base / np.sqrt(base @ base) + v / np.sqrt(v @ v) * np.sqrt(1 / 0.9 - 1) * rnd.uniform(0.98, 1.02)]))
    rows += [(500 + i, [float(x) for x in rnd.normal(size=3)]) for i in range(60)] + [(700, rows[0][1]), (701, rows[0][1]), (702, [2 * x for x in rows[0][1]])]
    df = spark.createDataFrame([*rows, (None, rows[0][1])], "vec_id long, embedding array<double>").withColumn("tile", F.lit("t")).withColumn("links", F.lit(2)).repartition(4)
    assert {r[0]: tuple(r)[1:] for r in embedding_dedup.near_duplicates(df).collect()} == brute(rows)


def test_very_long_vectors(spark):
    rnd = np.random.default_rng(4)
    base = rnd.normal(size=20_000)
    rows = [(i, [float(x) for x in base + rnd.normal(size=20_000) * s]) for i, s in enumerate([0, 0.3, 0.34, 0.5, 0.1])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    assert {r[0]: tuple(r)[1:] for r in embedding_dedup.near_duplicates(df).collect()} == brute(rows)
