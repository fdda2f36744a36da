import random

import pytest

from rulewright.llm._components import components

N = 10_000


def _path(ids):
    return list(zip(ids[:-1], ids[1:], strict=True))


def _comb(ids):
    """A path of half the ids; every one of them carries a tooth."""
    half = len(ids) // 2
    return _path(ids[:half]) + list(zip(ids[:half], ids[half:], strict=True))


def _star(ids):
    return [(ids[-1], i) for i in ids[:-1]]


def _in_order(n, order):
    ids = list(range(7, n + 7))
    if order == "descending":
        ids.reverse()
    elif order == "shuffled":
        random.Random(4).shuffle(ids)
    return ids


@pytest.mark.parametrize("order", ["ascending", "descending", "shuffled"])
@pytest.mark.parametrize("shape", [_path, _comb, _star])
def test_long_shapes(spark, shape, order):
    pairs = shape(_in_order(N, order))
    random.Random(1).shuffle(pairs)
    df = spark.createDataFrame(pairs, "a long, b long").repartition(4)
    got = components(df)
    assert got.count() == N and [r[0] for r in got.select("component").distinct().collect()] == [7]


def test_alternating_ids(spark):
    """Every second vertex of a path is a local minimum."""
    n = 2000
    ids = [i // 2 if i % 2 else n + i for i in range(n)]
    got = {r["id"]: r["component"] for r in components(spark.createDataFrame(_path(ids), "a long, b long")).collect()}
    assert got == dict.fromkeys(ids, 0)


def test_random_graphs_loops_and_nulls(spark):
    rnd = random.Random(2)
    pairs = [(rnd.randrange(300), rnd.randrange(300)) for _ in range(200)]
    parent = {x: x for p in pairs for x in p}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in pairs:
        x, y = find(a), find(b)
        parent[max(x, y)] = min(x, y)
    rows = [*pairs, pairs[0], (None, 3), (4, None), (777, 777)]
    got = {r["id"]: r["component"] for r in components(spark.createDataFrame(rows, "a long, b long")).collect()}
    assert got == {x: find(x) for x in parent} | {777: 777}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0
