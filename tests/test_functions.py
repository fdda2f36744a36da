import math

import pytest
from pyspark.sql import functions as F

from rulewright.functions import atoms, kernels, stats


def test_exact_interval_known_values():
    low, high = stats.exact_interval(5, 10)
    assert abs(low - 0.1871) < 1e-4 and abs(high - 0.8129) < 1e-4
    assert stats.exact_interval(0, 10)[0] == 0.0 and abs(stats.exact_interval(0, 10)[1] - 0.3085) < 1e-4
    assert abs(stats.binomial_cdf(3, 10, 0.5) - 0.171875) < 1e-12


@pytest.mark.parametrize("b, c, p", [(0, 0, 1.0), (1, 1, 1.0), (0, 5, 0.0625), (2, 9, 0.065430)])
def test_mcnemar(spark, b, c, p):
    got = spark.range(1).select(stats.mcnemar(F.lit(b), F.lit(c)).alias("p")).first()["p"]
    assert abs(got - p) < 1e-5


def test_balanced_accuracy_omitted_is_a_miss(spark):
    df = spark.createDataFrame([(True, True), (True, None), (False, False), (False, True)], "t boolean, s boolean")
    assert df.agg(stats.balanced_accuracy("t", "s").alias("b")).first()["b"] == 0.5
    assert df.where("t").agg(stats.balanced_accuracy("t", "s").alias("b")).first()["b"] is None
    assert df.agg(stats.cue_accuracy("t", "s").alias("b")).first()["b"] >= 0.5


def test_kernels(spark):
    df = spark.createDataFrame([([0.5], [0.25, 0.5]), ([], [])], "a array<double>, s array<double>")
    got = df.select(kernels.balance_product(F.col("a"), F.col("s")).alias("p"), kernels.balance_sum(F.col("a"), F.col("s")).alias("w"), kernels.noisy_or(F.col("s")).alias("n"), kernels.product(F.col("a")).alias("m"), kernels.minimum(F.col("a")).alias("x")).collect()
    assert [tuple(r) for r in got] == [(0.125, 0.25, 0.625, 0.5, 0.5), (0.0, 0.0, 0.0, 1.0, 1.0)]
    w = spark.range(1).select(kernels.linear(F.lit(0.5), F.lit(-0.5)).alias("l"), kernels.quadratic(F.lit(0.5), F.lit(1.0)).alias("q")).first()
    assert (w["l"], w["q"]) == (0.25, 0.75)


def test_solved_diamond_strength(spark):
    """Mutual attack of two assumptions at base one half settles at one third."""
    from rulewright.operators.gradual import strengths

    bases = spark.createDataFrame([("x", 0.5), ("y", 0.5)], "asm string, base double")
    edges = spark.createDataFrame([("x", "attack", 0, "y"), ("y", "attack", 0, "x")], "target string, polarity string, edge_id int, member string")
    assert all(math.isclose(r["value"], 1 / 3, abs_tol=1e-3) for r in strengths(bases, edges).collect())


def test_atoms(spark):
    df = spark.createDataFrame([("p(X) :- q(X, a), X = c.",), ("flag.",)], "r string")
    got = df.select(atoms.constants(F.col("r")).alias("c"), atoms.is_intensional(F.col("r")).alias("i")).collect()
    assert [tuple(r) for r in got] == [(["a", "c"], False), ([], True)]
    p = spark.createDataFrame([("not p(X)",), ("X = c",), ("q",), ("dom(X)",)], "a string").select(atoms.predicate(F.col("a")).alias("p")).collect()
    assert [r["p"] for r in p] == ["p", None, "q", None]


def test_canonical_key_ignores_order_and_variable_names(spark):
    from rulewright.operators.rule_text import canonical_key, parse_rules

    df = spark.createDataFrame([("p(X) :- q(X), r(X,Y).",), ("p(A):-r(A,B),q( A ).",), ("p(X) :- q(X), r(Y,X).",)], "line string")
    keys = [r["key"] for r in canonical_key(parse_rules(df, "line")).collect()]
    assert keys[0] == keys[1] != keys[2]


def test_bootstrap_matches_plain_python(spark):
    import hashlib

    values = sorted(float(i % 37) for i in range(211))
    pick = lambda r, j: int(hashlib.md5(f"b|{r}|{j}".encode()).hexdigest()[:8], 16) % len(values)
    means = sorted(sum(values[pick(r, j)] for j in range(len(values))) / len(values) for r in range(200))
    got = stats.bootstrap_mean(spark.createDataFrame([(v,) for v in values], "x double").repartition(5), "x").first()
    assert (got["n"], got["ci_low"], got["ci_high"]) == (211, round(means[5], 4), round(means[194], 4))
    assert stats.bootstrap_mean(spark.createDataFrame([], "x double"), "x").first()["n"] == 0


def test_running_total_over_partitions(spark):
    df = spark.createDataFrame([(i, i % 5) for i in range(500)], "k int, c int").repartition(7)
    got = {r["k"]: r["upto"] for r in stats.running_total(df, "k", "c").collect()}
    total = 0
    for i in range(500):
        total += i % 5
        assert got[i] == total


def test_no_observations_have_no_interval(spark):
    assert stats.exact_interval(0, 0) == (None, None)
    row = stats.with_exact_interval(spark.createDataFrame([(0, 0), (5, 10)], "k int, n int"), "k", "n").orderBy("n").collect()
    assert row[0]["ci_low"] is None and row[1]["ci_low"] == 0.1871
