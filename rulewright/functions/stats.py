"""Statistics of evaluation data as column expressions."""

from __future__ import annotations

import math
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def _c(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def share(flag: Column | str, digits: int = 4) -> Column:
    """Mean of a boolean or number over its non-null rows, null when there are none."""
    return F.round(F.avg(_c(flag).cast("double")), digits)


def count_if(flag: Column) -> Column:
    return F.coalesce(F.sum(F.when(flag, 1).otherwise(0)), F.lit(0)).cast("long")


def balanced_accuracy(truth: Column | str, said: Column | str, digits: int = 4) -> Column:
    """Half the sum of the hit rates of both classes; an answer that is left out is a miss; null if a class is empty."""
    t, s = _c(truth), _c(said)
    yes = F.sum(F.when(t, F.when(s, 1.0).otherwise(0.0))) / F.nullif(F.sum(F.when(t, 1.0)), F.lit(0.0))
    no = F.sum(F.when(~t, F.when(~s, 1.0).otherwise(0.0))) / F.nullif(F.sum(F.when(~t, 1.0)), F.lit(0.0))
    return F.round((yes + no) / 2, digits)


def balanced_accuracy_one_class(truth: Column | str, said: Column | str, digits: int = 4) -> Column:
    """As balanced_accuracy, but with one class only its hit rate counts."""
    t, s = _c(truth), _c(said)
    yes, no = F.avg(F.when(t, s.cast("double"))), F.avg(F.when(~t, (~s).cast("double")))
    return F.round(F.coalesce((yes + no) / 2, yes, no), digits)


def cue_accuracy(truth: Column | str, cue: Column | str, digits: int = 4) -> Column:
    """How well a surface cue tells the classes apart in either direction: max(b, 1 - b), empty classes counted as one row."""
    t, s = _c(truth), _c(cue)
    yes = F.sum(F.when(t & s, 1.0).otherwise(0.0)) / F.greatest(F.sum(F.when(t, 1.0).otherwise(0.0)), F.lit(1.0))
    no = F.sum(F.when(~t & ~s, 1.0).otherwise(0.0)) / F.greatest(F.sum(F.when(~t, 1.0).otherwise(0.0)), F.lit(1.0))
    b = (yes + no) / 2
    return F.round(F.greatest(b, 1 - b), digits)


def wilson(k: Column, n: Column, z: float = 1.96, digits: int = 3) -> tuple[Column, Column]:
    """Lower and upper end of the Wilson interval of k out of n, clamped to [0, 1]; null for n = 0."""
    n = F.nullif(n.cast("double"), F.lit(0.0))
    p = k.cast("double") / n
    zz = F.lit(z * z)
    centre = (p + zz / (2 * n)) / (1 + zz / n)
    half = F.lit(z) * F.sqrt(p * (1 - p) / n + zz / (4 * n * n)) / (1 + zz / n)
    return F.round(F.greatest(F.lit(0.0), centre - half), digits), F.round(F.least(F.lit(1.0), centre + half), digits)


def log_factorial(n: int) -> float:
    return math.lgamma(n + 1)


def binomial_cdf(k: int, n: int, p: float) -> float:
    """P[Bin(n, p) <= k]."""
    if k < 0:
        return 0.0
    if k >= n or p <= 0:
        return 1.0
    if p >= 1:
        return 0.0
    logs = [math.lgamma(n + 1) - math.lgamma(i + 1) - math.lgamma(n - i + 1) + i * math.log(p) + (n - i) * math.log1p(-p) for i in range(k + 1)]
    top = max(logs)
    return min(1.0, math.exp(top) * math.fsum(math.exp(x - top) for x in logs))


def exact_interval(k: int, n: int, level: float = 0.95) -> tuple[float | None, float | None]:
    """Clopper-Pearson interval by bisection of the binomial tails; none without observations."""
    if n == 0:
        return None, None
    tail = (1 - level) / 2

    def solve(above) -> float:
        lo, hi = 0.0, 1.0
        for _ in range(60):
            mid = (lo + hi) / 2
            lo, hi = (mid, hi) if above(mid) else (lo, mid)
        return (lo + hi) / 2

    low = 0.0 if k == 0 else solve(lambda p: 1 - binomial_cdf(k - 1, n, p) < tail)
    high = 1.0 if k == n else solve(lambda p: binomial_cdf(k, n, p) > tail)
    return low, high


def with_exact_interval(df: DataFrame, k: str, n: str, digits: int = 4) -> DataFrame:
    """df with ci_low and ci_high of k out of n."""

    @F.pandas_udf("low double, high double")
    def ends(parts: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        for ks, ns in parts:
            got = [exact_interval(int(a), int(b)) for a, b in zip(ks, ns, strict=True)]
            yield pd.DataFrame({"low": [g[0] for g in got], "high": [g[1] for g in got]})

    out = df.withColumn("__ci", ends(F.col(k), F.col(n)))
    return out.withColumn("ci_low", F.round("__ci.low", digits)).withColumn("ci_high", F.round("__ci.high", digits)).drop("__ci")


def mcnemar(b: Column, c: Column, digits: int = 6) -> Column:
    """Exact two-sided p of b and c discordant pairs: min(1, 2 P[Bin(b + c, 1/2) <= min(b, c)]), 1 without any.

    The tail is summed over logarithms of binomial terms, each from its predecessor.
    """
    n, k = (b + c).cast("int"), F.least(b, c).cast("int")
    start = F.struct((-n.cast("double") * F.log(F.lit(2.0))).alias("t"), F.exp(-n.cast("double") * F.log(F.lit(2.0))).alias("s"))

    def step(acc: Column, i: Column) -> Column:
        t = acc["t"] + F.log((n - i + 1).cast("double")) - F.log(i.cast("double"))
        return F.struct(t.alias("t"), (acc["s"] + F.exp(t)).alias("s"))

    terms = F.when(k >= 1, F.sequence(F.lit(1), F.greatest(k, F.lit(1)))).otherwise(F.array().cast("array<int>"))
    return F.when(n == 0, F.lit(1.0)).otherwise(F.round(F.least(F.lit(1.0), 2 * F.aggregate(terms, start, step, lambda a: a["s"])), digits))


def hash_index(parts: list[Column], n: Column) -> Column:
    """A repeatable index in [0, n) from the md5 of the joined parts: the same in every engine."""
    return F.pmod(F.conv(F.substring(F.md5(F.concat_ws("|", *[p.cast("string") for p in parts])), 1, 8), 16, 10).cast("long"), n)


def bootstrap_mean(df: DataFrame, value: str, replicates: int = 200, salt: str = "b", digits: int = 4) -> DataFrame:
    """(n, mean, ci_low, ci_high): percentile bootstrap of a mean with md5-indexed resamples.

    Values are numbered in their order; a replicate draws n numbers. A number is turned into its value by the cumulated
    counts of the distinct values: the draws meet the values in a range join on blocks of numbers, and nothing but the
    distinct values is ever sorted. The ends are the sorted replicate means at positions floor(0.025 r) and
    floor(0.975 r) - 1.
    """
    spark = df.sparkSession
    x = df.where(F.col(value).isNotNull()).select(F.col(value).cast("double").alias("x"))
    counts = x.groupBy("x").agg(F.count(F.lit(1)).alias("c"))
    total = x.agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("x"), digits).alias("mean"))
    places = running_total(counts, "x", "c").select("x", (F.col("upto") - F.col("c")).alias("lo"), F.col("upto").alias("hi"))
    n = total.first()["n"]
    width = max(1, n >> 10)  # numbers of a block, so a value meets few blocks and a draw one
    blocks = places.withColumn("b", F.explode(F.sequence(F.floor(F.col("lo") / width), F.floor((F.col("hi") - 1) / width))))
    draws = spark.range(n).select(F.col("id").alias("j"), F.explode(F.sequence(F.lit(0), F.lit(replicates - 1))).alias("r"))
    draws = draws.select("r", hash_index([F.lit(salt), F.col("r"), F.col("j")], F.lit(max(n, 1))).alias("i")).groupBy("r", "i").agg(F.count(F.lit(1)).alias("m")).withColumn("b", F.floor(F.col("i") / width))
    means = draws.join(blocks, "b").where((F.col("i") >= F.col("lo")) & (F.col("i") < F.col("hi"))).groupBy("r").agg((F.sum(F.col("x") * F.col("m")) / F.sum("m")).alias("m"))
    return total.crossJoin(percentile_ends(means, replicates, digits)).select("n", "mean", "ci_low", "ci_high")  # one row each


def percentile_ends(means: DataFrame, replicates: int, digits: int) -> DataFrame:
    """One row: the sorted replicate means m at positions floor(0.025 r) and floor(0.975 r) - 1; there are as many rows as replicates."""
    low, high = int(0.025 * replicates), int(0.975 * replicates) - 1
    ordered = means.agg(F.array_sort(F.collect_list("m")).alias("a"))
    return ordered.select(F.round(F.get("a", F.lit(low)), digits).alias("ci_low"), F.round(F.get("a", F.lit(high)), digits).alias("ci_high"))


def running_total(df: DataFrame, order: str, count: str, out: str = "upto") -> DataFrame:
    """df with the running total of counts in the order of a column of distinct values.

    The rows are range-partitioned and summed inside their partition; only one total for each partition is added up over all,
    so no task sees the whole column.
    """
    parts = df.repartitionByRange(F.col(order)).withColumn("__p", F.spark_partition_id())
    inside = parts.withColumn("__in", F.sum(count).over(Window.partitionBy("__p").orderBy(order)))
    sums = parts.groupBy("__p").agg(F.sum(count).alias("__s"))
    before = sums.withColumn("__before", F.sum("__s").over(Window.orderBy("__p")) - F.col("__s")).drop("__s")  # a row for each partition
    return inside.join(before, "__p").withColumn(out, F.col("__in") + F.col("__before")).drop("__p", "__in", "__before")


def most_common(df: DataFrame, keys: list[str], value: str) -> DataFrame:
    """The most frequent value of each group; ties go to the smallest value."""
    counts = df.where(F.col(value).isNotNull()).groupBy(*keys, value).agg(F.count(F.lit(1)).alias("n"))
    best = counts.groupBy(*keys).agg(F.min_by(value, F.struct((-F.col("n")).alias("m"), F.col(value).alias("v"))).alias(value), F.max("n").alias("n"))
    return best
