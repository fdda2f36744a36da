"""Resampling by repeatable hashed draws."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rulewright.functions.stats import hash_index, percentile_ends, running_total


def cluster_bootstrap(df: DataFrame, cluster: str, parts: dict[str, F.Column], metric: F.Column, replicates: int = 200, salt: str = "c", digits: int = 4) -> DataFrame:
    """(clusters, ci_low, ci_high) of any metric of sums, resampling whole clusters.

    parts: name -> expression whose sum over the rows a cluster contributes; metric: an expression of the summed names. Rows
    are summed for each cluster first, so only one row for each cluster and replicate is drawn; clusters are numbered by
    range partitions, not in one task.
    """
    sums = df.groupBy(cluster).agg(*[F.sum(e).alias(n) for n, e in parts.items()], F.lit(1).alias("__one"))
    numbered = running_total(sums, cluster, "__one").withColumn("i", (F.col("upto") - 1).cast("long"))
    n = numbered.agg(F.count(F.lit(1)).alias("n")).first()["n"]
    draws = df.sparkSession.range(n).select(F.col("id").alias("j"), F.explode(F.sequence(F.lit(0), F.lit(replicates - 1))).alias("r"))
    draws = draws.select("r", hash_index([F.lit(salt), F.col("r"), F.col("j")], F.lit(max(n, 1))).alias("i"))
    means = draws.join(numbered, "i").groupBy("r").agg(*[F.sum(p).alias(p) for p in parts]).select("r", metric.alias("m"))
    return percentile_ends(means, replicates, digits).select(F.lit(n).cast("long").alias("clusters"), "ci_low", "ci_high")


def cluster_ratio(df: DataFrame, cluster: str, value: str, replicates: int = 200, salt: str = "c", digits: int = 4) -> DataFrame:
    """cluster_bootstrap of the mean of a value over rows."""
    return cluster_bootstrap(df, cluster, {"s": F.col(value).cast("double"), "c": F.lit(1.0)}, F.col("s") / F.col("c"), replicates, salt, digits)
