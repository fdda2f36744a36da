"""Running computations over ordered groups."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def still_on_path(df: DataFrame, keys: list[str], order: list[str], same: str, out: str = "on_path") -> DataFrame:
    """Whether all rows before this one of its group agreed; true for the first."""
    w = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    return df.withColumn(out, F.coalesce(F.min(F.col(same).cast("int")).over(w), F.lit(1)) == 1)


def counter(df: DataFrame, keys: list[str], order: list[str], kind: Column, out: str = "counter") -> DataFrame:
    """Number of rows of a kind up to this one, less one."""
    w = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return df.withColumn(out, (F.sum(F.when(kind, 1).otherwise(0)).over(w) - 1).cast("long"))


def first_where(df: DataFrame, keys: list[str], order: list[str], flag: Column, value: str, out: str, count: str) -> DataFrame:
    """Value of the first flagged row of each group that has one, and how many it has: an aggregate, no sort."""
    return df.where(flag).groupBy(*keys).agg(F.min_by(value, F.struct(*order)).alias(out), F.count(F.lit(1)).alias(count))


def seeded_sample(df: DataFrame, keys: list[str], id_col: str, n: int, seed: str) -> DataFrame:
    """At most n rows of each group, in the order of a seeded hash of the id (the feature asked for, not a cap)."""
    w = Window.partitionBy(*keys).orderBy(F.md5(F.concat_ws("|", F.lit(seed), F.col(id_col).cast("string"))), id_col)
    return df.withColumn("__i", F.row_number().over(w)).where(F.col("__i") <= n).drop("__i")


def toggled(df: DataFrame, keys: list[str], order: list[str], marker: Column, out: str) -> DataFrame:
    """The last marker that is not null up to each row."""
    w = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return df.withColumn(out, F.last(marker, ignorenulls=True).over(w))


def ranked_first(df: DataFrame, keys: list[str], kind: str, order: list[str]) -> DataFrame:
    """df with rank (from 0, inside a group) and first (whether it is the first of its kind there)."""
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy(*order)) - 1
    first = F.row_number().over(Window.partitionBy(*keys, kind).orderBy(*order)) == 1
    return df.withColumn("rank", rank.cast("long")).withColumn("first", first)
