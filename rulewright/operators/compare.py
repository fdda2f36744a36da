"""Comparisons of two row sets."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def full_compare(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """(key, side): whether each key is in the left set, the right set or both."""
    a = left.select(F.col(key), F.lit(True).alias("__a"))
    b = right.select(F.col(key), F.lit(True).alias("__b"))
    side = F.when(F.col("__b").isNull(), "left").when(F.col("__a").isNull(), "right").otherwise("both")
    return a.join(b, key, "full").select(key, side.alias("side"))


def changed(before: DataFrame, after: DataFrame, key: str, value: str) -> DataFrame:
    """Keys of both sets whose values differ (null-safe), with both values."""
    a = before.select(key, F.col(value).alias("before"))
    b = after.select(key, F.col(value).alias("after"))
    return a.join(b, key).where(~F.col("before").eqNullSafe(F.col("after")))


def expected_but_missing(expected: DataFrame, present: DataFrame, keys: list[str]) -> DataFrame:
    return expected.join(present.select(*keys).distinct(), keys, "left_anti")


def shared(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    """Keys of both sets; for train and evaluation sets it must be empty."""
    return left.select(*keys).intersect(right.select(*keys))
