"""Sets and sequences in array columns."""

from __future__ import annotations

from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def prefix_share(a: Column, b: Column) -> Column:
    """Length of the longest common prefix over the length of a (at least 1)."""
    short = F.least(F.size(a), F.size(b))
    same = F.transform(F.slice(a, 1, short), lambda x, i: x == F.get(b, i))
    first = F.array_position(same, F.lit(False))
    return F.when(first > 0, first - 1).otherwise(short).cast("double") / F.greatest(F.size(a), F.lit(1))


def precision_recall(said: Column, gold: Column) -> tuple[Column, Column, Column]:
    """Precision, recall and F1 of two sets, 0 where undefined."""
    hit = F.size(F.array_intersect(said, gold)).cast("double")
    n, m = F.size(said), F.size(gold)
    zero = F.lit(0.0)
    return F.when(n > 0, hit / n).otherwise(zero), F.when(m > 0, hit / m).otherwise(zero), F.when(n + m > 0, 2 * hit / (n + m)).otherwise(zero)


def antichain(df: DataFrame, keys: list[str], members: str) -> DataFrame:
    """Distinct sets of each group without those that strictly contain another (sorted arrays).

    A set that is smaller and contained must hold its least member, so candidates meet on that member and not on the group;
    the empty set meets every set on a mark of its own.
    """
    rows = df.select(*keys, F.col(members)).distinct()
    kind = df.schema[members].dataType.elementType
    mark = lambda x: F.struct(x.isNull().alias("none"), x.cast(kind).alias("v"))
    nothing = F.array(mark(F.lit(None)))
    small = rows.select(*[F.col(k).alias(f"__{k}") for k in keys], F.col(members).alias("__b"), F.size(members).alias("__m"), mark(F.get(F.col(members), F.lit(0))).alias("__s"))
    probe = rows.select("*", F.size(members).alias("__n"), F.explode(F.concat(F.transform(members, mark), nothing)).alias("__p"))
    on = [F.col(k).eqNullSafe(F.col(f"__{k}")) for k in keys]
    least = (F.col("__p.none") == F.col("__s.none")) & F.col("__p.v").eqNullSafe(F.col("__s.v"))
    inside = least & (F.col("__m") < F.col("__n")) & (F.size(F.array_except("__b", members)) == 0)
    covered = probe.join(small, [*on, inside], "left_semi").select(*keys, members)
    return rows.join(covered, [*keys, members], "left_anti")


@F.pandas_udf(T.IntegerType())
def _lcs(left: pd.Series, right: pd.Series) -> pd.Series:
    def one(a, b) -> int | None:
        if a is None or b is None:
            return None
        codes = {x: i for i, x in enumerate({*a, *b})}
        y = np.array([codes[v] for v in b], dtype=np.int64)
        row = np.zeros(len(y) + 1, dtype=np.int64)
        for v in a:  # a row of the table at a time
            row[1:] = np.maximum.accumulate(np.maximum(row[1:], row[:-1] + (y == codes[v])))
        return int(row[-1])

    return pd.Series([one(a, b) for a, b in zip(left, right, strict=True)], dtype="Int32")


def lcs_length(a: Column, b: Column) -> Column:
    """Length of the longest common subsequence of two arrays of strings."""
    return _lcs(a, b)


def first_by_id(sources: list[DataFrame], key: str) -> DataFrame:
    """The rows of several sources by id; of rows of one id that of the first source stays."""
    every = reduce(DataFrame.unionByName, [s.withColumn("__at", F.lit(i)) for i, s in enumerate(sources)])
    rest = [c for c in sources[0].columns if c != key]
    return every.groupBy(key).agg(F.min_by(F.struct(*rest), "__at").alias("x")).select(key, "x.*")


def recall_by(said: DataFrame, gold: DataFrame, keys: list[str], item: str) -> DataFrame:
    """(keys.., recall): share of the distinct items of each group that were said as well."""
    a = said.select(*keys, item).distinct().withColumn("__hit", F.lit(1))
    return gold.select(*keys, item).distinct().join(a, [*keys, item], "left").groupBy(*keys).agg(F.round(F.avg(F.col("__hit").isNotNull().cast("double")), 4).alias("recall"))


def ordered_unique(a: Column) -> Column:
    return F.array_distinct(a)


def equal_multisets(a: Column, b: Column) -> Column:
    return F.array_sort(a) == F.array_sort(b)
