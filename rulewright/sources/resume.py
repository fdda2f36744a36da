"""Append-and-resume sinks keyed by ids."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def pending(wanted: DataFrame, done: DataFrame, keys: list[str]) -> DataFrame:
    """Rows of wanted whose keys are not done yet."""
    return wanted.join(done.select(*keys).distinct(), keys, "left_anti")


def conflicts(wanted: DataFrame, done: DataFrame, keys: list[str], same: list[str]) -> DataFrame:
    """Keys that are done under other settings (seed, hash, model): a run must not be resumed with them."""
    other = done.select(*keys, *[F.col(c).alias(f"__{c}") for c in same])
    differs = F.lit(False)
    for c in same:
        differs = differs | ~F.col(c).eqNullSafe(F.col(f"__{c}"))
    return wanted.join(other, keys).where(differs).select(*keys)


def append_pending(wanted: DataFrame, path: str, keys: list[str], same: list[str] | None = None) -> int:
    """Append the pending rows to the Parquet table at path; returns their number. Rows of another run raise a ValueError."""
    spark = wanted.sparkSession
    jpath = spark._jvm.org.apache.hadoop.fs.Path(path)
    exists = jpath.getFileSystem(spark._jsc.hadoopConfiguration()).exists(jpath)
    new = wanted
    if exists:
        done = spark.read.schema(wanted.schema).parquet(path)
        if same and not conflicts(wanted, done, keys, same).isEmpty():
            raise ValueError(f"{path} holds rows of another run")
        new = pending(wanted, done, keys)
    new = new.dropDuplicates(keys)
    n = new.count()
    if n:
        new.write.mode("append").parquet(path)
    return n


def finished_only(calls: DataFrame, done: DataFrame, keys: list[str]) -> DataFrame:
    """Calls of runs that were finished; those of a run that died in between are left out, so the run can start again."""
    return calls.join(done.select(*keys).distinct(), keys, "left_semi")


def open_run(spark: SparkSession, path: str, settings: dict, same: list[str]) -> dict:
    """Write the manifest of a run, or check that of the run at path; another value of a setting in `same` raises a ValueError."""
    import json

    from rulewright.sources.jsonl import exists, one_row

    if exists(spark, path):
        stored = json.loads(spark.read.text(path).first()[0])
        differs = [k for k in same if stored.get(k) != settings.get(k)]
        if differs:
            raise ValueError(f"{path} is a run with other {', '.join(differs)}")
        return stored
    one_row(spark, settings).select("manifest").coalesce(1).write.text(path)
    return settings


def matched(rows: DataFrame, generations: DataFrame, keys: list[str]) -> tuple[DataFrame, DataFrame]:
    """Rows with their generation, and (n, unmatched) counts of the rows."""
    found = generations.withColumn("__found", F.lit(1))
    both = rows.join(found, keys, "left")
    counts = both.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum(F.col("__found").isNull().cast("long")), F.lit(0)).alias("unmatched"))
    return both.where("__found = 1").drop("__found"), counts
