"""Materialising intermediate tables in the folder that driver and executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes of text for each task of a shuffle that holds its part in memory.
PART_BYTES = 32 << 20


def shared_dir(spark: SparkSession) -> str:
    """The folder named by spark.checkpoint.dir. Unset, a temporary one is made for a local master; a cluster gets an error."""
    path = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("rulewright.checkpoint.dir", None)
    if not path:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        path = "file://" + tempfile.mkdtemp(prefix="rulewright-")
        spark.conf.set("rulewright.checkpoint.dir", path)
    return path.rstrip("/")


def _file_system(spark: SparkSession, path: str):
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark._jsc.hadoopConfiguration()), target


def settle(df: DataFrame, name: str) -> DataFrame:
    """Write df to the shared folder and read it back: lineage ends there, so a lost executor costs no recomputation.

    The table is deleted when the driver ends, or before by discard().
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    files, target = _file_system(spark, path)
    files.deleteOnExit(target)
    out = spark.read.schema(df.schema).parquet(path)
    out._settled_at = path
    return out


def discard(*tables: DataFrame) -> None:
    """Delete settled tables that nothing will read again."""
    for table in tables:
        path = getattr(table, "_settled_at", None)
        if path:
            files, target = _file_system(table.sparkSession, path)
            files.delete(target, True)


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def partitions_for(text: list[DataFrame], column: str, part_bytes: int | None = None) -> int:
    """Parts in which a task's share of the texts stays bounded: the session's shuffle partitions, or more for more text."""
    size = sum(df.agg(F.sum(F.octet_length(column).cast("long"))).first()[0] or 0 for df in text)
    return max(shuffle_partitions(text[0].sparkSession), -(-size // (part_bytes or PART_BYTES)))
