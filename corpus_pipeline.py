"""A training-data pipeline over `documents`: filter, deduplicate, decontaminate, redact, encode.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; it is written as Parquet and read again as the next one's
docs. All but the last return the columns of documents, extra ones too; every stage works on all that its predecessor kept.

In every stage a null text is an empty one and stays null, very long texts are taken whole, an empty table gives an empty
one, and rows with nulls in other columns are kept or dropped like any. Rows without an id are judged by the quality,
decontamination and redaction stages; the near-duplicate stage keeps them, as nothing can be linked with them. Rows that
share an id are one document there: they stay or go together.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rulewright.llm import bpe, decontaminate, ngram_join, pii, quality
from rulewright.llm._memory import small_batches
from rulewright.llm._store import settle


def quality_filter(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier accepts (score of at least 0.7)."""
    small_batches(spark)
    return quality.keep_good(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document (the smallest id) of each group that the n-gram Jaccard join links."""
    small_batches(spark)
    return ngram_join.drop_copies(docs)


def decontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a region of a benchmark item."""
    small_batches(spark)
    return decontaminate.drop_leaks(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def redacted(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with personal data replaced by its kind; n_chars follows the new text."""
    out = pii.redact(docs)
    return out.withColumn("n_chars", F.length("text").cast("long")).select(docs.columns) if "n_chars" in docs.columns else out


def encoded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as token ids (doc_id and, where docs has them, lang and source); exact tells that decoding gives the text again."""
    small_batches(spark)
    known = [c for c in ("doc_id", "lang", "source") if c in docs.columns]
    fields = [T.StructField("n_tokens", T.LongType()), T.StructField("ids", T.BinaryType()), T.StructField("decoded", T.StringType())]
    out = bpe.map_tokens(docs, fields, lambda ids, back: (len(ids) // 4, ids, back.decode()), [*known, "text"])
    return out.select(*known, "n_tokens", F.col("ids").alias("ids_le_uint32"), (F.col("decoded") == F.coalesce("text", F.lit(""))).alias("exact"))


STAGES = [
    ("quality", quality_filter),
    ("near_duplicates", near_duplicates),
    ("decontaminate", decontaminated),
    ("pii", redacted),
    ("bpe", encoded),
]

#: SQL cannot express the fitted and the tokenizing stages; a test compares run() with the five stages in plain Python.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = settle(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
