"""Token counts as an exact length histogram with suffix sums.

Documents are encoded once and only their lengths are aggregated: one row per distinct encoded length. Suffix sums over
that histogram answer, for every context limit L, how many documents are longer, how many tokens are kept when texts are
truncated to L, and where the quantiles lie. The sums run in two levels (blocks of lengths, then inside a block), so no
task holds the whole histogram. Null and empty texts have length 0 and count as documents, repeated rows count each time, and
very long texts are encoded whole; an empty table gives no rows. Only the text column is read, whatever others are called.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from rulewright.functions.stats import running_total
from rulewright.llm._store import settle
from rulewright.llm.bpe import token_counts

BLOCK = 256


def histogram(df: DataFrame, text: str = "text", path: str | None = None) -> DataFrame:
    """(n_tokens, n_docs) for each distinct encoded length, written once as several reports read it."""
    return settle(token_counts(df, [], text, path).groupBy("n_tokens").agg(F.count(F.lit(1)).alias("n_docs")), "lengths")


def context_limits(hist: DataFrame) -> DataFrame:
    """One row per distinct length L taken as the context limit.

    n_docs have exactly L tokens, docs_longer have more, docs_upto have at most L; tokens_total is that of the corpus,
    tokens_truncated what stays if each text is cut to L tokens, tokens_lost the rest; quantile = docs_upto / all.
    A limit between two of these lengths a < L < b has docs_upto(a), docs_longer(a) and
    tokens_truncated(a) + (L - a) * docs_longer(a).
    """
    h = hist.select("n_tokens", "n_docs", F.floor(F.col("n_tokens") / BLOCK).alias("block"), (F.col("n_tokens") * F.col("n_docs")).alias("tokens"))
    blocks = h.groupBy("block").agg(F.sum("n_docs").alias("bd"), F.sum("tokens").alias("bt"))
    whole = h.agg(F.sum("n_docs").alias("docs_all"), F.sum("tokens").alias("tokens_total"))
    # Sums up to a block run over ranges of blocks; what lies behind it is the rest.
    upto = running_total(running_total(blocks, "block", "bd", "du"), "block", "bt", "tu")
    blocks = upto.crossJoin(whole).select("block", (F.col("docs_all") - F.col("du")).alias("docs_after"), (F.col("tokens_total") - F.col("tu")).alias("tokens_after"), "docs_all", "tokens_total")  # whole is one row
    inside = Window.partitionBy("block").orderBy(F.col("n_tokens").desc()).rowsBetween(Window.unboundedPreceding, -1)
    longer = F.coalesce(F.sum("n_docs").over(inside), F.lit(0)) + F.col("docs_after")
    tokens_longer = F.coalesce(F.sum("tokens").over(inside), F.lit(0)) + F.col("tokens_after")
    out = h.join(blocks, "block").withColumn("docs_longer", longer).withColumn("tokens_longer", tokens_longer)
    truncated = F.col("tokens_total") - F.col("tokens_longer") + F.col("n_tokens") * F.col("docs_longer")
    return out.select(
        F.col("n_tokens").alias("context_limit"),
        "n_docs",
        (F.col("docs_all") - F.col("docs_longer")).alias("docs_upto"),
        "docs_longer",
        F.round((F.col("docs_all") - F.col("docs_longer")) / F.col("docs_all"), 9).alias("quantile"),
        "tokens_total",
        truncated.alias("tokens_truncated"),
        (F.col("tokens_total") - truncated).alias("tokens_lost"),
    )


def quantile_lengths(limits: DataFrame, shares: list[float]) -> DataFrame:
    """(share, n_tokens): the least length that at least this share of the documents does not exceed."""
    spark = limits.sparkSession
    wanted = spark.createDataFrame([(float(s),) for s in shares], "share double")
    return F.broadcast(wanted).join(limits, F.col("docs_upto") >= F.col("share") * (F.col("docs_upto") + F.col("docs_longer"))).groupBy("share").agg(F.min("context_limit").alias("n_tokens"))
