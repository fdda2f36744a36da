"""Structural signatures by colour refinement: equal for graphs that differ in names and order only."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def one_round(nodes: DataFrame) -> DataFrame:
    """(g, sig) of star graphs: each node is coloured by its own colour and its centre's, the signature hashes the sorted colours."""
    coloured = nodes.select("g", F.md5(F.concat_ws("|", "colour", "near")).alias("c"))
    return coloured.groupBy("g").agg(F.md5(F.array_join(F.array_sort(F.collect_list("c")), ",")).alias("sig"))


def signatures(nodes: DataFrame, edges: DataFrame, rounds: int = 3) -> DataFrame:
    """(g, sig) of coloured graphs with labelled edges. nodes: (g, node, colour); edges: (g, a, label, b), seen from both ends."""
    both = edges.select("g", F.col("a").alias("node"), F.concat(F.lit(">"), "label").alias("l"), F.col("b").alias("other")).union(edges.select("g", "b", F.concat(F.lit("<"), "label"), "a"))
    now = nodes.select("g", "node", F.md5("colour").alias("colour"))
    for _ in range(rounds):
        seen = both.join(now.select("g", F.col("node").alias("other"), F.col("colour").alias("oc")), ["g", "other"]).groupBy("g", "node").agg(F.array_join(F.array_sort(F.collect_list(F.concat_ws(":", "l", "oc"))), ",").alias("around"))
        now = now.join(seen, ["g", "node"], "left").select("g", "node", F.md5(F.concat_ws("|", "colour", F.coalesce("around", F.lit("")))).alias("colour"))
    return now.groupBy("g").agg(F.sha1(F.array_join(F.array_sort(F.collect_list("colour")), ",")).alias("sig"))
