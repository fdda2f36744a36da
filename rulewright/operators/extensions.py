"""Stable extensions of unary frameworks as column expressions: one row for each (framework, constant).

When every rule ranges over one shared variable, the ground program falls apart into one component for each constant, so a
component is a row: the facts of its constant, the rules and the assumptions. Accepted assumptions are guessed bit by bit,
and a guess stays if the least model agrees with it. Nothing is shuffled beyond bringing the facts of a constant together.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Assumptions of one component beyond which guessing is refused.
GUESS_LIMIT = 12


def closure(known: Column, rules: Column) -> Column:
    """Least set of predicates with known that is closed under rules (array of struct head, body)."""
    step = lambda acc, _: F.aggregate(rules, acc, lambda a, r: F.when(F.size(F.array_except(r["body"], a)) == 0, F.array_union(a, F.array(r["head"]))).otherwise(a))
    return F.aggregate(rules, F.array_distinct(known), step)


def models(components: DataFrame, facts: str = "facts", rules: str = "rules", assumptions: str = "assumptions") -> DataFrame:
    """components exploded to one row for each stable model: accepted (assumptions) and model (all true predicates).

    facts: array<string>; rules: array<struct<head,body>>; assumptions: array<struct<asm,contrary>>. A component without a
    model gives no row.
    """
    n = F.size(assumptions)
    bits = F.when(n <= GUESS_LIMIT, F.sequence(F.lit(0), F.call_function("shiftleft", F.lit(1), n) - 1)).otherwise(F.raise_error(F.lit("too many assumptions in one component")).cast("array<int>"))
    guess = components.withColumn("__bits", F.explode(bits))
    accepted = F.filter(F.transform(assumptions, lambda a, i: F.struct(a["asm"].alias("asm"), i.alias("i"))), lambda x: F.call_function("bit_get", F.col("__bits").cast("long"), x["i"]) == 1)
    guess = guess.withColumn("accepted", F.transform(accepted, lambda x: x["asm"]))
    guess = guess.withColumn("model", closure(F.concat(F.col(facts), F.col("accepted")), F.col(rules)))
    agrees = F.forall(assumptions, lambda a: F.array_contains(F.col("accepted"), a["asm"]) != F.array_contains(F.col("model"), a["contrary"]))
    return guess.where(agrees).drop("__bits")


def admissible(found: DataFrame, must: str, never: str) -> DataFrame:
    """Models that hold all predicates of must and none of never (arrays of the row)."""
    return found.where((F.size(F.array_except(must, "model")) == 0) & ~F.arrays_overlap(F.coalesce(F.col(never), F.array().cast("array<string>")), "model"))


def brave(components: DataFrame, fw: list[str], const: str, must: str, never: str) -> DataFrame:
    """(fw, holds): whether one extension satisfies all examples, that is, whether every component has an admissible model."""
    ok = admissible(models(components), must, never).select(*fw, const).distinct().withColumn("__ok", F.lit(1))
    return components.select(*fw, const).distinct().join(ok, [*fw, const], "left").groupBy(*fw).agg((F.count("__ok") == F.count(F.lit(1))).alias("holds"))


def status(components: DataFrame, fw: list[str], const: str, must: str, never: str, query: str) -> DataFrame:
    """(fw, const, status) of the predicate in column query: ALWAYS, NEVER, FREE, or NO_EXTENSION if some component of the framework has none."""
    seen = admissible(models(components), must, never).groupBy(*fw, const).agg(F.bool_or(F.array_contains("model", F.col(query))).alias("yes"), F.bool_or(~F.array_contains("model", F.col(query))).alias("no"))
    holds = brave(components, fw, const, must, never)
    out = components.select(*fw, const).distinct().join(seen, [*fw, const], "left").join(holds, fw)
    word = F.when(~F.col("holds"), "NO_EXTENSION").when(F.col("yes") & F.col("no"), "FREE").when(F.col("yes"), "ALWAYS").otherwise("NEVER")
    return out.select(*fw, const, word.alias("status"))


def fewest_facts(components: DataFrame, learnable: str, must: str, never: str) -> DataFrame:
    """components with cost and added: the fewest learnable predicates whose facts let the component satisfy its examples.

    Ties go to the subset that comes first in the order of learnable. Null where no subset does.
    """
    n = F.size(learnable)
    choice = components.withColumn("__id", F.monotonically_increasing_id()).withColumn("__pick", F.explode(F.sequence(F.lit(0), F.call_function("shiftleft", F.lit(1), n) - 1)))
    added = F.filter(F.transform(learnable, lambda p, i: F.when(F.call_function("bit_get", F.col("__pick").cast("long"), i) == 1, p)), lambda x: x.isNotNull())
    choice = choice.withColumn("added", added).withColumn("facts", F.array_union("facts", "added"))
    ok = admissible(models(choice), must, never)
    return ok.groupBy("fw", "const").agg(F.min_by(F.struct(F.size("added").alias("cost"), "added"), F.struct(F.size("added"), "__pick")).alias("best")).select("fw", "const", "best.cost", "best.added")
