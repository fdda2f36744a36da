"""Parsing, canonical keys and renaming of rule texts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rulewright.functions import atoms

# The clause grammar. A head is an atom; a body element an atom, possibly negated, or a comparison of two terms.
TERM = r"(?:[A-Za-z_]\w*|-?\d+)"
ATOM = rf"[a-z]\w*(?:\s*\(\s*{TERM}(?:\s*,\s*{TERM})*\s*\))?"
ELEMENT = rf"(?:(?:not\s+)?{ATOM}|{TERM}\s*(?:==|!=|<=|>=|=|<|>)\s*{TERM})"
RULE = rf"^{ATOM}(?:\s*:-\s*{ELEMENT}(?:\s*,\s*{ELEMENT})*)?$"


def parse_rules(df: DataFrame, line: str) -> DataFrame:
    """df with head and body (array); both null where the line is no rule. A comment after % and the final dot are dropped."""
    text = F.trim(F.regexp_replace(F.trim(F.regexp_replace(F.col(line), r"\s*%.*$", "")), r"\.+$", ""))
    ok = text.rlike(RULE)
    parts = F.split(text, r"\s*:-\s*", 2)
    body = F.when(F.size(parts) > 1, atoms.split_top_level(F.get(parts, F.lit(1)))).otherwise(F.array().cast("array<string>"))
    return df.withColumn("head", F.when(ok, F.trim(F.get(parts, F.lit(0))))).withColumn("body", F.when(ok, body))


def unsafe_variables(head: F.Column, body: F.Column) -> F.Column:
    """Variables that no positive body atom binds, directly or through equalities; sorted.

    An equality binds in one of as many steps as there are equalities, so the fold over them is repeated for each of them.
    """
    names = lambda x: F.filter(F.regexp_extract_all(x, F.lit(r"\b[A-Z_]\w*\b"), F.lit(0)), lambda v: v != "_")
    compared = lambda x: x.rlike(rf"^{TERM}\s*(?:==|!=|<=|>=|=|<|>)\s*{TERM}$")
    equal = F.filter(body, lambda x: x.rlike(rf"^{TERM}\s*={{1,2}}\s*{TERM}$"))
    none = F.array().cast("array<string>")
    start = F.aggregate(F.filter(body, lambda x: ~compared(x) & ~x.startswith("not ")), none, lambda acc, x: F.array_union(acc, names(x)))

    def step(bound, e):
        sides = F.transform(F.split(e, r"\s*={1,2}\s*"), lambda x: F.trim(x))
        a, b = F.get(sides, F.lit(0)), F.get(sides, F.lit(1))
        free = lambda t: t.rlike("^[A-Z_]") & ~F.array_contains(bound, t)
        return F.when(free(a) & ~free(b), F.array_union(bound, F.array(a))).when(free(b) & ~free(a), F.array_union(bound, F.array(b))).otherwise(bound)

    closed = F.aggregate(F.transform(equal, lambda _: F.lit(0)), start, lambda acc, _: F.aggregate(equal, acc, step))
    every = F.array_distinct(F.flatten(F.transform(F.concat(F.array(head), body), names)))
    return F.array_sort(F.array_except(every, closed))


def canonical_key(df: DataFrame, head: str = "head", body: str = "body", out: str = "key") -> DataFrame:
    """df with a key that is equal for rules equal up to the order of the body and the names of variables.

    The body is sorted with variables masked, then variables are renamed by first appearance.
    """
    masked = F.array_sort(F.transform(F.col(body), lambda x: F.struct(F.regexp_replace(atoms.squeeze(x), r"\b[A-Z]\w*", "_").alias("m"), atoms.squeeze(x).alias("t"))))
    text = F.concat(atoms.squeeze(F.col(head)), F.lit(":-"), F.array_join(F.transform(masked, lambda x: x["t"]), ","))
    tokens = F.regexp_extract_all(text, F.lit(r"\w+|\W+"), F.lit(0))
    names = F.array_distinct(F.filter(tokens, lambda x: x.rlike("^[A-Z]")))
    renamed = F.transform(tokens, lambda x: F.when(x.rlike("^[A-Z]"), F.concat(F.lit("V"), (F.array_position(names, x) - 1).cast("string"))).otherwise(x))
    return df.withColumn(out, F.array_join(renamed, ""))


def name_map(df: DataFrame, name: str, order: list[str], letters: str) -> DataFrame:
    """(name, alias): generated names in the order of first appearance; one row for each distinct name.

    Names are numbered by range partitions of their first place, so no task sees them all.
    """
    from rulewright.functions.stats import running_total

    first = df.groupBy(name).agg(F.min(F.struct(*order)).alias("at")).withColumn("one", F.lit(1))
    ranked = running_total(first, "at", "one", "k")
    return ranked.select(F.col(name).alias("name"), atoms.generated_name(F.col("k").cast("long") - 1, letters).alias("alias"))


def renamed(df: DataFrame, texts: str, mapping: str) -> DataFrame:
    """df whose array of texts has every whole word that is a key of the map column replaced, all at once."""

    def one(x):
        tokens = F.regexp_extract_all(x, F.lit(r"\w+|\W+"), F.lit(0))
        return F.array_join(F.transform(tokens, lambda t: F.coalesce(F.element_at(F.col(mapping), t), t)), "")

    return df.withColumn(texts, F.transform(F.col(texts), one))
