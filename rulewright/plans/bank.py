"""Literal cases dealt over whole tables, so operators on rules, answers and problems run on every row of them."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rulewright.plans._registry import table


def dealt(spark, d: str, name: str, key: str, cases: list[tuple], schema: str) -> DataFrame:
    """(id, k, case columns): case id % n for each row of a table. The cases are the literals of this package, so they are small."""
    rows = spark.createDataFrame([(k, *c) for k, c in enumerate(cases)], f"k int, {schema}")
    return table(spark, d, name).select(F.col(key).alias("id")).withColumn("k", (F.col("id") % len(cases)).cast("int")).join(F.broadcast(rows), "k")


def values(columns: list[str], rows: list[tuple]) -> str:
    """DuckDB SQL of literal rows."""
    empty = [all(r[i] is None for r in rows) for i in range(len(columns))]
    null = lambda i: f"CAST(NULL AS {'VARCHAR' if columns[i] == 'error' else 'DOUBLE'})"
    text = ", ".join("(" + ", ".join(null(i) if empty[i] else _literal(v) for i, v in enumerate(r)) + ")" for r in rows)
    return f"SELECT * FROM (VALUES {text}) e({', '.join(map(_quoted, columns))})"


def _quoted(name: str) -> str:
    return f'"{name}"'


def dealt_oracle(name: str, key: str, n: int, columns: list[str], rows: list[tuple]) -> str:
    """DuckDB SQL of the expected rows: (case number, values) dealt in the same way. A case may have several rows or none."""
    return f"SELECT t.{key} AS id, {', '.join('e.' + _quoted(c) for c in columns)} FROM {name} t JOIN ({values(['case_no', *columns], rows)}) e ON t.{key} % {n} = e.case_no"


def _literal(v) -> str:
    if v is None:
        return "NULL"
    if isinstance(v, bool):
        return str(v).lower()
    if isinstance(v, float):
        return f"CAST({v!r} AS DOUBLE)"
    if isinstance(v, int):
        return str(v)
    return "'" + v.replace("'", "''") + "'"


def problem_cases() -> list[tuple[str, str]]:
    """(problem_id, problem JSON) of the built-in problems and of small ones for what those do not reach."""
    from rulewright.operators.learner import Problem
    from rulewright.operators.reason import Framework, Rule
    from rulewright.sources.builtin import BUILTIN

    facts = lambda text: [Rule(x) for x in text.split()]
    out = {name: make() for name, make in BUILTIN.items()}
    out["needless"] = Problem(Framework([*facts("bird(a) bird(b)"), Rule("flies(X)", ("bird(X)",))]), ["flies(a)"], [], ["flies"], ["a", "b"])
    out["even_cycle"] = Problem(Framework([*facts("tall(a) tall(b) wide(b)"), Rule("left(X)", ("p(X)",)), Rule("right(X)", ("q(X)",))], ["p(X)", "q(X)"], {"p(X)": "right(X)", "q(X)": "left(X)"}), ["left(a)", "right(b)"], ["left(b)"], ["left", "right"], ["a", "b"])
    out["binary"] = Problem(Framework([*facts("parent(a,b) parent(b,c) old(a)"), Rule("elder(X)", ("parent(X,Y)", "parent(Y,Z)"))]), ["chief(a)"], ["chief(b)", "chief(c)"], ["chief"], ["a", "b", "c"])
    out["hopeless"] = Problem(Framework(facts("same(a) same(b)")), ["x(a)"], ["x(a)"], ["x"], ["a", "b"])
    return [(n, json.dumps(p.to_dict())) for n, p in out.items()]


def problems(spark, d: str, name: str = "nation", key: str = "n_nationkey") -> DataFrame:
    """(problem_id, problem): a problem for each row of a table; its id is the row's key."""
    got = dealt(spark, d, name, key, problem_cases(), "name string, problem string")
    return got.select(F.col("id").cast("string").alias("problem_id"), "problem")


def by_id(df: DataFrame, kind: str = "int") -> DataFrame:
    """df with id, in the type of the table's key, instead of problem_id."""
    return df.withColumn("id", F.col("problem_id").cast(kind)).drop("problem_id")


def narrow(df: DataFrame) -> DataFrame:
    """df with its counts as int, as the expected rows have them."""
    return df.select(*[F.col(c).cast("int").alias(c) if t == "bigint" else F.col(c) for c, t in df.dtypes])
