"""Built-in problems as literals (fixed values: their facts, rules, contraries and examples)."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession

from rulewright.operators.learner import Problem
from rulewright.operators.reason import Framework, Rule


def _facts(text: str) -> list[Rule]:
    return [Rule(x) for x in text.split()]


def diamond() -> Problem:
    rules = _facts("quaker(a) quaker(b) quaker(e) democrat(c) republican(a) republican(b) republican(d)")
    rules += [Rule("democrat(X)", ("person(X)", "votes_dem(X)")), Rule("republican(X)", ("person(X)", "votes_rep(X)")), Rule("pacifist(X)", ("quaker(X)", "normal_quaker(X)")), Rule("person(X)", ("dom(X)",))]
    against = {"votes_dem(X)": "republican(X)", "votes_rep(X)": "democrat(X)", "normal_quaker(X)": "abnormal_quaker(X)"}
    return Problem(Framework(rules, list(against), against), ["pacifist(a)", "pacifist(c)", "pacifist(e)"], ["pacifist(b)", "pacifist(d)"], ["pacifist", "abnormal_quaker"], list("abcde"))


def birds() -> Problem:
    against = {"normal_bird(X)": "ab_bird(X)"}
    return Problem(Framework(_facts("bird(tweety) bird(sam) bird(opus) penguin(sam) penguin(opus)"), list(against), against), ["flies(tweety)"], ["flies(sam)", "flies(opus)"], ["flies", "ab_bird"], ["tweety", "sam", "opus"])


def tax() -> Problem:
    rules = _facts("employed(alice) employed(bob) self_employed(carol)")
    rules += [Rule("income(alice)", ("employed(alice)",)), Rule("income(bob)", ("employed(bob)",)), Rule("income(carol)", ("self_employed(carol)",))]
    against = {"normal_taxpayer(X)": "exempt(X)"}
    return Problem(Framework(rules, list(against), against), ["taxable(alice)", "taxable(carol)"], ["taxable(bob)"], ["taxable", "exempt"], ["alice", "bob", "carol"])


#: The built-in problems by the ids under which rows are stored.
BUILTIN = {"nixon_diamond": diamond, "flies": birds, "tax_law": tax}


def problems(spark: SparkSession) -> DataFrame:
    """(problem_id, problem JSON) of the built-in problems."""
    return spark.createDataFrame([(n, json.dumps(make().to_dict())) for n, make in BUILTIN.items()], "problem_id string, problem string")
