"""Explanations of learnt frameworks and outcomes of single examples."""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rulewright.operators.answers import parse_rule
from rulewright.operators.learner import Problem, solve
from rulewright.operators.reason import Checker, Rule, parse


def mechanism(rule: Rule, new: set[str], known: set[str]) -> str:
    """fact, guarded by a new assumption, guarded by a known one, defined by an exception, or general."""
    body = set(rule.body)
    if any("=" in b for b in body) or not body:
        return "fact"
    if body & new:
        return "new_exception"
    if body & known:
        return "reused_assumption"
    return "exception_rule" if parse(rule.head)[0].startswith("c_") else "general"


def mechanism_column(head: F.Column, body: F.Column, new: F.Column, known: F.Column) -> F.Column:
    """The same over columns: body, new and known are arrays of atoms."""
    fact = (F.size(body) == 0) | F.exists(body, lambda x: x.contains("="))
    return F.when(fact, "fact").when(F.arrays_overlap(body, new), "new_exception").when(F.arrays_overlap(body, known), "reused_assumption").when(head.startswith("c_"), "exception_rule").otherwise("general")


def narrative(p: Problem, got: dict) -> str:
    """What was learnt, in sentences."""
    if not got["success"]:
        return "No rules explain the examples."
    new, known = set(got["assumptions"]), set(p.background.assumptions)
    out = []
    for text in got["rules"]:
        rule = parse_rule(text)
        head, kind = parse(rule.head)[0], mechanism(rule, new, known)
        rest = " and ".join(parse(b)[0] for b in rule.body if b not in new | known and "=" not in b) or "anything"
        guards = [b for b in rule.body if b in new | known]
        end = "".join(f", unless {parse(got['contraries'].get(g) or p.background.contrary(g))[0]}" for g in guards)
        out.append(f"{rest} is {head}{end}." if kind != "fact" else f"{head} holds where {', '.join(rule.body)}.")
    return " ".join(out)


OUTCOME = "problem_id string, atom string, label string, status string, narrative string"


def example_outcomes(problems: DataFrame) -> DataFrame:
    """For each example of each problem its status in the learnt framework."""

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for pid, text in zip(batch["problem_id"], batch["problem"], strict=True):
                p = Problem.of(json.loads(text))
                got = solve(p)
                fw = p.background.extended([parse_rule(r) for r in got["rules"]], got["assumptions"], got["contraries"])
                status = Checker(fw, p.domain).status(p.positive if got["success"] else [], p.negative if got["success"] else [], [*p.positive, *p.negative])
                rows += [(pid, a, "pos" if a in p.positive else "neg", s, narrative(p, got)) for a, s in status.items()]
            yield pd.DataFrame(rows, columns=["problem_id", "atom", "label", "status", "narrative"])

    return problems.select("problem_id", "problem").mapInPandas(work, OUTCOME)


PROSE = "answer_id string, problem_id string, has_trace boolean, answer_first boolean, n_rule_lines int, steps array<string>, precision double, recall double, f1 double, align_exact double, r1_recall double, r2_recall double, r3_recall double, r4_recall double, phase_order_ok boolean"


def prose_scores(answers: DataFrame, problems: DataFrame) -> DataFrame:
    """answers (answer_id, problem_id, raw): the steps that each text takes, and how they compare with the learner's own."""
    from rulewright.operators.trace_score import prose_steps, trace_score

    names = [c.split()[0] for c in PROSE.split(", ")]

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        known: dict[str, tuple[Problem, dict]] = {}
        for batch in batches:
            rows = []
            for aid, pid, raw, text in zip(batch["answer_id"], batch["problem_id"], batch["raw"], batch["problem"], strict=True):
                if text not in known:
                    if len(known) >= 256:
                        known.clear()
                    p = Problem.of(json.loads(text))
                    known[text] = (p, solve(p))
                p, got = known[text]
                steps, info = prose_steps(raw, p)
                row = {"answer_id": aid, "problem_id": pid, "steps": [f"{s} {k}" for s, k in steps], **info, **trace_score(steps, got, p)}
                rows.append(tuple(row[n] for n in names))
            yield pd.DataFrame(rows, columns=names, dtype=object)

    return answers.join(problems, "problem_id").select("answer_id", "problem_id", "raw", "problem").mapInPandas(work, PROSE)


OFF = "problem_id string, atom string, status string"


def off_example_status(problems: DataFrame) -> DataFrame:
    """Atoms of the example predicates over the domain that are no examples, with their status in the learnt framework."""
    from rulewright.operators.learner import rows_of_problems
    from rulewright.operators.scoring import Reference

    return rows_of_problems(problems, lambda pid, p: ((pid, a, s) for a, s in Reference(p).status.items()), OFF)
