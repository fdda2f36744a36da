"""Anonymised and permuted problems."""

from __future__ import annotations

import json
import random
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame

from rulewright.operators.learner import Problem, solve
from rulewright.operators.reason import EQUAL, Framework, Rule, is_variable, parse

#: Letters that generated names start from.
PREDICATE_LETTERS, CONSTANT_LETTERS = "pqrstuvw", "abcdefghijklmno"


def generated(i: int, letters: str) -> str:
    return letters[i % len(letters)] + (str(i // len(letters)) if i >= len(letters) else "")


def symbols(p: Problem) -> tuple[list[str], list[str]]:
    """Predicates and constants in the order of first appearance."""
    preds, consts = {}, {}

    def see(part: str) -> None:
        part = re.sub(r"^\s*not\s+", "", part)
        m = EQUAL.match(part)
        if m:
            terms = m.groups()
        else:
            pred, terms = parse(part)
            if pred != "dom":
                preds.setdefault(pred)
        for t in terms:
            if not is_variable(t):
                consts.setdefault(t)

    for r in p.background.rules:
        for part in (r.head, *r.body):
            see(part)
    for a in p.background.assumptions:
        see(a)
        see(p.background.contrary(a))
    for a in (*p.positive, *p.negative):
        see(a)
    for q in p.learnable:
        preds.setdefault(q)
    for c in p.domain:
        consts.setdefault(c)
    return list(preds), list(consts)


def rewritten(p: Problem, names: dict[str, str]) -> Problem:
    """The problem with every whole word that is a key replaced, all at once."""
    word = re.compile(r"\b[A-Za-z_]\w*\b|\b\d+\b")
    put = lambda x: word.sub(lambda m: names.get(m[0], m[0]), x)
    b = p.background
    fw = Framework([Rule(put(r.head), tuple(put(x) for x in r.body)) for r in b.rules], [put(a) for a in b.assumptions], {put(a): put(c) for a, c in b.contraries.items()})
    return Problem(fw, [put(a) for a in p.positive], [put(a) for a in p.negative], [put(q) for q in p.learnable], [put(c) for c in p.domain])


def renamed_rule(text: str, names: dict[str, str]) -> str:
    """A rule or atom with every whole word that is a key replaced, all at once."""
    return re.sub(r"\b[A-Za-z_]\w*\b|\b\d+\b", lambda m: names.get(m[0], m[0]), text)


def anonymised(p: Problem) -> tuple[Problem, dict[str, str]]:
    """The problem under generated names, and the names; the inverse map restores it."""
    preds, consts = symbols(p)
    names = {q: generated(i, PREDICATE_LETTERS) for i, q in enumerate(preds)} | {c: f"{generated(i, CONSTANT_LETTERS)}" for i, c in enumerate(consts)}
    if len(set(names.values())) < len(names):  # a predicate and a constant may not share a name
        names |= {c: f"{n}0" if n in {names[q] for q in preds} else n for c, n in ((c, names[c]) for c in consts)}
    return rewritten(p, names), names


def restored(p: Problem, names: dict[str, str]) -> Problem:
    return rewritten(p, {v: k for k, v in names.items()})


def invariant(p: Problem) -> bool:
    """Whether the learner takes the same course under other names."""
    a, b = solve(p), solve(anonymised(p)[0])
    return a["success"] == b["success"] and [s["kind"] for s in a["steps"]] == [s["kind"] for s in b["steps"]]


def derangement(items: list[str], seed: int) -> dict[str, str]:
    """A seeded permutation without a fixed point (one item stays)."""
    rnd, out = random.Random(seed), list(items)
    while len(items) > 1:
        rnd.shuffle(out)
        if all(a != b for a, b in zip(items, out, strict=True)):
            break
    return dict(zip(items, out, strict=True))


def permuted(problems: DataFrame, seed: int = 0) -> DataFrame:
    """(problem_id, problem) with the predicates of each problem deranged among themselves: the meaning of names is lost, the structure is not."""

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for pid, text in zip(batch["problem_id"], batch["problem"], strict=True):
                p = Problem.of(json.loads(text))
                preds, _ = symbols(p)
                rows.append((pid, json.dumps(rewritten(p, derangement(preds, hash_seed(pid, seed))).to_dict())))
            yield pd.DataFrame(rows, columns=["problem_id", "problem"])

    return problems.select("problem_id", "problem").mapInPandas(work, "problem_id string, problem string")


def hash_seed(text: str, seed: int) -> int:
    import hashlib

    return int(hashlib.sha256(f"{seed}|{text}".encode()).hexdigest()[:8], 16) % (1 << 31)
