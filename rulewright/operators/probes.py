"""Questions on single decisions (probes): made from the states that the learner visits, and scored one by one."""

from __future__ import annotations

import json
import random
import re
from collections.abc import Iterator
from dataclasses import dataclass, field
from typing import Any

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rulewright.functions.stats import count_if
from rulewright.operators.answers import ASSUMPTIONS_HEAD, RULES_HEAD, clean, parse_rule, statement
from rulewright.operators.learner import Ask, Problem, course, framework, relative_assumptions, rows_of_problems
from rulewright.operators.reason import Rule, brave, parse
from rulewright.operators.scoring import predicate
from rulewright.operators.steps import render_state
from rulewright.operators.trace_score import without_echo

PROBE_KINDS = ("role", "fold", "check", "introduce", "subsume")
YES_NO = ("check", "subsume")
_FACT = re.compile(r"^(?:R1\s+)?([a-z]\w*)\(\s*([A-Za-z0-9_]\w*)\s*\)(?:\s*:-\s*(\w+)\s*=\s*(\w+))?\s*\.?$")
_ASKS = {
    "role": "List the fewest facts that make the examples hold, one p(c). on a line.",
    "fold": "Give one rule without constants that a background rule turns {rule} into.",
    "check": "Do these rules make the examples hold? Answer YES, or NO and the examples that fail, one on a line.",
    "introduce": "{fold} does not solve the problem. Guard it: RULE: <rule>, ASSUMPTION: <a> defeated_by <c>, and CONTRARY: <rule> if the assumption is new.",
    "subsume": "Do the examples hold without {rule}? Answer YES or NO.",
}


@dataclass
class Probe:
    probe_id: str
    kind: str
    prompt: str
    oracle: Any
    rules: list[str] = field(default_factory=list)
    asms: dict[str, str] = field(default_factory=dict)
    fold: str | None = None

    def plain(self) -> str:
        return json.dumps({"probe_id": self.probe_id, "kind": self.kind, "oracle": self.oracle, "rules": self.rules, "asms": self.asms, "fold": self.fold})


def visited(p: Problem) -> Iterator[tuple[Ask, Any]]:
    """The learner's decisions with its own answers."""
    run, reply = course(p), None
    while True:
        try:
            ask = run.send(reply)
        except StopIteration:
            return
        reply = ask.compute()
        yield ask, reply


def probes(p: Problem, pid: str, per_kind: int = 2, seed: int = 42) -> list[Probe]:
    """The role probe, and at most per_kind probes of every other kind (of yes/no kinds half of either answer), sampled by a
    generator seeded with the problem."""
    found: list[Probe] = []
    head = statement(p.positive, p.negative, p.background, p.learnable, p.domain)

    def add(kind: str, oracle: Any, ask: Ask, rules: list[Rule], fold: Rule | None = None) -> None:
        asms = dict(ask.state.get("asms", {}))
        shown = render_state({"rules": [r.text() for r in rules], "asms": asms}) if kind != "role" else ""
        words = {"rule": ask.state["rule"].text() if "rule" in ask.state else "", "fold": fold.text() if fold else ""}
        text = "\n\n".join(x for x in (head, shown, _ASKS[kind].format(**words)) if x)
        found.append(Probe(f"{pid}::{kind}::{len(found)}" if kind != "role" else f"{pid}::role", kind, text, oracle, [r.text() for r in rules], asms, fold.text() if fold else None))

    for ask, answer in visited(p):
        s = ask.state
        if ask.kind == "role":
            if answer is None:
                return []
            add("role", sorted(f"{parse(r.head)[0]}({r.body[0].split(' = ')[1]})" for r in answer), ask, [])
        elif ask.kind == "subsume":
            add("subsume", bool(answer), ask, s["learnt"])
        elif ask.kind == "fold_candidates" and answer:
            add("fold", [r.text() for r, _ in answer], ask, s["learnt"])
        elif ask.kind == "check":
            add("check", bool(answer), ask, [*s["learnt"][: s["at"]], s["fold"], *s["learnt"][s["at"] + 1 :]])
        elif ask.kind == "reuse_scan":
            add("introduce", None, ask, [*s["learnt"][: s["at"]], s["rule"], *s["learnt"][s["at"] + 1 :]], s["fold"])
    rnd = random.Random(f"{seed}:{pid}")
    out = found[:1]
    for kind in PROBE_KINDS[1:]:
        pool = [x for x in found if x.kind == kind]
        if kind in YES_NO:
            half = max(1, per_kind // 2)
            for value in (True, False):
                own = [x for x in pool if x.oracle is value]
                out += rnd.sample(own, min(len(own), half))
        else:
            out += rnd.sample(pool, min(len(pool), per_kind))
    return out


# ---- scoring


def facts_in(text: str) -> set[str]:
    out = set()
    for line in text.split("\n"):
        m = _FACT.match(line.strip().lstrip("-*+ \t"))
        if m and (m[3] is None or m[3] == m[2]):
            out.add(f"{m[1]}({m[4] if m[3] and m[2][:1].isupper() else m[2]})")
    return out


def f1(said: set, gold: set) -> float:
    """1 for two empty sets."""
    if not said or not gold:
        return float(said == gold)
    hit = len(said & gold)
    return 2 * hit / (len(said) + len(gold))


def _rule_in(line: str) -> Rule | None:
    line = re.sub(r"^(RULE|CONTRARY)\s*:\s*", "", line.strip().lstrip("-*+ \t"), flags=re.I)
    return parse_rule(line) if ":-" in line else None


def _same(a: Rule, b: Rule) -> bool:
    return a.head == b.head and sorted(a.body) == sorted(b.body)


def failing_alone(probe: Probe, p: Problem) -> set[str]:
    """Examples that fail by themselves in the framework that a check is about."""
    fw = framework(p, [parse_rule(r) for r in probe.rules], probe.asms)
    bad = [e for e in p.positive if not brave(fw, [e], [], p.domain)] + [e for e in p.negative if not brave(fw, [], [e], p.domain)]
    return {re.sub(r"\s+", "", e) for e in bad}


def score_probe(probe: Probe, raw: str | None, p: Problem) -> tuple[bool, float, str]:
    """(right, partial score, what was read). Echoed question text is dropped first."""
    lines = without_echo(clean(raw or "").split("\n"))
    text = "\n".join(lines)
    if probe.kind == "role":
        said, gold = facts_in(text), set(probe.oracle)
        return said == gold, f1(said, gold), "; ".join(sorted(said))
    if probe.kind == "fold":
        got = next(filter(None, map(_rule_in, lines)), None)
        if got is None:
            return False, 0.0, "<unparseable>"
        good = any(_same(got, parse_rule(r)) for r in probe.oracle)
        return good, float(good), got.text()
    if probe.kind in YES_NO:
        m = re.search(r"\b(yes|no)\b", text, re.I)
        if not m:
            return False, 0.0, "<no yes/no>"
        said = m[1].lower() == "yes"
        good, word = said == probe.oracle, "YES" if said else "NO"
        if probe.kind == "check" and not probe.oracle:  # which examples fail is the part that cannot be guessed
            named = f1(facts_in(text), failing_alone(probe, p))
            return good, 0.5 * good + 0.5 * named, f"{word}|{named:.2f}"
        return good, float(good), word
    return _score_introduce(probe, lines, p)


def _bearing(lines: list[str]) -> list[str]:
    """Labelled lines, else the rules block, else all lines."""
    labelled = [x for x in lines if re.match(r"^\s*(RULE|CONTRARY)\s*:", x, re.I)]
    if len(labelled) >= 2:
        return labelled
    block = _block(lines, RULES_HEAD)
    return block if any(":-" in x for x in block) else lines


def _block(lines: list[str], head: re.Pattern) -> list[str]:
    at = next((i for i, x in enumerate(lines) if head.match(x)), None)
    if at is None:
        return []
    end = next((i for i in range(at + 1, len(lines)) if RULES_HEAD.match(lines[i]) or ASSUMPTIONS_HEAD.match(lines[i])), len(lines))
    return lines[at + 1 : end]


def _declaration(lines: list[str]) -> tuple[str, str] | None:
    """(assumption, contrary): a labelled declaration, else the first of the assumptions block, else the first of any line."""
    trim = lambda x: re.sub(r"\s+", "", x.strip().rstrip(".").strip())
    labelled = re.search(r"ASSUMPTION\s*:\s*(.+?)\s+defeated_by\s+(.+?)\s*$", "\n".join(lines), re.I | re.M)
    if labelled:
        return trim(labelled[1]), trim(labelled[2])
    own = _block(lines, ASSUMPTIONS_HEAD)
    for x in own if any(ASSUMPTIONS_HEAD.match(y) for y in lines) and any("defeated_by" in y for y in own) else lines:
        m = re.match(r"^\s*(.+?)\s+defeated_by\s+(.+?)\s*$", x, re.I)
        if m:
            return trim(m[1]), trim(m[2])
    return None


def _score_introduce(probe: Probe, lines: list[str], p: Problem) -> tuple[bool, float, str]:
    """Right where the fold is guarded by a relative assumption with its contrary, or, where there is none, by a new one with a new contrary."""
    rules, said = list(filter(None, map(_rule_in, _bearing(lines)))), _declaration(lines)
    if not rules or said is None:
        return False, 0.0, "<incomplete>"
    asm, against = said
    name = lambda atom: re.sub(r"\s+", "", atom).split("(")[0]
    guarded = next((r for r in rules if any(name(b) == name(asm) for b in r.body)), rules[0])
    fold, learnt = parse_rule(probe.fold), [parse_rule(r) for r in probe.rules]
    contraries = {a: p.background.contrary(a) for a in p.background.assumptions} | probe.asms
    relative = relative_assumptions(fold.body, framework(p, learnt, probe.asms))
    shape = name(guarded.head) == name(fold.head) and sorted(guarded.body) == sorted((*fold.body, asm))
    if relative:
        own = [a for a in relative if name(a) == name(asm)]
        took = bool(own) and name(against) == name(contraries.get(own[0], ""))
    else:
        used = {predicate(x) for r in (*p.background.rules, *learnt) for x in (r.head, *r.body)} | {name(x) for pair in contraries.items() for x in pair} | {name(x) for x in (*p.positive, *p.negative)} | {*p.learnable, "dom"}
        took = name(asm) not in used and name(against) not in used and name(asm) != name(against)
    good = shape and took
    chose = "reuse" if any(name(a) == name(asm) for a in contraries) else "fresh"
    return good, float(good), f"{guarded.text()} | {asm} defeated_by {against} | chose={chose},available={'reuse' if relative else 'fresh'}"


# ---- tables

PROBE = "probe_id string, problem_id string, kind string, prompt string, oracle string, oracle_bool boolean, probe string"


def probe_rows(problems: DataFrame, per_kind: int = 2, seed: int = 42) -> DataFrame:
    """The probes of each problem."""

    def rows(pid: str, p: Problem) -> Iterator[tuple]:
        for x in probes(p, pid, per_kind, seed):
            yield (x.probe_id, pid, x.kind, x.prompt, json.dumps(x.oracle), x.oracle if isinstance(x.oracle, bool) else None, x.plain())

    return rows_of_problems(problems, rows, PROBE)


RESULT = "probe_id string, problem_id string, kind string, oracle_bool boolean, correct boolean, score double, parsed string, error string"


def score_probes(rows: DataFrame, problems: DataFrame) -> DataFrame:
    """rows (of probe_rows, with raw) scored one by one; a probe that cannot be scored gives its error."""
    names = [c.split()[0] for c in RESULT.split(", ")]

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for r in batch.to_dict("records"):
                base = (r["probe_id"], r["problem_id"], r["kind"], r["oracle_bool"])
                try:
                    x = json.loads(r["probe"])
                    probe = Probe(x["probe_id"], x["kind"], "", x["oracle"], x["rules"], x["asms"], x["fold"])
                    out.append((*base, *score_probe(probe, r["raw"], Problem.of(json.loads(r["problem"]))), None))
                except Exception as e:  # noqa: BLE001  reported in the row
                    out.append((*base, False, 0.0, None, f"{type(e).__name__}: {e}"))
            yield pd.DataFrame(out, columns=names, dtype=object)

    both = rows.join(problems, "problem_id").select("probe_id", "problem_id", "kind", "oracle_bool", "probe", "raw", "problem")
    return both.mapInPandas(work, RESULT)


def aggregate(results: DataFrame, by: list[str] = ()) -> DataFrame:
    """One row for each kind: n, accuracy, mean score, chance, balanced accuracy, and for introduce the recall of either branch.

    Balanced accuracy is the mean recall of both answers (of both branches for introduce), null where one does not occur.
    """
    right = F.col("correct").cast("double")
    rate = lambda c: F.round(F.avg(c), 3)
    branch = F.regexp_extract("parsed", r"available=(\w+)", 1)
    chose = F.regexp_extract("parsed", r"chose=(\w+)", 1)
    of = lambda cond: F.avg(F.when(cond, right))
    introduce = F.col("kind") == "introduce"
    balanced = F.when(F.col("kind").isin(*YES_NO), (F.col("__yes") + F.col("__no")) / 2).when(introduce, (F.col("__reuse") + F.col("__fresh")) / 2)
    out = results.withColumn("__b", F.when(introduce, branch)).withColumn("__c", F.when(introduce, chose)).groupBy(*by, "kind").agg(
        F.count(F.lit(1)).alias("n"), rate(right).alias("accuracy"), rate(F.col("score")).alias("score"), of(F.col("oracle_bool")).alias("__yes"), of(~F.col("oracle_bool")).alias("__no"),
        of(F.col("__b") == "reuse").alias("__reuse"), of(F.col("__b") == "fresh").alias("__fresh"), count_if(F.col("__b") == "reuse").alias("n_reuse"), count_if(F.col("__b") == "fresh").alias("n_fresh"),
        rate(F.when(F.col("__c") != "", (F.col("__c") == "reuse").cast("double"))).alias("reuse_rate"),
    )
    return out.select(
        *by, "kind", "n", "accuracy", "score", F.when(F.col("kind").isin(*YES_NO), F.lit(0.5)).otherwise(F.lit(0.0)).alias("chance"), F.round(balanced, 3).alias("balanced"),
        "n_reuse", "n_fresh", F.round("__reuse", 3).alias("accuracy_reuse"), F.round("__fresh", 3).alias("accuracy_fresh"), "reuse_rate",
    )


def policy_answer(kind: Column, oracle: Column, policy: str) -> Column:
    """Answers that need no reasoning (always_yes, always_no), or the expected ones (oracle)."""
    if policy == "oracle":
        facts = F.array_join(F.transform(F.from_json(oracle, "array<string>"), lambda x: F.concat(x, F.lit("."))), "\n")
        first = F.get(F.from_json(oracle, "array<string>"), F.lit(0))
        return F.when(kind == "role", facts).when(kind == "fold", first).when(oracle == "true", "YES").when(oracle == "false", "NO").otherwise("")
    return F.lit({"always_yes": "YES", "always_no": "NO"}[policy])
