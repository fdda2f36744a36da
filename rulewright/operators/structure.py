"""Structure of learnt frameworks, control checks, and crisp against graded outcomes of whole problems."""

from __future__ import annotations

import json
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rulewright.operators import corpus as build
from rulewright.operators.answers import parse_rule
from rulewright.operators.learner import Problem, path_events, rows_of_problems, solve
from rulewright.operators.reason import Checker, Framework, Rule, is_variable, parse, terms_of
from rulewright.operators.scoring import Reference, has_constant, is_comparison, is_guarded, predicate, reward, score
from rulewright.operators.trace import answer_of, target


def counts(fw: Framework, rules: list[Rule], background: Framework) -> dict[str, int | bool]:
    """Numbers of new rules, guarded rules and rules for exceptions, and whether the answer is defeasible, monotonic, intensional."""
    guarded = [r for r in rules if is_guarded(r, fw)]
    against = {parse(fw.contrary(a))[0] for a in fw.assumptions}
    new = [a for a in fw.assumptions if a not in background.assumptions]
    return {
        "n_new_rules": len(rules), "n_defeasible_rules": len(guarded), "n_contrary_rules": sum(parse(r.head)[0] in against for r in rules), "n_new_assumptions": len(new),
        "is_defeasible": bool(guarded), "is_monotonic": not guarded, "is_intensional": not any(has_constant(r) for r in rules), "depth": nesting(rules, {a: fw.contrary(a) for a in new}),
    }


def nesting(rules: list[Rule], new: dict[str, str]) -> int:
    """How deep exceptions to exceptions go among the new assumptions (with their contraries)."""
    heads = {parse(a)[0]: parse(c)[0] for a, c in new.items()}

    def depth(name: str, seen: frozenset[str]) -> int:
        if name in seen:
            return 0
        below = [depth(q, seen | {name}) for r in rules if parse(r.head)[0] == heads[name] for b in r.body if (q := predicate(b)) in heads]
        return 1 + max(below, default=0)

    return max((depth(q, frozenset()) for r in rules for b in r.body if (q := predicate(b)) in heads), default=0)


def shape(p: Problem) -> dict[str, int]:
    b = p.background
    preds = {parse(r.head)[0] for r in b.rules}
    return {"n_constants": len(p.domain), "n_facts": sum(not r.body for r in b.rules), "n_rules": sum(bool(r.body) for r in b.rules), "n_predicates": len(preds), "n_positive": len(p.positive), "n_negative": len(p.negative), "longest_body": max((len(r.body) for r in b.rules), default=0)}


def role_facts(text: str) -> list[tuple[str, str]]:
    """(predicate, constant) of the facts that a log starts from."""
    return re.findall(r"(?m)^\s*R1 (\w+)\(X\) :- X = (\w+)\.?\s*$", text.split("\nfact ")[0])


def four_way(p: Problem) -> bool:
    """The learner, the replay of its steps and events, the replay of its text and its answer agree, and these solve the problem."""
    got = solve(p)
    return got["success"] and build.disagreement(p, got) is None


def gold_failures(p: Problem, meta: dict | None = None) -> list[str]:
    """Instrument control: which fields of the cards of the learner's own log and answer are not at their best."""
    ref = Reference(p)
    if not ref.got["success"]:
        return ["unsolved"]
    out = []
    best = {"parsed": True, "well_formed": True, "valid": True, "intensional": True, "n_ground": 0, "n_self_defeating": 0, "clean": True, "exact": True, "error": "ok"}
    for name, text in (("log", target(ref.got)), ("answer", answer_of(ref.got))):
        card = score(p, text, ref, meta)
        out += [f"{name}: {k}" for k, v in best.items() if card[k] != v]
        out += [f"{name}: agreement"] * (card["agreement"] not in (None, 1.0)) + [f"{name}: defeasible"] * (card["defeasible"] != ref.defeasible) + [f"{name}: r2"] * (card["r2_exact"] != card["r2_n"])
        out += [f"{name}: choice"] * bool(meta and meta.get("answers") and not card["algorithm_choice"])
        if name == "log" and (card["audit_accuracy"] != 1.0 or card["n_illegal"] or not card["answer_matches_trace"]):
            out.append("log: audit")
        if name == "answer" and card["n_decisions"] is not None:
            out.append("answer: audit")
    facts = score(p, degenerate_answer(ref), ref, with_audit=False)
    if not facts["valid"] or reward(facts) >= reward(score(p, answer_of(ref.got), ref, with_audit=False)):
        out.append("facts alone are not rewarded less")
    return out


def gold_at_maximum(p: Problem) -> bool:
    return not gold_failures(p)


def degenerate_answer(ref: Reference) -> str:
    """The learnt facts as the whole answer: a solution that says nothing."""
    from rulewright.operators.answers import render_answer

    return render_answer([parse_rule(f) for f in ref.got["facts"]], {})


def positives_as_assumptions(p: Problem) -> str:
    """Every positive example declared an assumption: it solves the problem and is ill-formed."""
    from rulewright.operators.answers import render_answer

    return render_answer([], {a.replace(" ", ""): f"c_{a.replace(' ', '')}" for a in p.positive})


def constant_answers(rows: DataFrame) -> DataFrame:
    """(tier, class, target, n): the most frequent training answer of each tier and class, the first by text of equals."""
    n = rows.where("split = 'train'").groupBy("tier", "class", "target").agg(F.count(F.lit(1)).alias("n"))
    return n.groupBy("tier", "class").agg(F.min_by(F.struct("target", "n"), F.struct(-F.col("n"), "target")).alias("b")).select("tier", "class", "b.target", "b.n")


def untrainable(p: Problem) -> str | None:
    """Why a problem gives no training example, or None."""
    return build.untrainable(solve(p))


def unusable_rules(fw: Framework) -> list[str]:
    """Background rules that no fold can use: general rules without an equality to a constant, or with a head of another shape."""
    out = []
    for r in fw.rules:
        args = parse(r.head)[1]
        fact = not r.body and len(args) == 1 and not is_variable(args[0])
        bound = len(args) == 1 and any(is_comparison(b) and {args[0]} < set(terms_of(b)) for b in r.body)
        if not fact and not bound:
            out.append(r.text())
    return out


def minimal_supports(rules: list[tuple[str, frozenset[str]]], assumptions: list[str]) -> dict[str, set[frozenset[str]]]:
    """Subset-minimal sets of assumptions from which each atom follows, of one framework in memory."""
    family: dict[str, set[frozenset[str]]] = {a: {frozenset([a])} for a in assumptions}
    changed = True
    while changed:
        changed = False
        for head, body in rules:
            sets = {frozenset()}
            for b in body:
                sets = {x | y for x in sets for y in family.get(b, ())}
            have = family.setdefault(head, set())
            for s in sets:
                if not any(x <= s for x in have):
                    have -= {x for x in have if s < x}
                    have.add(s)
                    changed = True
    return family


def graded(p: Problem, rules: list[str], assumptions: list[str], contraries: dict[str, str], base: float = 0.5, rounds: int = 60) -> dict[str, float]:
    """Strength of each example under product DF-QuAD: minimal supports and strengths of one problem in memory."""
    from rulewright.functions import kernels
    from rulewright.operators.reason import ground

    fw = p.background.extended([parse_rule(r) for r in rules], assumptions, contraries)
    against = {}
    for a in fw.assumptions:
        pred, args = parse(a)
        c_pred, c_args = parse(fw.contrary(a))
        for c in p.domain:
            put = lambda ts: f"({c})" if ts else ""  # noqa: B023, E731
            against[f"{pred}{put(args)}"] = f"{c_pred}{put(c_args)}"
    family = minimal_supports([(g.head, g.needs) for g in ground(Framework(fw.rules, [], {}), p.domain)], list(against))
    value = dict.fromkeys(against, base)
    for _ in range(rounds):
        sets = lambda atom: [[value[m] for m in s] for s in family.get(atom, ()) if s != {atom}]  # noqa: B023, E731
        after = {a: kernels.plain("prod-dfquad", base, sets(c), sets(a)) for a, c in against.items()}
        moved = max((abs(after[a] - value[a]) for a in value), default=0.0)
        value = after
        if moved < 1e-4:
            break
    return {x: round(max((_product(value[m] for m in s) for s in family.get(x, ())), default=0.0), 4) for x in [*p.positive, *p.negative]}


def _product(values) -> float:
    out = 1.0
    for v in values:
        out *= v
    return out


COUNTS = "problem_id string, n_new_rules int, n_defeasible_rules int, n_contrary_rules int, n_new_assumptions int, is_defeasible boolean, is_monotonic boolean, is_intensional boolean, depth int, n_constants int, n_facts int, n_rules int, n_predicates int, n_positive int, n_negative int, longest_body int, symbols string, n_events int, n_abandoned int"


def structure_of(problems: DataFrame) -> DataFrame:
    """One row for each solved problem: its shape, and the structure of its solution."""

    def rows(pid: str, p: Problem):
        got = solve(p)
        if got["success"]:
            ref = Reference(p, got)
            c, s = counts(ref.fw, ref.rules, p.background), shape(p)
            yield (pid, *c.values(), *s.values(), ",".join(x["kind"] for x in got["steps"]), len(path_events(got)), len(got["events"]) - len(path_events(got)))

    return rows_of_problems(problems, rows, COUNTS)


CONTROL = "problem_id string, four_way boolean, at_maximum boolean, failures string, invariant boolean, untrainable string"


def controls(problems: DataFrame) -> DataFrame:
    """One row of instrument controls for each problem."""
    from rulewright.operators.rename import invariant

    def rows(pid: str, p: Problem):
        bad = gold_failures(p)
        yield (pid, four_way(p), not bad, "; ".join(bad), invariant(p), untrainable(p))

    return rows_of_problems(problems, rows, CONTROL)


REPORT = "problem_id string, atom string, label string, crisp string, strength double, agree boolean"


def crisp_against_graded(problems: DataFrame, threshold: float = 0.5) -> DataFrame:
    """For each example of each problem: status in the learnt framework, graded strength, and whether they agree at the threshold."""

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for pid, text in zip(batch["problem_id"], batch["problem"], strict=True):
                p = Problem.of(json.loads(text))
                got = solve(p)
                fw = p.background.extended([parse_rule(r) for r in got["rules"]], got["assumptions"], got["contraries"])
                atoms = [*p.positive, *p.negative]
                status = Checker(fw, p.domain).status([], [], atoms)
                strength = graded(p, got["rules"], got["assumptions"], got["contraries"])
                label = ["pos"] * len(p.positive) + ["neg"] * len(p.negative)
                rows += [(pid, a, x, status[a], strength[a], (status[a] != "NEVER") == (strength[a] >= threshold)) for a, x in zip(atoms, label, strict=True)]
            yield pd.DataFrame(rows, columns=[c.split()[0] for c in REPORT.split(", ")])

    return problems.select("problem_id", "problem").mapInPandas(work, REPORT)


def prompt_rows(corpus: DataFrame) -> DataFrame:
    """corpus with prompt, trace_target, endpoint_target and ceiling (what a perfect copy of the log would score)."""
    from rulewright.operators.answers import question
    from rulewright.operators.trace_score import ceiling

    def rows(pid: str, p: Problem):
        got = solve(p)
        if got["success"]:
            yield (pid, question(p.positive, p.negative, p.background, p.learnable, "target", p.domain), target(got), answer_of(got), json.dumps(ceiling(got, p)))

    own = rows_of_problems(corpus, rows, "problem_id string, prompt string, trace_target string, endpoint_target string, ceiling string")
    return corpus.join(own, "problem_id")


def write_corpus(corpus: DataFrame, path: str, rejects: DataFrame | None = None) -> dict[str, int]:
    """A folder for each file of a corpus, and the number of rows of each.

    problems, traces, sft_trace and sft_endpoint (train and val), eval (the rest) and rejects. A structure in two splits, or
    an evaluated problem among the training rows, is refused before anything is written.
    """
    if not corpus.groupBy("signature").agg(F.countDistinct("split").alias("n")).where("n > 1").isEmpty():
        raise ValueError("a structure is in two splits")
    if not corpus.groupBy("problem_id").agg(F.countDistinct("split").alias("n")).where("n > 1").isEmpty():
        raise ValueError("a problem is in two splits")
    rows = prompt_rows(corpus.select("problem_id", "tier", "split", "class", "seed", "signature", "problem", "name_map", "meta", "solution"))
    train = F.col("split").isin("train", "val")
    base = ["problem_id", "tier", "split", "class", "prompt"]
    files = {
        "problems": rows.select("problem_id", "tier", "split", "class", "seed", "signature", "problem", "name_map", "meta"), "traces": rows.select("problem_id", "split", "solution"),
        "sft_trace": rows.where(train).select(*base, F.col("trace_target").alias("target")), "sft_endpoint": rows.where(train).select(*base, F.col("endpoint_target").alias("target")),
        "eval": rows.where(~train).select(*base, "trace_target", "endpoint_target", "ceiling"),
    }
    if rejects is not None:
        files["rejects"] = rejects.select("tier", "class", "seed", F.col("verdict").alias("reason"))
    for name, df in files.items():
        df.write.mode("overwrite").json(f"{path}/{name}.jsonl")
    spark = corpus.sparkSession
    return {name: spark.read.schema(df.schema).json(f"{path}/{name}.jsonl").count() for name, df in files.items()}


def enriched(answers: DataFrame, problems: DataFrame) -> DataFrame:
    """answers (answer_id, problem_id, raw) that parse, with the structure of each: counts, flags and depth."""
    from rulewright.operators.answers import apply_answer, parse_answer

    schema = "answer_id string, problem_id string, " + COUNTS.split(", ", 1)[1].split(", n_constants")[0]
    names = [c.split()[0] for c in schema.split(", ")]

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for aid, pid, raw, text in zip(batch["answer_id"], batch["problem_id"], batch["raw"], batch["problem"], strict=True):
                p = Problem.of(json.loads(text))
                answer = parse_answer(raw) if isinstance(raw, str) else None
                if answer:
                    fw, _ = apply_answer(p.background, answer)
                    rows.append((aid, pid, *counts(fw, answer.rules, p.background).values()))
            yield pd.DataFrame(rows, columns=names, dtype=object)

    return answers.join(problems, "problem_id").select("answer_id", "problem_id", "raw", "problem").mapInPandas(work, schema)


def assembled(symbolic: DataFrame, samples: DataFrame, graded_rows: DataFrame) -> DataFrame:
    """Symbolic answers and every parsed sample as one table with the graded rows of their problem; symbolic ones first."""
    both = symbolic.withColumn("mode", F.lit("symbolic")).withColumn("sample_idx", F.lit(0)).unionByName(samples.where("parsed"), allowMissingColumns=True)
    out = both.join(graded_rows, "problem_id", "left")
    return out.orderBy(F.col("mode") != "symbolic", "mode", "problem_id", "sample_idx")
