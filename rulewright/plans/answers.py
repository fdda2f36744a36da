"""Queries on rule lines, answers, logs and score cards: literal cases on every row of a table, against their expected rows."""

from __future__ import annotations

from pyspark.sql import functions as F

from rulewright.functions import atoms
from rulewright.plans._registry import query
from rulewright.plans.bank import dealt, dealt_oracle
from rulewright.plans.expected import EXPECTED

#: Rule lines, and lines that are none.
LINES = [
    "p(X) :- q(X), not r(X).", "fact(a).", "flag.", "bad line", "p(X) :- X = c.", "s(X,Y) :- t(X), Y > 3. % note", "Up(X) :- q(X).", "w(X) :- v( X ), u(X,b).",
    "m(X) :- n(Y), X = Y, Z != 2.", "k(X) :-", "p(X) :- becomes accepted because q(X)", "v(A,B) :- e(B,A), dom(A).", "  spaced( X )  :-  q( X ) .", "h(X) :- not g(X), X = Y, Y = d.",
]


def _expected(name: str, source: str, key: str, cases: list) -> str:
    columns, rows = EXPECTED[name]
    return dealt_oracle(source, key, len(cases), columns, rows)


@query("q37_rule_parse", _expected("q37_rule_parse", "documents", "doc_id", LINES))
def rule_parse(spark, d):
    """Grammar, parts, constants, predicates, groundness and unsafe variables of a rule line."""
    from rulewright.operators.rule_text import canonical_key, parse_rules, unsafe_variables

    got = canonical_key(parse_rules(dealt(spark, d, "documents", "doc_id", [(x,) for x in LINES], "line string"), "line"))
    got = got.withColumnRenamed("head", "__head").withColumnRenamed("body", "__body")
    head, body = F.col("__head"), F.col("__body")
    text = atoms.clause(head, body)
    only = lambda c: F.when(head.isNotNull(), c)
    return got.select(
        "id", head.isNotNull().alias("is_rule"), atoms.squeeze(head).alias("head"), only(F.size(body)).alias("n_body"), only(F.array_join(F.transform(body, atoms.squeeze), "|")).alias("body"), only(F.array_join(atoms.constants(text), ",")).alias("constants"),
        only(atoms.is_intensional(text)).alias("intensional"), only(atoms.is_ground(text)).alias("is_ground"), only(atoms.predicate(head)).alias("predicate"), only(F.array_join(unsafe_variables(head, body), ",")).alias("unsafe"), only(F.col("key")).alias("key"),
    )


_LOG_LINES = [
    "RoLe.", "role:", "Gen", "R1 p(X) :- X = a.", "R1: wrong", "fact p(X) :- X = a.", "R4? yes, removed.", "R4? NO", "R4? maybe", "already intensional.", "R2 candidates: [p(X) :- q(X).]", "R2 candidates: none.", "R2? [p(X) :- q(X).] no.",
    "R2? p(X) yes", "R2 p(X) :- q(X).", "R3 on [p(X) :- q(X).]", "R3 reuse: none.", "R3 reuse? [a(X)] yes.", "R3 failed: no reusable assumption works.", "R3 mint [a(X)]: no contrary facts.", "R3 p(X) :- q(X), a(X).", "a(X) defeated_by c_a(X)",
    "no option works.", "Done.", "1. **R4? yes**", "- step 3: R4? no", "I think R4? yes", "", "done", "r1 is also a predicate",
]


@query("q36_line_classifier", _expected("q36_line_classifier", "documents", "doc_id", _LOG_LINES))
def line_classifier(spark, d):
    from rulewright.operators.trace import classify_lines

    return classify_lines(dealt(spark, d, "documents", "doc_id", [(x,) for x in _LOG_LINES], "line string"), "line").select("id", "kind")


_GOOD = "NEW RULES:\nflies(X) :- bird(X), alpha_0(X).\nc_alpha_0(X) :- penguin(X).\n\nNEW ASSUMPTIONS:\nalpha_0(X) defeated_by c_alpha_0(X)"
#: Answers to the built-in problem on birds.
ANSWERS = [
    _GOOD,
    _GOOD.replace("alpha_0", "usual").replace("(X)", "(Bird)"),
    "```prolog\n" + _GOOD + "\n```",
    "NEW RULES:\nNONE\n\nNEW ASSUMPTIONS:\nNONE",
    "NEW RULES:\nflies(X) :- X = tweety.\nNEW ASSUMPTIONS:\nNONE",
    "NEW RULES:\nflies(tweety).\nNEW ASSUMPTIONS:\nNONE",
    "NEW RULES:\nflies(X) :- bird(X).\nNEW ASSUMPTIONS:\nNONE",
    "no idea, the birds fly -> they are birds",
    None,
    "NEW RULES:\nbird(X) :- penguin(X).\nflies(Y) :- bird(X).\nNEW ASSUMPTIONS:\nnormal_bird(X) defeated_by other(X)",
    "NEW RULES:\nflies(X) :- bird(X), normal_bird(X).\nab_bird(X) :- penguin(X).\nNEW ASSUMPTIONS:\nnormal_bird(X) defeated_by ab_bird(X)",
    "NEW RULES:\nx(X) :- bird(X).\nNEW ASSUMPTIONS:\nNONE\nOn reflection:\n" + _GOOD,
    _GOOD + "\n=== PROBLEM\nNEW RULES:\n<head> :- <body_atom_1>.\nNEW ASSUMPTIONS:\n<a> defeated_by <c>",
    "NEW RULES:\nNONE\nNEW ASSUMPTIONS:\nflies(X) :- bird(X), usual(X) defeated_by odd(X).\nodd(X) :- penguin(X).",
    "NEW RULES:\n1. flies(X) :- bird(X), usual(X). \\\n* odd(X) :- penguin(X).\nflies(X) :- it has wings\nNEW ASSUMPTIONS:\n- usual(X) defeated_by odd(X)",
    _GOOD + "\nflies(X) :- bird(X), never(X).\nnever(X) defeated_by bird(X)",
    "NEW RULES:\nNONE\nNEW ASSUMPTIONS:\nflies(tweety) defeated_by c_flies(tweety)",
    "NEW RULES:\nflies(X) :- bird(X), alpha_0(X), bird(Y).\nc_alpha_0(X) :- penguin(X).\nNEW ASSUMPTIONS:\nalpha_0(X) defeated_by c_alpha_0(X)",
]
_HARD = ["p(X,Y) :- q(X, Y), X — Y.", "p(X) :- q(X) , “r”(X).", "NEW RULES: p(X) :- q(X,a), r(X).", "new rules:\np(X) :- q(X) % why.\nNew Assumptions :\na(X), c(X)", "NEW ASSUMPTIONS:\na(X) defeated_by c(X)", "NEW RULES:\n\n\n\np(X) :- q(X).\n\\\nr(X).\\\nNEW ASSUMPTIONS:\nNone"]


@query("q89_answer_parser", _expected("q89_answer_parser", "documents", "doc_id", ANSWERS + _HARD))
def answer_parser(spark, d):
    """What is read of free-text answers: blocks, sections, misfiled rules, echoes, fences, and what had to be repaired."""
    from rulewright.operators.answers import parse_answers

    rows = dealt(spark, d, "documents", "doc_id", [(x,) for x in ANSWERS + _HARD], "raw string").select(F.col("id").cast("string").alias("answer_id"), "raw")
    got = parse_answers(rows)
    return got.select(F.col("answer_id").cast("int").alias("id"), "parsed", F.array_join("rules", " ").alias("rules"), F.array_join("assumptions", ", ").alias("assumptions"), F.array_join("repairs", "; ").alias("repairs"))


def _scored(spark, d):
    from rulewright.operators.scoring import score_answers
    from rulewright.sources.builtin import problems

    rows = dealt(spark, d, "documents", "doc_id", [(x,) for x in ANSWERS], "raw string").select(F.col("id").cast("string").alias("answer_id"), F.lit("flies").alias("problem_id"), "raw")
    return score_answers(rows, problems(spark))


@query("q90_score_cards", _expected("q90_score_cards", "documents", "doc_id", ANSWERS))
def score_cards(spark, d):
    return _scored(spark, d).select(
        F.col("answer_id").cast("int").alias("id"), "parsed", "well_formed", "valid", "stable", "intensional", "clean", "exact", F.round("agreement", 4).alias("agreement"), "n_ground", "n_self_defeating", "defeasible", "ref_defeasible",
        "r2_n", "r2_exact", "r2_over", "r2_under", "r2_other", F.array_join("violations", "; ").alias("violations"), "error", "reward",
    )


@query("q51_score_error_precedence", "SELECT c.id, c.error, c.reward FROM (" + _expected("q90_score_cards", "documents", "doc_id", ANSWERS) + ") c")
def score_error_precedence(spark, d):
    """Error label and reward of stored cards as columns, without scoring again."""
    from rulewright.operators.scoring import error_column, reward_column

    c = _scored(spark, d).withColumn("n_violations", F.coalesce(F.size("violations"), F.lit(0)))
    error = error_column(F.col("parsed"), F.col("n_violations"), F.col("valid"), F.col("intensional"), F.col("n_self_defeating"), F.col("n_illegal"))
    reward = reward_column(F.col("parsed"), F.col("n_violations"), F.col("valid"), F.col("intensional"), F.col("n_ground"), F.col("n_self_defeating"))
    return c.select(F.col("answer_id").cast("int").alias("id"), error.alias("error"), reward.alias("reward"))


@query("q10_violations", _expected("q10_violations", "documents", "doc_id", ANSWERS))
def violations(spark, d):
    """One row for each side condition that an answer breaks."""
    return _scored(spark, d).select(F.col("answer_id").cast("int").alias("id"), F.explode("violations").alias("violation"))


def _logs():
    from rulewright.operators.learner import solve
    from rulewright.operators.trace import target
    from rulewright.sources.builtin import BUILTIN

    out = []
    for name, make in BUILTIN.items():
        gold = target(solve(make()))
        lines = gold.split("\n")
        out += [
            (name, gold), (name, gold.replace("R4? no", "R4? yes", 1)), (name, "\n".join(x for x in lines if not x.startswith("R4?"))), (name, "\n".join(x for x in lines if not x.startswith("R2?"))),
            (name, gold.replace("RoLe.\n", "").replace("Gen.\n", "")), (name, "\n".join(lines[:8])), (name, gold.replace("R2? [", "R2? [x").replace("NEW RULES", "**NEW RULES")), (name, gold.split("\n\n", 1)[1]),
        ]
    return out


def _audits(spark, d):
    from rulewright.operators.trace import audit_logs
    from rulewright.sources.builtin import problems

    rows = dealt(spark, d, "supplier", "s_suppkey", _logs(), "problem_id string, raw string")
    return audit_logs(rows.select(F.col("id").cast("string").alias("answer_id"), "problem_id", "raw"), problems(spark))


@query("q56_audit_trace", _expected("q56_audit_trace", "supplier", "s_suppkey", range(24)))
def audit_trace(spark, d):
    """Logs with a flipped verdict, without their decisions, cut, or without headers, audited on the path they take."""
    r = lambda c: F.round(c, 4).alias(c)
    return _audits(spark, d).select(F.col("answer_id").cast("int").alias("id"), "problem_id", "n_decisions", r("accuracy"), r("written_accuracy"), "n_omitted", "n_illegal", "first_error", "gave_up", "answer_matches_trace", r("gold_prefix"))


@query(
    "q99_merged_audits",
    f"""SELECT problem_id, count(*) AS n, CAST(round(sum(accuracy * n_decisions)) AS BIGINT) AS "right", CAST(sum(n_decisions) AS BIGINT) AS decisions, round(sum(n_omitted)::DOUBLE / sum(n_decisions), 4) AS omitted_share,
    CAST(count(*) FILTER (WHERE n_illegal > 0) AS BIGINT) AS any_illegal, CAST(count(*) FILTER (WHERE gave_up > 0) AS BIGINT) AS halted, CAST(count(*) FILTER (WHERE answer_matches_trace) AS BIGINT) AS answer_matches,
    CAST(count(*) FILTER (WHERE accuracy = 1 AND n_illegal = 0 AND answer_matches_trace) AS BIGINT) AS faithful FROM ({_expected("q56_audit_trace", "supplier", "s_suppkey", range(24))}) a WHERE n_decisions IS NOT NULL GROUP BY problem_id""",
)
def merged_audits(spark, d):
    from rulewright.operators.trace_score import merged_audits as merge

    return merge(_audits(spark, d), ["problem_id"]).drop("accuracy", "written_accuracy")


@query("q108_audit_kinds", "SELECT problem_id, kind, CAST(sum(x.right) AS BIGINT) AS \"right\", CAST(sum(n) AS BIGINT) AS n, round(sum(x.right)::DOUBLE / sum(n), 4) AS accuracy FROM (" + _expected("q108_audit_kinds", "supplier", "s_suppkey", range(24)) + ") x GROUP BY problem_id, kind")
def audit_kinds(spark, d):
    from rulewright.operators.trace_score import by_kind

    return by_kind(_audits(spark, d), ["problem_id"])


PROSE = [
    "Add: flies(tweety) :- tweety = tweety.\nFold flies(X) :- X = tweety using bird(tweety) -> flies(X) :- bird(X).\nflies(X) :- bird(X), alpha(X). c_alpha(sam).\n" + _GOOD,
    _GOOD + "\n=== PROBLEM\nbird(tweety).\n## Reasoning\nflies(tweety).\nThen flies(X) :- bird(X), usual(X).",
    "violates [flies(sam)], so flies(sam) becomes accepted.",
    "",
    "flies(opus).\nflies(tweety).\nflies(X) :- bird(X).\nNEW RULES:\nflies(X) :- bird(X).\nNEW ASSUMPTIONS:\nNONE\nThat is all.",
]


@query("q109_prose_steps", _expected("q109_prose_steps", "documents", "doc_id", PROSE))
def prose_steps(spark, d):
    """Steps that prose takes, told by the shape of its rules, and how they compare with the learner's."""
    from rulewright.operators.explain import prose_scores
    from rulewright.sources.builtin import problems

    rows = dealt(spark, d, "documents", "doc_id", [(x,) for x in PROSE], "raw string").select(F.col("id").cast("string").alias("answer_id"), F.lit("flies").alias("problem_id"), "raw")
    r = lambda c: F.round(c, 4).alias(c)
    return prose_scores(rows, problems(spark)).select(F.col("answer_id").cast("int").alias("id"), "has_trace", "answer_first", F.array_join("steps", " | ").alias("steps"), r("precision"), r("recall"), r("f1"), r("align_exact"), r("r1_recall"), r("r4_recall"), "phase_order_ok")


@query("q13b_rescored", f"SELECT id, 'reward' AS field, CAST(reward AS VARCHAR) AS stored, CAST(reward + 1 AS VARCHAR) AS fresh FROM ({_expected('q90_score_cards', 'documents', 'doc_id', ANSWERS)}) c")
def rescored(spark, d):
    """Stored cards against fresh ones, one row for each field that differs."""
    from rulewright.operators.trace_score import rescored as differences

    now = _scored(spark, d).select("answer_id", "error", "reward", "valid")
    got = differences(now, now.withColumn("reward", F.col("reward") + 1), ["answer_id"], ["error", "reward", "valid"])
    return got.select(F.col("answer_id").cast("int").alias("id"), "field", "stored", "fresh")


@query(
    "q110_rescore_status",
    """SELECT status, count(*) AS n FROM (SELECT CASE WHEN doc_id % 5 = 4 THEN 'unknown' WHEN doc_id % 5 = 3 THEN 'changed problem' WHEN doc_id % 5 = 2 THEN 'changed prompt' ELSE 'same' END AS status FROM documents) x GROUP BY status""",
)
def rescore_status(spark, d):
    """Stored answers with their problem and prompt hashes against the problems as they are now; ids may have a suffix."""
    from rulewright.operators.trace_score import rescore_status as status
    from rulewright.sources.builtin import problems

    p = problems(spark)
    known = p.select(F.col("problem_id").alias("__p"), F.sha2("problem", 256).alias("h"))
    rows = dealt(spark, d, "documents", "doc_id", [("nixon_diamond", "nixon_diamond"), ("flies#a", "flies"), ("flies", "flies"), ("tax_law", "tax_law"), ("gone", None)], "problem_id string, own string")
    rows = rows.join(known, rows["own"] == known["__p"], "left").withColumn("problem_sha256", F.when(F.col("k") == 3, "other").otherwise(F.col("h")))
    rows = rows.withColumn("prompt_sha256", F.when(F.col("k") == 2, "other").otherwise(F.sha2(F.concat(F.lit("ask "), F.col("own")), 256)))
    return status(rows, p, F.concat(F.lit("ask "), F.col("problem_id")))
