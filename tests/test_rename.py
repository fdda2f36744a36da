import json

from rulewright.operators import rename, trace, trace_score
from rulewright.operators.learner import Problem, solve
from rulewright.sources.builtin import birds, diamond, problems, tax


def test_anonymise_round_trip_and_invariance():
    for p in (diamond(), birds(), tax()):
        other, names = rename.anonymised(p)
        assert len(set(names.values())) == len(names)
        assert rename.restored(other, names).to_dict() == p.to_dict()
        assert rename.invariant(p)
    assert rename.renamed_rule("bird(X) :- birds(X), X = a.", {"bird": "p", "a": "b"}) == "p(X) :- birds(X), X = b."


def test_derangement_and_permuted_problems(spark):
    d = rename.derangement(list("abcdef"), 3)
    assert sorted(d.values()) == list("abcdef") and all(k != v for k, v in d.items())
    assert rename.derangement(["a"], 1) == {"a": "a"}
    got = {r["problem_id"]: Problem.of(json.loads(r["problem"])) for r in rename.permuted(problems(spark)).collect()}
    assert got["flies"].to_dict() != birds().to_dict() and len(got["flies"].background.rules) == 5


def test_trace_scores():
    p = diamond()
    got = solve(p)
    gold = trace_score.recorded_steps(got, p)
    assert [s for s, _ in gold] == ["R1", "R1", "R2", "R2", "R3", "R1", "R2", "R3"]
    same = trace_score.compare_steps(gold, gold)
    assert same["f1"] == 1.0 and same["align_exact"] == 1.0 and same["phase_order_ok"]
    said, info = trace_score.prose_steps(trace.target(got), p)
    assert info["has_trace"] and not info["answer_first"] and trace_score.compare_steps(said, gold)["f1"] == 1.0
    assert trace_score.ceiling(got, p)["r4_recall"] is None
    assert trace_score.compare_steps([], gold)["f1"] == 0.0 and trace_score.compare_steps([], [])["align_exact"] == 1.0
    assert not trace_score.compare_steps([("R2", "x"), ("R1", "y")], gold)["phase_order_ok"]


def test_merged_audits_and_rescoring(spark):
    log = trace.target(solve(birds()))
    logs = spark.createDataFrame([("a", "flies", log), ("b", "flies", log.replace("R4? no", "R4? yes", 1)), ("c", "flies", "no log")], "answer_id string, problem_id string, raw string")
    audits = trace.audit_logs(logs, problems(spark)).cache()
    row = trace_score.merged_audits(audits, ["problem_id"]).first()
    assert row["n"] == 2 and row["faithful"] == 1 and 0 < row["accuracy"] < 1 and row["any_illegal"] == 1
    kinds = {r["kind"]: r for r in trace_score.by_kind(audits.where("answer_id = 'a'"), ["answer_id"]).collect()}
    assert kinds["subsume"]["accuracy"] == 1.0
    balanced = {r["kind"]: r["balanced"] for r in trace_score.confusion(audits, ["problem_id"]).collect()}
    assert 0.5 <= balanced["subsume"] <= 1.0
    diff = trace_score.rescored(audits, audits.where("answer_id = 'a'").selectExpr("answer_id", "accuracy - 0.5 AS accuracy", "n_omitted"), ["answer_id"], ["accuracy", "n_omitted"]).collect()
    assert [(r["answer_id"], r["field"]) for r in diff] == [("a", "accuracy")]
