import pytest
from pyspark.sql import functions as F

from rulewright.operators import corpus, scoring, structure
from rulewright.operators.learner import solve
from rulewright.operators.trace import render
from rulewright.sources import jsonl
from rulewright.sources.builtin import birds, diamond, problems, tax


def test_controls_on_builtins():
    for p in (diamond(), birds(), tax()):
        assert structure.four_way(p) and structure.gold_at_maximum(p) and structure.untrainable(p) is None
        assert scoring.score(p, structure.positives_as_assumptions(p))["error"] == "illformed"


def test_counts_and_shapes():
    ref = scoring.Reference(tax())
    c = structure.counts(ref.fw, ref.rules, tax().background)
    assert c["n_new_rules"] == 4 and c["is_defeasible"] and c["is_intensional"] and c["depth"] == 2
    s = structure.shape(diamond())
    assert s["n_constants"] == 5 and s["n_facts"] == 7 and s["n_rules"] == 4 and s["longest_body"] == 2
    assert structure.role_facts(render(solve(diamond()))) == [("pacifist", "c"), ("abnormal_quaker", "b")]
    assert structure.unusable_rules(diamond().background) == ["democrat(X) :- person(X), votes_dem(X).", "republican(X) :- person(X), votes_rep(X).", "pacifist(X) :- quaker(X), normal_quaker(X).", "person(X) :- dom(X)."]


def test_graded_value_of_the_solved_diamond():
    got = solve(diamond())
    assert abs(structure.graded(diamond(), got["rules"], got["assumptions"], got["contraries"])["pacifist(a)"] - 0.3333) < 2e-3


def test_crisp_against_graded(spark):
    rows = structure.crisp_against_graded(problems(spark)).collect()
    assert len(rows) == 11 and all(0 <= r["strength"] <= 1 for r in rows)
    assert {r["crisp"] for r in rows if r["label"] == "pos"} <= {"ALWAYS", "FREE"}


def test_corpus_files(spark, tmp_path):
    tried = corpus.attempts(spark, ["t2_noise", "t9_reuse"], 6).cache()
    built = corpus.splits(tried, {"test": 1, "train": 2}, held_out=2).cache()
    n = structure.write_corpus(built, f"file://{tmp_path}/c", corpus.judged(tried).where("verdict <> 'accepted'"))
    assert n["problems"] == n["traces"] == built.count() and n["sft_trace"] == n["sft_endpoint"] == built.where("split = 'train'").count() and n["eval"] == n["problems"] - n["sft_trace"]
    rows = spark.read.json(f"file://{tmp_path}/c/sft_trace.jsonl")
    assert set(rows.columns) == {"problem_id", "tier", "split", "class", "prompt", "target"}
    assert structure.constant_answers(rows).count() == rows.select("tier", "class").distinct().count()
    text = jsonl.manifest(built, corpus.gates(built), tried, jsonl.checksums(spark, f"file://{tmp_path}/c/eval.jsonl")).first()
    assert '"symbol":"R1"' in text["symbols"] and '"unique_ids":true' in text["gates"] and text["files"].startswith("[")
    assert "| tier |" in jsonl.report("build", {"tallies": corpus.tallies(tried)}, ["a note"])
    leak = built.unionByName(built.limit(1).withColumn("split", F.lit("val")).withColumn("problem_id", F.lit("other")))
    with pytest.raises(ValueError):
        structure.write_corpus(leak, f"file://{tmp_path}/d")


def test_assembled(spark):
    sym = spark.createDataFrame([("a", "r")], "problem_id string, rules string")
    samples = spark.createDataFrame([("a", "direct", 1, True, "x"), ("a", "direct", 0, False, "y")], "problem_id string, mode string, sample_idx int, parsed boolean, rules string")
    out = structure.assembled(sym, samples, spark.createDataFrame([("a", 0.5)], "problem_id string, strength double")).collect()
    assert [(r["mode"], r["sample_idx"], r["strength"]) for r in out] == [("symbolic", 0, 0.5), ("direct", 1, 0.5)]
