from pyspark.sql import functions as F

from rulewright.functions import kernels
from rulewright.operators import explain, gradual, probes, steps
from rulewright.operators.learner import solve
from rulewright.sources.builtin import birds, diamond, problems, tax


def test_recorder_is_a_spectator():
    for p in (diamond(), birds(), tax()):
        rows = steps.harvest_problem(p)
        assert solve(p)["rules"] and [r["k"] for r in rows] == list(range(len(rows)))
        n, first = steps.course_length(p)
        assert n == sum(not r["extra"] for r in rows) and first == next(r["verdict"] for r in rows if r["first"])
        for r in rows:  # every target reads back as the answer
            if r["kind"] != "role" or r["answer"] is not None:
                said, notes = steps.read_answer(r["kind"], r["target"], p, r["answer"], r["ask"].state)
                assert steps.same_answer(r["kind"], said, r["answer"]) and not notes["illegal"]


def test_gold_answers_are_right_and_policies_are_not(spark):
    p = problems(spark)
    rows = steps.harvest(p).join(p, "problem_id").cache()
    gold = steps.judge(rows, rows.select("problem_id", "k", F.col("target").alias("raw")))
    assert gold.where("NOT correct OR error IS NOT NULL OR NOT on_path OR NOT coalesce(witness_correct, true)").count() == 0
    stats = {r["kind"]: r for r in steps.run_stats(steps.judge(rows, steps.baseline_answers(rows, "always_no"))).collect()}
    assert stats["role"]["first_errors"] == 3 and stats["subsume"]["accuracy"] > 0.5 and stats["check"]["balanced"] == 0.5
    votes = steps.majority_verdicts(rows.withColumn("tier", F.lit("t")))
    based = steps.with_baseline(rows.withColumn("tier", F.lit("u")), votes)
    assert based.where("kind = 'check' AND first AND baseline").count() == 0 and based.count() == rows.count()


def test_probes():
    for p in (diamond(), birds(), tax()):
        made = probes.probes(p, "x")
        assert [m.probe_id for m in made] == [m.probe_id for m in probes.probes(p, "x")] and {m.kind for m in made} == set(probes.PROBE_KINDS)
        for m in made:
            text = "\n".join(f"{f}." for f in m.oracle) if m.kind == "role" else m.oracle[0] if m.kind == "fold" else "YES" if m.oracle else "NO"
            if m.kind in ("role", "fold", "subsume"):
                assert probes.score_probe(m, text, p)[:2] == (True, 1.0)
            if m.kind == "check":
                text = "YES" if m.oracle else "NO\n" + "\n".join(probes.failing_alone(m, p))
                assert probes.score_probe(m, text, p)[:2] == (True, 1.0)
            assert not probes.score_probe(m, "", p)[0] or (m.kind == "role" and not m.oracle)
    intro = next(m for m in probes.probes(birds(), "x") if m.kind == "introduce" and m.fold == "flies(X) :- bird(X).")
    good = "RULE: flies(X) :- bird(X), odd(X).\nASSUMPTION: odd(X) defeated_by c_odd(X).\nCONTRARY: c_odd(X) :- penguin(X)."
    assert probes.score_probe(intro, good, birds())[0] and "available=fresh" in probes.score_probe(intro, good, birds())[2]
    assert probes.score_probe(intro, good.replace("c_odd", "ab_bird"), birds())[0] is False
    block = "NEW RULES:\nflies(X) :- bird(X), odd(X).\nNEW ASSUMPTIONS:\nodd(X) defeated_by c_odd(X)"
    assert probes.score_probe(intro, block, birds())[0]


def test_explanations(spark):
    assert "flies" in explain.narrative(birds(), solve(birds()))
    got = {(r["problem_id"], r["atom"]): r["status"] for r in explain.example_outcomes(problems(spark)).collect()}
    assert got[("flies", "flies(tweety)")] == "ALWAYS" and got[("flies", "flies(sam)")] == "NEVER"


def test_contest_moves_in_the_right_direction(spark):
    bases = spark.createDataFrame([("x", 0.5), ("y", 0.5)], "asm string, base double")
    edges = spark.createDataFrame([("x", "attack", 0, "y"), ("y", "attack", 0, "x")], "target string, polarity string, edge_id int, member string")
    got = {r["asm"]: r["moved"] for r in gradual.contested(bases, edges, "x", 0.9, rounds=8).collect()}
    assert got == {"x": 1, "y": -1}
    tree = gradual.argument_tree(spark.createDataFrame([("x",)], "asm string"), edges.select("target", "polarity", "member"), 3)
    assert sorted(r["node_id"] for r in tree.collect()) == ["x", "x/a:y"]
    given = gradual.base_scores(bases.select("asm"), spark.createDataFrame([("x", 0.0)], "asm string, score double"), spark.createDataFrame([], "pred string, score double"), spark.createDataFrame([("y",)], "asm string"))
    assert {r["asm"]: r["base"] for r in given.collect()} == {"x": 0.0, "y": 0.0}


def test_convergence_agrees_with_the_joins(spark):
    """Rounds counted in memory against those of the DataFrame operator, and one plain update of every kernel."""
    fws = gradual.random_frameworks(spark, 2, seed=5)
    steps_of = {(r["fw"], r["kernel"], r["init"]): r["steps"] for r in gradual.convergence(fws, inits=(0.9,)).collect()}
    for fw in (0, 1):
        own = fws.where(F.col("fw") == fw)
        rules = own.where("kind = 'rule'").select("head", "body")
        asms = own.where("kind = 'contrary'").select(F.col("head").alias("asm"), F.get("body", F.lit(0)).alias("contrary"), F.lit(0.9).alias("base"))
        g = gradual.Gradual(rules, asms)
        n = steps_of[(fw, "prod-dfquad", 0.9)]
        plain = {r["asm"]: r["value"] for r in gradual.strengths(asms.select("asm", "base"), g.edges, rounds=n).collect()}
        assert {r["asm"]: r["value"] for r in g.strengths().collect()} == plain
        assert g.claims().where("strongest > 1 OR strongest < weakest").count() == 0
    assert kernels.plain("prod-dfquad", 0.5, [[1.0]], []) == 0.0 and kernels.plain("min-dfquad", 0.5, [], [[0.2, 0.4]]) == 0.6
    assert abs(kernels.plain("prod-qe", 0.5, [], [[1.0]]) - 0.75) < 1e-12
