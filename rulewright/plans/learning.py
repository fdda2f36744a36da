"""Queries that run the learner, its recorder, the controller, probes and generated corpora over problems dealt to a table."""

from __future__ import annotations

from pyspark.sql import functions as F

from rulewright.plans._registry import query
from rulewright.plans.bank import by_id, dealt_oracle, narrow, problem_cases, problems, values
from rulewright.plans.expected import EXPECTED

N = len(problem_cases())


def _expected(name: str, source: str = "nation", key: str = "n_nationkey", n: int = N) -> str:
    columns, rows = EXPECTED[name]
    return dealt_oracle(source, key, n, columns, rows)


def _rows(name: str) -> str:
    """Expected rows as they are."""
    columns, rows = EXPECTED[name]
    return values(columns, rows)


@query("q54_learner_on_builtins", _expected("q54_learner_on_builtins", "supplier", "s_suppkey"))
def learner_on_builtins(spark, d):
    """A problem for each supplier: success, symbols of the steps, rules and assumptions."""
    from rulewright.operators.learner import solve_all

    out = solve_all(problems(spark, d, "supplier", "s_suppkey"))
    return by_id(out, "bigint").select("id", "success", "n_steps", F.array_join("symbols", ",").alias("symbols"), F.array_join("rules", " ").alias("rules"), F.array_join("assumptions", ",").alias("assumptions"), "n_backtracks", "budget_exceeded", "error")


@query("q111_course_events", _expected("q111_course_events", "supplier", "s_suppkey"))
def course_events(spark, d):
    """The recorder's events: what became of each fact, abandoned branches too."""
    from rulewright.operators.learner import events_of

    return by_id(events_of(problems(spark, d, "supplier", "s_suppkey")), "bigint").select("id", "event_id", "idx", "input_rule", "outcome", "abandoned", "chosen_rank", "guarded_rule", F.array_join("contrary_facts", " ").alias("contrary_facts"), "n_candidates", "n_attempts")


@query("q55_replay", _expected("q55_replay", "supplier", "s_suppkey"))
def replay_logs(spark, d):
    """Logs replayed from their text."""
    from rulewright.operators.trace import replays

    return by_id(replays(problems(spark, d, "supplier", "s_suppkey")), "bigint").select("id", "n_lines", F.array_join("rules", " ").alias("rules"), F.array_join("assumptions", ", ").alias("assumptions"), "same")


@query("q92_decision_rows", _expected("q92_decision_rows"))
def decision_rows(spark, d):
    """Every decision of the course and the tests it skips: place, verdict, examples that fail, and target."""
    from rulewright.operators.steps import harvest

    return by_id(harvest(problems(spark, d))).select("id", "k", "kind", "event", "src", "rank", "first", "extra", "cell", "verdict", F.array_join("witness", " ").alias("witness"), "target")


@query(
    "q85_decision_cell",
    "SELECT cell, count(*) AS n FROM (" + _expected("q92_decision_rows") + ") x GROUP BY cell",
)
def decision_cells(spark, d):
    """Cells of decisions as columns, without running the learner's own labels."""
    from rulewright.operators.steps import cell, harvest

    rows = harvest(problems(spark, d))
    return rows.groupBy(cell(F.col("kind"), F.col("src"), F.col("event"), F.col("rank"), F.col("first"), F.col("extra")).alias("cell")).agg(F.count(F.lit(1)).alias("n"))


@query("q08_fact_subsumption", "SELECT id, k, verdict AS removable FROM (" + _expected("q92_decision_rows") + ") x WHERE kind = 'subsume'")
def fact_subsumption(spark, d):
    """Whether the examples hold without a learnt fact, for each fact that the course meets."""
    from rulewright.operators.steps import harvest

    return by_id(harvest(problems(spark, d)).where("kind = 'subsume'")).select("id", "k", F.col("verdict").alias("removable"))


@query("q93_policy_run_stats", _rows("q93_policy_run_stats"))
def policy_run_stats(spark, d):
    """Stored answers of a policy that always says no, judged call by call and summed up by kind."""
    from rulewright.operators.steps import baseline_answers, harvest, judge, run_stats

    p = problems(spark, d)
    steps = harvest(p).join(p, "problem_id")
    return narrow(run_stats(judge(steps, baseline_answers(steps, "always_no"))))


@query("q100_controlled_runs", _expected("q100_controlled_runs"))
def controlled_runs(spark, d):
    """The course on outside answers: the learner's own, and a policy that says yes to every test."""
    from rulewright.operators.steps import DECISIONS, controlled_runs as runs

    p = problems(spark, d)
    got = runs(p, "reference").unionByName(runs(p, "always_yes", DECISIONS)).unionByName(runs(p, "empty"))
    return by_id(got).select("id", "policy", "error", "n_calls", "gold_steps", "first_truth", "first_said", "first_on_path", "gold_first", "any_illegal", "has_text", "retractions")


@query("q33b_first_checks", """SELECT policy, count(*) AS n, CAST(count(*) FILTER (WHERE first_truth IS NOT NULL) AS BIGINT) AS reached, CAST(count(*) FILTER (WHERE first_on_path) AS BIGINT) AS at_reference_state,
    round(avg(CASE WHEN coalesce(first_truth, gold_first) IS NULL THEN NULL WHEN first_truth IS NOT NULL AND first_said = first_truth THEN 1.0::DOUBLE ELSE 0.0 END), 4) AS accuracy,
    round((sum(CASE WHEN t AND s THEN 1.0::DOUBLE WHEN t THEN 0.0 END) / nullif(sum(CASE WHEN t THEN 1.0::DOUBLE END), 0) + sum(CASE WHEN NOT t AND NOT s THEN 1.0::DOUBLE WHEN NOT t THEN 0.0 END) / nullif(sum(CASE WHEN NOT t THEN 1.0::DOUBLE END), 0)) / 2, 4) AS balanced,
    round((sum(CASE WHEN first_truth AND s THEN 1.0::DOUBLE WHEN first_truth THEN 0.0 END) / nullif(sum(CASE WHEN first_truth THEN 1.0::DOUBLE END), 0) + sum(CASE WHEN NOT first_truth AND NOT s THEN 1.0::DOUBLE WHEN NOT first_truth THEN 0.0 END) / nullif(sum(CASE WHEN NOT first_truth THEN 1.0::DOUBLE END), 0)) / 2, 4) AS balanced_reached
    FROM (SELECT *, coalesce(first_truth, gold_first) AS t, CASE WHEN first_truth IS NOT NULL THEN first_said END AS s FROM (""" + _expected("q100_controlled_runs") + ") y) x GROUP BY policy")
def first_checks(spark, d):
    from rulewright.operators.summaries import first_checks as summary

    return summary(controlled_runs(spark, d), ["policy"])


@query("q74_run_stops", "SELECT policy, count(*) AS n, CAST(count(error) AS BIGINT) AS stopped, round(avg(CAST(has_text AS INT)), 4) AS exact, round(avg(CAST(has_text AND NOT any_illegal AS INT)), 4) AS strict_exact, round(avg(n_calls), 2) AS calls_mean, round(avg(gold_steps), 2) AS reference_steps_mean FROM (" + _expected("q100_controlled_runs") + ") x GROUP BY policy")
def run_stops(spark, d):
    from rulewright.operators.summaries import run_summary

    return run_summary(controlled_runs(spark, d).withColumn("exact", F.col("has_text")), ["policy"])


@query("q112_replayed_calls", "SELECT id, CAST(n_calls AS INT) AS n_calls, error, true AS same FROM (" + _expected("q100_controlled_runs") + ") x WHERE policy = 'reference'")
def replayed_calls(spark, d):
    """Recorded calls run again, question for question."""
    from rulewright.operators.steps import controlled_calls, replayed

    p = problems(spark, d)
    return by_id(replayed(p, controlled_calls(p, "reference")))


@query("q101_probes", _expected("q101_probes"))
def probes(spark, d):
    """Probes from the states that the course visits."""
    from rulewright.operators.probes import probe_rows

    got = probe_rows(problems(spark, d))
    return by_id(got).groupBy("id", "kind").agg(F.count(F.lit(1)).cast("int").alias("n"), F.sum(F.col("oracle_bool").cast("int")).cast("int").alias("n_yes"))


@query("q102_probe_aggregate", _rows("q102_probe_aggregate"))
def probe_aggregate(spark, d):
    """Probe answers of two policies scored and summed up by kind."""
    from rulewright.operators.probes import aggregate, policy_answer, probe_rows, score_probes

    p = problems(spark, d)
    rows = probe_rows(p)
    out = None
    for name in ("always_yes", "oracle"):
        part = aggregate(score_probes(rows.withColumn("raw", policy_answer(F.col("kind"), F.col("oracle"), name)), p)).withColumn("policy", F.lit(name))
        out = part if out is None else out.unionByName(part)
    return narrow(out)


TIERS = ("t1_base", "t4_nested", "t5_twopath", "t8_decoy", "t9_reuse")


def _corpus(spark, n: int = 6):
    from rulewright.operators import corpus

    return corpus.attempts(spark, list(TIERS), n)


@query("q91_corpus_build", _rows("q91_corpus_build"))
def corpus_build(spark, d):
    """Generated problems filled into splits by tier and class, with structural duplicates rejected."""
    from rulewright.operators import corpus

    return corpus.splits(_corpus(spark), {"test": 1, "val": 1, "train": 2}, held_out=2).groupBy("tier", "class", "split").agg(F.count(F.lit(1)).cast("int").alias("n"))


@query("q72_gate_report", "SELECT true AS unique_ids, true AS unique_signatures, true AS no_leak, true AS evaluation_apart, true AS both_classes")
def gate_report(spark, d):
    from rulewright.operators import corpus

    return corpus.gates(corpus.splits(_corpus(spark), {"test": 1, "val": 1, "train": 2}, held_out=2))


@query("q73_attempt_verdict", _rows("q73_attempt_verdict"))
def attempt_verdict(spark, d):
    """Attempts, accepted ones and rejects by tier and class."""
    from rulewright.operators import corpus

    return narrow(corpus.tallies(_corpus(spark)))


@query("q103_step_gates", "SELECT true AS every_problem, true AS unique_rows, true AS targets_read, true AS verdicts_agree, true AS prompts_apart, true AS extra_in_train, true AS both_verdicts")
def step_gates(spark, d):
    """Gates of the decision rows of a generated corpus."""
    from rulewright.operators import corpus

    built = corpus.splits(_corpus(spark, 4), {"test": 1, "val": 1, "train": 2}, held_out=1)
    return corpus.step_gates(corpus.step_corpus(built), built)


@query("q86_surface_cues", _rows("q86_surface_cues"))
def surface_cues(spark, d):
    """How well surface cues tell the classes of a generated corpus apart; the semantic test does so."""
    from rulewright.operators import corpus

    tried = corpus.attempts(spark, ["t1_base", "t2_noise"], 8)
    return narrow(corpus.cue_table(tried.where("verdict = 'accepted'")))


@query("q94_example_outcomes", _expected("q94_example_outcomes"))
def example_outcomes(spark, d):
    from rulewright.operators.explain import example_outcomes as outcomes

    return by_id(outcomes(problems(spark, d))).select("id", "atom", "label", "status", "narrative")


@query("q104_structure", _expected("q104_structure"))
def structure(spark, d):
    """Shapes of problems and structures of their solutions."""
    from rulewright.operators.structure import structure_of

    return by_id(structure_of(problems(spark, d)))


@query("q105_controls", _expected("q105_controls"))
def controls(spark, d):
    """Instrument controls: four derivations agree, the learner's own texts score best, names do not matter."""
    from rulewright.operators.structure import controls as rows

    return by_id(rows(problems(spark, d)))


@query("q106_first_unseen", _expected("q106_first_unseen"))
def first_unseen(spark, d):
    """The first decision of each log that no log of the first built-in problem takes."""
    from rulewright.operators.summaries import first_unseen as unseen
    from rulewright.operators.trace import signatures_of

    rows = signatures_of(problems(spark, d))
    return by_id(unseen(rows, rows.where("problem_id = '0'"), ["problem_id"], "line", "signature"))


@query("q09_off_example_atoms", _expected("q09_off_example_atoms"))
def off_example_atoms(spark, d):
    """Atoms of the example predicates over the domain that are no examples, with their status in the learnt framework."""
    from rulewright.operators.explain import off_example_status

    return by_id(off_example_status(problems(spark, d)))


@query("q97_crisp_against_graded", _expected("q97_crisp_against_graded"))
def crisp_against_graded(spark, d):
    from rulewright.operators.structure import crisp_against_graded as compare

    return by_id(compare(problems(spark, d)))


@query("q67_graded_agreement", "SELECT label, count(*) AS n, CAST(count(*) FILTER (WHERE agree) AS BIGINT) AS agree, round(avg(CAST(agree AS INT)), 4) AS share FROM (" + _expected("q97_crisp_against_graded") + ") x GROUP BY label")
def graded_agreement(spark, d):
    from rulewright.operators.summaries import graded_agreement as totals

    return totals(crisp_against_graded(spark, d), ["label"])


@query("q98_permuted_problems", _expected("q98_permuted_problems"))
def permuted_problems(spark, d):
    """Whether the learner takes the same course on problems whose predicates are deranged."""
    from rulewright.operators.learner import solve_all
    from rulewright.operators.rename import permuted

    p = problems(spark, d)
    a = solve_all(p).select("problem_id", F.array_join("symbols", ",").alias("symbols"))
    b = solve_all(permuted(p)).select("problem_id", F.array_join("symbols", ",").alias("permuted_symbols"))
    return by_id(a.join(b, "problem_id").withColumn("same", F.col("symbols") == F.col("permuted_symbols")))


@query("q95_convergence", _rows("q95_convergence"))
def convergence(spark, d):
    """How many random frameworks converge, and in how many rounds, for each kernel and base score."""
    from rulewright.operators.gradual import convergence as run, convergence_rates, random_frameworks

    return narrow(convergence_rates(run(random_frameworks(spark, 40).unionByName(random_frameworks(spark, 40, flat=False, seed=1).withColumn("fw", F.col("fw") + 40)))))


@query("q96_contested_base", "SELECT * FROM (VALUES ('x', 0.333::DOUBLE, 0.8031::DOUBLE, 1), ('y', 0.333::DOUBLE, 0.0892::DOUBLE, -1), ('z', 0.667::DOUBLE, 0.9108::DOUBLE, 1)) t(asm, before, after, moved)")
def contested_base(spark, d):
    """Two assumptions attack each other and one supports a third: x = b (1 - y), y = 0.5 (1 - x), z = 0.5 + 0.5 x, nine times."""
    from rulewright.operators.gradual import contested

    bases = spark.createDataFrame([("x", 0.5), ("y", 0.5), ("z", 0.5)], "asm string, base double")
    edges = spark.createDataFrame([("x", "attack", 0, "y"), ("y", "attack", 0, "x"), ("z", "support", 0, "x")], "target string, polarity string, edge_id int, member string")
    return contested(bases, edges, "x", 0.9, rounds=9).select("asm", F.round("before", 4).alias("before"), F.round("after", 4).alias("after"), "moved")
