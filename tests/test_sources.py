import hashlib
import json
import zipfile

import pytest
from pyspark.sql import functions as F

from rulewright.operators.learner import Problem, solve
from rulewright.sources import jsonl, logic_text, model, resume
from rulewright.sources.builtin import problems
from rulewright.streaming import events


def test_jsonl_round_trip(spark, tmp_path):
    df = spark.createDataFrame([("b", 2), ("a", 1)], "problem_id string, n int")
    path = f"file://{tmp_path}/x"
    jsonl.write(df, path, ["problem_id"])
    assert [tuple(r) for r in jsonl.read(spark, path, "problem_id string, n int").collect()] == [("a", 1), ("b", 2)]
    assert jsonl.read(spark, f"file://{tmp_path}/none", "problem_id string").count() == 0
    (tmp_path / "bad.jsonl").write_text('{"problem_id": "a"}\n{broken\n')
    got = jsonl.read(spark, f"file://{tmp_path}/bad.jsonl", "problem_id string", strict=False).collect()
    assert [r["problem_id"] for r in got] == ["a", None] and got[1]["_corrupt_record"] == "{broken"
    with pytest.raises(Exception):
        jsonl.read(spark, f"file://{tmp_path}/bad.jsonl", "problem_id string").collect()


def test_checksums(spark, tmp_path):
    (tmp_path / "a.txt").write_text("hello")
    want = hashlib.sha256(b"hello").hexdigest()
    ok = spark.createDataFrame([("a.txt", want)], "name string, sha256 string")
    assert jsonl.verified(spark, f"file://{tmp_path}", ok).count() == 0
    assert jsonl.verified(spark, f"file://{tmp_path}", ok.union(spark.createDataFrame([("b.txt", "0")], ok.schema))).count() == 1


def test_problem_serde(spark):
    df = problems(spark)
    nested = jsonl.problem_struct(df)
    assert {r["problem_id"]: len(r["problem"]["positive"]) for r in nested.collect()} == {"nixon_diamond": 3, "flies": 1, "tax_law": 2}
    back = {r["problem_id"]: json.loads(r["problem"]) for r in jsonl.problem_json(nested).collect()}
    assert solve(Problem.of(back["tax_law"]))["success"]


def test_resume_and_stream_are_idempotent(spark, tmp_path):
    path = f"file://{tmp_path}/sink"
    rows = spark.createDataFrame([(1, "s"), (2, "s"), (2, "s")], "id long, seed string")
    assert resume.append_pending(rows, path, ["id"], ["seed"]) == 2
    assert resume.append_pending(rows, path, ["id"], ["seed"]) == 0
    with pytest.raises(ValueError):
        resume.append_pending(rows.withColumn("seed", F.lit("t")), path, ["id"], ["seed"])
    spark.createDataFrame([(2, "s"), (3, "s")], "id long, seed string").write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema("id long, seed string").parquet(f"{tmp_path}/in")
    for i in range(2):
        events.append_new(stream, path, ["id"], f"{tmp_path}/ck{i}").awaitTermination()
    assert sorted(r["id"] for r in spark.read.parquet(path).collect()) == [1, 2, 3]


def test_windows_batch_and_stream_agree(spark, tmp_path):
    e = spark.read.parquet("/root/testdata/sf0.001/events.parquet").select("ts", "event_type", "value", "user_id")
    want = sorted(map(tuple, events.windowed_counts(e, "1 day").collect()))
    e.coalesce(1).write.parquet(f"{tmp_path}/e")
    stream = events.windowed_counts(spark.readStream.schema(e.schema).parquet(f"{tmp_path}/e"), "1 day")
    stream.writeStream.format("memory").queryName("w").outputMode("complete").trigger(availableNow=True).start().awaitTermination()
    assert sorted(map(tuple, spark.table("w").collect())) == want
    assert events.sessions(e).agg(F.sum("n")).first()[0] == e.count()


def test_logic_text(spark, tmp_path):
    program = "bird(tweety). bird(sam).\npenguin(sam).\nflies(X) :- bird(X), normal(X).\nage(sam, 3).\nassumption(normal(X)).\nassumption(unused(X)).\ncontrary(normal(Y), odd(Y)) :- assumption(normal(Y)).\n% end"
    with zipfile.ZipFile(tmp_path / "set.zip", "w") as z:
        z.writestr("a/01_birds.bk.aba", program)
        z.writestr("a/01_birds.bk.goal", ":- aba_asp('birds', [flies(tweety)], [flies(sam)]).")
        z.writestr("a/02_bad.bk.aba", "contrary(a, b).")
    got = {r["name"]: r for r in logic_text.read_programs(spark, f"file://{tmp_path}").collect()}
    p = Problem.of(json.loads(got["01_birds"]["problem"]))
    assert p.positive == ["flies(tweety)"] and p.negative == ["flies(sam)"] and p.background.contraries == {"normal(X)": "odd(X)"} and p.background.assumptions == ["normal(X)"]
    assert p.learnable == ["flies", "odd"] and p.domain == ["tweety", "sam", "n3"] and got["01_birds"]["n_rules"] == 5 and got["02_bad"]["error"]
    assert solve(p)["success"]
    other = logic_text.read_programs(spark, f"file://{tmp_path}", {"set.zip": "0" * 32}).collect()
    assert [(r["name"], r["error"]) for r in other] == [(None, "checksum differs")]
    with pytest.raises(ValueError):
        logic_text.parse_program("p(X) :- q(X), a(Y).\nassumption(a(X)).")


def test_torn_files_prefixes_and_runs(spark, tmp_path):
    (tmp_path / "eval.jsonl").write_text('{"problem_id": "a", "n": 1}\n{"problem_id": "b", "n"')
    schema = "problem_id string, n int"
    assert [tuple(r) for r in jsonl.without_torn_tail(spark, f"file://{tmp_path}/eval.jsonl", schema).collect()] == [("a", 1)]
    (tmp_path / "bad.jsonl").write_text('{"problem_id"\n{"problem_id": "b", "n": 2}\n')
    with pytest.raises(Exception):
        jsonl.without_torn_tail(spark, f"file://{tmp_path}/bad.jsonl", schema).collect()
    assert jsonl.without_torn_tail(spark, f"file://{tmp_path}/none", schema).count() == 0
    folder = tmp_path / "c"
    folder.mkdir()
    for prefix in ("", "table1_"):
        (folder / f"{prefix}eval.jsonl").write_text('{"problem_id": "x%s", "split": "test"}\n' % prefix)
        (folder / f"{prefix}problems.jsonl").write_text('{"problem_id": "x%s", "problem": {"positive": ["p(a)"]}}\n' % prefix)
        (folder / f"{prefix}traces.jsonl").write_text('{"problem_id": "x%s", "n": 1}\n' % prefix)
    got = jsonl.load_eval(spark, f"file://{folder}", "problem_id string, split string").collect()
    assert sorted((r["problem_id"], r["set"], r["problem"]["positive"]) for r in got) == [("x", "corpus", ["p(a)"]), ("xtable1_", "table1", ["p(a)"])]
    assert jsonl.stored_records(spark, f"file://{folder}", schema).count() == 2
    jsonl.write_name_maps(spark.createDataFrame([("b", "{}"), ("a", "{}")], "problem_id string, name_map string"), f"file://{tmp_path}/names")
    assert spark.read.json(f"file://{tmp_path}/names").count() == 2
    run = f"file://{tmp_path}/run"
    assert resume.open_run(spark, run, {"model": "m", "note": 1}, ["model"]) == resume.open_run(spark, run, {"model": "m", "note": 2}, ["model"]) == {"model": "m", "note": 1}
    with pytest.raises(ValueError):
        resume.open_run(spark, run, {"model": "other"}, ["model"])
    calls = spark.createDataFrame([("a", 0), ("b", 0)], "problem_id string, i int")
    done = spark.createDataFrame([("a",)], "problem_id string")
    assert [r["problem_id"] for r in resume.finished_only(calls, done, ["problem_id"]).collect()] == ["a"]
    both, counts = resume.matched(calls, done, ["problem_id"])
    assert both.count() == 1 and tuple(counts.first()) == (2, 1)


def test_mock_model(spark):
    prompts = spark.createDataFrame([("p", 0, "text", 1), ("p", 1, "text", 2)], "problem_id string, sample_idx int, prompt string, seed long")
    a, b = (sorted(map(tuple, model.generate(prompts).drop("latency_s").collect())) for _ in range(2))
    assert a == b and a[0][2] != a[1][2]

    def broken(prompt, seed):
        raise TimeoutError("no answer")

    assert model.generate(prompts, broken).where("error LIKE 'TimeoutError%' AND raw IS NULL AND n_tries = 3").count() == 2
    assert model.wait_of("try again in 1m2.5s", 9.0) == 62.5 and model.wait_of("no", 9.0) == 9.0 and model.wait_of("try again in 250ms", 1.0) == 0.25


def test_modes_resume_and_a_failing_mode_is_skipped(spark, tmp_path):
    rows = spark.createDataFrame([(m, "p", i, "text", i) for m in ("direct", "guided") for i in range(2)], "mode string, problem_id string, sample_idx int, prompt string, seed long")
    path = f"file://{tmp_path}/modes"
    assert model.run_modes(rows, ["direct", "guided"], path) == {"direct": 2, "guided": 2}
    assert model.run_modes(rows, ["direct", "guided"], path) == {"direct": 0, "guided": 0}
    with pytest.raises(ValueError):
        model.run_modes(rows.withColumn("seed", F.col("seed") + 1), ["direct"], path)
    assert model.run_modes(rows, ["direct"], "nosuch://x/y") == {"direct": -1}


def test_reports(spark, tmp_path):
    df = spark.createDataFrame([("a", 1, ["x"])], "problem_id string, n int, rules array<string>")
    assert "| a | 1 |" in jsonl.markdown(df.select("problem_id", "n"), "t")
    jsonl.export_frameworks(df, f"file://{tmp_path}/out")
    assert spark.read.option("header", True).csv(f"file://{tmp_path}/out/csv").columns == ["problem_id", "n"]
