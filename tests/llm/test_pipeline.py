import corpus_pipeline
import pytest

from rulewright.llm import queries

SF = "/root/testdata/sf0.001"


def test_stages_and_run(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns, ids = docs.columns, {r[0] for r in docs.select("doc_id").collect()}
    for name, stage in corpus_pipeline.STAGES:
        docs = corpus_pipeline.settle(stage(spark, docs, SF), f"test-{name}")
        own = {r[0] for r in docs.select("doc_id").collect()}
        assert own <= ids and own
        ids = own
        if name != corpus_pipeline.STAGES[-1][0]:
            assert docs.columns == columns
    assert docs.where("NOT exact").count() == 0
    assert sorted(map(tuple, docs.select("doc_id", "n_tokens").collect())) == sorted(map(tuple, corpus_pipeline.run(spark, SF).select("doc_id", "n_tokens").collect()))


@pytest.mark.parametrize("n", range(1, 11))
def test_one_query_for_each_operator(n):
    assert sum(q.startswith(f"op{n}_") for q in queries.queries()) == 1
