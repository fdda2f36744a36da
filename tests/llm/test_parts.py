from rulewright.llm import _store, ngram_join, suffix_dedup


def test_more_parts_than_shuffle_partitions_change_nothing(spark, monkeypatch):
    words = [f"w{(7 * i) % 31}" for i in range(400)]
    rows = [(i, " ".join(words[i % 5 * 20 : i % 5 * 20 + 60] + [f"only{i}"] * (i % 3))) for i in range(60)] + [(60, None), (61, "")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    asked = []

    def results():
        return [sorted(map(tuple, f(df).collect())) for f in (ngram_join.jaccard_classes, suffix_dedup.dedup_digest)]

    few = results()
    plain = _store.partitions_for
    monkeypatch.setattr(_store, "PART_BYTES", 500)
    for module in (ngram_join, suffix_dedup):
        monkeypatch.setattr(module, "partitions_for", lambda *a: asked.append(plain(*a)) or asked[-1])
    assert results() == few
    assert len(asked) == 2 and min(asked) > 20
