"""Every stage of the pipeline on rows that are easily mishandled."""

import random

import corpus_pipeline
import pytest
from pyspark.sql import functions as F

SF = "/root/testdata/sf0.001"
NAMES = {"doc_id": "long", "text": "string", "lang": "string", "source": "string", "n_chars": "long"}


@pytest.fixture(scope="module")
def rows(spark):
    """Rows of the table, and beside them nulls, empty and blank texts, a text of a megabyte, rows that occur twice, a copy."""
    good = [r.asDict() for r in spark.read.parquet(f"{SF}/documents.parquet").select(*NAMES).where("length(text) BETWEEN 200 AND 2000").orderBy("doc_id").limit(25).collect()]
    rnd = random.Random(1)
    long = " ".join(rnd.choice(good)["text"].split()[rnd.randrange(20)] for _ in range(170_000))
    more = [{**good[0], "doc_id": None}, {**good[1], "text": None, "doc_id": 90_001}, {**good[1], "text": "", "doc_id": 90_002}, {**good[1], "text": " \n", "doc_id": 90_003}, {**good[2], "lang": None, "source": None, "n_chars": None, "doc_id": 90_004, "text": good[2]["text"][::-1]}]
    more += [{**good[3], "text": long, "doc_id": 90_005}, good[4], good[4], {**good[5], "doc_id": 90_006}]
    return good + more


def frame(spark, rows):
    """With extra columns whose names operators use for their own results."""
    df = spark.createDataFrame([tuple(r[c] for c in NAMES) for r in rows], ", ".join(f"{c} {t}" for c, t in NAMES.items())).repartition(3)
    for name in ("score", "n_tokens", "component_id", "spans", "n_shingles", "held_out", "ids", "item_id"):
        df = df.withColumn(name, F.lit(7))
    return df


@pytest.mark.parametrize("name, stage", corpus_pipeline.STAGES)
def test_stage(spark, rows, name, stage):
    docs = frame(spark, rows)
    out = stage(spark, docs, SF)
    got = out.collect()
    ids = [r["doc_id"] for r in rows]
    assert {r["doc_id"] for r in got} <= set(ids)
    if name == "bpe":
        assert out.columns == ["doc_id", "lang", "source", "n_tokens", "ids_le_uint32", "exact"] and len(got) == len(rows) and all(r["exact"] for r in got)
        assert {r["n_tokens"] for r in got if r["doc_id"] in (90_001, 90_002)} == {0}
    else:
        assert out.columns == docs.columns and {r["spans"] for r in got} <= {7}
    if name == "near_duplicates":
        kept = [r["doc_id"] for r in got]
        assert 90_006 not in kept and kept.count(rows[4]["doc_id"]) == 3 and None in kept and {90_001, 90_002, 90_003, 90_005} <= set(kept)
    if name in ("decontaminate", "pii"):
        assert {90_001, 90_002, 90_003, 90_005} <= {r["doc_id"] for r in got}
    if name == "pii":
        assert len(got) == len(rows) and {r["text"] for r in got if r["doc_id"] == 90_001} == {None}
    empty = stage(spark, docs.where("false"), SF)
    assert empty.columns == out.columns and empty.count() == 0
