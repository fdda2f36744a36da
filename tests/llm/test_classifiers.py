import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from rulewright.llm import quality, toxicity
from rulewright.llm._boost import Boosted, Isotonic


def corpus(n=900):
    rnd = random.Random(2)
    words = ["ka", "lo", "mira", "tor", "ensa", "verdu", "pelo", "sta", "ri", "onte"]
    rows, labels = [], []
    for i in range(n):
        text = " ".join(rnd.choice(words) + rnd.choice(("", "", ",", ".")) for _ in range(rnd.randint(20, 120)))
        bad, toxic = i % 5 == 0, i % 7 == 0
        if bad:
            text = " ".join(w + "$$$" for w in text.split()) if i % 2 else text.upper().replace(" ", "!! ")
        if toxic:
            text = text.replace(" ", rnd.choice((" idiot you ", " zzfoo ", " stup1d ")), 3)
        rows.append((i, text))
        labels.append((i, int(not bad), int(toxic)))
    return rows, labels


@pytest.mark.parametrize("module, label, modulus, remainder", [(toxicity, "toxic", 3, 1), (quality, "quality", 4, 2)])
def test_held_out_accuracy_and_contract(spark, docs, edge, module, label, modulus, remainder):
    rows, labels = corpus()
    lab = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    got = module.score(docs(rows + edge), lab).collect()
    assert len(got) == len(rows) + len(edge)
    truth = {i: (q if label == "quality" else t) for i, q, t in labels}
    right = []
    for r in got:
        assert r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % modulus == remainder)
        assert 0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.7)
        if r["held_out"] and r["doc_id"] in truth:
            right.append(r["predicted"] == truth[r["doc_id"]])
    assert np.mean(right) > 0.95
    # Labels of held-out rows are never used: flipping them changes nothing.
    out = F.crc32(F.col("doc_id").cast("string")) % modulus == remainder
    flipped = lab.withColumn(label, F.when(out, 1 - F.col(label)).otherwise(F.col(label)))
    again = {r["doc_id"]: r["score"] for r in module.score(docs(rows + edge), flipped).collect()}
    assert again == {r["doc_id"]: r["score"] for r in got}


@pytest.mark.parametrize("module, label", [(toxicity, "toxic"), (quality, "quality")])
def test_without_labels(spark, docs, edge, module, label):
    none = spark.createDataFrame([(1, None, None)], "doc_id long, quality int, toxic int")
    assert {round(r["score"], 6) for r in module.score(docs(edge), none).collect()} == {0.5}
    assert module.score(docs(edge).where("false"), none).count() == 0


def test_keep_good(spark, docs, edge):
    rows, labels = corpus()
    lab = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    df = docs(rows)
    kept = quality.keep_good(df, lab)
    assert kept.columns == df.columns
    good = {i for i, q, _ in labels if q}
    ids = {r["doc_id"] for r in kept.collect()}
    assert len(ids & good) > 0.97 * len(good) and len(ids - good) < 0.03 * len(ids)


def test_boosting_and_isotonic():
    rnd = np.random.default_rng(1)
    x = rnd.normal(size=(600, 4))
    y = ((x[:, 0] > 0) ^ (x[:, 1] > 0)).astype(float)
    m = Boosted(trees=40).fit(x, y).margin(x)
    assert ((m > 0) == (y == 1)).mean() > 0.97
    c = Isotonic().fit(m, y)
    p = c(np.sort(m))
    assert (np.diff(p) >= 0).all() and abs(c(m).mean() - y.mean()) < 0.03


@pytest.mark.parametrize("module, label, column, modulus, remainder", [(toxicity, "toxic", "toxic", 3, 1), (quality, "quality", "quality", 4, 2)])
def test_held_out_rows_of_the_test_tables(spark, module, label, column, modulus, remainder):
    """On the labels of the driver's tables: ranking and precision of held-out rows, and scores that rank inside a step."""
    sf = "/root/testdata/sf0.01"
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    truth = {r["doc_id"]: r[column] for r in labels.collect()}
    rows = [r for r in module.score(docs, labels).collect() if r["held_out"] and r["doc_id"] in truth]
    pos, neg = ([r["score"] for r in rows if truth[r["doc_id"]] == k] for k in (1, 0))
    auc = np.mean([(a > b) + 0.5 * (a == b) for a in pos for b in neg])
    assert len(rows) > 60 and auc > 0.9
    flagged = [truth[r["doc_id"]] for r in rows if r["predicted"]]
    assert np.mean(flagged) > 0.75 and len({r["score"] for r in rows}) > 20


@pytest.mark.parametrize("module, label", [(toxicity, "toxic"), (quality, "quality")])
def test_long_texts_null_ids_repeated_rows_and_clashing_columns(spark, module, label):
    rows, labels = corpus(300)
    long = "ka lo mira " * 90_000
    extra = [(None, "ka lo"), (5000, long), (5001, None), (7, rows[7][1])]
    df = spark.createDataFrame([(i, t, 0.5, True) for i, t in rows + extra], "doc_id long, text string, score double, held_out boolean")
    lab = spark.createDataFrame([*labels, labels[7], (None, 1, 1)], "doc_id long, quality int, toxic int")
    got = module.score(df, lab).collect()
    assert len(got) == len(rows) + len(extra) and all(0 <= r["score"] <= 1 for r in got)
    assert len({r["score"] for r in got if r["doc_id"] == 7}) == 1 and sum(r["doc_id"] is None for r in got) == 1
