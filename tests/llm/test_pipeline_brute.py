"""The pipeline's rows against the five stages in plain Python; of the fitted stages only the models are shared."""

import re

import corpus_pipeline
import numpy as np
import pyarrow as pa
from tokenizers import Tokenizer

from rulewright.llm import bpe, pii, quality

SF = "/root/testdata/sf0.001"


def shingles(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return {" ".join(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def one_of_each_group(docs):
    """Ids that are the smallest of their component of documents with a Jaccard similarity of at least 0.8."""
    sets = {d: shingles(r["text"]) for d, r in docs.items()}
    label = {d: d for d in docs}
    for a in sorted(docs):
        for b in sorted(docs):
            common = len(sets[a] & sets[b])
            if a < b and common and 100 * common >= 80 * (len(sets[a]) + len(sets[b]) - common):
                old, new = max(label[a], label[b]), min(label[a], label[b])
                label = {d: new if x == old else x for d, x in label.items()}
    return {d for d, x in label.items() if d == x}


def folded(text):
    low = lambda c: " " if c in "\t\n\v\f\r\x85\xa0" else c.lower() if c <= "\xde" and c != "\xd7" else c
    return np.array([ord(low(c)) for c in text or ""], dtype=np.int32)


def leaking(docs, items):
    """Ids of documents with a region that at most 8 % edits turn into an item: every cell of every alignment."""
    ids, parts, ends = list(docs), [], []
    gap = np.full(1 + max(8 * len(t or "") // 100 for t in items), -1, dtype=np.int32)  # crossing it costs more than any budget
    for d in ids:
        parts += [folded(docs[d]["text"]), gap]
        ends.append(sum(map(len, parts[-2:])))
    text, owner = np.concatenate(parts), np.repeat(ids, ends)
    step, out = np.arange(len(text) + 1, dtype=np.int32), set()
    for item in items:
        pattern = folded(item)
        if not len(pattern):
            continue
        row = np.zeros(len(text) + 1, dtype=np.int32)
        for c in pattern:
            new = row + 1
            new[1:] = np.minimum(new[1:], row[:-1] + (text != c))
            row = np.minimum.accumulate(new - step) + step
        out |= set(owner[np.flatnonzero(row[1:] <= 8 * len(pattern) // 100)].tolist())
    return out


def replaced(text, spans):
    out, at = "", 0
    for kind, s, e in sorted(spans, key=lambda x: (x[1], -x[2])):
        if s >= at:
            out += text[at:s] + f"[{kind.upper()}]"
        at = max(at, e)
    return out + text[at:]


def test_run_matches_plain_python(spark):
    table = spark.read.parquet(f"{SF}/documents.parquet")
    docs = {r["doc_id"]: r for r in table.collect()}
    model = quality.fit(table, spark.read.parquet(f"{SF}/labels.parquet"))
    good = {d: r for d, r in docs.items() if model(pa.array([r["text"]], pa.string()))[0] >= 0.7}
    least = one_of_each_group(good)
    single = {d: r for d, r in good.items() if d in least}
    leaks = leaking(single, [r["text"] for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()])
    clean = {d: r for d, r in single.items() if d not in leaks}
    assert len(docs) > len(good) > len(single) > len(clean) > 0
    spans = {r["doc_id"]: [(k, int(s), int(e)) for k, s, e in (x.split(":") for x in r["spans"].split(",") if x)] for r in pii.digest(table, ["doc_id"]).collect()}
    tokenizer, want = Tokenizer.from_file(bpe.vocabulary()), []
    for d, r in clean.items():
        ids = tokenizer.encode(replaced(r["text"] or "", spans[d]), add_special_tokens=False).ids
        want.append((d, r["lang"], r["source"], len(ids), np.array(ids, dtype="<u4").tobytes(), True))
    assert any(spans[d] for d in clean)
    got = [(r["doc_id"], r["lang"], r["source"], r["n_tokens"], bytes(r["ids_le_uint32"]), r["exact"]) for r in corpus_pipeline.run(spark, SF).collect()]
    assert sorted(got) == sorted(want)
