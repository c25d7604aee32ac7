"""Quality classifier: features against plain Python, held-out accuracy, edge cases."""

import zlib

import numpy as np
import pytest

from vigilog.llm import classifier as c
from vigilog.llm.classifier_query import op10_quality_classifier


def test_features_do_not_depend_on_the_other_words():
    words = ["a", "Straße", "x" * 40, "日本", "the"]
    buckets, counts = c.word_features(words)
    ends = np.cumsum(counts)
    for i, w in enumerate(words):
        own, n = c.word_features([w])
        assert n[0] == counts[i] == 1 + sum(max(0, len(w) + 2 - k + 1) for k in c.NGRAMS)
        assert sorted(own) == sorted(buckets[ends[i] - counts[i] : ends[i]])
    assert set(c.word_features(["abcd"])[0]) & set(c.word_features(["zabcz"])[0])


@pytest.mark.parametrize("sf_dir", ["/root/testdata/sf0.01"])
def test_held_out_accuracy(spark, sf_dir):
    rows = op10_quality_classifier(spark, sf_dir).collect()
    labels = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{sf_dir}/labels.parquet").collect()}
    assert len(rows) == spark.read.parquet(f"{sf_dir}/documents.parquet").count()
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 3 == 1) for r in rows)
    assert all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.5) for r in rows)
    out = [(labels[r["doc_id"]], r["predicted"]) for r in rows if r["held_out"] and r["doc_id"] in labels]
    assert sum(a == b for a, b in out) >= 0.97 * len(out)
    assert sum(a == b for a, b in out if a == 0) >= 0.85 * sum(a == 0 for a, _ in out)


def test_score_is_the_softmax_of_the_average(spark):
    rng = np.random.default_rng(1)
    model = c.Model(rng.normal(size=(c.BUCKETS + c.MARKS, c.DIMENSIONS)).astype(np.float32).tobytes(), rng.normal(size=(c.DIMENSIONS, 2)).astype(np.float32).tobytes(), np.array([0.1, 0.3], np.float32).tobytes())
    texts = ["the cat the the cat sat", "", "one", None, "x " * 5000, "a b\tc\nd"]
    got = {r["doc_id"]: r["score"] for r in c.scored(spark.createDataFrame([(i, t, 0.0) for i, t in enumerate(texts)], "doc_id int, text string, score double"), model).collect()}
    for i, text in enumerate(texts):
        words = (text or "").split()
        features = [b for w in words for b in c.word_features([w])[0].tolist()]
        for k, w in enumerate(words):
            share = words.count(w) / len(words)
            features.append(c.BUCKETS + (0 if k and words[k - 1] == w else 1 + min(int(np.floor(-np.log2(share))), c.MARKS - 2)))
        hidden = model.vectors[features].astype(float).mean(0) if features else np.zeros(c.DIMENSIONS)
        logits = hidden @ model.output + model.bias
        assert got[i] == pytest.approx(1 / (1 + np.exp(logits[0] - logits[1])), rel=1e-4)


def test_edge_cases(spark):
    docs = spark.createDataFrame([(None, "a"), (1, None), (2, "b b"), (2, "b b")], "doc_id long, text string")
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    model = c.fitted(docs, none)
    assert [r["score"] for r in c.scored(docs, model).collect()] == [0.5] * 4
    odd = spark.createDataFrame([(1, 1), (2, None), (2, 0), (2, 0), (None, 1), (9, 5)], "doc_id long, quality int")
    scores = {r["doc_id"]: r["score"] for r in c.scored(docs, c.fitted(docs, odd)).collect()}
    assert scores[2] < scores[1]
    assert c.scored(docs.limit(0), model).count() == 0
