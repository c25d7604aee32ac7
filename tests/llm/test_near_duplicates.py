"""Near duplicates against all pairs of shingle sets."""

import random

import numpy as np
import pytest

from test_pipeline import shingles
from vigilog.llm import near_duplicates as nd
from vigilog.llm.components import components


def brute(texts):
    """Component labels (smallest place) and set sizes."""
    sets = [shingles(t) for t in texts]
    label = list(range(len(texts)))

    def find(i):
        while label[i] != i:
            i = label[i]
        return i

    for i, a in enumerate(sets):
        for j in range(i):
            both = len(a & sets[j])
            if both and 100 * both >= 75 * (len(a) + len(sets[j]) - both):
                x, y = sorted((find(i), find(j)))
                label[y] = x
    return [find(i) for i in range(len(texts))], [len(s) for s in sets]


def family(size, words=120, edits=6, seed=1):
    """Near copies around one text, pairwise similarity on both sides of the threshold."""
    rng = random.Random(seed)
    base = [f"w{rng.randrange(900)}" for _ in range(words)]
    out = []
    for _ in range(size):
        own = list(base)
        for _ in range(rng.randrange(edits)):
            own[rng.randrange(words)] = f"x{rng.randrange(10**6)}"
        out.append(" ".join(own))
    return out


def check(spark, texts):
    df = spark.createDataFrame([(i, t, "c", b"m") for i, t in enumerate(texts)], "doc_id long, text string, class string, marks binary")
    rows = {r["doc_id"]: r for r in nd.near_duplicates(df).collect()}
    label, sizes = brute(texts)
    assert len(rows) == len(texts)
    assert [rows[i]["n_shingles"] for i in range(len(texts))] == sizes
    assert [rows[i]["component_id"] for i in range(len(texts))] == label
    assert all(rows[i]["kept"] == (label[i] == i) for i in range(len(texts)))
    alone = [i for i, n in enumerate(sizes) if not n]
    assert sum(r["first"] for r in rows.values()) == len({c for i, c in enumerate(label) if sizes[i]}) + len(alone)


def test_families_and_odd_texts(spark):
    texts = family(40) + family(25, 60, 4, 2) + [None, "", " \n", "one two", "ONE two", "one two three four five", "É e é e e", "a b c d e f g h"]
    texts += ["common words here to share among many texts " * 3 + f"end {i} {i * 7} {i * i} q{i} z{i}" for i in range(30)]
    texts += ["long " + " ".join(str(i) for i in range(30_000)), "long " + " ".join(str(i) for i in range(1, 30_000))]
    texts += [texts[3], texts[70]]
    check(spark, texts)


@pytest.mark.parametrize("rows", [4, 9])
def test_large_groups_are_split_into_blocks(spark, monkeypatch, rows):
    monkeypatch.setattr(nd, "BUCKET_ROWS", rows)
    monkeypatch.setattr(nd, "CLUSTER_ROWS", rows)
    check(spark, family(45, 90, 7, 3))


def test_null_and_repeated_ids(spark):
    a, b = family(2, 80, 2, 5)
    df = spark.createDataFrame([(None, a), (None, b), (4, a), (4, a), (4, "other text of five words"), (9, b), (None, "")], "doc_id long, text string")
    rows = nd.near_duplicates(df).collect()
    assert len(rows) == 7
    linked = [r for r in rows if r["n_shingles"] > 1]
    assert {r["component_id"] for r in linked} == {4} and sum(r["first"] for r in linked) == 1
    assert nd.near_duplicates(df.limit(0)).count() == 0


def test_miss_probabilities():
    assert (1 - 0.75**nd.BAND_ROWS) ** nd.BANDS < 1e-5
    rng = np.random.default_rng(3)
    steps = nd.least_matches()
    alive = np.ones(20_000, bool)
    hits = np.zeros(20_000, int)
    done = 0
    for n, needed in steps:
        hits += rng.binomial(n - done, 0.75, 20_000)
        alive &= hits >= needed
        done = n
    assert alive.mean() > 0.9999
    assert steps[-1][1] > 0.5 * nd.HASHES


def test_components(spark):
    rng = random.Random(8)
    pairs = [(rng.randrange(60), rng.randrange(60)) for _ in range(40)] + [(100 + i, 101 + i) for i in range(60)] + [(5, 5)]
    label = {x: x for p in pairs for x in p}
    for _ in label:
        for a, b in pairs:
            label[a] = label[b] = min(label[a], label[b])
    got = {r["node"]: r["component"] for r in components(spark.createDataFrame(pairs, "a long, b long")).collect()}
    assert got == {x: c for x, c in label.items() if sum(v == c for v in label.values()) > 1}
