"""Quality rules against plain Python counts and a numpy estimate."""

import re
from collections import Counter

import numpy as np
import pytest

from vigilog.llm import quality_rules as q

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def counts(text):
    text = text or ""
    words = WORD.findall(text)
    windows = Counter(tuple(words[i : i + 3]) for i in range(len(words) - 2))
    covered = {j for i in range(len(words) - 2) if windows[tuple(words[i : i + 3])] > 1 for j in (i, i + 1, i + 2)}
    lines = [x for x in text.split("\n") if WORD.search(x)]
    failed = len(words) < 50 or 100 * len(covered) > 50 * len(words)
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(covered), failed


def as_tuple(r):
    return r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"], r["base_failed"]


def test_base_counts(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    rows = q.judged(docs).collect()
    assert len(rows) == len(texts)
    for r in rows:
        assert as_tuple(r) == counts(texts[r["doc_id"]])
        assert not (r["kept"] and r["base_failed"])


def test_junk_goes_and_clean_stays(spark, sf_dir):
    docs, labels = (spark.read.parquet(f"{sf_dir}/{n}.parquet") for n in ("documents", "labels"))
    rows = q.judged(docs).join(labels, "doc_id").filter("NOT base_failed").collect()
    assert all(r["kept"] for r in rows if r["quality"] == 1)
    assert not any(r["kept"] for r in rows if r["quality"] == 0)


def numpy_distances(x):
    """The same estimate, written on one array."""
    floor = np.diag(np.array(q.FLOOR) ** 2)

    def step(mean, scatter):
        gap = x - mean
        d2 = np.einsum("ij,jk,ik->i", gap, np.linalg.inv(scatter), gap)
        bars = np.floor(np.log1p(d2) * 100)
        near = x[bars <= np.sort(bars)[int(np.ceil(len(x) * q.SUBSET)) - 1]]
        return near.mean(0), np.cov(near.T, bias=True) * q.CONSISTENCY + floor

    def quantile(share):
        grid = np.floor(x * q.GRID)
        return (np.sort(grid, 0)[int(np.ceil(len(x) * share)) - 1] + 0.5) / q.GRID

    starts = [(quantile(0.5), np.diag(((quantile(0.75) - quantile(0.25)) / 1.349) ** 2) + floor), (x.mean(0), np.cov(x.T, bias=True) * q.CONSISTENCY + floor)]
    ends = []
    for state in starts:
        for _ in range(q.STEPS):
            state = step(*state)
        ends.append(state)
    mean, scatter = min(ends, key=lambda e: np.linalg.slogdet(e[1])[1])
    gap = x - mean
    return np.einsum("ij,jk,ik->i", gap, np.linalg.inv(scatter), gap)


def test_estimate_is_the_numpy_one(spark):
    rng = np.random.default_rng(5)
    x = rng.normal(size=(300, q.P)) @ rng.normal(size=(q.P, q.P)) * 0.3
    x[:60] += 25  # a fifth of the rows are far away together
    rows = spark.createDataFrame([("a", *map(float, r)) for r in x], ["team", *q.FEATURES])
    estimate = q.scatter_estimates(rows, 1)
    got = sorted(r["d2"] for r in q._distances(rows, estimate, 1).collect())
    assert np.allclose(got, np.sort(numpy_distances(x)), rtol=1e-6)
    assert got[239] < q.CUTOFF < got[240]


CASES = [
    [],
    [(1, None, None, None)],
    [(None, "", "en", None), (1, "a b a b a b", "en", "s"), (1, "a b a b a b", "en", "s"), (2, "x\n\n x\nx\nx", None, "s"), (3, "a " * 3000, "en", "s"), (4, "# | <b> é\t\x0bÉ", "de", "s")],
]


@pytest.mark.parametrize("case", CASES)
def test_edge_cases(spark, case):
    df = spark.createDataFrame([(*r, 0, 0) for r in case], "doc_id long, text string, lang string, source string, TEAM int, key int")
    rows = q.judged(df).collect()
    assert sorted(map(as_tuple, rows)) == sorted(counts(t) for _, t, _, _ in case)
    assert all(r["kept"] == (not r["base_failed"]) for r in rows)
    assert q.kept_rows(df).columns == df.columns


def test_kept_rows(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    kept = {r["doc_id"] for r in q.judged(docs).filter("kept").collect()}
    assert sorted(r["doc_id"] for r in q.kept_rows(docs.unionAll(docs)).collect()) == sorted([*kept, *kept])
