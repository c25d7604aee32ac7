"""Top-k search against Python integers."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from vigilog.llm import top_k as tk


def expected(rows, k, scale, asked):
    usable = [(i, [math.floor(scale * x) for x in v]) for i, v in rows if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    out = set()
    for q, v in usable:
        if asked(q):
            scores = sorted((-sum(a * b for a, b in zip(v, w, strict=False)), i) for i, w in usable if i != q)
            out |= {(q, r + 1, i, -s) for r, (s, i) in enumerate(scores[:k])}
    return out


def got(df):
    return {(r["query_id"], r["rank"], r["vec_id"], r["score"]) for r in df.collect()}


@pytest.mark.parametrize("blocks", [(1024, 16384), (3, 7)])
def test_random_vectors(spark, monkeypatch, blocks):
    monkeypatch.setattr(tk, "QUERY_BLOCK", blocks[0])
    monkeypatch.setattr(tk, "CANDIDATE_BLOCK", blocks[1])
    rng = np.random.default_rng(4)
    rows = [(i, [float(x) for x in np.float32(rng.integers(-3, 4, 6) / 64)]) for i in range(60)]
    rows += [(60, rows[0][1]), (61, [1e-9] * 6), (62, [0.0] * 6), (63, [-1e-9] * 3)]
    df = spark.createDataFrame([(i, v, 0) for i, v in rows], "vec_id long, embedding array<float>, q int")
    assert got(tk.top_k(df, F.col("id") % 10 == 0)) == expected(rows, 5, 256, lambda q: q % 10 == 0)


@pytest.mark.parametrize(
    "rows",
    [[], [(0, [1.0])], [(0, [1.0, 2.0]), (0, [1.0, 2.0]), (None, [1.0, 1.0]), (1, None), (2, [float("nan"), 1.0]), (3, [None, 1.0]), (4, [float("inf"), 1.0]), (5, []), (6, [0.5]), (7, [300.0, -300.0, 9.0])]],
)
def test_edge_cases(spark, rows):
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    assert got(tk.top_k(df, F.col("id") % 2 == 0, k=3)) == expected(rows, 3, 256, lambda q: q % 2 == 0)


def test_selection_with_ties():
    scores, ids = np.array([5, 9, 9, 5, 9, 1]), np.array([3, 8, 2, 1, 5, 0])
    assert ids[tk.best(scores, ids, 4)].tolist() == [2, 5, 8, 1]
    assert len(tk.best(scores[:2], ids[:2], 4)) == 2


def test_components_of_any_size(spark):
    """Sums beyond doubles, and beyond 64 bits, are exact and rank as they are."""
    big = float(2**70)
    vectors = {0: [300000.0, 1.0], 1: [100000.0, 0.0], 2: [70000.0, 0.0], 3: [66000.0, 0.0], 4: [66000.0, 2.0**-8], 50: [big, 1.0], 6: [big, 3.0], 7: [big, 2.0], 8: [-big, 5.0], 9: [0.5, -1e300], 10: [1e307, 0.0]}
    df = spark.createDataFrame(list(vectors.items()), "vec_id long, embedding array<double>").repartition(3)
    found = tk.top_k(df, F.col("id") % 50 == 0, k=9, scale=256).collect()
    exact = {i: [int(v) * 256 if abs(v) >= 2**52 else math.floor(v * 256) for v in x] for i, x in vectors.items() if i != 10}
    for q in (0, 50):
        scores = {i: sum(a * b for a, b in zip(exact[q], x, strict=True)) for i, x in exact.items() if i != q}
        order = sorted(scores, key=lambda i: (-scores[i], i))[:9]
        own = sorted((r for r in found if r["query_id"] == q), key=lambda r: r["rank"])
        assert [r["vec_id"] for r in own] == order
        assert [r["score"] for r in own] == [max(min(scores[i], 2**63 - 1), -(2**63)) for i in order]


def test_unlike_rows_of_one_query_id_share_its_ranks(spark):
    df = spark.createDataFrame([(0, [1.0, 0.0]), (0, [0.0, 1.0]), (0, [0.0, 1.0]), (1, [3.0, 0.0]), (2, [0.0, 2.0])], "vec_id long, embedding array<double>")
    found = sorted((r["rank"], r["vec_id"], r["score"]) for r in tk.top_k(df, F.col("id") % 50 == 0, k=3, scale=1).collect())
    assert found == [(1, 1, 3), (2, 2, 2), (3, 1, 0)]
