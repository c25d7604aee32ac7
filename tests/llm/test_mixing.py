"""Mixing against direct sums over documents sorted by their places."""

import hashlib
import re

import pytest

from test_pipeline import goals
from vigilog.llm import mixing


def place(doc, text):
    name = str(doc) if doc is not None else "text:" + (text or "")
    return int(hashlib.md5(name.encode()).hexdigest()[:15], 16)


def expected(rows):
    docs = [(d, s, len(re.findall(r"[^\x20\x09-\x0D]+", t or "")), place(d, t)) for d, t, s in rows]
    total = {}
    for _, s, n, _ in docs:
        total[s] = total.get(s, 0) + n
    names = {s: (s is None, s or "") for s in total}
    target = dict(zip(sorted(total, key=names.get), goals({names[s]: n for s, n in total.items()}).items(), strict=True))
    out = []
    for d, s, n, p in docs:
        goal = target[s][1]
        passes = int(goal // total[s]) if total[s] else 0
        missing = goal - passes * total[s]
        before = sum(m for _, t, m, q in docs if t == s and q < p)
        own = sum(m for _, t, m, q in docs if t == s and q == p)
        more = missing > 0 and before < missing and (before + own < missing or before + own - missing < missing - before)
        out.append((d, n, total[s], round(goal, 6), n * (passes + more)))
    return sorted(out, key=str)


def check(spark, rows):
    df = spark.createDataFrame([(d, t, s, 1, 2) for d, t, s in rows], "doc_id long, text string, source string, place int, `limit` int")
    got = mixing.shares(mixing.sized(df)).collect()
    assert sorted(((r["doc_id"], r["size"], r["source_size"], round(r["target"], 6), r["taken"]) for r in got), key=str) == expected(rows)
    out = mixing.mixed(df)
    assert out.columns == df.columns
    counts = {}
    for r in out.collect():
        counts[r["doc_id"], r["text"], r["source"]] = counts.get((r["doc_id"], r["text"], r["source"]), 0) + 1
    wanted = {}
    for d, t, s in rows:
        size = len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
        if size and sum(x[0] == d for x in rows) == 1:
            taken = next(r["taken"] for r in got if r["doc_id"] == d)
            wanted[d, t, s] = taken // size
    assert all(counts.get(k, 0) == n for k, n in wanted.items())


def test_many_sources(spark):
    rows = [(i, "w " * (1 + i * 7919 % 300), f"s{i % 11 if i % 3 else 0}") for i in range(700)]
    check(spark, rows)


@pytest.mark.parametrize(
    "rows",
    [
        [],
        [(1, None, None)],
        [(1, "a b", "x"), (1, "a b", "x"), (None, "c d e", "x"), (None, "f", None), (2, "", "y"), (3, "long " * 20_000, "z"), (4, "q", "É"), (5, "q r", "é")],
    ],
)
def test_edge_cases(spark, rows):
    check(spark, rows)


def test_close_places_need_all_levels(spark, monkeypatch):
    """Two documents whose places differ in the last bits only."""
    rows = spark.createDataFrame([("s", (1 << 59) + i, 5) for i in range(4)] + [("t", 3, 100)], "source string, place long, size long")
    goals_ = spark.createDataFrame([("s", 20, 10.0), ("t", 100, 100.0)], "source string, source_size long, target double")
    found = {r["source"]: (r["passes"], r["limit"]) for r in mixing.thresholds(rows, goals_, 2).collect()}
    assert found["s"] == (0, (1 << 59) + 2) and found["t"] == (1, 0)
