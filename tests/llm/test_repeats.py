"""Removal of repeated strings against a set of all strings."""

import hashlib
from collections import Counter

import numpy as np
import pytest

from vigilog.llm import repeats
from vigilog.llm.suffix_columns import column_orders


def brute(texts, length=repeats.LENGTH):
    raw = [(t or "").encode() for t in texts]
    seen = Counter(b[i : i + length] for b in raw for i in range(len(b) - length + 1))
    out = []
    for b in raw:
        gone = bytearray(len(b))
        for i in range(len(b) - length + 1):
            if seen[b[i : i + length]] > 1:
                gone[i : i + length] = b"\1" * length
        runs = sum(1 for i, g in enumerate(gone) if g and (not i or not gone[i - 1]))
        out.append((len(b), sum(gone), runs, hashlib.sha256(bytes(x for x, g in zip(b, gone) if not g)).hexdigest()))
    return out


def got(df):
    return sorted((r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in df.collect())


def test_columns_sort_suffixes():
    rng = np.random.default_rng(3)
    rows = rng.integers(1, 4, (60, 12)).astype(np.uint16)
    rows[::3, 2:9] = rows[0, 2:9]
    rows[5, 7:] = 0
    groups = np.sort(rng.integers(0, 3, 60))
    for j, order, common in column_orders(rows, groups, 5):
        suffixes = [(groups[i], tuple(rows[i, j:])) for i in order]
        assert suffixes == sorted(suffixes)
        for k in range(60):
            n = 0
            if k and groups[order[k]] == groups[order[k - 1]]:
                a, b = rows[order[k], j:], rows[order[k - 1], j:]
                while n < len(a) and a[n] == b[n] != 0:
                    n += 1
            assert common[k] == min(n, 5)


def passages():
    rng = np.random.default_rng(9)
    words = ["".join(rng.choice(list("abcdeé "), 5)) for _ in range(400)]
    text = lambda n: " ".join(rng.choice(words, n))
    shared, edge, other = text(60), text(34)[:200], text(34)[:199]
    docs = [text(50) + shared + text(40), shared, "x" + shared[3:] + text(9), edge, "q" + edge + "q", other, other + "z", text(400), "", None, "short"]
    docs += ["a" * 700, "ab" * 300, "ab" * 120 + text(30), text(20) + "\n" + text(20)]
    docs += [text(40)] * 3
    mid = text(200)
    docs += [mid[:400] + "#" + mid[401:], mid, mid[:100] + mid[300:], mid[150:380] + mid[150:380]]
    return docs


@pytest.mark.parametrize("most", [20_000, 2])
def test_passages(spark, monkeypatch, most):
    monkeypatch.setattr(repeats, "GROUP_ROWS", most)
    docs = passages()
    df = spark.createDataFrame([(i % 17 if i else None, t, "k") for i, t in enumerate(docs)], "doc_id long, text string, text_key string")
    assert got(repeats.without_repeats(df)) == sorted(brute(docs))


def test_groups_stay_whole_beside_a_large_one(spark, monkeypatch):
    # Joins become broadcast joins at run time only, and small tables keep their partitions, as on large input.
    monkeypatch.setattr(repeats, "GROUP_ROWS", 6)
    names = ["spark.sql.autoBroadcastJoinThreshold", "spark.sql.adaptive.autoBroadcastJoinThreshold", "spark.sql.adaptive.coalescePartitions.enabled"]
    before = {n: spark.conf.get(n, None) for n in names}
    for name, value in zip(names, ("-1", "10m", "false"), strict=True):
        spark.conf.set(name, value)
    rng = np.random.default_rng(21)
    text = lambda n: "".join(rng.choice(list("abcdefgh "), n))
    common = text(300)
    docs = [text(150) + common + text(150) for _ in range(9)]
    for _ in range(40):
        passage = text(300)
        docs += [text(150) + passage + text(150), text(90) + passage + text(210)]
    try:
        assert got(repeats.without_repeats(spark.createDataFrame(list(enumerate(docs)), "doc_id long, text string"))) == sorted(brute(docs))
    finally:
        for name, value in before.items():
            spark.conf.unset(name) if value is None else spark.conf.set(name, value)


def test_documents(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    rows = docs.collect()
    result = {r["doc_id"]: (r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in repeats.without_repeats(docs).collect()}
    assert result == dict(zip([r["doc_id"] for r in rows], brute([r["text"] for r in rows]), strict=True))


def test_kept_bytes_and_empty_table(spark):
    docs = spark.createDataFrame([(1, "y" * 10 + "x" * 300), (2, "z" + "x" * 200)], "doc_id long, text string")
    rows = {r["doc_id"]: bytes(r["kept"]) for r in repeats.without_repeats(docs, keep_bytes=True).collect()}
    assert rows == {1: b"y" * 10, 2: b"z"}
    assert repeats.without_repeats(docs.limit(0)).count() == 0
