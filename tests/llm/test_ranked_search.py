"""Ranked search against a plain loop over all items and documents."""

import math
import random
import re

import pytest
from compare import connection, difference

from vigilog.llm import ranked_search as module
from vigilog.llm.ranked_search import ranked_documents
from vigilog.llm.ranked_search_query import SQL, op13_ranked_search

TERM = re.compile("[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def terms(text):
    return TERM.findall((text or "").translate(LOWER))


def expected(docs, items, k):
    bags = [(d, terms(t)) for d, t in docs]
    count, length = sum(bool(b) for _, b in bags), sum(len(b) for _, b in bags)
    df = {}
    for _, own in bags:
        for t in set(own):
            df[t] = df.get(t, 0) + 1
    out = []
    for item, text in items:
        found = []
        for d, own in bags:
            m = 50 + 50 * len(own) * count // length if length else 0
            score = 0
            for t in set(terms(text)):
                if tf := own.count(t):
                    score += math.floor(1000 * math.log((2 * count + 2) / (2 * df[t] + 1))) * (1000000000 * tf // (1000 * tf + 20 * m))
            if score > 0:
                found.append((-score, d is None, d or 0))
        out += [(item, i + 1, None if none else d, -s) for i, (s, none, d) in enumerate(sorted(found)[:k])]
    return sorted(out, key=str)


def found(spark, docs, items, k, **names):
    d = spark.createDataFrame(docs, "doc_id long, text string").repartition(5)
    i = spark.createDataFrame(items, "item_id long, text string")
    return sorted((tuple(r) for r in ranked_documents(d, i, k).collect()), key=str)


def corpus(seed, n):
    rng = random.Random(seed)
    words = ["alpha", "Beta", "gamma", "éa", "ÉA", "x1", "日本", "rare", "the", "The"]
    docs = [(i, " ".join(rng.choices(words, k=rng.randrange(0, 12)))) for i in rng.sample(range(10 * n), n)]
    copies = [(20_000 + i, "the rare, Alpha!\x00alpha-alpha") for i in range(n // 3)]
    items = [(i, " ".join(rng.choices([*words, "absent"], k=rng.randrange(0, 8)))) for i in range(12)]
    return docs + copies + [(5, None), (6, ""), (7, "?!")], items


@pytest.mark.parametrize("blocks", [5, 10**6])
def test_against_a_plain_loop(spark, monkeypatch, blocks):
    monkeypatch.setattr(module, "BLOCK_TERMS", blocks)
    monkeypatch.setattr(module, "PAIRS", 50)
    docs, items = corpus(1, 300)
    for k in (1, 7, 50):
        assert found(spark, docs, items, k) == expected(docs, items, k)


def test_sums_beyond_doubles(spark, monkeypatch):
    monkeypatch.setattr(module, "EXACT_SUM", 0)
    docs, items = corpus(2, 100)
    assert found(spark, docs, items, 20) == expected(docs, items, 20)


def test_nulls_repeats_long_texts_and_empty_tables(spark):
    docs = [(None, "a b"), (1, "a b"), (1, "a b"), (1, "b c c"), (2, None), (None, None), (3, "b " * 100_000 + "zz"), (4, "a\tB")]
    items = [(1, "A b"), (1, "c"), (None, "zz"), (2, None), (3, "missing"), (4, "")]
    assert found(spark, docs, items, 3) == expected(docs, items, 3)
    assert found(spark, docs, items, 50) == expected(docs, items, 50)
    assert found(spark, [], items, 3) == [] == found(spark, docs, [], 3)
    clashing = spark.createDataFrame([(1, "a", 5, 6, 7)], "doc_id long, text string, m long, low long, score long")
    other = spark.createDataFrame([(9, "a", 1)], "item_id long, text string, rank int")
    assert [tuple(r) for r in ranked_documents(clashing, other).collect()] == expected([(1, "a")], [(9, "a")], 50)


def test_query_is_its_sql(spark, sf_dir):
    assert difference(spark, connection(sf_dir), "op13", op13_ranked_search, SQL, sf_dir) is None
