"""The prefix trie against a trie of nested dictionaries."""

import hashlib
import random
import zlib

import pytest
from compare import connection, difference

from vigilog.llm import prefix_trie as module
from vigilog.llm.prefix_trie import prefix_trie, sequences
from vigilog.llm.prefix_trie_query import SQL, op12_conversation_trie, with_shared_starts

COLUMNS = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]


def words_in(text):
    return len([w for w in "".join(" " if c in " \t\n\v\f\r" else c for c in text).split(" ") if w])


def expected(conversations):
    """Rows of the trie of {conv_id: [(role, text), ...]}."""
    members, ends = {(): []}, {}
    for c, turns in conversations.items():
        for d in range(len(turns) + 1):
            members.setdefault(tuple(turns[:d]), []).append(c)
        ends.setdefault(tuple(turns), []).append(c)
    if not conversations:
        return []
    children = {}
    for path in members:
        if path:
            children.setdefault(path[:-1], []).append(path)

    totals = {}
    for path in sorted(members, key=len, reverse=True):
        below = [totals[x] for x in children.get(path, [])]
        own = (len(members[path]) - 1) * words_in(path[-1][1]) if path else 0
        totals[path] = (sum(x[0] for x in below) or 1, own + sum(x[1] for x in below))
    return sorted(
        (min(m), len(path), min(members[path[:-1]]) if path else -1, len(m), len(children.get(path, [])), *totals[path], hashlib.sha256(",".join(map(str, sorted(ends.get(path, [])))).encode()).hexdigest())
        for path, m in members.items()
    )


def rows_of(df):
    assert df.columns == COLUMNS
    return sorted(tuple(-1 if v is None else v for v in r) for r in df.collect())


def frame(spark, conversations):
    rows = [(c, i, r, t) for c, turns in conversations.items() for i, (r, t) in enumerate(turns)]
    random.Random(1).shuffle(rows)
    return spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").repartition(5)


def made(kind, seed):
    rng = random.Random(seed)
    if kind == "copies":
        return {c: [("u", "one two")] * 3 for c in range(200)} | {1000 + c: [("u", "one two")] * rng.randrange(1, 6) for c in range(40)}
    if kind == "chains":
        return {c: [("u", "x " * (d % 4)) for d in range(rng.randrange(1, 60))] for c in range(60)}
    if kind == "common start":
        return {c: [("u", "hello there")] + [("a", rng.choice("abc") + " b") for _ in range(rng.randrange(0, 6))] for c in range(300)}
    if kind == "one":
        return {7: [("u", "a"), ("a", "b c")]}
    return {c: [(rng.choice("ua"), rng.choice(["", "a", "a b", "c d e"])) for _ in range(rng.randrange(1, 7))] for c in rng.sample(range(10_000), 250)}


@pytest.mark.parametrize("fan", [2, 64])
@pytest.mark.parametrize("kind", ["copies", "chains", "common start", "one", "mixed"])
def test_against_nested_dictionaries(spark, monkeypatch, kind, fan):
    monkeypatch.setattr(module, "FAN", fan)
    monkeypatch.setattr(module, "RUN_IDS", 7)
    conversations = made(kind, 3)
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "13")
    try:
        assert rows_of(prefix_trie(sequences(frame(spark, conversations)))) == expected(conversations)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)


def rebuilt(conversations):
    out = {}
    for c, turns in conversations.items():
        h = zlib.crc32(str(c).encode()) % 4
        out[c] = conversations.get(c - c % 20, [])[:h] + turns[h:]
    return out


def test_shared_starts_and_edge_cases(spark):
    rows = [(0, 2, "a", "two words"), (0, None, None, None), (0, 1, "u", "x"), (0, 1, "u", "x"), (3, 0, "u", "only"), (5, 1, "u", "x"), (21, 0, "u", "y"), (39, 0, "", ""), (39, 0, "", "")]
    rows += [(None, 1, "u", "lost"), (40, 3, "u", "long " * 50_000), (41, 3, "u", "long " * 50_000), (2**40, 1, "é", " ")]
    docs = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").selectExpr("*", "'x' AS digest", "1 AS words", "2 AS depth")
    conversations = {}
    for c, _, r, t in sorted((x for x in rows if x[0] is not None), key=lambda x: (x[0], x[1] is not None, x[1] or 0)):
        conversations.setdefault(c, []).append((r or "", t or ""))
    assert rows_of(prefix_trie(with_shared_starts(sequences(docs)))) == expected(rebuilt(conversations))
    assert any(not x for x in rebuilt({21: [("u", "y")], 22: [("u", "z")], 23: [("u", "z")]}).values())  # turnless ones are members of the root
    bare = {21: [("u", "y")], 22: [("u", "z")], 23: [("u", "z")]}
    assert rows_of(prefix_trie(with_shared_starts(sequences(frame(spark, bare))))) == expected(rebuilt(bare))
    assert prefix_trie(with_shared_starts(sequences(docs.limit(0)))).count() == 0


def test_query_is_its_sql_and_the_dictionaries(spark, sf_dir):
    conversations = {}
    for r in spark.read.parquet(f"{sf_dir}/conversations.parquet").orderBy("conv_id", "turn").collect():
        conversations.setdefault(r["conv_id"], []).append((r["role"] or "", r["text"] or ""))
    assert rows_of(op12_conversation_trie(spark, sf_dir)) == expected(rebuilt(conversations))
    assert difference(spark, connection(sf_dir), "op12", op12_conversation_trie, SQL, sf_dir) is None
