"""The pipeline stage by stage against plain Python, and on awkward tables."""

import re
import zlib
from collections import Counter

import numpy as np
import pytest
from test_packing import check_rows
from test_quality_rules import counts
from test_secrets import base_of

import corpus_pipeline
from vigilog.llm import secrets as s
from vigilog.llm.quality_rules import judged

COLUMNS = "doc_id long, text string, lang string, source string, n_chars long"


def shingles(text):
    text = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    return {tuple(words[i : i + 5]) for i in range(max(len(words) - 4, 1))} if words else set()


def groups(rows):
    """Near-duplicate components of the rows by comparing all pairs."""
    sets = [shingles(r["text"]) for r in rows]
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, a in enumerate(sets):
        for j in range(i):
            both = len(a & sets[j])
            if both and 100 * both >= 75 * (len(a) + len(sets[j]) - both):
                root[find(i)] = find(j)
    return [find(i) for i in range(len(rows))]


def run_stage(spark, k, rows):
    df = spark.createDataFrame([tuple(r) for r in rows], COLUMNS)
    return corpus_pipeline.STAGES[k][1](spark, df, "unused")


def test_stages(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "lang", "source", "n_chars")
    before = docs.collect()
    kept = {r["doc_id"] for r in judged(docs).filter("kept").collect()}
    rows = run_stage(spark, 0, before).collect()
    assert sorted(map(tuple, rows)) == sorted(tuple(r) for r in before if r["doc_id"] in kept)
    assert not any(counts(r["text"])[5] for r in rows)

    label = groups(rows)
    least = {}
    for r, c in zip(rows, label, strict=True):
        least[c] = min(least.get(c, r["doc_id"]), r["doc_id"])
    single = run_stage(spark, 1, rows).collect()
    assert sorted(r["doc_id"] for r in single) != sorted(r["doc_id"] for r in rows)
    found = {r["doc_id"]: c for r, c in zip(rows, label, strict=True)}
    assert sorted(found[r["doc_id"]] for r in single) == sorted(least)
    assert all(tuple(r) in {tuple(x) for x in rows} for r in single)

    clean = {r["doc_id"]: r for r in run_stage(spark, 2, single).collect()}
    assert len(clean) == len(single)
    for r in single:
        assert not base_of(clean[r["doc_id"]]["text"])
        if not base_of(r["text"]):
            assert clean[r["doc_id"]]["text"] == r["text"] or "[secret]" in clean[r["doc_id"]]["text"]

    clean = list(clean.values())
    mix = run_stage(spark, 3, clean).collect()
    size = {r["doc_id"]: len(re.findall(r"[^\x20\x09-\x0D]+", r["text"])) for r in clean}
    times = Counter(r["doc_id"] for r in mix)
    assert set(times.values()) <= {1, 2}
    source = {r["doc_id"]: r["source"] for r in clean}
    total, taken = Counter(), Counter()
    for d, n in size.items():
        total[source[d]] += n
        taken[source[d]] += n * times[d]
    target = goals(total)
    for x in total:
        assert abs(taken[x] - target[x]) <= max(n for d, n in size.items() if source[d] == x) / 2 + 1e-6

    pieces = run_stage(spark, 4, mix).collect()
    check_rows(pieces, [(r["doc_id"], r["text"]) for r in mix], 4096)


def goals(total, weights=(3, 1, 2)):
    names = sorted(total)
    weight = {x: weights[i % 3] for i, x in enumerate(names)}
    full = set()
    while True:
        rest = 1.5 * sum(total.values()) - sum(2 * total[x] for x in full)
        open_ = sum(weight[x] for x in names if x not in full)
        target = {x: 2 * total[x] if x in full else weight[x] * rest / open_ for x in names}
        over = {x for x in names if target[x] > 2 * total[x]}
        if not over:
            return target
        full |= over


def test_run(spark, sf_dir):
    rows = corpus_pipeline.run(spark, sf_dir)
    assert rows.columns == ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"]
    assert rows.count() > 0


def test_last_stage_keeps_token_ids(spark, sf_dir):
    rows = corpus_pipeline.packed_corpus(spark, sf_dir).collect()
    assert rows and all(len(r["ids"]) == r["length"] for r in rows)
    assert all(zlib.crc32(np.array(r["ids"], "<u4").tobytes()) == r["ids_crc32"] for r in rows)


LONG = " ".join(f"word{i % 997} and{i}" for i in range(30_000))
AWKWARD = [
    (None, None, None, None, None),
    (1, "", "en", "a", 0),
    (1, "", "en", "a", 0),
    (2, LONG, "en", None, 1),
    (None, LONG, "en", "a", 1),
    (None, LONG, "en", "a", 1),
    (3, LONG + " password=abcdefghijkl123", "de", "a", 1),
    (3, "short", None, "b", 5),
]


@pytest.mark.parametrize("rows", [[], AWKWARD, AWKWARD[:1]])
@pytest.mark.parametrize("k", range(5))
def test_awkward_tables(spark, rows, k):
    extra = spark.createDataFrame([(*r, 1, "p") for r in rows], COLUMNS + ", mix_copy int, `dedup.place` string")
    out = corpus_pipeline.STAGES[k][1](spark, extra, "unused")
    got = out.collect()
    if k < 4:
        assert out.columns == extra.columns
    if k == 1:
        texts = Counter((r["doc_id"], r["text"]) for r in got)
        assert max(texts.values(), default=1) == 1
        assert sum((r["text"] or "").startswith("word0") for r in got) == (1 if len(rows) > 1 else 0)
    if k == 2:
        assert len(got) == len(rows)
    if k == 4:
        assert sum(r["piece"] == 0 for r in got) == len(rows)
