"""Packing against the tokenizer itself and against the rules of the result."""

import zlib

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings, strategies as st
from tokenizers import Tokenizer

from vigilog.llm.packing import packed_documents, slack_plan
from vigilog.llm.tokens import WordIds

PATH = public_tokenizers.path("word_bpe_49k.json")
TOKENIZER = Tokenizer.from_file(PATH)


def expected(doc_id, text, most=4096):
    ids = np.array([*TOKENIZER.encode(text or "", add_special_tokens=False).ids, 1], "<u4")
    return [(doc_id, k, at, len(ids[at : at + most]), zlib.crc32(ids[at : at + most].tobytes())) for k, at in enumerate(range(0, len(ids), most))]


IDS = WordIds(PATH)


@settings(max_examples=500, deadline=None)
@given(st.lists(st.text(alphabet="ab1.,;:!?é×÷Ö…»( '\n\u0301İẞ", max_size=30), max_size=6))
def test_marks_after_anything(texts):
    assert IDS([t.encode() for t in texts]) == [np.array(TOKENIZER.encode(t, add_special_tokens=False).ids, "<u4").tobytes() for t in texts]


@settings(max_examples=200, deadline=None)
@given(st.lists(st.text(alphabet="ab'sté́ \t\n \x1c Ö<|>1_-日", max_size=40), max_size=4))
def test_ids_of_words_are_ids_of_the_text(texts):
    ids_of = WordIds(PATH)
    for text in [*texts, "<|endoftext|> x"]:
        assert ids_of([text.encode()]) == [np.array(TOKENIZER.encode(text, add_special_tokens=False).ids, "<u4").tobytes()]


@settings(max_examples=60, deadline=None)
@given(st.dictionaries(st.integers(1, 64), st.integers(1, 30), max_size=20))
def test_plan_places_every_piece_once(counts):
    bins, seen = {}, dict.fromkeys(counts, 0)
    for length, first, pieces, uses, sequence, offset in slack_plan(counts, 64):
        assert first == seen[length] and pieces % uses == 0
        seen[length] += pieces
        for k in range(pieces):
            bins.setdefault(sequence + k // uses, []).append((offset + k % uses * length, length))
    assert seen == counts
    for own in bins.values():
        at = 0
        for offset, length in sorted(own):
            assert offset == at
            at += length
        assert at <= 64
    total = sum(n * c for n, c in counts.items())
    assert len(bins) <= max(2 * total / 64 + 1, 1) or not counts


def check_rows(rows, docs, most):
    got = sorted((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in rows)
    assert got == sorted(x for d, t in docs for x in expected(d, t, most))
    bins = {}
    for r in rows:
        bins.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for own in bins.values():
        at = 0
        for offset, length in sorted(own):
            assert offset == at
            at += length
        assert at <= most
    return len(bins)


def test_documents(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    rows = packed_documents(docs, PATH, keep_ids=False).collect()
    bins = check_rows(rows, [(r["doc_id"], r["text"]) for r in docs.collect()], 4096)
    assert bins <= sum(r["length"] for r in rows) // 4096 + 2


@pytest.mark.parametrize("docs", [[], [(1, None)], [(1, "a"), (1, "a"), (2, ""), (3, "b " * 70), (4, "x" * 500)]])
def test_edge_cases(spark, docs):
    df = spark.createDataFrame([(d, t, "x") for d, t in docs], "doc_id long, text string, length string")
    check_rows(packed_documents(df, PATH, capacity=32).collect(), docs, 32)


def test_null_ids(spark):
    df = spark.createDataFrame([(None, "a b"), (None, None), (7, "c")], "doc_id long, text string")
    rows = packed_documents(df, PATH, keep_ids=True).collect()
    assert sorted(r["length"] for r in rows) == [1, 2, 3]
    assert all(len(r["ids"]) == r["length"] for r in rows)
