"""BPE encoding and decoding against the tokenizers library and against merging pair by pair."""

import hashlib
import json
import random

import numpy as np
import public_tokenizers
from hypothesis import given, settings, strategies as st
from tokenizers import Tokenizer

from vigilog.llm.bpe import IdTexts, TextIds, Vocabulary, decoded, encoded
from vigilog.llm.bpe_query import op11_bpe

PATH = public_tokenizers.path("byte_bpe_50k.json")
TOKENIZER = Tokenizer.from_file(PATH)
VOCABULARY = Vocabulary(PATH)
encode, decode = TextIds(PATH), IdTexts(VOCABULARY)


def ids(found: bytes) -> list[int]:
    return np.frombuffer(found, "<u4").tolist()


@settings(max_examples=400, deadline=None)
@given(st.lists(st.one_of(st.text(max_size=30), st.text(alphabet="abels'tré 　\t\n\u0085\x1c\x1f _1٣-日🙂.,", max_size=60)), max_size=4))
def test_ids_and_texts_are_those_of_the_library(texts):
    texts = [t.encode("utf-8", "replace").decode() for t in texts]
    for text, found in zip(texts, encode([t.encode() for t in texts]), strict=True):
        own = TOKENIZER.encode(text, add_special_tokens=False).ids
        assert ids(found) == own
        assert decode(np.array(own, np.int64)).decode() == text == TOKENIZER.decode(own, skip_special_tokens=False)


def test_names_of_added_tokens():
    for text in ["<|endoftext|>", " a <|endoftext|> b", "x<|endoftext|><|endoftext|>\n\n y", "<|endoftext", "a  <|endoftext|>  b"]:
        assert ids(encode([text.encode()])[0]) == TOKENIZER.encode(text, add_special_tokens=False).ids


def merged(piece: bytes) -> list[int]:
    """The merge rules as they stand: the pair of least rank, the leftmost of equal ones, again and again."""
    out = [VOCABULARY.id_of[bytes([b])] for b in piece]
    while True:
        least = min(((VOCABULARY.rank[pair], i) for i, pair in enumerate(zip(out, out[1:], strict=False)) if pair in VOCABULARY.rank), default=None)
        if least is None:
            return out
        i = least[1]
        out[i : i + 2] = [VOCABULARY.id_of[VOCABULARY.bytes[out[i]] + VOCABULARY.bytes[out[i + 1]]]]


@settings(max_examples=300, deadline=None)
@given(st.one_of(st.binary(min_size=1, max_size=40), st.text(alphabet="aeinorst", min_size=1, max_size=60).map(str.encode), st.integers(1, 50).map(lambda n: b"a" * n)))
def test_backtracking_ends_where_merging_ends(piece):
    assert VOCABULARY.encode(piece) == merged(piece)


def test_every_token_is_reachable():
    assert VOCABULARY.unreachable() == []


def test_long_pieces_take_linear_time():
    rng = random.Random(5)
    for text in ["a" * 300_000, "ab" * 150_000, "".join(rng.choice("etaoinshr") for _ in range(300_000))]:
        own = ids(encode([text.encode()])[0])
        assert own[:50] == TOKENIZER.encode(text[:3000], add_special_tokens=False).ids[:50]
        assert decode(np.array(own)) == text.encode()


def test_vocabularies_that_do_not_fit_the_method(tmp_path):
    content = json.load(open(PATH, encoding="utf-8"))
    content["model"]["merges"] = [m for m in content["model"]["merges"] if m not in ("t h", ["t", "h"])]
    path = tmp_path / "lacking.json"
    path.write_text(json.dumps(content), encoding="utf-8")
    assert Vocabulary(str(path)).unreachable()  # tokens made from "th" end elsewhere


def test_edge_cases(spark):
    rows = [(1, None, "x"), (2, "", "y"), (3, "a  b\n\n c ", "z"), (3, "a  b\n\n c ", "z"), (None, "It's <|endoftext|> über 12", None), (5, "word " * 60_000, "")]
    docs = spark.createDataFrame(rows, "id long, body string, ids string").repartition(3)
    found = decoded(encoded(docs, PATH, "id", "body"), PATH).collect()
    assert sorted((r["doc_id"] or 0, r["text"], r["ids"]) for r in found) == sorted((a or 0, b or "", TOKENIZER.encode(b or "", add_special_tokens=False).ids) for a, b, _ in rows)
    none = spark.createDataFrame([], "doc_id long, text string")
    assert encoded(none, PATH).count() == 0
    odd = spark.createDataFrame([(1, None), (2, [64, None, 99_999_999, -5, 65]), (3, []), (4, [128])], "doc_id long, ids array<int>")
    assert {r["doc_id"]: r["text"] for r in decoded(odd, PATH).collect()} == {1: "", 2: "ab", 3: "", 4: TOKENIZER.decode([128], skip_special_tokens=False)}


def test_query_over_all_documents(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    expected = []
    for r in docs.collect():
        own = TOKENIZER.encode(r["text"] or "", add_special_tokens=False).ids
        text = TOKENIZER.decode(own, skip_special_tokens=False)
        expected.append((r["doc_id"], len(own), hashlib.sha256(",".join(map(str, own)).encode()).hexdigest(), hashlib.sha256(text.encode()).hexdigest()))
    found = op11_bpe(spark, sf_dir)
    assert found.columns == ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
    assert sorted(tuple(r) for r in found.collect()) == sorted(expected)
