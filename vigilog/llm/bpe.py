"""Byte-level BPE by backtracking: texts to token ids, and ids back to texts.

Two adjacent tokens are compatible if merging their bytes from scratch ends at these two tokens
again, and a sequence of tokens is what the merge rules give exactly if all its neighbours are
compatible. So no merge is ever carried out:

1. An Aho-Corasick automaton over the vocabulary gives the longest token that begins at every
   byte of a piece, in one pass.
2. From the left, the longest token is taken if it is compatible with the token before it, else
   its longest prefix that is a token, and so on. Where none fits, the token before is given up
   and the place marked as a dead end, which is never tried again; so the time is linear in the
   piece, however long it is.
3. Compatibility undoes the last merges on both sides of the boundary, latest first, and asks
   whether a pair that stood there would have been merged earlier. Answers are kept in a table.

Decoding reads the bytes of each id from one array by an offset table.

Pieces are what the tokenizer's pattern cuts a text into. White space is cut first, since it
needs no letter classes, and each worker remembers the ids of what it has met, in two generations
of bounded size. Names of added tokens in a text become their ids, as in the tokenizers library.

Defined results: a null text is empty and has no ids; null ids are an empty text. Ids that the
vocabulary lacks and null elements are skipped; bytes that are no UTF-8 become U+FFFD. Repeated
rows, equal or null row ids and further columns change nothing; an empty table gives no rows.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from vigilog.llm.batches import bounded_batches, column, slabs, texts_of
from vigilog.llm.tokens import BYTE_CHARACTERS

REMEMBERED = 300_000
REMEMBERED_BYTES = 64
PAIRS = 1_000_000
DECODED_IDS = 1 << 20

# Fixed values of the byte-level pre-tokenizer: its pattern and its white space.
PIECE = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+")
WIDE_SPACE = re.compile(rb"\xc2[\x85\xa0]|\xe1\x9a\x80|\xe2\x80[\x80-\x8a\xa8\xa9\xaf]|\xe2\x81\x9f|\xe3\x80\x80")
COARSE = re.compile(rb" ?[^\t-\r ]+|[\t-\r ]+(?![^\t-\r ])|[\t-\r ]")


class Vocabulary:
    """Tokens of a byte-level BPE file with what the merge rules say about them."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as file:
            content = json.load(file)
        ids, merges = content["model"]["vocab"], content["model"]["merges"]
        byte_of = {chr(b): b for b in range(256)} | {c: b for b, c in BYTE_CHARACTERS.items()}
        size = max([*ids.values(), *(x["id"] for x in content["added_tokens"])]) + 1
        self.bytes: list[bytes] = [b""] * size
        for name, own in ids.items():
            self.bytes[own] = bytes(byte_of[c] for c in name) if all(c in byte_of for c in name) else name.encode()
        # The rank of the merge that makes a token (-1: none does) and the two tokens that it merges.
        self.made, self.head, self.tail = [-1] * size, [-1] * size, [-1] * size
        self.rank: dict[tuple[int, int], int] = {}
        for rank, pair in enumerate(merges):
            left, right = pair.split(" ") if isinstance(pair, str) else pair
            own = ids[left + right]
            if self.made[own] >= 0:
                raise ValueError(f"two merges make {left + right!r}")
            self.rank[ids[left], ids[right]] = rank
            self.made[own], self.head[own], self.tail[own] = rank, ids[left], ids[right]
        usable = [own for own in ids.values() if self.made[own] >= 0 or len(self.bytes[own]) == 1]
        self.id_of = {self.bytes[own]: own for own in usable}
        if len(self.id_of) < len(usable) or any(bytes([b]) not in self.id_of for b in range(256)):
            raise ValueError("tokens must differ, and every byte must be one")
        self.length = [len(b) for b in self.bytes]
        # The longest proper prefix of a token that is a token.
        self.shorter = [-1] * size
        for own in usable:
            whole = self.bytes[own]
            for n in range(len(whole) - 1, 0, -1):
                if whole[:n] in self.id_of:
                    self.shorter[own] = self.id_of[whole[:n]]
                    break
        self.automaton = ahocorasick.Automaton()
        for whole, own in self.id_of.items():
            self.automaton.add_word(whole.decode("latin-1"), own)
        self.automaton.make_automaton()
        self.added = {x["content"].encode(): x["id"] for x in content["added_tokens"]}
        for name, own in self.added.items():
            self.bytes[own] = name
        self.compatible: dict[tuple[int, int], bool] = {}

    def unreachable(self) -> list[bytes]:
        """Tokens whose own bytes the merges don't turn into that token; the method needs that there are none."""
        whole = [rank >= 0 or n == 1 for rank, n in zip(self.made, self.length, strict=True)]
        made = [(own, self.head[own], self.tail[own], rank) for own, rank in enumerate(self.made) if rank >= 0]
        return [self.bytes[own] for own, head, tail, rank in made if not (whole[head] and whole[tail] and max(self.made[head], self.made[tail]) < rank and self.apart(head, tail, rank))]

    def apart(self, left: int, right: int, before: int | None = None) -> bool:
        """Whether the bytes of two tokens in a row become these two tokens again.

        ``before``: only merges of lower rank than this are asked about.
        """
        made, rank = self.made, self.rank
        limit = len(rank) if before is None else before
        while True:
            if rank.get((left, right), limit) < limit:
                return False
            # The pair at the boundary was there until the earlier of its two last merges: undo the
            # later one first. Of equal ones the left one came first, and it came before the pair itself.
            if made[left] > made[right]:
                limit, left = min(limit, made[left]), self.tail[left]
            elif made[right] >= 0:
                limit, right = min(limit, made[right] + 1), self.head[right]
            else:
                return True

    def _fit(self, pair: tuple[int, int]) -> bool:
        if len(self.compatible) >= PAIRS:
            self.compatible.clear()
        self.compatible[pair] = found = self.apart(*pair)
        return found

    def encode(self, piece: bytes) -> list[int]:
        """Ids of one piece (not empty)."""
        if piece in self.id_of:
            return [self.id_of[piece]]
        length, shorter, known = self.length, self.shorter, self.compatible
        longest = [0] * (len(piece) + 1)
        for end, own in self.automaton.iter(piece.decode("latin-1")):
            longest[end + 1 - length[own]] = own  # later ends are longer
        open_ = bytearray(b"\1") * (len(piece) + 1)
        out: list[int] = []
        at, token = 0, longest[0]
        while at < len(piece):
            end = at + length[token]
            if open_[end]:
                pair = (out[-1], token) if out else None
                fits = pair is None or known.get(pair)
                if fits is None:
                    fits = self._fit(pair)
                if fits:
                    out.append(token)
                    at, token = end, longest[end]
                    continue
            token = shorter[token]
            while token < 0:  # nothing fits here: give up the token before
                open_[at] = 0
                given = out.pop()
                at -= length[given]
                token = shorter[given]
        return out


class TextIds:
    """Ids of whole texts as little-endian 32-bit bytes."""

    def __init__(self, path: str):
        self.vocabulary = Vocabulary(path)
        self.new: dict[bytes, bytes] = {}
        self.old: dict[bytes, bytes] = {}
        names = sorted(self.vocabulary.added, key=len, reverse=True)
        self.names = re.compile(b"(" + b"|".join(map(re.escape, names)) + b")") if names else None

    def _piece(self, piece: bytes) -> bytes:
        found = self.new.get(piece) or self.old.get(piece)
        if found is None:
            found = np.array(self.vocabulary.encode(piece), "<u4").tobytes()
            self._put(piece, found)
        return found

    def _put(self, piece: bytes, ids: bytes) -> None:
        if len(piece) > REMEMBERED_BYTES:
            return
        if len(self.new) >= REMEMBERED:
            self.old, self.new = self.new, {}
        self.new[piece] = ids

    def _fine(self, text: bytes) -> bytes:
        return b"".join([self._piece(x.encode()) for x in PIECE.findall(text.decode("utf-8", "replace"))])

    def _learn(self, chunk: bytes) -> bytes:
        found = self._fine(chunk)
        if chunk not in self.new:
            self._put(chunk, found)
        return found

    def __call__(self, texts: list[bytes]) -> list[bytes]:
        """Ids of every text; texts in a call share the look-up of what they have in common."""
        parts: list[list[bytes]] = []  # added tokens at odd places
        for text in texts:
            parts.append(self.names.split(text) if self.names and self.names.search(text) else [text])
        chunks = [[None if i % 2 or WIDE_SPACE.search(x) else COARSE.findall(x) for i, x in enumerate(own)] for own in parts]
        new, old = self.new.get, self.old.get
        known = {x: new(x) or old(x) for x in set().union(*(x for own in chunks for x in own if x is not None))}
        for x, found in known.items():
            if found is None:
                known[x] = self._learn(x)
        out = []
        for own, cut in zip(parts, chunks, strict=True):
            whole = []
            for i, (part, pieces) in enumerate(zip(own, cut, strict=True)):
                if pieces is not None:
                    whole.extend([known[x] for x in pieces])
                elif i % 2:
                    whole.append(np.array([self.vocabulary.added[part]], "<u4").tobytes())
                else:
                    whole.append(self._fine(part))
            out.append(b"".join(whole))
        return out


class IdTexts:
    """Bytes of ids, read from one array by an offset table."""

    def __init__(self, vocabulary: Vocabulary):
        self.blob = np.frombuffer(b"".join(vocabulary.bytes), np.uint8)
        self.offsets = np.concatenate([[0], np.cumsum([len(b) for b in vocabulary.bytes])])

    def __call__(self, ids: np.ndarray) -> bytes:
        out = []
        for at in range(0, len(ids), DECODED_IDS):
            own = ids[at : at + DECODED_IDS]
            own = own[(own >= 0) & (own < len(self.offsets) - 1)]
            lengths = self.offsets[own + 1] - self.offsets[own]
            begins = np.cumsum(lengths) - lengths
            out.append(self.blob[np.repeat(self.offsets[own] - begins, lengths) + np.arange(int(lengths.sum()))].tobytes())
        return b"".join(out)


_encoders: dict[str, TextIds] = {}
_decoders: dict[str, IdTexts] = {}


def encoder(path: str) -> TextIds:
    """This worker's encoder of a tokenizer file."""
    if path not in _encoders:
        _encoders[path] = TextIds(path)
    return _encoders[path]


def decoder(path: str) -> IdTexts:
    """This worker's decoder of a tokenizer file."""
    if path not in _decoders:
        _decoders[path] = IdTexts(_encoders[path].vocabulary if path in _encoders else Vocabulary(path))
    return _decoders[path]


def _lists(parts: list[np.ndarray]) -> pa.ListArray:
    offsets = np.concatenate([[0], np.cumsum([len(x) for x in parts])]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(parts) if parts else np.zeros(0, np.int32)))


def _encoded(path: str):
    def encoded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids_of = encoder(path)
        for batch in batches:
            for part, data, offsets in slabs(batch, "text"):
                whole = data.tobytes()
                found = ids_of([whole[a:b] for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)])
                ids = _lists([np.frombuffer(x, "<u4").astype(np.int32) for x in found])
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), ids], ["doc_id", "ids"])

    return encoded


def _decoded(path: str):
    def decoded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        text_of = decoder(path)
        for batch in batches:
            ids = batch.column("ids")
            values = ids.flatten().fill_null(-1).to_numpy(zero_copy_only=False)
            ends = np.cumsum(ids.value_lengths().fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64))
            begins = np.concatenate([[0], ends[:-1]])
            texts = [text_of(values[a:b]).decode("utf-8", "replace") for a, b in zip(begins.tolist(), ends.tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), ids, pa.array(texts, pa.string())], ["doc_id", "ids", "text"])

    return decoded


def encoded(docs: DataFrame, path: str, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """``doc_id`` and ``ids`` of every text. Raises where the vocabulary does not allow the method."""
    if lost := Vocabulary(path).unreachable():
        raise ValueError(f"merges never end at {lost[:3]}")
    bounded_batches(docs.sparkSession)
    texts = texts_of(docs, id_column, text_column)
    return texts.mapInArrow(_encoded(path), f"doc_id {texts.schema['doc_id'].dataType.simpleString()}, ids array<int>")


def decoded(rows: DataFrame, path: str, id_column: str = "doc_id", ids_column: str = "ids") -> DataFrame:
    """``doc_id``, ``ids`` and the ``text`` that they stand for."""
    bounded_batches(rows.sparkSession)
    lists = rows.select(column(rows, id_column).alias("doc_id"), column(rows, ids_column).cast("array<int>").alias("ids"))
    return lists.mapInArrow(_decoded(path), f"doc_id {lists.schema['doc_id'].dataType.simpleString()}, ids array<int>, text string")
