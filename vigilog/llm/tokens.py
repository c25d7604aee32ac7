"""Token ids of whole texts, cut into pieces of bounded length.

The tokenizer drops white space, never joins characters across it, lower-cases, and ends a
token between a letter and a mark such as a full stop. So texts are lower-cased and parted
there first, and the ids of a text are those of its parts in a row, which repeat far more
often than words as they stand. Each worker remembers what it has met in two generations of
bounded size, across its tasks.
"""

from __future__ import annotations

import os
import re
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from vigilog.llm.batches import bounded_batches, slabs, texts_of

REMEMBERED = 500_000
LONG_WORD = 64
SLAB_BYTES = 8 << 20
CLOSING = b".,;:!?"
#: A letter before a closing mark; a blank between them changes no id.
LETTER_BEFORE_MARK = re.compile(rb"([a-z])(?=[.,;:!?])")
#: A mark after anything but a letter (ASCII, or the Latin ones of two bytes), a digit or white space.
ODD_MARK = re.compile(rb"[.,;:!?](?<![a-z0-9\x09-\x0D\x20].)(?<!\xc3[\x80-\x96\x98-\xb6\xb8-\xbf].)")


def _byte_characters() -> dict[int, str]:
    """The character that stands for each byte in a byte-level vocabulary, where it is another one:
    bytes without a visible Latin-1 character get those from 256 on, in order."""
    visible = {*range(33, 127), *range(161, 173), *range(174, 256)}
    return {b: chr(256 + i) for i, b in enumerate(x for x in range(256) if x not in visible)}


BYTE_CHARACTERS = _byte_characters()


class _Memory:
    """The newest entries: a full generation becomes the old one, the old one is forgotten."""

    def __init__(self, size: int):
        self.size, self.new, self.old = size, {}, {}

    def put(self, key: bytes, value: bytes) -> None:
        if len(self.new) >= self.size:
            self.old, self.new = self.new, {}
        self.new[key] = value


class WordIds:
    """Ids of texts as little-endian 32-bit bytes."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark runs a task per core
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.model = self.tokenizer.model
        self.words = _Memory(REMEMBERED)

    def _encoded(self, parts: list[bytes]) -> list[bytes]:
        found = self.tokenizer.encode_batch_fast([p.decode("utf-8", "replace") for p in parts], add_special_tokens=False)
        return [np.array(x.ids, "<u4").tobytes() for x in found]

    def _letters(self, word: bytes) -> bytes:
        """Ids of lower-case letters: one word for the tokenizer, so its model is asked at once."""
        text = word.decode("latin-1")
        found = self.model.tokenize(text if word.isascii() else text.translate(BYTE_CHARACTERS))
        return array("I", [x.id for x in found]).tobytes()

    def _learn(self, words: list[bytes]) -> dict[bytes, bytes]:
        """Ids of words that are not remembered."""
        plain, parts, other = {}, {}, set()
        for w in words:
            if w.isalpha() and w.islower():  # of bytes: ASCII letters
                plain[w] = w
                continue
            stem = w.rstrip(CLOSING)
            text = stem.decode("utf-8", "replace")
            if not text.isalpha() or max(text) >= "\u0100":  # more than Latin letters and marks after them
                parts[w] = b"", w
            else:
                plain[stem] = text.lower().encode()
                parts[w] = stem, w[len(stem) :]
            other.add(parts[w][1])
        letters = self._letters
        out = {w: letters(lower) for w, lower in plain.items()}
        out[b""] = b""
        other.discard(b"")
        rests = list(other)
        after = {b"": b""} | dict(zip(rests, self._encoded(rests), strict=True))
        out.update([(w, out[stem] + after[rest]) for w, (stem, rest) in parts.items()])
        del out[b""]
        for w, ids in out.items():
            if len(w) <= LONG_WORD:
                self.words.put(w, ids)
        return out

    def __call__(self, texts: list[bytes]) -> list[bytes]:
        lists = [self._parted(t) for t in texts]
        unique = set().union(*lists)  # bytes are split at ASCII white space only
        new, old = self.words.new.get, self.words.old.get
        known = {w: new(w) or old(w) for w in unique}
        known.update(self._learn([w for w, ids in known.items() if ids is None]))
        ids_of = known.__getitem__
        return [b"".join(map(ids_of, words)) for words in lists]

    @staticmethod
    def _parted(text: bytes) -> list[bytes]:
        if b"<|" in text:  # the name of a special token would become one by lower-casing
            return text.split()
        lower = text.lower()
        if ODD_MARK.search(lower):
            return LETTER_BEFORE_MARK.sub(rb"\1 ", lower).split()
        for mark in (b".", b",", b";", b":", b"!", b"?"):
            lower = lower.replace(mark, b" " + mark)
        return lower.split()


_own: dict[str, WordIds] = {}


def word_ids(path: str) -> WordIds:
    """This worker's encoder of a tokenizer file."""
    if path not in _own:
        _own[path] = WordIds(path)
    return _own[path]


def _pieces(path: str, end_id: int, most: int, keep_ids: bool):
    end = np.array([end_id], "<u4").tobytes()

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids_of = word_ids(path)
        for batch in batches:
            for part, data, offsets in slabs(batch, "text", SLAB_BYTES):
                whole = data.tobytes()
                encoded = ids_of([whole[a:b] for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)])
                row, number, start, length, crc, ids = [], [], [], [], [], []
                for i, own in enumerate(encoded):
                    own += end
                    for k, at in enumerate(range(0, len(own), 4 * most)):
                        cut = own[at : at + 4 * most]
                        row.append(i)
                        number.append(k)
                        start.append(at // 4)
                        length.append(len(cut) // 4)
                        crc.append(zlib.crc32(cut))
                        if keep_ids:
                            ids.append(np.frombuffer(cut, "<u4").astype(np.int32))
                arrays = [part.column("doc_id").take(pa.array(row, pa.int64())), pa.array(number, pa.int32()), pa.array(start, pa.int64()), pa.array(length, pa.int64()), pa.array(crc, pa.int64())]
                names = ["doc_id", "piece", "start", "length", "ids_crc32"]
                if keep_ids:
                    arrays.append(pa.array(ids, pa.list_(pa.int32())))
                    names.append("ids")
                yield pa.RecordBatch.from_arrays(arrays, names)

    return pieces


def token_pieces(docs: DataFrame, path: str, end_id: int = 1, most: int = 4096, keep_ids: bool = True, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """``doc_id``, ``piece``, ``start``, ``length``, ``ids_crc32`` and, if asked for, ``ids``.

    A text's ids are followed by ``end_id``; only texts of more than ``most`` ids are cut.
    """
    bounded_batches(docs.sparkSession)
    texts = texts_of(docs, id_column, text_column)
    schema = f"doc_id {texts.schema['doc_id'].dataType.simpleString()}, piece int, start long, length long, ids_crc32 long" + ", ids array<int>" * keep_ids
    return texts.mapInArrow(_pieces(path, end_id, most, keep_ids), schema)
