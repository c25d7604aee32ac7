"""Quality classifier on learned subword embeddings.

A document is the average of the vectors of its features: every word and every character
n-gram of the word between boundary marks, hashed into ``BUCKETS`` rows, and for each word
a mark of how it repeats in the text (equal to the word before it, or else the power of
two of its share of the text), as an average alone cannot tell a word that is said once
from one that is said a thousand times. A softmax over two classes reads the average; vectors and output are trained together by stochastic gradient
descent in numpy.

Training takes at most ``SAMPLE_ROWS`` labelled documents, those with the smallest hash of
their id, with their whole texts, in one task; that bound makes its memory and time
independent of the corpus. Scoring reads every document: the vector of a word is looked
up once per batch, and with two classes only its product with the output weights is needed.

Defined results: an empty or null text gets the score of the bias alone. Labels other than
0 and 1 and labels without a document are not used; several labels of an id count as their
largest. Without labels every score is 0.5. Repeated rows have equal scores; an empty
table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from vigilog.llm.batches import bounded_batches, column, slabs, texts_of
from vigilog.llm.hashing import BASE, U, mixed, powers, words

BUCKETS = 1 << 16
DIMENSIONS = 16
NGRAMS = (3, 4)
SAMPLE_ROWS = 6000
MARKS = 16
EPOCHS = 5
LEAST_STEPS = 30_000  # more epochs over fewer documents
RATE = 1.0
SEED = 7


def word_features(unique: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of the features of each word, in a row, and how many each word has."""
    marked = ["<" + w + ">" for w in unique]
    lengths = np.array([len(w) for w in marked])
    points = np.frombuffer("".join(marked).encode("utf-32-le", "surrogatepass"), "<u4").astype(U)
    values = mixed(points + U(1))
    begins = np.cumsum(lengths) - lengths
    place = np.arange(len(points)) - np.repeat(begins, lengths)
    whole = mixed(np.add.reduceat(values * powers(int(lengths.max()))[place], begins) ^ U(0xABCD))
    parts, owners = [whole], [np.arange(len(unique))]
    owner = np.repeat(np.arange(len(unique)), lengths)
    for n in NGRAMS:
        if len(values) < n:
            continue
        rolled = sum((values[j : len(values) - n + 1 + j] * powers(n)[j] for j in range(1, n)), values[: len(values) - n + 1].copy())
        inside = place[: len(rolled)] + n <= lengths[owner[: len(rolled)]]
        parts.append(mixed(rolled[inside] ^ U(n * int(BASE) % 2**64)))
        owners.append(owner[: len(rolled)][inside])
    buckets, owners = np.concatenate(parts), np.concatenate(owners)
    order = np.argsort(owners, kind="stable")
    return (buckets[order] % U(BUCKETS)).astype(np.int32), np.bincount(owners, minlength=len(unique))


def _words(data: np.ndarray, offsets: np.ndarray):
    """Unique words of a slab with their features, and for each word of the slab its unique one."""
    hashes, at, lengths, before = words(data, offsets, lower=False)
    _, first, which = np.unique(hashes, return_index=True, return_inverse=True)
    raw = data.tobytes()
    unique = [raw[at[i] : at[i] + lengths[i]].decode("utf-8", "replace") for i in first.tolist()]
    buckets, counts = word_features(unique) if unique else (np.zeros(0, np.int32), np.zeros(0, np.int64))
    return buckets, counts, which, before


def _marks(which: np.ndarray, before: np.ndarray) -> np.ndarray:
    """The bucket of the repetition mark of each word of a slab."""
    sizes = np.diff(before)
    doc = np.repeat(np.arange(len(sizes)), sizes)
    _, pair, times = np.unique(doc * (int(which.max(initial=0)) + 1) + which, return_inverse=True, return_counts=True)
    marks = 1 + np.clip(np.floor(np.log2(sizes[doc] / times[pair])), 0, MARKS - 2).astype(np.int64)
    same = np.zeros(len(which), bool)
    same[1:] = (which[1:] == which[:-1]) & (doc[1:] == doc[:-1])
    marks[same] = 0
    return BUCKETS + marks


def _fit(documents: list[tuple[np.ndarray, np.ndarray, int]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Vectors, output weights and bias from (buckets, shares, label) of each document."""
    rng = np.random.default_rng(SEED)
    positive = sum(y for _, _, y in documents)
    bias = np.log([len(documents) - positive + 0.5, positive + 0.5]).astype(np.float32) if documents else np.zeros(2, np.float32)
    vectors = ((rng.random((BUCKETS + MARKS, DIMENSIONS), np.float32) - 0.5) / DIMENSIONS).astype(np.float32)
    output = np.zeros((DIMENSIONS, 2), np.float32)
    epochs = max(EPOCHS, -(-LEAST_STEPS // max(len(documents), 1))) if 0 < positive < len(documents) else 0
    steps, step = epochs * len(documents), 0
    for _ in range(epochs):
        for i in rng.permutation(len(documents)):
            buckets, shares, label = documents[i]
            rate = RATE * (1 - step / steps)
            step += 1
            if not len(buckets):
                continue
            hidden = shares @ vectors[buckets]
            logits = hidden @ output + bias
            chance = np.exp(logits - logits.max())
            chance /= chance.sum()
            chance[label] -= 1
            back = output @ chance
            output -= rate * np.outer(hidden, chance)
            bias -= rate * 0.1 * chance
            vectors[buckets] -= rate * shares[:, None] * back
    return vectors, output, bias


def _trained(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    documents = []
    for batch in batches:
        for part, data, offsets in slabs(batch, "text"):
            buckets, counts, which, before = _words(data, offsets)
            ends, marks = np.cumsum(counts), _marks(which, before)
            for i, label in enumerate(part.column("label").to_pylist()):
                own, times = np.unique(which[before[i] : before[i + 1]], return_counts=True)
                if len(own):
                    repeats, often = np.unique(marks[before[i] : before[i + 1]], return_counts=True)
                    flat = np.concatenate([*[buckets[ends[u] - counts[u] : ends[u]] for u in own], repeats])
                    found, place = np.unique(flat, return_inverse=True)
                    shares = np.bincount(place, np.concatenate([np.repeat(times, counts[own]), often])).astype(np.float32)
                    documents.append((found, shares / shares.sum(), label))
                else:
                    documents.append((np.zeros(0, np.int32), np.zeros(0, np.float32), label))
    arrays = [pa.array([x.astype(np.float32).tobytes()], pa.binary()) for x in _fit(documents)]
    yield pa.RecordBatch.from_arrays(arrays, ["vectors", "output", "bias"])


class Model:
    """Trained vectors with the output layer."""

    def __init__(self, vectors: bytes, output: bytes, bias: bytes):
        self.vectors = np.frombuffer(vectors, np.float32).reshape(BUCKETS + MARKS, DIMENSIONS)
        self.output = np.frombuffer(output, np.float32).reshape(DIMENSIONS, 2)
        self.bias = np.frombuffer(bias, np.float32)

    def slopes(self) -> tuple[np.ndarray, float]:
        """What each feature adds to the log odds of class 1, before averaging, and the bias."""
        return (self.vectors @ (self.output[:, 1] - self.output[:, 0])).astype(np.float64), float(self.bias[1] - self.bias[0])


def fitted(docs: DataFrame, labels: DataFrame, learn: Column | None = None, rows: int = SAMPLE_ROWS, id_column: str = "doc_id", text_column: str = "text", label_column: str = "quality") -> Model:
    """A model of at most ``rows`` labelled documents; ``learn`` is a condition on ``doc_id`` (the id)."""
    bounded_batches(docs.sparkSession)
    known = labels.select(column(labels, id_column).alias("doc_id"), column(labels, label_column).cast("int").alias("label"))
    known = known.filter("label IN (0, 1) AND doc_id IS NOT NULL").groupBy("doc_id").agg(F.max("label").alias("label"))
    if learn is not None:
        known = known.filter(learn)
    order = F.xxhash64("doc_id", F.lit(SEED))
    chosen = known.orderBy(order, "doc_id").limit(rows)
    sample = texts_of(docs, id_column, text_column).join(F.broadcast(chosen), "doc_id")
    bounded = sample.orderBy(order, "doc_id", F.xxhash64("text")).limit(rows).select("text", "label")
    row = bounded.coalesce(1).mapInArrow(_trained, "vectors binary, output binary, bias binary").first()
    return Model(*(bytes(x) for x in row or [x.astype(np.float32).tobytes() for x in _fit([])]))


def scored(docs: DataFrame, model: Model, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """``doc_id`` and ``score``, the probability of class 1, for every document."""
    spark = docs.sparkSession
    bounded_batches(spark)
    shared = spark.sparkContext.broadcast(model.slopes())

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        slopes, bias = shared.value
        for batch in batches:
            for part, data, offsets in slabs(batch, "text"):
                buckets, counts, which, before = _words(data, offsets)
                owners = np.repeat(np.arange(len(counts)), counts)
                sums = np.bincount(owners, slopes[buckets], minlength=len(counts))
                whole = np.concatenate([[0.0], np.cumsum(sums[which] + slopes[_marks(which, before)])])
                sizes = np.concatenate([[0], np.cumsum(counts[which] + 1)])
                total, size = np.diff(whole[before]), np.diff(sizes[before])
                logit = bias + total / np.maximum(size, 1)
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(1 / (1 + np.exp(-np.clip(logit, -60, 60))))], ["doc_id", "score"])

    texts = texts_of(docs, id_column, text_column)
    return texts.mapInArrow(score, f"doc_id {texts.schema['doc_id'].dataType.simpleString()}, score double")
