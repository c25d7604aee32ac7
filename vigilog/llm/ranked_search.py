"""Ranked lexical search: a fixed set of items against all documents, equal bags scored once.

1. One pass restricts every text to the vocabulary of the items: how often it holds each of their
   terms, and how many terms it has in all. From these rows come the number of documents and of
   terms and how many documents hold each term (as many rows as the vocabulary has).
2. A document's score depends on its restricted bag and on its length class ``m`` alone. Bags with
   ``m`` are hashed to 64 bits; rows of equal hash are one class if the bags and ``m`` are equal.
   Of each class the ``k`` smallest ids are kept, limited before the shuffle, so a class
   that holds a third of all documents is no large group.
3. Classes are scored once, a block of classes against all items: each term's part is added to
   the items that hold it, in exact integers. Each task keeps the ``k`` best classes of an item by
   score and smallest id; no other class can have a document among the item's first ``k``.
4. The best classes are expanded to their members in ascending order of id.

Items are taken in blocks of about ``BLOCK_TERMS`` terms, so that what the tasks hold has a bound;
each block is a pass over the documents.

Defined results: a null text has no terms and is not counted, nor is a text without terms. Rows are
documents: repeated rows are found repeatedly and rows that share an id are ranked by their own
texts; null ids come after all others. Each row of the items is one item; without terms that a
document holds it has no rows. Empty tables give no rows. Other columns are ignored.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window as W, functions as F

from vigilog.llm.batches import bounded_batches, column, slabs, texts_of
from vigilog.session import stored

# Letters and digits of ASCII, and everything beyond it; upper case is lowered in ASCII alone.
TERM = re.compile(rb"[0-9a-z\x80-\xff]+")
BLOCK_TERMS = 200_000
PAIRS = 1 << 22
CELLS = 1 << 22
EXACT_SUM = 1 << 53
MOST_PART = 1_000_000  # what a term adds to a score is at most this times its weight
LAST = 2**63 - 1


def terms(text: bytes) -> list[bytes]:
    return TERM.findall(text.lower())


def _item_terms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        found = [sorted(set(terms((t or "").encode()))) for t in batch.column("text").to_pylist()]
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(found, pa.list_(pa.binary()))], ["item_id", "terms"])


def _bags(vocabulary):
    def bags(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = vocabulary.value.get
        for batch in batches:
            for part, data, offsets in slabs(batch, "text"):
                whole = data.tobytes()
                n, held, times = [], [], []
                for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True):
                    found = terms(whole[a:b])
                    counts = Counter(map(number, found))
                    counts.pop(None, None)
                    own = sorted(counts)
                    n.append(len(found))
                    held.append(own)
                    times.append([counts[t] for t in own])
                arrays = [part.column("doc_id"), pa.array(n, pa.int64()), pa.array(held, pa.list_(pa.int32())), pa.array(times, pa.list_(pa.int32()))]
                yield pa.RecordBatch.from_arrays(arrays, ["doc_id", "n", "terms", "times"])

    return bags


class _Best:
    """The best classes of each item so far."""

    def __init__(self, items: int, k: int):
        self.k, self.least = k, np.ones(items, np.int64)  # a score below this is of no use
        self.kept: list[np.ndarray] = [np.zeros((0, 4), np.int64)]
        self.size = 0

    def add(self, item: np.ndarray, score: np.ndarray, low: np.ndarray, bag: np.ndarray) -> None:
        self.kept.append(np.stack([item, score, low, bag], axis=1))
        self.size += len(item)
        if self.size > 4 * self.k * len(self.least):
            self.shrink()

    def shrink(self) -> np.ndarray:
        rows = np.concatenate(self.kept)
        rows = rows[np.lexsort((rows[:, 2], -rows[:, 1], rows[:, 0]))]
        first = np.searchsorted(rows[:, 0], rows[:, 0])
        place = np.arange(len(rows)) - first
        edge = place == self.k - 1
        self.least[rows[edge, 0]] = rows[edge, 1]
        rows = rows[place < self.k]
        self.kept, self.size = [rows], 0
        return rows


def _scored(state, k: int):
    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weights, begins, items, count = state.value  # per term: weight, place of its items
        exact = int(np.bincount(items, np.repeat(weights, np.diff(begins)), count).max(initial=0)) * MOST_PART < EXACT_SUM
        best = _Best(count, k)
        for batch in batches:
            held, times = batch.column("terms"), batch.column("times")
            sizes = held.value_lengths().to_numpy().astype(np.int64)
            term, tf = held.flatten().to_numpy().astype(np.int64), times.flatten().to_numpy().astype(np.int64)
            m, low, bag = (batch.column(c).to_numpy() for c in ("m", "low", "bag"))
            part = 1_000_000_000 * tf // (1000 * tf + 20 * np.repeat(m, sizes)) * weights[term]
            owner, width = np.repeat(np.arange(len(sizes)), sizes), begins[term + 1] - begins[term]
            pairs = np.concatenate([[0], np.cumsum(np.bincount(owner, width, len(sizes)).astype(np.int64))])
            at, ends = 0, np.concatenate([[0], np.cumsum(sizes)])
            while at < len(sizes):
                to = max(at + 1, min(int(np.searchsorted(pairs, pairs[at] + PAIRS, "right")) - 1, at + max(1, CELLS // count)))
                own = slice(int(ends[at]), int(ends[to]))
                spread = np.repeat(begins[term[own]] - np.cumsum(width[own]) + width[own], width[own]) + np.arange(int(width[own].sum()))
                cell = np.repeat((owner[own] - at) * count, width[own]) + items[spread]
                values = np.repeat(part[own], width[own])
                if exact:
                    scores = np.bincount(cell, values, (to - at) * count).astype(np.int64)
                else:  # doubles hold the sums of either half
                    scores = np.bincount(cell, values >> 24, (to - at) * count).astype(np.int64) << 24
                    scores += np.bincount(cell, values & 0xFFFFFF, (to - at) * count).astype(np.int64)
                scores = scores.reshape(-1, count)
                row, item = np.nonzero(scores >= best.least)
                best.add(item, scores[row, item], low[at + row], bag[at + row])
                at = to
        rows = best.shrink()
        yield pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(rows[:, i])) for i in range(4)], ["item", "score", "low", "bag"])

    return scored


def _postings(items: list[list[bytes]]) -> tuple[dict[bytes, int], np.ndarray, np.ndarray]:
    """Numbers of the terms, and for each the items that hold it."""
    vocabulary = {t: i for i, t in enumerate(sorted({t for own in items for t in own}))}
    term = np.array([vocabulary[t] for own in items for t in own], np.int64)
    item = np.repeat(np.arange(len(items)), [len(own) for own in items])
    order = np.argsort(term, kind="stable")
    return vocabulary, np.searchsorted(term[order], np.arange(len(vocabulary) + 1)), item[order]


def _block(texts: DataFrame, items: list[tuple], item_type: str, k: int) -> DataFrame:
    """Result rows of a bounded number of items (id, distinct terms)."""
    spark = texts.sparkSession
    vocabulary, begins, holders = _postings([own for _, own in items])
    shared = spark.sparkContext.broadcast(vocabulary)
    id_type = texts.schema["doc_id"].dataType.simpleString()
    bags = stored(texts.mapInArrow(_bags(shared), f"doc_id {id_type}, n long, terms array<int>, times array<int>"))
    documents, length = bags.agg(F.count_if(F.col("n") > 0), F.coalesce(F.sum("n"), F.lit(0))).first()
    found = {r["term"]: r["count"] for r in bags.select(F.explode("terms").alias("term")).groupBy("term").count().collect()}  # at most the vocabulary
    weights = np.array([math.floor(1000 * math.log((2 * documents + 2) / (2 * found.get(t, 0) + 1))) for t in range(len(vocabulary))], np.int64)

    m = F.expr(f"100 - 50 + ((50 * n * {documents}L) div {max(length, 1)}L)")
    bags = bags.filter(F.size("terms") > 0).withColumns({"m": m, "place": F.coalesce(F.col("doc_id").cast("long"), F.lit(LAST))})
    bags = bags.withColumn("bag", F.xxhash64("m", "terms", "times"))
    same = W.partitionBy("bag", "m", "terms", "times").orderBy("place")
    members = bags.withColumn("number", F.row_number().over(same)).filter(F.col("number") <= k).withColumn("low", F.first("place").over(same))
    members = stored(members.select("doc_id", "place", "bag", "low", "number", "m", F.when(F.col("number") == 1, F.col("terms")).alias("terms"), F.when(F.col("number") == 1, F.col("times")).alias("times")))

    state = spark.sparkContext.broadcast((weights, begins, holders, len(items)))
    classes = members.filter("number = 1").select("low", "bag", "m", "terms", "times")
    best = classes.mapInArrow(_scored(state, k), "item long, score long, low long, bag long")
    ranked = best.withColumn("rank", F.row_number().over(W.partitionBy("item").orderBy(F.desc("score"), "low", "bag"))).filter(F.col("rank") <= k)
    rows = ranked.drop("rank").join(members.select("bag", "low", "place", "doc_id"), ["bag", "low"])
    rows = rows.withColumn("rank", F.row_number().over(W.partitionBy("item").orderBy(F.desc("score"), "place")).cast("int")).filter(F.col("rank") <= k)
    names = spark.createDataFrame([(i, own) for i, (own, _) in enumerate(items)], f"item long, item_id {item_type}")
    return rows.join(F.broadcast(names), "item").select("item_id", "rank", "doc_id", "score")


def ranked_documents(docs: DataFrame, items: DataFrame, k: int = 50, id_column: str = "doc_id", text_column: str = "text", item_column: str = "item_id", item_text_column: str = "text") -> DataFrame:
    """``item_id``, ``rank`` (from 1), ``doc_id``, ``score`` of the ``k`` best documents of each item."""
    spark = docs.sparkSession
    bounded_batches(spark)
    asked = texts_of(items, item_column, item_text_column)
    item_type = asked.schema["doc_id"].dataType.simpleString()
    asked = stored(asked.mapInArrow(_item_terms, f"item_id {item_type}, terms array<binary>").filter(F.size("terms") > 0))
    blocks = (asked.agg(F.sum(F.size("terms").cast("long"))).first()[0] or 0) // BLOCK_TERMS + 1
    texts = texts_of(docs, id_column, text_column)
    out = None
    for block in range(blocks):
        own = asked.filter(F.pmod(F.xxhash64("item_id", "terms"), F.lit(blocks)) == block).orderBy("item_id", "terms").collect()  # about BLOCK_TERMS terms
        rows = _block(texts, [(r["item_id"], [bytes(t) for t in r["terms"]]) for r in own], item_type, k) if own else None
        out = out.unionAll(rows) if out and rows else rows or out
    if out is None:
        id_type = texts.schema["doc_id"].dataType.simpleString()
        out = spark.createDataFrame([], f"item_id {item_type}, rank int, doc_id {id_type}, score long")
    return out
