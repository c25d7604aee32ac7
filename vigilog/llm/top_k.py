"""Exact top-k search by inner product, term at a time over dense score arrays.

Queries and candidates are dealt into blocks; each pair of blocks is one group, so every
query meets every candidate once and no group grows with the data. Inside a group the
candidates become postings per dimension (row and weight of each non-zero component);
a query, read as a sparse row, adds its weighted postings into one dense array of scores.
Partition selection keeps its k best, and the best of all groups are merged.

Components are turned into floor(scale * x). Sums are exact at any size: a query and a set of
candidates whose sums could leave 64 bits are added up in unbounded integers, all others in 64 bits.
A score beyond 64 bits is shown as the largest or smallest one and ranked by its true value.

Defined results: rows without id, without vector, or with a component that is null or not finite
(also after scaling) take no part. Vectors may differ in length, missing components count as 0.
A query does not find rows of its own id; repeated candidates are found repeatedly. Rows of one
query id are one query each: equal ones count once, and what unlike ones find is ranked
together under that id, ``k`` in all. An empty table gives no rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window as W, functions as F

from vigilog.llm.batches import column

# Candidates with larger components are kept apart, so that they don't slow down the others.
SMALL = 1 << 24
WHOLE = float(1 << 52)  # doubles from here on are integers
LARGEST = 2**63 - 1
QUERY_BLOCK = 1024
CANDIDATE_BLOCK = 16_384


def quantised(rows: DataFrame, id_column: str, vector_column: str, scale: int) -> DataFrame:
    """``id`` and ``vector``, integers as doubles, of the rows that take part."""
    vector = F.transform(column(rows, vector_column).cast("array<double>"), lambda x: F.lit(float(scale)) * x)
    usable = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    number = lambda x: F.when(F.abs(x) < F.lit(WHOLE), F.floor(x).cast("double")).otherwise(x)
    return rows.filter(column(rows, id_column).isNotNull() & vector.isNotNull() & usable).select(column(rows, id_column).cast("long").alias("id"), F.transform(vector, number).alias("vector"))


def integers(values: np.ndarray, wide: bool) -> np.ndarray:
    """Doubles without fractions as 64-bit or, if ``wide``, as unbounded integers."""
    return np.array([int(v) for v in values.tolist()], object) if wide else values.astype(np.int64)


class Postings:
    """For each dimension the rows and weights of its non-zero components."""

    def __init__(self, ids: np.ndarray, values: np.ndarray, lengths: np.ndarray):
        self.ids, self.most = ids, float(np.abs(values).max(initial=0.0))
        rows = np.repeat(np.arange(len(lengths)), lengths)
        terms = np.arange(len(values)) - np.repeat(np.cumsum(lengths) - lengths, lengths)
        used = np.flatnonzero(values)
        order = used[np.argsort(terms[used], kind="stable")]
        cuts = np.searchsorted(terms[order], np.arange(int(lengths.max(initial=0)) + 1)).tolist()
        self.rows = [rows[order[a:b]] for a, b in zip(cuts[:-1], cuts[1:], strict=True)]
        self.values = [values[order[a:b]] for a, b in zip(cuts[:-1], cuts[1:], strict=True)]
        self.weights: dict[bool, list[np.ndarray]] = {}

    def scores(self, query: np.ndarray) -> np.ndarray:
        """Inner products of all rows with a query."""
        wide = float(np.abs(query).sum()) * self.most >= 2.0**62
        if wide not in self.weights:
            self.weights[wide] = [integers(v, wide) for v in self.values]
        weights = self.weights[wide]
        scores = np.zeros(len(self.ids), object if wide else np.int64)
        for term, weight in enumerate(integers(query[: len(self.rows)], wide)):
            if weight:
                scores[self.rows[term]] += weight * weights[term]
        return scores


def _postings(candidates: pa.Table) -> list[Postings]:
    vectors = candidates.column("vector").combine_chunks()
    ids, values, lengths = candidates.column("id").to_numpy(), vectors.flatten().to_numpy(zero_copy_only=False), np.diff(vectors.offsets.to_numpy())
    large = np.zeros(len(ids), bool)
    large[np.repeat(np.arange(len(ids)), lengths)[np.abs(values) > SMALL]] = True
    return [Postings(ids[own], values[np.repeat(own, lengths)], lengths[own]) for own in (~large, large) if own.any()]


def order_key(score: int) -> bytes | None:
    """Bytes that sort as the scores do, for those that 64 bits don't tell apart."""
    if abs(score) < LARGEST:
        return None
    size = (abs(score).bit_length() + 7) // 8
    own = size.to_bytes(4) + abs(score).to_bytes(size)
    return b"\1" + own if score > 0 else b"\0" + bytes(255 - b for b in own)


def best(scores: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Places of the k highest scores, ties to the smaller id."""
    if len(scores) > k:
        edge = np.partition(scores, len(scores) - k)[len(scores) - k]
        places = np.flatnonzero(scores >= edge)
    else:
        places = np.arange(len(scores))
    return places[np.lexsort((ids[places], -scores[places]))[:k]]


def _search(k: int):
    def search(queries: pa.Table, candidates: pa.Table) -> pa.Table:
        found: dict[str, list] = {"query_id": [], "vec_id": [], "score": [], "key": []}
        if queries.num_rows and candidates.num_rows:
            parts = _postings(candidates)
            for own, vector in zip(queries.column("id").to_pylist(), queries.column("vector"), strict=True):
                query = np.array(vector.as_py(), np.float64)
                for part in parts:
                    others = np.flatnonzero(part.ids != own)
                    scores, ids = part.scores(query)[others], part.ids[others]
                    top = best(scores, ids, k)
                    exact = scores[top].tolist()
                    found["query_id"] += [own] * len(top)
                    found["vec_id"] += ids[top].tolist()
                    found["score"] += [max(min(s, LARGEST), -LARGEST - 1) for s in exact]
                    found["key"] += [order_key(s) for s in exact]
        return pa.table({n: pa.array(v, pa.binary() if n == "key" else pa.int64()) for n, v in found.items()})

    return search


def top_k(rows: DataFrame, queries: Column, k: int = 5, scale: int = 256, id_column: str = "vec_id", vector_column: str = "embedding") -> DataFrame:
    """``query_id``, ``rank`` (from 1), ``vec_id``, ``score`` for the rows that ``queries`` (a condition on ``id``) selects."""
    all_rows = quantised(rows, id_column, vector_column, scale)
    asked = all_rows.filter(queries).distinct()
    counts = all_rows.agg(F.count("*"), F.count_if(queries)).first()
    query_blocks, candidate_blocks = max(1, -(-counts[1] // QUERY_BLOCK)), max(1, -(-counts[0] // CANDIDATE_BLOCK))
    left = asked.withColumn("q", F.pmod(F.xxhash64("id"), F.lit(query_blocks))).withColumn("c", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(candidate_blocks - 1).cast("long"))))
    right = all_rows.withColumn("c", F.pmod(F.xxhash64("id", "vector"), F.lit(candidate_blocks))).withColumn("q", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(query_blocks - 1).cast("long"))))
    found = left.groupBy("q", "c").cogroup(right.groupBy("q", "c")).applyInArrow(_search(k), "query_id long, vec_id long, score long, key binary")
    order = W.partitionBy("query_id").orderBy(F.desc("score"), F.desc("key"), F.asc("vec_id"))
    return found.withColumn("rank", F.row_number().over(order).cast("int")).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
