"""Best-fit packing by minimum bin slack.

The plan needs only how many pieces there are of each length, at most as many counts as a
sequence has tokens. Sequence by sequence, the longest piece left is put in and a
subset-sum over the lengths left (a bitset of reachable sums) finds the fullest feasible
completion, which is then removed. A combination is repeated for as many sequences as its
counts allow in one step, so the plan does not grow with the number of pieces: each step
uses up the supply of a length.

Pieces are then numbered within their length: counts of small random parts of a length
give each part its first number, and a window numbers the pieces of a part. The number
leads to the sequence and the offset. A length that a third of all pieces share is
many parts, so no task holds it whole.

Defined results: a null text is empty and has the end id alone; repeated rows are packed
as often as they come; an empty table gives no rows. Pieces longer than a sequence raise.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window as W, functions as F

from vigilog.session import stored

PART_ROWS = 500
PARTS = 100_000


def fullest(counts: dict[int, int], room: int) -> list[tuple[int, int]]:
    """Lengths with their number that fill ``room`` as far as the supply allows."""
    reached, steps = 1, []
    target, mask = 1 << room, (1 << (room + 1)) - 1
    for length in sorted((x for x in counts if x <= room), reverse=True):
        left, unit = min(counts[length], room // length), 1
        while left:
            unit = min(unit, left)
            steps.append((length, unit, reached))
            reached |= (reached << (length * unit)) & mask
            left -= unit
            unit *= 2
            if reached & target:
                break
        if reached & target:
            break
    at = reached.bit_length() - 1
    used: dict[int, int] = {}
    for length, unit, before in reversed(steps):
        if not before >> at & 1:
            at -= length * unit
            used[length] = used.get(length, 0) + unit
    return list(used.items())


def slack_plan(counts: dict[int, int], capacity: int) -> list[tuple[int, int, int, int, int, int]]:
    """Rows (length, first number, pieces, uses in a sequence, first sequence, offset)."""
    left = {n: c for n, c in counts.items() if c}
    given = dict.fromkeys(left, 0)
    rows, sequence = [], 0
    for longest in sorted(left, reverse=True):
        while left.get(longest):
            left[longest] -= 1
            rest = dict(fullest({n: c for n, c in left.items() if c}, capacity - longest))
            left[longest] += 1
            rest[longest] = rest.get(longest, 0) + 1
            times = min(left[n] // k for n, k in rest.items())
            offset = 0
            for n, k in sorted(rest.items(), reverse=True):
                rows.append((n, given[n], times * k, k, sequence, offset))
                given[n] += times * k
                left[n] -= times * k
                offset += n * k
            sequence += times
    return rows


def _placed(plan: list[tuple[int, int, int, int, int, int]]):
    table = np.array(sorted(plan), np.int64).reshape(-1, 6)

    def placed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first = {int(n): int(i) for i, n in reversed(list(enumerate(table[:, 0])))}
        last = {int(n): i + 1 for i, n in enumerate(table[:, 0])}
        for batch in batches:
            lengths, numbers = batch.column("length").to_numpy(), batch.column("number").to_numpy()
            at = np.zeros(len(lengths), np.int64)
            order = np.argsort(lengths, kind="stable")
            cuts = [0, *(np.flatnonzero(np.diff(lengths[order])) + 1).tolist(), len(order)]
            for a, b in zip(cuts[:-1], cuts[1:], strict=True):
                if a < b:
                    own, n = order[a:b], int(lengths[order[a]])
                    at[own] = first[n] + np.searchsorted(table[first[n] : last[n], 1], numbers[own], side="right") - 1
            within = numbers - table[at, 1]
            names = [n for n in batch.schema.names if n != "number"]
            arrays = [batch.column(n) for n in names]
            arrays += [pa.array(table[at, 4] + within // table[at, 3]), pa.array(table[at, 5] + within % table[at, 3] * lengths)]
            yield pa.RecordBatch.from_arrays(arrays, [*names, "sequence_id", "offset"])

    return placed


def packed(pieces: DataFrame, capacity: int = 4096) -> DataFrame:
    """``pieces`` (with ``doc_id``, ``piece``, ``start`` and ``length``, stored) with ``sequence_id`` and ``offset``."""
    counts = {r["length"]: r["count"] for r in pieces.groupBy("length").count().collect()}  # at most ``capacity`` rows
    if counts and max(counts) > capacity:
        raise ValueError(f"a piece of {max(counts)} tokens does not fit in {capacity}")
    spark = pieces.sparkSession
    part_rows = max(PART_ROWS, sum(counts.values()) // PARTS)
    parts = spark.createDataFrame([(n, -(-c // part_rows)) for n, c in counts.items()], "length long, _parts long")
    dealt = pieces.join(F.broadcast(parts), "length").withColumn("_part", F.pmod(F.xxhash64("doc_id", "piece", "start"), "_parts")).drop("_parts")
    sizes = dealt.groupBy("length", "_part").agg(F.count("*").alias("_rows"))  # at most PARTS + capacity rows
    begins = sizes.withColumn("_begin", F.sum("_rows").over(W.partitionBy("length").orderBy("_part")) - F.col("_rows")).drop("_rows")
    numbered = dealt.withColumn("_at", F.row_number().over(W.partitionBy("length", "_part").orderBy("doc_id", "piece")) - 1)
    numbered = numbered.join(begins, ["length", "_part"]).withColumn("number", F.col("_begin") + F.col("_at")).drop("_begin", "_at", "_part")
    names = [c for c in numbered.columns if c != "number"]
    schema = ", ".join(f"`{n}` {numbered.schema[n].dataType.simpleString()}" for n in names) + ", sequence_id long, offset long"
    return numbered.mapInArrow(_placed(slack_plan(counts, capacity)), schema).select(*pieces.columns, "sequence_id", "offset")


def packed_documents(docs: DataFrame, path: str, capacity: int = 4096, end_id: int = 1, keep_ids: bool = True, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """All documents as pieces with their place in sequences of at most ``capacity`` tokens."""
    from vigilog.llm.tokens import token_pieces

    return packed(stored(token_pieces(docs, path, end_id, capacity, keep_ids, id_column, text_column)), capacity)
