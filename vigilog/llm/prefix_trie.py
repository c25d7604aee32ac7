"""The prefix trie of conversations: union-find over sorted neighbours, partition by partition.

A conversation is the sequence of its turns, each an MD5 of role and text. Conversations are
sorted by these sequences over range partitions (the id is the last key, so that a sequence which a
third of all conversations share is spread over many), and two neighbours are joined by an edge as
deep as the prefix that they share.

1. Inside a partition the edges are taken in descending depth. An edge merges the two components
   beside it: a component that is deeper than the edge is finished, it is a node of the trie, and
   becomes a child of the new node at the edge's depth; one that is as deep already is that node.
   A node's subtree is its component, so counts, leaves and saved words are sums over its edges.
2. A component that reaches the partition's first or last conversation may go on beyond it and is
   not finished; its edges stay. What stays is the contracted forest of the partition: at most one
   component per depth on either side, with the first and last sequence.
3. Forests of neighbouring partitions are merged by the same steps, ``FAN`` at a time, until one is
   left, whose last component is the root.
4. Nodes between a node and its parent have one child and the same members; they are made at the
   end, one row each, from the words before each turn.

Ids of conversations that end at a node are hashed where their run lies within a partition. A run
that reaches a boundary is handed on as strings of ids and hashed as a stream by one task, as
SHA-256 allows no other way; its memory does not grow.

Defined results: a null role or text is empty; turns are ordered with null first, equal ones by the
MD5 of role and text, and repeated rows are repeated turns. Rows without a conversation id take no
part. An empty table gives no rows, not even a root. A conversation is one row of 24 bytes a turn.
"""

from __future__ import annotations

import hashlib
import itertools
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from vigilog.llm.batches import SPACE, bounded_batches, column
from vigilog.session import stored

DIGEST = 16
PARTITION_TURNS = 500_000
FAN = 64
RUN_IDS = 65_536
WORDS = SPACE.replace("[", "[^")
NO_ENDS = hashlib.sha256(b"").hexdigest()

PART = "depth int, n long, children long, leaves long, low long, saved long, sha string, run binary, refs array<long>"
ROWS = (
    "kind string, conv_id long, top int, depth int, parent_conv_id long, parent_ref long, n long, children long, leaves long, saved long, before array<long>, sha string, run binary,"
    f" ref long, ids string, segment long, first_key binary, first_words array<long>, last_key binary, last_words array<long>, parts array<struct<{PART.replace(' ', ':').replace(',:', ',')}>>, edges array<int>"
)
_part = pa.struct([("depth", pa.int32()), *((n, pa.int64()) for n in ("n", "children", "leaves", "low", "saved")), ("sha", pa.string()), ("run", pa.binary()), ("refs", pa.list_(pa.int64()))])
_longs = pa.list_(pa.int64())
ARROW = pa.schema(
    [
        ("kind", pa.string()),
        ("conv_id", pa.int64()),
        ("top", pa.int32()),
        ("depth", pa.int32()),
        *((n, pa.int64()) for n in ("parent_conv_id", "parent_ref", "n", "children", "leaves", "saved")),
        ("before", _longs),
        ("sha", pa.string()),
        ("run", pa.binary()),
        ("ref", pa.int64()),
        ("ids", pa.string()),
        ("segment", pa.int64()),
        ("first_key", pa.binary()),
        ("first_words", _longs),
        ("last_key", pa.binary()),
        ("last_words", _longs),
        ("parts", pa.list_(_part)),
        ("edges", pa.list_(pa.int32())),
    ]
)


@dataclass(slots=True)
class Component:
    """Neighbouring conversations that share their first ``depth`` turns."""

    depth: int
    low: int
    words: np.ndarray  # words in the first 0, 1, ... turns, ``depth`` at least
    n: int = 1
    children: int = 0
    leaves: int = 0
    saved: int = 0  # words before each edge inside
    sha: str | None = None
    run: bytes | None = None
    refs: list[int] = field(default_factory=list)
    waiting: list[dict] = field(default_factory=list)  # children, for whom this one's id is not known yet


def shared(a: bytes, b: bytes) -> int:
    """Turns that two sequences share from the front."""
    low, high = 0, min(len(a), len(b)) // DIGEST
    while low < high:
        middle = (low + high + 1) // 2
        if a[low * DIGEST : middle * DIGEST] == b[low * DIGEST : middle * DIGEST]:
            low = middle
        else:
            high = middle - 1
    return low


class Forest:
    """Components in sorted order, and the depth that each one shares with the next."""

    def __init__(self, parts: list[Component], edges: list[int], new_ref: Iterator[int], open_left: bool = True, open_right: bool = True):
        self.parts, self.edges, self.new_ref = parts, edges, new_ref
        self.open_left, self.open_right = open_left, open_right
        self.rows: list[dict] = []
        self.above = list(range(len(parts)))  # union-find
        self.first, self.last = list(range(len(parts))), list(range(len(parts)))
        self.kept = [False] * len(edges)

    def find(self, i: int) -> int:
        while self.above[i] != i:
            self.above[i] = self.above[self.above[i]]
            i = self.above[i]
        return i

    def finish(self, own: Component, depth: int) -> dict:
        """The node of a finished component, child of one at ``depth`` (-1: it is the root)."""
        node = {
            "kind": "node",
            "conv_id": own.low,
            "top": depth + 1,
            "depth": own.depth,
            "n": own.n,
            "children": own.children,
            "leaves": own.leaves or 1,
            "saved": own.saved,
            "before": own.words[depth : own.depth].tolist() if depth >= 0 else [0, *own.words[: own.depth].tolist()],
            "sha": own.sha,
            "run": own.run,
        }
        self.rows.append(node)
        for child in own.waiting:
            child["parent_conv_id"] = own.low
        self.rows.extend({"kind": "alias", "ref": ref, "conv_id": own.low} for ref in own.refs)
        return node

    def raised(self, own: Component, depth: int) -> Component:
        """The node at ``depth`` that has this component as its child so far."""
        node = self.finish(own, depth)
        return Component(depth, own.low, own.words, own.n, 1, own.leaves or 1, own.saved, waiting=[node])

    def merge(self) -> Forest:
        for at in sorted(range(len(self.edges)), key=lambda i: -self.edges[i]):
            depth, left, right = self.edges[at], self.find(at), self.find(at + 1)
            a, b = self.parts[left], self.parts[right]
            left_end, right_end = self.first[left], self.last[right]
            # A component that is deeper than this edge and may reach beyond the forest is not finished.
            from_left = a.depth > depth and (self.kept[left_end - 1] if left_end else self.open_left)
            from_right = b.depth > depth and (self.kept[right_end] if right_end < len(self.edges) else self.open_right)
            if a.depth > depth and not from_left:
                self.parts[left] = self.raised(a, depth)
            if b.depth > depth and not from_right:
                self.parts[right] = self.raised(b, depth)
            if from_left or from_right:
                self.kept[at] = True
            else:
                self._unite(left, right, depth)
        return self

    def _unite(self, left: int, right: int, depth: int) -> None:
        a, b = self.parts[left], self.parts[right]
        if len(a.waiting) < len(b.waiting):
            a.waiting, b.waiting = b.waiting, a.waiting
        a.waiting.extend(b.waiting)
        a.refs.extend(b.refs)
        a.saved += b.saved + int(a.words[depth])
        a.n, a.children, a.leaves, a.low = a.n + b.n, a.children + b.children, a.leaves + b.leaves, min(a.low, b.low)
        a.sha, a.run = a.sha or b.sha, a.run or b.run
        self.above[right] = left
        self.last[left] = self.last[right]

    def left_over(self) -> tuple[list[Component], list[int]]:
        """The contracted forest. Finished children of its components wait for an alias."""
        parts = [self.parts[i] for i in range(len(self.parts)) if self.above[i] == i]
        for own in parts:
            if own.waiting and not own.refs:
                own.refs.append(next(self.new_ref))
            for child in own.waiting:
                child["parent_ref"] = own.refs[0]
            own.waiting = []
        return parts, [e for e, kept in zip(self.edges, self.kept, strict=True) if kept]


def _batches(rows: list[dict], size: int = 8192) -> Iterator[pa.RecordBatch]:
    for at in range(0, len(rows), size):
        yield pa.RecordBatch.from_pylist(rows[at : at + size], ARROW)


def _segment(forest: Forest, number: int, first: tuple, last: tuple) -> dict:
    parts, edges = forest.left_over()
    content = [{n: getattr(own, n) for n in _part.names} for own in parts]
    return {"kind": "segment", "segment": number, "first_key": first[0], "first_words": first[1], "last_key": last[0], "last_words": last[1], "parts": content, "edges": edges}


def _joined(ids: list[int]) -> str:
    return ",".join(map(str, ids))


def _sorted_partition(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Finished nodes, the contracted forest and the runs at the boundaries of one sorted partition."""
    number = TaskContext.get().partitionId()
    keys: list[bytes] = []
    words: list[np.ndarray] = []
    ids: list[list[int]] = []
    edges: list[int] = []
    for batch in batches:
        key_column, word_column = batch.column("key"), batch.column("words")
        for i, conv_id in enumerate(batch.column("conv_id").to_pylist()):
            key = key_column[i].as_py()
            if keys and keys[-1] == key:
                ids[-1].append(conv_id)
                continue
            if keys:
                edges.append(shared(keys[-1], key))
                if len(keys) > 1:
                    keys[-1] = b""  # only the neighbour, the first and the last one are asked for
            keys.append(key)
            words.append(np.concatenate([[0], np.cumsum(word_column[i].values.to_numpy(zero_copy_only=False).astype(np.int64))]))
            ids.append([conv_id])
    if not keys:
        return
    rows, parts = [], []
    for i, (own, run) in enumerate(zip(words, ids, strict=True)):
        part = Component(len(own) - 1, run[0], own, len(run), saved=(len(run) - 1) * int(own[-1]))
        if i in (0, len(ids) - 1):
            part.run = hashlib.md5(keys[i]).digest()
            rows.extend({"kind": "run", "run": part.run, "conv_id": run[at], "ids": _joined(run[at : at + RUN_IDS])} for at in range(0, len(run), RUN_IDS))
        else:
            part.sha = hashlib.sha256(_joined(run).encode()).hexdigest()
        parts.append(part)
    forest = Forest(parts, edges, itertools.count(number << 28)).merge()
    rows.append(_segment(forest, number, (keys[0], words[0].tolist()), (keys[-1], words[-1].tolist())))
    yield from _batches(forest.rows + rows)


def _neighbours(level: int, last: bool):
    """Merges the contracted forests of one group of neighbouring partitions."""

    def merged(table: pa.Table) -> pa.Table:
        segments = sorted(table.to_pylist(), key=lambda x: x["segment"])
        number = segments[0]["group"]
        parts, edges = [], []
        for before, own in zip([None, *segments[:-1]], segments, strict=True):
            if before:
                edges.append(shared(before["last_key"], own["first_key"]))
            reach = len(own["first_words"])
            first, end = np.array(own["first_words"], np.int64), np.array(own["last_words"], np.int64)
            for x, edge in itertools.zip_longest(own["parts"], own["edges"]):
                parts.append(Component(words=first if x["depth"] <= reach else end, **x))
                if edge is not None:
                    reach = min(reach, edge)
            edges.extend(own["edges"])
        forest = Forest(parts, edges, itertools.count((level << 58) | (number << 28)), not last, not last).merge()
        if last:
            forest.finish(forest.parts[forest.find(0)], -1)
            rows = forest.rows
        else:
            ends = (segments[0]["first_key"], segments[0]["first_words"]), (segments[-1]["last_key"], segments[-1]["last_words"])
            row = _segment(forest, number, *ends)
            rows = [*forest.rows, row]
        return pa.Table.from_batches(list(_batches(rows)), ARROW)

    return merged


def _hashed_runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """SHA-256 of each run's ids, read piece by piece in ascending order."""
    run, state = None, None
    done: list[dict] = []
    for batch in batches:
        for row in batch.to_pylist():
            if row["run"] != run:
                if state:
                    done.append({"run": run, "run_sha": state.hexdigest()})
                run, state = row["run"], hashlib.sha256(row["ids"].encode())
            else:
                state.update(b"," + row["ids"].encode())
    if state:
        done.append({"run": run, "run_sha": state.hexdigest()})
    yield pa.RecordBatch.from_pylist(done, pa.schema([("run", pa.binary()), ("run_sha", pa.string())]))


def sequences(turns: DataFrame, conv_column: str = "conv_id", turn_column: str = "turn", role_column: str = "role", text_column: str = "text") -> DataFrame:
    """``conv_id`` and ``turns``, the ordered array of (turn, digest, words) of each conversation."""
    role, text = (F.coalesce(column(turns, c).cast("string"), F.lit("")) for c in (role_column, text_column))
    digest = F.md5(F.concat(F.length(role).cast("string"), F.lit(":"), role, text).cast("binary"))
    rows = turns.filter(column(turns, conv_column).isNotNull()).select(
        column(turns, conv_column).cast("long").alias("conv_id"),
        F.struct(column(turns, turn_column).alias("turn"), digest.alias("digest"), F.regexp_count(text, F.lit(WORDS)).cast("int").alias("words")).alias("x"),
    )
    return rows.groupBy("conv_id").agg(F.sort_array(F.collect_list("x")).alias("turns"))


def prefix_trie(conversations: DataFrame) -> DataFrame:
    """One row per node of the trie of ``conversations`` (``conv_id``, different in all rows, and ``turns`` as from ``sequences``).

    ``conv_id`` (the smallest member), ``depth``, ``parent_conv_id`` (null: root), ``n_convs``, ``n_children``,
    ``n_leaves`` and ``saved_tokens`` (of the subtree), ``ends_sha256`` (of the ids that end there).
    """
    spark = conversations.sparkSession
    bounded_batches(spark)
    rows = stored(
        conversations.select(
            "conv_id",
            F.unhex(F.array_join(F.transform("turns", lambda x: x["digest"]), "")).alias("key"),
            F.transform("turns", lambda x: x["words"]).alias("words"),
        )
    )
    turns = rows.agg(F.sum(F.size("words").cast("long"))).first()[0] or 0
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), turns // PARTITION_TURNS + 1)
    level = 0
    pieces = [stored(rows.repartitionByRange(parts, "key", "conv_id").sortWithinPartitions("key", "conv_id").mapInArrow(_sorted_partition, ROWS))]
    while True:
        segments = pieces[-1].filter("kind = 'segment'").select("segment", "first_key", "first_words", "last_key", "last_words", "parts", "edges")
        count = segments.count()
        if not count:
            break
        level, last = level + 1, count <= FAN
        grouped = segments.withColumn("group", F.lit(0).cast("long") if last else F.floor(F.col("segment") / FAN))
        pieces.append(stored(grouped.groupBy("group").applyInArrow(_neighbours(level, last), ROWS)))
        if last:
            break
    everything = pieces[0]
    for piece in pieces[1:]:
        everything = everything.unionAll(piece)

    names = ["conv_id", "top", "depth", "parent_conv_id", "n", "children", "leaves", "saved", "before", "sha", "run"]
    nodes = everything.filter("kind = 'node'")
    aliases = everything.filter("kind = 'alias'").select(F.col("ref").alias("parent_ref"), F.col("conv_id").alias("known"))
    waiting = nodes.filter("parent_ref IS NOT NULL").join(aliases, "parent_ref").withColumn("parent_conv_id", F.col("known"))
    nodes = nodes.filter("parent_ref IS NULL").select(*names).unionAll(waiting.select(*names))
    runs = everything.filter("kind = 'run'").select("run", "conv_id", "ids")
    runs = runs.repartition(parts, "run").sortWithinPartitions("run", "conv_id").select("run", "ids").mapInArrow(_hashed_runs, "run binary, run_sha string")
    # At most two runs for each partition.
    nodes = nodes.join(F.broadcast(stored(runs)), "run", "left").select(*names, "run_sha", F.posexplode("before").alias("above", "words"))
    depth = F.col("top") + F.col("above")
    bottom = depth == F.col("depth")
    return nodes.select(
        "conv_id",
        depth.cast("long").alias("depth"),
        F.when(F.col("above") == 0, F.col("parent_conv_id")).otherwise(F.col("conv_id")).alias("parent_conv_id"),
        F.col("n").alias("n_convs"),
        F.when(bottom, F.col("children")).otherwise(F.lit(1)).cast("long").alias("n_children"),
        F.col("leaves").alias("n_leaves"),
        (F.col("saved") - (F.col("n") - 1) * F.col("words")).alias("saved_tokens"),
        F.when(bottom, F.coalesce("sha", "run_sha")).otherwise(F.lit(None)).alias("sha"),
    ).withColumn("ends_sha256", F.coalesce("sha", F.lit(NO_ENDS))).drop("sha")
