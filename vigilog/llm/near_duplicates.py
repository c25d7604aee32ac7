"""Near-duplicate documents: banded MinHash candidates, sequential Bayesian verification.

1. One pass over the texts gives each document its set of 5-word shingles, the 128-bit
   fingerprint of that set, and a signature of 128 minima in 32 bands of 4. Documents with
   equal sets are one class from here on, however many copies there are.
2. Classes that share a band are candidates. Inside a bucket, signatures are compared batch
   by batch; a pair is pruned as soon as the posterior probability that its similarity
   reaches the threshold (uniform prior) falls below ``MISS``. Buckets of more than
   ``BUCKET_ROWS`` classes are split into pairs of blocks, so that none is dropped or cut.
3. What survives in a bucket is written as one row per class (its smallest connected class),
   never as pairs. The connected components of these rows are clusters that hold all links.
4. In each cluster, again in pairs of blocks, the full shingle sets are compared exactly.
   Exact links are reduced to one row per class in the same way and joined to components.

At the threshold itself a link is missed by all bands with probability
(1 - 0.75^4)^32 = 5e-6, and far less above it.

Defined results: an empty or null text, or one without words, has 0 shingles and is linked
with nothing. Repeated rows and rows that share an id are linked like any others, and an
id's component is the smallest of its rows. A null id is never the smallest one unless no
document of the component has an id. An empty table gives no rows. Other columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from vigilog.llm.batches import bounded_batches, column, fresh, grouped, slabs, texts_of
from vigilog.llm.components import components
from vigilog.llm.hashing import U, mixed, shingles, words
from vigilog.session import stored

SHINGLE_WORDS = 5
SIMILAR_PERCENT = 75
BANDS = 32
BAND_ROWS = 4
HASHES = BANDS * BAND_ROWS
COMPARE = 16  # minima compared before each look at the posterior
MISS = 1e-6
BUCKET_ROWS = 4096
CLUSTER_ROWS = 4096
BROADCAST_ROWS = 1_000_000
CLUSTER_SHINGLES = 1 << 21

FACTORS = (mixed(np.arange(1001, 1001 + HASHES, dtype=U)) >> U(32)).astype(np.uint32) | np.uint32(1)
SHIFTS = (mixed(np.arange(5001, 5001 + HASHES, dtype=U)) >> U(32)).astype(np.uint32)


def signature(members: np.ndarray) -> np.ndarray:
    """The minima of the hash functions over a non-empty set of 64-bit shingle hashes."""
    values = (members >> U(32)).astype(np.uint32)
    least = np.full(HASHES, 2**32 - 1, np.uint32)
    for i in range(0, len(values), 2048):
        np.minimum(least, (values[None, i : i + 2048] * FACTORS[:, None] + SHIFTS[:, None]).min(axis=1), out=least)
    return least


def fingerprint(members: np.ndarray) -> bytes:
    """128 bits of a set: two independent sums over its members."""
    n = U(len(members))
    first = mixed(members).sum(dtype=U) + n
    second = mixed(members ^ U(0x5851F42D4C957F2D)).sum(dtype=U) ^ mixed(np.array([n]))[0]
    return np.array([first, second], U).tobytes()


def band_keys(least: np.ndarray) -> np.ndarray:
    """One 64-bit key for each band of a signature; keys of different bands differ."""
    rows = least.reshape(BANDS, BAND_ROWS).astype(U)
    key = mixed(np.arange(BANDS, dtype=U) + U(77))
    for j in range(BAND_ROWS):
        key = mixed(key ^ rows[:, j])
    return key.view(np.int64)


def least_matches(hashes: int = HASHES, step: int = COMPARE, similar: float = SIMILAR_PERCENT / 100, miss: float = MISS) -> list[tuple[int, int]]:
    """(compared, matches needed to go on) after each batch of minima.

    With a uniform prior the posterior after m of n matches is Beta(m + 1, n - m + 1), and
    its mass above ``similar`` is the chance of at most m successes in n + 1 trials.
    """
    out = []
    for n in range(step, hashes + 1, step):
        mass, m = 0.0, -1
        while mass < miss:
            m += 1
            mass += math.comb(n + 1, m) * similar**m * (1 - similar) ** (n + 1 - m)
        out.append((n, m))
    return out


def sets_of(batch_data: np.ndarray, offsets: np.ndarray) -> list[np.ndarray]:
    hashes, _, _, before = words(batch_data, offsets)
    return shingles(hashes, before, SHINGLE_WORDS)


def _signed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part, data, offsets in slabs(batch, "text"):
            sizes, prints, keys, marks = [], [], [], []
            for members in sets_of(data, offsets):
                sizes.append(len(members))
                if len(members):
                    least = signature(members)
                    prints.append(fingerprint(members))
                    keys.append(band_keys(least).tolist())
                    marks.append((mixed(least.astype(U)) & U(255)).astype(np.uint8).tobytes())
                else:
                    prints.append(None)
                    keys.append(None)
                    marks.append(None)
            yield pa.RecordBatch.from_arrays(
                [part.column("doc_id"), part.column("place"), pa.array(sizes, pa.int64()), pa.array(prints, pa.binary()), pa.array(keys, pa.list_(pa.int64())), pa.array(marks, pa.binary())],
                ["doc_id", "place", "n_shingles", "class", "bands", "marks"],
            )


def _joined(count: int, linked) -> np.ndarray:
    """Labels 0 .. of the components of ``count`` items; ``linked(i, rest)`` says which of
    the items ``rest`` are linked with i. Each item is compared only with items not yet reached."""
    label = np.full(count, -1)
    rest = np.arange(count)
    while len(rest):
        start = int(rest[0])
        label[start] = start
        rest = rest[1:]
        queue = [start]
        while queue and len(rest):
            hit = linked(queue.pop(), rest)
            found = rest[hit]
            if len(found):
                label[found] = start
                queue.extend(found.tolist())
                rest = rest[~hit]
    return label


def _candidates(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    steps = least_matches()

    def survivors(marks):
        def linked(i, rest):
            alive = np.arange(len(rest))
            matches = np.zeros(len(rest), np.int64)
            done = 0
            for n, needed in steps:
                matches[alive] += (marks[rest[alive], done:n] == marks[i, done:n]).sum(axis=1)
                alive = alive[matches[alive] >= needed]
                done = n
                if not len(alive):
                    break
            hit = np.zeros(len(rest), bool)
            hit[alive] = True
            return hit

        return linked

    for table in grouped(batches, "run"):
        nodes = table.column("node").to_numpy()
        marks = np.frombuffer(b"".join(table.column("marks").to_pylist()), np.uint8).reshape(-1, HASHES)
        left, right = [], []
        for begin, end in _runs(table.column("run").to_numpy()):
            own = nodes[begin:end]
            if end - begin == 2:
                label = np.array([0, 0 if survivors(marks[begin:end])(0, np.array([1]))[0] else 1])
            else:
                label = _joined(end - begin, survivors(marks[begin:end]))
            away = label != np.arange(end - begin)
            left.append(own[away])
            right.append(own[label[away]])
        if left:
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(left)), pa.array(np.concatenate(right))], ["a", "b"])


def _runs(keys: np.ndarray) -> list[tuple[int, int]]:
    edges = np.flatnonzero(keys[1:] != keys[:-1]) + 1
    return list(zip([0, *edges.tolist()], [*edges.tolist(), len(keys)], strict=True))


def _full_sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part, data, offsets in slabs(batch, "text"):
            found = sets_of(data, offsets)
            same = [fingerprint(s) == c for s, c in zip(found, part.column("class").to_pylist(), strict=True)]
            kept = np.flatnonzero(same)
            yield pa.RecordBatch.from_arrays(
                [part.column("node").take(pa.array(kept)), part.column("cluster").take(pa.array(kept)), pa.array([found[i].tobytes() for i in kept], pa.binary())], ["node", "cluster", "members"]
            )


def _links(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for table in grouped(batches, "run"):
        nodes = table.column("node").to_numpy()
        raw = table.column("members")
        left, right = [], []
        for begin, end in _runs(table.column("run").to_numpy()):
            own = nodes[begin:end]
            sets = [np.frombuffer(x.as_py(), U) for x in raw.slice(begin, end - begin)]
            label = _joined(end - begin, _similar(sets))
            away = label != np.arange(end - begin)
            left.append(own[away])
            right.append(own[label[away]])
        if left:
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(left)), pa.array(np.concatenate(right))], ["a", "b"])


def _similar(sets: list[np.ndarray]):
    """Exact test of one set against many: shared members from one look-up table."""
    sizes = np.array([len(s) for s in sets])
    known, places = np.unique(np.concatenate(sets), return_inverse=True)
    ends = np.cumsum(sizes)
    mark = np.zeros(len(known), np.int32)
    # Only the items not yet reached are looked at: their places are gathered anew when half of them are gone.
    cache = {"rest": None}

    def linked(i, rest):
        kept = cache["rest"]
        if kept is None or len(kept) > 2 * len(rest):
            cache["rest"] = kept = rest
            cache["flat"] = np.concatenate([places[ends[r] - sizes[r] : ends[r]] for r in rest])
            cache["begin"] = np.concatenate([[0], np.cumsum(sizes[rest])[:-1]])
        own = places[ends[i] - sizes[i] : ends[i]]
        mark[own] = 1
        shared = np.add.reduceat(mark[cache["flat"]], cache["begin"])
        mark[own] = 0
        if len(kept) != len(rest):
            shared = shared[np.searchsorted(kept, rest)]
        return 100 * shared >= SIMILAR_PERCENT * (sizes[i] + sizes[rest] - shared)

    return linked


def _in_blocks(rows: DataFrame, blocks) -> DataFrame:
    """Rows with ``run``: one number for each group, or for each pair of blocks of a large group.

    ``blocks`` is the number of blocks of the row's group. A row goes to the pairs of its own
    block with every block, so any two rows of a group meet in one run at least, and no run
    holds more than two blocks.
    """
    own = F.pmod(F.xxhash64("node", F.lit(3)), F.col("_blocks")).cast("int")
    dealt = rows.withColumn("_blocks", blocks.cast("int")).withColumn("_own", own)
    dealt = dealt.withColumn("_other", F.explode(F.sequence(F.lit(0), F.col("_blocks") - 1)))
    return dealt.withColumn("run", F.xxhash64("group", F.least("_own", "_other"), F.greatest("_own", "_other"))).drop("_blocks", "_own", "_other", "group")


def near_duplicates(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """One row per document: ``doc_id``, ``n_shingles``, ``component_id``, ``kept``, ``first`` and ``place``
    (a hash of the text).

    ``component_id`` is the smallest id among all documents reachable by links (its own
    for a document without links). ``kept`` marks rows whose id it is, ``first`` exactly one
    row of each component (of each document without words).
    """
    spark = docs.sparkSession
    bounded_batches(spark)
    texts = texts_of(docs, id_column, text_column)
    id_type = texts.schema["doc_id"].dataType.simpleString()
    numbered = texts.withColumn("place", F.xxhash64("text"))
    signed = stored(numbered.mapInArrow(_signed, f"doc_id {id_type}, place long, n_shingles long, class binary, bands array<long>, marks binary").withColumn("row", F.monotonically_increasing_id()))
    classes = signed.filter("class is not null").groupBy("class").agg(F.min("doc_id").alias("low"), F.min("row").alias("row"))
    nodes = stored(
        signed.select("row", "class", "doc_id", "place", "n_shingles", "bands", "marks")
        .join(classes.select("row", "low"), "row")
        .withColumnRenamed("row", "node")
    )
    clusters = components(_bucket_links(nodes))
    links = _exact_links(texts, nodes, clusters)
    linked = components(links).withColumnRenamed("component", "root")
    labels = nodes.select("node", "class", "low").join(linked, "node", "left").withColumn("root", F.coalesce("root", "node"))
    roots = labels.groupBy("root").agg(F.min("low").alias("component_id"), F.min("node").alias("first_row"))
    labels = stored(labels.join(roots, "root").select("class", "component_id", "first_row"))
    found = signed.filter("class is not null").select("doc_id", "n_shingles", "class", "row", "place").join(labels, "class")
    alone = signed.filter("class is null").select("doc_id", "n_shingles", F.col("doc_id").alias("component_id"), F.lit(True).alias("first"), "place")
    rows = found.select("doc_id", "n_shingles", "component_id", (F.col("row") == F.col("first_row")).alias("first"), "place").unionAll(alone)
    return rows.select("doc_id", "n_shingles", "component_id", F.col("doc_id").eqNullSafe(F.col("component_id")).alias("kept"), "first", "place")


def deduplicated(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """``docs`` with one document of each component, the others unchanged.

    Rows that repeat both id and text are one document. The rows that go are joined away,
    the smaller side, by broadcast up to ``BROADCAST_ROWS`` of them (two numbers each) and by
    shuffle beyond; only documents that stay and come repeatedly are grouped.
    """
    rows = near_duplicates(docs, id_column, text_column).groupBy("doc_id", "place").agg(F.bool_or("first").alias("stays"), F.count("*").alias("times"))
    rows = stored(rows.filter("NOT stays OR times > 1"))
    place = fresh(docs, "dedup_place")
    marked = docs.withColumn(place, F.xxhash64(F.coalesce(column(docs, text_column).cast("string"), F.lit(""))))

    def match(other):
        return (marked[place] == other["place"]) & column(marked, id_column).eqNullSafe(other["doc_id"])

    def small(other):
        return F.broadcast(other) if other.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS else other

    names = [column(marked, c) for c in docs.columns]
    gone = small(rows.filter("NOT stays").select("doc_id", "place"))
    left = marked.join(gone, match(gone), "left_anti")
    repeated = small(rows.filter("stays").select("doc_id", "place"))
    if repeated.isEmpty():
        return left.select(*names)
    once = left.join(repeated, match(repeated), "left_anti").select(*names)
    several = left.join(repeated, match(repeated), "left_semi").dropDuplicates([id_column, place]).drop(place)
    return once.unionByName(several)


def _bucket_links(nodes: DataFrame) -> DataFrame:
    banded = nodes.select("node", F.explode("bands").alias("group"))
    shared = banded.groupBy("group").agg(F.count("*").alias("members")).filter("members > 1")
    members = banded.join(shared, "group")
    dealt = _in_blocks(members, F.ceil(F.col("members") / BUCKET_ROWS)).drop("members").join(nodes.select("node", "marks"), "node")
    return _by_run(dealt).mapInArrow(_candidates, "a long, b long").distinct()


def _exact_links(texts: DataFrame, nodes: DataFrame, clusters: DataFrame) -> DataFrame:
    asked = nodes.select("node", "class", "doc_id", "place").join(clusters.withColumnRenamed("component", "cluster"), "node")
    chosen = texts.withColumn("place", F.xxhash64("text")).alias("t").join(asked.alias("n"), (F.col("t.place") == F.col("n.place")) & F.col("t.doc_id").eqNullSafe(F.col("n.doc_id")))
    sets = stored(chosen.select("node", "cluster", "class", "text").mapInArrow(_full_sets, "node long, cluster long, members binary"))
    sizes = sets.groupBy("cluster").agg(F.count("*").alias("docs"), F.sum(F.octet_length("members") / 8).alias("shingles"))
    blocks = F.ceil(F.greatest(F.col("docs") / CLUSTER_ROWS, F.col("shingles") / CLUSTER_SHINGLES))
    dealt = _in_blocks(sets.join(sizes, "cluster").withColumnRenamed("cluster", "group"), blocks).drop("docs", "shingles")
    return _by_run(dealt).mapInArrow(_links, "a long, b long").distinct()


def _by_run(rows: DataFrame) -> DataFrame:
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return rows.repartition(parts, "run").sortWithinPartitions("run")
