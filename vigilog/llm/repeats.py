"""Removal of byte strings that occur more than once, from sorted suffixes.

A string of ``LENGTH`` bytes holds 169 grams of 32 bytes; every gram with the least hash among
them is an anchor, so equal strings have anchors at equal places, and all occurrences of a
string meet in the group of an anchor. The group's members are segments: 168 bytes before
the anchor, 200 from it on.

1. Anchors of all texts are counted; only those at two places or more go on. Copies of a
   whole text are one text here: their strings all repeat.
2. Segments that occur twice as a whole are settled: every string in them repeats. One of
   each kind stays as a partner for the others.
3. Groups with other segments are sorted by column-wise construction (``suffix_columns``):
   segments are aligned at the anchor, and a common prefix of ``LENGTH`` in a column means
   that the string beginning there occurs twice. A group of more than ``GROUP_ROWS``
   different segments is counted string by string instead, spread over all tasks.
4. Runs of repeated strings are joined per text and removed.

Building suffixes of whole texts column by column needs as many rounds as the longest text
has bytes, each reading all of the transform; aligned segments bound the rounds by 368.

Defined results: a null text is empty; texts of fewer than ``LENGTH`` bytes keep all bytes.
Repeated rows are copies of each other, also with equal or null ids. An empty table gives no
rows; other columns are ignored. Hashes of strings have 64 bits and are taken as the strings.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from vigilog.llm.batches import bounded_batches, grouped, slabs, texts_of
from vigilog.llm.hashing import BASE, EXACT, U, mixed, powers
from vigilog.llm.suffix_columns import repeated
from vigilog.session import stored

LENGTH = 200
GRAM = 32
WINDOW = LENGTH - GRAM + 1  # grams in a string
BEFORE = LENGTH - GRAM  # bytes of a segment before its anchor
GROUP_ROWS = 20_000
SORT_ROWS = 16_384
INVERSE = U(pow(int(BASE), -1, 2**64))


def _sliding(values: np.ndarray, width: int, combine) -> np.ndarray:
    """``combine`` over every run of ``width`` values, by doubling."""
    size = 1
    while size * 2 <= width:
        values = combine(values[:-size], values[size:])
        size *= 2
    return combine(values[: len(values) - (width - size)], values[width - size :]) if width > size else values


def _gram_hashes(data: np.ndarray) -> np.ndarray:
    values, size = EXACT[data], 1
    while size < GRAM:
        values = values[:-size] + values[size:] * powers(GRAM)[size]
        size *= 2
    return mixed(values)


_inverse = np.ones(1, U)


def _inverse_powers(n: int) -> np.ndarray:
    global _inverse
    if len(_inverse) < n:
        factors = np.full(1 << max(6, (n - 1).bit_length()), INVERSE)
        factors[0] = 1
        _inverse = np.multiply.accumulate(factors)
    return _inverse[:n]


def _range_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Hashes of the bytes [start, end) that depend on these bytes alone."""
    sums = np.zeros(len(data) + 1, U)
    np.cumsum(EXACT[data] * powers(len(data)), out=sums[1:])
    return mixed((sums[ends] - sums[starts]) * _inverse_powers(len(data) + 1)[starts] ^ mixed((ends - starts).astype(U)))


def anchors(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places and hashes of the anchors of a text of at least ``LENGTH`` bytes."""
    hashes = _gram_hashes(data)
    least = _sliding(hashes, WINDOW, np.minimum)
    # A gram is an anchor if it is the least of a window that holds it: the greatest of those windows' leasts.
    padded = np.concatenate([np.zeros(WINDOW - 1, U), least, np.zeros(WINDOW - 1, U)])
    places = np.flatnonzero(_sliding(padded, WINDOW, np.maximum) == hashes)
    return places, hashes[places]


def segments(data: np.ndarray, places: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    return np.maximum(places - BEFORE, 0), np.minimum(places + LENGTH, len(data))


def _anchored(with_places: bool):
    def anchored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, data, offsets in slabs(batch, "text"):
                keys = part.column("text_key").to_numpy()
                key, place, gram, segment = [], [], [], []
                for i in np.flatnonzero(np.diff(offsets) >= LENGTH).tolist():
                    own = data[offsets[i] : offsets[i + 1]]
                    at, hashes = anchors(own)
                    key.append(np.full(len(at), keys[i]))
                    place.append(at)
                    gram.append(hashes)
                    if with_places:
                        starts, ends = segments(own, at)
                        segment.append(_range_hashes(own, starts, ends) ^ mixed((at - starts).astype(U)))
                if not key:
                    continue
                key, place, gram = np.concatenate(key), np.concatenate(place), np.concatenate(gram).view(np.int64)
                if with_places:
                    arrays = [pa.array(gram), pa.array(key), pa.array(place.astype(np.int32)), pa.array(np.concatenate(segment).view(np.int64))]
                    yield pa.RecordBatch.from_arrays(arrays, ["gram", "text_key", "place", "segment"])
                else:
                    where = mixed(key.view(U) ^ mixed(place.astype(U))).view(np.int64)
                    yield pa.RecordBatch.from_arrays([pa.array(gram), pa.array(where)], ["gram", "occurrence"])

    return anchored


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The bytes of the chosen segments, with the bytes that lie before the anchor."""
    for batch in batches:
        for part, data, offsets in slabs(batch, "text"):
            chosen = part.column("chosen").to_pylist()
            keys = part.column("text_key").to_pylist()
            rows: list[list] = [[], [], [], [], [], [], []]
            for i, wanted in enumerate(chosen):
                own = data[offsets[i] : offsets[i + 1]].tobytes() if wanted else b""
                for x in wanted or ():
                    begin = max(x["place"] - BEFORE, 0)
                    for column, value in zip(rows, (x["gram"], keys[i], x["place"], x["open"], x["large"], x["place"] - begin, own[begin : x["place"] + LENGTH]), strict=True):
                        column.append(value)
            types = [pa.int64(), pa.int64(), pa.int32(), pa.bool_(), pa.bool_(), pa.int32(), pa.binary()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(rows, types, strict=True)], ["gram", "text_key", "place", "open", "large", "before", "bytes"])


def _window_runs(hits: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row, first and last column of each run of hits."""
    padded = np.zeros((hits.shape[0], hits.shape[1] + 2), np.int8)
    padded[:, 1:-1] = hits
    turns = np.diff(padded, axis=1)
    rows, first = np.nonzero(turns == 1)
    _, after = np.nonzero(turns == -1)
    return rows, first, after - 1


def _sorted_groups(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Spans ``text_key``, ``start``, ``end`` of the repeated strings of open segments."""
    waiting: list[pa.Table] = []

    def spans(tables: list[pa.Table]) -> pa.RecordBatch:
        table = pa.concat_tables(tables).combine_chunks()
        _, groups = np.unique(table.column("gram").to_numpy(), return_inverse=True)
        order = np.argsort(groups, kind="stable")
        table, groups = table.take(pa.array(order)), groups[order]
        before = table.column("before").to_numpy()
        raw = [np.frombuffer(x, np.uint8) for x in table.column("bytes").to_pylist()]
        rows = np.zeros((len(raw), BEFORE + LENGTH), np.uint16)
        for i, own in enumerate(raw):
            rows[i, BEFORE - before[i] : BEFORE - before[i] + len(own)] = own.astype(np.uint16) + 1
        hits = repeated(rows, groups, LENGTH) & table.column("open").to_numpy(zero_copy_only=False)[:, None]
        at, first, last = _window_runs(hits)
        place = table.column("place").to_numpy()[at].astype(np.int64) - BEFORE
        return pa.RecordBatch.from_arrays([pa.array(table.column("text_key").to_numpy()[at]), pa.array(place + first), pa.array(place + last + LENGTH)], ["text_key", "start", "end"])

    for table in grouped(batches, "gram"):
        waiting.append(table)
        if sum(t.num_rows for t in waiting) >= SORT_ROWS:
            yield spans(waiting)
            waiting = []
    if waiting:
        yield spans(waiting)


def _strings(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Every string of the segments of very large groups, by its hash."""
    for batch in batches:
        columns = batch.to_pydict()
        for key, place, open_, before, own in zip(*(columns[n] for n in ("text_key", "place", "open", "before", "bytes")), strict=True):
            if len(own) >= LENGTH:
                data = np.frombuffer(own, np.uint8)
                starts = np.arange(len(own) - LENGTH + 1)
                hashes = _range_hashes(data, starts, starts + LENGTH).view(np.int64)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(hashes), pa.array(np.full(len(starts), key)), pa.array(place - before + starts), pa.array(np.full(len(starts), open_))], ["string", "text_key", "start", "open"]
                )


def _stripped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part, data, offsets in slabs(batch, "text"):
            removed, runs, digests, kept_bytes = [], [], [], []
            for i, spans in enumerate(part.column("spans").to_pylist()):
                own = data[offsets[i] : offsets[i + 1]].tobytes()
                kept, at, count = [], 0, 0
                for start, end in sorted((x["start"], x["end"]) for x in spans):
                    if start > at or not count:
                        kept.append(own[at:start])
                        count += 1
                        at = start
                    at = max(at, end)
                kept.append(own[at:])
                left = b"".join(kept)
                removed.append(len(own) - len(left))
                runs.append(count)
                digests.append(hashlib.sha256(left).hexdigest())
                kept_bytes.append(left)
            yield pa.RecordBatch.from_arrays(
                [part.column("text_key"), pa.array(removed, pa.int64()), pa.array(runs, pa.int64()), pa.array(digests, pa.string()), pa.array(kept_bytes, pa.binary())],
                ["text_key", "n_removed", "n_spans", "kept_sha256", "kept"],
            )


def repeat_spans(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> tuple[DataFrame, DataFrame, DataFrame]:
    """Three stored tables.

    ``doc_id``, ``text_key``, ``n_bytes``, ``sha256`` of every document; ``text_key``, ``copies`` of
    every different text; and ``text_key``, ``text``, ``spans`` (start and end of repeated strings,
    they may overlap) of texts without copies that have some.
    """
    bounded_batches(docs.sparkSession)
    texts = texts_of(docs, id_column, text_column).withColumns({"text_key": F.xxhash64("text"), "row_key": F.xxhash64("doc_id", "text")})
    base = stored(texts.select("doc_id", "text_key", "row_key", F.octet_length("text").cast("long").alias("n_bytes"), F.sha2(F.col("text").cast("binary"), 256).alias("sha256")))
    copies = stored(base.groupBy("text_key").agg(F.count("*").alias("copies"), F.min("row_key").alias("row_key")))

    counted = texts.select("text", "text_key").mapInArrow(_anchored(False), "gram long, occurrence long")
    met = stored(counted.groupBy("gram").agg(F.min("occurrence").alias("a"), F.max("occurrence").alias("b")).filter("a <> b").select("gram"))
    placed = texts.select("text", "text_key").mapInArrow(_anchored(True), "gram long, text_key long, place int, segment long")
    places = stored(placed.join(met, "gram"))

    # Different places of a segment; copies of a text are the same place.
    kinds = places.groupBy("gram", "segment").agg(F.min(F.struct("text_key", "place")).alias("one"), F.max(F.struct("text_key", "place")).alias("other"))
    kinds = stored(kinds.select("gram", "segment", "one", (F.col("one") != F.col("other")).alias("settled")))
    groups = stored(kinds.groupBy("gram").agg(F.count("*").alias("members"), F.bool_or(~F.col("settled")).alias("open")).filter("members > 1 AND open"))
    whole = places.join(kinds.filter("settled").select("gram", "segment"), ["gram", "segment"]).select("text_key", F.greatest(F.col("place") - BEFORE, F.lit(0)).cast("long").alias("start"), F.col("place").cast("long").alias("at"))

    sized = groups.select("gram", (F.col("members") > GROUP_ROWS).alias("large"))
    wanted = kinds.join(sized, "gram").select(F.col("one.text_key").alias("text_key"), F.struct(F.col("one.place").alias("place"), "gram", (~F.col("settled")).alias("open"), "large").alias("x"))
    chosen = wanted.groupBy("text_key").agg(F.collect_list("x").alias("chosen"))
    sure = whole.groupBy("text_key").agg(F.collect_set(F.struct("start", "at")).alias("sure"))
    asked = chosen.join(sure, "text_key", "full").join(copies, "text_key").filter("chosen IS NOT NULL OR copies = 1")
    held = stored(texts.drop("doc_id", "text_key").join(asked, "row_key").select("text_key", "copies", "text", "chosen", "sure"))

    pieces = held.filter("chosen IS NOT NULL").select("text_key", "text", "chosen").mapInArrow(_cut, "gram long, text_key long, place int, open boolean, large boolean, before int, bytes binary")
    spans = []
    if sized.filter("large").isEmpty():
        small = pieces
    else:
        # Told apart by a column: after a join by gram Spark leaves the repartition below out, and where that join
        # turns into a broadcast join at run time, the rows of a gram end up in several tasks.
        pieces = stored(pieces)
        small = pieces.filter("NOT large")
        strings = pieces.filter("large").select("text_key", "place", "open", "before", "bytes").mapInArrow(_strings, "string long, text_key long, start long, open boolean")
        strings = stored(strings)
        twice = strings.groupBy("string").agg(F.min(F.struct("text_key", "start")).alias("one"), F.max(F.struct("text_key", "start")).alias("other")).filter("one <> other").select("string")
        spans.append(strings.filter("open").join(twice, "string").select("text_key", "start", (F.col("start") + LENGTH).alias("end")))
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    spans.append(small.repartition(parts, "gram").sortWithinPartitions("gram").mapInArrow(_sorted_groups, "text_key long, start long, end long"))
    found = spans[0] if len(spans) == 1 else spans[0].unionAll(spans[1])
    found = found.groupBy("text_key").agg(F.collect_list(F.struct("start", "end")).alias("found"))

    single = held.filter("copies = 1").select("text_key", "text", "sure").join(found, "text_key", "left")
    end = lambda x: F.least(x["at"] + LENGTH, F.octet_length("text").cast("long"))
    settled = F.filter(F.transform(F.coalesce("sure", F.array()), lambda x: F.struct(x["start"].alias("start"), end(x).alias("end"))), lambda x: x["end"] - x["start"] >= LENGTH)
    both = single.select("text_key", "text", F.concat(settled, F.coalesce("found", F.array().cast("array<struct<start:long,end:long>>"))).alias("spans"))
    return base, copies, both.filter(F.size("spans") > 0)


def without_repeats(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", keep_bytes: bool = False) -> DataFrame:
    """Per document ``doc_id``, ``n_bytes``, ``n_removed``, ``n_spans``, ``kept_sha256``; with ``keep_bytes`` also
    ``kept``, the bytes left of the texts that lost some but not all (null: all or none are left)."""
    base, copies, spans = repeat_spans(docs, id_column, text_column)
    cut = spans.mapInArrow(_stripped, "text_key long, n_removed long, n_spans long, kept_sha256 string, kept binary")
    cut = stored(cut if keep_bytes else cut.drop("kept"))
    rows = base.drop("row_key").join(copies.select("text_key", "copies"), "text_key").join(cut, "text_key", "left")
    copied = (F.col("copies") > 1) & (F.col("n_bytes") >= LENGTH)
    nothing = hashlib.sha256(b"").hexdigest()
    return rows.select(
        "doc_id",
        "n_bytes",
        F.when(copied, F.col("n_bytes")).otherwise(F.coalesce("n_removed", F.lit(0))).cast("long").alias("n_removed"),
        F.when(copied, F.lit(1)).otherwise(F.coalesce("n_spans", F.lit(0))).cast("long").alias("n_spans"),
        F.when(copied, F.lit(nothing)).otherwise(F.coalesce("kept_sha256", "sha256")).alias("kept_sha256"),
        *(["kept"] if keep_bytes else []),
    )
