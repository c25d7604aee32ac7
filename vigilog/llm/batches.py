"""Helpers of the operators that work on Arrow batches of whole texts."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

# The white space of every word rule: blank, tab, newline, vertical tab, form feed, return.
SPACE = r"[\x20\x09-\x0D]+"
BATCH_BYTES = 16 << 20


def bounded_batches(spark: SparkSession) -> None:
    """Bounds the bytes of an Arrow batch, so that long texts don't fill a worker."""
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    if int(spark.conf.get(name, str(2**31 - 1)).rstrip("bB")) > BATCH_BYTES:
        spark.conf.set(name, str(BATCH_BYTES))


def fresh(df: DataFrame, name: str) -> str:
    """A column name that ``df`` does not have, in either case."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name


def column(df: DataFrame, name: str):
    """The column of exactly this name, also where the name has dots or quotes."""
    return df["`" + name.replace("`", "``") + "`"]


def texts_of(df: DataFrame, id_column: str, text_column: str) -> DataFrame:
    """Only id and text (null text: empty), under the names ``doc_id`` and ``text``."""
    return df.select(column(df, id_column).alias("doc_id"), F.coalesce(column(df, text_column).cast("string"), F.lit("")).alias("text"))


def utf8(array: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of all strings of an Arrow array in a row, and where each begins (n + 1)."""
    array = array.cast(pa.large_binary())
    offsets = np.frombuffer(array.buffers()[1], dtype=np.int64)[array.offset : array.offset + len(array) + 1]
    data = array.buffers()[2]
    whole = np.frombuffer(data, dtype=np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return whole[offsets[0] : offsets[-1]], offsets - offsets[0]


def slabs(batch: pa.RecordBatch, text: str, size: int = 2 << 20) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """Slices of a batch of about ``size`` bytes of text (a longer text stands alone)."""
    data, offsets = utf8(batch.column(text))
    begin = 0
    while begin < batch.num_rows:
        end = max(begin + 1, int(np.searchsorted(offsets, offsets[begin] + size, side="right")) - 1)
        yield batch.slice(begin, end - begin), data[offsets[begin] : offsets[end]], offsets[begin : end + 1] - offsets[begin]
        begin = end


def grouped(batches: Iterator[pa.RecordBatch], key: str) -> Iterator[pa.Table]:
    """Runs of equal keys in a partition that is sorted by the key, many runs at a time.

    Every table holds whole runs only; the last run of a batch waits for the next one.
    """
    waiting: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        keys = batch.column(key)
        changes = np.flatnonzero(_differs(keys))
        cut = int(changes[-1]) + 1 if len(changes) else 0
        same = not waiting or waiting[-1].column(key)[waiting[-1].num_rows - 1] == keys[0]
        if waiting and not same:
            yield pa.Table.from_batches(waiting)
            waiting = []
        if cut:
            yield pa.Table.from_batches([*waiting, batch.slice(0, cut)])
            waiting = []
        waiting.append(batch.slice(cut))
    if waiting:
        yield pa.Table.from_batches(waiting)


def _differs(keys: pa.Array) -> np.ndarray:
    values = keys.to_numpy(zero_copy_only=False)
    return values[1:] != values[:-1]
