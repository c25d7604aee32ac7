"""One schema for the rows of all readers."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F, types as T

from vigilog.functions import decode, timeparse
from vigilog.functions.text import squeeze
from vigilog.rules import events

INTEGERS = ["EventRecordID", "EventID", "Level", "ExecutionProcessID", "ExecutionThreadID"]


def normalize(raw: DataFrame) -> DataFrame:
    """Integers, time columns, level names and clean EventData.

    A column that a source does not have is added as null for the integers and
    the time columns. A level that is a word is kept in ``LevelText``.
    """
    present = set(raw.columns)
    df = raw
    if "Level" in present and "LevelText" not in present:
        word = F.col("Level").cast("string")
        df = df.withColumn("LevelText", F.when(decode.safe_int(word).isNull(), word))
    text = F.lit(None).cast("string")
    for name in ["Timestamp", "TimeCreated"]:
        if name in present:
            text = F.coalesce(F.nullif(F.col(name).cast("string"), F.lit("")), text)
    # The time is parsed once; the derived columns read the stored text.
    df = df.withColumn("_time", text).withColumns(
        {c: decode.safe_int(F.col(c)) if c in present else F.lit(None).cast("long") for c in INTEGERS}
    )
    df = df.withColumns(timeparse.time_columns(F.col("_time"))).drop("_time")
    old_name = F.col("LevelName") if "LevelName" in present else F.lit(None).cast("string")
    df = df.withColumn("LevelName", decode.word(events.LEVEL_NAMES, F.col("Level").cast("int"), old_name))
    if "EventData" in present:
        df = clean_event_data(df)
    return df


def clean_event_data(df: DataFrame) -> DataFrame:
    """EventData as a map of text without superfluous white space; empty text is null."""
    data = F.col("EventData")
    kind = df.schema["EventData"].dataType
    if isinstance(kind, T.StructType):
        names = F.array(*[F.lit(f.name) for f in kind.fields])
        data = F.map_from_arrays(names, F.array(*[data[f.name].cast("string") for f in kind.fields]))
    elif not isinstance(kind, T.MapType):
        return df
    data = F.transform_values(data, lambda _, value: squeeze(value.cast("string")))
    empty = F.map_from_arrays(F.array().cast("array<string>"), F.array().cast("array<string>"))
    return df.withColumn("EventData", F.coalesce(data, empty))


def expand_event_data(df: DataFrame) -> DataFrame:
    """The EventData fields as columns, decoded."""
    if "EventData" not in df.columns:
        return df
    return df.withColumns(decode.event_data_columns(F.col("EventData")))


def report_columns(df: DataFrame, wanted: list[str] = events.REPORT_COLUMNS) -> list[str]:
    """The wanted columns that exist and hold at least one value."""
    present = [c for c in wanted if c in df.columns]
    if not present:
        return df.columns[:5]
    counts = df.agg(*[F.count(c).alias(c) for c in present]).first()
    return [c for c in present if counts[c] > 0]


def with_headings(df: DataFrame) -> DataFrame:
    return df.withColumnsRenamed({k: v for k, v in events.REPORT_HEADINGS.items() if k in df.columns})
