"""Feature columns of the log. Every step is ``DataFrame -> DataFrame`` and guarded
by the presence of its input columns."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, functions as F, types as T

from vigilog.functions import text
from vigilog.operators.joins import attach
from vigilog.operators.profile import DISTINCT_COLUMNS, pinned_profiles
from vigilog.rules import events

COUNT_COLUMNS = {
    "Computer": "ComputerEventCount",
    "Channel": "ChannelEventCount",
    "User": "UserEventCount",
    "IP": "IPFrequency",
}
Z_COLUMNS = ["EventID", "ExecutionProcessID", "EventsPerMinute"]


def flag(condition: Column) -> Column:
    """1 where the condition holds, 0 where it does not or is unknown."""
    return F.coalesce(condition, F.lit(False)).cast("int")


def lookup(column: Column, table: dict, default) -> Column:
    """Value of a small constant table, ``default`` for unknown keys and nulls."""
    pairs = F.create_map(*[F.lit(x) for pair in table.items() for x in pair])
    return F.coalesce(F.try_element_at(pairs, column), F.lit(default))


def temporal(df: DataFrame) -> DataFrame:
    if "Hour" not in df.columns:
        return df
    hour = F.col("Hour")
    angle = hour * (2 * math.pi / 24)
    return df.withColumns(
        {
            "IsNightTime": flag((hour < 6) | (hour > 22)),
            "IsBusinessHours": flag(hour.between(9, 17)),
            "HourSin": F.coalesce(F.sin(angle), F.lit(0.0)),
            "HourCos": F.coalesce(F.cos(angle), F.lit(0.0)),
        }
    )


def level_severity(df: DataFrame) -> DataFrame:
    if "Level" not in df.columns:
        return df
    return df.withColumn("LevelSeverity", lookup(F.col("Level").cast("int"), events.LEVEL_SEVERITY, 0))


def frequencies(df: DataFrame, keys: DataFrame) -> DataFrame:
    """Value counts of the key columns and the per-host spread of EventID."""
    present = [c for c in ["EventID", *COUNT_COLUMNS] if c in df.columns]
    sizes = {r["kind"]: (r["size"], r["total"]) for r in keys.groupBy("kind").agg(F.count(F.lit(1)).alias("size"), F.sum("n").alias("total")).collect()}
    for column in present:
        name = COUNT_COLUMNS.get(column, "EventIDFrequency")
        table = keys.filter(F.col("kind") == column).select(
            F.col("key").alias("_key"), F.col("n").alias("_weight"), F.col("n").alias(name), "id_std"
        )
        wanted = {name: F.coalesce(F.col(name), F.lit(0))}
        if column == "Computer" and "EventID" in df.columns:
            wanted["EventIDStdPerComputer"] = F.coalesce(F.col("id_std"), F.lit(0.0))
        if column == "EventID":
            wanted["EventIDRarity"] = 1 / (F.coalesce(F.col(name), F.lit(0)) + 1.0)
        joined = attach(df.withColumn("_key", F.col(column).cast("string")), table, "_key", "_weight", measured=sizes.get(column, (0, 0)))
        df = joined.withColumns(wanted).drop("_key", "id_std")
    return df


def trailing_windows(df: DataFrame, seconds: DataFrame) -> DataFrame:
    """Gap to the previous event, events per minute, login ratio and distinct counts."""
    if "EpochSeconds" not in df.columns:
        return df
    joined = attach(df, seconds.withColumnRenamed("n", "_weight"), "EpochSeconds", "_weight")
    counts = ["EventsPerMinute"] + [name for c, name in DISTINCT_COLUMNS.items() if c in df.columns]
    first = F.col("record_id") == F.col("first_record")
    columns = {"TimeSincePrevEvent": F.when(first, F.col("gap")).otherwise(0)}
    columns |= {c: F.coalesce(F.col(c), F.lit(0)) for c in counts}
    if "EventID" in df.columns:
        columns["FailedLoginRatio"] = F.coalesce(F.col("FailedLoginRatio"), F.lit(0.0))
    dropped = ["gap", "first_record"] + ([] if "EventID" in df.columns else ["FailedLoginRatio"])
    return joined.withColumns(columns).drop(*dropped)


def event_flags(df: DataFrame) -> DataFrame:
    columns = {}
    if "EventID" in df.columns:
        columns = {name: flag(F.col("EventID").isin(ids)) for name, ids in events.EVENT_FLAGS.items()}
    if "ExecutionProcessID" in df.columns:
        columns["HasProcessID"] = F.col("ExecutionProcessID").isNotNull().cast("int")
    return df.withColumns(columns)


def text_features(df: DataFrame, column: str = "RawLog") -> DataFrame:
    columns = {}
    if column in df.columns:
        raw = F.coalesce(F.col(column), F.lit(""))
        columns["LogLength"] = F.length(raw)
        columns["LogWordCount"] = text.word_count(raw)
        columns |= {name: text.mentions(raw, name).cast("int") for name in events.TEXT_FLAGS}
        columns["LogEntropy"] = text.entropy(raw)
    if "EventData" in df.columns:
        columns["EventDataCount"] = F.coalesce(F.size(F.map_keys("EventData")), F.lit(0))
    if "Action" in df.columns:
        columns["ActionSeverity"] = lookup(F.col("Action"), events.ACTION_SEVERITY, 0)
    return df.withColumns(columns)


def z_scores(df: DataFrame, log: DataFrame | None = None, seconds: DataFrame | None = None) -> DataFrame:
    """Distance from the mean in sample standard deviations, 0 without spread.

    With ``log`` and ``seconds`` the statistics come from the narrow source columns
    and the per-second table, so that ``df`` is not evaluated twice.
    """
    source = log if log is not None else df
    own = [c for c in Z_COLUMNS if c in source.columns]
    stats = source.agg(
        F.count(F.lit(1)).cast("double").alias("rows"),
        *[F.avg(c).alias("m_" + c) for c in own],
        *[F.stddev_samp(c).alias("s_" + c) for c in own],
    )
    moments = {c: (stats.select("m_" + c).scalar(), stats.select("s_" + c).scalar()) for c in own}
    if "EventsPerMinute" not in own and "EventsPerMinute" in df.columns and seconds is not None:
        rate = F.col("EventsPerMinute")
        sums = seconds.agg(
            F.coalesce(F.sum(F.col("n") * rate), F.lit(0)).cast("double").alias("s1"),
            F.coalesce(F.sum((F.col("n") * rate * rate).cast("decimal(38,0)")), F.lit(0)).cast("double").alias("s2"),
        )
        rows, s1, s2 = stats.select("rows").scalar(), sums.select("s1").scalar(), sums.select("s2").scalar()
        variance = F.try_divide(s2 - F.try_divide(s1 * s1, rows), rows - 1)
        moments["EventsPerMinute"] = (F.try_divide(s1, rows), F.sqrt(F.greatest(variance, F.lit(0.0))))
    scores = {
        c + "_ZScore": F.when(std > 0, (F.col(c) - mean) / std).otherwise(0.0) for c, (mean, std) in moments.items()
    }
    return df.withColumns(scores)


def fill_numbers(df: DataFrame, keep: tuple = ("EpochSeconds", "Year", "Month", "Day", "Hour", "Minute", "Weekday")) -> DataFrame:
    """Numeric nulls become 0; times stay null, so that a missing time is never 1970."""
    numeric = [f.name for f in df.schema if isinstance(f.dataType, T.NumericType) and f.name not in keep]
    return df.fillna(0, subset=[c for c in numeric if c != "record_id"])


def extract_features(log: DataFrame, profiles: tuple[DataFrame, DataFrame] | None = None) -> DataFrame:
    """All feature columns and the event knowledge, in a fixed order."""
    from vigilog.operators.knowledge import enrich

    keys, seconds = profiles or pinned_profiles(log)
    df = (
        log.transform(temporal)
        .transform(level_severity)
        .transform(frequencies, keys)
        .transform(trailing_windows, seconds)
        .transform(event_flags)
        .transform(text_features)
        .transform(z_scores, log, seconds)
    )
    if "EventID" in log.columns:
        df = enrich(df)
    return fill_numbers(df)


def ml_features(df: DataFrame) -> list[str]:
    """Names of the numeric columns that enter a model."""
    excluded = {*events.NON_FEATURES, "record_id"}
    return [f.name for f in df.schema if isinstance(f.dataType, T.NumericType) and f.name not in excluded]


def finite(column: Column) -> Column:
    """Null, NaN and infinity become 0."""
    x = column.cast("double")
    return F.when(x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")), 0.0).otherwise(x)
