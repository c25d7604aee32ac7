"""Time stamps in the formats that logs use, with the clock of their source.

A time is parsed to the wall clock of its source and the offset of that clock;
calendar columns follow the wall clock, epoch seconds follow UTC.
"""

from __future__ import annotations

from pyspark.sql import Column, functions as F

ISO_DATE = r"^\d{4}-\d{2}-\d{2}$"
ISO_TIME = r"^\d{4}-\d{2}-\d{2}[T ]\d{2}:\d{2}(?::\d{2}(?:[.,]\d+)?)?$"
ZONE = r"(Z|[+-]\d{2}:?\d{2})$"


def zone_text(text: Column) -> Column:
    """The zone at the end of an ISO time as ``+hh:mm``; '+00:00' when there is none."""
    has_clock = text.rlike(r"\d{2}:\d{2}.*" + ZONE)
    zone = F.when(has_clock, F.regexp_extract(text, ZONE, 1)).otherwise("")
    signed = F.concat(F.substring(zone, 1, 3), F.lit(":"), F.substring(zone, -2, 2))
    return F.when(zone.isin("", "Z"), "+00:00").otherwise(signed)


def offset_seconds(zone: Column) -> Column:
    """Seconds east of UTC of a ``+hh:mm`` zone."""
    size = F.substring(zone, 2, 2).cast("int") * 3600 + F.substring(zone, 5, 2).cast("int") * 60
    return F.when(zone.startswith("-"), -size).otherwise(size)


def wall_clock(text: Column) -> Column:
    """Time without zone, null for text that is not a time.

    ISO times come first, then year/month/day, then the day/month-name form of web
    servers, then the form of syslog, which has no year and is put in 1900.
    """
    has_clock = text.rlike(r"\d{2}:\d{2}.*" + ZONE)
    body = F.when(has_clock, F.regexp_replace(text, ZONE, "")).otherwise(F.regexp_replace(text, "Z$", ""))
    iso = F.when(body.rlike(ISO_DATE) | body.rlike(ISO_TIME), body.try_cast("timestamp_ntz"))
    named = F.initcap(F.lower(F.regexp_replace(text, r"\s+", " ")))

    def formatted(value: Column, pattern: str) -> Column:
        return F.try_to_timestamp(value, F.lit(pattern)).cast("timestamp_ntz")

    return F.coalesce(
        iso,
        formatted(text, "y/M/d H:m:s"),
        formatted(F.regexp_replace(named, "/([a-z])", "/$1"), "d/MMM/y:H:m:s"),
        formatted(F.concat(F.lit("1900 "), named), "y MMM d H:m:s"),
    )


def time_columns(text: Column) -> dict[str, Column]:
    """All time columns of a log row from the text of its time."""
    wall = wall_clock(text)
    zone = F.when(wall.isNotNull(), zone_text(text))
    epoch = F.timestamp_diff("SECOND", F.lit("1970-01-01 00:00:00").cast("timestamp_ntz"), wall) - offset_seconds(zone)
    pattern = F.when(F.date_format(wall, "SSSSSS") == "000000", F.date_format(wall, "yyyy-MM-dd'T'HH:mm:ss")).otherwise(
        F.date_format(wall, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS")
    )
    return {
        "event_ts": F.timestamp_seconds(epoch),
        "TimeCreatedISO": F.concat(pattern, zone),
        "Year": F.year(wall),
        "Month": F.month(wall),
        "Day": F.dayofmonth(wall),
        "Hour": F.hour(wall),
        "Minute": F.minute(wall),
        "Weekday": F.weekday(wall),
        "IsWeekend": (F.weekday(wall) >= 5).cast("int"),
        "EpochSeconds": epoch,
    }
