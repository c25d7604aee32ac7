"""EventData fields as columns, with their codes in words."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from vigilog.functions.text import basename
from vigilog.rules import events


def safe_int(column: Column) -> Column:
    """Whole number of a text, null when it is none."""
    return F.trim(column.cast("string")).try_cast("bigint")


def word(table: dict, code: Column, otherwise: Column) -> Column:
    pairs = F.create_map(*[F.lit(x) for pair in table.items() for x in pair])
    return F.coalesce(F.try_element_at(pairs, code), otherwise)


def field(data: Column, name: str) -> Column:
    """One EventData field; codes, paths and placeholders in readable form."""
    value = F.try_element_at(data, F.lit(name))
    if name == "LogonType":
        return word(events.LOGON_TYPES, value, value)
    if name in ("Status", "SubStatus"):
        return word(events.STATUS_CODES, F.lower(value), value)
    if name == "FailureReason":
        return word(events.FAILURE_REASONS, value, F.replace(value, F.lit("%%"), F.lit("")))
    if name in ("ProcessName", "ParentProcessName"):
        return basename(value)
    if name in ("IpAddress", "SourceAddress", "SourceNetworkAddress"):
        return F.nullif(value, F.lit("-"))
    return value


def event_data_columns(data: Column) -> dict[str, Column]:
    return {name: field(data, name) for name in events.EVENT_DATA_FIELDS}


def json_list(text: Column) -> Column:
    """A JSON list of strings; null or broken text becomes an empty list."""
    return F.coalesce(F.from_json(text, "array<string>"), F.array().cast("array<string>"))


def json_map(text: Column) -> Column:
    """A JSON object of strings; null or broken text becomes an empty map."""
    empty = F.map_from_arrays(F.array().cast("array<string>"), F.array().cast("array<string>"))
    return F.coalesce(F.from_json(text, "map<string,string>"), empty)
