"""Log files of four formats as DataFrames of the log schema."""

from __future__ import annotations

import uuid
from functools import reduce
from urllib.parse import unquote

from pyspark.sql import Column, DataFrame, Observation, SparkSession, Window, functions as F

from vigilog.functions import text
from vigilog.operators.joins import BROADCAST_ROWS
from vigilog.operators.normalize import normalize
from vigilog.session import shared_folder
from vigilog.sources.records import csv_piece, json_lines, records

FORMATS = {".csv": "csv", ".json": "json", ".log": "text", ".txt": "text", ".xml": "xml"}
BROKEN = "_corrupt_record"

XML_SCHEMA = """
System struct<
  Provider: struct<_Name: string, _Guid: string>,
  EventID: struct<_VALUE: string, _Qualifiers: string>,
  Level: string, Task: string, Opcode: string, Keywords: string,
  TimeCreated: struct<_SystemTime: string>,
  EventRecordID: string,
  Execution: struct<_ProcessID: string, _ThreadID: string>,
  Channel: string, Computer: string,
  Security: struct<_UserID: string>>,
EventData struct<Data: array<struct<_VALUE: string, _Name: string>>>,
_corrupt_record string
"""


def first_lines(spark: SparkSession, paths: list[str]) -> dict[str, list[str]]:
    """The first line that is not blank of each file, and the files that begin with it.

    One narrow pass whose result has a row per file, as the driver's list of files has.
    """
    lines = spark.read.text(paths).select(
        "value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("place")
    )
    heads = lines.filter((F.col("block") == 0) & (F.trim("value") != "")).groupBy("file").agg(F.min_by("value", "place").alias("head"))
    found: dict[str, list[str]] = {}
    for row in heads.orderBy("file").collect():
        found.setdefault(row["head"], []).append(unquote(row["file"]))
    return found


def united(frames: list[DataFrame]) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)


def _csv_heads(spark: SparkSession, paths: list[str]) -> dict[tuple[str, bool], list[str]]:
    """The files by their first line that is not blank, and whether a quoted value may hold a line break (a line has an odd number of quotes)."""
    lines = spark.read.text(paths).select(
        "value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("place")
    )
    own = (F.col("block") == 0) & (F.trim("value") != "")
    odd = F.length(F.regexp_replace("value", '[^"]', "")) % 2 == 1
    heads = lines.groupBy("file").agg(F.min_by(F.when(own, F.col("value")), F.when(own, F.col("place"))).alias("head"), F.bool_or(odd).alias("odd"))
    found: dict[tuple[str, bool], list[str]] = {}
    for row in heads.filter("head is not null").orderBy("file").collect():  # a row per file
        found.setdefault((row["head"], row["odd"]), []).append(unquote(row["file"]))
    return found


CSV_OPTIONS = {"escape": '"', "mode": "PERMISSIVE", "columnNameOfCorruptRecord": BROKEN}


def _quoted(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"


def _csv_schema(names: list[str], *more: str) -> str:
    return ", ".join(f"{_quoted(n)} string" for n in [*names, *more])


def read_csv(spark: SparkSession, paths: list[str]) -> DataFrame:
    """Header files, every column a string, ``source_file`` and ``_corrupt_record``. Files of
    different headers are read apart and have the columns of all of them.

    Quoted values may hold line breaks; such files are put together from lines (``records``) and split
    like others. A record with fewer values than the header has nulls; one with more values, or with
    a quote that is never closed, is broken.
    """
    frames = []
    for (_, odd), files in _csv_heads(spark, paths).items():
        names = spark.read.csv(files, header=True, escape='"').columns
        schema = _csv_schema(names, BROKEN)
        kept = [n for n in names if n.lower() not in (BROKEN, "source_file")]
        if odd:
            rows = records(spark, files, "\n", csv_piece).filter(~F.col("head") & (F.trim(F.translate("text", "\r\n", "")) != ""))
            text = F.regexp_replace("text", r"\r?\n\z", "")
            parsed = F.from_csv(text, F.lit(schema), CSV_OPTIONS)
            rows = rows.select(parsed.alias("r"), F.col("file").alias("source_file"), text.alias("_text"))
            rows = rows.select(*[F.col("r")[n].alias(n) for n in [*kept, BROKEN]], "source_file", "_text")
            unclosed = (F.length(F.regexp_replace("_text", '[^"]', "")) % 2 == 1) & F.col("_text").contains("\n")
            raw = F.when(F.col(BROKEN).isNotNull() | unclosed, F.col("_text"))
        else:
            reader = spark.read.schema(schema).option("columnPruning", False).option("enforceSchema", True)
            rows = reader.csv(files, header=True, **CSV_OPTIONS).withColumn("source_file", F.col("_metadata.file_path"))
            unclosed, raw = F.lit(False), F.col(BROKEN)
        # Only records of another number of values are read again, with room for one value more.
        room = F.from_csv(raw, F.lit(_csv_schema([f"c{i}" for i in range(len(names) + 1)])), {"escape": '"'})
        more = raw.isNotNull() & room[f"c{len(names)}"].isNotNull()
        frames.append(rows.withColumn(BROKEN, F.when(unclosed | more, raw)).select(*[F.col(_quoted(n)) for n in kept], BROKEN, "source_file"))
    return united(frames) if frames else spark.read.csv(paths, header=True).withColumn("source_file", F.col("_metadata.file_path"))


def read_json(spark: SparkSession, paths: list[str], lines: bool = False, schema=None) -> DataFrame:
    """Files with an array of events or a single event, which all tasks read at once; ``lines``
    reads one event per line. A broken element of an array is one broken record."""
    reader = spark.read.option("columnNameOfCorruptRecord", BROKEN)
    if schema is not None:
        reader = reader.schema(schema)
    if lines:
        return reader.json(paths)
    parts = [json_lines(spark, files, base) for base, files in _first_signs(spark, paths).items() if files]
    if not parts:
        return reader.json(paths)
    folder = f"{shared_folder(spark)}/{uuid.uuid4().hex}"
    reduce(lambda a, b: a.unionAll(b), parts).write.text(folder)
    return reader.json(folder)


def _first_signs(spark: SparkSession, paths: list[str]) -> dict[int, list[str]]:
    """The files that begin with a bracket (1), and the others that are not empty (0)."""
    pieces = spark.read.text(paths, lineSep="}").select(
        "value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("place")
    )
    sign = F.regexp_extract("value", r"^[\s\ufeff]*(\S)", 1)
    heads = pieces.filter("block = 0").groupBy("file").agg(F.min_by(sign, "place").alias("sign"))
    found: dict[int, list[str]] = {1: [], 0: []}
    for row in heads.filter("sign <> ''").orderBy("file").collect():  # a row per file
        found[int(row["sign"] == "[")].append(unquote(row["file"]))
    return found


def read_any_json(spark: SparkSession, paths: list[str]) -> DataFrame:
    """Files of any of the three layouts. A file whose first line is a whole object holds one
    event per line; the others are an array or one event over several lines. All are split."""
    signs = _first_signs(spark, paths)
    heads = first_lines(spark, signs[0]) if signs[0] else {}
    whole = dict(spark.createDataFrame([(h,) for h in heads], "head string").select("head", F.get_json_object("head", "$").isNotNull() & F.startswith(F.trim("head"), F.lit("{"))).collect()) if heads else {}
    groups = {lines: [f for h, files in heads.items() if whole[h] == lines for f in files] for lines in (True, False)}
    groups[False] += signs[1]
    return united([read_json(spark, files, lines) for lines, files in groups.items() if files] or [read_json(spark, paths, True)])


def numbered_lines(spark: SparkSession, paths: list[str]) -> DataFrame:
    """``(source_file, LineNumber, value)``: numbers start at 1 and count blank lines.

    A line is numbered inside its file split; the lines of the splits before it are
    added from a table with one row per split.
    """
    lines = spark.read.text(paths).select(
        "value",
        F.col("_metadata.file_path").alias("source_file"),
        F.col("_metadata.file_block_start").alias("block"),
        F.monotonically_increasing_id().alias("place"),
    )
    splits = lines.groupBy("source_file", "block").agg(F.min("place").alias("first"), F.count(F.lit(1)).alias("n"))
    earlier = Window.partitionBy("source_file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    starts = splits.select(
        "source_file", "block", (F.coalesce(F.sum("n").over(earlier), F.lit(0)) - F.col("first")).alias("shift")
    )
    if starts.count() <= BROADCAST_ROWS:
        starts = F.broadcast(starts)
    return lines.join(starts, ["source_file", "block"]).select(
        "source_file", (F.col("place") + F.col("shift") + 1).alias("LineNumber"), "value"
    )


def line_columns(line: Column) -> dict[str, Column]:
    return {
        "Timestamp": text.time_text(line),
        "Level": text.severity_word(line),
        "User": text.user_token(line),
        "IP": text.ipv4(line),
        "Action": text.action_word(line),
    }


def read_text(spark: SparkSession, paths: list[str]) -> DataFrame:
    """One event per line that is not blank. Bytes that are not UTF-8 are left out."""
    valid = F.translate(F.make_valid_utf8("value"), "�", "")
    stripped = F.regexp_replace(valid, f"^[{text.BLANK}]+|[{text.BLANK}]+$", "")
    rows = numbered_lines(spark, paths).withColumn("RawLog", stripped).drop("value").filter("RawLog <> ''")
    return rows.withColumns(line_columns(F.col("RawLog")))


def event_data_map(data: Column) -> Column:
    """Name/value pairs as a map; an unnamed value is called Data_<number of names so
    far>, and of several values of one name the last one counts."""

    def named(item: Column, position: Column) -> Column:
        before = F.slice(data, F.lit(1), position)
        names = F.transform(before, lambda x: F.nullif(x["_Name"], F.lit("")))
        distinct = F.size(F.array_distinct(F.array_compact(names)))
        unnamed = F.size(F.filter(names, lambda n: n.isNull()))
        label = F.coalesce(
            F.nullif(item["_Name"], F.lit("")), F.concat(F.lit("Data_"), (distinct + unnamed).cast("string"))
        )
        return F.struct(label.alias("key"), item["_VALUE"].alias("value"))

    pairs = F.transform(data, named)
    last = F.filter(
        pairs,
        lambda pair, i: ~F.exists(F.slice(pairs, i + 2, F.size(pairs)), lambda later: later["key"] == pair["key"]),
    )
    return F.map_from_entries(last)


def xml_columns() -> dict[str, Column]:
    system = F.col("System")
    fields = {
        "EventID": system["EventID"]["_VALUE"],
        "Level": system["Level"],
        "TimeCreated": system["TimeCreated"]["_SystemTime"],
        "Computer": system["Computer"],
        "Channel": system["Channel"],
        "ProviderName": system["Provider"]["_Name"],
        "ProviderGuid": system["Provider"]["_Guid"],
        "Keywords": system["Keywords"],
        "Task": system["Task"],
        "Opcode": system["Opcode"],
        "EventRecordID": system["EventRecordID"],
        "ExecutionProcessID": system["Execution"]["_ProcessID"],
        "ExecutionThreadID": system["Execution"]["_ThreadID"],
        "SecurityUserID": system["Security"]["_UserID"],
    }
    data = F.coalesce(F.col("EventData.Data"), F.array().cast("array<struct<_VALUE: string, _Name: string>>"))
    return fields | {"EventData": event_data_map(data)}


def read_xml(spark: SparkSession, paths: list[str]) -> DataFrame:
    """Rendered event XML, one row per Event element; broken ones in ``_corrupt_record``.

    The files are cut at the closing tag of an event, so that Spark can split them
    and a broken event does not spoil the ones after it.
    """
    pieces = spark.read.text(paths, lineSep="</Event>").select(
        F.nullif(F.regexp_extract("value", r"(?s)<Event[\s>].*", 0), F.lit("")).alias("xml")
    )
    options = {"ignoreNamespace": "true", "mode": "PERMISSIVE", "columnNameOfCorruptRecord": BROKEN}
    parsed = F.from_xml(F.concat("xml", F.lit("</Event>")), XML_SCHEMA, options)
    events = pieces.filter("xml is not null").select(parsed.alias("event")).select("event.*")
    return events.select(*[c.alias(n) for n, c in xml_columns().items()], BROKEN)


def ingest_quality(raw: DataFrame) -> DataFrame:
    """One row with the numbers of good and broken records."""
    if BROKEN not in raw.columns:
        return raw.agg(F.count(F.lit(1)).alias("good"), F.lit(0).cast("long").alias("broken"))
    # Broken is what fails against all columns, so the condition reads every column.
    read = F.concat(*[F.col(c).isNull().cast("string") for c in raw.columns if c != BROKEN]) != ""
    return raw.agg(
        F.count_if(F.col(BROKEN).isNull() & read).alias("good"),
        F.count_if(F.col(BROKEN).isNotNull() & read).alias("broken"),
    )


def without_broken(raw: DataFrame, counts: Observation | None = None) -> DataFrame:
    """The good records; an error when there are broken ones only.

    The check reads up to the first good record. The numbers of good and broken
    records are filled into ``counts`` by the job that reads the result.
    """
    if BROKEN not in raw.columns:
        return raw
    if counts is not None:
        good, broken = F.count_if(F.col(BROKEN).isNull()), F.count_if(F.col(BROKEN).isNotNull())
        raw = raw.observe(counts, good.alias("good"), broken.alias("broken"))
    if not raw.filter(F.col(BROKEN).isNull()).take(1) and raw.take(1):
        raise ValueError("none of the records could be read")
    return raw.filter(F.col(BROKEN).isNull()).drop(BROKEN)


def format_of(path: str) -> str:
    for suffix, name in FORMATS.items():
        if path.lower().endswith(suffix):
            return name
    raise ValueError(f"unsupported file format: {path}")


def read_raw(spark: SparkSession, paths: list[str], fmt: str, counts: Observation | None = None) -> DataFrame:
    readers = {"csv": read_csv, "json": read_any_json, "text": read_text, "xml": read_xml}
    raw = readers[fmt](spark, paths)
    return without_broken(raw, counts)


def read_logs(
    spark: SparkSession, paths: list[str] | str, fmt: str | None = None, counts: Observation | None = None
) -> DataFrame:
    """Log files of any mix of formats as one normalised DataFrame.

    ``record_id`` numbers the rows of this read. It follows the file splits, so
    write the result to a table before several jobs refer to the ids.
    """
    listed = [paths] if isinstance(paths, str) else list(paths)
    by_format: dict[str, list[str]] = {}
    for path in listed:
        by_format.setdefault(fmt or format_of(path), []).append(path)
    frames = [normalize(read_raw(spark, members, name, counts)) for name, members in by_format.items()]
    if not frames:
        raise ValueError("no files given")
    return united(frames).withColumn("record_id", F.monotonically_increasing_id())
