"""Queries P1-P19: parsing, normalisation and decoding of log rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from vigilog.functions import decode, text, timeparse
from vigilog.operators import features, normalize
from vigilog.plans.oracle import case, items, using
from vigilog.plans.registry import query
from vigilog.rules import events
from vigilog.sources.shared_tables import pick, read_table, security_log


def first_of(column: str, patterns: list[str]) -> str:
    return "coalesce(" + ", ".join(f"nullif(regexp_extract({column}, '{p}', 1), '')" for p in patterns) + ")"


@query("P1_time_text", using("seclog", f"SELECT record_id, {first_of('RawLog', events.TIME_PATTERNS)} AS Timestamp FROM seclog"))
def time_text(spark, sf_dir) -> DataFrame:
    return security_log(spark, sf_dir).select("record_id", text.time_text(F.col("RawLog")).alias("Timestamp"))


@query("P2_first_ipv4", using("seclog", f"SELECT record_id, nullif(regexp_extract(RawLog, '{events.IPV4_PATTERN}', 0), '') AS IP FROM seclog"))
def first_ipv4(spark, sf_dir) -> DataFrame:
    return security_log(spark, sf_dir).select("record_id", text.ipv4(F.col("RawLog")).alias("IP"))


@query(
    "P2_first_ipv4_in_documents",
    f"SELECT doc_id, nullif(regexp_extract(text, '{events.IPV4_PATTERN}', 0), '') AS IP FROM documents",
)
def first_ipv4_in_documents(spark, sf_dir) -> DataFrame:
    return read_table(spark, sf_dir, "documents").select("doc_id", text.ipv4(F.col("text")).alias("IP"))


@query(
    "P3_severity_word",
    using("seclog", f"SELECT record_id, upper(nullif(regexp_extract(RawLog, '(?i){events.SEVERITY_PATTERN}', 1), '')) AS Level FROM seclog"),
)
def severity_word(spark, sf_dir) -> DataFrame:
    return security_log(spark, sf_dir).select("record_id", text.severity_word(F.col("RawLog")).alias("Level"))


@query(
    "P4_user_token",
    using("seclog", f"""SELECT record_id, nullif(regexp_extract(RawLog, '(?i){events.USER_PATTERN}', 1), '') AS "User" FROM seclog"""),
)
def user_token(spark, sf_dir) -> DataFrame:
    return security_log(spark, sf_dir).select("record_id", text.user_token(F.col("RawLog")).alias("User"))


ACTION = "CASE " + " ".join(
    f"WHEN contains(lower({{0}}), '{w}') THEN '{w.capitalize()}'" for w in events.ACTION_WORDS
) + " END"


@query("P5_action_word", using("seclog", f"SELECT record_id, {ACTION.format('RawLog')} AS Action FROM seclog"))
def action_word(spark, sf_dir) -> DataFrame:
    return security_log(spark, sf_dir).select("record_id", text.action_word(F.col("RawLog")).alias("Action"))


@query("P5_action_word_in_documents", f"SELECT doc_id, {ACTION.format('text')} AS Action FROM documents")
def action_word_in_documents(spark, sf_dir) -> DataFrame:
    return read_table(spark, sf_dir, "documents").select("doc_id", text.action_word(F.col("text")).alias("Action"))


@query(
    "P6_safe_integer",
    """SELECT event_id AS record_id,
         CASE event_id % 4 WHEN 0 THEN user_id WHEN 1 THEN user_id WHEN 2 THEN NULL ELSE NULL END AS EventID FROM events""",
)
def safe_integer(spark, sf_dir) -> DataFrame:
    user = F.col("user_id").cast("string")
    shapes = F.element_at(
        F.array(user, F.concat(F.lit(" "), user, F.lit(" ")), F.concat(F.lit("x"), user), F.concat(user, F.lit(".5"))),
        (F.col("event_id") % 4 + 1).cast("int"),
    )
    df = read_table(spark, sf_dir, "events").select(F.col("event_id").alias("record_id"), shapes.alias("EventID"))
    return normalize.normalize(df).select("record_id", "EventID")


def time_texts(log: DataFrame) -> DataFrame:
    """Eight shapes of time text from EpochSeconds, chosen by record."""
    utc = F.timestamp_seconds("EpochSeconds")
    east = F.timestamp_seconds(F.col("EpochSeconds") + 19800)
    shapes = [
        F.date_format(utc, "yyyy-MM-dd'T'HH:mm:ss'Z'"),
        F.date_format(east, "yyyy-MM-dd'T'HH:mm:ss'+05:30'"),
        F.date_format(utc, "yyyy-MM-dd HH:mm:ss"),
        F.date_format(utc, "yyyy-MM-dd'T'HH:mm:ss'.250Z'"),
        F.date_format(utc, "yyyy/MM/dd HH:mm:ss"),
        F.date_format(utc, "dd/MMM/yyyy:HH:mm:ss"),
        F.concat(F.date_format(utc, "MMM"), F.lpad(F.dayofmonth(utc).cast("string"), 4, " "), F.date_format(utc, " HH:mm:ss")),
        F.lit("no time here"),
    ]
    shape = F.element_at(F.array(*shapes), (F.col("record_id") % 8 + 1).cast("int"))
    return log.select("record_id", shape.alias("TimeCreated"))


TIME_SQL = """
SELECT record_id,
       CASE WHEN shape = 7 THEN NULL WHEN shape = 6 THEN epoch_1900 ELSE EpochSeconds END AS EpochSeconds,
       CASE WHEN shape < 7 THEN CAST(CASE shape WHEN 6 THEN 1900 ELSE year(wall) END AS INTEGER) END AS Year,
       CASE WHEN shape < 7 THEN CAST(month(wall) AS INTEGER) END AS Month,
       CASE WHEN shape < 7 THEN CAST(day(wall) AS INTEGER) END AS Day,
       CASE WHEN shape < 7 THEN CAST(hour(wall) AS INTEGER) END AS Hour,
       CASE WHEN shape < 7 THEN CAST(minute(wall) AS INTEGER) END AS Minute,
       CASE WHEN shape < 7 THEN CAST(CASE shape WHEN 6 THEN isodow(wall_1900) ELSE isodow(wall) END - 1 AS INTEGER) END AS Weekday,
       CASE WHEN shape < 7 THEN CAST(CASE shape WHEN 6 THEN isodow(wall_1900) ELSE isodow(wall) END >= 6 AS INTEGER) END AS IsWeekend,
       CASE WHEN shape < 7 THEN strftime(CASE shape WHEN 6 THEN wall_1900 ELSE wall END, '%Y-%m-%dT%H:%M:%S')
         || CASE shape WHEN 3 THEN '.250000' ELSE '' END || CASE shape WHEN 1 THEN '+05:30' ELSE '+00:00' END END AS TimeCreatedISO
FROM (SELECT *, CAST(epoch(wall_1900) AS BIGINT) AS epoch_1900 FROM (
  SELECT *, make_timestamp(1900, CAST(month(wall) AS BIGINT), CAST(day(wall) AS BIGINT), CAST(hour(wall) AS BIGINT), CAST(minute(wall) AS BIGINT), CAST(second(wall) AS DOUBLE)) AS wall_1900 FROM (
    SELECT record_id, EpochSeconds, record_id % 8 AS shape,
           make_timestamp((EpochSeconds + CASE record_id % 8 WHEN 1 THEN 19800 ELSE 0 END) * 1000000) AS wall FROM seclog)))
"""


@query("P7_time_formats", using("seclog", f"SELECT record_id, EpochSeconds FROM ({TIME_SQL})"))
def time_formats(spark, sf_dir) -> DataFrame:
    df = normalize.normalize(time_texts(security_log(spark, sf_dir)))
    return df.select("record_id", "EpochSeconds")


@query("P8_calendar_parts", using("seclog", TIME_SQL))
def calendar_parts(spark, sf_dir) -> DataFrame:
    df = normalize.normalize(time_texts(security_log(spark, sf_dir)))
    return df.select(
        "record_id", "EpochSeconds", "Year", "Month", "Day", "Hour", "Minute", "Weekday", "IsWeekend", "TimeCreatedISO"
    )


@query(
    "P9_level_names",
    f"SELECT event_id AS record_id, {case('event_id % 7', events.LEVEL_NAMES)} AS LevelName FROM events",
)
def level_names(spark, sf_dir) -> DataFrame:
    df = read_table(spark, sf_dir, "events").select(
        F.col("event_id").alias("record_id"), (F.col("event_id") % 7).cast("string").alias("Level")
    )
    return normalize.normalize(df).select("record_id", "LevelName")


@query(
    "P10_event_data_squeeze",
    using("seclog", "SELECT record_id, nullif(regexp_replace(RawLog, '\\s+', ' ', 'g'), '') AS Message, 'a b' AS Pair, NULL::VARCHAR AS Blank FROM seclog"),
)
def event_data_squeeze(spark, sf_dir) -> DataFrame:
    log = security_log(spark, sf_dir)
    spaced = F.concat(F.lit("  "), F.replace("RawLog", F.lit(" "), F.lit(" \t ")), F.lit("\n"))
    # One phrase holds two blanks in a row already, which are squeezed as well.
    data = F.create_map(F.lit("Message"), spaced, F.lit("Pair"), F.lit("a \n  b"), F.lit("Blank"), F.lit("  "))
    df = normalize.normalize(log.select("record_id", data.alias("EventData")))
    return df.select("record_id", *[F.col("EventData")[k].alias(k) for k in ["Message", "Pair", "Blank"]])


STATUS = ["0xC000006D", "0xc0000234", "0x0", "0xC0000999"]
REASONS = ["%%2313", "%%9999"]
PATHS = ["C:\\Windows\\System32\\cmd.exe", "notepad.exe"]


def with_event_data(spark, sf_dir) -> DataFrame:
    number, user = F.col("event_id"), F.col("user_id")
    data = {
        "TargetUserName": F.concat(F.lit("user"), user.cast("string")),
        "LogonType": (2 + number % 11).cast("string"),
        "Status": pick(STATUS, number % 4),
        "SubStatus": pick(STATUS, user % 4),
        "FailureReason": pick(REASONS, number % 2),
        "IpAddress": F.when(number % 3 == 0, "-").otherwise(F.concat(F.lit("10.0.0."), (number % 50).cast("string"))),
        "ProcessName": pick(PATHS, number % 2),
        "ParentProcessName": pick(PATHS, user % 2),
    }
    pairs = F.create_map(*[x for name, value in data.items() for x in (F.lit(name), value)])
    return read_table(spark, sf_dir, "events").select(number.alias("record_id"), pairs.alias("EventData"))


DECODED = f"""
SELECT event_id AS record_id, 'user' || user_id AS TargetUserName,
       {case("CAST(2 + event_id % 11 AS VARCHAR)", events.LOGON_TYPES, "CAST(2 + event_id % 11 AS VARCHAR)")} AS LogonType,
       {case(f"lower({items(STATUS)}[1 + event_id % 4])", events.STATUS_CODES, f"{items(STATUS)}[1 + event_id % 4]")} AS Status,
       {case(f"lower({items(STATUS)}[1 + user_id % 4])", events.STATUS_CODES, f"{items(STATUS)}[1 + user_id % 4]")} AS SubStatus,
       {case(f"{items(REASONS)}[1 + event_id % 2]", events.FAILURE_REASONS, f"replace({items(REASONS)}[1 + event_id % 2], '%%', '')")} AS FailureReason,
       CASE WHEN event_id % 3 = 0 THEN NULL ELSE '10.0.0.' || (event_id % 50) END AS IpAddress,
       ['cmd.exe', 'notepad.exe'][1 + event_id % 2] AS ProcessName,
       ['cmd.exe', 'notepad.exe'][1 + user_id % 2] AS ParentProcessName,
       NULL::VARCHAR AS ServiceName
FROM events
"""


def decoded(spark, sf_dir) -> DataFrame:
    return normalize.expand_event_data(with_event_data(spark, sf_dir))


@query("P11_event_data_columns", f"SELECT record_id, TargetUserName, ServiceName FROM ({DECODED})")
def event_data_columns(spark, sf_dir) -> DataFrame:
    return decoded(spark, sf_dir).select("record_id", "TargetUserName", "ServiceName")


@query("P12_code_decoding", f"SELECT record_id, LogonType, Status, SubStatus, FailureReason FROM ({DECODED})")
def code_decoding(spark, sf_dir) -> DataFrame:
    return decoded(spark, sf_dir).select("record_id", "LogonType", "Status", "SubStatus", "FailureReason")


@query("P13_process_basename", f"SELECT record_id, ProcessName, ParentProcessName FROM ({DECODED})")
def process_basename(spark, sf_dir) -> DataFrame:
    return decoded(spark, sf_dir).select("record_id", "ProcessName", "ParentProcessName")


@query("P14_placeholder_address", f"SELECT record_id, IpAddress FROM ({DECODED})")
def placeholder_address(spark, sf_dir) -> DataFrame:
    return decoded(spark, sf_dir).select("record_id", "IpAddress")


@query("P15_report_columns", f'SELECT record_id, TargetUserName, IpAddress, ProcessName, LogonType, FailureReason, Status FROM ({DECODED})')
def report_columns(spark, sf_dir) -> DataFrame:
    df = decoded(spark, sf_dir)
    return df.select("record_id", *normalize.report_columns(df))


@query(
    "P16_report_headings",
    using("seclog", 'SELECT record_id, TimeCreatedISO AS "Timestamp", EventID AS "Event ID", Computer, "User" FROM seclog'),
)
def report_headings(spark, sf_dir) -> DataFrame:
    df = security_log(spark, sf_dir).select("record_id", "TimeCreatedISO", "EventID", "Computer", "User")
    return normalize.with_headings(df)


@query(
    "P17_finite_numbers",
    """SELECT event_id AS record_id, CASE event_id % 4 WHEN 0 THEN 0.0 WHEN 1 THEN 0.0 WHEN 2 THEN 0.0 ELSE value END AS value,
         CASE WHEN event_id % 4 = 0 THEN 0 ELSE user_id END AS user_id FROM events""",
)
def finite_numbers(spark, sf_dir) -> DataFrame:
    kind = F.col("event_id") % 4
    value = (
        F.when(kind == 0, F.lit(float("nan"))).when(kind == 1, F.lit(float("-inf"))).when(kind == 2, F.lit(None)).otherwise(F.col("value"))
    )
    df = read_table(spark, sf_dir, "events").select(
        F.col("event_id").alias("record_id"), features.finite(value).alias("value"),
        F.when(kind != 0, F.col("user_id")).alias("user_id"),
    )
    return features.fill_numbers(df)


@query("P18_model_features")
def model_features(spark, sf_dir) -> DataFrame:
    from pyspark.ml.feature import VectorAssembler

    df = features.extract_features(security_log(spark, sf_dir))
    names = features.ml_features(df)
    vectors = VectorAssembler(inputCols=names, outputCol="features").transform(
        df.select("record_id", *[features.finite(F.col(c)).alias(c) for c in names])
    )
    return vectors.select("record_id", "features")


@query(
    "P19_json_decoding",
    """SELECT event_id AS record_id, CASE WHEN event_id % 3 = 0 THEN 0 ELSE 2 END AS tactics,
         CASE WHEN event_id % 3 = 0 THEN '' ELSE event_type || ',x' END AS joined,
         CAST(json_extract(props, '$.k') AS VARCHAR) AS k FROM events""",
)
def json_decoding(spark, sf_dir) -> DataFrame:
    listed = F.concat(F.lit('["'), F.col("event_type"), F.lit('", "x"]'))
    broken = F.when(F.col("event_id") % 3 == 0, F.lit('["a", ')).otherwise(listed)
    values = decode.json_list(broken)
    return read_table(spark, sf_dir, "events").select(
        F.col("event_id").alias("record_id"), F.size(values).alias("tactics"), F.array_join(values, ",").alias("joined"),
        F.try_element_at(decode.json_map(F.col("props")), F.lit("k")).alias("k"),
    )
