"""Queries F1-F20: feature columns over the security log and the shared texts."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from vigilog.functions import text
from vigilog.operators import features, profile
from vigilog.plans.oracle import entropy, text_flag, using, word_count
from vigilog.plans.registry import query
from vigilog.rules import events
from vigilog.session import pinned
from vigilog.sources.shared_tables import read_table, security_log


def rounded(*names: str) -> list:
    return [F.round(F.col(n), 6).alias(n) for n in names]


def sql_rounded(*names: str) -> str:
    return ", ".join(f"round({n}, 6) AS {n}" for n in names)


@query("F1_night_and_business_hours", using("feats", "SELECT record_id, IsNightTime, IsBusinessHours FROM feats"))
def night_and_business_hours(spark, sf_dir) -> DataFrame:
    return features.temporal(security_log(spark, sf_dir)).select("record_id", "IsNightTime", "IsBusinessHours")


@query(
    "F2_hour_circle",
    using("seclog", "SELECT record_id, round(sin(2 * pi() * Hour / 24), 6) + 0 AS HourSin, round(cos(2 * pi() * Hour / 24), 6) + 0 AS HourCos FROM seclog"),
)
def hour_circle(spark, sf_dir) -> DataFrame:
    df = features.temporal(security_log(spark, sf_dir))
    return df.select("record_id", *[(F.round(F.col(c), 6) + 0).alias(c) for c in ["HourSin", "HourCos"]])


def trailing(spark, sf_dir, *columns: str) -> DataFrame:
    log = security_log(spark, sf_dir)
    df = features.trailing_windows(log, pinned(profile.second_profile(log)))
    return df.select("record_id", *columns)


@query("F3_time_since_previous_event", using("feats", "SELECT record_id, TimeSincePrevEvent FROM feats"))
def time_since_previous_event(spark, sf_dir) -> DataFrame:
    return trailing(spark, sf_dir, "TimeSincePrevEvent")


def counted(spark, sf_dir, *columns: str) -> DataFrame:
    log = security_log(spark, sf_dir)
    return features.frequencies(log, pinned(profile.key_profile(log))).select("record_id", *columns)


@query("F4_event_id_frequency", using("feats", f"SELECT record_id, EventIDFrequency, {sql_rounded('EventIDRarity')} FROM feats"))
def event_id_frequency(spark, sf_dir) -> DataFrame:
    return counted(spark, sf_dir, "EventIDFrequency", *rounded("EventIDRarity"))


@query("F5_level_severity", using("feats", "SELECT record_id, LevelSeverity FROM feats"))
def level_severity(spark, sf_dir) -> DataFrame:
    return features.level_severity(security_log(spark, sf_dir)).select("record_id", "LevelSeverity")


@query(
    "F6_value_counts",
    using("feats", "SELECT record_id, ComputerEventCount, ChannelEventCount, UserEventCount FROM feats"),
)
def value_counts(spark, sf_dir) -> DataFrame:
    return counted(spark, sf_dir, "ComputerEventCount", "ChannelEventCount", "UserEventCount")


@query("F7_events_per_minute", using("feats", "SELECT record_id, EventsPerMinute FROM feats"))
def events_per_minute(spark, sf_dir) -> DataFrame:
    return trailing(spark, sf_dir, "EventsPerMinute")


@query("F8_unique_event_ids_in_window", using("feats", "SELECT record_id, UniqueEventIDsInWindow FROM feats"))
def unique_event_ids(spark, sf_dir) -> DataFrame:
    return trailing(spark, sf_dir, "UniqueEventIDsInWindow")


@query("F9_event_flags", using("feats", f"SELECT record_id, {', '.join(events.EVENT_FLAGS)} FROM feats"))
def event_flags(spark, sf_dir) -> DataFrame:
    return features.event_flags(security_log(spark, sf_dir)).select("record_id", *events.EVENT_FLAGS)


@query("F10_failed_login_ratio", using("feats", f"SELECT record_id, {sql_rounded('FailedLoginRatio')} FROM feats"))
def failed_login_ratio(spark, sf_dir) -> DataFrame:
    return trailing(spark, sf_dir, *rounded("FailedLoginRatio"))


@query("F11_process_counts", using("feats", "SELECT record_id, HasProcessID, UniqueProcessCount FROM feats"))
def process_counts(spark, sf_dir) -> DataFrame:
    log = features.event_flags(security_log(spark, sf_dir))
    df = features.trailing_windows(log, pinned(profile.second_profile(log)))
    return df.select("record_id", "HasProcessID", "UniqueProcessCount")


@query("F12_ip_counts", using("feats", "SELECT record_id, IPFrequency, UniqueIPCount FROM feats"))
def ip_counts(spark, sf_dir) -> DataFrame:
    log = security_log(spark, sf_dir)
    keys, seconds = features.pinned_profiles(log)
    df = features.trailing_windows(features.frequencies(log, keys), seconds)
    return df.select("record_id", "IPFrequency", "UniqueIPCount")


@query("F13_log_length", using("feats", "SELECT record_id, LogLength, LogWordCount FROM feats"))
def log_length(spark, sf_dir) -> DataFrame:
    return features.text_features(security_log(spark, sf_dir)).select("record_id", "LogLength", "LogWordCount")


@query(
    "F13_document_length",
    f"SELECT doc_id, length(text) AS LogLength, {word_count('text')} AS LogWordCount FROM documents",
)
def document_length(spark, sf_dir) -> DataFrame:
    df = features.text_features(read_table(spark, sf_dir, "documents"), "text")
    return df.select("doc_id", "LogLength", "LogWordCount")


@query("F14_text_flags", using("feats", f"SELECT record_id, {', '.join(events.TEXT_FLAGS)} FROM feats"))
def text_flags(spark, sf_dir) -> DataFrame:
    return features.text_features(security_log(spark, sf_dir)).select("record_id", *events.TEXT_FLAGS)


@query(
    "F14_document_flags",
    "SELECT doc_id, " + ", ".join(f"{text_flag('text', n)} AS {n}" for n in events.TEXT_FLAGS) + " FROM documents",
)
def document_flags(spark, sf_dir) -> DataFrame:
    df = features.text_features(read_table(spark, sf_dir, "documents"), "text")
    return df.select("doc_id", *events.TEXT_FLAGS)


@query("F15_log_entropy", using("feats", f"SELECT record_id, {sql_rounded('LogEntropy')} FROM feats"))
def log_entropy(spark, sf_dir) -> DataFrame:
    return features.text_features(security_log(spark, sf_dir)).select("record_id", *rounded("LogEntropy"))


@query("F15_document_entropy", f"SELECT doc_id, round({entropy('text')}, 6) AS LogEntropy FROM documents")
def document_entropy(spark, sf_dir) -> DataFrame:
    documents = read_table(spark, sf_dir, "documents")
    return documents.select("doc_id", F.round(text.entropy(F.coalesce("text", F.lit(""))), 6).alias("LogEntropy"))


@query(
    "F16_event_data_count",
    "SELECT event_id AS record_id, CASE WHEN event_id % 4 = 0 THEN 0 ELSE 2 + CAST(user_id % 2 AS INTEGER) END AS EventDataCount FROM events",
)
def event_data_count(spark, sf_dir) -> DataFrame:
    third = F.when(F.col("user_id") % 2 == 1, F.lit("AccessMask"))
    names = F.array_compact(F.array(F.lit("TargetUserName"), F.lit("IpAddress"), third))
    data = F.map_from_arrays(names, F.transform(names, lambda n: F.concat(n, F.col("user_id").cast("string"))))
    df = read_table(spark, sf_dir, "events").select(
        F.col("event_id").alias("record_id"), F.when(F.col("event_id") % 4 != 0, data).alias("EventData")
    )
    return features.text_features(df).select("record_id", "EventDataCount")


@query(
    "F17_action_severity",
    using("seclog", """
      SELECT record_id, CASE WHEN t LIKE '%login%' THEN 1 WHEN t LIKE '%logout%' THEN 1 WHEN t LIKE '%failed%' THEN 3
        WHEN t LIKE '%success%' THEN 0 WHEN t LIKE '%denied%' THEN 4 WHEN t LIKE '%access%' THEN 2
        WHEN t LIKE '%error%' THEN 4 WHEN t LIKE '%connect%' THEN 1 ELSE 0 END AS ActionSeverity
      FROM (SELECT record_id, lower(RawLog) AS t FROM seclog)"""),
)
def action_severity(spark, sf_dir) -> DataFrame:
    log = security_log(spark, sf_dir).withColumn("Action", text.action_word(F.col("RawLog")))
    return features.text_features(log).select("record_id", "ActionSeverity")


@query("F18_event_id_spread_per_computer", using("feats", f"SELECT record_id, {sql_rounded('EventIDStdPerComputer')} FROM feats"))
def event_id_spread(spark, sf_dir) -> DataFrame:
    return counted(spark, sf_dir, *rounded("EventIDStdPerComputer"))


def z(column: str) -> str:
    spread = f"stddev_samp({column}) OVER ()"
    return (
        f"round(CASE WHEN {spread} > 0 THEN ({column} - avg({column}) OVER ()) / ({spread}) ELSE 0 END, 6) AS {column}_ZScore"
    )


@query("F19_z_scores", using("feats", f"SELECT record_id, {', '.join(z(c) for c in features.Z_COLUMNS)} FROM feats"))
def z_scores(spark, sf_dir) -> DataFrame:
    log = security_log(spark, sf_dir)
    seconds = pinned(profile.second_profile(log))
    df = features.z_scores(features.trailing_windows(log, seconds), log, seconds)
    return df.select("record_id", *rounded(*[c + "_ZScore" for c in features.Z_COLUMNS]))


SUMMED = [
    "IsNightTime", "IsBusinessHours", "TimeSincePrevEvent", "EventIDFrequency", "LevelSeverity", "ComputerEventCount",
    "ChannelEventCount", "UserEventCount", "EventsPerMinute", "UniqueEventIDsInWindow", *events.EVENT_FLAGS,
    "HasProcessID", "UniqueProcessCount", "IPFrequency", "UniqueIPCount", "LogLength", "LogWordCount",
    *events.TEXT_FLAGS, "EventID_RiskScore", "EventID_IsSuspicious",
]


@query(
    "F20_all_features",
    using("enriched", "SELECT Computer, " + ", ".join(f"CAST(sum({c}) AS BIGINT) AS {c}" for c in SUMMED) + " FROM enriched GROUP BY Computer"),
)
def all_features(spark, sf_dir) -> DataFrame:
    df = features.extract_features(security_log(spark, sf_dir))
    return df.groupBy("Computer").agg(*[F.sum(c).cast("long").alias(c) for c in SUMMED])
