"""A security log derived from the shared ``events`` table by integer arithmetic.

The same arithmetic is written in SQL in ``vigilog.plans.oracle``, so that both
engines see identical rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from vigilog.session import spread

# Fixed values of the adapter.
EVENT_IDS = [
    4624, 4624, 4624, 4625, 4625, 4688, 4672, 4663, 4656, 4698, 4732, 1102,
    4776, 1, 3, 11, 13, 10, 7045, 7036, 104, 18456, 15281, 999999,
]
PHRASES = [
    "An account failed to log on, access denied",
    "powershell.exe -EncodedCommand SQBFAFgA base64 payload",
    "cmd.exe /c net user backup /add",
    "2024-01-15T10:30:00Z User: bob ERROR denied from 10.0.0.7",
    "15/Jan/2024:10:30:00 GET https://example.org/index.html status 200",
    "Jan  5 10:30:00 the print service entered the running state",
    "runas /user:admin C:\\Temp\\setup.bat",
    "",
]
CHANNELS = {
    "Microsoft-Windows-Sysmon/Operational": [1, 3, 10, 11, 13],
    "System": [7045, 7036, 104],
    "Application": [18456, 15281],
}
ORIGIN = 1704067200
SQUEEZE = 20


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def pick(values: list, index: Column) -> Column:
    return F.element_at(F.array(*[F.lit(v) for v in values]), (index + 1).cast("int"))


def security_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    # The narrow source is spread, before anything is computed from it.
    events = spread(read_table(spark, sf_dir, "events").select("event_id", "ts", "user_id", "value"), "event_id", "ts")
    number, user = F.col("event_id"), F.col("user_id")
    epoch = F.unix_seconds(F.col("ts").cast("timestamp"))
    ids = events.select(
        number.alias("record_id"),
        (F.floor((epoch - ORIGIN) / F.lit(float(SQUEEZE))) + ORIGIN).cast("long").alias("EpochSeconds"),
        pick(EVENT_IDS, F.pmod(number * 7 + user, F.lit(24))).cast("long").alias("EventID"),
        (1 + F.pmod(number, F.lit(5))).cast("long").alias("Level"),
        F.concat(F.lit("HOST-"), F.pmod(user, F.lit(12)).cast("string")).alias("Computer"),
        F.concat(F.lit("user"), user.cast("string")).alias("User"),
        F.concat(
            F.lit("10.0."), F.pmod(user, F.lit(4)).cast("string"), F.lit("."),
            F.pmod(number * 13, F.lit(50)).cast("string"),
        ).alias("IP"),
        F.when(F.pmod(number, F.lit(9)) != 0, 400 + F.pmod(number * 11, F.lit(37))).alias("ExecutionProcessID"),
        pick(PHRASES, F.pmod(number * 3 + user, F.lit(8))).alias("RawLog"),
        F.col("value"),
    )
    channel = F.when(F.col("EventID") == 999999, F.lit(None).cast("string"))
    for name, members in CHANNELS.items():
        channel = channel.when(F.col("EventID").isin(members), name)
    stamp = F.timestamp_seconds("EpochSeconds")
    return ids.withColumns(
        {
            "Channel": channel.otherwise("Security"),
            "event_ts": stamp,
            "TimeCreatedISO": F.date_format(stamp, "yyyy-MM-dd'T'HH:mm:ss'+00:00'"),
            "Hour": F.hour(stamp),
            "Weekday": F.weekday(stamp),
            "IsWeekend": (F.weekday(stamp) >= 5).cast("int"),
        }
    )
