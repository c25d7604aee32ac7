"""The two derived tables behind the frequency and trailing-window features.

Both are aggregates of narrow columns, combined on the map side, so that a key,
second or hour that holds a large share of the log costs one row per task in the
shuffle. They are written once and joined back to the rows by ``joins.attach``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from vigilog.session import pinned

KEY_COLUMNS = ["EventID", "Computer", "Channel", "User", "IP"]
DISTINCT_COLUMNS = {"EventID": "UniqueEventIDsInWindow", "ExecutionProcessID": "UniqueProcessCount", "IP": "UniqueIPCount"}

MINUTE = 60
WINDOW = 300
MAX_GAP = 3600
# Time is cut into hours; no window reaches further back.
HOUR = 3600


def key_profile(log: DataFrame) -> DataFrame:
    """``(kind, key, n, id_std)``: rows per value of each key column, spread of EventID."""
    kinds = [c for c in KEY_COLUMNS if c in log.columns]
    event_id = F.col("EventID") if "EventID" in log.columns else F.lit(None).cast("long")
    pairs = F.inline(F.array(*[F.struct(F.lit(c).alias("kind"), F.col(c).cast("string").alias("key")) for c in kinds]))
    return (
        log.select(event_id.alias("event_id"), pairs)
        .filter("key is not null")
        .groupBy("kind", "key")
        .agg(F.count(F.lit(1)).alias("n"), F.stddev_samp("event_id").alias("id_std"))
    )


def hour_of(second: Column) -> Column:
    return F.floor(second / HOUR)


def hours_of(second: Column, also: Column, when: Column) -> Column:
    """The hour of a second as an owned row, and a copy for another hour where needed."""
    own = F.struct(hour_of(second).alias("hour"), F.lit(True).alias("own"))
    copy = F.struct(also.alias("hour"), F.lit(False).alias("own"))
    return F.inline(F.array_compact(F.array(own, F.when(when, copy))))


def sightings(log: DataFrame) -> DataFrame:
    """Spans of seconds ``[start, stop)`` on which a value counts as seen.

    A value seen at second t counts up to t + 300, or up to its next sighting.
    """
    kinds = [c for c in DISTINCT_COLUMNS if c in log.columns]
    pairs = F.inline(F.array(*[F.struct(F.lit(c).alias("kind"), F.col(c).cast("string").alias("value")) for c in kinds]))
    seen = log.select(F.col("EpochSeconds").alias("second"), pairs).filter("value is not null").distinct()
    # The first seconds of an hour are visible to the hour before, to find the next sighting.
    hour = hour_of(F.col("second"))
    both = seen.select("*", hours_of(F.col("second"), hour - 1, F.col("second") - hour * HOUR < WINDOW))
    following = F.lead("second").over(Window.partitionBy("kind", "value", "hour").orderBy("second"))
    return (
        both.withColumn("following", following)
        .filter("own")
        .select(
            F.col("second").alias("start"),
            F.least(F.col("second") + WINDOW + 1, F.col("following")).alias("stop"),
            *[(F.col("kind") == c).cast("long").alias(DISTINCT_COLUMNS[c]) for c in kinds],
        )
    )


def steps(start: Column, stop: Column, amounts: list[str], others: list[str] | None = None) -> Column:
    """Rises and falls of the amounts of a span, so that a running sum inside each hour
    is the sum of the spans that cover a second.

    A span is at most an hour long; one that runs into the next hour falls there
    and rises again at the start of that hour. ``others`` are further columns, null.
    """
    hour_end = (hour_of(start) + 1) * HOUR

    def step(second: Column, sign: int) -> Column:
        values = [(sign * F.col(a)).alias(a) for a in amounts]
        return F.struct(second.alias("second"), *values, *[F.lit(None).cast("long").alias(o) for o in others or []])

    falls, crosses = stop != hour_end, stop > hour_end
    return F.array_compact(
        F.array(step(start, 1), F.when(falls, step(stop, -1)), F.when(crosses, step(hour_end, 1)))
    )


def second_profile(log: DataFrame) -> DataFrame:
    """One row per second that has events, with all trailing-window features.

    Columns: EpochSeconds, n, first_record, gap (to the second before), EventsPerMinute,
    FailedLoginRatio and the distinct counts. Every window is a running sum of steps
    inside an hour, so the work is linear in the number of seconds and hours run in
    parallel.
    """
    timed = log.filter("EpochSeconds is not null")
    has_ids = "EventID" in log.columns
    failed = (F.col("EventID") == 4625) if has_ids else F.lit(False)
    login = F.col("EventID").isin(4624, 4625) if has_ids else F.lit(False)
    per_second = timed.groupBy(F.col("EpochSeconds").alias("second")).agg(
        F.count(F.lit(1)).alias("n"),
        F.min("record_id").alias("first_record"),
        F.count_if(failed).alias("failed"),
        F.count_if(login).alias("logins"),
    )
    sums = ["EventsPerMinute", "failed", "logins"]
    second = F.col("second")
    itself = F.array(
        F.struct("second", *[F.lit(None).cast("long").alias(c) for c in sums], "n", "first_record")
    )

    def only(amounts: list[str], length: int) -> Column:
        """Steps of some of the sums, the others null, in the order of all columns."""
        span = steps(second, second + length + 1, amounts, [c for c in [*sums, "n", "first_record"] if c not in amounts])
        return F.transform(span, lambda x: F.struct(x["second"], *[x[c].alias(c) for c in [*sums, "n", "first_record"]]))

    changes = per_second.withColumn("EventsPerMinute", F.col("n")).select(
        F.inline(F.concat(itself, only(["EventsPerMinute"], MINUTE), only(["failed", "logins"], WINDOW)))
    )
    counts = [name for c, name in DISTINCT_COLUMNS.items() if c in log.columns]
    if counts:
        spans = sightings(timed).select(F.inline(steps(F.col("start"), F.col("stop"), counts)))
        changes = changes.unionByName(spans, allowMissingColumns=True)
    sums += counts
    seconds = changes.groupBy("second").agg(
        *[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ["n", *sums]], F.max("first_record").alias("first_record")
    )
    # Every hour sees the events of the hour before it; a longer gap is capped anyway.
    shown = seconds.select("*", hours_of(second, hour_of(second) + 1, F.col("n") > 0))
    running = Window.partitionBy("hour").orderBy("second").rowsBetween(Window.unboundedPreceding, 0)
    before = Window.partitionBy("hour").orderBy("second").rowsBetween(Window.unboundedPreceding, -1)
    previous = F.max(F.when(F.col("n") > 0, second)).over(before)
    origin = log.agg(F.min("EpochSeconds")).scalar()
    gap = F.when(second == origin, 0).otherwise(
        F.coalesce(F.least(second - F.col("previous"), F.lit(MAX_GAP)), F.lit(MAX_GAP))
    )
    return (
        shown.select(
            "second", "n", "first_record", "own", previous.alias("previous"),
            *[F.sum(F.when(F.col("own"), F.col(c))).over(running).alias(c) for c in sums],
        )
        .filter("own and n > 0")
        .select(
            second.alias("EpochSeconds"),
            "n",
            "first_record",
            gap.cast("long").alias("gap"),
            "EventsPerMinute",
            F.coalesce(F.try_divide(F.col("failed"), F.col("logins")), F.lit(0.0)).alias("FailedLoginRatio"),
            *counts,
        )
    )


def pinned_profiles(log: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Both tables, written to the shared folder."""
    return pinned(key_profile(log)), pinned(second_profile(log))
