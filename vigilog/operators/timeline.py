"""Events around an anomaly.

Numbers, frequent event IDs and their modes come from running sums over seconds for
all rows, without any pairs of events. The listing of the events themselves holds each event
once: windows that overlap are one run, and every anomaly is a range of places in its run. A listing
in pairs is there for the anomalies that the caller chooses.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window, functions as F

from vigilog.operators.hierarchy import numbered
from vigilog.operators.joins import BROADCAST_ROWS, attach
from vigilog.operators.profile import HOUR, hour_of, hours_of, steps
from vigilog.session import pinned

MINUTES = 10
# Windows of at most this many anomalies are broadcast to the log; more are joined by shuffle.
BROADCAST_WINDOWS = 10_000


def covering_spans(seen: DataFrame, reach: int) -> DataFrame:
    """Spans ``[start, stop)`` without overlap on which a value has an event at most
    ``reach`` seconds away, from ``(value, second)``."""
    hour = hour_of(F.col("second"))
    halo = 2 * reach + 1
    both = seen.select("*", hours_of(F.col("second"), hour - 1, F.col("second") - hour * HOUR < halo))
    following = F.lead("second").over(Window.partitionBy("value", "hour").orderBy("second"))
    return (
        both.withColumn("following", following)
        .filter("own")
        .select(
            (F.col("second") - reach).alias("start"),
            F.least(F.col("second") + reach + 1, F.col("following") - reach).alias("stop"),
            F.lit(1).cast("long").alias("diversity"),
        )
    )


def running_sums(changes: DataFrame, sums: list[str], *keys: str) -> DataFrame:
    """Sums of steps at every second with events, inside each hour."""
    totals = changes.groupBy(*keys, "second").agg(*[F.sum(c).alias(c) for c in ["n", *sums]])
    frame = Window.partitionBy(*keys, "hour").orderBy("second").rowsBetween(Window.unboundedPreceding, 0)
    return (
        totals.withColumn("hour", hour_of(F.col("second")))
        .select(*keys, "second", "n", *[F.coalesce(F.sum(c).over(frame), F.lit(0)).alias(c) for c in sums])
        .filter("n > 0")
    )


def second_context(log: DataFrame, minutes: int = MINUTES, distinct: bool = True) -> DataFrame:
    """Per second with events: events before and after, and (where asked for) distinct event
    IDs, within the given minutes."""
    reach = 60 * minutes
    timed = log.filter("EpochSeconds is not null")
    counts = timed.groupBy(F.col("EpochSeconds").alias("second")).agg(F.count(F.lit(1)).alias("n"))
    second = F.col("second")

    def side(name: str, start: Column, stop: Column) -> DataFrame:
        spans = counts.select(start.alias("start"), stop.alias("stop"), F.col("n").alias(name))
        return spans.select(F.inline(steps(F.col("start"), F.col("stop"), [name])))

    changes = [counts, side("events_before", second + 1, second + reach + 1), side("events_after", second - reach, second)]
    sums = ["events_before", "events_after"]
    if distinct:
        seen = timed.filter("EventID is not null").select(F.col("EventID").alias("value"), second_of()).distinct()
        changes.append(covering_spans(seen, reach).select(F.inline(steps(F.col("start"), F.col("stop"), ["diversity"]))))
        sums.append("diversity")
    union = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), changes)
    return running_sums(union, sums)


def second_of() -> Column:
    return F.col("EpochSeconds").alias("second")


def occurrences(log: DataFrame, minutes: int = MINUTES) -> DataFrame:
    """Per event ID and second: events of the same ID within the given minutes."""
    reach = 60 * minutes
    counts = (
        log.filter("EpochSeconds is not null and EventID is not null")
        .groupBy("EventID", second_of())
        .agg(F.count(F.lit(1)).alias("n"))
    )
    spans = counts.select("EventID", (F.col("second") - reach).alias("start"), (F.col("second") + reach + 1).alias("stop"), F.col("n").alias("occurrences"))
    changes = counts.unionByName(
        spans.select("EventID", F.inline(steps(F.col("start"), F.col("stop"), ["occurrences"]))), allowMissingColumns=True
    )
    return running_sums(changes, ["occurrences"], "EventID")


def event_context(rows: DataFrame, log: DataFrame, minutes: int = MINUTES) -> DataFrame:
    """Context of the event ID of every row: frequency, occurrences nearby, rarity, class
    and risk. Without a time nothing is known about the events around: only the frequency
    and rarity are given, the rest is null."""
    totals = pinned(log.filter("EventID is not null").groupBy("EventID").agg(F.count(F.lit(1)).alias("event_frequency")))
    around = pinned(second_context(log, minutes).withColumnsRenamed({"second": "EpochSeconds", "n": "_weight"}))
    same = pinned(
        occurrences(log, minutes).select(
            F.concat_ws(":", "EventID", "second").alias("_key"), F.col("n").alias("_weight"), "occurrences"
        )
    )
    total = totals.agg(F.coalesce(F.sum("event_frequency"), F.lit(0))).scalar()
    df = attach(rows, around, "EpochSeconds", "_weight")
    timed = F.col("EpochSeconds").isNotNull()
    df = attach(df.withColumn("_key", F.when(timed, F.concat_ws(":", "EventID", "EpochSeconds"))), same, "_key", "_weight").drop("_key")
    df = attach(df, totals.withColumn("_weight", F.col("event_frequency")), "EventID", "_weight")
    frequency, nearby = F.coalesce("event_frequency", F.lit(0)), F.when(timed, F.coalesce("occurrences", F.lit(0)))
    share = F.coalesce(F.try_divide(frequency * 100.0, total), F.lit(0.0))
    rare, isolated = (frequency < 3) | (share < 2.0), nearby <= 1
    return df.withColumns(
        {
            "event_frequency": frequency,
            "event_percentage": share,
            "occurrences": nearby,
            "is_rare": rare,
            "is_isolated": isolated,
            "classification": F.when(nearby.isNull(), F.lit(None).cast("string")).when(rare & isolated, "Truly Rare Event")
            .when(~rare & isolated, "Isolated But Common Event")
            .when(rare, "Rare Event with Context")
            .otherwise("Common Event in Context"),
            "context_risk": F.when(nearby.isNull(), F.lit(None).cast("string")).when(rare & isolated, "High").when(rare | isolated, "Medium").otherwise("Low"),
        }
    )


def windows_of(chosen: DataFrame, minutes: int) -> DataFrame:
    """The chosen anomalies once per bucket that their window touches, for a join by bucket."""
    reach = 60 * minutes
    timed = chosen.filter("EpochSeconds is not null").select(
        F.col("record_id").alias("anomaly_id"), F.col("EpochSeconds").alias("anomaly_time")
    )
    first, last = (F.floor((F.col("anomaly_time") + d) / reach) for d in (-reach, reach))
    windows = timed.withColumn("_bucket", F.explode(F.sequence(first, last)))
    return F.broadcast(windows) if chosen.limit(BROADCAST_WINDOWS + 1).count() <= BROADCAST_WINDOWS else windows


def around_chosen(rows: DataFrame, time: str, chosen: DataFrame, minutes: int = MINUTES) -> DataFrame:
    """Rows within the given minutes of each chosen anomaly."""
    reach = 60 * minutes
    windows = windows_of(chosen, minutes)
    near = F.abs(F.col(time) - F.col("anomaly_time")) <= reach
    bucketed = rows.filter(F.col(time).isNotNull()).withColumn("_bucket", F.floor(F.col(time) / reach))
    return bucketed.join(windows, "_bucket").filter(near).drop("_bucket")


def event_timeline(log: DataFrame, chosen: DataFrame, minutes: int = MINUTES) -> DataFrame:
    """The events around each chosen anomaly, with the seconds to it."""
    df = around_chosen(log, "EpochSeconds", chosen, minutes)
    return df.withColumns(
        {
            "IsAnomalous": F.col("record_id") == F.col("anomaly_id"),
            "SecondsFromAnomaly": F.col("EpochSeconds") - F.col("anomaly_time"),
        }
    )


def _of_earlier_hours(hours: DataFrame, column: str) -> Column:
    """The largest value that an earlier hour has; ``hours`` has a row per hour of the log."""
    return F.max(column).over(Window.orderBy("hour").rowsBetween(Window.unboundedPreceding, -1))


def window_runs(chosen: DataFrame, minutes: int = MINUTES) -> DataFrame:
    """``run_start``, ``run_stop``: the windows of all chosen anomalies, merged where they overlap or touch.

    The anomaly before and the last beginning of a run are looked up inside each hour, and beyond it
    in a table with one row per hour that has anomalies.
    """
    reach = 60 * minutes
    seconds = pinned(chosen.filter("EpochSeconds is not null").select(second_of()).distinct().withColumn("hour", hour_of(F.col("second"))))
    inside = Window.partitionBy("hour").orderBy("second")
    hours = seconds.groupBy("hour").agg(F.max("second").alias("last"))
    before = hours.select("hour", _of_earlier_hours(hours, "last").alias("before"))
    gaps = seconds.withColumn("previous", F.lag("second").over(inside)).join(before, "hour")
    heads = pinned(
        gaps.select("hour", "second", F.coalesce("previous", "before").alias("previous")).withColumn(
            "head", F.when(F.col("previous").isNull() | (F.col("second") - F.col("previous") > 2 * reach + 1), F.col("second"))
        )
    )
    starts = heads.groupBy("hour").agg(F.max("head").alias("head"))
    begun = starts.select("hour", _of_earlier_hours(starts, "head").alias("begun"))
    here = F.max("head").over(inside.rowsBetween(Window.unboundedPreceding, 0))
    placed = heads.withColumn("here", here).join(begun, "hour").select("second", F.coalesce("here", "begun").alias("first"))
    return placed.groupBy("first").agg(F.max("second").alias("last")).select((F.col("first") - reach).alias("run_start"), (F.col("last") + reach).alias("run_stop"))


def event_runs(log: DataFrame, chosen: DataFrame, minutes: int = MINUTES) -> DataFrame:
    """The events around all chosen anomalies, each event once, so no more rows than the log has.

    ``run_start``, ``run_stop`` and ``place`` (order of the log by time and ``record_id``) come with each
    event; an anomaly's own row has ``first_place`` and ``last_place``: its listing is the rows of its
    run from the one to the other. Rows without a time are in no run.
    """
    runs = pinned(window_runs(chosen, minutes))
    in_hours = runs.withColumn("hour", F.explode(F.sequence(hour_of(F.col("run_start")), hour_of(F.col("run_stop")))))
    # A few runs for each hour of the log.
    few = runs.agg(F.coalesce(F.sum(hour_of(F.col("run_stop")) - hour_of(F.col("run_start")) + 1), F.lit(0))).first()[0] <= BROADCAST_ROWS
    timed = log.filter("EpochSeconds is not null").withColumn("hour", hour_of(F.col("EpochSeconds")))
    events = numbered(timed, "EpochSeconds", "record_id").withColumnRenamed("number", "place")
    events = events.join(F.broadcast(in_hours) if few else in_hours, "hour").filter(F.col("EpochSeconds").between(F.col("run_start"), F.col("run_stop"))).drop("hour")
    around = second_context(log, minutes, distinct=False).withColumnRenamed("second", "EpochSeconds")
    ends = events.groupBy("EpochSeconds").agg(F.min("place").alias("_first"), F.max("place").alias("_last"), F.count(F.lit(1)).alias("_weight"))
    ranges = pinned(ends.join(around, "EpochSeconds").select("EpochSeconds", "_weight", (F.col("_first") - F.col("events_before")).alias("first_place"), (F.col("_last") + F.col("events_after")).alias("last_place")))
    marked = attach(events, ranges, "EpochSeconds", "_weight")
    ids = chosen.filter("EpochSeconds is not null").select("record_id", F.lit(True).alias("IsAnomalous"))
    anomalous = F.coalesce("IsAnomalous", F.lit(False))
    own = {n: F.when(anomalous, F.col(n)) for n in ("first_place", "last_place")}
    return marked.join(ids, "record_id", "left").withColumns(own | {"IsAnomalous": anomalous})


def nearby_events(log: DataFrame, chosen: DataFrame, minutes: int = MINUTES) -> DataFrame:
    """``(second, EventID, n)``: event IDs around every second in which a chosen anomaly lies.

    The counts of each event ID rise and fall with its events; they are read off at the
    seconds of the anomalies, for the event IDs that occur in the hours next to them.
    """
    reach = 60 * minutes
    hours = -(-reach // HOUR)
    counts = (
        log.filter("EpochSeconds is not null and EventID is not null").groupBy("EventID", second_of()).agg(F.count(F.lit(1)).alias("n"))
    )
    hour = hour_of(F.col("second"))
    seen = counts.select("EventID", F.explode(F.sequence(hour - hours, hour + hours)).alias("hour")).distinct()
    asked = chosen.filter("EpochSeconds is not null").select(second_of()).distinct()
    probes = asked.withColumn("hour", hour).join(seen, "hour").select("EventID", "second", F.lit(1).cast("long").alias("n"))
    spans = counts.select("EventID", (F.col("second") - reach).alias("start"), (F.col("second") + reach + 1).alias("stop"), F.col("n").alias("nearby"))
    changes = probes.unionByName(spans.select("EventID", F.inline(steps(F.col("start"), F.col("stop"), ["nearby"]))), allowMissingColumns=True)
    return running_sums(changes, ["nearby"], "EventID").filter("nearby > 0").select("second", "EventID", F.col("nearby").alias("n"))


def _of_anomalies(chosen: DataFrame, seconds: DataFrame, how: str = "inner") -> DataFrame:
    """``anomaly_id`` of each chosen anomaly with the columns of its second."""
    ids = chosen.select(F.col("record_id").alias("anomaly_id"), second_of())
    return ids.join(seconds, "second", how).drop("second")


def nearby_modes(log: DataFrame, chosen: DataFrame, minutes: int = MINUTES) -> DataFrame:
    """The most frequent event IDs around each chosen anomaly with a time, all that tie."""
    counts = nearby_events(log, chosen, minutes)
    entries = F.collect_list(F.struct("EventID", "n"))  # the distinct event IDs of one window
    modes = counts.groupBy("second").agg(entries.alias("e"), F.max("n").alias("most"))
    best = F.transform(F.filter("e", lambda x: x["n"] == F.col("most")), lambda x: x["EventID"])
    return _of_anomalies(chosen, modes.select("second", F.sort_array(best).alias("most_common")))


def top_nearby(log: DataFrame, chosen: DataFrame, k: int = 5, minutes: int = MINUTES) -> DataFrame:
    """``(second, rank, EventID, n)``: the k most frequent event IDs around the seconds of anomalies."""
    place = F.row_number().over(Window.partitionBy("second").orderBy(F.desc("n"), "EventID"))
    return nearby_events(log, chosen, minutes).withColumn("rank", place).filter(F.col("rank") <= k)


def window_ends(log: DataFrame, minutes: int = MINUTES) -> DataFrame:
    """Per second with events the first and last second with events within the given minutes."""
    reach = 60 * minutes
    second = F.col("second")
    seconds = log.filter("EpochSeconds is not null").select(second_of()).distinct()
    spread = seconds.withColumn("hour", F.explode(F.sequence(hour_of(second - reach), hour_of(second + reach))))
    frame = Window.partitionBy("hour").orderBy("second").rangeBetween(-reach, reach)
    ends = spread.withColumns({"earliest": F.min("second").over(frame), "latest": F.max("second").over(frame)})
    return ends.filter(F.col("hour") == hour_of(second)).select("second", "earliest", "latest")


def percentage(part: Column, whole: Column) -> Column:
    return F.when(whole > 0, F.format_string("%.2f%%", part * 100.0 / whole)).otherwise("N/A")


def known(columns: list[str], name: str) -> Column:
    return F.coalesce(F.col(name).cast("string"), F.lit("Unknown")) if name in columns else F.lit("Unknown")


def anomaly_context(chosen: DataFrame, log: DataFrame, total_anomalies: Column, minutes: int = MINUTES) -> DataFrame:
    """One JSON text per chosen anomaly: details, window counts, frequent event IDs and
    features, anomaly rate. Without a time, the timeline is empty."""
    second = F.col("second")
    sums = second_context(log, minutes).join(window_ends(log, minutes), "second")
    window = sums.select(
        "second",
        "events_before",
        "events_after",
        (F.col("events_before") + F.col("n") + F.col("events_after")).alias("total_events"),
        F.concat((F.col("earliest") - second).cast("string"), F.lit("s to "), (F.col("latest") - second).cast("string"), F.lit("s")).alias("time_window"),
    )
    ids = top_nearby(log, chosen, 5, minutes).groupBy("second").agg(
        F.map_from_entries(
            F.transform(
                F.sort_array(F.collect_list(F.struct("rank", "EventID", "n"))),
                lambda e: F.struct(e["EventID"].cast("string"), e["n"]),
            )
        ).alias("common_event_ids")
    )
    c = chosen.columns
    details = F.struct(
        known(c, "EventID").alias("event_id"), known(c, "TimeCreatedISO").alias("timestamp"), known(c, "Computer").alias("computer"),
        known(c, "User").alias("user"), known(c, "Channel").alias("channel"),
        F.round("AnomalyScoreNormalized", 6).alias("risk_score"), known(c, "ProviderName").alias("provider"),
    )
    features = F.slice("top_features", 1, 5) if "top_features" in c else F.array().cast("array<string>")
    rate = percentage(total_anomalies, F.col("total_events"))
    return (
        chosen.withColumn("second", F.col("EpochSeconds"))
        .join(window, "second", "left")
        .join(ids, "second", "left")
        .select(
            "record_id",
            F.to_json(
                F.struct(
                    details.alias("anomaly"),
                    F.struct("events_before", "events_after", "total_events", "time_window", "common_event_ids").alias("timeline"),
                    features.alias("top_features"),
                    F.struct(total_anomalies.alias("total_anomalies"), rate.alias("anomaly_rate")).alias("global_stats"),
                )
            ).alias("context"),
        )
    )


def dataset_context(df: DataFrame, sample: int = 20) -> DataFrame:
    """One row: numbers, a sample of the first anomalies, their time span, the ten most
    frequent event IDs and the five most affected hosts."""
    from vigilog.operators.reports import anomalies_of, top_values

    found = anomalies_of(df)
    c = df.columns
    row = F.struct(
        F.col("record_id"), known(c, "EventID").alias("event_id"), known(c, "TimeCreatedISO").alias("timestamp"),
        known(c, "Computer").alias("computer"), known(c, "User").alias("user"),
        F.round("AnomalyScoreNormalized", 6).alias("risk_score"), known(c, "Channel").alias("channel"),
    )
    first = found.orderBy("record_id").limit(sample).select(row.alias("row"))
    samples = first.agg(F.to_json(F.sort_array(F.collect_list("row"))).alias("x"))

    def ranked(column: str, k: int) -> Column:
        entry = F.struct((-F.col("n")).alias("o"), "value", "n")
        pairs = F.transform(F.array_sort(F.collect_list(entry)), lambda e: F.concat_ws(": ", e["value"].cast("string"), e["n"].cast("string")))
        return top_values(found, column, k).agg(F.array_join(pairs, ", ").alias("x")).scalar()

    total, anomalies = F.count(F.lit(1)), F.count_if(F.col("Anomaly") == 1)
    time = F.when(F.col("Anomaly") == 1, F.col("EpochSeconds"))
    stamp = [F.date_format(F.timestamp_seconds(f(time)), "yyyy-MM-dd HH:mm:ss") for f in (F.min, F.max)]
    return df.agg(
        total.alias("total_events"),
        anomalies.alias("total_anomalies"),
        percentage(anomalies, total).alias("anomaly_rate"),
        F.concat(stamp[0], F.lit(" to "), stamp[1]).alias("time_range"),
        F.round((F.max(time) - F.min(time)) / 3600.0, 6).alias("duration_hours"),
    ).withColumns(
        {"anomalies": samples.scalar(), "event_id_distribution": ranked("EventID", 10), "affected_computers": ranked("Computer", 5)}
    )
