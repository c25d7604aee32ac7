"""Report tables over results. Every report is an aggregate with a bounded result or
a top-k; rows that tie are ordered by ``record_id`` or by the group key."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from vigilog.rules import mitre

SCORE = "AnomalyScoreNormalized"
# A rank inside groups is computed on at most this many groups per report.
STAGE_LABELS = list(dict.fromkeys([*mitre.STAGE_OF_TACTIC.values(), "Stage 4: Credential Access", "Stage 5: Lateral Movement"]))


def percent(part: Column, whole: Column, digits: int = 2) -> Column:
    return F.round(F.coalesce(F.try_divide(part * 100.0, whole), F.lit(0.0)), digits)


def anomalies_of(df: DataFrame) -> DataFrame:
    return df.filter("Anomaly = 1")


def parse_summary(log: DataFrame) -> DataFrame:
    return log.agg(
        F.count(F.lit(1)).alias("total_events"),
        F.countDistinct("EventID").alias("unique_event_ids"),
        F.countDistinct("Computer").alias("unique_hosts"),
        (F.count("EpochSeconds") > 0).alias("time_data"),
    )


def result_summary(df: DataFrame) -> DataFrame:
    anomaly, score = F.col("Anomaly") == 1, F.col(SCORE)
    total, found = F.count(F.lit(1)), F.count_if(anomaly)
    return df.agg(
        total.alias("total_events"),
        found.alias("anomaly_count"),
        percent(found, total).alias("anomaly_percentage"),
        F.count_if(anomaly & (score > 0.8)).alias("high_risk_count"),
        F.count_if(anomaly & (score > 0.5) & (score <= 0.8)).alias("medium_risk_count"),
        F.count_if(anomaly & (score <= 0.5)).alias("low_risk_count"),
    )


def top_anomalies(df: DataFrame, k: int = 10) -> DataFrame:
    return anomalies_of(df).orderBy(F.desc(SCORE), "record_id").limit(k)


def label_counts(df: DataFrame) -> DataFrame:
    return df.groupBy("Anomaly").agg(F.count(F.lit(1)).alias("n"))


def score_histogram(df: DataFrame, bins: int = 30) -> DataFrame:
    """Counts of equal-width bins over the score range 0 to 1, by label."""
    place = F.least(F.floor(F.col(SCORE) * bins), F.lit(bins - 1)).cast("int")
    return df.groupBy("Anomaly", place.alias("bin")).agg(F.count(F.lit(1)).alias("n"))


def timeline_unit(span_seconds: int | None) -> tuple[str, str]:
    """Bin width of a time line by the span of the data."""
    if span_seconds is not None and span_seconds < 3600:
        return "minute", "1 minute"
    if span_seconds is not None and span_seconds < 86400:
        return "hour", "1 hour"
    return "day", "1 day"


def timeline(df: DataFrame) -> DataFrame:
    """Normal and anomalous events per minute, hour or day; empty bins are filled."""
    low, high = df.agg(F.min("EpochSeconds"), F.max("EpochSeconds")).first()
    if low is None:
        return index_timeline(df)
    unit, width = timeline_unit(high - low)
    stamp = F.timestamp_seconds("EpochSeconds")
    counts = df.filter("EpochSeconds is not null").groupBy(F.date_trunc(unit, stamp).alias("bin")).agg(
        F.sum("Anomaly").alias("anomalies"), F.count(F.lit(1)).alias("total")
    )
    first, last = (F.date_trunc(unit, F.timestamp_seconds(F.lit(x))) for x in (low, high))
    bins = df.sparkSession.range(1).select(F.explode(F.sequence(first, last, F.expr(f"interval {width}"))).alias("bin"))
    return bins.join(counts, "bin", "left").select(
        "bin",
        F.coalesce("anomalies", F.lit(0)).alias("anomalies"),
        (F.coalesce("total", F.lit(0)) - F.coalesce("anomalies", F.lit(0))).alias("normal"),
    )


def index_timeline(df: DataFrame, bins: int = 50) -> DataFrame:
    """The time line of a log without times: equal-width bins over the record number."""
    low, high = df.agg(F.min("record_id"), F.max("record_id")).first()
    width = max(high - low, 1) / bins
    place = F.greatest(F.ceil((F.col("record_id") - low) / width) - 1, F.lit(0)).cast("int")
    counts = df.groupBy(place.alias("bin")).agg(F.sum("Anomaly").alias("anomalies"), F.count(F.lit(1)).alias("total"))
    return counts.select("bin", "anomalies", (F.col("total") - F.col("anomalies")).alias("normal"))


def correlations(df: DataFrame, features: list[str], top: int = 15) -> DataFrame:
    """Pairwise correlation of the features with the largest variance."""
    variances = df.agg(*[F.var_samp(f).alias(f) for f in features]).first().asDict()
    chosen = sorted(features, key=lambda f: (-(variances[f] or 0.0), f))[:top]
    # One pass over half of the matrix: a row of coefficients, turned into one row per pair.
    half = {(a, b): f"r{i}_{j}" for i, a in enumerate(chosen) for j, b in enumerate(chosen) if i <= j}
    row = df.agg(*[F.corr(a, b).alias(name) for (a, b), name in half.items()])
    entries = [
        F.struct(F.lit(x).alias("feature"), F.lit(y).alias("other"), F.col(name).alias("r"))
        for (a, b), name in half.items()
        for x, y in {(a, b), (b, a)}
    ]
    return row.select(F.inline(F.array(*entries)))


def group_counts(df: DataFrame, column: str) -> DataFrame:
    return anomalies_of(df).groupBy(column).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), column)


def risk_band(score: Column) -> Column:
    """Band of a risk score from 1 to 10."""
    return F.when(score >= 8, "Critical").when(score >= 6, "High").when(score >= 4, "Medium").otherwise("Low")


def score_band(score: Column, limits: tuple[float, float, float] = (0.8, 0.6, 0.3)) -> Column:
    """Band of a normalised anomaly score."""
    critical, high, medium = limits
    return F.when(score > critical, "Critical").when(score > high, "High").when(score > medium, "Medium").otherwise("Low")


def severity_distribution(df: DataFrame) -> DataFrame:
    """Events per band, by risk score where there is one, else by anomaly score or flag."""
    if "EventID_RiskScore" in df.columns:
        band = risk_band(F.col("EventID_RiskScore"))
    elif SCORE in df.columns:
        band = score_band(F.col(SCORE))
    else:
        band = F.when(F.col("Anomaly") == 1, "High").otherwise("Low")
    flag = F.col("Anomaly") if "Anomaly" in df.columns else F.lit(0)
    counts = df.groupBy(band.alias("risk")).agg(F.count(F.lit(1)).alias("total"), F.count_if(flag == 1).alias("anomalies"))
    # Four rows at most are left for the share of the whole.
    whole = F.sum("total").over(Window.partitionBy())
    return counts.select(
        "risk", "total", "anomalies", (F.col("total") - F.col("anomalies")).alias("normal"),
        percent(F.col("total"), whole, 1).alias("percentage"),
    )


def top_per_group(df: DataFrame, group: str, value: str, k: int) -> DataFrame:
    """The k most frequent values of each group with their counts and ranks."""
    counts = df.filter(F.col(value).isNotNull()).groupBy(group, value).agg(F.count(F.lit(1)).alias("n"))
    place = F.row_number().over(Window.partitionBy(group).orderBy(F.desc("n"), value))
    return counts.withColumn("rank", place).filter(F.col("rank") <= k)


def listed(top: DataFrame, group: str, value: str, name: str) -> DataFrame:
    """The ranked values of a group in one text, for example '4625: 12, 4624: 3'."""
    entry = F.concat_ws(": ", F.col(value).cast("string"), F.col("n").cast("string"))
    ordered = F.sort_array(F.collect_list(F.struct("rank", entry.alias("entry"))))
    return top.groupBy(group).agg(F.array_join(F.transform(ordered, lambda x: x["entry"]), ", ").alias(name))


def stage_report(df: DataFrame) -> DataFrame:
    """Anomalies per stage with the five most frequent event IDs and three labels."""
    found = anomalies_of(df)
    counts = found.groupBy("MITRE_Stage").agg(F.count(F.lit(1)).alias("n"))
    ids = listed(top_per_group(found, "MITRE_Stage", "EventID", 5), "MITRE_Stage", "EventID", "top_event_ids")
    labels = listed(top_per_group(found, "MITRE_Stage", "ClusterLabel", 3), "MITRE_Stage", "ClusterLabel", "top_labels")
    return counts.join(ids, "MITRE_Stage", "left").join(labels, "MITRE_Stage", "left")


def dashboard_metrics(df: DataFrame) -> DataFrame:
    """One row: totals, rate, time range and the three most frequent event IDs."""
    top = top_values(df, "EventID", 3)
    text = F.array_join(
        F.transform(F.array_sort(F.collect_list(F.struct((-F.col("n")).alias("o"), "value", "n"))),
                    lambda x: F.concat_ws(": ", x["value"].cast("string"), x["n"].cast("string"))), ", ",
    )
    total, found = F.count(F.lit(1)), F.count_if(F.col("Anomaly") == 1)
    return df.agg(
        total.alias("total_events"), found.alias("n_anomalies"), percent(found, total).alias("anomaly_rate"),
        F.min("TimeCreatedISO").alias("first_time"), F.max("TimeCreatedISO").alias("last_time"),
    ).withColumn("top_events", top.agg(text.alias("t")).scalar())


def top_values(df: DataFrame, column: str, k: int, default: str | None = None) -> DataFrame:
    """The k most frequent values of a column; nulls count under ``default`` if given."""
    value = F.col(column)
    rows = df.filter(value.isNotNull()) if default is None else df.withColumn(column, F.coalesce(value.cast("string"), F.lit(default)))
    return rows.groupBy(F.col(column).alias("value")).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "value").limit(k)


def stage_order(stage: Column) -> Column:
    pairs = F.create_map(*[F.lit(x) for i, label in enumerate(STAGE_LABELS) for x in (label, i)])
    return F.coalesce(F.try_element_at(pairs, stage), F.lit(len(STAGE_LABELS)))


def anomalies_by_stage(df: DataFrame) -> DataFrame:
    counts = anomalies_of(df).groupBy("MITRE_Stage").agg(
        F.count(F.lit(1)).alias("n"),
        F.countDistinct("EventID").alias("event_ids"),
        F.countDistinct("Computer").alias("hosts"),
        F.avg(SCORE).alias("mean_score"),
    )
    return counts.withColumn("stage_order", stage_order(F.col("MITRE_Stage"))).orderBy("stage_order", "MITRE_Stage")


def stage_rows(df: DataFrame, stage: str) -> DataFrame:
    """The anomalies of one stage, highest score first."""
    return anomalies_of(df).filter(F.col("MITRE_Stage") == stage).orderBy(F.desc(SCORE), "record_id")


def event_groups(df: DataFrame) -> DataFrame:
    """Anomalies per event ID: numbers, scores, hosts, users and a badge by the highest score."""
    def distinct(column: str) -> Column:
        return F.countDistinct(column) if column in df.columns else F.lit(0).cast("long")

    groups = anomalies_of(df).groupBy("EventID").agg(
        F.count(F.lit(1)).alias("count"),
        F.avg(SCORE).alias("avg_score"),
        F.max(SCORE).alias("max_score"),
        distinct("Computer").alias("unique_computers"),
        distinct("User").alias("unique_users"),
    )
    badge = F.upper(score_band(F.col("max_score"), (0.8, 0.6, 0.4)))
    return groups.withColumn("badge", badge).orderBy(F.desc("max_score"), "EventID")


def anomalies_by_hour(df: DataFrame) -> DataFrame:
    """Anomalies per hour of the source clock; all 24 hours are listed."""
    counts = anomalies_of(df).groupBy("Hour").agg(F.count(F.lit(1)).alias("n"))
    hours = df.sparkSession.range(24).select(F.col("id").cast("int").alias("Hour"))
    return hours.join(counts, "Hour", "left").select("Hour", F.coalesce("n", F.lit(0)).alias("n"))


def risk_bands(df: DataFrame) -> DataFrame:
    band = score_band(F.col(SCORE), (0.8, 0.6, 0.4))
    return anomalies_of(df).groupBy(band.alias("band")).agg(F.count(F.lit(1)).alias("n"))


def sample_statistics(samples: DataFrame) -> DataFrame:
    """Labelled samples per label, attack type and severity, and their total."""
    kinds = ["label", "attack_type", "severity"]
    entries = [F.struct(F.lit(k).alias("kind"), F.col(k).alias("value")) for k in kinds]
    entries.append(F.struct(F.lit("total").alias("kind"), F.lit(None).cast("string").alias("value")))
    return samples.select(F.inline(F.array(*entries))).groupBy("kind", "value").agg(F.count(F.lit(1)).alias("n"))
