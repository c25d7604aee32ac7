"""The event catalogue and ATT&CK tables, and the enrichment of log rows with them.

The catalogue has 121 rows and is broadcast; a catalogue loaded from a table is
broadcast only after a check of its size.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from vigilog.functions import risk
from vigilog.operators.joins import BROADCAST_ROWS
from vigilog.rules import catalog, mitre

CATALOG_SCHEMA = (
    "source string, event_id long, name string, category string, risk_score int, severity string, "
    "mitre_tactics array<string>, mitre_techniques array<string>, suspicious_when array<string>, "
    "key_fields array<string>, states map<string,string>"
)


def catalog_rows() -> list[tuple]:
    return [
        (
            source, e.event_id, e.name, e.category, e.risk, e.severity, list(e.tactics), list(e.techniques), list(e.cues),
            list(catalog.KEY_FIELDS.get(e.event_id, ())) if source == "Sysmon" else [], catalog.STATES.get(e.event_id, {}),
        )
        for source, events in catalog.SOURCES.items()
        for e in events
    ]


def event_catalog(spark: SparkSession, path: str | None = None) -> DataFrame:
    """The built-in catalogue, or one stored as a Parquet table of the same schema."""
    if path is None:
        return spark.createDataFrame(catalog_rows(), CATALOG_SCHEMA)
    table = spark.read.schema(CATALOG_SCHEMA).parquet(path)
    if table.count() > BROADCAST_ROWS:
        raise ValueError("the event catalogue is too large to broadcast")
    return table


def tactics(spark: SparkSession) -> DataFrame:
    rows = [(i, *tactic) for i, tactic in enumerate(mitre.TACTICS)]
    return spark.createDataFrame(rows, "ordinal int, tactic string, stage string, description string")


def techniques(spark: SparkSession, path: str | None = None) -> DataFrame:
    """``(tactic, technique_id, name)``, a technique once per tactic.

    The built-in rows are those that the catalogue refers to; ``path`` is a CSV
    file with a header and these three columns for the complete matrix.
    """
    if path is not None:
        return spark.read.csv(path, header=True, schema="tactic string, technique_id string, name string")
    rows = [(tactic, t.technique_id, t.name) for t in mitre.TECHNIQUES for tactic in t.tactics]
    return spark.createDataFrame(rows, "tactic string, technique_id string, name string")


def last_tactic(pairs: DataFrame, tactic_table: DataFrame) -> DataFrame:
    """One row per technique, under the last of its tactics."""
    order = tactic_table.select("tactic", "ordinal")
    return (
        pairs.join(F.broadcast(order), "tactic")
        .groupBy("technique_id")
        .agg(F.max_by("tactic", "ordinal").alias("tactic"), F.max_by("name", "ordinal").alias("name"))
    )


def upsert(current: DataFrame, changes: DataFrame, keys: list[str]) -> DataFrame:
    """``current`` with the rows of ``changes`` added or replaced by key."""
    both = current.withColumn("_order", F.lit(0)).unionByName(changes.withColumn("_order", F.lit(1)))
    latest = F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc("_order")))
    return both.withColumn("_rank", latest).filter("_rank = 1").drop("_order", "_rank")


def channel_route(channel: Column) -> Column:
    """The source that a channel is looked up in; null searches all sources."""
    name = F.lower(channel)
    return (
        F.when(name.contains("sysmon") | name.contains("operational"), "Sysmon")
        .when(name.contains("security"), "Security")
        .when(name.contains("system") | name.contains("task") | name.contains("powershell"), "System")
    )


def guessed_source(event_id: Column) -> Column:
    """Source of an uncatalogued event by its ID range."""
    return F.when(event_id.between(4600, 5999), "Security").when(event_id.between(1, 29), "Sysmon").otherwise("System")


def source_label(event_id: Column, channel: Column, catalog_source: Column, found: Column) -> Column:
    """Where an event comes from: by channel, else by catalogue, else by ID range.

    An empty channel counts as no channel.
    """
    has_channel = F.coalesce(channel, F.lit("")) != ""
    by_channel = F.coalesce(channel_route(channel), F.lit("Unknown"))
    return (
        F.when(found & has_channel, by_channel)
        .when(found, F.coalesce(catalog_source, guessed_source(event_id)))
        .otherwise("Unknown")
    )


def small(table: DataFrame, given: bool = True) -> DataFrame:
    """``table`` to be broadcast, unless it was given and has more rows than that allows."""
    return table if given and table.limit(BROADCAST_ROWS + 1).count() > BROADCAST_ROWS else F.broadcast(table)


def with_intelligence(df: DataFrame, events: DataFrame | None = None) -> DataFrame:
    """Left join with the catalogue: a struct column ``info``, null for unknown events."""
    given = events is not None
    events = events if given else event_catalog(df.sparkSession)
    info = events.select(F.col("event_id").alias("_id"), F.col("source").alias("_source"), F.struct("*").alias("info"))
    channel = F.col("Channel") if "Channel" in df.columns else F.lit(None).cast("string")
    routed = df.withColumn("_route", channel_route(channel))
    match = (F.col("EventID") == F.col("_id")) & (F.col("_route").isNull() | (F.col("_route") == F.col("_source")))
    return routed.join(small(info, given), match, "left").drop("_route", "_id", "_source")


def primary_tactic(info: Column) -> Column:
    return F.coalesce(F.try_element_at(info["mitre_tactics"], F.lit(1)), F.lit(mitre.DEFAULT_TACTIC))


def stage_of(tactic: Column) -> Column:
    """Kill-chain stage of a tactic."""
    stages = F.create_map(*[F.lit(x) for pair in mitre.STAGE_OF_TACTIC.items() for x in pair])
    return F.coalesce(F.try_element_at(stages, tactic), F.lit(mitre.DEFAULT_STAGE))


def enrich(df: DataFrame, events: DataFrame | None = None) -> DataFrame:
    """Risk, category, name, severity, primary tactic and verdict of every row.

    A row without an EventID keeps risk 5 and 'Unknown'.
    """
    joined = with_intelligence(df, events)
    context = risk.Context(df.columns)
    known_id = F.col("EventID").isNotNull()
    info = F.col("info")
    score = risk.context_score(info["risk_score"], context)
    unnamed = F.concat(F.lit("Unknown Event "), F.col("EventID").cast("string"))

    def known(value: Column, default) -> Column:
        return F.when(known_id, F.coalesce(value, F.lit(default))).otherwise(F.lit(default))

    return joined.withColumns(
        {
            "EventID_RiskScore": F.when(known_id, score).otherwise(5),
            "EventID_Category": known(info["category"], "Unknown"),
            "EventID_Name": F.when(known_id, F.coalesce(info["name"], unnamed)).otherwise("Unknown"),
            "EventID_Severity": known(info["severity"], "Unknown"),
            "EventID_PrimaryTactic": F.when(known_id, primary_tactic(info)).otherwise("Unknown"),
            "EventID_IsSuspicious": F.when(
                known_id, risk.is_suspicious(score, info["suspicious_when"], context).cast("int")
            ).otherwise(0),
        }
    ).drop("info")


def technique_names(df: DataFrame, names: DataFrame) -> DataFrame:
    """Names of the techniques in ``mitre_techniques``, in order; absent ones as 'Unknown (id)'.

    ``df`` is a table of at most catalogue size with one row per ``event_id``.
    """
    one_name = small(names.groupBy("technique_id").agg(F.min("name").alias("name")))
    label = F.coalesce(F.col("name"), F.concat(F.lit("Unknown ("), F.col("technique_id"), F.lit(")")))
    listed = (
        df.select("event_id", F.posexplode("mitre_techniques").alias("position", "technique_id"))
        .join(one_name, "technique_id", "left")
        .groupBy("event_id")
        .agg(F.sort_array(F.collect_list(F.struct("position", label.alias("label")))).alias("_named"))
        .select("event_id", F.transform("_named", lambda x: x["label"]).alias("technique_names"))
    )
    return df.join(listed, "event_id", "left").withColumn(
        "technique_names", F.coalesce("technique_names", F.array().cast("array<string>"))
    )


def techniques_by_tactic(df: DataFrame, pairs: DataFrame) -> DataFrame:
    """All techniques of each tactic of an event: ``(event_id, tactic, techniques)``."""
    listed = pairs.groupBy("tactic").agg(F.sort_array(F.collect_set("technique_id")).alias("techniques"))
    return (
        df.select("event_id", F.posexplode("mitre_tactics").alias("position", "tactic"))
        .join(small(listed), "tactic", "left")
        .select("event_id", "position", "tactic", "techniques")
    )


def high_risk_events(events: DataFrame, minimum: int = 7) -> DataFrame:
    return events.filter(F.col("risk_score") >= minimum)


def events_of_tactic(events: DataFrame, tactic: str) -> DataFrame:
    return events.filter(F.array_contains("mitre_tactics", tactic))


def search_techniques(pairs: DataFrame, term: str) -> DataFrame:
    """Techniques whose ID or name contains the term, whatever the case."""
    wanted = F.lit(term.lower())
    return pairs.filter(F.lower("technique_id").contains(wanted) | F.lower("name").contains(wanted))


def catalog_statistics(events: DataFrame) -> DataFrame:
    counts = [F.count_if(F.col("source") == s).alias(s.lower() + "_events") for s in catalog.SOURCES]
    return events.agg(
        *counts,
        F.count(F.lit(1)).alias("total_events"),
        F.count_if(F.col("risk_score") >= 7).alias("high_risk_events"),
        F.count_if(F.col("risk_score") >= 9).alias("critical_severity"),
    )
