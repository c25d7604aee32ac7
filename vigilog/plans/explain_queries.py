"""Queries J2-J10: explanations and the context of anomalies."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from vigilog.operators import explain, reports, timeline
from vigilog.plans.oracle import using
from vigilog.plans.registry import query
from vigilog.plans.scored import scored_log
from vigilog.sources.shared_tables import read_table, security_log

DIMENSIONS = 64
NAMES = [f"Feature_{i}" for i in range(DIMENSIONS)]


def attributed(spark, sf_dir) -> DataFrame:
    """The shared vectors as attributions, and ten times their values as feature values."""
    vectors = read_table(spark, sf_dir, "embeddings")
    values = F.transform("embedding", lambda v: v.cast("double") * 10)
    shown = explain.top_features(F.array(*[F.lit(n) for n in NAMES]), values, F.col("embedding"), 5)
    return vectors.select(F.col("vec_id").alias("record_id"), shown.alias("top_features"))


RANKED = """
ranked AS (SELECT vec_id, position, a, 'Feature_' || (position - 1) AS feature, CAST(a AS DOUBLE) * 10 AS value,
    CASE WHEN a > 0 THEN 'increases' ELSE 'decreases' END AS contribution,
    row_number() OVER (PARTITION BY vec_id ORDER BY abs(a) DESC, position) AS place
  FROM (SELECT vec_id, unnest(embedding) AS a, generate_subscripts(embedding, 1) AS position FROM embeddings))
"""
VALUE = "CASE WHEN abs(value) < 0.01 THEN printf('%.4f', value) WHEN abs(value) < 1 THEN printf('%.2f', value) ELSE printf('%.1f', value) END"
LINE = f"'  - ' || replace(feature, '_', ' ') || ': ' || {VALUE} || ', ' || contribution || ' the score'"
TEXT = f"'{explain.OPENING}' || chr(10) || string_agg({LINE}, chr(10) ORDER BY place) FILTER (place <= 3)"


@query(
    "J2_global_importance",
    "SELECT 'Feature_' || (position - 1) AS feature, round(avg(abs(CAST(a AS DOUBLE))), 6) AS importance FROM (SELECT unnest(embedding) AS a, generate_subscripts(embedding, 1) AS position FROM embeddings) GROUP BY position",
)
def global_importance(spark, sf_dir) -> DataFrame:
    vectors = read_table(spark, sf_dir, "embeddings").select(F.transform("embedding", lambda v: v.cast("double")).alias("a"))
    return explain.global_importance(vectors, "a", NAMES).withColumn("importance", F.round("importance", 6))


@query(
    "J3_top_features",
    f"WITH {RANKED} SELECT vec_id AS record_id, place, feature, round(value, 6) AS value, round(CAST(a AS DOUBLE), 6) AS attribution, contribution FROM ranked WHERE place <= 5",
)
def top_features(spark, sf_dir) -> DataFrame:
    df = attributed(spark, sf_dir).select("record_id", F.posexplode("top_features").alias("place", "e"))
    return df.select(
        "record_id", (F.col("place") + 1).alias("place"), "e.feature", F.round("e.value", 6).alias("value"),
        F.round("e.attribution", 6).alias("attribution"), "e.contribution",
    )


@query("J4_explanation_text", f"WITH {RANKED} SELECT vec_id AS record_id, {TEXT} AS text FROM ranked GROUP BY vec_id")
def explanation_text(spark, sf_dir) -> DataFrame:
    return attributed(spark, sf_dir).select("record_id", explain.explanation_text(F.col("top_features")).alias("text"))


WIDE = ", ".join(
    f"max(feature) FILTER (place = {i}) AS TopFeature{i}, round(max(value) FILTER (place = {i}), 6) AS TopFeature{i}_Value, "
    f"round(max(CAST(a AS DOUBLE)) FILTER (place = {i}), 6) AS TopFeature{i}_Attribution" for i in (1, 2, 3)
)


@query("J5_explanation_report", f'WITH {RANKED} SELECT vec_id AS "Index", {TEXT} AS ExplanationText, {WIDE} FROM ranked GROUP BY vec_id')
def explanation_report(spark, sf_dir) -> DataFrame:
    df = explain.explanation_report(attributed(spark, sf_dir))
    numbers = [c for c in df.columns if c.endswith(("_Value", "_Attribution"))]
    return df.withColumns({c: F.round(c, 6) for c in numbers})


@query(
    "S14_explanation_sink",
    f'WITH {RANKED} SELECT vec_id AS "Index", {TEXT} AS ExplanationText, max(feature) FILTER (place = 1) AS TopFeature1 FROM ranked GROUP BY vec_id ORDER BY vec_id LIMIT 100',
)
def explanation_sink(spark, sf_dir) -> DataFrame:
    from vigilog.plans.source_queries import scratch
    from vigilog.sources.results import write_csv

    path = scratch(spark, "explanations")
    write_csv(explain.explanation_report(attributed(spark, sf_dir).orderBy("record_id").limit(100)), path)
    df = spark.read.csv(path, header=True, escape='"', multiLine=True)
    return df.select(F.col("Index").cast("long").alias("Index"), "ExplanationText", "TopFeature1")


AROUND = """
SELECT *,
       count(*) OVER (ORDER BY EpochSeconds RANGE BETWEEN 600 PRECEDING AND 1 PRECEDING) AS events_before,
       count(*) OVER (ORDER BY EpochSeconds RANGE BETWEEN 1 FOLLOWING AND 600 FOLLOWING) AS events_after,
       count(DISTINCT EventID) OVER (ORDER BY EpochSeconds RANGE BETWEEN 600 PRECEDING AND 600 FOLLOWING) AS diversity,
       count(*) OVER (PARTITION BY EventID ORDER BY EpochSeconds RANGE BETWEEN 600 PRECEDING AND 600 FOLLOWING) AS occurrences,
       count(*) OVER (PARTITION BY EventID) AS event_frequency,
       100.0 * count(*) OVER (PARTITION BY EventID) / count(*) OVER () AS event_percentage
FROM verdicts
"""
CONTEXT = f"""
SELECT *, (event_frequency < 3 OR event_percentage < 2) AS is_rare, occurrences <= 1 AS is_isolated,
       CASE WHEN (event_frequency < 3 OR event_percentage < 2) AND occurrences <= 1 THEN 'Truly Rare Event' WHEN occurrences <= 1 THEN 'Isolated But Common Event'
            WHEN event_frequency < 3 OR event_percentage < 2 THEN 'Rare Event with Context' ELSE 'Common Event in Context' END AS classification,
       CASE WHEN (event_frequency < 3 OR event_percentage < 2) AND occurrences <= 1 THEN 'High'
            WHEN event_frequency < 3 OR event_percentage < 2 OR occurrences <= 1 THEN 'Medium' ELSE 'Low' END AS context_risk
FROM ({AROUND})
"""


def with_context(spark, sf_dir) -> DataFrame:
    log = scored_log(spark, sf_dir)
    return timeline.event_context(reports.anomalies_of(log), log.select("EpochSeconds", "EventID"))


@query("J6_timeline_counts", using("verdicts", f"SELECT record_id, events_before, events_after FROM ({AROUND}) WHERE Anomaly = 1"))
def timeline_counts(spark, sf_dir) -> DataFrame:
    return with_context(spark, sf_dir).select("record_id", "events_before", "events_after")


@query(
    "J6_event_timeline",
    using("verdicts", """
      , timed AS (SELECT record_id, EventID, EpochSeconds AS t, Anomaly = 1 AS hit, row_number() OVER (ORDER BY EpochSeconds, record_id) - 1 AS place FROM verdicts WHERE EpochSeconds IS NOT NULL)
      , marks AS (SELECT t, CASE WHEN t - lag(t) OVER (ORDER BY t) <= 1201 THEN 0 ELSE 1 END AS head FROM (SELECT DISTINCT t FROM timed WHERE hit))
      , runs AS (SELECT min(t) - 600 AS run_start, max(t) + 600 AS run_stop FROM (SELECT t, sum(head) OVER (ORDER BY t) AS run FROM marks) GROUP BY run)
      , ranges AS (SELECT record_id, min(place) OVER w AS first_place, max(place) OVER w AS last_place FROM timed WINDOW w AS (ORDER BY t RANGE BETWEEN 600 PRECEDING AND 600 FOLLOWING))
      SELECT run_start, run_stop, place, record_id, EventID, t - run_start AS SecondsFromStart, hit AS IsAnomalous,
        CASE WHEN hit THEN first_place END AS first_place, CASE WHEN hit THEN last_place END AS last_place
      FROM timed JOIN runs ON t BETWEEN run_start AND run_stop JOIN ranges USING (record_id)"""),
)
def event_timeline(spark, sf_dir) -> DataFrame:
    """The events around all anomalies, each once per run of windows."""
    log = scored_log(spark, sf_dir)
    df = timeline.event_runs(log.select("record_id", "EventID", "EpochSeconds"), reports.anomalies_of(log))
    return df.select("run_start", "run_stop", "place", "record_id", "EventID", (F.col("EpochSeconds") - F.col("run_start")).alias("SecondsFromStart"), "IsAnomalous", "first_place", "last_place")


@query(
    "J6_chosen_timeline",
    using("verdicts", """
      , chosen AS (SELECT * FROM verdicts WHERE Anomaly = 1 ORDER BY AnomalyScoreNormalized DESC, record_id LIMIT 100)
      SELECT c.record_id AS anomaly_id, v.record_id, v.EventID, v.EpochSeconds - c.EpochSeconds AS SecondsFromAnomaly, v.record_id = c.record_id AS IsAnomalous
      FROM chosen c JOIN verdicts v ON v.EpochSeconds BETWEEN c.EpochSeconds - 600 AND c.EpochSeconds + 600"""),
)
def chosen_timeline(spark, sf_dir) -> DataFrame:
    """Events in pairs with the anomalies of a top-100 report."""
    log = scored_log(spark, sf_dir)
    df = timeline.event_timeline(log.select("record_id", "EventID", "EpochSeconds"), reports.top_anomalies(log, 100))
    return df.select("anomaly_id", "record_id", "EventID", "SecondsFromAnomaly", "IsAnomalous")


@query(
    "J7_event_id_context",
    using("verdicts", f"""
      SELECT record_id, event_frequency, round(event_percentage, 6) AS event_percentage, occurrences, diversity, is_rare, is_isolated, classification, context_risk
      FROM ({CONTEXT}) WHERE Anomaly = 1"""),
)
def event_id_context(spark, sf_dir) -> DataFrame:
    return with_context(spark, sf_dir).select(
        "record_id", "event_frequency", F.round("event_percentage", 6).alias("event_percentage"), "occurrences", "diversity",
        "is_rare", "is_isolated", "classification", "context_risk",
    )


NEARBY = """
, chosen AS (SELECT * FROM verdicts WHERE Anomaly = 1)
, nearby AS (SELECT c.record_id AS anomaly_id, v.EventID, count(*) AS n FROM chosen c JOIN verdicts v
             ON v.EpochSeconds BETWEEN c.EpochSeconds - 600 AND c.EpochSeconds + 600 GROUP BY ALL)
"""


@query(
    "J7_nearby_modes",
    using("verdicts", NEARBY + """
      SELECT anomaly_id, string_agg(EventID, ',' ORDER BY EventID) AS most_common
      FROM (SELECT *, max(n) OVER (PARTITION BY anomaly_id) AS most FROM nearby) WHERE n = most GROUP BY anomaly_id"""),
)
def nearby_modes(spark, sf_dir) -> DataFrame:
    log = scored_log(spark, sf_dir)
    df = timeline.nearby_modes(log.select("EventID", "EpochSeconds"), reports.anomalies_of(log))
    texts = F.transform("most_common", lambda e: e.cast("string"))
    return df.select("anomaly_id", F.array_join(texts, ",").alias("most_common"))


TOLD = ["EventsPerMinute", "IsNightTime", "LogLength"]


@query(
    "J8_incident_narrative",
    using("verdicts", f"""
      SELECT record_id, concat_ws(chr(10),
        'Time: ' || strftime(event_ts, '%Y-%m-%d %H:%M:%S') || CASE WHEN Hour < 6 OR Hour > 22 THEN ', at night' WHEN Hour BETWEEN 9 AND 17 THEN ', in office hours' ELSE '' END,
        'Event: ' || EventID || ' ' || EventID_Name, 'Host: ' || Computer, 'Account: ' || "User", 'Reasons:',
        '  - busy minute: ' || printf('%.1f', CAST(EventsPerMinute AS DOUBLE)) || ' events',
        CASE WHEN IsNightTime > 0.5 THEN '  - logged at night' ELSE '  - isnighttime = 0.00, decreases the score' END,
        '  - loglength = ' || printf('%.2f', CAST(LogLength AS DOUBLE)) || ', increases the score',
        'Risk: ' || CASE WHEN AnomalyScoreNormalized > 0.9 THEN 'critical' WHEN AnomalyScoreNormalized > 0.7 THEN 'high'
             WHEN AnomalyScoreNormalized > 0.5 THEN 'medium' ELSE 'low' END || ' (' || printf('%.1f', AnomalyScoreNormalized * 100) || '%)',
        'Stage: ' || MITRE_Stage,
        'Context: ' || classification || ', ' || printf('%.1f', event_percentage) || '% of the log, '
          || CASE WHEN is_isolated THEN 'none like it nearby' ELSE occurrences || ' like it nearby' END
          || CASE WHEN is_rare AND is_isolated THEN '; look at it first' WHEN is_isolated THEN '; known event in an odd place' ELSE '' END) AS narrative
      FROM ({CONTEXT}) WHERE Anomaly = 1"""),
)
def incident_narrative(spark, sf_dir) -> DataFrame:
    df = with_context(spark, sf_dir)
    top = explain.top_features(
        F.array(*[F.lit(n) for n in TOLD]), F.array(*[F.col(n).cast("double") for n in TOLD]),
        F.array(F.lit(3.0), F.lit(-2.0), F.lit(1.0)), 3,
    )
    df = df.withColumn("top_features", top)
    return df.select("record_id", explain.narrative(df.columns).alias("narrative"))


def ranked_text(column: str, k: int) -> str:
    return f"(SELECT string_agg({column} || ': ' || n, ', ' ORDER BY n DESC, {column}) FROM (SELECT {column}, count(*) AS n FROM verdicts WHERE Anomaly = 1 GROUP BY 1 ORDER BY n DESC, {column} LIMIT {k}))"


@query(
    "J9_dataset_context",
    using("verdicts", f"""
      SELECT count(*) AS total_events, count(*) FILTER (Anomaly = 1) AS total_anomalies,
        printf('%.2f', 100.0 * count(*) FILTER (Anomaly = 1) / count(*)) || '%' AS anomaly_rate,
        strftime(min(event_ts) FILTER (Anomaly = 1), '%Y-%m-%d %H:%M:%S') || ' to ' || strftime(max(event_ts) FILTER (Anomaly = 1), '%Y-%m-%d %H:%M:%S') AS time_range,
        round((max(EpochSeconds) FILTER (Anomaly = 1) - min(EpochSeconds) FILTER (Anomaly = 1)) / 3600.0, 6) AS duration_hours,
        {ranked_text("EventID", 10)} AS event_id_distribution, {ranked_text("Computer", 5)} AS affected_computers,
        (SELECT string_agg(record_id || '/' || EventID || '/' || Computer, ',' ORDER BY record_id) FROM (SELECT * FROM verdicts WHERE Anomaly = 1 ORDER BY record_id LIMIT 20)) AS anomalies
      FROM verdicts"""),
)
def dataset_context(spark, sf_dir) -> DataFrame:
    df = timeline.dataset_context(scored_log(spark, sf_dir))
    rows = F.from_json("anomalies", "array<struct<record_id: string, event_id: string, computer: string>>")
    short = F.transform(rows, lambda r: F.concat_ws("/", r["record_id"], r["event_id"], r["computer"]))
    return df.withColumn("anomalies", F.array_join(short, ","))


@query(
    "J10_anomaly_context",
    using("verdicts", NEARBY + """
      , w AS (SELECT c.record_id, count(*) FILTER (v.EpochSeconds < c.EpochSeconds) AS events_before, count(*) FILTER (v.EpochSeconds > c.EpochSeconds) AS events_after,
                     count(*) AS total_events, min(v.EpochSeconds - c.EpochSeconds) || 's to ' || max(v.EpochSeconds - c.EpochSeconds) || 's' AS time_window
              FROM chosen c JOIN verdicts v ON v.EpochSeconds BETWEEN c.EpochSeconds - 600 AND c.EpochSeconds + 600 GROUP BY c.record_id)
      , t AS (SELECT anomaly_id AS record_id, string_agg(EventID || ':' || n, ',' ORDER BY n DESC, EventID) AS ids
              FROM (SELECT *, row_number() OVER (PARTITION BY anomaly_id ORDER BY n DESC, EventID) AS r FROM nearby) WHERE r <= 5 GROUP BY 1)
      SELECT record_id, CAST(EventID AS VARCHAR) AS event_id, Computer AS computer, coalesce(Channel, 'Unknown') AS channel, events_before, events_after, total_events, time_window, ids,
             printf('%.2f', 100.0 * (SELECT count(*) FROM verdicts WHERE Anomaly = 1) / total_events) || '%' AS anomaly_rate
      FROM chosen JOIN w USING (record_id) JOIN t USING (record_id)"""),
)
def anomaly_context(spark, sf_dir) -> DataFrame:
    log = scored_log(spark, sf_dir)
    found = log.agg(F.count_if(F.col("Anomaly") == 1)).scalar()
    df = timeline.anomaly_context(reports.anomalies_of(log), log, found)

    def part(path: str, kind: str = "string"):
        return F.get_json_object("context", "$." + path).cast(kind)

    ids = F.from_json(part("timeline.common_event_ids"), "map<string,long>")
    pairs = F.transform(F.map_entries(ids), lambda e: F.concat_ws(":", e["key"], e["value"].cast("string")))
    return df.select(
        "record_id", part("anomaly.event_id").alias("event_id"), part("anomaly.computer").alias("computer"),
        part("anomaly.channel").alias("channel"), part("timeline.events_before", "long").alias("events_before"),
        part("timeline.events_after", "long").alias("events_after"), part("timeline.total_events", "long").alias("total_events"),
        part("timeline.time_window").alias("time_window"), F.array_join(pairs, ",").alias("ids"),
        part("global_stats.anomaly_rate").alias("anomaly_rate"),
    )
