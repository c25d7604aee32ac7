"""Queries E1-E13: the event catalogue and ATT&CK tables against the security log.

Queries over the small tables alone are joined with the events observed in the
log, so that they say how often each catalogued event occurs.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from vigilog.functions import risk
from vigilog.operators import features, knowledge
from vigilog.plans.oracle import HITS, MATCH, RISK, STAGE, using
from vigilog.plans.registry import query
from vigilog.sources.shared_tables import security_log

ENRICHED_COLUMNS = [
    "EventID_RiskScore", "EventID_Category", "EventID_Name", "EventID_Severity", "EventID_PrimaryTactic",
    "EventID_IsSuspicious",
]


def observed(spark, sf_dir) -> DataFrame:
    """``(event_id, observed)`` of the log; one row per distinct EventID."""
    return security_log(spark, sf_dir).groupBy(F.col("EventID").alias("event_id")).agg(F.count(F.lit(1)).alias("observed"))


def observed_catalog(spark, sf_dir) -> DataFrame:
    events = knowledge.event_catalog(spark)
    seen = observed(spark, sf_dir).join(F.broadcast(events.select("event_id")), "event_id", "left_semi")
    # At most one row per catalogue event is left, so the join below is small.
    return events.join(F.broadcast(seen), "event_id", "left").withColumn("observed", F.coalesce("observed", F.lit(0)))


OBSERVED = (
    "(SELECT c.*, coalesce(o.observed, 0) AS observed FROM catalog c LEFT JOIN "
    "(SELECT EventID AS event_id, count(*) AS observed FROM seclog GROUP BY EventID) o USING (event_id))"
)


@query(
    "E1_catalog_lookup",
    using("seclog catalog", f"SELECT source, event_id, name, category, risk_score, severity, array_to_string(key_fields, ',') AS key_fields, known_states, observed FROM {OBSERVED}"),
)
def catalog_lookup(spark, sf_dir) -> DataFrame:
    return observed_catalog(spark, sf_dir).select(
        "source", "event_id", "name", "category", "risk_score", "severity", F.array_join("key_fields", ",").alias("key_fields"),
        F.size(F.map_keys("states")).alias("known_states"), "observed",
    )


@query(
    "E2_channel_routed_lookup",
    using("seclog catalog", f"SELECT record_id, c.source, c.name FROM seclog r LEFT JOIN catalog c ON {MATCH}"),
)
def channel_routed_lookup(spark, sf_dir) -> DataFrame:
    df = knowledge.with_intelligence(security_log(spark, sf_dir))
    return df.select("record_id", F.col("info.source").alias("source"), F.col("info.name").alias("name"))


@query(
    "E3_unknown_event_defaults",
    using("seclog catalog", f"""
      SELECT EventID, Channel, coalesce(c.risk_score, 5) AS risk_score, coalesce(c.category, 'Unknown') AS category,
             coalesce(c.name, 'Unknown Event ' || EventID) AS name, coalesce(c.severity, 'Unknown') AS severity, count(*) AS n
      FROM seclog r LEFT JOIN catalog c ON {MATCH} GROUP BY ALL"""),
)
def unknown_event_defaults(spark, sf_dir) -> DataFrame:
    df = knowledge.enrich(security_log(spark, sf_dir))
    return df.groupBy(
        "EventID", "Channel", F.col("EventID_RiskScore").alias("risk_score"), F.col("EventID_Category").alias("category"),
        F.col("EventID_Name").alias("name"), F.col("EventID_Severity").alias("severity"),
    ).agg(F.count(F.lit(1)).alias("n"))


@query(
    "E4_source_label",
    using("seclog catalog", f"""
      SELECT record_id, CASE WHEN c.event_id IS NULL THEN 'Unknown'
          WHEN r.Channel IS NULL THEN c.source
          WHEN lower(r.Channel) LIKE '%sysmon%' OR lower(r.Channel) LIKE '%operational%' THEN 'Sysmon'
          WHEN lower(r.Channel) LIKE '%security%' THEN 'Security'
          WHEN lower(r.Channel) LIKE '%system%' THEN 'System' ELSE 'Unknown' END AS source,
        CASE WHEN EventID >= 4600 AND EventID < 6000 THEN 'Security' WHEN EventID >= 1 AND EventID <= 29 THEN 'Sysmon' ELSE 'System' END AS guess
      FROM seclog r LEFT JOIN catalog c ON {MATCH}"""),
)
def source_label(spark, sf_dir) -> DataFrame:
    df = knowledge.with_intelligence(security_log(spark, sf_dir))
    label = knowledge.source_label(
        F.col("EventID"), F.col("Channel"), F.col("info.source"), F.col("info.event_id").isNotNull()
    )
    return df.select("record_id", label.alias("source"), knowledge.guessed_source(F.col("EventID")).alias("guess"))


@query(
    "E5_context_risk_score",
    using("feats catalog", f"SELECT record_id, CAST({RISK} AS INTEGER) AS risk FROM feats r LEFT JOIN catalog c ON {MATCH}"),
)
def context_risk_score(spark, sf_dir) -> DataFrame:
    df = features.extract_features(security_log(spark, sf_dir))
    return df.select("record_id", F.col("EventID_RiskScore").alias("risk"))


@query(
    "E6_mitre_mapping",
    using("seclog catalog techniques", f"""
      , observed AS {OBSERVED}
      , listed AS (SELECT event_id, unnest(mitre_techniques) AS technique_id, generate_subscripts(mitre_techniques, 1) AS position FROM catalog)
      , named AS (SELECT event_id, string_agg(coalesce(m.name, 'Unknown (' || l.technique_id || ')'), ';' ORDER BY position) AS names
                  FROM listed l LEFT JOIN (SELECT DISTINCT technique_id, name FROM techniques) m USING (technique_id) GROUP BY event_id)
      SELECT o.event_id, o.observed, array_to_string(mitre_tactics, ',') AS tactics, array_to_string(mitre_techniques, ',') AS techniques,
             coalesce(mitre_tactics[1], 'Execution') AS primary_tactic, coalesce(names, '') AS technique_names
      FROM observed o LEFT JOIN named USING (event_id)"""),
)
def mitre_mapping(spark, sf_dir) -> DataFrame:
    df = knowledge.technique_names(observed_catalog(spark, sf_dir), knowledge.techniques(spark))
    return df.select(
        "event_id", "observed", F.array_join("mitre_tactics", ",").alias("tactics"),
        F.array_join("mitre_techniques", ",").alias("techniques"),
        knowledge.primary_tactic(F.struct("mitre_tactics")).alias("primary_tactic"),
        F.array_join("technique_names", ";").alias("technique_names"),
    )


@query(
    "E6_techniques_by_tactic",
    using("seclog catalog techniques", f"""
      , listed AS (SELECT event_id, observed, unnest(mitre_tactics) AS tactic FROM {OBSERVED})
      SELECT event_id, observed, l.tactic, t.techniques FROM listed l
      LEFT JOIN (SELECT tactic, string_agg(DISTINCT technique_id, ',' ORDER BY technique_id) AS techniques FROM techniques GROUP BY tactic) t ON l.tactic = t.tactic"""),
)
def techniques_by_tactic(spark, sf_dir) -> DataFrame:
    events = observed_catalog(spark, sf_dir)
    pairs = knowledge.techniques_by_tactic(events, knowledge.techniques(spark))
    return pairs.join(F.broadcast(events.select("event_id", "observed")), "event_id").select(
        "event_id", "observed", "tactic", F.array_join("techniques", ",").alias("techniques")
    )


@query(
    "E7_suspicious_reasons",
    using("feats catalog", f"""
      SELECT record_id, CASE WHEN {RISK} >= 7 THEN array_to_string(coalesce(c.suspicious_when, []), ';')
             ELSE array_to_string(list_sort({HITS}), ';') END AS reasons,
             {RISK} >= 7 OR len({HITS}) > 0 AS suspicious
      FROM feats r LEFT JOIN catalog c ON {MATCH}"""),
)
def suspicious_reasons(spark, sf_dir) -> DataFrame:
    log = security_log(spark, sf_dir)
    keys, seconds = features.pinned_profiles(log)
    df = (
        log.transform(features.temporal)
        .transform(features.frequencies, keys)
        .transform(features.trailing_windows, seconds)
        .transform(features.event_flags)
        .transform(features.text_features)
    )
    df = knowledge.with_intelligence(df)
    context = risk.Context(df.columns)
    score = risk.context_score(F.col("info.risk_score"), context)
    cues = F.col("info.suspicious_when")
    reasons = risk.reasons(score, cues, context)
    shown = F.when(score >= 7, F.array_join(reasons, ";")).otherwise(F.array_join(F.sort_array(reasons), ";"))
    return df.select("record_id", shown.alias("reasons"), risk.is_suspicious(score, cues, context).alias("suspicious"))


@query("E8_row_enrichment", using("enriched", f"SELECT record_id, {', '.join(ENRICHED_COLUMNS)} FROM enriched"))
def row_enrichment(spark, sf_dir) -> DataFrame:
    return features.extract_features(security_log(spark, sf_dir)).select("record_id", *ENRICHED_COLUMNS)


@query(
    "E9_stage_of_tactic",
    using("seclog catalog", f"""
      SELECT record_id, {STAGE} AS stage FROM (
        SELECT record_id, coalesce(c.mitre_tactics[1], 'Execution') AS EventID_PrimaryTactic
        FROM seclog r LEFT JOIN catalog c ON {MATCH})"""),
)
def stage_of_tactic(spark, sf_dir) -> DataFrame:
    df = knowledge.with_intelligence(security_log(spark, sf_dir))
    return df.select("record_id", knowledge.stage_of(knowledge.primary_tactic(F.col("info"))).alias("stage"))


@query(
    "E10_high_risk_search",
    using("seclog catalog", f"SELECT source, event_id, name, risk_score, observed FROM {OBSERVED} WHERE risk_score >= 7"),
)
def high_risk_search(spark, sf_dir) -> DataFrame:
    events = knowledge.high_risk_events(observed_catalog(spark, sf_dir))
    return events.select("source", "event_id", "name", "risk_score", "observed").orderBy(F.desc("risk_score"), "event_id")


@query(
    "E11_catalog_statistics",
    using("seclog catalog", """
      SELECT count(*) FILTER (source = 'Security') AS security_events, count(*) FILTER (source = 'Sysmon') AS sysmon_events,
        count(*) FILTER (source = 'System') AS system_events, count(*) FILTER (source = 'SQL') AS sql_events,
        count(*) AS total_events, count(*) FILTER (risk_score >= 7) AS high_risk_events, count(*) FILTER (risk_score >= 9) AS critical_severity,
        (SELECT count(*) FROM seclog WHERE EventID IN (SELECT event_id FROM catalog)) AS log_events_known
      FROM catalog"""),
)
def catalog_statistics(spark, sf_dir) -> DataFrame:
    known = observed_catalog(spark, sf_dir).agg(F.sum("observed").alias("n")).scalar()
    return knowledge.catalog_statistics(knowledge.event_catalog(spark)).withColumn("log_events_known", known)


@query(
    "E12_events_by_tactic",
    using("seclog catalog tactics", f"""
      SELECT t.tactic, count(e.event_id) AS events, CAST(coalesce(sum(e.observed), 0) AS BIGINT) AS observed
      FROM tactics t LEFT JOIN (SELECT *, unnest(mitre_tactics) AS tactic FROM {OBSERVED}) e ON e.tactic = t.tactic GROUP BY t.tactic"""),
)
def events_by_tactic(spark, sf_dir) -> DataFrame:
    listed = observed_catalog(spark, sf_dir).select("event_id", "observed", F.explode("mitre_tactics").alias("tactic"))
    return (
        knowledge.tactics(spark)
        .join(listed, "tactic", "left")
        .groupBy("tactic")
        .agg(F.count("event_id").alias("events"), F.coalesce(F.sum("observed"), F.lit(0)).alias("observed"))
    )


@query(
    "E12_severe_events_by_source",
    using("seclog catalog", f"""
      SELECT source, severity, event_id, name, observed FROM {OBSERVED} WHERE severity IN ('Critical', 'High') AND source IN ('Sysmon', 'SQL')"""),
)
def severe_events_by_source(spark, sf_dir) -> DataFrame:
    events = observed_catalog(spark, sf_dir)
    severe = F.col("severity").isin("Critical", "High") & F.col("source").isin("Sysmon", "SQL")
    return events.filter(severe).select("source", "severity", "event_id", "name", "observed")


@query(
    "E13_technique_search",
    using("seclog catalog techniques tactics", f"""
      , uses AS (SELECT technique_id, CAST(sum(observed) AS BIGINT) AS observed FROM (SELECT observed, unnest(mitre_techniques) AS technique_id FROM {OBSERVED}) GROUP BY 1)
      SELECT t.technique_id, t.name, t.tactic, x.description, coalesce(observed, 0) AS observed
      FROM techniques t JOIN tactics x USING (tactic) LEFT JOIN uses USING (technique_id)
      WHERE lower(t.technique_id) LIKE '%account%' OR lower(t.name) LIKE '%account%'"""),
)
def technique_search(spark, sf_dir) -> DataFrame:
    uses = (
        observed_catalog(spark, sf_dir)
        .select("observed", F.explode("mitre_techniques").alias("technique_id"))
        .groupBy("technique_id")
        .agg(F.sum("observed").alias("observed"))
    )
    return (
        knowledge.search_techniques(knowledge.techniques(spark), "Account")
        .join(knowledge.tactics(spark).select("tactic", "description"), "tactic")
        .join(uses, "technique_id", "left")
        .select("technique_id", "name", "tactic", "description", F.coalesce("observed", F.lit(0)).alias("observed"))
    )


@query(
    "E13_last_tactic_of_technique",
    using("seclog catalog techniques tactics", f"""
      , uses AS (SELECT technique_id, CAST(sum(observed) AS BIGINT) AS observed FROM (SELECT observed, unnest(mitre_techniques) AS technique_id FROM {OBSERVED}) GROUP BY 1)
      SELECT technique_id, arg_max(tactic, ordinal) AS tactic, any_value(name) AS name, any_value(coalesce(observed, 0)) AS observed
      FROM techniques JOIN tactics USING (tactic) LEFT JOIN uses USING (technique_id) GROUP BY technique_id"""),
)
def last_tactic_of_technique(spark, sf_dir) -> DataFrame:
    uses = (
        observed_catalog(spark, sf_dir)
        .select("observed", F.explode("mitre_techniques").alias("technique_id"))
        .groupBy("technique_id")
        .agg(F.sum("observed").alias("observed"))
    )
    latest = knowledge.last_tactic(knowledge.techniques(spark), knowledge.tactics(spark))
    return latest.join(uses, "technique_id", "left").withColumn("observed", F.coalesce("observed", F.lit(0)))
