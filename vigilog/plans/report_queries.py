"""Queries R1-R17 and A1, A6-A12: verdicts and reports from a given score."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from vigilog.operators import features, quantile, reports, scaling, verdicts
from vigilog.plans.oracle import text, using
from vigilog.plans.registry import query
from vigilog.plans.scored import scored_features, scored_log
from vigilog.plans.source_queries import samples_of
from vigilog.rules import events
from vigilog.sources.shared_tables import read_table, security_log

SCALED = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]


@query(
    "A1_standard_scaling",
    "SELECT l_orderkey, l_linenumber, " + ", ".join(
        f"round(({c} - avg({c}) OVER ()) / stddev_pop({c}) OVER (), 6) AS {c}" for c in SCALED) + " FROM lineitem",
)
def standard_scaling(spark, sf_dir) -> DataFrame:
    lines = read_table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", *SCALED)
    scaler = scaling.fit_scaler(lines, SCALED)
    return lines.select("l_orderkey", "l_linenumber", *[F.round(c, 6).alias(n) for n, c in zip(SCALED, scaler.columns())])


@query(
    "A6_contamination_cut",
    """SELECT l_orderkey, l_linenumber, CAST(l_extendedprice > quantile_cont(l_extendedprice, 0.9) OVER () AS INTEGER) AS Anomaly FROM lineitem""",
)
def contamination_cut(spark, sf_dir) -> DataFrame:
    lines = read_table(spark, sf_dir, "lineitem")
    cut = verdicts.contamination_cut(lines, "l_extendedprice", verdicts.effective_contamination(lines.count()))
    return lines.select("l_orderkey", "l_linenumber", (F.col("l_extendedprice") > cut).cast("int").alias("Anomaly"))


@query(
    "A7_small_data_cut",
    "SELECT n_nationkey, CAST(n_nationkey * n_nationkey % 7 >= quantile_cont(n_nationkey * n_nationkey % 7, 0.75) OVER () AS INTEGER) AS Anomaly FROM nation",
)
def small_data_cut(spark, sf_dir) -> DataFrame:
    rows = read_table(spark, sf_dir, "nation").select("n_nationkey", (F.col("n_nationkey") * F.col("n_nationkey") % 7).alias("score"))
    cut = verdicts.small_data_cut(rows, "score")
    return rows.select("n_nationkey", (F.col("score") >= cut).cast("int").alias("Anomaly"))


@query(
    "A8_score_normalisation",
    "SELECT event_id, round((value - min(value) OVER ()) / (max(value) OVER () - min(value) OVER ()), 6) AS score, 0.5 AS constant FROM events",
)
def score_normalisation(spark, sf_dir) -> DataFrame:
    rows = read_table(spark, sf_dir, "events")
    low, high = verdicts.score_range(rows, "value")
    return rows.select(
        "event_id", F.round(verdicts.normalised(F.col("value"), low, high), 6).alias("score"),
        verdicts.normalised(F.lit(1.0), 1.0, 1.0).alias("constant"),
    )


@query("A9_confidence", using("verdicts", "SELECT record_id, Anomaly, Confidence FROM verdicts"))
def confidence(spark, sf_dir) -> DataFrame:
    return scored_features(spark, sf_dir).select("record_id", "Anomaly", "Confidence")


INDICATORS = (
    "(EventsPerMinute > 20 OR TimeSincePrevEvent > 300 OR TimeSincePrevEvent < 0.1 OR UniqueEventIDsInWindow > 10 OR EventIDRarity > 0.8 OR "
    + " OR ".join(f"{c} > 0.5" for c in events.INDICATOR_FLAGS) + ")"
)
BENIGN = f"(Anomaly = 1 AND EventID IN ({', '.join(map(str, events.BENIGN_EVENT_IDS))}) AND NOT {INDICATORS})"


@query(
    "A10_benign_filter",
    using("verdicts", f"""
      SELECT record_id, CASE WHEN {BENIGN} THEN 0 ELSE Anomaly END AS Anomaly,
             round(CASE WHEN {BENIGN} THEN least(0.4, AnomalyScoreNormalized) ELSE AnomalyScoreNormalized END, 6) AS score,
             CASE WHEN {BENIGN} THEN 1 ELSE Confidence END AS Confidence FROM verdicts"""),
)
def benign_filter(spark, sf_dir) -> DataFrame:
    df = verdicts.benign_filter(scored_features(spark, sf_dir))
    return df.select("record_id", "Anomaly", F.round("AnomalyScoreNormalized", 6).alias("score"), "Confidence")


@query("A11_other_indicators", using("feats", f"SELECT record_id, {INDICATORS} AS suspicious FROM feats"))
def other_indicators(spark, sf_dir) -> DataFrame:
    df = features.extract_features(security_log(spark, sf_dir))
    return df.select("record_id", verdicts.other_indicators(df.columns).alias("suspicious"))


@query(
    "A12_training_metrics",
    using("verdicts", """
      SELECT 'given_score' AS algorithm, count(*) AS n_samples, 1 AS n_features, count(*) FILTER (Anomaly = 1) AS n_anomalies,
             round(avg(Anomaly), 6) AS anomaly_rate, 0.1 AS contamination, 0.1 AS original_contamination, true AS adaptive_mode FROM verdicts"""),
)
def training_metrics(spark, sf_dir) -> DataFrame:
    scores = read_table(spark, sf_dir, "events").select(F.sqrt("value").alias("AnomalyScore"))
    df = verdicts.training_metrics(verdicts.with_verdicts(scores), "given_score", 1, 0.1, 0.1, True)
    return df.withColumn("anomaly_rate", F.round("anomaly_rate", 6))


@query(
    "R1_parse_summary",
    using("seclog", 'SELECT count(*) AS total_events, count(DISTINCT EventID) AS unique_event_ids, count(DISTINCT Computer) AS unique_hosts, true AS time_data FROM seclog'),
)
def parse_summary(spark, sf_dir) -> DataFrame:
    return reports.parse_summary(security_log(spark, sf_dir))


@query(
    "R2_result_summary",
    using("verdicts", """
      SELECT count(*) AS total_events, count(*) FILTER (Anomaly = 1) AS anomaly_count,
        round(100.0 * count(*) FILTER (Anomaly = 1) / count(*), 2) AS anomaly_percentage,
        count(*) FILTER (Anomaly = 1 AND AnomalyScoreNormalized > 0.8) AS high_risk_count,
        count(*) FILTER (Anomaly = 1 AND AnomalyScoreNormalized > 0.5 AND AnomalyScoreNormalized <= 0.8) AS medium_risk_count,
        count(*) FILTER (Anomaly = 1 AND AnomalyScoreNormalized <= 0.5) AS low_risk_count FROM verdicts"""),
)
def result_summary(spark, sf_dir) -> DataFrame:
    return reports.result_summary(scored_log(spark, sf_dir))


TOP = 'SELECT record_id, EventID, round(AnomalyScoreNormalized, 6) AS score, TimeCreatedISO, Computer, "User" FROM verdicts WHERE Anomaly = 1 ORDER BY AnomalyScoreNormalized DESC, record_id LIMIT '


@query("R3_top_anomalies", using("verdicts", TOP + "100"))
def top_anomalies(spark, sf_dir) -> DataFrame:
    df = reports.top_anomalies(scored_log(spark, sf_dir), 100)
    return df.select("record_id", "EventID", F.round("AnomalyScoreNormalized", 6).alias("score"), "TimeCreatedISO", "Computer", "User")


@query("R4_label_counts", using("verdicts", "SELECT Anomaly, count(*) AS n FROM verdicts GROUP BY Anomaly"))
def label_counts(spark, sf_dir) -> DataFrame:
    return reports.label_counts(scored_log(spark, sf_dir))


@query(
    "R5_score_histogram",
    using("verdicts", "SELECT Anomaly, CAST(least(floor(AnomalyScoreNormalized * 30), 29) AS INTEGER) AS bin, count(*) AS n FROM verdicts GROUP BY ALL"),
)
def score_histogram(spark, sf_dir) -> DataFrame:
    return reports.score_histogram(scored_log(spark, sf_dir))


@query(
    "R5_score_histogram_of_ten",
    using("verdicts", "SELECT Anomaly, CAST(least(floor(AnomalyScoreNormalized * 10), 9) AS INTEGER) AS bin, count(*) AS n FROM verdicts WHERE Anomaly = 1 GROUP BY ALL"),
)
def score_histogram_of_ten(spark, sf_dir) -> DataFrame:
    return reports.score_histogram(reports.anomalies_of(scored_log(spark, sf_dir)), 10)


@query(
    "R6_timeline",
    using("verdicts", """
      , b AS (SELECT date_trunc('day', event_ts) AS bin, CAST(sum(Anomaly) AS BIGINT) AS anomalies, count(*) AS total FROM verdicts GROUP BY 1)
      SELECT CAST(d.bin AS TIMESTAMP) AS bin, coalesce(anomalies, 0) AS anomalies, coalesce(total - anomalies, 0) AS normal
      FROM (SELECT unnest(generate_series((SELECT min(bin) FROM b), (SELECT max(bin) FROM b), INTERVAL 1 DAY)) AS bin) d LEFT JOIN b ON d.bin = b.bin"""),
)
def timeline(spark, sf_dir) -> DataFrame:
    return reports.timeline(scored_log(spark, sf_dir))


@query(
    "R6_index_timeline",
    using("verdicts", """
      SELECT CAST(greatest(ceil((record_id - lo) / ((hi - lo) / 50.0)) - 1, 0) AS INTEGER) AS bin, CAST(sum(Anomaly) AS BIGINT) AS anomalies,
             CAST(count(*) - sum(Anomaly) AS BIGINT) AS normal
      FROM verdicts, (SELECT min(record_id) AS lo, max(record_id) AS hi FROM verdicts) GROUP BY 1"""),
)
def index_timeline(spark, sf_dir) -> DataFrame:
    return reports.index_timeline(scored_log(spark, sf_dir).drop("EpochSeconds"))


CORRELATED = ["l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_linenumber"]


@query(
    "R7_correlation_matrix",
    " UNION ALL ".join(
        f"SELECT {text(a)} AS feature, {text(b)} AS other, round(corr({a}, {b}), 6) AS r FROM lineitem" for a in CORRELATED for b in CORRELATED
    ),
)
def correlation_matrix(spark, sf_dir) -> DataFrame:
    return reports.correlations(read_table(spark, sf_dir, "lineitem"), CORRELATED).withColumn("r", F.round("r", 6))


@query(
    "R8_group_counts",
    using("verdicts", """
      SELECT 'cluster' AS kind, ClusterLabel AS label, count(*) AS n FROM verdicts WHERE Anomaly = 1 GROUP BY ClusterLabel
      UNION ALL SELECT 'stage', MITRE_Stage, count(*) FROM verdicts WHERE Anomaly = 1 GROUP BY MITRE_Stage"""),
)
def group_counts(spark, sf_dir) -> DataFrame:
    log = scored_log(spark, sf_dir)
    clusters = reports.group_counts(log, "ClusterLabel").select(F.lit("cluster").alias("kind"), F.col("ClusterLabel").alias("label"), "n")
    stages = reports.group_counts(log, "MITRE_Stage").select(F.lit("stage").alias("kind"), F.col("MITRE_Stage").alias("label"), "n")
    return clusters.unionByName(stages)


@query(
    "R9_severity_distribution",
    using("verdicts", """
      SELECT risk, count(*) AS total, count(*) FILTER (Anomaly = 1) AS anomalies, count(*) FILTER (Anomaly = 0) AS normal,
             round(100.0 * count(*) / sum(count(*)) OVER (), 1) AS percentage
      FROM (SELECT Anomaly, CASE WHEN EventID_RiskScore >= 8 THEN 'Critical' WHEN EventID_RiskScore >= 6 THEN 'High'
              WHEN EventID_RiskScore >= 4 THEN 'Medium' ELSE 'Low' END AS risk FROM verdicts) GROUP BY risk"""),
)
def severity_distribution(spark, sf_dir) -> DataFrame:
    return reports.severity_distribution(scored_log(spark, sf_dir))


@query(
    "R10_stage_report",
    using("verdicts", """
      , a AS (SELECT * FROM verdicts WHERE Anomaly = 1)
      , ids AS (SELECT MITRE_Stage, string_agg(EventID || ': ' || n, ', ' ORDER BY n DESC, EventID) AS top_event_ids FROM (
          SELECT MITRE_Stage, EventID, count(*) AS n, row_number() OVER (PARTITION BY MITRE_Stage ORDER BY count(*) DESC, EventID) AS r FROM a GROUP BY 1, 2) WHERE r <= 5 GROUP BY 1)
      , labels AS (SELECT MITRE_Stage, string_agg(ClusterLabel || ': ' || n, ', ' ORDER BY n DESC, ClusterLabel) AS top_labels FROM (
          SELECT MITRE_Stage, ClusterLabel, count(*) AS n, row_number() OVER (PARTITION BY MITRE_Stage ORDER BY count(*) DESC, ClusterLabel) AS r FROM a GROUP BY 1, 2) WHERE r <= 3 GROUP BY 1)
      SELECT MITRE_Stage, n, top_event_ids, top_labels FROM (SELECT MITRE_Stage, count(*) AS n FROM a GROUP BY 1) JOIN ids USING (MITRE_Stage) JOIN labels USING (MITRE_Stage)"""),
)
def stage_report(spark, sf_dir) -> DataFrame:
    return reports.stage_report(scored_log(spark, sf_dir))


@query(
    "R11_dashboard_metrics",
    using("verdicts", """
      SELECT count(*) AS total_events, count(*) FILTER (Anomaly = 1) AS n_anomalies, round(100.0 * count(*) FILTER (Anomaly = 1) / count(*), 2) AS anomaly_rate,
             min(TimeCreatedISO) AS first_time, max(TimeCreatedISO) AS last_time,
             (SELECT string_agg(EventID || ': ' || n, ', ' ORDER BY n DESC, EventID) FROM (SELECT EventID, count(*) AS n FROM verdicts GROUP BY 1 ORDER BY n DESC, EventID LIMIT 3)) AS top_events
      FROM verdicts"""),
)
def dashboard_metrics(spark, sf_dir) -> DataFrame:
    return reports.dashboard_metrics(scored_log(spark, sf_dir))


@query(
    "R12_anomalies_by_stage",
    using("verdicts", f"""
      SELECT MITRE_Stage, count(*) AS n, count(DISTINCT EventID) AS event_ids, count(DISTINCT Computer) AS hosts,
             round(avg(AnomalyScoreNormalized), 6) AS mean_score,
             CASE MITRE_Stage {" ".join(f"WHEN {text(s)} THEN {i}" for i, s in enumerate(reports.STAGE_LABELS))} END AS stage_order
      FROM verdicts WHERE Anomaly = 1 GROUP BY MITRE_Stage"""),
)
def anomalies_by_stage(spark, sf_dir) -> DataFrame:
    return reports.anomalies_by_stage(scored_log(spark, sf_dir)).withColumn("mean_score", F.round("mean_score", 6))


@query(
    "R13_event_groups",
    using("verdicts", """
      SELECT EventID, count(*) AS count, round(avg(AnomalyScoreNormalized), 6) AS avg_score, round(max(AnomalyScoreNormalized), 6) AS max_score,
             count(DISTINCT Computer) AS unique_computers, count(DISTINCT "User") AS unique_users,
             CASE WHEN max(AnomalyScoreNormalized) > 0.8 THEN 'CRITICAL' WHEN max(AnomalyScoreNormalized) > 0.6 THEN 'HIGH'
                  WHEN max(AnomalyScoreNormalized) > 0.4 THEN 'MEDIUM' ELSE 'LOW' END AS badge
      FROM verdicts WHERE Anomaly = 1 GROUP BY EventID"""),
)
def event_groups(spark, sf_dir) -> DataFrame:
    df = reports.event_groups(scored_log(spark, sf_dir))
    return df.withColumns({c: F.round(c, 6) for c in ["avg_score", "max_score"]})


@query(
    "R14_top_hosts_and_events",
    using("verdicts", """
      SELECT * FROM (SELECT 'host' AS kind, coalesce(Computer, 'Unknown') AS value, count(*) AS n FROM verdicts WHERE Anomaly = 1 GROUP BY 2 ORDER BY n DESC, value LIMIT 10)
      UNION ALL SELECT * FROM (SELECT 'event' AS kind, coalesce(CAST(EventID AS VARCHAR), 'Unknown') AS value, count(*) AS n FROM verdicts WHERE Anomaly = 1 GROUP BY 2 ORDER BY n DESC, value LIMIT 10)
      UNION ALL SELECT * FROM (SELECT 'channel' AS kind, coalesce(Channel, 'Unknown') AS value, count(*) AS n FROM verdicts WHERE Anomaly = 1 GROUP BY 2 ORDER BY n DESC, value LIMIT 10)"""),
)
def top_hosts_and_events(spark, sf_dir) -> DataFrame:
    found = reports.anomalies_of(scored_log(spark, sf_dir))
    parts = [
        reports.top_values(found, column, 10, "Unknown").select(F.lit(kind).alias("kind"), "value", "n")
        for kind, column in [("host", "Computer"), ("event", "EventID"), ("channel", "Channel")]
    ]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


@query(
    "R15_anomalies_by_hour",
    using("verdicts", """
      SELECT CAST(h AS INTEGER) AS Hour, coalesce(n, 0) AS n FROM (SELECT unnest(range(24)) AS h)
      LEFT JOIN (SELECT Hour, count(*) AS n FROM verdicts WHERE Anomaly = 1 GROUP BY Hour) ON Hour = h"""),
)
def anomalies_by_hour(spark, sf_dir) -> DataFrame:
    return reports.anomalies_by_hour(scored_log(spark, sf_dir))


@query(
    "R16_risk_bands",
    using("verdicts", """
      SELECT CASE WHEN AnomalyScoreNormalized > 0.8 THEN 'Critical' WHEN AnomalyScoreNormalized > 0.6 THEN 'High'
                  WHEN AnomalyScoreNormalized > 0.4 THEN 'Medium' ELSE 'Low' END AS band, count(*) AS n
      FROM verdicts WHERE Anomaly = 1 GROUP BY band"""),
)
def risk_bands(spark, sf_dir) -> DataFrame:
    return reports.risk_bands(scored_log(spark, sf_dir))


@query(
    "R17_sample_statistics",
    """
    WITH s AS (SELECT CASE WHEN toxic = 1 THEN 'anomaly' ELSE 'normal' END AS label,
        CASE WHEN toxic = 1 THEN 'malware_execution' ELSE 'normal' END AS attack_type, CASE WHEN quality = 0 THEN 'high' ELSE 'medium' END AS severity FROM labels)
    SELECT 'label' AS kind, label AS value, count(*) AS n FROM s GROUP BY 2 UNION ALL SELECT 'attack_type', attack_type, count(*) FROM s GROUP BY 2
    UNION ALL SELECT 'severity', severity, count(*) FROM s GROUP BY 2 UNION ALL SELECT 'total', NULL, count(*) FROM s""",
)
def sample_statistics(spark, sf_dir) -> DataFrame:
    return reports.sample_statistics(samples_of(spark, sf_dir))


SHARES = [0.01, 0.25, 0.5, 0.9, 0.999]


@query(
    "A6_exact_quantiles",
    f"SELECT unnest({SHARES}) AS share, unnest(quantile_cont(n_chars, {SHARES})) AS n_chars, unnest(quantile_cont(length(text), {SHARES})) AS length FROM documents",
)
def exact_quantiles(spark, sf_dir) -> DataFrame:
    documents = read_table(spark, sf_dir, "documents").select("n_chars", F.length("text").alias("length"))
    rows = [
        (share, quantile.quantile(documents, "n_chars", share), quantile.quantile(documents, "length", share))
        for share in SHARES
    ]
    return spark.createDataFrame(rows, "share double, n_chars double, length double")
