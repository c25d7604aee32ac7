"""The whole analysis of a log, from rows to a threat report."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from vigilog.operators import clusters, detection, labels, reports
from vigilog.operators.features import extract_features
from vigilog.plans.registry import query
from vigilog.plans.scored import feature_table, model_features
from vigilog.session import stored


def analyse(log: DataFrame, algorithm: str = "isolation_forest", contamination: float = 0.1) -> DataFrame:
    """Results of a normalised log with a unique ``record_id``: all features, verdicts,
    and group and stage of the anomalies."""
    return analyse_features(stored(extract_features(log)), algorithm, contamination)


def analyse_features(table: DataFrame, algorithm: str = "isolation_forest", contamination: float = 0.1) -> DataFrame:
    """The same from a stored feature table."""
    names = model_features(table)
    _, verdicts = detection.fit_predict(table, names, algorithm, contamination)
    if algorithm != "isolation_forest":
        verdicts = stored(verdicts)  # they come from a join, and all that follows reads them
    found = stored(labels.with_stage(reports.anomalies_of(verdicts)))
    grouped = clusters.grouped_anomalies(found, names)
    normal = verdicts.filter("Anomaly = 0")
    return normal.unionByName(grouped, allowMissingColumns=True)


@query("threat_report")
def threat_report(spark, sf_dir) -> DataFrame:
    """Anomalies by stage and host with their event types and scores."""
    results = analyse_features(feature_table(spark, sf_dir))
    return (
        reports.anomalies_of(results)
        .groupBy("MITRE_Stage", "Computer")
        .agg(
            F.count(F.lit(1)).alias("anomalies"),
            F.countDistinct("EventID").alias("event_types"),
            F.max("EventID_RiskScore").alias("highest_risk"),
            F.round(F.avg("AnomalyScoreNormalized"), 4).alias("mean_score"),
        )
        .orderBy("MITRE_Stage", F.desc("anomalies"), "Computer")
    )
