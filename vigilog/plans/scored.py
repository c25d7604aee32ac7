"""The security log with features, knowledge and verdicts.

The feature table is stored once per session and data folder, as a run would keep
it, and the queries on results read it. The score of ``scored_features`` is the
square root of the shared ``value`` column, so that SQL can state the same
verdicts; a fitted model takes its place in a real run.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from vigilog.operators import features, knowledge, verdicts
from vigilog.session import stored
from vigilog.sources.shared_tables import security_log

_tables: dict[tuple[str, str], DataFrame] = {}


def feature_table(spark, sf_dir) -> DataFrame:
    key = (spark.sparkContext.applicationId, sf_dir)
    if key not in _tables:
        _tables[key] = stored(features.extract_features(security_log(spark, sf_dir)))
    return _tables[key]


def model_features(df: DataFrame) -> list[str]:
    """The model columns, without the score that the shared table gives."""
    return [c for c in features.ml_features(df) if c != "value"]


def scored_features(spark, sf_dir) -> DataFrame:
    df = feature_table(spark, sf_dir).withColumn("AnomalyScore", F.sqrt("value"))
    return verdicts.with_verdicts(df)


def scored_log(spark, sf_dir) -> DataFrame:
    """As above, with the category as group label and the stage of the primary tactic."""
    anomaly = F.col("Anomaly") == 1
    return scored_features(spark, sf_dir).withColumns(
        {
            "ClusterLabel": F.when(anomaly, F.col("EventID_Category")),
            "MITRE_Stage": F.when(anomaly, knowledge.stage_of(F.col("EventID_PrimaryTactic"))),
        }
    )
