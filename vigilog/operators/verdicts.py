"""From anomaly scores to verdicts: cut, scaling, confidence and the benign filter.

Scores are high for anomalies throughout.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from vigilog.operators.quantile import quantile
from vigilog.rules import events

SMALL_DATA = 50


def effective_contamination(rows: int, contamination: float = 0.1, adaptive: bool = True) -> float:
    """The share of anomalies to expect; small data sets get a larger one."""
    if not adaptive or rows >= 100:
        return contamination
    if rows < 10:
        return min(0.5, max(0.3, 3 * contamination))
    if rows < 50:
        return min(0.3, 2 * contamination)
    return min(0.2, 1.5 * contamination)


def contamination_cut(scores: DataFrame, column: str, contamination: float) -> float:
    """The score that a share of ``contamination`` of the training rows exceeds."""
    return quantile(scores, column, 1 - contamination)


def small_data_cut(scores: DataFrame, column: str) -> float:
    """The upper quartile, used inclusively for fewer than 50 training rows."""
    return quantile(scores, column, 0.75)


def score_range(scores: DataFrame, column: str) -> tuple[float, float]:
    return tuple(scores.agg(F.min(column), F.max(column)).first())


def normalised(score: Column, low: float, high: float) -> Column:
    """Score on the scale 0 to 1; constant scores become 0.5."""
    if low is None or low == high:
        return F.when(score.isNotNull(), 0.5)
    return (score - low) / (high - low)


def confidence(score: Column, anomaly: Column) -> Column:
    """3 (high) to 1 (low): far above the cut for anomalies, far below for normal rows."""
    sure = F.when(score > 0.8, 3).when(score > 0.6, 2).otherwise(1)
    unsure = F.when(score < 0.2, 3).when(score < 0.4, 2).otherwise(1)
    return F.when(anomaly == 1, sure).otherwise(unsure)


def other_indicators(columns: list[str]) -> Column:
    """Does a row have a suspicious trait besides a rare event ID?

    A gap of less than a tenth of a second counts, and so do rows in the second of
    the event before them.
    """
    conditions = []
    if "EventsPerMinute" in columns:
        conditions.append(F.col("EventsPerMinute") > 20)
    if "TimeSincePrevEvent" in columns:
        gap = F.col("TimeSincePrevEvent")
        conditions.append((gap > 300) | (gap < 0.1))
    if "UniqueEventIDsInWindow" in columns:
        conditions.append(F.col("UniqueEventIDsInWindow") > 10)
    conditions += [F.col(c) > 0.5 for c in events.INDICATOR_FLAGS if c in columns]
    if "EventIDRarity" in columns:
        conditions.append(F.col("EventIDRarity") > 0.8)
    met = F.lit(False)
    for condition in conditions:
        met = met | F.coalesce(condition, F.lit(False))
    return met


def benign_filter(df: DataFrame, event_ids: list[int] = events.BENIGN_EVENT_IDS) -> DataFrame:
    """Routine events without a second indicator are no anomalies."""
    if "EventID" not in df.columns:
        return df
    benign = (
        (F.col("Anomaly") == 1)
        & F.coalesce(F.col("EventID").isin(event_ids), F.lit(False))
        & ~other_indicators(df.columns)
    )
    score = F.col("AnomalyScoreNormalized")
    return df.withColumns(
        {
            "Anomaly": F.when(benign, 0).otherwise(F.col("Anomaly")),
            "AnomalyScoreNormalized": F.when(benign, F.least(F.lit(0.4), score)).otherwise(score),
            "Confidence": F.when(benign, 1).otherwise(F.col("Confidence")),
        }
    )


def with_verdicts(df: DataFrame, score: str = "AnomalyScore", contamination: float = 0.1) -> DataFrame:
    """Label, scaled score and confidence from a score column, by the cut of ``df`` itself."""
    cut = contamination_cut(df, score, contamination)
    low, high = score_range(df, score)
    labelled = df.withColumns(
        {"Anomaly": (F.col(score) > cut).cast("int"), "AnomalyScoreNormalized": normalised(F.col(score), low, high)}
    )
    return labelled.withColumn("Confidence", confidence(F.col("AnomalyScoreNormalized"), F.col("Anomaly")))


def training_metrics(verdicts: DataFrame, algorithm: str, features: int, contamination: float, original: float, adaptive: bool) -> DataFrame:
    """One row that describes a training run."""
    anomalies = F.count_if(F.col("Anomaly") == 1)
    rows = F.count(F.lit(1))
    return verdicts.agg(
        F.lit(algorithm).alias("algorithm"),
        rows.alias("n_samples"),
        F.lit(features).alias("n_features"),
        anomalies.alias("n_anomalies"),
        F.coalesce(F.try_divide(anomalies, rows), F.lit(0.0)).alias("anomaly_rate"),
        F.lit(contamination).alias("contamination"),
        F.lit(original).alias("original_contamination"),
        F.lit(adaptive).alias("adaptive_mode"),
    )
