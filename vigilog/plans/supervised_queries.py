"""Queries M1-M10: supervised detection on the shared labels and documents."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, functions as F

from vigilog.operators import detection, features, supervised
from vigilog.plans.registry import query
from vigilog.plans.scored import feature_table, model_features
from vigilog.plans.source_queries import samples_of
from vigilog.rules import events
from vigilog.session import shared_folder, stored
from vigilog.sources.shared_tables import read_table

FEATURES = ["LogLength", "LogWordCount", *events.TEXT_FLAGS, "LogEntropy"]
_frames: dict[tuple[str, str], DataFrame] = {}
_models: dict[tuple[str, str, str], tuple] = {}

MARKED = """(SELECT l.doc_id AS id, length(text) AS LogLength, CASE WHEN toxic = 1 THEN 1 ELSE 0 END AS Label,
  CASE WHEN toxic = 1 THEN CASE WHEN quality = 1 THEN 'malware_execution' ELSE 'data_exfiltration' END ELSE 'normal' END AS AttackType
  FROM labels l JOIN documents d USING (doc_id))"""


def samples(spark, sf_dir) -> DataFrame:
    """Labelled samples with text features of their whole documents."""
    key = (spark.sparkContext.applicationId, sf_dir)
    if key not in _frames:
        toxic = F.col("toxic") == 1
        attack = F.when(F.col("quality") == 1, "malware_execution").otherwise("data_exfiltration")
        labels = read_table(spark, sf_dir, "labels").select(
            F.col("doc_id").alias("id"), F.when(toxic, "anomaly").otherwise("normal").alias("label"),
            F.when(toxic, attack).otherwise("normal").alias("attack_type"),
        )
        documents = read_table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), F.col("text").alias("RawLog"))
        _frames[key] = stored(features.text_features(labels.join(documents, "id")).drop("RawLog"))
    return _frames[key]


def trained(spark, sf_dir, model: str) -> tuple:
    key = (spark.sparkContext.applicationId, sf_dir, model)
    if key not in _models:
        _models[key] = supervised.train_from_samples(samples(spark, sf_dir), FEATURES, model)
    return _models[key]


@query("M1_labelled_frame", f"SELECT id, LogLength, Label, AttackType FROM {MARKED}")
def labelled_frame(spark, sf_dir) -> DataFrame:
    df = supervised.labelled_frame(samples(spark, sf_dir), FEATURES)
    return df.select("id", F.col("LogLength").cast("long").alias("LogLength"), "Label", "AttackType")


@query(
    "M2_stratified_split",
    f"""SELECT id, Label, row_number() OVER (PARTITION BY Label ORDER BY CAST('0x' || md5(CAST(id AS VARCHAR))[1:13] AS BIGINT))
          <= CAST(floor(0.8 * count(*) OVER (PARTITION BY Label)) AS BIGINT) AS is_train FROM {MARKED}""",
)
def stratified_split(spark, sf_dir) -> DataFrame:
    df = supervised.labelled_frame(samples(spark, sf_dir), FEATURES)
    return supervised.stratified_split(df.select("id", "Label"))


@query("M3_random_forest")
def random_forest(spark, sf_dir) -> DataFrame:
    return trained(spark, sf_dir, "random_forest")[2]


@query("M3_gradient_boosting")
def gradient_boosting(spark, sf_dir) -> DataFrame:
    """Both classifiers by boosting."""
    return trained(spark, sf_dir, "gradient_boosting")[2]


SPLIT = f"""(SELECT *, row_number() OVER (PARTITION BY Label ORDER BY CAST('0x' || md5(CAST(id AS VARCHAR))[1:13] AS BIGINT)) AS place,
  CAST(floor(0.8 * count(*) OVER (PARTITION BY Label)) AS BIGINT) AS train FROM {MARKED})"""
REPORTED = f"SELECT AttackType AS class, count(*) AS support, true AS in_range FROM {SPLIT} WHERE place > train AND Label = 1 GROUP BY AttackType"


def reported(spark, sf_dir, model: str) -> DataFrame:
    """The attack report in the form that SQL can state: supports, and all rates within 0 and 1."""
    detector, tested, _ = trained(spark, sf_dir, model)
    rates = [F.col(c).between(0, 1) for c in ("precision", "recall", "f1")]
    report = supervised.attack_report(detector, tested).filter("support > 0")
    return report.select("class", "support", (rates[0] & rates[1] & rates[2]).alias("in_range"))


@query("M4_attack_types", REPORTED)
def attack_types(spark, sf_dir) -> DataFrame:
    return reported(spark, sf_dir, "random_forest")


@query("M4_boosted_attack_types", REPORTED)
def boosted_attack_types(spark, sf_dir) -> DataFrame:
    return reported(spark, sf_dir, "gradient_boosting")


@query(
    "M6_folds",
    f"""SELECT fold, Label, count(*) AS n FROM (
          SELECT Label, (place * 5 - 1) // n AS fold FROM (SELECT Label, place, count(*) OVER (PARTITION BY Label) AS n FROM {SPLIT} WHERE place <= train))
        GROUP BY ALL""",
)
def folds(spark, sf_dir) -> DataFrame:
    frame = supervised.stratified_split(supervised.labelled_frame(samples(spark, sf_dir), FEATURES))
    placed = supervised.stratified_folds(frame.filter("is_train"), 5)
    return placed.groupBy(F.col("fold").cast("long").alias("fold"), "Label").agg(F.count(F.lit(1)).alias("n"))


@query(
    "M1_trained_dataset",
    f"""SELECT count(*) FILTER (place > train) AS n_samples, count(*) FILTER (place > train AND Label = 1) AS attack_samples, 5::BIGINT AS folds, true AS in_range FROM {SPLIT}""",
)
def trained_dataset(spark, sf_dir) -> DataFrame:
    """From a stored dataset to the metrics of both classifiers and the cross-validation."""
    from vigilog.sources import results

    path = f"{shared_folder(spark)}/datasets-{uuid.uuid4().hex}"
    results.append_samples(samples(spark, sf_dir), path, "marked")
    metrics = supervised.train_from_dataset(spark, path, "marked", FEATURES)[2]
    rates = ["accuracy", "f1_score", "f1_weighted", "attack_accuracy", "attack_f1_weighted", "binary_cv_mean"]
    return metrics.select("n_samples", "attack_samples", "folds", F.forall(F.array(*rates), lambda x: x.between(0, 1)).alias("in_range"))


PREDICTED = "(SELECT CAST(toxic AS VARCHAR) AS label, CAST(CASE WHEN n_chars % 3 = 0 THEN 1 - toxic ELSE toxic END AS VARCHAR) AS predicted FROM labels JOIN documents USING (doc_id))"


def given_predictions(spark, sf_dir) -> DataFrame:
    """Predictions that differ from the label for every third document."""
    joined = read_table(spark, sf_dir, "labels").join(read_table(spark, sf_dir, "documents").select("doc_id", "n_chars"), "doc_id")
    wrong = F.col("n_chars") % 3 == 0
    return joined.select(F.col("toxic").alias("Label"), F.when(wrong, 1 - F.col("toxic")).otherwise(F.col("toxic")).alias("Anomaly"))


@query("M5_confusion_matrix", f"SELECT label, predicted, count(*) AS n FROM {PREDICTED} GROUP BY ALL")
def confusion_matrix(spark, sf_dir) -> DataFrame:
    return supervised.confusion(given_predictions(spark, sf_dir))


REPORT = f"""
SELECT c AS class, count(*) FILTER (label = c AND predicted = c) AS hit, count(*) FILTER (label = c) AS support,
       coalesce(hit / nullif(count(*) FILTER (predicted = c), 0), 0) AS "precision", coalesce(hit / nullif(support, 0), 0) AS recall,
       coalesce(2.0 * hit / nullif(support + count(*) FILTER (predicted = c), 0), 0) AS f1
FROM {PREDICTED}, (VALUES ('0'), ('1')) v(c) GROUP BY c
"""


@query(
    "M5_class_report",
    f'SELECT class, round("precision", 6) AS "precision", round(recall, 6) AS recall, round(f1, 6) AS f1, support FROM ({REPORT})',
)
def class_report(spark, sf_dir) -> DataFrame:
    report = supervised.class_report(supervised.confusion(given_predictions(spark, sf_dir)))
    return report.select("class", *[F.round(c, 6).alias(c) for c in ["precision", "recall", "f1"]], "support")


@query(
    "M5_overall_metrics",
    f"""SELECT round(sum(hit) / sum(support), 6) AS accuracy, round(max(f1) FILTER (class = '1'), 6) AS f1_score,
          round(sum(f1 * support) / sum(support), 6) AS f1_weighted, CAST(sum(support) AS BIGINT) AS n_samples FROM ({REPORT})""",
)
def overall_metrics(spark, sf_dir) -> DataFrame:
    df = supervised.overall_metrics(supervised.confusion(given_predictions(spark, sf_dir)))
    return df.withColumns({c: F.round(c, 6) for c in ["accuracy", "f1_score", "f1_weighted"]})


@query("M6_cross_validation")
def cross_validation(spark, sf_dir) -> DataFrame:
    df = supervised.stratified_split(supervised.labelled_frame(samples(spark, sf_dir), FEATURES)).filter("is_train").drop("is_train")
    return supervised.cross_validation_summary(spark, supervised.cross_validation(df, FEATURES))


@query("M7_feature_importances")
def feature_importances(spark, sf_dir) -> DataFrame:
    detector = trained(spark, sf_dir, "random_forest")[0]
    return spark.createDataFrame(detector.importances()[:10], "feature string, importance double")


@query("M8_supervised_prediction")
def supervised_prediction(spark, sf_dir) -> DataFrame:
    detector = trained(spark, sf_dir, "random_forest")[0]
    documents = read_table(spark, sf_dir, "documents").select("doc_id", F.col("text").alias("RawLog"))
    rows = features.text_features(documents).drop("RawLog")
    return supervised.hybrid_predict(rows, detector, None).select("doc_id", *supervised.RESULTS)


@query("M8_hybrid_without_classifier")
def hybrid_without_classifier(spark, sf_dir) -> DataFrame:
    df = feature_table(spark, sf_dir)
    fitted = detection.fit_detector(df, model_features(df))
    return supervised.hybrid_predict(df, None, fitted).select("record_id", "Anomaly", "AnomalyScoreNormalized", "Confidence")


@query("M10_save_and_load")
def save_and_load(spark, sf_dir) -> DataFrame:
    path = f"{shared_folder(spark)}/supervised-{uuid.uuid4().hex}"
    trained(spark, sf_dir, "random_forest")[0].save(spark, path)
    detector = supervised.load_supervised(spark, path)
    return detector.predict(samples(spark, sf_dir)).select("id", *supervised.RESULTS)
