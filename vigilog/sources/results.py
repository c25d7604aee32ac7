"""Sinks and tables of results and labelled samples.

Tables that grow are written batch by batch: a batch goes to a folder of its own, and counts once a
row in the table's manifest names that folder. A try that fails leaves a folder that no reader
looks at; a batch that is written again under its id is read once, as it was first committed.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, Window, functions as F, types as T
from pyspark.errors import AnalysisException

MANIFEST = "batch string, name string, folder string, committed timestamp"

RESULT_COLUMNS = {
    "event_record_id": ("EventRecordID", "long"),
    "event_id": ("EventID", "long"),
    "computer": ("Computer", "string"),
    "timestamp": ("TimeCreatedISO", "string"),
    "anomaly": ("Anomaly", "int"),
    "anomaly_score": ("AnomalyScoreNormalized", "double"),
    "cluster_label": ("ClusterLabel", "string"),
    "mitre_stage": ("MITRE_Stage", "string"),
    "confidence": ("Confidence", "double"),
}


def flat(df: DataFrame) -> DataFrame:
    """Maps, lists and structs as JSON text, for sinks without nested types."""
    nested = (T.MapType, T.ArrayType, T.StructType)
    return df.select(
        *[F.to_json(f.name).alias(f.name) if isinstance(f.dataType, nested) else F.col(f.name) for f in df.schema]
    )


def write_csv(df: DataFrame, path: str, anomalies_only: bool = False) -> None:
    """All results, or the anomalies alone, as CSV files with a header."""
    rows = df.filter("Anomaly = 1") if anomalies_only else df
    flat(rows).write.mode("overwrite").csv(path, header=True, escape='"')


def append_batch(rows: DataFrame, path: str, name: str, batch: str | None = None) -> str:
    """Write one batch of the part ``name`` of a table; the id to give when it is tried again."""
    batch, folder = batch or uuid.uuid4().hex, uuid.uuid4().hex
    rows.write.parquet(f"{path}/batches/{folder}")
    entry = rows.sparkSession.range(1).select(F.lit(batch).alias("batch"), F.lit(name).alias("name"), F.lit(folder).alias("folder"), F.current_timestamp().alias("committed"))
    entry.coalesce(1).write.mode("append").parquet(f"{path}/manifest")
    return batch


def committed(spark: SparkSession, path: str) -> DataFrame:
    """``batch``, ``name``, ``folder``, ``committed`` of every batch, one row each."""
    try:
        entries = spark.read.schema(MANIFEST).parquet(f"{path}/manifest")
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], MANIFEST)
    first = Window.partitionBy("name", "batch").orderBy("committed", "folder")
    return entries.withColumn("_place", F.row_number().over(first)).filter("_place = 1").drop("_place")


def read_batches(spark: SparkSession, path: str, name: str | None = None, schema: str | None = None) -> DataFrame | None:
    """The rows of all committed batches, or of those of one part; other folders are not read."""
    entries = committed(spark, path)
    chosen = entries if name is None else entries.filter(F.col("name") == name)
    folders = [f"{path}/batches/{r['folder']}" for r in chosen.select("folder").orderBy("folder").collect()]  # a row per batch
    if not folders:
        return None if schema is None else spark.createDataFrame([], schema)
    reader = spark.read.option("mergeSchema", True) if schema is None else spark.read.schema(schema)
    return reader.parquet(*folders)


RESULT_SCHEMA = "session_id string, " + ", ".join(f"{name} {kind}" for name, (_, kind) in RESULT_COLUMNS.items())


def append_results(results: DataFrame, path: str, session_id: str, batch: str | None = None) -> str:
    """Add the anomalies of one session to the result table, once for each batch id."""
    columns = [
        (F.col(source) if source in results.columns else F.lit(None)).cast(kind).alias(name)
        for name, (source, kind) in RESULT_COLUMNS.items()
    ]
    anomalies = results.filter("Anomaly = 1").select(F.lit(session_id).alias("session_id"), *columns)
    return append_batch(anomalies, path, session_id, batch)


def all_results(spark: SparkSession, path: str) -> DataFrame:
    return read_batches(spark, path, schema=RESULT_SCHEMA)


def read_results(spark: SparkSession, path: str, session_id: str, anomalies_only: bool = False) -> DataFrame:
    """Results of one session, highest score first; other sessions are not read. The
    session is text also where it looks like a number."""
    rows = read_batches(spark, path, session_id, RESULT_SCHEMA)
    rows = rows.select(*RESULT_COLUMNS, "session_id")
    if anomalies_only:
        rows = rows.filter("anomaly = 1")
    return rows.orderBy(F.desc("anomaly_score"))


def append_samples(samples: DataFrame, path: str, dataset: str, description: str = "", batch: str | None = None) -> str:
    """Add labelled samples ``(id, label, attack_type, severity, notes, ...)`` to a dataset, once for each batch id.

    The dataset comes into being with its first samples.
    """
    rows = samples.withColumns(
        {"dataset": F.lit(dataset), "description": F.lit(description), "added_at": F.current_timestamp()}
    )
    return append_batch(rows, path, dataset, batch)


def load_samples(spark: SparkSession, path: str, dataset: str) -> DataFrame:
    """All samples of a dataset with the columns that any of its parts has, and no others."""
    rows = read_batches(spark, path, dataset)
    if rows is None:
        raise ValueError(f"no dataset {dataset}")
    return rows


def list_datasets(spark: SparkSession, path: str) -> DataFrame:
    return (
        read_batches(spark, path, schema="description string, added_at timestamp, dataset string")
        .groupBy("dataset")
        .agg(
            F.max("description").alias("description"),
            F.count(F.lit(1)).alias("samples"),
            F.min("added_at").alias("created_at"),
            F.max("added_at").alias("updated_at"),
        )
    )


def import_labelled_csv(
    spark: SparkSession, path: str, label_column: str = "Label", attack_column: str = "AttackType"
) -> DataFrame:
    """Labelled samples from CSV: label 1 is an anomaly, all other columns are event data."""
    raw = spark.read.csv(path, header=True, escape='"')
    if label_column not in raw.columns:
        raise ValueError(f"label column {label_column} not found")
    attack = F.col(attack_column) if attack_column in raw.columns else F.lit(None).cast("string")
    data = raw.drop(label_column, attack_column)
    return raw.select(
        F.when(F.col(label_column).try_cast("double") == 1, "anomaly").otherwise("normal").alias("label"),
        F.coalesce(attack, F.lit("normal")).alias("attack_type"),
        F.lit("medium").alias("severity"),
        *data.columns,
    )


def export_labelled_csv(samples: DataFrame, path: str) -> None:
    """Event data with the columns Label (1 or 0) and AttackType."""
    labelled = samples.withColumns(
        {"Label": (F.col("label") == "anomaly").cast("int"), "AttackType": F.col("attack_type")}
    )
    extra = [c for c in ["id", "attack_type", "severity", "notes", "dataset", "description", "added_at"] if c in samples.columns]
    flat(labelled.drop(*extra)).write.mode("overwrite").csv(path, header=True, escape='"')
