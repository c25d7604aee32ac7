"""Session helpers: a sensible local session and the shared checkpoint folder."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def local_session(cpus: str = "*", app: str = "vigilog") -> SparkSession:
    """A local session for tests and benchmarks; clusters bring their own."""
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "16g")
        .config("spark.ui.enabled", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


# Folders of the tables that were stored, by application.
_stored: dict[str, list[str]] = {}


def shared_folder(spark: SparkSession) -> str:
    """The folder for cut lineage: ``spark.checkpoint.dir`` where the cluster sets it.

    Only a local master falls back to a temporary folder; a cluster without a
    shared folder is a configuration error.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if folder is None:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        folder = tempfile.mkdtemp(prefix="vigilog-")
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(folder)
    return folder


def pinned(df: DataFrame) -> DataFrame:
    """The result of ``df``, written once to the shared folder.

    Used for aggregates that several later steps read, so that they are computed
    once and survive the loss of an executor.
    """
    shared_folder(df.sparkSession)
    return df.checkpoint()


def stored(df: DataFrame) -> DataFrame:
    """``df`` as a Parquet table in the shared folder, for wide results that several
    passes read: a pass reads the columns it needs and no earlier step runs again."""
    path = f"{shared_folder(df.sparkSession)}/{uuid.uuid4().hex}"
    _stored.setdefault(df.sparkSession.sparkContext.applicationId, []).append(path)
    df.write.parquet(path)
    return df.sparkSession.read.parquet(path)


def discard(*tables: DataFrame) -> None:
    """Delete tables of ``stored`` that nothing reads any more, before the end of the run."""
    for table in tables:
        spark = table.sparkSession
        folders = {name.rsplit("/", 1)[0].rsplit("/", 1)[-1] for name in table.inputFiles()}
        paths = _stored.get(spark.sparkContext.applicationId, [])
        for path in [p for p in paths if p.rsplit("/", 1)[-1] in folders]:
            folder = spark._jvm.org.apache.hadoop.fs.Path(path)
            folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)
            paths.remove(path)


def release_tables(spark: SparkSession) -> int:
    """Delete the tables that ``stored`` wrote in this application, and how many there were.

    For the end of a run: results that were not written elsewhere can't be read any more.
    """
    paths = _stored.pop(spark.sparkContext.applicationId, [])
    for path in paths:
        folder = spark._jvm.org.apache.hadoop.fs.Path(path)
        folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)
    return len(paths)


# Rows of one task of a spread source.
SPREAD_ROWS = 250_000


def spread(source: DataFrame, *keys: str) -> DataFrame:
    """A source with at least one partition per core and per ``SPREAD_ROWS`` rows, for steps that are heavy per row.

    Only a source of fewer file splits is redistributed, by the hash of ``keys``.
    """
    wanted = max(source.sparkSession.sparkContext.defaultParallelism, -(-source.count() // SPREAD_ROWS))
    return source if source.rdd.getNumPartitions() >= wanted else source.repartition(wanted, *keys)
