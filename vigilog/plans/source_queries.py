"""Queries S1-S14: readers and sinks, run as round trips of the log through the
shared folder."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, Window, functions as F

from vigilog.operators import knowledge, verdicts
from vigilog.plans.oracle import using
from vigilog.plans.registry import query
from vigilog.plans.scored import scored_log
from vigilog.session import shared_folder, stored
from vigilog.sources import readers, results
from vigilog.sources.shared_tables import read_table, security_log

FIELDS = ["EventID", "Level", "EpochSeconds", "Computer", "User", "RawLog"]
LOG_SQL = 'SELECT record_id AS "row", EventID, Level, EpochSeconds, Computer, "User", nullif(RawLog, \'\') AS RawLog FROM seclog'


def scratch(spark, name: str) -> str:
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


def exported(spark, sf_dir) -> DataFrame:
    """The log as a source would write it, with its own row number."""
    log = security_log(spark, sf_dir)
    return log.select(
        F.col("record_id").alias("row"), "EventID", "Level", F.col("TimeCreatedISO").alias("TimeCreated"),
        "Computer", "User", "IP", "Channel", "RawLog",
    )


# Rows of one file of a kind that is written by one task.
FILE_ROWS = 2_000_000
# Splits that one file is read in where a query asks for several, each of this many bytes at least.
SPLITS, SPLIT_BYTES = 16, 8192


def in_files(body: DataFrame, key: str, path: str, head: str, foot: str | None = None, rows: int = FILE_ROWS) -> int:
    """``body`` (``key``, ``value``) as text files of about ``rows`` lines between a first and a last line, dealt by the key's hash; the number of files."""
    spark = body.sparkSession
    files = max(1, -(-body.count() // rows))
    dealt = body.select(F.pmod(F.xxhash64(key), F.lit(files)).alias("file"), F.lit(1).alias("place"), "value")
    for line, place in ((head, 0), (foot, 2)):
        if line is not None:
            dealt = dealt.unionByName(spark.range(files).select(F.col("id").alias("file"), F.lit(place).alias("place"), F.lit(line).alias("value")))
    # A file lies in one partition, in the order of its lines.
    dealt.repartition(files, "file").sortWithinPartitions("file", "place").select("file", "value").write.partitionBy("file").text(path)
    return files


def split_bytes(spark, path: str) -> int:
    """The size of a split of which the largest file has ``SPLITS``."""
    return max(SPLIT_BYTES, spark.read.format("binaryFile").load(path).agg(F.max("length")).first()[0] // SPLITS)


def back(df: DataFrame) -> DataFrame:
    return df.select(F.col("row").cast("long").alias("row"), *FIELDS[:-1], F.nullif("RawLog", F.lit("")).alias("RawLog"))


@query("S2_csv_reader", using("seclog", LOG_SQL))
def csv_reader(spark, sf_dir) -> DataFrame:
    path = scratch(spark, "csv")
    results.write_csv(exported(spark, sf_dir), path)
    return back(readers.read_logs(spark, path, "csv"))


@query(
    "S2_mixed_headers",
    using("seclog", """
      SELECT record_id AS "row", EventID, CASE WHEN record_id % 3 = 0 THEN NULL ELSE Computer END AS Computer,
             CASE WHEN record_id % 3 = 0 THEN "User" END AS Account, EpochSeconds FROM seclog"""),
)
def mixed_headers(spark, sf_dir) -> DataFrame:
    """Two kinds of files in one folder: other columns, and common ones in another order."""
    path = scratch(spark, "csv")
    log = exported(spark, sf_dir)
    results.write_csv(log.filter("row % 3 <> 0").select("row", "EventID", "Computer", "TimeCreated"), path + "/a")
    results.write_csv(log.filter("row % 3 = 0").select("TimeCreated", F.col("User").alias("Account"), "EventID", "row"), path + "/b")
    df = readers.read_logs(spark, [path + "/a", path + "/b"], "csv")
    return df.select(F.col("row").cast("long").alias("row"), "EventID", "Computer", "Account", "EpochSeconds")


@query("S3_json_reader", using("seclog", LOG_SQL))
def json_reader(spark, sf_dir) -> DataFrame:
    """The three layouts in one read: lines, an array, and single events over several lines."""
    path = scratch(spark, "json")
    log = exported(spark, sf_dir)
    log.filter("row % 2 = 0").write.json(path + "/lines.json")
    # About a thousand files of either kind at most.
    scale = max(1, -(-log.count() // 100_000))
    single = F.col("row") % (100 * scale) == 1
    event = F.to_json(F.struct(*log.columns))
    odd = log.filter("row % 2 = 1")
    # One array for each thousand rows (more of them in a large log) and one file for each single event.
    arrays = odd.filter(~single).groupBy(F.floor(F.col("row") / min(1000 * scale, 100_000)).alias("part")).agg(F.concat(F.lit("["), F.array_join(F.collect_list(event), ",\n"), F.lit("]")).alias("value"))
    arrays.write.partitionBy("part").text(path + "/arrays.json")
    ones = odd.filter(single).select("row", F.regexp_replace(event, "^[{]", "{\n").alias("value"))
    ones.write.partitionBy("row").text(path + "/ones.json")
    files = [path + "/lines.json", path + "/arrays.json/*/", path + "/ones.json/*/"]
    return back(readers.read_logs(spark, files, "json"))


TEXT_LINE = """strftime(event_ts, '%Y-%m-%dT%H:%M:%SZ') || ' ERROR user=' || "User" || ' from ' || IP || ' login on ' || Computer"""


@query(
    "S4_text_reader",
    using("seclog", f"""SELECT {TEXT_LINE} AS RawLog, EpochSeconds, 'ERROR' AS LevelText, "User", IP, 'Login' AS Action FROM seclog"""),
)
def text_reader(spark, sf_dir) -> DataFrame:
    path = scratch(spark, "text")
    log = security_log(spark, sf_dir)
    line = F.concat(
        F.date_format("event_ts", "yyyy-MM-dd'T'HH:mm:ss'Z'"), F.lit(" ERROR user="), F.col("User"), F.lit(" from "),
        F.col("IP"), F.lit(" login on "), F.col("Computer"),
    )
    # Two of three lines are followed by a blank line, which the reader skips.
    ended = F.concat(line, F.when(F.col("record_id") % 3 > 0, "\n").otherwise(""))
    log.select(ended.alias("value")).write.text(path)
    df = readers.read_logs(spark, path, "text")
    return df.select("RawLog", "EpochSeconds", "LevelText", "User", "IP", "Action")


@query(
    "S4_line_numbers",
    "SELECT count(*) AS lines, CAST(sum(n) AS BIGINT) AS number_sum FROM (SELECT row_number() OVER () AS n FROM documents)",
)
def line_numbers(spark, sf_dir) -> DataFrame:
    path = scratch(spark, "lines")
    documents = read_table(spark, sf_dir, "documents")
    documents.select(F.regexp_replace("text", r"[\r\n]+", " ").alias("value")).write.text(path)
    # The numbers of a file begin after the lines of the files before it: a row for each file.
    files = readers.numbered_lines(spark, [path]).groupBy("source_file").agg(F.count(F.lit(1)).alias("n"), F.sum("LineNumber").alias("numbers"))
    earlier = F.coalesce(F.sum("n").over(Window.orderBy("source_file").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return files.select("n", (F.col("numbers") + F.col("n") * earlier).alias("numbers")).agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("lines"), F.sum("numbers").alias("number_sum")
    )


def as_xml(log: DataFrame) -> DataFrame:
    escaped = F.replace(F.replace(F.col("RawLog"), F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;"))
    return log.select(
        F.concat(
            F.lit('<Event xmlns="http://schemas.microsoft.com/win/2004/08/events/event"><System><Provider Name="P" Guid="{1}"/><EventID>'),
            F.col("EventID").cast("string"), F.lit("</EventID><Level>"), F.col("Level").cast("string"),
            F.lit('</Level><TimeCreated SystemTime="'), F.date_format("event_ts", "yyyy-MM-dd'T'HH:mm:ss'Z'"),
            F.lit('"/><EventRecordID>'), F.col("record_id").cast("string"),
            F.lit('</EventRecordID><Execution ProcessID="4" ThreadID="8"/><Channel>Security</Channel><Computer>'),
            F.col("Computer"), F.lit('</Computer></System><EventData><Data Name="TargetUserName">'), F.col("User"),
            F.lit('</Data><Data Name="Message">'), escaped, F.lit("</Data><Data>loose</Data></EventData></Event>"),
        ).alias("value")
    )


@query(
    "S5_event_xml_reader",
    using("seclog", """
      SELECT record_id AS EventRecordID, EventID, Level, EpochSeconds, Computer, 4 AS ExecutionProcessID, 'P' AS ProviderName,
             "User" AS TargetUserName, nullif(regexp_replace(RawLog, '\\s+', ' ', 'g'), '') AS Message, 'loose' AS Data_2 FROM seclog"""),
)
def event_xml_reader(spark, sf_dir) -> DataFrame:
    path = scratch(spark, "xml")
    as_xml(security_log(spark, sf_dir)).write.text(path)
    df = readers.read_logs(spark, path, "xml")
    data = F.col("EventData")
    return df.select(
        "EventRecordID", "EventID", "Level", "EpochSeconds", "Computer", "ExecutionProcessID", "ProviderName",
        *[data[k].alias(k) for k in ["TargetUserName", "Message", "Data_2"]],
    )


@query(
    "S6_broken_records",
    "SELECT count(*) FILTER (event_id % 10 <> 0) AS good, count(*) FILTER (event_id % 10 = 0) AS broken FROM events",
)
def broken_records(spark, sf_dir) -> DataFrame:
    path = scratch(spark, "broken")
    line = F.when(F.col("event_id") % 10 == 0, F.lit('{"EventID": 1, ')).otherwise(
        F.concat(F.lit('{"EventID": '), F.col("user_id").cast("string"), F.lit("}"))
    )
    read_table(spark, sf_dir, "events").select(line.alias("value")).write.text(path)
    raw = readers.read_json(spark, [path], lines=True, schema="EventID string, _corrupt_record string")
    return readers.ingest_quality(raw)


@query(
    "S6_broken_csv_records",
    "SELECT count(*) FILTER (event_id % 10 <> 0) AS good, count(*) FILTER (event_id % 10 = 0) AS broken, count(*) FILTER (event_id % 10 <> 0 AND event_id % 3 = 0) AS with_breaks FROM events",
)
def broken_csv_records(spark, sf_dir) -> DataFrame:
    """Values with quoted line breaks, and records with a value too many, in files of several splits."""
    path = scratch(spark, "broken")
    number = F.col("event_id").cast("string")
    value = F.when(F.col("event_id") % 3 == 0, F.lit('"first\nsecond, ""quoted"""')).otherwise(F.lit("plain"))
    line = F.concat(number, F.lit(","), value, F.when(F.col("event_id") % 10 == 0, F.lit(",more")).otherwise(F.lit("")))
    in_files(read_table(spark, sf_dir, "events").select("event_id", line.alias("value")), "event_id", path, "id,note")
    raw = stored(readers.read_csv(spark, [path + "/*/"]))
    breaks = raw.filter("_corrupt_record IS NULL").agg(F.count_if(F.col("note") == 'first\nsecond, "quoted"').alias("with_breaks"))
    return readers.ingest_quality(raw).crossJoin(breaks)


@query("S3_array_splits", "SELECT count(*) AS n, sum(event_id)::BIGINT AS ids, true AS several_tasks FROM events")
def array_splits(spark, sf_dir) -> DataFrame:
    """One array in one file (of up to about ``FILE_ROWS`` events), with braces and quotes in its strings, read by several tasks."""
    path = scratch(spark, "array")
    event = F.to_json(F.struct("event_id", F.lit('a } \\" ] { "b\\').alias("note")))
    body = read_table(spark, sf_dir, "events").select("event_id", F.concat(event, F.lit(",")).alias("value"))
    # Every file ends with an event that is not counted.
    files = in_files(body, "event_id", path, "[", '{"event_id": 0}]')
    path += "/*/"
    name = "spark.sql.files.maxPartitionBytes"
    before = spark.conf.get(name)
    spark.conf.set(name, str(split_bytes(spark, path)))
    try:
        tasks = spark.read.text(path, lineSep="}").rdd.getNumPartitions()
        raw = stored(readers.read_any_json(spark, [path]))
    finally:
        spark.conf.set(name, before)
    return raw.agg((F.count(F.lit(1)) - files).alias("n"), F.sum("event_id").alias("ids"), F.lit(tasks > files).alias("several_tasks"))


@query(
    "S7_file_concatenation",
    using("seclog", """
      SELECT EventID, Computer, EpochSeconds, NULL AS RawLog FROM seclog
      UNION ALL SELECT NULL, NULL, EpochSeconds, strftime(event_ts, '%Y-%m-%dT%H:%M:%SZ') || ' ' || Computer FROM seclog"""),
)
def file_concatenation(spark, sf_dir) -> DataFrame:
    table, lines = scratch(spark, "events") + ".csv", scratch(spark, "lines") + ".log"
    results.write_csv(exported(spark, sf_dir).select("EventID", "Computer", "TimeCreated"), table)
    log = security_log(spark, sf_dir)
    log.select(F.concat_ws(" ", F.date_format("event_ts", "yyyy-MM-dd'T'HH:mm:ss'Z'"), "Computer").alias("value")).write.text(lines)
    return readers.read_logs(spark, [table, lines]).select("EventID", "Computer", "EpochSeconds", "RawLog")


@query(
    "S1_format_dispatch",
    using("seclog", "SELECT 'csv' AS format, count(*) AS n, count(EventID) AS with_id FROM seclog UNION ALL SELECT 'text', count(*), 0 FROM seclog"),
)
def format_dispatch(spark, sf_dir) -> DataFrame:
    table, lines = scratch(spark, "events") + ".csv", scratch(spark, "lines") + ".txt"
    results.write_csv(exported(spark, sf_dir).select("EventID", "Computer", "TimeCreated"), table)
    security_log(spark, sf_dir).select("Computer").write.text(lines)
    df = readers.read_logs(spark, [table, lines])
    kind = F.when(F.col("source_file").contains(".csv"), "csv").otherwise("text")
    return df.groupBy(kind.alias("format")).agg(F.count(F.lit(1)).alias("n"), F.count("EventID").alias("with_id"))


@query(
    "S8_catalog_upsert",
    using("seclog catalog", """
      , changes AS (SELECT EventID AS event_id, count(*) AS n FROM seclog GROUP BY EventID)
      SELECT event_id, CASE WHEN n IS NULL THEN c.name ELSE 'Observed ' || event_id END AS name,
             CAST(coalesce(CASE WHEN n IS NOT NULL THEN 1 END, c.risk_score) AS INTEGER) AS risk_score
      FROM catalog c FULL JOIN changes USING (event_id)"""),
)
def catalog_upsert(spark, sf_dir) -> DataFrame:
    current = knowledge.event_catalog(spark).select("event_id", "name", "risk_score")
    path = scratch(spark, "catalog")
    current.write.parquet(path)
    changes = security_log(spark, sf_dir).select(F.col("EventID").alias("event_id")).distinct().select(
        "event_id", F.concat(F.lit("Observed "), F.col("event_id").cast("string")).alias("name"), F.lit(1).alias("risk_score")
    )
    return knowledge.upsert(spark.read.parquet(path), changes, ["event_id"])


RESULT_SQL = """
SELECT record_id AS event_record_id, EventID AS event_id, Computer AS computer, TimeCreatedISO AS "timestamp", 1 AS anomaly,
       round(AnomalyScoreNormalized, 6) AS anomaly_score, ClusterLabel AS cluster_label, MITRE_Stage AS mitre_stage,
       CAST(Confidence AS DOUBLE) AS confidence
FROM verdicts WHERE Anomaly = 1
"""


@query(
    "S9_csv_sink",
    using("verdicts", 'SELECT record_id, EventID, Anomaly, round(AnomalyScoreNormalized, 6) AS score FROM verdicts WHERE Anomaly = 1'),
)
def csv_sink(spark, sf_dir) -> DataFrame:
    path = scratch(spark, "results")
    results.write_csv(scored_log(spark, sf_dir), path, anomalies_only=True)
    df = spark.read.csv(path, header=True, escape='"')
    return df.select(
        F.col("record_id").cast("long").alias("record_id"), F.col("EventID").cast("long").alias("EventID"),
        F.col("Anomaly").cast("int").alias("Anomaly"),
        F.round(F.col("AnomalyScoreNormalized").cast("double"), 6).alias("score"),
    )


def stored_results(spark, sf_dir) -> str:
    path = scratch(spark, "sessions")
    log = scored_log(spark, sf_dir).withColumn("EventRecordID", F.col("record_id"))
    results.append_results(log, path, "first")
    results.append_results(log.filter("EventID = 4625"), path, "second")
    return path


@query("S10_repeated_append", using("verdicts", f"SELECT session_id, count(*) AS n FROM ({RESULT_SQL}), (VALUES ('a'), ('b')) v(session_id) GROUP BY session_id"))
def repeated_append(spark, sf_dir) -> DataFrame:
    """Batches that are written twice, and a try without an entry in the manifest, count once and never."""
    path = scratch(spark, "sessions")
    log = scored_log(spark, sf_dir)
    for session in ("a", "b"):
        parts = [log.filter("record_id % 2 = 0"), log.filter("record_id % 2 = 1")]
        for part, name in zip(parts, ("even", "odd"), strict=True):
            results.append_results(part, path, session, name)
        results.append_results(parts[0], path, session, "even")
    log.limit(5).select("record_id").write.parquet(f"{path}/batches/failed")
    return results.all_results(spark, path).groupBy("session_id").agg(F.count(F.lit(1)).alias("n"))


@query(
    "S10_append_session_results",
    using("verdicts", f"""
      SELECT 'first' AS session_id, count(*) AS n FROM ({RESULT_SQL})
      UNION ALL SELECT 'second', count(*) FROM ({RESULT_SQL}) WHERE event_id = 4625"""),
)
def append_session_results(spark, sf_dir) -> DataFrame:
    stored = results.all_results(spark, stored_results(spark, sf_dir))
    return stored.groupBy("session_id").agg(F.count(F.lit(1)).alias("n"))


@query("S11_session_results", using("verdicts", RESULT_SQL + " AND EventID = 4625"))
def session_results(spark, sf_dir) -> DataFrame:
    df = results.read_results(spark, stored_results(spark, sf_dir), "second", anomalies_only=True)
    return df.drop("session_id").withColumn("anomaly_score", F.round("anomaly_score", 6))


def samples_of(spark, sf_dir) -> DataFrame:
    """Labelled samples from the shared labels: toxic documents are anomalies."""
    labels = read_table(spark, sf_dir, "labels")
    toxic = F.col("toxic") == 1
    return labels.select(
        F.col("doc_id").alias("id"), F.when(toxic, "anomaly").otherwise("normal").alias("label"),
        F.when(toxic, "malware_execution").otherwise("normal").alias("attack_type"),
        F.when(F.col("quality") == 0, "high").otherwise("medium").alias("severity"), F.lit("").alias("notes"),
    )


@query(
    "S12_labelled_datasets",
    "SELECT 'a' AS dataset, 'all labels' AS description, count(*) AS samples FROM labels UNION ALL SELECT 'b', '', 2 * count(*) FROM labels WHERE toxic = 1",
)
def labelled_datasets(spark, sf_dir) -> DataFrame:
    path, samples = scratch(spark, "datasets"), samples_of(spark, sf_dir)
    results.append_samples(samples, path, "a", "all labels")
    for _ in range(2):
        results.append_samples(samples.filter("label = 'anomaly'"), path, "b")
    return results.list_datasets(spark, path).select("dataset", "description", "samples")


@query(
    "S12_loaded_samples",
    """SELECT 'one' AS dataset, 'HostName' AS columns, count(*) AS samples, sum(doc_id)::BIGINT AS ids FROM labels WHERE toxic = 1
       UNION ALL SELECT 'two', 'CommandLine,Level', count(*), sum(doc_id)::BIGINT FROM labels WHERE toxic = 0""",
)
def loaded_samples(spark, sf_dir) -> DataFrame:
    """Two datasets of different event data; the second one gets a further column later."""
    path, samples = scratch(spark, "datasets"), samples_of(spark, sf_dir)
    normal = samples.filter("label = 'normal'").withColumn("CommandLine", F.lit("whoami"))
    results.append_samples(samples.filter("label = 'anomaly'").withColumn("HostName", F.lit("h")), path, "one")
    results.append_samples(normal.filter("id % 2 = 0"), path, "two")
    results.append_samples(normal.filter("id % 2 = 1").withColumn("Level", F.lit(3)), path, "two")
    fixed = {*samples.columns, "description", "added_at", "dataset"}
    frames = []
    for name in ("one", "two"):
        df = results.load_samples(spark, path, name)
        own = ",".join(sorted(c for c in df.columns if c not in fixed))
        frames.append(df.groupBy("dataset").agg(F.lit(own).alias("columns"), F.count(F.lit(1)).alias("samples"), F.sum("id").alias("ids")))
    return frames[0].unionAll(frames[1])


@query(
    "S13_labelled_csv",
    """SELECT doc_id AS row, CASE WHEN toxic = 1 THEN 'anomaly' ELSE 'normal' END AS label,
         CASE WHEN toxic = 1 THEN 'malware_execution' ELSE 'normal' END AS attack_type, 'medium' AS severity, n_chars FROM labels JOIN documents USING (doc_id)""",
)
def labelled_csv(spark, sf_dir) -> DataFrame:
    path = scratch(spark, "labelled")
    documents = read_table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), F.col("doc_id").alias("row"), "n_chars")
    results.export_labelled_csv(samples_of(spark, sf_dir).join(documents, "id"), path)
    df = results.import_labelled_csv(spark, path)
    return df.select(
        F.col("row").cast("long").alias("row"), "label", "attack_type", "severity", F.col("n_chars").cast("long").alias("n_chars")
    )
