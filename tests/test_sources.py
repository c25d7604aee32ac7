"""Readers and sinks on small files of every format."""

import csv
import json
import random

import pytest
from pyspark.sql import Observation, functions as F

from vigilog.functions import text, timeparse
from vigilog.operators import normalize
from vigilog.sources import readers, results


def test_text_lines(spark, tmp_path):
    lines = [
        b"2024-01-15T10:30:00Z ERROR user=alice from 10.0.0.7 login ok",
        b"",
        b"15/Jan/2024:10:30:00 warn user: bob, denied",
        b"   ",
        b"Jan  5 10:30:00 host connect \xff\xfe done",
        b"nothing here",
    ]
    (tmp_path / "a.log").write_bytes(b"\n".join(lines) + b"\n")
    rows = {r["LineNumber"]: r for r in readers.read_logs(spark, str(tmp_path / "a.log")).collect()}
    assert sorted(rows) == [1, 3, 5, 6]
    first = rows[1]
    assert (first["LevelText"], first["Level"], first["User"], first["IP"], first["Action"]) == ("ERROR", None, "alice", "10.0.0.7", "Login")
    assert (rows[3]["User"], rows[3]["Action"], rows[3]["EpochSeconds"]) == ("bob", "Denied", first["EpochSeconds"])
    assert (rows[5]["Year"], rows[5]["Month"], rows[5]["Day"], rows[5]["Action"]) == (1900, 1, 5, "Connect")
    assert rows[5]["RawLog"].endswith("connect  done")
    assert rows[6]["EpochSeconds"] is None and rows[6]["Action"] is None


def test_line_numbers_over_splits(spark, tmp_path):
    for name, n in (("a.txt", 3000), ("b.txt", 700)):
        (tmp_path / name).write_text("".join(f"{i} {'x' * (i % 50)}\n" for i in range(1, n + 1)))
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "9000")
    try:
        rows = readers.numbered_lines(spark, [str(tmp_path / "a.txt"), str(tmp_path / "b.txt")]).collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    assert len(rows) == 3700
    assert all(int(r["value"].split()[0]) == r["LineNumber"] for r in rows)


def test_csv(spark, tmp_path):
    (tmp_path / "a.csv").write_text('EventID,Level,TimeCreated,Message\n4624,2,2024-01-15 10:30:00,"a, ""b"""\n,high,,x\n')
    rows = readers.read_logs(spark, str(tmp_path / "a.csv")).orderBy("Message").collect()
    assert (rows[0]["EventID"], rows[0]["LevelName"], rows[0]["Message"], rows[0]["Hour"]) == (4624, "Error", 'a, "b"', 10)
    assert (rows[1]["EventID"], rows[1]["Level"], rows[1]["LevelText"]) == (None, None, "high")


def test_json_array_and_object(spark, tmp_path):
    (tmp_path / "a.json").write_text(json.dumps([{"EventID": "4625", "EventData": {"LogonType": " 3 ", "Status": ""}}, {"EventID": 1}]))
    (tmp_path / "b.json").write_text(json.dumps({"EventID": 7045, "Timestamp": "2024/01/15 10:30:00"}))
    rows = {r["EventID"]: r for r in readers.read_logs(spark, [str(tmp_path / "a.json"), str(tmp_path / "b.json")]).collect()}
    assert sorted(rows) == [1, 4625, 7045]
    assert rows[4625]["EventData"] == {"LogonType": "3", "Status": None}
    assert rows[7045]["Minute"] == 30


def test_json_lines_and_mixed_layouts(spark, tmp_path):
    (tmp_path / "a.json").write_text('\n{"EventID": 1}\n{"EventID": 2}\n{"EventID": 3, "Level": "2"}\n')
    (tmp_path / "b.json").write_text(json.dumps([{"EventID": 4}, {"EventID": 5}], indent=1))
    (tmp_path / "c d.json").write_text(json.dumps({"EventID": 6, "EventData": {"a": "x"}}, indent=1))
    paths = [str(tmp_path / n) for n in ("a.json", "b.json", "c d.json")]
    assert sorted(r["EventID"] for r in readers.read_logs(spark, paths).collect()) == [1, 2, 3, 4, 5, 6]


def test_csv_files_of_different_headers(spark, tmp_path):
    (tmp_path / "a.csv").write_text("EventID,Computer\n1,A\n")
    (tmp_path / "b.csv").write_text("Computer,EventID,Extra\nB,2,x\n")
    (tmp_path / "c.csv").write_text("EventID,Computer\n")
    rows = {r["EventID"]: r for r in readers.read_logs(spark, str(tmp_path), "csv").collect()}
    assert sorted(rows) == [1, 2]
    assert [(rows[i]["Computer"], rows[i]["Extra"]) for i in (1, 2)] == [("A", None), ("B", "x")]


def test_datasets_keep_their_own_columns(spark, tmp_path):
    path = str(tmp_path / "sets")
    first = spark.createDataFrame([(1, "anomaly", "a")], "id long, label string, HostName string")
    second = spark.createDataFrame([(2, "normal", "b")], "id long, label string, CommandLine string")
    results.append_samples(first, path, "01")
    results.append_samples(second, path, "1 x:y")
    loaded = results.load_samples(spark, path, "1 x:y")
    assert "HostName" not in loaded.columns and loaded.first()["CommandLine"] == "b"
    assert {r["dataset"] for r in results.list_datasets(spark, path).collect()} == {"01", "1 x:y"}


EVENT = """<Event xmlns='http://schemas.microsoft.com/win/2004/08/events/event'><System><Provider Name='P' Guid='{{g}}'/>
<EventID Qualifiers='1'>{event}</EventID><Level>4</Level><TimeCreated SystemTime='2024-01-15T10:30:00.5Z'/><EventRecordID>9</EventRecordID>
<Execution ProcessID='4' ThreadID='8'/><Channel>Security</Channel><Computer>H</Computer><Security UserID='S-1'/></System>
<EventData><Data Name='A'>x  y</Data><Data>loose</Data><Data Name='B'></Data><Data Name='A'>last</Data></EventData></Event>"""


def test_event_xml(spark, tmp_path):
    broken = "<Event><System><EventID>1</EventID></Sys></Event>"
    (tmp_path / "a.xml").write_text("<Events>\n" + EVENT.format(event=4624) + broken + EVENT.format(event=4625) + "\n</Events>")
    counts = Observation()
    rows = readers.read_logs(spark, str(tmp_path / "a.xml"), counts=counts).orderBy("EventID").collect()
    assert [r["EventID"] for r in rows] == [4624, 4625]
    first = rows[0]
    assert first["EventData"] == {"Data_1": "loose", "B": None, "A": "last"}
    assert (first["LevelName"], first["ExecutionThreadID"], first["SecurityUserID"], first["Channel"]) == ("Information", 8, "S-1", "Security")
    assert first["TimeCreatedISO"] == "2024-01-15T10:30:00.500000+00:00"
    quality = readers.ingest_quality(readers.read_xml(spark, [str(tmp_path / "a.xml")])).first()
    assert (quality["good"], quality["broken"]) == (2, 1)


def test_only_broken_records(spark, tmp_path):
    (tmp_path / "a.xml").write_text("<Event><System></Event>")
    with pytest.raises(ValueError):
        readers.read_logs(spark, str(tmp_path / "a.xml"))


def test_unknown_format(spark):
    with pytest.raises(ValueError):
        readers.read_logs(spark, "a.evtx")


@pytest.mark.parametrize("value,iso,epoch", [
    ("2024-01-15T10:30:00Z", "2024-01-15T10:30:00+00:00", 1705314600),
    ("2024-01-15T10:30:00+05:30", "2024-01-15T10:30:00+05:30", 1705294800),
    ("2024-01-15T10:30:00-0800", "2024-01-15T10:30:00-08:00", 1705343400),
    ("2024-01-15 10:30", "2024-01-15T10:30:00+00:00", 1705314600),
    ("2024-01-15", "2024-01-15T00:00:00+00:00", 1705276800),
    ("2024/01/15 10:30:00", "2024-01-15T10:30:00+00:00", 1705314600),
    ("15/Jan/2024:10:30:00", "2024-01-15T10:30:00+00:00", 1705314600),
    ("Jan  5 10:30:00", "1900-01-05T10:30:00+00:00", -2208605400),
    ("2024-13-15T10:30:00Z", None, None),
    ("2024", None, None),
    ("junk", None, None),
    (None, None, None),
])
def test_times(spark, value, iso, epoch):
    df = spark.createDataFrame([(value,)], "t string")
    columns = timeparse.time_columns(F.col("t"))
    row = df.select(columns["TimeCreatedISO"].alias("iso"), columns["EpochSeconds"].alias("epoch")).first()
    assert (row["iso"], row["epoch"]) == (iso, epoch)


def test_event_data_codes(spark):
    data = {"LogonType": "6", "Status": "0xC000006D", "SubStatus": "0x1", "FailureReason": "%%9999", "IpAddress": "-", "ProcessName": "C:\\a\\b.exe"}
    df = spark.createDataFrame([(data,)], "EventData map<string,string>")
    row = normalize.expand_event_data(df).first()
    assert (row["LogonType"], row["Status"], row["SubStatus"], row["FailureReason"]) == ("6", "Bad Username", "0x1", "9999")
    assert row["IpAddress"] is None and row["ProcessName"] == "b.exe" and row["TaskName"] is None


def test_words_and_entropy(spark):
    df = spark.createDataFrame([("a\u00a0b\tc  d",), ("",), ("aabb",), ("a😀",)], "t string")
    rows = df.select(text.word_count(F.col("t")).alias("w"), text.entropy("t").alias("h")).collect()
    assert [r["w"] for r in rows] == [4, 0, 1, 1]
    assert rows[1]["h"] == 0.0 and rows[2]["h"] == 1.0 and rows[3]["h"] == 1.0


def test_result_table_round_trip(spark, tmp_path):
    path = str(tmp_path / "results")
    data = [(1, 4625, "H1", "2024", 1, 0.9, "c", "s", 3), (2, 4624, "H2", "2024", 0, 0.1, None, None, 1), (3, 1, "H1", "2024", 1, 0.95, "c", "s", 3)]
    df = spark.createDataFrame(data, "EventRecordID long, EventID long, Computer string, TimeCreatedISO string, Anomaly int, AnomalyScoreNormalized double, ClusterLabel string, MITRE_Stage string, Confidence int")
    results.append_results(df, path, "one")
    results.append_results(df.limit(1), path, "two")
    rows = results.read_results(spark, path, "one").collect()
    assert [r["event_record_id"] for r in rows] == [3, 1]
    assert results.read_results(spark, path, "two", anomalies_only=True).count() == 1


@pytest.fixture
def small_splits(spark):
    name = "spark.sql.files.maxPartitionBytes"
    before, cost = spark.conf.get(name), spark.conf.get("spark.sql.files.openCostInBytes")
    spark.conf.set(name, "300b")
    spark.conf.set("spark.sql.files.openCostInBytes", "1b")
    yield
    spark.conf.set(name, before)
    spark.conf.set("spark.sql.files.openCostInBytes", cost)


HARD = ['plain', 'a } b { c', 'quote " and ] [', "back \\", 'both \\" }', "é\n\t end", "", "x" * 900, "{}" * 200]


@pytest.mark.parametrize("indent", [None, 2])
def test_json_arrays_are_split_like_lines(spark, tmp_path, small_splits, indent):
    events = [{"id": i, "text": HARD[i % len(HARD)], "data": {"k": [i, {"d": HARD[(i + 3) % len(HARD)]}], "n": None}} for i in range(120)]
    path = tmp_path / "a.json"
    path.write_text(json.dumps(events, indent=indent, ensure_ascii=False), encoding="utf-8")
    assert spark.read.text(str(path), lineSep="}").rdd.getNumPartitions() > 20
    found = readers.read_any_json(spark, [str(path)])
    assert sorted((r["id"], r["text"], r["data"]["k"][0] if isinstance(r["data"]["k"][0], int) else int(r["data"]["k"][0])) for r in found.collect()) == [(e["id"], e["text"], e["id"]) for e in events]


def test_json_layouts_and_broken_elements(spark, tmp_path, small_splits):
    files = {
        "one.json": json.dumps({"id": 1, "text": HARD[4], "more": {"a": 1}}, indent=1),
        "lines.json": "\n".join(json.dumps({"id": 10 + i, "text": HARD[i]}) for i in range(9)),
        "array.json": '\ufeff [ {"id": 20, "text": "x"} , {"id": 21, "text": }, 5, "word", {"id": 22, "text": "y"}\n]\n',
        "cut.json": '[{"id": 30, "text": "whole"}, {"id": 31',
        "empty.json": "",
        "none.json": " [ ] ",
    }
    for name, content in files.items():
        (tmp_path / name).write_text(content, encoding="utf-8")
    raw = readers.read_any_json(spark, [str(tmp_path / n) for n in files]).cache()
    assert sorted(r["id"] for r in raw.filter("_corrupt_record is null").collect()) == [1, *range(10, 19), 20, 22, 30]
    assert raw.filter("_corrupt_record is not null").count() == 3


def test_csv_values_with_line_breaks_are_split_like_lines(spark, tmp_path, small_splits):
    rng = random.Random(3)
    words = ["plain", "two\nlines", 'a "quoted" word', "x,y", "", "cr\r\nlf", 'tail"', "é " * 30, "\n\n"]
    rows = [[str(i), *(rng.choice(words) for _ in range(2))] for i in range(150)]
    path = tmp_path / "a.csv"
    with open(path, "w", newline="", encoding="utf-8") as file:
        csv.writer(file, lineterminator="\n").writerows([["id", "a", "b"], *rows])
    assert spark.read.text(str(path)).rdd.getNumPartitions() > 10
    found = readers.read_csv(spark, [str(path)])
    assert found.columns == ["id", "a", "b", "_corrupt_record", "source_file"]
    assert sorted(([r["id"], r["a"] or "", r["b"] or ""] for r in found.collect()), key=lambda r: int(r[0])) == rows
    assert found.filter("_corrupt_record is not null").count() == 0


def test_broken_csv_records_are_counted_and_short_ones_kept(spark, tmp_path):
    (tmp_path / "a.csv").write_text("id,a\n1,x\n2\n3,y,z\n4,it is 5\" wide\n", encoding="utf-8")
    (tmp_path / "b.csv").write_text('id,a\n5,"line\nbreak"\n6,p,q\n7\n8,"never\nclosed\n9,x\n', encoding="utf-8")
    raw = readers.read_csv(spark, [str(tmp_path / n) for n in ("a.csv", "b.csv")])
    assert readers.ingest_quality(raw).first().asDict() == {"good": 5, "broken": 3}
    good = {r["id"]: r["a"] for r in readers.without_broken(raw).collect()}
    assert good == {"1": "x", "2": None, "4": 'it is 5" wide', "5": "line\nbreak", "7": None}
    assert {r[0] for r in raw.filter("_corrupt_record is not null").select("_corrupt_record").collect()} == {"3,y,z", "6,p,q", '8,"never\nclosed\n9,x'}
    only = tmp_path / "c.csv"
    only.write_text("id,a\n1,2,3\n4,5,6\n", encoding="utf-8")
    with pytest.raises(ValueError):
        readers.read_raw(spark, [str(only)], "csv")


@pytest.mark.parametrize("seed", range(5))
def test_states_of_pieces_compose(seed):
    """Any cut of a text into pieces leaves the states that the whole text has."""
    from vigilog.sources.records import csv_piece

    rng = random.Random(seed)
    for _ in range(200):
        line = "".join(rng.choice('",ab') for _ in range(rng.randrange(0, 12)))
        for start in (0, 1):
            state, at_value = start, True
            i = 0
            while i < len(line):
                if state and line[i] == '"':
                    if line[i + 1 : i + 2] == '"':
                        i += 1
                    else:
                        state = 0
                elif not state and line[i] == '"' and at_value:
                    state = 1
                at_value = not state and line[i] == ","
                i += 1
            assert csv_piece(line)[start][0] == state, (line, start)


def test_batches_that_are_tried_again_count_once(spark, tmp_path, monkeypatch):
    path = str(tmp_path / "results")
    df = spark.createDataFrame([(1, 1, 0.9), (2, 1, 0.8), (3, 0, 0.1)], "EventID long, Anomaly int, AnomalyScoreNormalized double")
    assert results.read_results(spark, path, "s").count() == 0

    class Lost(Exception):
        pass

    def fails(*args, **kwargs):
        raise Lost

    with monkeypatch.context() as broken:
        broken.setattr(F, "current_timestamp", fails)  # after the rows are written, before the manifest is
        with pytest.raises(Lost):
            results.append_results(df, path, "s", "first")
    assert results.read_results(spark, path, "s").count() == 0
    assert results.append_results(df, path, "s", "first") == "first"
    results.append_results(df, path, "s", "first")
    assert results.read_results(spark, path, "s").count() == 2
    results.append_results(df, path, "s")
    results.append_results(df, path, "t", "first")
    assert results.read_results(spark, path, "s").count() == 4 and results.all_results(spark, path).count() == 6
    samples = str(tmp_path / "samples")
    for _ in range(2):
        results.append_samples(df, samples, "d", "text", batch="one")
    assert results.load_samples(spark, samples, "d").count() == 3
    with pytest.raises(ValueError):
        results.load_samples(spark, samples, "other")


def test_files_of_a_large_table_are_several_with_ends_and_few_splits(spark, tmp_path):
    from vigilog.plans import source_queries as s

    body = spark.range(1000).select(F.col("id").alias("event_id"), F.concat(F.lit('{"a": "'), F.repeat(F.lit("x"), 700), F.lit('"},')).alias("value"))
    path = str(tmp_path / "a")
    assert s.in_files(body, "event_id", path, "[", '{"a": ""}]', rows=400) == 3
    texts = [p.read_text().splitlines() for p in sorted((tmp_path / "a").glob("*/part-*"))]
    assert len(texts) == 3 and sum(map(len, texts)) == 1006
    assert {(t[0], t[-1]) for t in texts} == {("[", '{"a": ""}]')}
    largest = max(p.stat().st_size for p in (tmp_path / "a").glob("*/part-*"))
    assert largest // 16 == s.split_bytes(spark, path + "/*/") > s.SPLIT_BYTES


def test_line_numbers_of_a_table_in_several_files(spark, tmp_path, monkeypatch):
    from vigilog.plans import source_queries as s

    monkeypatch.setattr(s, "scratch", lambda spark, name: str(tmp_path / name))
    rows = spark.createDataFrame([("a\nb",), (None,), ("",), ("c",), ("d",)], "text string")
    rows.repartition(3).write.parquet(str(tmp_path / "documents.parquet"))
    spark.conf.set("spark.sql.files.openCostInBytes", str(1 << 30))
    try:
        row = s.line_numbers(spark, str(tmp_path)).first()
    finally:
        spark.conf.unset("spark.sql.files.openCostInBytes")
    assert tuple(row) == (5, 15)
    assert len(list((tmp_path / "lines").glob("part-*"))) > 1


def test_layouts_of_a_large_log_are_a_bounded_number_of_files(spark, tmp_path, monkeypatch):
    from vigilog.plans import source_queries as s

    names = ["row", "EventID", "Level", "TimeCreated", "Computer", "User", "IP", "Channel", "RawLog"]
    monkeypatch.setattr(s, "scratch", lambda spark, name: str(tmp_path / name))
    monkeypatch.setattr(s, "exported", lambda spark, sf_dir: spark.range(200_001).select(F.col("id").alias("row"), *[F.lit("1").alias(n) for n in names[1:]]))
    df = s.json_reader(spark, "")
    assert df.agg(F.count("row"), F.countDistinct("row")).first() == (200_001, 200_001)
    assert len(list((tmp_path / "json" / "ones.json").glob("row=*"))) <= 1000
    assert len(list((tmp_path / "json" / "arrays.json").glob("part=*"))) <= 101


def test_names_of_model_columns_store_no_rows(spark, sf_dir, monkeypatch):
    from vigilog.plans import fact_queries, scored

    def never(*_):
        raise AssertionError("the feature table is computed")

    monkeypatch.setattr(scored, "stored", never)
    monkeypatch.setattr(scored, "_tables", {})
    assert [r["feature"] for r in fact_queries.feature_names(spark, sf_dir).collect()] == fact_queries.MODEL_COLUMNS


def test_log_is_spread_by_its_rows(spark, sf_dir, monkeypatch):
    from vigilog import session
    from vigilog.sources.shared_tables import security_log

    monkeypatch.setattr(session, "SPREAD_ROWS", 100, raising=False)
    log = security_log(spark, sf_dir)
    assert log.rdd.getNumPartitions() >= 10
    assert log.count() == spark.read.parquet(f"{sf_dir}/events.parquet").count()
