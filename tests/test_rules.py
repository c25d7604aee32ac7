"""Catalogue facts and single rows for the rule tables."""

import pytest
from pyspark.sql import functions as F

from vigilog.operators import knowledge, labels, reports
from vigilog.rules import catalog, mitre, patterns, stages


def test_catalogue(spark):
    events = {r["event_id"]: r for r in knowledge.event_catalog(spark).collect()}
    assert len(events) == 121
    assert {s: len(t) for s, t in catalog.SOURCES.items()} == {"Security": 53, "Sysmon": 29, "System": 15, "SQL": 24}
    assert (events[4624]["source"], events[4624]["name"]) == ("Security", "Successful Logon")
    assert (events[1]["source"], events[1]["name"]) == ("Sysmon", "Process Creation")
    assert (events[7045]["source"], events[7045]["name"]) == ("System", "Service Installed")
    assert events[4701]["risk_score"] == 5
    known = {r["technique_id"] for r in knowledge.techniques(spark).collect()}
    used = {t for r in events.values() for t in r["mitre_techniques"]}
    assert used - known == {"T1557.001"}


def test_tables_as_parameters(spark, tmp_path):
    events = knowledge.event_catalog(spark)
    events.write.parquet(str(tmp_path / "c"))
    assert knowledge.event_catalog(spark, str(tmp_path / "c")).count() == 121
    (tmp_path / "t.csv").write_text("tactic,technique_id,name\nImpact,T1486,Data Encrypted for Impact\n")
    assert knowledge.techniques(spark, str(tmp_path / "t.csv")).first()["technique_id"] == "T1486"


def stage(spark, **columns):
    types = {"RawLog": "string", "Channel": "string", "CommandLine": "string", "ProcessName": "string", "ObjectName": "string", "EventData": "map<string,string>", "FailedLoginRatio": "double"}
    schema = ", ".join(f"{k} {types.get(k, 'long')}" for k in columns)
    df = spark.createDataFrame([tuple(columns.values())], schema)
    return labels.with_stage(df).first()["MITRE_Stage"]


@pytest.mark.parametrize("columns,expected", [
    ({"EventID": 4688, "Channel": "Security"}, "Stage 2: Execution"),
    ({"EventID": 4625, "CommandLine": "whoami"}, "Stage 2: Execution"),
    ({"EventID": 4625, "ProcessName": "System"}, "Stage 1: Initial Access"),
    ({"EventID": 4625, "EventData": {"NewProcessName": "x.exe"}}, "Stage 2: Execution"),
    ({"EventID": 1102, "Channel": "Security"}, "Stage 3: Defense Evasion"),
    ({"EventID": 10, "Channel": "Microsoft-Windows-Sysmon/Operational"}, "Stage 2: Credential Access"),
    # Not in the catalogue, or routed to a table without the event: points decide.
    ({"EventID": 4798, "Channel": "Security"}, "Stage 4: Discovery"),
    ({"EventID": 4625, "Channel": "System", "IsFailedLogin": 1}, "Stage 1: Initial Access"),
    ({"EventID": 4625, "Channel": "System", "IsFailedLogin": 1, "RawLog": "via conhost"}, "Stage 2: Execution"),
    ({"EventID": 18456, "Channel": "Security"}, "Stage 2: Credential Access"),
    ({"EventID": 4656, "Channel": "System", "ObjectName": "C:/lsass"}, "Stage 2: Credential Access"),
    ({"EventID": 4656, "Channel": "System", "ObjectName": "my certificate"}, "Stage 3: Defense Evasion"),
    ({"EventID": 4656, "Channel": "System", "ObjectName": "Registry key"}, "Stage 3: Defense Evasion"),
    ({"EventID": 4656, "Channel": "System", "ObjectName": "report.doc"}, "Stage 5: Collection"),
    ({"EventID": 3, "Channel": "Security", "IsNetworkConnection": 1}, "Stage 4: Lateral Movement"),
    ({"EventID": 999999, "Channel": "Security", "LogLength": 1500}, "Stage 6: Exfiltration"),
    ({"EventID": 999999, "Channel": "Security"}, "Stage 1: Initial Access"),
])
def test_stage(spark, columns, expected):
    assert stage(spark, **columns) == expected


def pattern(spark, **columns):
    types = {"Channel": "string", "TargetImage": "string", "FailedLoginRatio": "double", "EventIDRarity": "double", "LogEntropy": "double"}
    df = spark.createDataFrame([tuple(columns.values())], ", ".join(f"{k} {types.get(k, 'long')}" for k in columns))
    row = labels.with_attack_pattern(df).first()
    return row["Cluster"], row["ClusterLabel"]


@pytest.mark.parametrize("columns,expected", [
    ({"EventID": 104, "Channel": "System"}, (6, "Defense Evasion (Log Cleared)")),
    ({"EventID": 10, "Channel": "Sysmon", "TargetImage": "C:/LSASS.exe"}, (8, "Credential Theft (Process Access)")),
    ({"EventID": 10, "Channel": "Sysmon"}, (0, "Unclassified Anomaly")),
    ({"EventID": 21, "Channel": "Sysmon"}, (7, "Persistence (WMI)")),
    ({"EventID": 5, "FailedLoginRatio": 0.3}, (0, "Unclassified Anomaly")),
    ({"EventID": 5, "FailedLoginRatio": 0.31}, (1, "Brute Force Attack")),
    ({"EventID": 5, "LogHasPowerShell": 1, "FailedLoginRatio": 0.9}, (1, "Brute Force Attack")),
    ({"EventID": 5, "LogHasPowerShell": 1, "LogHasBase64": 1, "FailedLoginRatio": 0.9}, (2, "PowerShell Exploit")),
    ({"EventID": 5, "UniqueIPCount": 3, "EventsPerMinute": 9}, (10, "Network Reconnaissance")),
    ({"EventID": 5, "UniqueIPCount": 4, "EventsPerMinute": 9}, (4, "Lateral Movement")),
    ({"EventID": 5, "EventIDRarity": 0.81}, (12, "Rare Event (Anomalous)")),
])
def test_attack_pattern(spark, columns, expected):
    assert pattern(spark, **columns) == expected


def test_risk_of_failed_logon(spark):
    df = spark.createDataFrame([(4625, "Security", 1, 15, 0.7, 1)], "EventID long, Channel string, IsNightTime int, EventsPerMinute long, FailedLoginRatio double, LogHasSuspicious int")
    row = knowledge.enrich(df).first()
    assert (row["EventID_RiskScore"], row["EventID_IsSuspicious"], row["EventID_PrimaryTactic"]) == (10, 1, "Initial Access")


def test_enrichment_of_five_rows(spark):
    data = [(4624, "Security"), (4625, "Security"), (4688, "Security"), (1, "Sysmon"), (7045, "System"), (None, None), (4624, "System")]
    rows = knowledge.enrich(spark.createDataFrame(data, "EventID long, Channel string")).collect()
    assert [r["EventID_RiskScore"] for r in rows] == [2, 7, 4, 5, 9, 5, 5]
    assert [r["EventID_Name"] for r in rows][-2:] == ["Unknown", "Unknown Event 4624"]


@pytest.mark.parametrize("score,band", [(0.81, "Critical"), (0.8, "High"), (0.6, "Medium"), (0.31, "Medium"), (0.3, "Low")])
def test_score_band(spark, score, band):
    assert spark.range(1).select(reports.score_band(F.lit(score))).first()[0] == band


def test_rows_of_the_rule_tables_by_hand():
    """Values written out here once more, so that a changed entry of a table is seen."""
    assert [t.name for t in mitre.TACTICS] == [
        "Initial Access", "Execution", "Persistence", "Privilege Escalation", "Defense Evasion", "Credential Access",
        "Discovery", "Lateral Movement", "Collection", "Command and Control", "Exfiltration", "Impact",
    ]
    total = {t.name: sum(p.points for p in stages.POINTS if p.tactic == t.name) for t in mitre.TACTICS}
    assert total == {
        "Initial Access": 14, "Execution": 98, "Persistence": 162, "Privilege Escalation": 85, "Defense Evasion": 52, "Credential Access": 69,
        "Discovery": 20, "Lateral Movement": 29, "Collection": 11, "Command and Control": 11, "Exfiltration": 20, "Impact": 13,
    }
    assert [(p.number, p.score, sum(points for points, _ in p.additions)) for p in patterns.PATTERNS] == [
        (1, 10, 8), (2, 10, 13), (3, 8, 10), (4, 8, 12), (5, 10, 10), (6, 15, 5), (7, 9, 7), (8, 8, 9), (9, 10, 8), (10, 8, 5), (11, 12, 3), (12, 7, 3), (13, 9, 4),
    ]
    assert {e.event_id: e.tactics for e in catalog.SECURITY if e.risk >= 9} == {
        1102: ("Defense Evasion",), 4697: ("Persistence", "Lateral Movement"), 4719: ("Defense Evasion",), 4794: ("Privilege Escalation", "Persistence"),
    }
    assert catalog.KEY_FIELDS[22] == ("QueryName", "QueryResults", "Image") and catalog.STATES[18456]["8"] == "Wrong password"
