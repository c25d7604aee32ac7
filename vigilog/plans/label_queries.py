"""Queries C2-C7: grouping and labelling of anomalies."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from vigilog.operators import features, labels
from vigilog.plans.oracle import case, inside, text, using
from vigilog.plans.registry import query
from vigilog.rules import mitre, patterns, stages
from vigilog.sources.shared_tables import pick, security_log


def mixed_log(spark, sf_dir) -> DataFrame:
    """The log with other channels and program columns, so that many events miss the catalogue."""
    number = F.col("record_id")
    log = security_log(spark, sf_dir)
    return log.withColumns(
        {
            "Channel": F.when(number % 2 == 0, "Windows PowerShell").otherwise(F.col("Channel")),
            "CommandLine": F.when(number % 10 == 0, "whoami"),
            "ProcessName": F.when(number % 10 == 1, "wscript.exe").when(number % 10 == 2, "System"),
            "ObjectName": pick(["lsass", "Certificate store", "registry", "file", None], number % 5),
            "TargetImage": F.when(number % 3 == 0, "C:\\Windows\\lsass.exe"),
        }
    )


def pattern_sql() -> str:
    entries = []
    for number, label, condition, base, additions in patterns.PATTERNS:
        more = "".join(f" + CASE WHEN {c} THEN {p} ELSE 0 END" for p, c in additions)
        entries.append(
            f"CASE WHEN {condition} THEN {{'score': {base}{more}, 'rank': -{number}, 'id': {number}, 'label': {text(label)}}} END"
        )
    best = f"list_sort(list_filter([{', '.join(entries)}], lambda e: e IS NOT NULL), 'DESC')[1]"
    known = "CASE WHEN EventID_RiskScore < 8 THEN NULL "
    for ids, number, label in patterns.KNOWN_EVENTS:
        extra = " AND contains(lower(TargetImage), 'lsass')" if ids == (10,) else ""
        known += f"WHEN EventID IN {inside(ids)}{extra} THEN {{'id': {number}, 'label': replace({text(label)}, '%s', EventID_Name)}} "
    known += "END"
    return f"""
      SELECT record_id, CAST(coalesce(known.id, best.id, 0) AS INTEGER) AS Cluster,
             coalesce(known.label, best.label, 'Unclassified Anomaly') AS ClusterLabel
      FROM (SELECT record_id, {known} AS known, {best} AS best FROM mixed)"""


def stage_sql() -> str:
    rows = stages.POINTS

    def points(tactic: str) -> str:
        return "0" + "".join(f" + CASE WHEN {c} THEN {p} ELSE 0 END" for t, p, c in rows if t == tactic)

    def handle(tactic: str) -> str:
        arms = ""
        for words, rewards in stages.HANDLE_POINTS:
            reward = rewards.get(tactic, 0)
            found = " OR ".join(f"coalesce(contains({t}, {text(w)}), false)" for w in words for t in ("raw", "object"))
            arms += f" WHEN {found or 'true'} THEN {reward}"
        return f"CASE WHEN EventID = 4656 THEN CASE{arms} END ELSE 0 END"

    running = " OR ".join(f"coalesce({c}, false)" for t, _, c in rows if t == "Execution" and "contains(" in c)
    entries = []
    for order, (tactic, stage) in enumerate(mitre.STAGE_OF_TACTIC.items()):
        score = f"{points(tactic)} + {handle(tactic)}"
        if tactic == "Initial Access":
            score = (
                f"CASE WHEN EventID IN {inside(stages.POST_COMPROMISE)} OR {running} THEN 0 "
                f"ELSE greatest(0, {points(tactic)} - CASE WHEN {stages.NOT_FIRST_STEP} THEN 5 ELSE 0 END) END "
                f"+ CASE EventID WHEN 18456 THEN 4 WHEN 18452 THEN 3 ELSE 0 END"
            )
        entries.append(f"{{'points': {score}, 'rank': -{order}, 'stage': {text(stage)}}}")
    known = case("EventID_PrimaryTactic", mitre.STAGE_OF_TACTIC, text(mitre.DEFAULT_STAGE))
    return f"""
      SELECT record_id, CASE
          WHEN EventID IN (4688, 1) OR CommandLine <> '' THEN 'Stage 2: Execution'
          WHEN ProcessName <> '' AND lower(ProcessName) NOT IN {inside(stages.PLACEHOLDER_PROCESSES)} THEN 'Stage 2: Execution'
          WHEN EventID_RiskScore >= 6 OR {known} <> 'Stage 2: Execution' THEN {known}
          ELSE list_sort([{', '.join(entries)}], 'DESC')[1].stage END AS MITRE_Stage
      FROM (SELECT *, lower(RawLog) AS raw, lower(ProcessName) AS process, lower(ObjectName) AS object FROM mixed)"""


@query("C5_attack_pattern", using("mixed", pattern_sql()))
def attack_pattern(spark, sf_dir) -> DataFrame:
    df = labels.with_attack_pattern(features.extract_features(mixed_log(spark, sf_dir)))
    return df.select("record_id", "Cluster", "ClusterLabel")


@query("C6_mitre_stage", using("mixed", stage_sql()))
def mitre_stage(spark, sf_dir) -> DataFrame:
    df = labels.with_stage(features.extract_features(mixed_log(spark, sf_dir)))
    return df.select("record_id", "MITRE_Stage")


OVERRIDE = "CASE WHEN CommandLine <> '' AND EventID NOT IN (4624, 4625, 4648) THEN 'Stage 2: Execution' " + " ".join(
    f"WHEN EventID IN {inside(ids)} THEN {text(label)}" for label, ids in stages.STAGE_OVERRIDES.items()
) + " ELSE 'none' END"


@query("C7_stage_override", using("mixed_log", f"SELECT record_id, {OVERRIDE} AS MITRE_Stage FROM mixed_log"))
def stage_override(spark, sf_dir) -> DataFrame:
    df = mixed_log(spark, sf_dir).withColumn("MITRE_Stage", F.lit("none"))
    return labels.stage_override(df).select("record_id", "MITRE_Stage")
