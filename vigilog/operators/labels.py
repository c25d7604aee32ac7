"""Attack pattern and kill-chain stage of a row, from rule tables.

Every score is one expression per tactic or pattern over the row's own columns, and
the best one is the maximum of a small array, so a stage of any size of log is a
single projection after one broadcast join.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from vigilog.functions import risk
from vigilog.operators import knowledge
from vigilog.rules import events, mitre, patterns, stages

NUMBERS = [
    "IsNightTime", "EventsPerMinute", "FailedLoginRatio", "UniqueIPCount", "LogLength", "LogEntropy", "LevelSeverity",
    "EventIDRarity", *events.EVENT_FLAGS, *events.TEXT_FLAGS,
]
TEXTS = ["RawLog", "ProcessName", "ObjectName", "CommandLine", "TargetImage", "Channel"]


def completed(df: DataFrame) -> tuple[DataFrame, list[str]]:
    """All columns that the rules read; also the names of those that were added."""
    added = {c: F.lit(0) for c in NUMBERS if c not in df.columns}
    added |= {c: F.lit(None).cast("string") for c in TEXTS if c not in df.columns}
    if "EventData" not in df.columns:
        added["EventData"] = F.lit(None).cast("map<string,string>")
    return df.withColumns(added), list(added)


def total(terms: list[Column]) -> Column:
    return reduce(lambda a, b: a + b, terms, F.lit(0))


def points_of(tactic: str) -> Column:
    """Points of the rule table for one tactic."""
    return total([F.when(F.expr(row.condition), row.points).otherwise(0) for row in stages.POINTS if row.tactic == tactic])


def handle_points(tactic: str) -> Column:
    """Points of a requested handle, by the words of the object."""
    choice = F
    for row in stages.HANDLE_POINTS:
        found = [F.col(t).contains(w) for w in row.words for t in ("raw", "object")]
        met = reduce(lambda a, b: a | b, found) if found else F.lit(True)
        choice = choice.when(met, row.points.get(tactic, 0))
    return F.when(F.col("EventID") == 4656, choice.otherwise(0)).otherwise(0)


def initial_access_points() -> Column:
    """Points for Initial Access after the reductions.

    Signs of execution and of work inside the network take them all away; signs of
    installation take 5. Failed and late database logins count in any case.
    """
    running = [row.condition for row in stages.POINTS if row.tactic == "Execution" and "contains(" in row.condition]
    inside = F.coalesce(F.col("EventID").isin(stages.POST_COMPROMISE), F.lit(False))
    none = reduce(lambda a, b: a | b, [F.coalesce(F.expr(c), F.lit(False)) for c in running], inside)
    reduced = F.when(F.expr(stages.NOT_FIRST_STEP), 5).otherwise(0)
    late = total([F.when(F.col("EventID") == i, p).otherwise(0) for i, p in stages.LATE_INITIAL_ACCESS.items()])
    return F.when(none, 0).otherwise(F.greatest(F.lit(0), points_of("Initial Access") - reduced)) + late


def best_tactic() -> Column:
    """The tactic with most points; the earlier one in the kill chain wins a tie."""
    entries = []
    for order, (tactic, stage) in enumerate(mitre.STAGE_OF_TACTIC.items()):
        points = initial_access_points() if tactic == "Initial Access" else points_of(tactic) + handle_points(tactic)
        entries.append(F.struct(points.alias("points"), F.lit(-order).alias("order"), F.lit(stage).alias("stage")))
    return F.array_max(F.array(*entries))["stage"]


def text_or_empty(column: Column) -> Column:
    return F.coalesce(F.nullif(F.trim(column), F.lit("nan")), F.lit(""))


def runs_program() -> Column:
    """A process was created, or the row holds a command line or a real process name."""
    data = F.col("EventData")

    def from_data(name: str) -> Column:
        return F.nullif(text_or_empty(F.try_element_at(data, F.lit(name))), F.lit(""))

    command = F.coalesce(F.nullif(text_or_empty(F.col("CommandLine")), F.lit("")), from_data("CommandLine"), F.lit(""))
    process = F.coalesce(
        F.nullif(text_or_empty(F.col("ProcessName")), F.lit("")), from_data("ProcessName"), from_data("NewProcessName"), F.lit("")
    )
    real = (process != "") & ~F.lower(process).isin(stages.PLACEHOLDER_PROCESSES)
    return F.coalesce(F.col("EventID").isin(4688, 1), F.lit(False)) | (command != "") | real


def with_stage(df: DataFrame, catalog: DataFrame | None = None) -> DataFrame:
    """Column ``MITRE_Stage``: a run program is Execution; else the stage of the known
    event when its risk is 6 or more or its stage is another than Execution; else the
    tactic with most points."""
    rows, added = completed(df)
    rows = knowledge.with_intelligence(rows, catalog).withColumns(
        {"raw": F.lower("RawLog"), "process": F.lower("ProcessName"), "object": F.lower("ObjectName")}
    )
    # The points read the three texts often, so the texts are columns of their own.
    context = risk.Context([c for c in df.columns if c != "IsExternalIP"])
    score = risk.context_score(F.col("info.risk_score"), context)
    known = knowledge.stage_of(knowledge.primary_tactic(F.col("info")))
    trusted = F.col("EventID").isNotNull() & ((score >= 6) | (known != mitre.DEFAULT_STAGE))
    stage = F.when(runs_program(), mitre.DEFAULT_STAGE).when(trusted, known).otherwise(best_tactic())
    return rows.withColumn("MITRE_Stage", stage).drop("info", "raw", "process", "object", *added)


def stage_override(df: DataFrame) -> DataFrame:
    """Stages fixed by event ID, and Execution for command lines of other than logon events."""
    stage = F.col("MITRE_Stage") if "MITRE_Stage" in df.columns else F.lit(None).cast("string")
    for label, ids in stages.STAGE_OVERRIDES.items():
        stage = F.when(F.col("EventID").isin(ids), label).otherwise(stage)
    if "CommandLine" in df.columns:
        logon = F.coalesce(F.col("EventID").isin(stages.LOGON_EVENTS), F.lit(False))
        command = F.coalesce(F.col("CommandLine"), F.lit("")) != ""
        stage = F.when(command & ~logon, "Stage 2: Execution").otherwise(stage)
    return df.withColumn("MITRE_Stage", stage)


def known_pattern(score: Column) -> Column:
    """Pattern of a known event of risk 8 and more as a struct, null for all others."""
    result = F.lit(None).cast("struct<id: int, label: string>")
    unnamed = F.concat(F.lit("Unknown Event "), F.col("EventID").cast("string"))
    for numbers, pattern, label in reversed(patterns.KNOWN_EVENTS):
        met = F.col("EventID").isin(*numbers)
        if numbers == (10,):
            met = met & F.lower("TargetImage").contains(patterns.LSASS)
        before, found, after = label.partition("%s")
        named = F.concat(F.lit(before), F.coalesce(F.col("info.name"), unnamed), F.lit(after)) if found else F.lit(label)
        result = F.when(met, F.struct(F.lit(pattern).alias("id"), named.alias("label"))).otherwise(result)
    return F.when(score >= 8, result)


def scored_pattern() -> Column:
    """The pattern with the highest score; the first one wins a tie."""
    entries = []
    for pattern in patterns.PATTERNS:
        more = [F.when(F.expr(condition), points).otherwise(0) for points, condition in pattern.additions]
        entry = F.struct(
            (F.lit(pattern.score) + total(more)).alias("score"), F.lit(-pattern.number).alias("order"),
            F.lit(pattern.number).alias("id"), F.lit(pattern.label).alias("label"),
        )
        entries.append(F.when(F.expr(pattern.condition), entry))
    best = F.array_max(F.array(*entries))
    return F.when(best.isNotNull(), F.struct(best["id"].alias("id"), best["label"].alias("label")))


def with_attack_pattern(df: DataFrame, catalog: DataFrame | None = None) -> DataFrame:
    """Columns ``Cluster`` and ``ClusterLabel``: the attack pattern of each row."""
    rows, added = completed(df)
    rows = knowledge.with_intelligence(rows, catalog)
    context = risk.Context([c for c in df.columns if c != "IsExternalIP"])
    score = risk.context_score(F.col("info.risk_score"), context)
    number, label = patterns.UNCLASSIFIED
    none = F.struct(F.lit(number).alias("id"), F.lit(label).alias("label"))
    best = F.coalesce(known_pattern(score), scored_pattern(), none)
    rows = rows.withColumn("_pattern", best).withColumns(
        {"Cluster": F.col("_pattern.id"), "ClusterLabel": F.col("_pattern.label")}
    )
    return rows.drop("_pattern", "info", *added)
