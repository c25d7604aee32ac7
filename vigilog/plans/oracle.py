"""SQL building blocks: the security log and its features as common table expressions.

The SQL states each definition in the most direct way (global windows, plain
joins), independently of how the Spark operators compute it.
"""

from __future__ import annotations

from vigilog.operators.knowledge import catalog_rows
from vigilog.rules import events, mitre
from vigilog.sources import shared_tables as shared


def text(value) -> str:
    return "NULL" if value is None else "'" + str(value).replace("'", "''") + "'"


def items(values) -> str:
    return "[" + ", ".join(text(v) if isinstance(v, str) else str(v) for v in values) + "]"


def inside(values) -> str:
    return "(" + ", ".join(text(v) if isinstance(v, str) else str(v) for v in values) + ")"


def case(subject: str, table: dict, default: str = "NULL") -> str:
    def literal(v):
        return text(v) if isinstance(v, str) else str(v)

    arms = " ".join(f"WHEN {literal(k)} THEN {literal(v)}" for k, v in table.items())
    return f"CASE {subject} {arms} ELSE {default} END"


SECLOG = f"""
SELECT record_id, EpochSeconds, EventID, Level, Computer, "User", IP, ExecutionProcessID, RawLog, value,
       CASE WHEN EventID = 999999 THEN NULL
            {" ".join(f"WHEN EventID IN {inside(ids)} THEN {text(name)}" for name, ids in shared.CHANNELS.items())}
            ELSE 'Security' END AS Channel,
       make_timestamp(EpochSeconds * 1000000) AS event_ts,
       strftime(make_timestamp(EpochSeconds * 1000000), '%Y-%m-%dT%H:%M:%S+00:00') AS TimeCreatedISO,
       CAST(hour(make_timestamp(EpochSeconds * 1000000)) AS INTEGER) AS Hour,
       CAST(isodow(make_timestamp(EpochSeconds * 1000000)) - 1 AS INTEGER) AS Weekday,
       CAST(isodow(make_timestamp(EpochSeconds * 1000000)) >= 6 AS INTEGER) AS IsWeekend
FROM (
  SELECT event_id AS record_id,
         CAST(floor((floor(epoch(ts)) - {shared.ORIGIN}) / {float(shared.SQUEEZE)}) AS BIGINT) + {shared.ORIGIN} AS EpochSeconds,
         CAST({items(shared.EVENT_IDS)}[1 + (event_id * 7 + user_id) % 24] AS BIGINT) AS EventID,
         1 + event_id % 5 AS Level,
         'HOST-' || CAST(user_id % 12 AS VARCHAR) AS Computer,
         'user' || CAST(user_id AS VARCHAR) AS "User",
         '10.0.' || CAST(user_id % 4 AS VARCHAR) || '.' || CAST((event_id * 13) % 50 AS VARCHAR) AS IP,
         CASE WHEN event_id % 9 <> 0 THEN 400 + (event_id * 11) % 37 END AS ExecutionProcessID,
         {items(shared.PHRASES)}[1 + (event_id * 3 + user_id) % 8] AS RawLog,
         value
  FROM events)
"""

CATALOG = (
    "SELECT * FROM (VALUES "
    + ", ".join(
        f"({text(s)}, {i}, {text(n)}, {text(c)}, {r}, {text(v)}, {items(ta)}::VARCHAR[], {items(te)}::VARCHAR[], {items(cu)}::VARCHAR[], {items(k)}::VARCHAR[], {len(st)})"
        for s, i, n, c, r, v, ta, te, cu, k, st in catalog_rows()
    )
    + ") t(source, event_id, name, category, risk_score, severity, mitre_tactics, mitre_techniques, suspicious_when, key_fields, known_states)"
)

TACTICS = (
    "SELECT * FROM (VALUES "
    + ", ".join(f"({i}, {text(n)}, {text(s)}, {text(d)})" for i, (n, s, d) in enumerate(mitre.TACTICS))
    + ") t(ordinal, tactic, stage, description)"
)

TECHNIQUES = (
    "SELECT * FROM (VALUES "
    + ", ".join(f"({text(c)}, {text(i)}, {text(n)})" for i, n, names in mitre.TECHNIQUES for c in names)
    + ") t(tactic, technique_id, name)"
)


def entropy(column: str) -> str:
    counts = f"map_values(list_histogram(string_split({column}, '')))"
    return (
        f"CASE WHEN coalesce({column}, '') = '' THEN 0.0 ELSE log2(length({column})) - "
        f"list_sum(list_transform({counts}, lambda c: c * log2(c))) / length({column}) END"
    )


def word_count(column: str) -> str:
    from vigilog.functions.text import BLANK

    return f"len(regexp_extract_all(coalesce({column}, ''), '[^{BLANK}]+'))"


def text_flag(column: str, flag: str) -> str:
    words = [w.replace(".", "[.]") for w in events.TEXT_FLAGS[flag]]
    pattern = "|".join(words + [p for f, p in events.TEXT_PATTERNS.items() if f == flag])
    return f"CAST(regexp_matches(coalesce({column}, ''), {text('(?i)' + pattern)}) AS INTEGER)"


def window(seconds: int) -> str:
    return f"OVER (ORDER BY EpochSeconds RANGE BETWEEN {seconds} PRECEDING AND CURRENT ROW)"


FEATS = f"""
SELECT *,
       CAST(Hour < 6 OR Hour > 22 AS INTEGER) AS IsNightTime,
       CAST(Hour BETWEEN 9 AND 17 AS INTEGER) AS IsBusinessHours,
       greatest(0, least(3600, coalesce(EpochSeconds - lag(EpochSeconds) OVER (ORDER BY EpochSeconds, record_id), 0))) AS TimeSincePrevEvent,
       count(*) OVER (PARTITION BY EventID) AS EventIDFrequency,
       1.0 / (count(*) OVER (PARTITION BY EventID) + 1) AS EventIDRarity,
       {case("Level", events.LEVEL_SEVERITY, "0")} AS LevelSeverity,
       count(*) OVER (PARTITION BY Computer) AS ComputerEventCount,
       CASE WHEN Channel IS NULL THEN 0 ELSE count(*) OVER (PARTITION BY Channel) END AS ChannelEventCount,
       count(*) OVER (PARTITION BY "User") AS UserEventCount,
       count(*) {window(60)} AS EventsPerMinute,
       count(DISTINCT EventID) {window(300)} AS UniqueEventIDsInWindow,
       {", ".join(f"CAST(EventID IN {inside(ids)} AS INTEGER) AS {name}" for name, ids in events.EVENT_FLAGS.items())},
       coalesce(sum(CAST(EventID = 4625 AS DOUBLE)) {window(300)}
                / nullif(sum(CAST(EventID IN (4624, 4625) AS DOUBLE)) {window(300)}, 0), 0) AS FailedLoginRatio,
       CAST(ExecutionProcessID IS NOT NULL AS INTEGER) AS HasProcessID,
       count(DISTINCT ExecutionProcessID) {window(300)} AS UniqueProcessCount,
       count(*) OVER (PARTITION BY IP) AS IPFrequency,
       count(DISTINCT IP) {window(300)} AS UniqueIPCount,
       length(RawLog) AS LogLength,
       {word_count("RawLog")} AS LogWordCount,
       {", ".join(f"{text_flag('RawLog', name)} AS {name}" for name in events.TEXT_FLAGS)},
       {entropy("RawLog")} AS LogEntropy,
       coalesce(stddev_samp(EventID) OVER (PARTITION BY Computer), 0) AS EventIDStdPerComputer
FROM seclog
"""

# The channel routing as a join condition between a log row r and a catalogue row c.
ROUTE = """
CASE WHEN lower(r.Channel) LIKE '%sysmon%' OR lower(r.Channel) LIKE '%operational%' THEN 'Sysmon'
     WHEN lower(r.Channel) LIKE '%security%' THEN 'Security'
     WHEN lower(r.Channel) LIKE '%system%' OR lower(r.Channel) LIKE '%task%' OR lower(r.Channel) LIKE '%powershell%' THEN 'System'
END
"""
MATCH = f"r.EventID = c.event_id AND coalesce({ROUTE} = c.source, true)"

RISK = """
least(10, coalesce(c.risk_score, 5) + IsNightTime + CAST(EventsPerMinute > 10 AS INTEGER)
      + 2 * CAST(FailedLoginRatio > 0.5 AS INTEGER) + 2 * LogHasSuspicious)
"""

HITS = """
list_concat(
  list_filter(coalesce(c.suspicious_when, []), lambda s: IsNightTime > 0 AND contains(lower(s), 'night')),
  list_filter(coalesce(c.suspicious_when, []), lambda s: IsFailedLogin > 0 AND contains(lower(s), 'fail')),
  list_filter(coalesce(c.suspicious_when, []), lambda s: LogHasPowerShell > 0 AND contains(lower(s), 'powershell')),
  list_filter(coalesce(c.suspicious_when, []), lambda s: EventIDRarity > 0.8 AND contains(lower(s), 'unusual')))
"""

ENRICHED = f"""
SELECT r.*,
       CAST({RISK} AS INTEGER) AS EventID_RiskScore,
       coalesce(c.category, 'Unknown') AS EventID_Category,
       coalesce(c.name, 'Unknown Event ' || CAST(EventID AS VARCHAR)) AS EventID_Name,
       coalesce(c.severity, 'Unknown') AS EventID_Severity,
       coalesce(c.mitre_tactics[1], 'Execution') AS EventID_PrimaryTactic,
       CAST({RISK} >= 7 OR len({HITS}) > 0 AS INTEGER) AS EventID_IsSuspicious
FROM feats r LEFT JOIN catalog c ON {MATCH}
"""

STAGES = {name: stage for name, stage in mitre.STAGE_OF_TACTIC.items()}
STAGE = case("EventID_PrimaryTactic", STAGES, text(mitre.DEFAULT_STAGE))

# Verdicts from a given score: cut at the 90th percentile, min-max scaling, confidence.
VERDICTS = f"""
SELECT *,
       CASE WHEN Anomaly = 1 THEN CASE WHEN AnomalyScoreNormalized > 0.8 THEN 3 WHEN AnomalyScoreNormalized > 0.6 THEN 2 ELSE 1 END
            ELSE CASE WHEN AnomalyScoreNormalized < 0.2 THEN 3 WHEN AnomalyScoreNormalized < 0.4 THEN 2 ELSE 1 END END AS Confidence,
       CASE WHEN Anomaly = 1 THEN EventID_Category END AS ClusterLabel,
       CASE WHEN Anomaly = 1 THEN {STAGE} END AS MITRE_Stage
FROM (
  SELECT *, sqrt(value) AS AnomalyScore,
         CAST(sqrt(value) > quantile_cont(sqrt(value), 0.9) OVER () AS INTEGER) AS Anomaly,
         (sqrt(value) - min(sqrt(value)) OVER ()) / (max(sqrt(value)) OVER () - min(sqrt(value)) OVER ()) AS AnomalyScoreNormalized
  FROM enriched)
"""

# The log with other channels and program columns, so that many events miss the catalogue.
MIXED_LOG = """
SELECT * REPLACE (CASE WHEN record_id % 2 = 0 THEN 'Windows PowerShell' ELSE Channel END AS Channel),
       CASE WHEN record_id % 10 = 0 THEN 'whoami' END AS CommandLine,
       CASE record_id % 10 WHEN 1 THEN 'wscript.exe' WHEN 2 THEN 'System' END AS ProcessName,
       ['lsass', 'Certificate store', 'registry', 'file', NULL][1 + record_id % 5] AS ObjectName,
       CASE WHEN record_id % 3 = 0 THEN 'C:\\Windows\\lsass.exe' END AS TargetImage
FROM seclog
"""


def over(table: str, old: str, new: str) -> str:
    return table.replace(f"FROM {old}", f"FROM {new}")


TABLES = {
    "mixed_log": (MIXED_LOG, ["seclog"]),
    "mixed_feats": (over(FEATS, "seclog", "mixed_log"), ["mixed_log"]),
    "mixed": (over(ENRICHED, "feats", "mixed_feats"), ["mixed_feats", "catalog"]),
    "seclog": (SECLOG, []),
    "catalog": (CATALOG, []),
    "tactics": (TACTICS, []),
    "techniques": (TECHNIQUES, []),
    "feats": (FEATS, ["seclog"]),
    "enriched": (ENRICHED, ["feats", "catalog"]),
    "verdicts": (VERDICTS, ["enriched"]),
}


def using(tables: str, select: str) -> str:
    """``select`` with the named building blocks as common table expressions."""
    order: list[str] = []

    def add(name: str) -> None:
        for needed in TABLES[name][1]:
            add(needed)
        if name not in order:
            order.append(name)

    for name in tables.split():
        add(name)
    return "WITH " + ", ".join(f"{n} AS MATERIALIZED ({TABLES[n][0]})" for n in order) + " " + select
