"""Points that a row's own traits give to each ATT&CK tactic.

Conditions are SQL over the feature columns and three lower-case texts: ``raw``
(raw log), ``process`` (process name) and ``object`` (object name).
All tables in this module are fixed values.
"""

from __future__ import annotations

from typing import NamedTuple

# Process names that do not show that a program was run.
PLACEHOLDER_PROCESSES = ["system", "registry", "idle", "-", "none"]


class Points(NamedTuple):
    tactic: str
    points: int
    condition: str


class Handle(NamedTuple):
    words: tuple[str, ...]
    points: dict[str, int]


POINTS = [
    Points("Initial Access", 5, "IsFailedLogin > 0"),
    Points("Initial Access", 3, "FailedLoginRatio > 0.2"),
    Points("Initial Access", 4, "EventID in (4625, 4648)"),
    Points("Initial Access", 2, "IsNightTime > 0 and IsFailedLogin > 0"),
    Points("Execution", 8, "IsProcessCreation > 0"),
    Points("Execution", 5, "LogHasSuspicious > 0"),
    Points("Execution", 7, "LogHasPowerShell > 0"),
    Points("Execution", 5, "LogHasCmd > 0"),
    Points("Execution", 6, "LogHasScript > 0"),
    Points("Execution", 10, "contains(raw, 'cscript') or contains(raw, 'wscript') or contains(process, 'cscript') or contains(process, 'wscript')"),
    Points("Execution", 8, "contains(raw, 'conhost') or contains(process, 'conhost')"),
    Points("Execution", 9, "contains(raw, 'powershell') or contains(raw, 'pwsh') or contains(process, 'powershell')"),
    Points("Execution", 8, "contains(raw, 'cmd.exe') or contains(process, 'cmd.exe') or contains(raw, 'cmd ')"),
    Points("Execution", 9, "contains(raw, '.vbs') or contains(raw, '.js') or contains(raw, '.bat') or contains(raw, '.ps1')"),
    Points("Execution", 8, "contains(raw, 'rundll32') or contains(raw, 'regsvr32') or contains(raw, 'mshta') or contains(raw, 'wmic') or contains(process, 'rundll32') or contains(process, 'regsvr32') or contains(process, 'mshta') or contains(process, 'wmic')"),
    Points("Execution", 5, "EventID in (229, 208)"),
    Points("Execution", 10, "EventID = 15281"),
    Points("Persistence", 10, "EventID in (7045, 4697)"),
    Points("Persistence", 8, "EventID = 7040"),
    Points("Persistence", 4, "EventID = 7036"),
    Points("Persistence", 9, "IsScheduledTask > 0"),
    Points("Persistence", 8, "EventID in (4698, 106, 200, 201)"),
    Points("Persistence", 7, "IsRegistryModification > 0"),
    Points("Persistence", 8, "EventID in (12, 13)"),
    Points("Persistence", 7, "EventID = 4657"),
    Points("Persistence", 10, "EventID in (19, 20, 21)"),
    Points("Persistence", 8, "EventID = 4720"),
    Points("Persistence", 7, "EventID = 4722"),
    Points("Persistence", 6, "EventID = 4723"),
    Points("Persistence", 7, "EventID = 4738"),
    Points("Persistence", 7, "EventID in (4704, 4717)"),
    Points("Persistence", 8, "EventID in (4728, 4732, 4756)"),
    Points("Persistence", 7, "EventID in (4735, 4737, 4755)"),
    Points("Persistence", 10, "EventID = 4794"),
    Points("Persistence", 8, "EventID = 6"),
    Points("Persistence", 6, "IsFileCreation > 0 and LogHasScript > 0"),
    Points("Persistence", 3, "IsFileCreation > 0 and LogHasScript <= 0"),
    Points("Persistence", 5, "EventID = 11"),
    Points("Persistence", 9, "EventID in (33212, 15434)"),
    Points("Privilege Escalation", 12, "EventID = 4704"),
    Points("Privilege Escalation", 11, "EventID = 4717"),
    Points("Privilege Escalation", 7, "EventID in (4735, 4737, 4755)"),
    Points("Privilege Escalation", 10, "EventID = 4794"),
    Points("Privilege Escalation", 5, "EventID in (4672, 4673, 4674)"),
    Points("Privilege Escalation", 8, "EventID in (8, 10)"),
    Points("Privilege Escalation", 2, "LevelSeverity >= 4"),
    Points("Privilege Escalation", 6, "EventID in (4732, 4705)"),
    Points("Privilege Escalation", 8, "EventID = 33212"),
    Points("Privilege Escalation", 9, "EventID = 15281"),
    Points("Privilege Escalation", 7, "EventID in (15247, 33211)"),
    Points("Defense Evasion", 6, "EventID = 8"),
    Points("Defense Evasion", 8, "EventID in (1102, 104, 1100)"),
    Points("Defense Evasion", 10, "IsSecurityLogCleared > 0"),
    Points("Defense Evasion", 8, "EventID = 4705"),
    Points("Defense Evasion", 7, "EventID = 4718"),
    Points("Defense Evasion", 3, "EventIDRarity > 0.8"),
    Points("Defense Evasion", 1, "IsNightTime > 0"),
    Points("Defense Evasion", 9, "EventID in (17049, 17120)"),
    Points("Credential Access", 9, "EventID = 10"),
    Points("Credential Access", 3, "EventID in (4624, 4625, 4768)"),
    Points("Credential Access", 6, "EventID in (4769, 4776)"),
    Points("Credential Access", 5, "EventID = 4771"),
    Points("Credential Access", 8, "EventID = 4661"),
    Points("Credential Access", 9, "EventID = 4662"),
    Points("Credential Access", 7, "EventID in (4663, 18456, 33210)"),
    Points("Credential Access", 5, "FailedLoginRatio > 0.5"),
    Points("Credential Access", 3, "EventID = 18452"),
    Points("Credential Access", 8, "EventID in (18454, 15434)"),
    Points("Credential Access", 6, "EventID in (229, 208)"),
    Points("Discovery", 5, "EventID = 4661"),
    Points("Discovery", 4, "EventID = 4662"),
    Points("Discovery", 4, "UniqueIPCount > 3"),
    Points("Discovery", 5, "EventID in (4798, 4799)"),
    Points("Discovery", 2, "IsNetworkConnection > 0"),
    Points("Lateral Movement", 4, "EventID = 4776"),
    Points("Lateral Movement", 3, "IsNetworkConnection > 0"),
    Points("Lateral Movement", 6, "UniqueIPCount > 5"),
    Points("Lateral Movement", 4, "EventID in (3, 5156)"),
    Points("Lateral Movement", 5, "EventID in (4624, 4648) and UniqueIPCount > 2"),
    Points("Lateral Movement", 7, "EventID = 4697"),
    Points("Collection", 6, "EventID in (33210, 3014)"),
    Points("Collection", 3, "EventID in (11, 4663)"),
    Points("Collection", 2, "LogLength > 500"),
    Points("Command and Control", 5, "IsNetworkConnection > 0 and EventsPerMinute > 10"),
    Points("Command and Control", 3, "EventID = 3"),
    Points("Command and Control", 3, "IsNightTime > 0 and IsNetworkConnection > 0"),
    Points("Exfiltration", 5, "EventID = 3014"),
    Points("Exfiltration", 4, "LogLength > 1000"),
    Points("Exfiltration", 6, "IsNetworkConnection > 0 and LogLength > 500"),
    Points("Exfiltration", 5, "EventsPerMinute > 20"),
    Points("Impact", 5, "EventID in (1102, 104)"),
    Points("Impact", 2, "LevelSeverity >= 4"),
    Points("Impact", 6, "EventID = 4719"),
]

# What a requested handle (event 4656) says depends on the object: the first row whose words occur
# in the raw log or the object name counts; the last one holds for all others.
HANDLE_POINTS = [
    Handle(("lsass", "sam", "security", "ntds.dit", "credential"), {"Credential Access": 9}),
    Handle(("certificate", "enterprisecertificates", "root\\certificates"), {"Defense Evasion": 8, "Persistence": 6}),
    Handle(("registry",), {"Defense Evasion": 6, "Persistence": 5}),
    Handle((), {"Collection": 5, "Discovery": 3}),
]

# Reduces Initial Access by 5, not below 0.
NOT_FIRST_STEP = (
    "EventID in (7045, 4697, 4720, 4723, 4738, 4704, 4705, 4717, 4718, 4735, 4737, 4755, 4794, 19, 20, 21)"
    " or IsScheduledTask > 0"
)

# Activity that presupposes access: no points for Initial Access.
POST_COMPROMISE = [
    4656, 4663, 4661, 4662,
    4688, 1,
    7045, 4697,
    4698, 4699, 4700, 4701,
    4720, 4722, 4723, 4738,
    4704, 4705, 4717, 4718,
    4732, 4735, 4737, 4755,
    12, 13, 14, 4657,
    19, 20, 21,
    1102, 104, 1100, 4719,
    8, 10,
    6,
]

# Points for Initial Access that hold whatever the reductions above.
LATE_INITIAL_ACCESS = {18456: 4, 18452: 3}

# Optional correction of the stage by event ID.
STAGE_OVERRIDES = {
    "Stage 1: Initial Access": [4624, 4625, 4648, 4768, 4769, 4771, 4776],
    "Stage 2: Execution": [4688, 1, 4689],
    "Stage 3: Persistence": [4698, 4699, 4700, 4701, 7045, 7040],
    "Stage 3: Defense Evasion": [4657, 4663, 4670, 1102],
    "Stage 4: Credential Access": [4656, 4661, 4662],
    "Stage 5: Lateral Movement": [4672, 4778, 4779, 5140, 5145],
}
LOGON_EVENTS = [4624, 4625, 4648]
