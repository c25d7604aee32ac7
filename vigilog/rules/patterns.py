"""Attack patterns: what a row must show, and what raises the score.

All tables in this module are fixed values. Conditions are SQL over the feature
columns. A '%s' in a label stands for the event name.
"""

from __future__ import annotations

from typing import NamedTuple


class KnownEvents(NamedTuple):
    event_ids: tuple[int, ...]
    pattern: int
    label: str


class Pattern(NamedTuple):
    number: int
    label: str
    condition: str
    score: int
    additions: tuple[tuple[int, str], ...]


# Known events of risk 8 and more.
KNOWN_EVENTS = [
    KnownEvents((1102, 104), 6, "Defense Evasion (%s)"),
    KnownEvents((4697, 7045), 11, "Service Installation (%s)"),
    KnownEvents((4732, 4728), 5, "Privilege Escalation (%s)"),
    KnownEvents((4698, 4699, 4700, 4701, 106), 7, "Persistence (%s)"),
    KnownEvents((9,), 8, "Credential Theft (LSASS Access)"),
    KnownEvents((10,), 8, "Credential Theft (Process Access)"),
    KnownEvents((19, 20, 21), 7, "Persistence (WMI)"),
]
# Event 10 counts only when this word is part of the target image.
LSASS = "lsass"

PATTERNS = [
    Pattern(1, "Brute Force Attack", "IsFailedLogin > 0 or FailedLoginRatio > 0.3", 10, ((5, "EventsPerMinute > 5"), (3, "IsNightTime > 0"))),
    Pattern(2, "PowerShell Exploit", "LogHasPowerShell > 0", 10, ((5, "LogHasBase64 > 0"), (5, "LogHasSuspicious > 0"), (3, "LogEntropy > 4.5"))),
    Pattern(3, "Process Execution (Stage 2)", "IsProcessCreation > 0", 8, ((3, "LogHasCmd > 0"), (5, "LogHasSuspicious > 0"), (2, "IsNightTime > 0"))),
    Pattern(4, "Lateral Movement", "UniqueIPCount > 3 or IsNetworkConnection > 0", 8, ((5, "UniqueIPCount > 5"), (3, "EventsPerMinute > 10"), (4, "IsSuccessfulLogin > 0"))),
    Pattern(5, "Privilege Escalation", "IsPrivilegeUse > 0 or IsGroupModification > 0", 10, ((5, "LogHasPrivEsc > 0"), (5, "EventID in (4732)"))),
    Pattern(6, "Defense Evasion (Log Tampering)", "IsSecurityLogCleared > 0 or IsAuditPolicyChange > 0", 15, ((5, "IsNightTime > 0"),)),
    Pattern(7, "Persistence Establishment", "IsScheduledTask > 0 or IsRegistryModification > 0", 9, ((3, "IsFileCreation > 0"), (4, "LogHasScript > 0"))),
    Pattern(8, "Credential Theft", "EventID in (4776, 4768, 4769)", 8, ((4, "FailedLoginRatio > 0.5"), (5, "LogHasSuspicious > 0"))),
    Pattern(9, "Data Exfiltration", "LogLength > 1000 and IsNetworkConnection > 0", 10, ((5, "EventsPerMinute > 20"), (3, "IsNightTime > 0"))),
    Pattern(10, "Network Reconnaissance", "UniqueIPCount > 2 and EventsPerMinute > 8", 8, ((5, "UniqueIPCount > 10"),)),
    Pattern(11, "Service Installation (PSExec)", "IsServiceInstalled > 0", 12, ((3, "IsNightTime > 0"),)),
    Pattern(12, "Rare Event (Anomalous)", "EventIDRarity > 0.8", 7, ((3, "LevelSeverity >= 4"),)),
    Pattern(13, "C2 Beaconing", "EventsPerMinute > 15 and IsNetworkConnection > 0", 9, ((4, "IsNightTime > 0"),)),
]

UNCLASSIFIED = (0, "Unclassified Anomaly")
