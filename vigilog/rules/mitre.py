"""ATT&CK tactics and the techniques that the event catalogue refers to.

The complete technique matrix is a parameter: load it with
``vigilog.operators.knowledge.techniques``.
"""

from __future__ import annotations

from typing import NamedTuple


class Tactic(NamedTuple):
    name: str
    stage: str
    description: str


class Technique(NamedTuple):
    technique_id: str
    name: str
    tactics: tuple[str, ...]


# Fixed values, in the order of the kill chain.
TACTICS = [
    Tactic("Initial Access", "Stage 1: Initial Access", "Getting a first foothold inside the network"),
    Tactic("Execution", "Stage 2: Execution", "Running attacker controlled code"),
    Tactic("Persistence", "Stage 3: Persistence", "Keeping access over restarts and password changes"),
    Tactic("Privilege Escalation", "Stage 3: Privilege Escalation", "Gaining higher rights"),
    Tactic("Defense Evasion", "Stage 3: Defense Evasion", "Hiding from detection"),
    Tactic("Credential Access", "Stage 2: Credential Access", "Stealing accounts and passwords"),
    Tactic("Discovery", "Stage 4: Discovery", "Learning about the environment"),
    Tactic("Lateral Movement", "Stage 4: Lateral Movement", "Moving on to other hosts"),
    Tactic("Collection", "Stage 5: Collection", "Gathering data of interest"),
    Tactic("Command and Control", "Stage 5: Command & Control", "Steering compromised hosts from outside"),
    Tactic("Exfiltration", "Stage 6: Exfiltration", "Taking data out"),
    Tactic("Impact", "Stage 7: Impact", "Disrupting, altering or destroying systems and data"),
]

DEFAULT_TACTIC = "Execution"
DEFAULT_STAGE = "Stage 2: Execution"

# Fixed values.
TECHNIQUES = [
    Technique("T1003", "OS Credential Dumping", ("Credential Access",)),
    Technique("T1003.001", "OS Credential Dumping: LSASS Memory", ("Credential Access",)),
    Technique("T1003.002", "OS Credential Dumping: Security Account Manager", ("Credential Access",)),
    Technique("T1003.003", "OS Credential Dumping: NTDS", ("Credential Access",)),
    Technique("T1003.006", "OS Credential Dumping: DCSync", ("Credential Access",)),
    Technique("T1005", "Data from Local System", ("Collection",)),
    Technique("T1021", "Remote Services", ("Lateral Movement",)),
    Technique("T1021.002", "Remote Services: SMB/Windows Admin Shares", ("Lateral Movement",)),
    Technique("T1036", "Masquerading", ("Defense Evasion",)),
    Technique("T1041", "Exfiltration Over C2 Channel", ("Exfiltration",)),
    Technique("T1046", "Network Service Discovery", ("Discovery",)),
    Technique("T1053", "Scheduled Task/Job", ("Execution", "Persistence", "Privilege Escalation")),
    Technique("T1053.005", "Scheduled Task/Job: Scheduled Task", ("Execution", "Persistence")),
    Technique("T1055", "Process Injection", ("Privilege Escalation", "Defense Evasion")),
    Technique("T1055.001", "Process Injection: Dynamic-link Library Injection", ("Privilege Escalation",)),
    Technique("T1059", "Command and Scripting Interpreter", ("Execution",)),
    Technique("T1059.001", "Command and Scripting Interpreter: PowerShell", ("Execution",)),
    Technique("T1068", "Exploitation for Privilege Escalation", ("Privilege Escalation",)),
    Technique("T1070", "Indicator Removal", ("Defense Evasion",)),
    Technique("T1070.001", "Indicator Removal: Clear Windows Event Logs", ("Defense Evasion",)),
    Technique("T1070.004", "Indicator Removal: File Deletion", ("Defense Evasion",)),
    Technique("T1070.006", "Indicator Removal: Timestomp", ("Defense Evasion",)),
    Technique("T1071", "Application Layer Protocol", ("Command and Control",)),
    Technique("T1071.004", "Application Layer Protocol: DNS", ("Command and Control",)),
    Technique("T1078", "Valid Accounts", ("Initial Access", "Persistence", "Privilege Escalation")),
    Technique("T1078.002", "Valid Accounts: Domain Accounts", ("Initial Access",)),
    Technique("T1078.003", "Valid Accounts: Local Accounts", ("Initial Access",)),
    Technique("T1087", "Account Discovery", ("Discovery",)),
    Technique("T1087.002", "Account Discovery: Domain Account", ("Discovery",)),
    Technique("T1098", "Account Manipulation", ("Persistence",)),
    Technique("T1105", "Ingress Tool Transfer", ("Command and Control",)),
    Technique("T1110", "Brute Force", ("Credential Access",)),
    Technique("T1110.001", "Brute Force: Password Guessing", ("Credential Access",)),
    Technique("T1110.003", "Brute Force: Password Spraying", ("Credential Access",)),
    Technique("T1112", "Modify Registry", ("Defense Evasion",)),
    Technique("T1115", "Clipboard Data", ("Collection",)),
    Technique("T1134", "Access Token Manipulation", ("Privilege Escalation", "Defense Evasion")),
    Technique("T1136", "Create Account", ("Persistence",)),
    Technique("T1136.001", "Create Account: Local Account", ("Persistence",)),
    Technique("T1190", "Exploit Public-Facing Application", ("Initial Access",)),
    Technique("T1204.002", "User Execution: Malicious File", ("Execution",)),
    Technique("T1484", "Domain Policy Modification", ("Privilege Escalation", "Defense Evasion")),
    Technique("T1489", "Service Stop", ("Impact",)),
    Technique("T1490", "Inhibit System Recovery", ("Impact",)),
    Technique("T1531", "Account Access Removal", ("Impact",)),
    Technique("T1543", "Create or Modify System Process", ("Persistence", "Privilege Escalation")),
    Technique("T1543.003", "Create or Modify System Process: Windows Service", ("Persistence",)),
    Technique("T1546.003", "Event Triggered Execution: Windows Management Instrumentation Event Subscription", ("Persistence",)),
    Technique("T1547", "Boot or Logon Autostart Execution", ("Persistence", "Privilege Escalation")),
    Technique("T1550.002", "Use Alternate Authentication Material: Pass the Hash", ("Defense Evasion",)),
    Technique("T1552.001", "Unsecured Credentials: Credentials In Files", ("Credential Access",)),
    Technique("T1558", "Steal or Forge Kerberos Tickets", ("Credential Access",)),
    Technique("T1558.003", "Steal or Forge Kerberos Tickets: Kerberoasting", ("Credential Access",)),
    Technique("T1559", "Inter-Process Communication", ("Execution",)),
    Technique("T1562", "Impair Defenses", ("Defense Evasion",)),
    Technique("T1562.001", "Impair Defenses: Disable or Modify Tools", ("Defense Evasion",)),
    Technique("T1562.002", "Impair Defenses: Disable Windows Event Logging", ("Defense Evasion",)),
    Technique("T1564.004", "Hide Artifacts: NTFS File Attributes", ("Defense Evasion",)),
    Technique("T1569.002", "System Services: Service Execution", ("Execution",)),
    Technique("T1571", "Non-Standard Port", ("Command and Control",)),
]

STAGE_OF_TACTIC = {tactic.name: tactic.stage for tactic in TACTICS}
