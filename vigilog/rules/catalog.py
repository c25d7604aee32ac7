"""Event-ID catalogue: one row per known event of each log source.

The first tactic of an event is its primary one. Cues are the conditions under which the event
is suspicious; the words night, fail, powershell and unusual inside a cue are matched against
the row context.
"""

from __future__ import annotations

from typing import NamedTuple


class Event(NamedTuple):
    event_id: int
    name: str
    category: str
    risk: int
    severity: str
    tactics: tuple[str, ...]
    techniques: tuple[str, ...]
    cues: tuple[str, ...]


# Fixed values.
SECURITY = [
    Event(1100, "Event Log Service Shutdown", "System", 8, "Critical", ("Defense Evasion",), ("T1562.002",), ("audit service stopped outside a reboot",)),
    Event(1102, "Security Log Cleared", "System", 10, "Critical", ("Defense Evasion",), ("T1070.001",), ("audit trail wiped", "no matching change ticket")),
    Event(4624, "Successful Logon", "Logon/Logoff", 2, "Low", ("Initial Access", "Lateral Movement"), ("T1078", "T1021"), ("logon at night", "remote desktop from outside")),
    Event(4625, "Failed Logon", "Logon/Logoff", 7, "High", ("Initial Access", "Credential Access"), ("T1110",), ("many attempts in a short time", "one password over many accounts")),
    Event(4634, "Logoff", "Logon/Logoff", 1, "Info", (), (), ("session ended early",)),
    Event(4647, "User Initiated Logoff", "Logon/Logoff", 1, "Info", (), (), ()),
    Event(4648, "Logon Using Explicit Credentials", "Logon/Logoff", 5, "Medium", ("Lateral Movement", "Privilege Escalation"), ("T1078", "T1021.002"), ("unusual account pairing", "remote administration tool")),
    Event(4656, "Handle to Object Requested", "Object Access", 7, "High", ("Credential Access", "Collection"), ("T1003.001", "T1003.002"), ("unusual process opens the object", "credential store opened")),
    Event(4657, "Registry Value Modified", "Object Access", 6, "High", ("Persistence", "Privilege Escalation"), ("T1547",), ("unusual process writes an autostart key",)),
    Event(4658, "Handle to Object Closed", "Object Access", 2, "Low", (), (), ()),
    Event(4661, "Handle to Object Requested (SAM/AD)", "Object Access", 8, "High", ("Credential Access", "Discovery"), ("T1003.002", "T1003.003", "T1087"), ("unusual account opens the directory", "security database opened")),
    Event(4662, "Operation Performed on Object (AD)", "Directory Service Access", 7, "High", ("Credential Access", "Discovery"), ("T1003.006", "T1087.002"), ("directory replication rights used",)),
    Event(4663, "Object Access Attempted", "Object Access", 6, "Medium", ("Credential Access", "Collection"), ("T1003.002", "T1003.003"), ("credential file read",)),
    Event(4672, "Special Privileges Assigned", "Privilege Use", 6, "High", ("Privilege Escalation",), ("T1078.002",), ("unusual account gets privileges", "service identity logs on")),
    Event(4673, "Sensitive Privilege Use", "Privilege Use", 7, "High", ("Privilege Escalation",), ("T1134",), ("debug right used", "token handling")),
    Event(4674, "Operation on Privileged Object", "Privilege Use", 5, "Medium", ("Privilege Escalation",), ("T1134",), ("secret storage touched",)),
    Event(4688, "Process Created", "Process Tracking", 4, "Medium", ("Execution", "Persistence"), ("T1059", "T1543"), ("powershell command line", "encoded arguments")),
    Event(4689, "Process Terminated", "Process Tracking", 2, "Low", (), (), ("protection tool ended",)),
    Event(4697, "Service Installed", "System", 9, "Critical", ("Persistence", "Lateral Movement"), ("T1543.003", "T1021.002"), ("unusual service binary", "remote installation")),
    Event(4698, "Scheduled Task Created", "Task Scheduler", 7, "High", ("Persistence", "Execution"), ("T1053.005",), ("powershell action", "runs as system")),
    Event(4699, "Scheduled Task Deleted", "Task Scheduler", 5, "Medium", ("Defense Evasion",), ("T1070",), ("protective task removed",)),
    Event(4700, "Scheduled Task Enabled", "Task Scheduler", 6, "Medium", ("Persistence",), ("T1053.005",), ("dormant task switched on",)),
    Event(4701, "Scheduled Task Disabled", "Task Scheduler", 5, "Medium", ("Defense Evasion",), ("T1562",), ("monitoring task switched off",)),
    Event(4702, "Scheduled Task Updated", "Task Scheduler", 6, "Medium", ("Persistence",), ("T1053.005",), ("action of the task replaced",)),
    Event(4704, "User Right Assigned", "User Rights Assignment", 8, "High", ("Privilege Escalation", "Persistence"), ("T1078", "T1098"), ("unusual account receives a right", "debug right granted")),
    Event(4705, "User Right Removed", "User Rights Assignment", 7, "High", ("Defense Evasion", "Privilege Escalation"), ("T1562.001", "T1078"), ("monitoring right taken away",)),
    Event(4717, "System Security Access Granted", "Security Access Management", 8, "High", ("Privilege Escalation", "Persistence"), ("T1098", "T1068"), ("unusual account receives access", "token creation right")),
    Event(4718, "System Security Access Removed", "Security Access Management", 6, "Medium", ("Defense Evasion",), ("T1562.001",), ("monitoring access taken away",)),
    Event(4719, "System Audit Policy Changed", "Policy Change", 9, "Critical", ("Defense Evasion",), ("T1562.002",), ("auditing turned off", "change at night")),
    Event(4720, "User Account Created", "Account Management", 6, "Medium", ("Persistence",), ("T1136.001",), ("created at an unusual hour", "local account")),
    Event(4722, "User Account Enabled", "Account Management", 5, "Medium", ("Persistence",), ("T1098",), ("enabled at night", "dormant account")),
    Event(4723, "Password Change Attempt", "Account Management", 5, "Medium", ("Persistence", "Credential Access"), ("T1098",), ("unusual account changes the password", "attempt did fail")),
    Event(4724, "Password Reset Attempt", "Account Management", 6, "High", ("Credential Access", "Persistence"), ("T1098",), ("administrator password reset",)),
    Event(4725, "User Account Disabled", "Account Management", 4, "Medium", ("Impact",), ("T1531",), ("many accounts disabled",)),
    Event(4726, "User Account Deleted", "Account Management", 5, "Medium", ("Impact", "Defense Evasion"), ("T1531", "T1070"), ("active account removed",)),
    Event(4728, "Member Added to Global Group", "Account Management", 7, "High", ("Privilege Escalation", "Persistence"), ("T1098",), ("domain administrators group changed",)),
    Event(4732, "Member Added to Local Group", "Account Management", 8, "High", ("Privilege Escalation", "Persistence"), ("T1078.003",), ("administrators group changed",)),
    Event(4733, "Member Removed from Local Group", "Account Management", 5, "Medium", ("Defense Evasion",), ("T1070",), ("security group reduced",)),
    Event(4735, "Security-Enabled Local Group Changed", "Account Management", 7, "High", ("Privilege Escalation", "Persistence"), ("T1098",), ("administrators group altered",)),
    Event(4737, "Security-Enabled Global Group Changed", "Account Management", 7, "High", ("Privilege Escalation", "Persistence"), ("T1098", "T1484"), ("domain administrators group altered",)),
    Event(4738, "User Account Changed", "Account Management", 6, "Medium", ("Persistence", "Privilege Escalation"), ("T1098",), ("password set never to expire",)),
    Event(4739, "Domain Policy Changed", "Policy Change", 7, "High", ("Defense Evasion", "Persistence"), ("T1484",), ("password rules weakened",)),
    Event(4755, "Security-Enabled Universal Group Changed", "Account Management", 7, "High", ("Privilege Escalation", "Persistence"), ("T1098",), ("forest wide rights altered",)),
    Event(4756, "Member Added to Universal Security Group", "Account Management", 7, "High", ("Persistence", "Privilege Escalation"), ("T1098",), ("forest wide group changed",)),
    Event(4768, "Kerberos TGT Requested", "Account Logon", 3, "Medium", ("Initial Access", "Credential Access"), ("T1078", "T1558"), ("unusual hour", "several tickets fail")),
    Event(4769, "Kerberos Service Ticket Requested", "Account Logon", 5, "Medium", ("Credential Access", "Lateral Movement"), ("T1558.003",), ("unusual service name", "weak ticket encryption")),
    Event(4770, "Kerberos Service Ticket Renewed", "Account Logon", 2, "Low", ("Persistence",), ("T1078",), ("unusual timing", "very frequent renewals")),
    Event(4771, "Kerberos Pre-authentication Failed", "Account Logon", 6, "High", ("Initial Access", "Credential Access"), ("T1110.003",), ("many attempts fail", "one password over many accounts")),
    Event(4776, "NTLM Authentication", "Account Logon", 6, "Medium", ("Credential Access", "Lateral Movement"), ("T1550.002", "T1557.001"), ("hash reuse", "several validations fail")),
    Event(4794, "Directory Services Restore Mode Password Set", "Account Management", 9, "Critical", ("Privilege Escalation", "Persistence"), ("T1098",), ("restore mode password set without approval",)),
    Event(5156, "Network Connection Allowed", "Filtering Platform", 3, "Low", ("Command and Control", "Exfiltration"), ("T1071", "T1041"), ("unusual destination", "new program talks out")),
    Event(5157, "Network Connection Blocked", "Filtering Platform", 6, "Medium", ("Discovery", "Command and Control"), ("T1046",), ("scan like pattern",)),
    Event(5158, "Network Bind Allowed", "Filtering Platform", 4, "Medium", ("Command and Control",), ("T1571",), ("unusual port",)),
]

# Fixed values.
SYSMON = [
    Event(1, "Process Creation", "Process Activity", 5, "Medium", ("Execution",), ("T1059",), ("powershell started", "office program as parent")),
    Event(2, "File Creation Time Changed", "File Activity", 7, "High", ("Defense Evasion",), ("T1070.006",), ("timestamp moved back",)),
    Event(3, "Network Connection", "Network Activity", 4, "Medium", ("Command and Control", "Exfiltration"), ("T1071", "T1041"), ("unusual port", "regular beacon")),
    Event(4, "Sysmon Service State Changed", "Sysmon", 8, "High", ("Defense Evasion",), ("T1562.001",), ("sensor stopped",)),
    Event(5, "Process Terminated", "Process Activity", 3, "Low", ("Defense Evasion",), ("T1562",), ("protection tool ended",)),
    Event(6, "Driver Loaded", "Driver Activity", 7, "High", ("Persistence", "Privilege Escalation"), ("T1543.003", "T1068"), ("unusual driver path", "unsigned driver")),
    Event(7, "Image Loaded", "Process Activity", 4, "Medium", ("Defense Evasion", "Execution"), ("T1055",), ("unsigned library",)),
    Event(8, "CreateRemoteThread", "Process Activity", 9, "High", ("Privilege Escalation", "Defense Evasion"), ("T1055", "T1055.001"), ("thread in a foreign process",)),
    Event(9, "RawAccessRead", "Disk Activity", 9, "Critical", ("Credential Access", "Defense Evasion"), ("T1003",), ("raw volume read",)),
    Event(10, "ProcessAccess", "Process Activity", 9, "High", ("Credential Access", "Privilege Escalation"), ("T1003.001", "T1134"), ("foreign process memory opened",)),
    Event(11, "FileCreate", "File Activity", 5, "Medium", ("Persistence", "Defense Evasion"), ("T1105",), ("autostart folder written",)),
    Event(12, "RegistryEvent (Object create/delete)", "Registry Activity", 6, "Medium", ("Persistence", "Privilege Escalation"), ("T1547",), ("autostart key created",)),
    Event(13, "RegistryEvent (Value Set)", "Registry Activity", 6, "Medium", ("Persistence", "Privilege Escalation"), ("T1547",), ("autostart value written",)),
    Event(14, "RegistryEvent (Key/Value Rename)", "Registry Activity", 5, "Medium", ("Defense Evasion",), ("T1112",), ("security key renamed",)),
    Event(15, "FileCreateStreamHash", "File Activity", 7, "High", ("Defense Evasion", "Execution"), ("T1564.004",), ("download mark removed",)),
    Event(16, "ServiceConfigurationChange", "System Activity", 7, "High", ("Persistence", "Privilege Escalation"), ("T1543.003",), ("monitoring configuration weakened",)),
    Event(17, "PipeEvent (Pipe Created)", "IPC Activity", 6, "Medium", ("Execution", "Lateral Movement"), ("T1559",), ("known tool pipe created",)),
    Event(18, "PipeEvent (Pipe Connected)", "IPC Activity", 5, "Medium", ("Execution", "Lateral Movement"), ("T1559",), ("known tool pipe used",)),
    Event(19, "WmiEvent (WmiEventFilter)", "WMI Activity", 8, "High", ("Persistence", "Execution"), ("T1546.003",), ("event filter registered",)),
    Event(20, "WmiEvent (WmiEventConsumer)", "WMI Activity", 8, "High", ("Persistence", "Execution"), ("T1546.003",), ("script consumer registered",)),
    Event(21, "WmiEvent (WmiEventConsumerToFilter)", "WMI Activity", 9, "Critical", ("Persistence", "Execution"), ("T1546.003",), ("filter bound to consumer",)),
    Event(22, "DNSEvent (DNS query)", "Network Activity", 4, "Low", ("Command and Control",), ("T1071.004",), ("generated domain name", "dns tunnelling")),
    Event(23, "FileDelete (File Deleted)", "File Activity", 6, "Medium", ("Defense Evasion",), ("T1070.004",), ("evidence removed",)),
    Event(24, "ClipboardChange", "Data Activity", 7, "High", ("Collection",), ("T1115",), ("clipboard read in bulk",)),
    Event(25, "ProcessTampering", "Process Activity", 9, "Critical", ("Defense Evasion",), ("T1055",), ("process image replaced",)),
    Event(26, "FileDeleteDetected", "File Activity", 5, "Medium", ("Defense Evasion",), ("T1070.004",), ("mass deletion",)),
    Event(27, "FileBlockExecutable", "File Activity", 8, "High", ("Defense Evasion",), ("T1036",), ("blocked binary",)),
    Event(28, "FileBlockShredding", "File Activity", 7, "High", ("Defense Evasion",), ("T1070.004",), ("secure wipe stopped",)),
    Event(29, "FileExecutableDetected", "File Activity", 6, "Medium", ("Execution",), ("T1204.002",), ("binary in the download folder",)),
]

# Fixed values.
SYSTEM = [
    Event(104, "Log Cleared", "System", 10, "Critical", ("Defense Evasion",), ("T1070.001",), ("log wiped",)),
    Event(106, "Task Scheduler Event", "Task Scheduler", 6, "Medium", ("Persistence", "Execution"), ("T1053.005",), ("task runs as system",)),
    Event(140, "Task Scheduler Updated", "Task Scheduler", 6, "Medium", ("Persistence",), ("T1053.005",), ("action of the task replaced",)),
    Event(141, "Task Scheduler Deleted", "Task Scheduler", 5, "Medium", ("Defense Evasion",), ("T1070",), ("protective task removed",)),
    Event(200, "Task Scheduler Action Started", "Task Scheduler", 5, "Medium", ("Execution",), ("T1053.005",), ("powershell action",)),
    Event(201, "Task Scheduler Action Completed", "Task Scheduler", 4, "Low", ("Execution",), ("T1053.005",), ("unusual timing", "actions that fail")),
    Event(800, "Named Pipe Created", "Application", 6, "Medium", ("Execution", "Lateral Movement"), ("T1559",), ("known tool pipe created",)),
    Event(4103, "PowerShell Module Logging", "PowerShell", 5, "Medium", ("Execution",), ("T1059.001",), ("encoded module call",)),
    Event(4104, "PowerShell Script Block Logging", "PowerShell", 6, "High", ("Execution",), ("T1059.001",), ("obfuscated script",)),
    Event(7030, "Service Control Manager", "System", 8, "High", ("Persistence",), ("T1543.003",), ("interactive service",)),
    Event(7034, "Service Crashed", "System", 6, "Medium", ("Impact",), ("T1489",), ("protection service crashed",)),
    Event(7035, "Service Control", "System", 5, "Medium", ("Execution",), ("T1569.002",), ("protection service stopped",)),
    Event(7036, "Service State Change", "System", 6, "Medium", ("Defense Evasion", "Persistence"), ("T1562.001", "T1543.003"), ("protection service stopped",)),
    Event(7040, "Service Startup Type Changed", "System", 7, "High", ("Persistence", "Defense Evasion"), ("T1543.003", "T1562.001"), ("disabled service set to automatic",)),
    Event(7045, "Service Installed", "System", 9, "Critical", ("Persistence", "Lateral Movement"), ("T1543.003", "T1021.002"), ("unusual service binary", "remote execution tool")),
]

# Fixed values.
SQL_SERVER = [
    Event(208, "Invalid Object Name", "SQL Injection", 6, "Medium", ("Discovery", "Credential Access"), ("T1190", "T1087"), ("probing of table names",)),
    Event(229, "SQL Permission Denied", "SQL Injection", 7, "High", ("Credential Access", "Privilege Escalation"), ("T1190", "T1059.001"), ("requests that fail in quick order", "system procedures refused")),
    Event(3009, "Restore Operation Initiated", "Data Access", 7, "High", ("Defense Evasion", "Impact"), ("T1490",), ("unusual time", "production data overwritten")),
    Event(3014, "Database Backup Completed", "Data Access", 5, "Medium", ("Collection", "Exfiltration"), ("T1005",), ("unusual backup target",)),
    Event(3041, "Backup Failed", "Data Access", 6, "Medium", ("Discovery", "Collection"), ("T1005",), ("backup denied repeatedly",)),
    Event(15247, "User Does Not Have Permission", "Privilege Escalation", 7, "High", ("Privilege Escalation", "Credential Access"), ("T1068", "T1190"), ("attempt to grant itself rights",)),
    Event(15281, "SQL Server xp_cmdshell Enabled", "Command Execution", 10, "Critical", ("Execution", "Privilege Escalation"), ("T1059.001",), ("shell procedure switched on",)),
    Event(15434, "Cannot Change sa Password", "Privilege Escalation", 9, "Critical", ("Persistence", "Credential Access"), ("T1098",), ("application account changes the main login",)),
    Event(15457, "Configuration Option Changed", "Configuration Change", 8, "High", ("Defense Evasion", "Persistence"), ("T1562.001",), ("dangerous option enabled",)),
    Event(17049, "Configuration Option Changed - SQL Trace", "Configuration Change", 9, "Critical", ("Defense Evasion",), ("T1562.001",), ("tracing stopped",)),
    Event(17120, "Error Log Disabled", "Defense Evasion", 9, "Critical", ("Defense Evasion",), ("T1562.001",), ("error log switched off",)),
    Event(17124, "Error Log Recycled", "Defense Evasion", 7, "High", ("Defense Evasion",), ("T1070.001",), ("log recycled often",)),
    Event(18452, "SQL Server Login Succeeded", "Authentication", 3, "Low", ("Initial Access", "Lateral Movement"), ("T1078",), ("unusual source", "success after many that fail")),
    Event(18453, "SQL Server Login Succeeded with Warnings", "Authentication", 5, "Medium", ("Initial Access", "Credential Access"), ("T1078",), ("warnings ignored",)),
    Event(18454, "SQL Server Login Failed - Account Locked", "Authentication", 8, "High", ("Credential Access",), ("T1110.001",), ("lockouts in series",)),
    Event(18455, "SQL Server Login Failed - Disabled Account", "Authentication", 6, "Medium", ("Credential Access", "Discovery"), ("T1087",), ("disabled accounts tried",)),
    Event(18456, "SQL Server Login Failed", "Authentication", 7, "High", ("Credential Access", "Initial Access"), ("T1110.001", "T1110.003"), ("many logins fail", "main login targeted")),
    Event(18483, "Linked Server Login Failed", "Linked Server", 6, "Medium", ("Lateral Movement", "Credential Access"), ("T1021",), ("unusual linked server", "several links fail")),
    Event(18486, "Linked Server Login Succeeded", "Linked Server", 5, "Medium", ("Lateral Movement",), ("T1021",), ("unusual time",)),
    Event(22022, "SQLAgent Job Executed", "Command Execution", 7, "High", ("Execution", "Persistence"), ("T1053", "T1059.001"), ("powershell step", "unexpected job")),
    Event(33205, "SQL Audit Event - DBCC Command", "SQL Injection", 8, "High", ("Credential Access", "Discovery"), ("T1190", "T1059.001"), ("unexpected maintenance command",)),
    Event(33210, "SQL Audit - Schema Object Access", "Audit", 6, "Medium", ("Discovery", "Collection"), ("T1087", "T1552.001"), ("unusual account reads schema", "password columns read")),
    Event(33211, "SQL Audit - Database Object Permission Change", "Audit", 8, "High", ("Privilege Escalation", "Persistence"), ("T1098",), ("control permission granted",)),
    Event(33212, "SQL Audit - Server Principal Management", "Audit", 9, "Critical", ("Persistence", "Privilege Escalation"), ("T1136", "T1098"), ("new high privilege login",)),
]

SOURCES = {"Security": SECURITY, "Sysmon": SYSMON, "System": SYSTEM, "SQL": SQL_SERVER}

# The EventData fields to look at, for events of the Sysmon source.
KEY_FIELDS = {
    1: ("CommandLine", "ParentImage", "User"),
    2: ("Image", "TargetFilename", "CreationUtcTime"),
    3: ("Image", "DestinationIp", "DestinationPort", "DestinationHostname"),
    4: ("State",),
    5: ("Image", "ProcessId"),
    6: ("ImageLoaded", "Signed", "Signature"),
    7: ("Image", "ImageLoaded", "Signed"),
    8: ("SourceImage", "TargetImage", "StartAddress"),
    9: ("Image", "Device"),
    10: ("SourceImage", "TargetImage", "GrantedAccess"),
    11: ("Image", "TargetFilename"),
    12: ("EventType", "TargetObject", "Image"),
    13: ("TargetObject", "Details", "Image"),
    14: ("TargetObject", "NewName", "Image"),
    15: ("TargetFilename", "Contents", "Hash"),
    16: ("State",),
    17: ("PipeName", "Image"),
    18: ("PipeName", "Image"),
    19: ("EventNamespace", "Name", "Query"),
    20: ("Name", "Type", "Destination"),
    21: ("Consumer", "Filter"),
    22: ("QueryName", "QueryResults", "Image"),
    23: ("Image", "TargetFilename", "Archived"),
    24: ("Image", "Session", "ClientInfo"),
    25: ("Image", "Type"),
    26: ("Image", "TargetFilename"),
    27: ("Image", "TargetFilename"),
    28: ("Image", "TargetFilename"),
    29: ("Image", "TargetFilename"),
}

# What the state codes of an event mean.
STATES = {
    18456: {
        "2": "Invalid username",
        "5": "Invalid username (Windows auth)",
        "6": "Windows account lockout",
        "7": "Account disabled",
        "8": "Wrong password",
        "11": "Valid login but server access failure",
        "12": "Valid login but server access failure",
        "18": "Password must be changed",
        "38": "Database not available",
        "40": "Database not available",
    },
}
