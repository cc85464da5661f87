"""ATT&CK tactics and techniques as small dimensions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Tactic id, name, kill-chain position.
TACTICS = [
    ("TA0043", "Reconnaissance", 1), ("TA0042", "Resource Development", 2), ("TA0001", "Initial Access", 3),
    ("TA0002", "Execution", 4), ("TA0003", "Persistence", 5), ("TA0004", "Privilege Escalation", 6),
    ("TA0005", "Defense Evasion", 7), ("TA0006", "Credential Access", 8), ("TA0007", "Discovery", 9),
    ("TA0008", "Lateral Movement", 10), ("TA0009", "Collection", 11), ("TA0011", "Command and Control", 12),
    ("TA0010", "Exfiltration", 13), ("TA0040", "Impact", 14),
]

# Technique id, name, tactic ids.
TECHNIQUES = [
    ("T1110", "Brute Force", ("TA0006",)),
    ("T1110.001", "Brute Force: Password Guessing", ("TA0006",)),
    ("T1110.003", "Brute Force: Password Spraying", ("TA0006",)),
    ("T1110.004", "Brute Force: Credential Stuffing", ("TA0006",)),
    ("T1078", "Valid Accounts", ("TA0001", "TA0003", "TA0004", "TA0005")),
    ("T1078.002", "Valid Accounts: Domain Accounts", ("TA0001", "TA0003", "TA0004", "TA0005")),
    ("T1078.003", "Valid Accounts: Local Accounts", ("TA0001", "TA0003", "TA0004", "TA0005")),
    ("T1078.004", "Valid Accounts: Cloud Accounts", ("TA0001", "TA0003", "TA0004", "TA0005")),
    ("T1087", "Account Discovery", ("TA0007",)),
    ("T1087.001", "Account Discovery: Local Account", ("TA0007",)),
    ("T1087.002", "Account Discovery: Domain Account", ("TA0007",)),
    ("T1087.004", "Account Discovery: Cloud Account", ("TA0007",)),
    ("T1082", "System Information Discovery", ("TA0007",)),
    ("T1033", "System Owner/User Discovery", ("TA0007",)),
    ("T1057", "Process Discovery", ("TA0007",)),
    ("T1069", "Permission Groups Discovery", ("TA0007",)),
    ("T1069.003", "Permission Groups Discovery: Cloud Groups", ("TA0007",)),
    ("T1046", "Network Service Discovery", ("TA0007",)),
    ("T1518", "Software Discovery", ("TA0007",)),
    ("T1526", "Cloud Service Discovery", ("TA0007",)),
    ("T1580", "Cloud Infrastructure Discovery", ("TA0007",)),
    ("T1059", "Command and Scripting Interpreter", ("TA0002",)),
    ("T1059.001", "Command and Scripting Interpreter: PowerShell", ("TA0002",)),
    ("T1059.004", "Command and Scripting Interpreter: Unix Shell", ("TA0002",)),
    ("T1548", "Abuse Elevation Control Mechanism", ("TA0004", "TA0005")),
    ("T1548.001", "Abuse Elevation Control Mechanism: Setuid and Setgid", ("TA0004", "TA0005")),
    ("T1548.003", "Abuse Elevation Control Mechanism: Sudo and Sudo Caching", ("TA0004", "TA0005")),
    ("T1068", "Exploitation for Privilege Escalation", ("TA0004",)),
    ("T1134", "Access Token Manipulation", ("TA0004", "TA0005")),
    ("T1098", "Account Manipulation", ("TA0003", "TA0004")),
    ("T1098.001", "Account Manipulation: Additional Cloud Credentials", ("TA0003", "TA0004")),
    ("T1098.003", "Account Manipulation: Additional Cloud Roles", ("TA0003", "TA0004")),
    ("T1098.004", "Account Manipulation: SSH Authorized Keys", ("TA0003", "TA0004")),
    ("T1136", "Create Account", ("TA0003",)),
    ("T1136.001", "Create Account: Local Account", ("TA0003",)),
    ("T1136.003", "Create Account: Cloud Account", ("TA0003",)),
    ("T1053", "Scheduled Task/Job", ("TA0002", "TA0003", "TA0004")),
    ("T1053.003", "Scheduled Task/Job: Cron", ("TA0002", "TA0003", "TA0004")),
    ("T1053.005", "Scheduled Task/Job: Scheduled Task", ("TA0002", "TA0003", "TA0004")),
    ("T1543", "Create or Modify System Process", ("TA0003", "TA0004")),
    ("T1543.002", "Create or Modify System Process: Systemd Service", ("TA0003", "TA0004")),
    ("T1543.003", "Create or Modify System Process: Windows Service", ("TA0003", "TA0004")),
    ("T1021", "Remote Services", ("TA0008",)),
    ("T1021.001", "Remote Services: Remote Desktop Protocol", ("TA0008",)),
    ("T1021.004", "Remote Services: SSH", ("TA0008",)),
    ("T1021.006", "Remote Services: Windows Remote Management", ("TA0008",)),
    ("T1570", "Lateral Tool Transfer", ("TA0008",)),
    ("T1105", "Ingress Tool Transfer", ("TA0011",)),
    ("T1071", "Application Layer Protocol", ("TA0011",)),
    ("T1071.001", "Application Layer Protocol: Web Protocols", ("TA0011",)),
    ("T1552", "Unsecured Credentials", ("TA0006",)),
    ("T1552.004", "Unsecured Credentials: Private Keys", ("TA0006",)),
    ("T1003", "OS Credential Dumping", ("TA0006",)),
    ("T1003.008", "OS Credential Dumping: /etc/passwd and /etc/shadow", ("TA0006",)),
    ("T1562", "Impair Defenses", ("TA0005",)),
    ("T1562.001", "Impair Defenses: Disable or Modify Tools", ("TA0005",)),
    ("T1562.008", "Impair Defenses: Disable or Modify Cloud Logs", ("TA0005",)),
    ("T1070", "Indicator Removal", ("TA0005",)),
    ("T1484", "Domain or Tenant Policy Modification", ("TA0003", "TA0004")),
    ("T1041", "Exfiltration Over C2 Channel", ("TA0010",)),
    ("T1567", "Exfiltration Over Web Service", ("TA0010",)),
    ("T1530", "Data from Cloud Storage", ("TA0009",)),
]


def tactics(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(TACTICS, "tactic_id string, tactic string, position int")


def techniques(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(
        [(t, n, list(x)) for t, n, x in TECHNIQUES], "technique_id string, name string, tactic_ids array<string>")


def technique_tactics(spark: SparkSession) -> DataFrame:
    """One row per (technique, tactic) with the tactic's name and kill-chain position."""
    pairs = techniques(spark).select("technique_id", "name", F.explode("tactic_ids").alias("tactic_id"))
    return pairs.join(F.broadcast(tactics(spark)), "tactic_id")


def primary_tactics(spark: SparkSession) -> DataFrame:
    """Each technique with its earliest tactic in kill-chain order."""
    return technique_tactics(spark).groupBy("technique_id").agg(
        F.first("name").alias("name"),
        F.min_by(F.struct("tactic_id", "tactic", "position"), "position").alias("p"),
    ).select("technique_id", "name", "p.*")


def unknown_techniques(used: DataFrame) -> DataFrame:
    """Technique ids in ``used.technique_id`` that the catalogue lacks."""
    known = F.broadcast(techniques(used.sparkSession).select("technique_id"))
    return used.select("technique_id").distinct().join(known, "technique_id", "left_anti")


def read_catalogue(spark: SparkSession, tactics_path: str, techniques_path: str | None = None):
    """Catalogue files (JSON arrays) as the two dimensions."""
    read = spark.read.option("multiLine", True)
    tactic_rows = read.schema("tactic_id string, name string, `order` int").json(tactics_path).select(
        "tactic_id", F.col("name").alias("tactic"), F.col("order").alias("position"))
    if techniques_path is None:
        return tactic_rows, techniques(spark)
    return tactic_rows, read.schema("technique_id string, name string, tactic_ids array<string>").json(techniques_path)
