"""Attack knowledge: anomaly type to tactic, technique, severity and advice."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

KNOWLEDGE_COLUMNS = [
    "anomaly_type", "tactic", "tactic_id", "technique", "technique_id",
    "description", "severity", "recommended_action",
]

# ---- fixed values: the attack knowledge table, in the order of KNOWLEDGE_COLUMNS -----------------
KNOWLEDGE = [
    ("brute_force", "Credential Access", "TA0006", "Brute Force", "T1110",
     "Multiple failed authentication attempts detected, indicating a brute force attack.", "high",
     "Block source IP, enforce account lockout policy, enable MFA."),
    ("privilege_escalation", "Privilege Escalation", "TA0004", "Sudo and Sudo Caching", "T1548.003",
     "Unauthorized privilege escalation attempt detected via sudo or su.", "critical",
     "Audit sudoers file, review PAM configuration, alert security team."),
    ("invalid_user", "Reconnaissance", "TA0043", "Active Scanning", "T1595",
     "Login attempts using non-existent usernames, indicating user enumeration.", "medium",
     "Enable fail2ban, review SSH configuration, monitor for patterns."),
    ("auth_failure", "Credential Access", "TA0006", "Valid Accounts", "T1078",
     "Authentication failure with valid username, possible credential stuffing.", "high",
     "Reset credentials, enforce MFA, review account access logs."),
    ("unauthorized_access", "Initial Access", "TA0001", "Exploit Public-Facing Application", "T1190",
     "Unauthorized access attempt to restricted web resource.", "medium",
     "Review WAF rules, audit access controls, patch vulnerable endpoints."),
    ("path_traversal", "Discovery", "TA0007", "File and Directory Discovery", "T1083",
     "Path traversal attack detected attempting to access sensitive files.", "high",
     "Patch application, sanitize inputs, review file access controls."),
    ("sqli", "Collection", "TA0009", "Data from Local System", "T1005",
     "SQL injection attempt detected in HTTP request.", "critical",
     "Enable WAF SQLi rules, use parameterized queries, audit DB access."),
    ("web_shell", "Persistence", "TA0003", "Server Software Component: Web Shell", "T1505.003",
     "Web shell execution detected via HTTP request with command parameter.", "critical",
     "Remove web shell immediately, audit web root, forensic analysis required."),
    ("cpu_spike", "Impact", "TA0040", "Resource Hijacking", "T1496",
     "Abnormal CPU utilization spike, possible cryptomining or DoS.", "high",
     "Identify and terminate offending process, check for malware."),
    ("memory_leak", "Impact", "TA0040", "Endpoint Denial of Service", "T1499",
     "Abnormal memory consumption detected, possible memory leak or malware.", "medium",
     "Restart affected service, analyze heap dumps, patch application."),
    ("network_exfiltration", "Exfiltration", "TA0010", "Exfiltration Over C2 Channel", "T1041",
     "Abnormally high outbound network traffic detected, possible data exfiltration.", "critical",
     "Block outbound connection, preserve evidence, initiate IR process."),
    ("disk_flood", "Impact", "TA0040", "Data Destruction", "T1485",
     "Abnormal disk I/O detected, possible ransomware encryption or log wiping.", "critical",
     "Isolate host, preserve disk image, check for ransomware indicators."),
    ("connection_storm", "Impact", "TA0040", "Network Denial of Service", "T1498",
     "Abnormal number of open connections, possible DoS attack or botnet activity.", "high",
     "Enable rate limiting, activate DDoS protection, block source ranges."),
    ("process_bomb", "Impact", "TA0040", "Resource Hijacking", "T1496",
     "Abnormal process count detected, possible fork bomb or malware spawning.", "critical",
     "Kill runaway processes, check for fork bombs, isolate host."),
    ("port_scan", "Discovery", "TA0007", "Network Service Discovery", "T1046",
     "Port scanning activity detected from external source.", "medium",
     "Block scanning IP, review firewall rules, monitor for follow-up activity."),
    ("c2_beacon", "Command and Control", "TA0011", "Application Layer Protocol", "T1071",
     "Regular beaconing pattern detected to suspicious external IP, possible C2.", "critical",
     "Block C2 IP, isolate infected host, full forensic analysis required."),
    ("lateral_movement", "Lateral Movement", "TA0008", "Remote Services", "T1021",
     "Internal host connecting to multiple hosts on admin ports, possible lateral movement.", "critical",
     "Isolate source host, reset credentials, audit all affected systems."),
    ("data_exfiltration", "Exfiltration", "TA0010", "Exfiltration Over Alternative Protocol", "T1048",
     "Large volume data transfer to external IP detected.", "critical",
     "Block transfer, preserve network logs, notify data protection officer."),
    ("dns_tunneling", "Command and Control", "TA0011", "Protocol Tunneling", "T1572",
     "High-volume DNS queries with large payloads, possible DNS tunneling.", "high",
     "Block suspicious DNS resolver, deploy DNS monitoring, inspect traffic."),
]
UNKNOWN = (
    None, "Unknown", "N/A", "Unknown Technique", "N/A",
    "Anomaly detected but no MITRE ATT&CK mapping available.", "medium",
    "Investigate manually and correlate with other indicators.",
)


def knowledge(spark: SparkSession) -> DataFrame:
    schema = T.StructType([T.StructField(c, T.StringType()) for c in KNOWLEDGE_COLUMNS])
    return spark.createDataFrame(KNOWLEDGE, schema)


def attach_attack_knowledge(df: DataFrame, key: str = "anomaly_type", prefix: str = "") -> DataFrame:
    """Left join to the knowledge table; an unknown or null type gets the 'Unknown' row.

    The broadcast side is the table above, whose size is fixed by the code.
    """
    table = knowledge(df.sparkSession).withColumnsRenamed(
        {c: f"_kb_{c}" for c in KNOWLEDGE_COLUMNS}
    )
    joined = df.join(F.broadcast(table), F.col(key) == F.col("_kb_anomaly_type"), "left")
    filled = {
        f"{prefix}{c}": F.coalesce(F.col(f"_kb_{c}"), F.lit(default))
        for c, default in zip(KNOWLEDGE_COLUMNS[1:], UNKNOWN[1:])
    }
    return joined.withColumns(filled).drop(*[f"_kb_{c}" for c in KNOWLEDGE_COLUMNS])


def distinct_tactics(table: DataFrame) -> DataFrame:
    return table.select("tactic").distinct().orderBy("tactic")


def by_tactic(table: DataFrame, tactic: str) -> DataFrame:
    return table.where(F.col("tactic") == tactic)
