"""The rule pack: 22 detection rules as plain configuration."""

from __future__ import annotations

from dataclasses import dataclass, field, replace


@dataclass(frozen=True)
class Step:
    name: str
    selection: dict
    min_count: int = 1
    max_gap_seconds: int | None = None
    optional: bool = False


@dataclass(frozen=True)
class Rule:
    id: str
    kind: str
    name: str
    severity: str
    confidence: float
    category: str
    techniques: tuple[str, ...]
    tactics: tuple[str, ...]
    title: str = ""
    dedup_seconds: int = 900
    selection: dict | None = None
    group_by: tuple[str, ...] = ()
    window_seconds: int | None = None
    count: int | None = None
    distinct_field: str | None = None
    distinct_count: int | None = None
    steps: tuple[Step, ...] = ()
    constraints: tuple[tuple[str, int], ...] = ()
    ioc_types: tuple[str, ...] = ()
    ioc_fields: tuple[str, ...] = ()
    detector: str | None = None
    params: dict = field(default_factory=dict)
    enabled: bool = True


_LOGIN_FAILED = {"event_type": "authentication", "status": "failure", "action": "login"}
_LOGIN_OK = {"event_type": "authentication", "status": "success", "action": "login"}
_SESSION_OK = {"event_type": "authentication", "status": "success", "action": ["login", "session_open"]}

# Ids, kinds, severities, confidences, selections, windows and technique ids.
RULES: list[Rule] = [
    Rule(
        "BRUTE_FORCE_001", "threshold", "Repeated failed logins from one address", "high", 0.80, "brute-force",
        ("T1110", "T1110.001"), ("TA0006",), "Password guessing from {source_ip}", 900,
        selection=_LOGIN_FAILED, group_by=("source_ip",), count=5, window_seconds=300,
    ),
    Rule(
        "BRUTE_FORCE_002", "threshold", "Failed logins spread over many accounts", "high", 0.85, "brute-force",
        ("T1110", "T1110.003"), ("TA0006",), "Password spray from {source_ip}", 1800,
        selection=_LOGIN_FAILED, group_by=("source_ip",), count=6, window_seconds=600,
        distinct_field="user", distinct_count=4,
    ),
    Rule(
        "BRUTE_FORCE_003", "sequence", "Login succeeds after a run of failures", "critical", 0.88, "brute-force",
        ("T1110", "T1078"), ("TA0006", "TA0001"), "Login from {source_ip} after repeated failures", 3600,
        group_by=("source_ip",), window_seconds=900,
        steps=(
            Step("repeated_failures", _LOGIN_FAILED, min_count=4),
            Step("successful_login", _LOGIN_OK, max_gap_seconds=600),
        ),
    ),
    Rule(
        "ACCOUNT_DISCOVERY_001", "threshold", "Burst of host enumeration", "medium", 0.70, "discovery",
        ("T1087", "T1087.001", "T1082", "T1033"), ("TA0007",), "Enumeration by {user} on {host}", 900,
        selection={"event_type": "discovery", "metadata.discovery_category": {"exists": True}},
        group_by=("user", "host"), count=4, window_seconds=180,
        distinct_field="metadata.discovery_category", distinct_count=3,
    ),
    Rule(
        "CLOUD_DISCOVERY_001", "threshold", "Burst of cloud inventory calls", "medium", 0.70, "discovery",
        ("T1087", "T1087.004", "T1526"), ("TA0007",), "Cloud enumeration by {user} in {cloud_account}", 1800,
        selection={"metadata.cloud_discovery": True}, group_by=("user", "cloud_account"),
        count=5, window_seconds=300, distinct_field="action", distinct_count=4,
    ),
    Rule(
        "VALID_ACCOUNT_ABUSE_001", "anomaly", "Login unlike the account's history", "medium", 0.60,
        "credential-abuse", ("T1078",), ("TA0001", "TA0003", "TA0004", "TA0005"),
        "Unusual login for {user} from {source_ip}", 3600,
        selection={"event_type": "authentication", "status": "success"},
        detector="anomalous_authentication",
        params={
            "min_observations": 8, "threshold": 0.45, "escalate_severity_at": 0.70, "weight_new_source_ip": 0.30,
            "weight_external_source": 0.25, "weight_off_hours": 0.25, "weight_new_host": 0.20,
        },
    ),
    Rule(
        "CREDENTIAL_FILE_ACCESS_001", "match", "Credential file touched", "high", 0.70, "credential-abuse",
        ("T1552", "T1552.004"), ("TA0006",), "Credential material touched on {host} by {user}", 600,
        selection={"any_of": [
            {"event_type": "file", "metadata.sensitive_file": True},
            {"event_type": ["process", "discovery"],
             "command_line": {"contains": ["/etc/shadow", "id_rsa", ".ssh/authorized_keys", "/etc/sudoers"]}},
        ]},
        group_by=("host", "user"),
    ),
    Rule(
        "IOC_MATCH_001", "ioc", "Known indicator seen", "medium", 0.85, "credential-abuse",
        ("T1071",), ("TA0011",), "", 1800,
        ioc_types=("ip", "hash", "domain", "hostname"), ioc_fields=("source_ip", "destination_ip", "file_hash"),
    ),
    Rule(
        "PRIVESC_SUID_ENUM_001", "match", "Search for setuid binaries", "medium", 0.75, "privilege-escalation",
        ("T1548", "T1548.001"), ("TA0004", "TA0007"), "Setuid search by {user} on {host}", 900,
        selection={"metadata.argument_indicators": {"contains": "suid_enumeration"}},
    ),
    Rule(
        "PRIVESC_SUDO_CHAIN_001", "sequence", "Enumeration then elevation", "high", 0.82, "privilege-escalation",
        ("T1548", "T1548.003", "T1068"), ("TA0004",), "{user} elevated on {host} after enumeration", 1800,
        group_by=("user", "host"), window_seconds=600,
        steps=(
            Step("privilege_enumeration", {"any_of": [
                {"event_type": "discovery", "metadata.discovery_category": "permission"},
                {"metadata.argument_indicators": {"contains": "suid_enumeration"}},
                {"event_type": "discovery", "process": "sudo"},
            ]}),
            Step("elevation", {"event_type": "privilege", "status": "success", "metadata.elevated": True},
                 max_gap_seconds=420),
        ),
    ),
    Rule(
        "PRIVESC_GROUP_CHANGE_001", "match", "Account joined a privileged group", "high", 0.80,
        "privilege-escalation", ("T1098", "T1078"), ("TA0004", "TA0003"),
        "{user} joined a privileged group on {host}", 600,
        selection={"event_type": "account", "action": "group_member_added", "metadata.privileged_group": True},
    ),
    Rule(
        "PRIVESC_WINDOWS_SPECIAL_PRIV_001", "match", "Sensitive privileges at logon", "high", 0.72,
        "privilege-escalation", ("T1134", "T1078"), ("TA0004", "TA0005"),
        "Sensitive privileges for {user} on {host}", 900,
        selection={
            "event_type": "privilege", "metadata.windows_event_id": 4672,
            "metadata.privileges": {"contains": ["SeDebugPrivilege", "SeTcbPrivilege", "SeLoadDriverPrivilege"]},
        },
    ),
    Rule(
        "PERSISTENCE_SCHEDULED_TASK_001", "match", "Autostart location written", "high", 0.78, "persistence",
        ("T1053", "T1053.003", "T1543", "T1543.002", "T1098.004"), ("TA0003", "TA0002"),
        "Autostart entry on {host}: {file_path}", 600,
        selection={"event_type": "file", "action": ["create", "modify", "write"], "metadata.persistence_path": True},
        group_by=("host", "metadata.persistence_mechanism"),
    ),
    Rule(
        "PERSISTENCE_BACKDOOR_ACCOUNT_001", "match", "Second root account", "critical", 0.92, "persistence",
        ("T1136", "T1136.001"), ("TA0003",), "UID 0 account {user} on {host}", 300,
        selection={"event_type": "account", "action": "account_created", "metadata.uid_zero": True},
    ),
    Rule(
        "PERSISTENCE_SERVICE_INSTALL_001", "match", "New service installed", "medium", 0.65, "persistence",
        ("T1543", "T1543.003"), ("TA0003", "TA0004"), "New service on {host}", 900,
        selection={"event_type": "service", "action": "service_installed"},
    ),
    Rule(
        "LATERAL_MOVEMENT_001", "sequence", "Login, internal connection, login elsewhere", "high", 0.84,
        "lateral-movement", ("T1021", "T1021.004", "T1078"), ("TA0008",), "{user} moved between hosts", 3600,
        group_by=("user",), window_seconds=1200,
        steps=(
            Step("initial_access", _SESSION_OK),
            Step("internal_remote_connection",
                 {"event_type": "network", "metadata.internal_lateral_candidate": True}, max_gap_seconds=900),
            Step("second_host_access", _SESSION_OK, max_gap_seconds=900),
        ),
        constraints=(("host", 2),),
    ),
    Rule(
        "LATERAL_BREADTH_001", "threshold", "Account logged in to many hosts", "high", 0.76, "lateral-movement",
        ("T1021", "T1078"), ("TA0008",), "{user} logged in to many hosts", 3600,
        selection=_SESSION_OK, group_by=("user",), count=4, window_seconds=900,
        distinct_field="host", distinct_count=4,
    ),
    Rule(
        "LATERAL_TOOL_TRANSFER_001", "match", "Remote download run", "medium", 0.62, "lateral-movement",
        ("T1105", "T1570"), ("TA0011", "TA0008"), "Remote download by {user} on {host}", 900,
        selection={"event_type": ["process", "discovery"],
                   "metadata.argument_indicators": {"contains": "remote_download"}},
    ),
    Rule(
        "CLOUD_IAM_PRIVESC_001", "match", "Administrative policy attached", "critical", 0.88, "cloud-iam",
        ("T1098", "T1098.003", "T1078.004"), ("TA0004", "TA0003"),
        "Administrative policy for {user} in {cloud_account}", 600,
        selection={"metadata.iam_category": "privilege_grant", "metadata.high_risk_policy": True,
                   "status": "success"},
    ),
    Rule(
        "CLOUD_LOG_TAMPERING_001", "match", "Audit logging changed", "critical", 0.90, "cloud-iam",
        ("T1562", "T1562.008"), ("TA0005",), "Audit logging changed by {user} ({action})", 300,
        selection={"metadata.iam_category": "defense_evasion", "status": "success"},
    ),
    Rule(
        "CLOUD_IAM_KEY_CHAIN_001", "sequence", "Cloud enumeration then new credentials", "critical", 0.86,
        "cloud-iam", ("T1098", "T1098.001", "T1136.003"), ("TA0003", "TA0004"),
        "New credentials after enumeration by {user} in {cloud_account}", 1800,
        group_by=("user", "cloud_account"), window_seconds=1800,
        steps=(
            Step("cloud_enumeration", {"metadata.cloud_discovery": True}, min_count=2),
            Step("credential_creation",
                 {"metadata.iam_category": ["credential_creation", "credential_modification"], "status": "success"},
                 max_gap_seconds=1200),
        ),
    ),
    Rule(
        "CLOUD_IAM_ANOMALY_001", "anomaly", "Cloud call unlike the identity's history", "high", 0.70, "cloud-iam",
        ("T1078", "T1078.004"), ("TA0004", "TA0005"), "Unusual cloud activity by {user} in {cloud_account}", 1800,
        selection={"cloud_account": {"exists": True}}, detector="unusual_cloud_api_for_identity",
        params={"min_observations": 10, "threshold": 0.50, "escalate_severity_at": 0.85},
    ),
]


def rules_of(kind: str, rules: list[Rule] | None = None) -> list[Rule]:
    return [r for r in (RULES if rules is None else rules) if r.kind == kind and r.enabled]


def rule(rule_id: str, rules: list[Rule] | None = None) -> Rule:
    return next(r for r in (RULES if rules is None else rules) if r.id == rule_id)


def stretched(factor: int, rules: list[Rule] | None = None) -> list[Rule]:
    """The pack with every window, gap and dedup period multiplied.

    For feeds whose clock runs slower than live telemetry; selections, counts and groupings stay as they
    are.
    """
    out = []
    for r in RULES if rules is None else rules:
        steps = tuple(
            replace(s, max_gap_seconds=s.max_gap_seconds * factor if s.max_gap_seconds else None) for s in r.steps
        )
        out.append(replace(
            r, steps=steps, dedup_seconds=r.dedup_seconds * factor,
            window_seconds=r.window_seconds * factor if r.window_seconds else None,
        ))
    return out
