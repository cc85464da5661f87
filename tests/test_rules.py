"""Every rule of the pack on events it must and must not fire on, all cases in one detection job."""

from dataclasses import replace

import pytest

from eventwarden.operators.baseline import FEATURES
from eventwarden.plans.detect import collect_evidence, summarise
from eventwarden.plans.rulepack import RULES

IP = "203.0.113.44"


def login(at, ok, user="admin", ip=IP, host="LINUX-03", action="login"):
    return {"at": at, "event_type": "authentication", "action": action, "status": "success" if ok else "failure",
            "user": user, "source_ip": ip, "host": host}


def command(at, process, category=None, indicators=None, line=None, kind="discovery"):
    meta = {"discovery_category": category, "argument_indicators": indicators}
    return {"at": at, "event_type": kind, "action": "exec", "status": "success", "user": "admin", "host": "LINUX-03", "process": process,
            "command_line": line, "metadata": meta}


def cloud(at, action, kind="cloud_audit", status="success", user="dev-admin", ip="198.51.100.77", **meta):
    return {"at": at, "event_type": kind, "action": action, "status": status, "user": user, "cloud_account": "123", "source_ip": ip, "metadata": meta}


def host_event(kind, action, status="success", path=None, process=None, **meta):
    return {"at": 0, "event_type": kind, "action": action, "status": status, "host": "LINUX-03", "user": "svc", "file_path": path,
            "process": process, "metadata": meta}


def flow(at, src, dst, port, **meta):
    return {"at": at, "event_type": "network", "action": "allow", "status": "success", "host": "LINUX-03", "user": "admin", "source_ip": src,
            "destination_ip": dst, "destination_port": port, "metadata": meta}


def fails(times, **k):
    return [login(t, False, **k) for t in times]


SPRAY = [login(35 * i, False, user=u, ip="198.51.100.23") for i, u in enumerate(("a", "b", "c", "d", "e", "f"))]
LIST5 = ("ListUsers", "ListRoles", "ListPolicies", "ListAccessKeys", "GetAccountSummary")
HOP = flow(120, "10.20.4.31", "10.20.4.52", 22, internal_lateral_candidate=True)
HOSTS = ("LINUX-03", "LINUX-07", "LINUX-11", "WIN-APP-01")

# (rule, case, fires, events)
CASES = [
    ("BRUTE_FORCE_001", "five inside the window", True, fails((0, 20, 41, 62, 90))),
    ("BRUTE_FORCE_001", "four", False, fails((0, 20, 41, 62))),
    ("BRUTE_FORCE_001", "spread out", False, fails((0, 400, 800, 1200, 1600))),
    ("BRUTE_FORCE_001", "successes", False, [login(t, True) for t in (0, 20, 41, 62, 90)]),
    ("BRUTE_FORCE_002", "six accounts", True, SPRAY),
    ("BRUTE_FORCE_002", "one account", False, [dict(e, user="alice") for e in SPRAY]),
    ("BRUTE_FORCE_003", "then a success", True, [*fails((0, 18, 39, 61)), login(84, True)]),
    ("BRUTE_FORCE_003", "success first", False, [login(0, True), *fails((18, 39, 61, 84))]),
    ("BRUTE_FORCE_003", "another address", False, [*fails((0, 18, 39, 61)), login(84, True, ip="10.20.4.31")]),
    ("ACCOUNT_DISCOVERY_001", "three categories", True, [
        command(0, "whoami", "account"), command(11, "id", "account"), command(23, "uname", "system"), command(38, "netstat", "network")]),
    ("ACCOUNT_DISCOVERY_001", "one category", False, [command(t, "id", "account") for t in (0, 11, 23, 38)]),
    ("CLOUD_DISCOVERY_001", "five calls", True, [cloud(12 * i, a, "discovery", cloud_discovery=True) for i, a in enumerate(LIST5)]),
    ("CLOUD_DISCOVERY_001", "two calls polled", False, [
        cloud(12 * i, a, "discovery", cloud_discovery=True) for i, a in enumerate(["GetCallerIdentity"] * 3 + ["ListBuckets"] * 2)]),
    ("VALID_ACCOUNT_ABUSE_001", "new external address", True, [login(43200, True, user="acct-a")]),
    ("VALID_ACCOUNT_ABUSE_001", "new address alone", False, [login(0, True, user="acct-b")]),
    ("VALID_ACCOUNT_ABUSE_001", "too little history", False, [login(43200, True, user="newhire", host="LINUX-09")]),
    ("CREDENTIAL_FILE_ACCESS_001", "shadow file", True, [command(0, "cat", line="cat /etc/shadow", kind="process")]),
    ("CREDENTIAL_FILE_ACCESS_001", "log file", False, [command(0, "cat", line="cat /var/log/app.log", kind="process")]),
    ("IOC_MATCH_001", "known address", True, [flow(0, "10.20.4.31", IP, 443)]),
    ("IOC_MATCH_001", "other address", False, [flow(0, "10.20.4.31", "10.20.4.52", 443)]),
    ("PRIVESC_SUID_ENUM_001", "setuid search", True, [command(0, "find", "permission", ["suid_enumeration"])]),
    ("PRIVESC_SUID_ENUM_001", "plain find", False, [command(0, "find", "permission")]),
    ("PRIVESC_SUDO_CHAIN_001", "search then root", True, [
        command(0, "find", "permission", ["suid_enumeration"]), {**login(47, True, action="sudo"), "event_type": "privilege", "metadata": {"elevated": True}}]),
    ("PRIVESC_SUDO_CHAIN_001", "root alone", False, [{**login(0, True, action="sudo"), "event_type": "privilege", "metadata": {"elevated": True}}]),
    ("PRIVESC_GROUP_CHANGE_001", "sudo group", True, [host_event("account", "group_member_added", privileged_group=True)]),
    ("PRIVESC_GROUP_CHANGE_001", "plain group", False, [host_event("account", "group_member_added", privileged_group=False)]),
    ("PRIVESC_WINDOWS_SPECIAL_PRIV_001", "debug privilege", True, [
        host_event("privilege", "special_privileges_assigned", windows_event_id=4672, privileges=["SeDebugPrivilege", "SeTcbPrivilege"])]),
    ("PRIVESC_WINDOWS_SPECIAL_PRIV_001", "routine privilege", False, [
        host_event("privilege", "special_privileges_assigned", windows_event_id=4672, privileges=["SeChangeNotifyPrivilege"])]),
    ("PERSISTENCE_SCHEDULED_TASK_001", "cron file", True, [
        host_event("file", "create", path="/etc/cron.d/x", persistence_path=True, persistence_mechanism="cron")]),
    ("PERSISTENCE_SCHEDULED_TASK_001", "unit file", True, [
        host_event("file", "create", path="/etc/systemd/system/x.service", persistence_path=True, persistence_mechanism="systemd_service")]),
    ("PERSISTENCE_SCHEDULED_TASK_001", "report file", False, [host_event("file", "create", path="/var/tmp/report.csv")]),
    ("PERSISTENCE_BACKDOOR_ACCOUNT_001", "uid 0", True, [host_event("account", "account_created", uid=0, uid_zero=True)]),
    ("PERSISTENCE_BACKDOOR_ACCOUNT_001", "uid 1042", False, [host_event("account", "account_created", uid=1042, uid_zero=False)]),
    ("PERSISTENCE_SERVICE_INSTALL_001", "installed", True, [host_event("service", "service_installed", windows_event_id=7045)]),
    ("PERSISTENCE_SERVICE_INSTALL_001", "started", False, [host_event("process", "process_created", process="services.exe")]),
    ("LATERAL_MOVEMENT_001", "second host", True, [login(0, True), HOP, login(150, True, ip="10.20.4.31", host="LINUX-07")]),
    ("LATERAL_MOVEMENT_001", "same host", False, [login(0, True), HOP, login(150, True, ip="10.20.4.31")]),
    ("LATERAL_BREADTH_001", "four hosts", True, [login(90 * i, True, ip="10.20.4.31", host=h) for i, h in enumerate(HOSTS)]),
    ("LATERAL_BREADTH_001", "one host", False, [login(90 * i, True, ip="10.20.4.31") for i in range(4)]),
    ("LATERAL_TOOL_TRANSFER_001", "download", True, [command(0, "curl", indicators=["remote_download"], kind="process")]),
    ("LATERAL_TOOL_TRANSFER_001", "unpacking", False, [command(0, "tar", kind="process")]),
    ("CLOUD_IAM_PRIVESC_001", "admin policy", True, [cloud(0, "AttachUserPolicy", "privilege", iam_category="privilege_grant", high_risk_policy=True)]),
    ("CLOUD_IAM_PRIVESC_001", "read-only policy", False, [cloud(0, "AttachUserPolicy", "privilege", iam_category="privilege_grant", high_risk_policy=False)]),
    ("CLOUD_LOG_TAMPERING_001", "logging stopped", True, [cloud(0, "StopLogging", iam_category="defense_evasion", iam_risk="critical")]),
    ("CLOUD_LOG_TAMPERING_001", "trail read", False, [cloud(0, "DescribeTrails", read_only=True)]),
    ("CLOUD_LOG_TAMPERING_001", "attempt denied", False, [cloud(0, "StopLogging", status="failure", iam_category="defense_evasion")]),
    ("CLOUD_IAM_KEY_CHAIN_001", "two lists then a key", True, [
        cloud(0, "ListUsers", "discovery", cloud_discovery=True), cloud(40, "ListAccessKeys", "discovery", cloud_discovery=True),
        cloud(180, "CreateAccessKey", "privilege", iam_category="credential_creation")]),
    ("CLOUD_IAM_KEY_CHAIN_001", "key alone", False, [cloud(0, "CreateAccessKey", "privilege", iam_category="credential_creation")]),
    ("CLOUD_IAM_ANOMALY_001", "all factors", True, [
        cloud(43200, "AttachUserPolicy", "privilege", user="dev-a", ip=IP, iam_category="privilege_grant", iam_risk="critical", high_risk_policy=True,
              mfa_authenticated=False, policy="arn:aws:iam::aws:policy/AdministratorAccess")]),
    ("CLOUD_IAM_ANOMALY_001", "routine call", False, [
        cloud(0, "ListUsers", "discovery", user="dev-b", ip="198.51.100.10", cloud_discovery=True, read_only=True, mfa_authenticated=True)]),
]

BASELINES = [
    *[("acct-a", f, v, 40, 40) for f, v in (("source_ips", "10.20.4.31"), ("login_hours", "14"), ("hosts", "linux-03"))],
    ("acct-b", "source_ips", "10.20.4.31", 30, 40), ("acct-b", "source_ips", "198.51.100.10", 10, 40),
    ("acct-b", "login_hours", "14", 40, 40), ("acct-b", "hosts", "linux-03", 40, 40),
    ("newhire", "source_ips", "10.20.4.31", 3, 3), ("newhire", "login_hours", "14", 3, 3),
    *[(u, f, v, n, 40) for u in ("dev-a", "dev-b") for f, v, n in (
        ("cloud_apis", "listusers", 30), ("cloud_apis", "getcalleridentity", 10), ("cloud_hours", "14", 40), ("source_ips", "198.51.100.10", 40))],
]


@pytest.fixture(scope="module")
def fired(spark, make_events):
    events = []
    for rule_id, case, _, rows in CASES:
        events += [{**row, "label_scenario": f"{rule_id}/{case}"} for row in rows]
    df = make_events(events)
    rules = [replace(r, group_by=(*r.group_by, "label_scenario")) if r.kind in ("threshold", "sequence") else r for r in RULES]
    indicators = spark.createDataFrame([("IOC-1", IP, "ip", 0.9, "high", "fixture", "", ["c2"], True)], (
        "ioc_id string, indicator string, ioc_type string, confidence double, severity string, source string, description string, tags array<string>, is_active boolean"))
    stored = spark.createDataFrame(BASELINES, "entity_ref string, feature string, value string, n bigint, observation_count bigint")
    evidence = collect_evidence(df, rules, indicators, stored=stored).cache()
    scenario = df.select("event_id", "label_scenario")
    pairs = {(r.rule_id, r.label_scenario) for r in evidence.join(scenario, "event_id").select("rule_id", "label_scenario").distinct().collect()}
    return pairs, {r.rule_id: r for r in summarise(evidence, rules).collect()}


def test_pack_has_both_kinds_of_cases():
    assert len(RULES) == 22 and len(CASES) == 50
    assert {r.id for r in RULES} == {c[0] for c in CASES if c[2]} == {c[0] for c in CASES if not c[2]}
    assert set(FEATURES) >= {b[1] for b in BASELINES}


@pytest.mark.parametrize("case", CASES, ids=[f"{c[0]}-{c[1]}" for c in CASES])
def test_rule_case(fired, case):
    rule_id, name, fires, _ = case
    assert ((rule_id, f"{rule_id}/{name}") in fired[0]) == fires


def test_detection_values(fired):
    rows = fired[1]
    assert rows["BRUTE_FORCE_001"].confidence == 0.8 and rows["BRUTE_FORCE_001"].evidence_count == 5
    # four failures and a success over 84 of 900 seconds
    assert rows["BRUTE_FORCE_003"].confidence == pytest.approx(0.971, abs=0.0011)
    assert rows["IOC_MATCH_001"].confidence == 0.865 and rows["IOC_MATCH_001"].severity == "high"
    assert rows["VALID_ACCOUNT_ABUSE_001"].anomaly_score == 0.55 and rows["VALID_ACCOUNT_ABUSE_001"].severity == "medium"
    # new call, risky call, admin policy, new address, no second factor
    assert rows["CLOUD_IAM_ANOMALY_001"].anomaly_score == 1.0 and rows["CLOUD_IAM_ANOMALY_001"].severity == "critical"
    assert rows["BRUTE_FORCE_003"].title == f"Login from {IP} after repeated failures"
