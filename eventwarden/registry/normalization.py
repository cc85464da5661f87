"""Raw records of every source, built from the event table, normalized and validated."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from eventwarden.model import micros
from eventwarden.plans.desk import desk
from eventwarden.registry.base import query
from eventwarden.registry.sql import with_ev
from eventwarden.session import work_folder
from eventwarden.sources.inventory import guess_os, guess_user_type, upsert_inventory
from eventwarden.sources.normalize import NORMALIZERS, normalize
from eventwarden.sources.raw import raw_records, read_raw


def _source(spark, sf_dir, *sources: str):
    raw = raw_records(desk(spark, sf_dir).events).filter(F.col("source").isin(list(sources)))
    now = F.lit("2024-02-01 00:00:00").cast("timestamp")
    return normalize(raw, now, list(sources))


@query("raw_repeated_lines", with_ev("SELECT event_type, 2 * count(*) AS records, 2 * count(*) AS ids FROM ev GROUP BY event_type"))
def raw_repeated_lines(spark, sf_dir):
    """Raw files that hold every line twice: equal lines stay separate records."""
    line = F.to_json(F.struct("event_id", "event_type"))
    lines = desk(spark, sf_dir).events.select(line.alias("value"))
    path = f"{work_folder(spark)}/repeated-lines-{uuid.uuid4().hex}"
    lines.union(lines).repartition(4, "value").write.text(path)
    raw = read_raw(spark, path, "normalized")
    return raw.groupBy(F.get_json_object("record", "$.event_type").alias("event_type")).agg(
        F.count("*").alias("records"), F.count_distinct("record_id").alias("ids"))


_meta = lambda k: F.col(f"metadata.`{k}`").alias(k)
_who = "coalesce(\"user\", 'ghost')"
_fail = "(event_type = 'authentication' AND status = 'failure')"
_ok = "(event_type = 'authentication' AND status = 'success')"


@query("norm_linux_auth", with_ev(f"""
SELECT 'linux_auth:' || e AS record_id, us, event_type, e % 50 = 0 AS ts_fallback,
  CASE WHEN {_fail} THEN ['login', 'login', 'login', 'login', 'disconnect', 'unparsed'][e % 6 + 1] WHEN {_ok} THEN ['login', 'session_open', 'unparsed'][e % 3 + 1]
    WHEN event_type = 'privilege' THEN ['sudo', 'sudo', 'su', 'su'][e % 4 + 1] ELSE ['account_created', 'group_member_added', 'password_changed'][e % 3 + 1] END AS action,
  CASE WHEN {_fail} THEN ['failure', 'failure', 'failure', 'failure', 'unknown', 'unknown'][e % 6 + 1] WHEN {_ok} THEN ['success', 'success', 'unknown'][e % 3 + 1]
    WHEN event_type = 'privilege' THEN ['success', 'failure', 'success', 'failure'][e % 4 + 1] ELSE 'success' END AS status,
  CASE WHEN ({_fail} AND e % 6 = 5) OR ({_ok} AND e % 3 = 2) THEN NULL ELSE {_who} END AS "user",
  CASE WHEN ({_fail} AND e % 6 < 5) OR ({_ok} AND e % 3 = 0) THEN source_ip END AS source_ip,
  CASE WHEN ({_fail} AND e % 6 < 2) OR ({_ok} AND e % 3 = 0) THEN 40000 + k END::BIGINT AS port, k::BIGINT AS process_id,
  CASE WHEN {_fail} AND e % 6 < 2 THEN ['password', 'publickey'][e % 6 + 1] WHEN {_ok} AND e % 3 = 0 THEN 'password' END AS auth_method,
  CASE WHEN {_fail} AND e % 6 < 2 THEN e % 6 = 1 WHEN {_fail} AND e % 6 = 3 THEN TRUE END AS invalid_user,
  CASE WHEN {_fail} AND e % 6 = 2 THEN 'max_auth_attempts' WHEN event_type = 'privilege' AND e % 4 = 1 THEN 'user NOT in sudoers' END AS reason,
  CASE WHEN event_type = 'privilege' THEN CASE e % 4 WHEN 0 THEN TRUE WHEN 2 THEN TRUE WHEN 3 THEN FALSE END END AS elevated,
  CASE WHEN event_type = 'privilege' AND e % 4 = 0 THEN '/bin/bash -c id' END AS command_line,
  CASE WHEN event_type = 'account' AND e % 3 = 0 THEN e % 2 = 0 END AS uid_zero,
  CASE WHEN event_type = 'account' AND e % 3 = 1 THEN e % 2 = 0 END AS privileged_group
FROM ev WHERE event_type IN ('authentication', 'privilege', 'account')"""))
def norm_linux_auth(spark, sf_dir):
    return _source(spark, sf_dir, "linux_auth").select(
        "record_id", micros().alias("us"), "event_type", "ts_fallback", "action", "status", "user", "source_ip",
        F.col("destination_port").cast("bigint").alias("port"), "process_id", _meta("auth_method"), _meta("invalid_user"), _meta("reason"),
        _meta("elevated"), "command_line", _meta("uid_zero"), _meta("privileged_group"))


@query("norm_windows", with_ev(f"""
SELECT 'windows_security:' || e AS record_id, us,
  CASE WHEN e % 41 = 0 THEN 'authentication' ELSE event_type END AS event_type,
  CASE WHEN e % 41 = 0 THEN NULL WHEN event_type = 'authentication' THEN 'login' WHEN event_type = 'privilege' THEN 'special_privileges_assigned'
    WHEN event_type = 'service' THEN 'service_installed' ELSE ['account_created', 'group_member_added', 'password_reset'][e % 3 + 1] END AS action,
  CASE WHEN e % 41 = 0 THEN 'unknown' ELSE status END AS status,
  CASE WHEN event_type = 'account' AND e % 3 = 1 AND (e % 5 = 0 OR e % 41 = 0) THEN CASE WHEN e % 2 = 0 THEN 'Administrators' ELSE 'Developers' END ELSE {_who} END AS "user",
  CASE WHEN e % 7 <> 0 THEN source_ip END AS source_ip, (40000 + k)::BIGINT AS port,
  CASE WHEN event_type = 'service' THEN 500 END::BIGINT AS process_id,
  CASE k % 4 WHEN 0 THEN 'network' WHEN 1 THEN 'remote_interactive' WHEN 2 THEN '99' END AS logon_type_name,
  CASE WHEN {_fail} AND e % 41 <> 0 THEN CASE WHEN e % 2 = 0 THEN 'bad_password' ELSE '0xc0000099' END END AS failure_reason,
  CASE WHEN event_type = 'privilege' AND e % 41 <> 0 THEN 'SeDebugPrivilege,SeChangeNotifyPrivilege' END AS privileges,
  CASE WHEN event_type = 'account' AND e % 3 = 1 AND e % 41 <> 0 THEN e % 2 = 0 END AS privileged_group,
  CASE WHEN e % 41 = 0 THEN 'windows_security record has no numeric EventID' ELSE '' END AS reasons
FROM ev WHERE event_type IN ('authentication', 'privilege', 'account') OR (event_type = 'service' AND (e % 2 = 0 OR e % 41 = 0))"""))
def norm_windows(spark, sf_dir):
    return _source(spark, sf_dir, "windows_security").select(
        "record_id", micros().alias("us"), "event_type", "action", "status", "user", "source_ip",
        F.col("destination_port").cast("bigint").alias("port"), "process_id", _meta("logon_type_name"), _meta("failure_reason"),
        F.array_join("metadata.privileges", ",").alias("privileges"), _meta("privileged_group"), F.array_join("reasons", ";").alias("reasons"))


@query("norm_edr", with_ev(f"""
SELECT CASE WHEN e % 10 = 0 THEN 'linux_auditd:' ELSE 'edr_process:' END || e AS record_id, us,
  CASE WHEN e % 3 = 0 THEN 'process' ELSE 'discovery' END AS event_type, host, {_who} AS "user", k::BIGINT AS process_id, 'bash' AS parent_process,
  CASE WHEN e % 2 = 0 THEN 'exec' ELSE 'process_created' END AS action, CASE WHEN k % 9 = 0 THEN 'failure' ELSE 'success' END AS status,
  CASE WHEN e % 3 = 0 THEN 'python3' WHEN k % 3 = 0 THEN 'net' ELSE process END AS base_name,
  CASE WHEN e % 3 = 0 THEN NULL WHEN k % 3 = 0 THEN 'account' ELSE m_discovery_category END AS discovery_category,
  CASE WHEN e % 3 = 0 THEN TRUE END AS interpreter, coalesce(m_indicator, '') AS argument_indicators
FROM ev WHERE event_type = 'discovery'"""))
def norm_edr(spark, sf_dir):
    return _source(spark, sf_dir, "edr_process", "linux_auditd").select(
        "record_id", micros().alias("us"), "event_type", "host", "user", "process_id", "parent_process", "action", "status", _meta("base_name"),
        _meta("discovery_category"), _meta("interpreter"), F.coalesce(F.array_join("metadata.argument_indicators", ","), F.lit("")).alias("argument_indicators"))


@query("norm_flow", with_ev("""
SELECT 'network_flow:' || e AS record_id, us, CASE WHEN e % 47 <> 0 AND e % 45 <> 0 THEN source_ip END AS source_ip,
  CASE WHEN e % 47 = 0 THEN NULL WHEN k % 5 = 0 THEN '203.0.113.' || k ELSE destination_ip END AS destination_ip, destination_port::BIGINT AS port, bytes_out,
  CASE WHEN k % 7 = 0 THEN 'deny' ELSE 'allow' END AS action, CASE WHEN k % 7 = 0 THEN 'failure' ELSE 'success' END AS status,
  m_service AS service, CASE WHEN e % 4 <> 1 THEN TRUE END AS remote_admin_protocol,
  CASE WHEN e % 47 = 0 OR e % 45 = 0 THEN NULL ELSE k < 70 END AS source_is_private,
  CASE WHEN e % 47 <> 0 AND e % 45 <> 0 AND k < 70 AND k % 5 <> 0 AND e % 4 <> 1 THEN TRUE END AS internal_lateral_candidate,
  CASE WHEN e % 47 <> 0 AND e % 45 <> 0 AND k < 70 AND k % 5 = 0 THEN TRUE END AS outbound_external,
  CASE WHEN e % 47 = 0 THEN 'network_flow record has no source or destination IP' WHEN e % 45 = 0 THEN 'invalid source_ip' ELSE '' END AS reasons
FROM ev WHERE event_type = 'network'"""))
def norm_flow(spark, sf_dir):
    return _source(spark, sf_dir, "network_flow").select(
        "record_id", micros().alias("us"), "source_ip", "destination_ip", F.col("destination_port").cast("bigint").alias("port"), "bytes_out",
        "action", "status", _meta("service"), _meta("remote_admin_protocol"), _meta("source_is_private"), _meta("internal_lateral_candidate"),
        _meta("outbound_external"), F.array_join("reasons", ";").alias("reasons"))


@query("norm_file", with_ev(r"""
SELECT 'file_integrity:' || e AS record_id, us, p AS file_path, 'modify' AS action,
  ['cron', 'ssh_authorized_keys', 'credential_file', 'sudoers', NULL, 'systemd_service', 'scheduled_task', 'shell_profile'][e % 8 + 1] AS persistence_mechanism,
  CASE WHEN e % 8 = 2 THEN TRUE END AS sensitive_file, CASE WHEN k % 3 = 0 THEN TRUE END AS setuid, k::BIGINT AS size, file_hash
FROM (SELECT *, ['/etc/cron.d/sync', '/home/a/.ssh/authorized_keys', '/etc/shadow', '/etc/sudoers.d/ops', '/var/tmp/report.csv',
  '/usr/lib/systemd/system/x.service', 'C:\Windows\System32\Tasks\Upd', '/root/.bashrc'][e % 8 + 1] AS p FROM ev WHERE event_type = 'file')"""))
def norm_file(spark, sf_dir):
    return _source(spark, sf_dir, "file_integrity").select(
        "record_id", micros().alias("us"), "file_path", "action", _meta("persistence_mechanism"), _meta("sensitive_file"), _meta("setuid"),
        _meta("size"), "file_hash")


@query("norm_cloud", with_ev(f"""
SELECT 'cloud_audit:' || e AS record_id, us,
  CASE WHEN action IN ('AttachUserPolicy', 'CreateAccessKey') THEN 'privilege' WHEN k >= 10 THEN 'discovery' ELSE 'cloud_audit' END AS event_type,
  {_who} AS "user", CASE WHEN e % 6 <> 0 THEN source_ip END AS source_ip, cloud_account, 'iam' AS cloud_service, action, CASE WHEN k % 7 = 0 THEN 'failure' ELSE 'success' END AS status,
  CASE WHEN action = 'AttachUserPolicy' THEN CASE WHEN e % 2 = 0 THEN 'arn:aws:iam::aws:policy/AdministratorAccess' ELSE 'ReadOnlyAccess' END
       WHEN action = 'CreateAccessKey' THEN {_who} END AS cloud_resource,
  CASE WHEN e % 5 <> 0 THEN e % 3 <> 0 END AS mfa_authenticated, (e % 2 = 0 OR k >= 10) AS read_only, m_iam_category AS iam_category, m_iam_risk AS iam_risk,
  CASE WHEN action = 'AttachUserPolicy' THEN e % 2 = 0 END AS high_risk_policy, CASE WHEN action = 'CreateAccessKey' THEN {_who} END AS target_principal,
  CASE WHEN k % 7 = 0 THEN 'AccessDenied' END AS error_code
FROM ev WHERE event_type = 'cloud_audit'"""))
def norm_cloud(spark, sf_dir):
    return _source(spark, sf_dir, "cloud_audit").select(
        "record_id", micros().alias("us"), "event_type", "user", "source_ip", "cloud_account", "cloud_service", "action", "status", "cloud_resource",
        _meta("mfa_authenticated"), _meta("read_only"), _meta("iam_category"), _meta("iam_risk"), _meta("high_risk_policy"), _meta("target_principal"),
        _meta("error_code"))


@query("norm_dispatch", with_ev("""
SELECT source, count(*) AS records, count(*) FILTER (bad) AS refused FROM (
  SELECT 'linux_auth' AS source, FALSE AS bad FROM ev WHERE event_type IN ('authentication', 'privilege', 'account')
  UNION ALL SELECT 'windows_security', e % 41 = 0 FROM ev WHERE event_type IN ('authentication', 'privilege', 'account') OR (event_type = 'service' AND (e % 2 = 0 OR e % 41 = 0))
  UNION ALL SELECT CASE WHEN e % 10 = 0 THEN 'linux_auditd' ELSE 'edr_process' END, FALSE FROM ev WHERE event_type = 'discovery'
  UNION ALL SELECT 'network_flow', e % 47 = 0 OR e % 45 = 0 FROM ev WHERE event_type = 'network'
  UNION ALL SELECT 'file_integrity', FALSE FROM ev WHERE event_type = 'file' UNION ALL SELECT 'cloud_audit', FALSE FROM ev WHERE event_type = 'cloud_audit') GROUP BY 1"""))
def norm_dispatch(spark, sf_dir):
    """Records and refusals per source after dispatch to the right job."""
    return _source(spark, sf_dir, *NORMALIZERS).groupBy("source").agg(
        F.count("*").alias("records"), F.count_if(F.size("reasons") > 0).alias("refused"))


@query("norm_canonical", with_ev("""
SELECT event_id, us // 1000000 AS second, event_type, host, 'ssh' AS service, 'T-' || (us // 1000000 % 5) AS ticket, 2 AS extra_keys,
  CASE WHEN us // 1000000 % 11 = 0 THEN 'unknown field color' WHEN us // 1000000 % 8 > 5 THEN 'metadata nests deeper than 6 levels' ELSE '' END AS reasons
FROM ev WHERE host IS NOT NULL"""))
def norm_canonical(spark, sf_dir):
    """Canonical events as JSON records, with metadata that no rule reads, deep metadata and unknown fields."""
    events = desk(spark, sf_dir).events.filter("host IS NOT NULL").withColumn("s", F.expr("unix_micros(timestamp) div 1000000"))
    depth = (F.col("s") % 8).cast("int")
    deep = F.concat(F.repeat(F.lit('{"x":'), depth), F.lit("1"), F.repeat(F.lit("}"), depth))
    record = F.concat(
        F.lit('{"event_id":"'), "event_id", F.lit('","timestamp":"'), F.date_format("timestamp", "yyyy-MM-dd'T'HH:mm:ss'Z'"),
        F.lit('","event_type":"'), "event_type", F.lit('","host_id":"'), "host", F.lit('","status":"'), "status",
        F.when(F.col("s") % 11 == 0, '","color":"red').otherwise(""), F.lit('","metadata":{"service":"ssh","ticket":"T-'),
        (F.col("s") % 5).cast("string"), F.lit('","deep":'), deep, F.lit("}}"))
    raw = events.select(F.col("event_id").alias("record_id"), F.lit("normalized").alias("source"), record.alias("record"),
                        F.col("timestamp").alias("ingested_at"))
    out = normalize(raw, F.lit("2024-02-05").cast("timestamp"), ["normalized"])
    return out.select(
        "event_id", F.expr("unix_micros(timestamp) div 1000000").alias("second"), "event_type", "host", _meta("service"),
        F.col("metadata.extra")["ticket"].alias("ticket"), F.size("metadata.extra").alias("extra_keys"), F.array_join("reasons", "; ").alias("reasons"))


@query("validate_quarantine", """
WITH d AS (
  SELECT o_orderkey AS id, o_custkey % 4 AS c, o_orderkey % 11 AS a, o_orderkey % 13 AS b, o_orderkey % 17 AS p, o_orderkey % 19 AS y, o_custkey % 5 AS h FROM orders
)
SELECT id, array_to_string(list_filter([
  CASE WHEN a = 0 THEN 'unknown event_type' END, CASE WHEN b = 0 THEN 'unknown status' END,
  CASE WHEN y = 0 THEN 'timestamp is more than 24h in the future' END, CASE WHEN y = 1 THEN 'timestamp predates the supported range' END,
  CASE WHEN c = 1 THEN 'invalid source_ip' END, CASE WHEN p = 0 THEN 'destination_port out of range' END, CASE WHEN p = 1 THEN 'negative bytes_out' END,
  CASE WHEN p = 2 THEN 'protocol too long' END, CASE WHEN h = 0 AND c <> 2 THEN 'no host, user, source_ip or cloud_account' END], lambda x: x IS NOT NULL), '; ') AS reason
FROM d WHERE a = 0 OR b = 0 OR y IN (0, 1) OR c = 1 OR p IN (0, 1, 2) OR (h = 0 AND c <> 2)""")
def validate_quarantine(spark, sf_dir):
    """Canonical rows built from the orders with faults in every field, and why each was refused."""
    from eventwarden.model import canonical
    from eventwarden.sources.bridge import read_table
    from eventwarden.sources.normalize import split_rejects, validate

    orders = read_table(spark, sf_dir, "orders")
    key, cust = F.col("o_orderkey"), F.col("o_custkey")
    rows = canonical(orders, {
        "event_id": key.cast("string"), "event_type": F.when(key % 11 == 0, "teapot").otherwise("network"),
        "status": F.when(key % 13 == 0, "maybe").otherwise("success"), "source": F.lit("normalized"),
        "timestamp": F.when(key % 19 == 0, F.lit("2030-01-01")).when(key % 19 == 1, F.lit("1999-12-31")).otherwise(F.lit("2024-01-05")).cast("timestamp"),
        "source_ip": F.when(cust % 4 == 0, "-").when(cust % 4 == 1, "10.0.0.1 ; DROP").when(cust % 4 == 2, " 10.0.0.1 "),
        "host": F.when(cust % 5 == 0, "  ").otherwise("h"), "protocol": F.when(key % 17 == 2, "a-protocol-name-too-long").otherwise("tcp"),
        "destination_port": F.when(key % 17 == 0, 70000).otherwise(22), "bytes_out": F.when(key % 17 == 1, -1).otherwise(1),
    }).withColumn("record_id", F.col("event_id"))
    _, bad = split_rejects(validate(rows, F.lit("2024-02-01").cast("timestamp")))
    return bad.select(F.col("record_id").cast("bigint").alias("id"), "reason")


@query("inventory_discovery", with_ev("""
SELECT 'host' AS kind, host AS id, min(us) AS first_us, max(us) AS last_us, 'linux' AS label FROM ev WHERE host IS NOT NULL GROUP BY 2
UNION ALL SELECT 'user', "user", min(us), max(us), 'human' FROM ev WHERE "user" IS NOT NULL GROUP BY 2"""))
def inventory_discovery(spark, sf_dir):
    from eventwarden.sources.inventory import discover_hosts, discover_users

    events = desk(spark, sf_dir).events
    hosts = discover_hosts(events).select(F.lit("host").alias("kind"), F.col("host_id").alias("id"), micros("first_seen").alias("first_us"),
                                          micros("last_seen").alias("last_us"), F.col("os_family").alias("label"))
    users = discover_users(events).select(F.lit("user"), "user_id", micros("first_seen"), micros("last_seen"), "user_type")
    return hosts.union(users)


@query("inventory_attributes", """
SELECT c_custkey AS id, CASE WHEN upper(n) LIKE 'WIN%' OR contains(upper(n), 'WINDOWS') THEN 'windows' WHEN upper(n) LIKE 'MAC%' OR contains(upper(n), 'DARWIN') THEN 'macos' ELSE 'linux' END AS os_family,
  CASE WHEN n LIKE 'svc%' OR n LIKE '%-svc' THEN 'service' WHEN contains(n, '-admin') THEN 'cloud' ELSE 'human' END AS user_type
FROM (SELECT c_custkey, ['win-', 'mac', 'srv-windows-', 'svc', 'x-admin', 'box'][c_custkey % 6 + 1] || c_custkey || CASE WHEN c_custkey % 7 = 0 THEN '-svc' ELSE '' END AS n FROM customer)""")
def inventory_attributes(spark, sf_dir):
    """Guessed system and account type for names built from the customers."""
    from eventwarden.sources.bridge import read_table

    key = F.col("c_custkey")
    name = F.concat(F.element_at(F.array(*[F.lit(x) for x in ("win-", "mac", "srv-windows-", "svc", "x-admin", "box")]), (key % 6 + 1).cast("int")),
                    key.cast("string"), F.when(key % 7 == 0, "-svc").otherwise(""))
    return read_table(spark, sf_dir, "customer").select(key.alias("id"), guess_os(name).alias("os_family"), guess_user_type(name).alias("user_type"))


@query("inventory_upsert", with_ev("""
SELECT coalesce(a.host_id, b.host_id) AS host_id, least(a.f, b.f) AS first_us, greatest(a.l, b.l) AS last_us,
       CASE WHEN a.host_id IS NOT NULL THEN 5 ELSE 3 END::BIGINT AS criticality
FROM (SELECT host AS host_id, min(us) AS f, max(us) AS l FROM ev WHERE event_type = 'file' AND k < 95 GROUP BY 1) a
FULL JOIN (SELECT host AS host_id, min(us) AS f, max(us) AS l FROM ev WHERE event_type = 'network' GROUP BY 1) b ON a.host_id = b.host_id"""))
def inventory_upsert(spark, sf_dir):
    """Hosts known from file events meet hosts seen in network events."""
    from eventwarden.sources.inventory import discover_hosts

    events = desk(spark, sf_dir).events
    k = F.element_at(F.split("source_ip", r"\."), -1).cast("int")
    known = discover_hosts(events.filter((F.col("event_type") == "file") & (k < 95))).withColumn("criticality", F.lit(5))
    seen = discover_hosts(events.filter(F.col("event_type") == "network"))
    return upsert_inventory(known, seen, "host_id").select(
        "host_id", micros("first_seen").alias("first_us"), micros("last_seen").alias("last_us"), F.col("criticality").cast("bigint").alias("criticality"))
