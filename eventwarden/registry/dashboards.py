"""Dashboards, profiles, cloud analytics, timelines and graphs."""

from __future__ import annotations

from pyspark.sql import functions as F

from eventwarden.model import SEVERITIES
from eventwarden.operators import graph
from eventwarden.operators.quantiles import order_statistics
from eventwarden.plans import analytics, cloud, timeline
from eventwarden.plans.desk import NOW_US, STRETCH, desk
from eventwarden.registry import sql as S
from eventwarden.registry.base import query
from eventwarden.registry.sql import with_alerts, with_cases, with_ev

_WEEK_US = NOW_US - 7 * 86_400_000_000
_GRAVE = "severity IN ('critical', 'high')"
_SEV = "(SELECT unnest(['info', 'low', 'medium', 'high', 'critical']) AS severity)"
_ACTIONS = """
act AS (
  SELECT incident_id, first_alert_us + (CAST(substr(incident_id, 10) AS BIGINT) % 50) * 60000000 AS created_us
  FROM inc WHERE CAST(substr(incident_id, 10) AS BIGINT) % 3 = 0
)"""


@query("kpis", with_cases(f"""
SELECT 'active_incidents' AS metric, count(*) AS value FROM inc
UNION ALL SELECT 'critical_incidents', count(*) FROM inc WHERE severity = 'critical'
UNION ALL SELECT 'critical_alerts', count(*) FROM sa0 WHERE {_GRAVE}
UNION ALL SELECT 'open_alerts', count(*) FROM sa0
UNION ALL SELECT 'hosts_at_risk', count(*) FROM (SELECT value FROM ien WHERE kind = 'host' UNION SELECT host FROM sa0 WHERE host IS NOT NULL AND {_GRAVE})
UNION ALL SELECT 'isolated_hosts', count(DISTINCT host) FROM ev WHERE host IS NOT NULL AND (k % 20) % 7 = 0
UNION ALL SELECT 'disabled_accounts', count(DISTINCT "user") FROM ev WHERE "user" IS NOT NULL AND u % 17 = 0
UNION ALL SELECT 'events_in_window', count(*) FROM ev WHERE us >= {NOW_US - 86_400_000_000}""", STRETCH))
def kpis(spark, sf_dir):
    d = desk(spark, sf_dir)
    return analytics.kpis(d.alerts, d.incidents, d.incident_entities, d.hosts, d.users, d.events, NOW_US)


@query("mttd", with_cases("SELECT round(median(first_alert_us - first_us) / 1e6, 2) AS seconds, count(*) AS sample_size FROM inc", STRETCH))
def mttd(spark, sf_dir):
    return analytics.mttd(desk(spark, sf_dir).incidents)


@query("mttr", with_cases("""
SELECT round(median((created_us - first_alert_us) // 1000000), 2) AS seconds, count(*) AS sample_size FROM act JOIN inc USING (incident_id)""", STRETCH, _ACTIONS))
def mttr(spark, sf_dir):
    d = desk(spark, sf_dir)
    return analytics.mttr(d.incidents, d.response_actions)


@query("response_times", with_cases("""
SELECT incident_id, (created_us - first_alert_us) // 1000000 AS mttr_seconds FROM act JOIN inc USING (incident_id)""", STRETCH, _ACTIONS))
def response_times(spark, sf_dir):
    d = desk(spark, sf_dir)
    return analytics.response_times(d.incidents, d.response_actions)


@query("severity_distribution", with_alerts(f"""
SELECT s.severity, count(a.alert_id) AS count FROM {_SEV} s LEFT JOIN al0 a ON a.severity = s.severity AND a.detected_us >= {_WEEK_US} GROUP BY 1""", STRETCH))
def severity_distribution(spark, sf_dir):
    return analytics.severity_distribution(desk(spark, sf_dir).alerts, _WEEK_US)


_SINCE, _WIDTH = NOW_US - 240 * 3_600_000_000, 240 * 3_600_000_000 // 24


@query("alert_trend", with_alerts(f"""
SELECT {_SINCE} + b * {_WIDTH} AS bucket_us, count(alert_id) AS total, count(*) FILTER (severity = 'critical') AS critical,
  count(*) FILTER (severity = 'high') AS high, count(*) FILTER (severity = 'medium') AS medium, count(*) FILTER (severity IN ('low', 'info')) AS low
FROM range(24) t(b) LEFT JOIN al0 ON detected_us >= {_SINCE} + b * {_WIDTH} AND detected_us < {_SINCE} + (b + 1) * {_WIDTH} GROUP BY b""", STRETCH))
def alert_trend(spark, sf_dir):
    return analytics.alert_trend(desk(spark, sf_dir).alerts, NOW_US, 240, 24)


@query("technique_distribution", with_alerts("""
SELECT x.technique_id, tp.name, tp.tactic_id, tp.tactic, x.alert_count FROM (
  SELECT technique_id, count(*) AS alert_count FROM (SELECT unnest(techniques) AS technique_id FROM al0) GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 12) x
LEFT JOIN tp USING (technique_id)""", STRETCH, S.catalogue_ctes()))
def technique_distribution(spark, sf_dir):
    return analytics.technique_distribution(desk(spark, sf_dir).alerts)


@query("risk_bands", with_cases("""
SELECT b.band, (SELECT count(*) FROM inc WHERE risk_score >= b.low AND risk_score < b.high) AS count
FROM (VALUES ('0-25 (low)', 0, 26), ('26-50 (medium)', 26, 51), ('51-75 (high)', 51, 76), ('76-100 (critical)', 76, 1000)) b(band, low, high)""", STRETCH))
def risk_bands(spark, sf_dir):
    return analytics.risk_distribution(desk(spark, sf_dir).incidents)


@query("top_entities", with_alerts("""
SELECT kind, value, alert_count FROM (
  SELECT *, row_number() OVER (PARTITION BY kind ORDER BY alert_count DESC, value) AS rn FROM (
    SELECT 'host' AS kind, host AS value, count(*) AS alert_count FROM al0 WHERE host IS NOT NULL GROUP BY 2
    UNION ALL SELECT 'user', "user", count(*) FROM al0 WHERE "user" IS NOT NULL GROUP BY 2
    UNION ALL SELECT 'source_ip', source_ip, count(*) FROM al0 WHERE source_ip IS NOT NULL GROUP BY 2)) WHERE rn <= 8""", STRETCH))
def top_entities(spark, sf_dir):
    return analytics.top_entities(desk(spark, sf_dir).alerts)


@query("host_profile", with_alerts("""
SELECT h.host, h.event_count, """ + ", ".join(f"count(a.alert_id) FILTER (a.severity = '{s}') AS {s}" for s in SEVERITIES) + """
FROM (SELECT host, count(*) AS event_count FROM ev WHERE host IS NOT NULL GROUP BY 1) h LEFT JOIN al0 a ON a.host = h.host GROUP BY 1, 2""", STRETCH))
def host_profile(spark, sf_dir):
    d = desk(spark, sf_dir)
    return analytics.host_profile(d.events, d.alerts)


def _top_sql(key: str, kind: str, value: str, k: int, order: str | None = None) -> str:
    return f"""SELECT {key}, '{kind}' AS kind, value, n, rn AS rank FROM (
  SELECT {key}, {value} AS value, count(*) AS n, row_number() OVER (PARTITION BY {key} ORDER BY count(*) DESC, {order or value}) AS rn
  FROM ev WHERE {key} IS NOT NULL AND {value} IS NOT NULL GROUP BY {key}, {value}{', ' + order if order else ''}) WHERE rn <= {k}"""


@query("host_profile_topk", with_ev(" UNION ALL ".join([
    _top_sql("host", "user", '"user"', 20), _top_sql("host", "process", "process", 15),
    _top_sql("host", "peer", "destination_ip || ':' || destination_port", 15, "destination_ip, destination_port")])))
def host_profile_topk(spark, sf_dir):
    return analytics.host_top(desk(spark, sf_dir).events).withColumn("rank", F.col("rank").cast("bigint"))


@query("user_auth_summary", with_ev("""
SELECT "user", count(*) FILTER (status = 'success') AS success, count(*) FILTER (status = 'failure') AS failure, count(*) AS total
FROM ev WHERE event_type = 'authentication' AND "user" IS NOT NULL GROUP BY 1"""))
def user_auth_summary(spark, sf_dir):
    return analytics.user_auth_summary(desk(spark, sf_dir).events)


@query("user_profile_topk", with_ev(" UNION ALL ".join([
    _top_sql('"user"', "source_ip", "source_ip", 20), _top_sql('"user"', "host", "host", 20)])))
def user_profile_topk(spark, sf_dir):
    return analytics.user_top(desk(spark, sf_dir).events).withColumn("rank", F.col("rank").cast("bigint"))


@query("entity_context_hosts", with_cases("""
SELECT h.value, h.events, coalesce(a.n, 0) AS alerts, coalesce(c.n, 0) AS incidents
FROM (SELECT host AS value, count(*) AS events FROM ev WHERE host IS NOT NULL GROUP BY 1) h
LEFT JOIN (SELECT host AS value, count(*) AS n FROM al0 GROUP BY 1) a USING (value)
LEFT JOIN (SELECT substr(entity, 6) AS value, count(DISTINCT incident_id) AS n FROM ik WHERE entity LIKE 'host:%' GROUP BY 1) c USING (value)""", STRETCH))
def entity_context_hosts(spark, sf_dir):
    d = desk(spark, sf_dir)
    return analytics.entity_context(d.events, d.alerts, d.incident_keys, "host")


@query("entity_context_ips", with_cases("""
SELECT h.value, h.events, coalesce(a.n, 0) AS alerts, coalesce(c.n, 0) AS incidents
FROM (SELECT value, count(DISTINCT e) AS events FROM (SELECT e, unnest([source_ip, destination_ip]) AS value FROM ev) WHERE value IS NOT NULL GROUP BY 1) h
LEFT JOIN (SELECT source_ip AS value, count(*) AS n FROM al0 GROUP BY 1) a USING (value)
LEFT JOIN (SELECT substr(entity, 4) AS value, count(DISTINCT incident_id) AS n FROM ik WHERE entity LIKE 'ip:%' GROUP BY 1) c USING (value)""", STRETCH))
def entity_context_ips(spark, sf_dir):
    d = desk(spark, sf_dir)
    return analytics.entity_context(d.events, d.alerts, d.incident_keys, "ip")


@query("replay_hours", with_ev("SELECT us // 3600000000 AS hour, count(*) AS events, min(us) AS first_us, max(us) AS last_us FROM ev GROUP BY 1"))
def replay_hours(spark, sf_dir):
    return analytics.tumbling_hours(desk(spark, sf_dir).events)


@query("order_price_statistics", """
WITH v AS (SELECT o_orderpriority AS priority, CAST(round(o_totalprice * 100) AS BIGINT) AS cents FROM orders),
r AS (SELECT *, row_number() OVER (PARTITION BY priority ORDER BY cents) - 1 AS rn, count(*) OVER (PARTITION BY priority) AS n FROM v)
SELECT priority, n AS count, round(median(cents), 1) AS median, round(avg(cents), 1) AS mean,
       min(cents) FILTER (rn = CAST(round_even(0.95 * (n - 1), 0) AS BIGINT)) AS p95, min(cents) AS min, max(cents) AS max
FROM r GROUP BY priority, n""")
def order_price_statistics(spark, sf_dir):
    """Exact order statistics per key at table scale."""
    from eventwarden.sources.bridge import read_table

    orders = read_table(spark, sf_dir, "orders").select(
        F.col("o_orderpriority").alias("priority"), F.round(F.col("o_totalprice") * 100).cast("bigint").alias("cents"))
    return order_statistics(orders, ["priority"], "cents", 1_000_000).withColumn("median", F.round("median", 1)).withColumn("mean", F.round("mean", 1))


# ---- cloud ----------------------------------------------------------------------------------------
_PRIV = "m_iam_category IN ('privilege_grant', 'credential_creation', 'credential_modification', 'trust_policy_change')"


@query("account_summary", with_ev(f"""
SELECT cloud_account, 'aws' AS provider, count(*) AS event_count, count(*) FILTER (status = 'failure') AS failed_count, count(DISTINCT "user") AS identity_count,
  array_to_string(list_sort(list(DISTINCT cloud_region)), ',') AS regions, 'iam' AS services, count(*) FILTER ({_PRIV}) AS privilege_operations,
  count(*) FILTER (m_iam_category = 'defense_evasion') AS defense_evasion_operations, min(us) AS first_us, max(us) AS last_us
FROM ev WHERE cloud_account IS NOT NULL GROUP BY 1"""))
def account_summary(spark, sf_dir):
    return cloud.account_summary(desk(spark, sf_dir).events)


@query("account_identities", with_ev('SELECT DISTINCT cloud_account, "user" AS identity FROM ev WHERE cloud_account IS NOT NULL AND "user" IS NOT NULL'))
def account_identities(spark, sf_dir):
    return cloud.account_identities(desk(spark, sf_dir).events)


_IDENTITY = f"""
ip0 AS (
  SELECT "user" AS identity, cloud_account, count(*) AS api_calls, count(DISTINCT action) AS distinct_apis, count(*) FILTER (status = 'failure') AS denied_attempts,
    count(*) FILTER (NOT m_mfa) AS no_mfa_calls, count(DISTINCT source_ip) AS source_ips,
    count(DISTINCT source_ip) FILTER (source_ip LIKE '203.%') AS external_ips,
    coalesce(array_to_string(list_sort(list(DISTINCT m_policy) FILTER (m_high_risk_policy)), ','), '') AS high_risk_policies, count(*) FILTER ({_PRIV}) AS privilege_operations,
    count(*) FILTER (m_iam_category = 'defense_evasion') AS defense_evasion_operations, min(us) AS first_us, max(us) AS last_us
  FROM ev WHERE cloud_account IS NOT NULL AND "user" IS NOT NULL GROUP BY 1, 2
), ir AS (
  SELECT *, round(round(least(100.0, 30 * least(1.0, privilege_operations / 2.0) + 20 * least(1.0, denied_attempts / 3.0) + 15 * no_mfa_calls / api_calls
    + 15 * least(1.0, external_ips / 2.0) + 20 * CASE WHEN defense_evasion_operations > 0 THEN 1 ELSE 0 END), 9), 1) AS risk_score FROM ip0
)"""
_IDENTITY_COLUMNS = ("identity, cloud_account, api_calls, distinct_apis, denied_attempts, no_mfa_calls, source_ips, external_ips, "
                     "high_risk_policies, privilege_operations, defense_evasion_operations, first_us, last_us, risk_score")


@query("identity_risk", with_ev(f"""
SELECT {_IDENTITY_COLUMNS}, CASE WHEN risk_score >= 76 THEN 'critical' WHEN risk_score >= 51 THEN 'high' WHEN risk_score >= 26 THEN 'medium' ELSE 'low' END AS risk_band FROM ir""", _IDENTITY))
def identity_risk(spark, sf_dir):
    return cloud.identity_profiles(desk(spark, sf_dir).events).select(*_IDENTITY_COLUMNS.split(", "), "risk_band")


@query("risky_identities", with_alerts("""
SELECT t.identity, t.cloud_account, t.risk_score, """ + ", ".join(f"count(a.alert_id) FILTER (a.severity = '{s}') AS alerts_{s}" for s in SEVERITIES) + """
FROM (SELECT * FROM ir ORDER BY risk_score DESC, identity, cloud_account LIMIT 25) t LEFT JOIN al0 a ON a."user" = t.identity GROUP BY 1, 2, 3""", STRETCH, _IDENTITY))
def risky_identities(spark, sf_dir):
    d = desk(spark, sf_dir)
    return cloud.risky_identities(d.events, d.alerts).select("identity", "cloud_account", "risk_score", *[f"alerts_{s}" for s in SEVERITIES])


@query("iam_changes", with_ev(f"""
SELECT event_id, us, "user" AS identity, cloud_account, action AS api_call, m_iam_category AS category, m_iam_risk AS risk, m_policy AS policy,
  coalesce(m_high_risk_policy, FALSE) AS high_risk_policy, source_ip, m_mfa AS mfa_authenticated, status, m_error_code AS error_code, cloud_resource AS resource
FROM ev WHERE cloud_account IS NOT NULL AND m_iam_category IS NOT NULL AND us >= {_WEEK_US} ORDER BY us DESC, event_id LIMIT 100"""))
def iam_changes(spark, sf_dir):
    return cloud.iam_changes(desk(spark, sf_dir).events, _WEEK_US).select(
        "event_id", "us", "identity", "cloud_account", "api_call", "category", "risk", "policy", "high_risk_policy", "source_ip",
        "mfa_authenticated", "status", "error_code", "resource")


@query("cloud_overview", with_ev(f"""
SELECT count(*) AS account_count, sum(i)::BIGINT AS identity_count, sum(n)::BIGINT AS event_count, sum(p)::BIGINT AS privilege_operations, sum(d)::BIGINT AS defense_evasion_operations
FROM (SELECT cloud_account, count(DISTINCT "user") AS i, count(*) AS n, count(*) FILTER ({_PRIV}) AS p, count(*) FILTER (m_iam_category = 'defense_evasion') AS d
      FROM ev WHERE cloud_account IS NOT NULL GROUP BY 1)"""))
def cloud_overview(spark, sf_dir):
    return cloud.overview(desk(spark, sf_dir).events)


_CLOUD_EDGES = """
ce AS (
  SELECT "user" AS identity, event_id, us, x.s AS source, x.t AS target, x.r AS relation FROM (
    SELECT "user", event_id, us, unnest([
      {'s': 'ip:' || source_ip, 't': 'identity:' || "user", 'r': 'used by'},
      {'s': 'identity:' || "user", 't': 'api_call:' || action, 'r': CASE WHEN status = 'failure' THEN 'denied' ELSE 'called' END},
      {'s': 'api_call:' || action, 't': 'resource:' || cloud_resource, 'r': 'targeted'},
      {'s': 'api_call:' || action, 't': 'policy:' || m_policy, 'r': 'applied'}]) AS x
    FROM ev WHERE cloud_account IS NOT NULL AND "user" IS NOT NULL) WHERE x.s IS NOT NULL AND x.t IS NOT NULL
)"""


@query("identity_graph_edges", with_ev("""
SELECT identity, source, target, relation, count(*) AS count, array_to_string((list(event_id ORDER BY us, event_id))[1:10], ',') AS event_ids FROM ce GROUP BY 1, 2, 3, 4""", _CLOUD_EDGES))
def identity_graph_edges(spark, sf_dir):
    return cloud.identity_graph(desk(spark, sf_dir).events)[1].withColumn("event_ids", F.array_join("event_ids", ","))


@query("identity_graph_nodes", with_ev("""
SELECT "user" AS identity, id, count(*) AS count FROM (
  SELECT "user", unnest(['ip:' || source_ip, 'api_call:' || action, 'resource:' || cloud_resource, 'policy:' || m_policy]) AS id
  FROM ev WHERE cloud_account IS NOT NULL AND "user" IS NOT NULL) WHERE id IS NOT NULL GROUP BY 1, 2
UNION ALL SELECT DISTINCT "user", 'identity:' || "user", 1 FROM ev WHERE cloud_account IS NOT NULL AND "user" IS NOT NULL"""))
def identity_graph_nodes(spark, sf_dir):
    return cloud.identity_graph(desk(spark, sf_dir).events)[0]


# ---- timelines ------------------------------------------------------------------------------------
SUMMARY_SQL = """replace(event_type, '_', ' ') || ' ' || status || ': ' || coalesce("user", '-') || ' | ' || coalesce(CASE
  WHEN event_type = 'authentication' THEN source_ip WHEN event_type IN ('process', 'discovery') THEN coalesce(command_line, process)
  WHEN event_type = 'file' THEN file_path WHEN event_type = 'network' THEN destination_ip || ':' || destination_port ELSE action END, '-')
  || ' | ' || coalesce(host, cloud_account, '-')"""


@query("event_summary_text", with_ev(f"SELECT event_id, {SUMMARY_SQL} AS summary FROM ev"))
def event_summary_text(spark, sf_dir):
    return desk(spark, sf_dir).events.select("event_id", timeline.event_summary().alias("summary"))


@query("event_highlights", with_ev("""
SELECT event_id, array_to_string(list_filter([
    CASE WHEN m_auth_method IS NOT NULL THEN 'auth_method=' || m_auth_method END, CASE WHEN m_failure_reason IS NOT NULL THEN 'failure_reason=' || m_failure_reason END,
    CASE WHEN m_discovery_category IS NOT NULL THEN 'discovery_category=' || m_discovery_category END,
    CASE WHEN m_persistence_mechanism IS NOT NULL THEN 'persistence_mechanism=' || m_persistence_mechanism END,
    CASE WHEN m_iam_category IS NOT NULL THEN 'iam_category=' || m_iam_category END, CASE WHEN m_iam_risk IS NOT NULL THEN 'iam_risk=' || m_iam_risk END,
    CASE WHEN m_policy IS NOT NULL THEN 'policy=' || m_policy END, CASE WHEN m_group IS NOT NULL THEN 'group=' || m_group END,
    CASE WHEN m_service IS NOT NULL THEN 'service=' || m_service END, CASE WHEN m_indicator IS NOT NULL THEN 'argument_indicators=' || m_indicator END,
    CASE WHEN m_uid_zero IS NOT NULL THEN 'uid_zero=' || m_uid_zero END, CASE WHEN m_privileged_group IS NOT NULL THEN 'privileged_group=' || m_privileged_group END,
    CASE WHEN m_high_risk_policy IS NOT NULL THEN 'high_risk_policy=' || m_high_risk_policy END,
    CASE WHEN m_invalid_user IS NOT NULL THEN 'invalid_user=' || m_invalid_user END], lambda x: x IS NOT NULL), ';') AS highlights FROM ev"""))
def event_highlights(spark, sf_dir):
    entries = F.transform(F.map_entries(timeline.metadata_map(timeline.HIGHLIGHT_KEYS)), lambda x: F.concat_ws("=", x["key"], x["value"]))
    return desk(spark, sf_dir).events.select("event_id", F.array_join(entries, ";").alias("highlights"))


@query("incident_timeline", with_cases(f"""
SELECT x.incident_id, ev.event_id, ev.us, {S.SEVERITY_NAMES}[x.rank + 1] AS severity, x.alerts, coalesce(h.iocs, '') AS iocs, {SUMMARY_SQL} AS summary
FROM (SELECT incident_id, ae.e, max({S.rank_sql('ia.severity')}) AS rank, string_agg(ia.alert_id, ',' ORDER BY ia.rule_id, ia.alert_id) AS alerts
      FROM ae JOIN ia USING (alert_id) GROUP BY 1, 2) x JOIN ev USING (e)
LEFT JOIN (SELECT e, string_agg(ioc_id, ',' ORDER BY ioc_id, matched_field) AS iocs FROM im GROUP BY 1) h USING (e)""", STRETCH))
def incident_timeline(spark, sf_dir):
    d = desk(spark, sf_dir)
    rows = timeline.incident_timeline(d.alerts, d.alert_evidence, d.events, d.ioc_matches)
    return rows.select(
        "incident_id", "event_id", "us", "severity", F.array_join(F.transform("alerts", lambda a: a["alert_id"]), ",").alias("alerts"),
        F.coalesce(F.array_join(F.transform("ioc_matches", lambda i: i["ioc_id"]), ","), F.lit("")).alias("iocs"), "summary")


@query("estate_timeline", with_cases(f"""
SELECT p.event_id, p.us, coalesce({S.SEVERITY_NAMES}[max({S.rank_sql('ia.severity')}) + 1], 'info') AS severity, count(ia.alert_id) AS alert_count,
       coalesce(array_to_string(list_sort(list(DISTINCT ia.incident_id) FILTER (ia.incident_id IS NOT NULL)), ','), '') AS incident_ids
FROM (SELECT * FROM ev WHERE host = 'HOST-3' ORDER BY us DESC, event_id LIMIT 60) p LEFT JOIN ae USING (e) LEFT JOIN ia ON ia.alert_id = ae.alert_id
GROUP BY p.event_id, p.us""", STRETCH))
def estate_timeline(spark, sf_dir):
    """Latest sixty events of one host."""
    d = desk(spark, sf_dir)
    rows = timeline.estate_timeline(d.events, d.alerts, d.alert_evidence, 60, host="HOST-3")
    return rows.select("event_id", "us", "severity", "alert_count", F.coalesce(F.array_join("incident_ids", ","), F.lit("")).alias("incident_ids"))


# ---- graph ----------------------------------------------------------------------------------------
_GRAPH = f"""
gv AS (
  SELECT incident_id, severity_rank, ev.* FROM ie JOIN ev USING (e)
), gi AS (
  SELECT gv.incident_id, gv.event_id, gv.us, gv.host, gv.source_ip, gv.destination_ip, im.ioc_id, {S.rank_sql('im.ioc_severity')} AS rank
  FROM gv JOIN (SELECT DISTINCT e, ioc_id, matched_field, ioc_severity FROM im) im ON im.e = gv.e
), gn0 AS (
  SELECT incident_id, severity_rank AS rank, unnest(['host:' || host, 'user:' || "user", 'ip:' || source_ip, 'cloud_account:' || cloud_account,
    CASE WHEN event_type = 'discovery' THEN 'process:' || coalesce(host, 'unknown') || '::' || process END, CASE WHEN event_type = 'network' THEN 'ip:' || destination_ip END,
    CASE WHEN event_type = 'file' THEN 'file:' || coalesce(host, 'unknown') || '::' || file_path END]) AS id FROM gv
  UNION ALL SELECT incident_id, {S.rank_sql('severity')}, 'alert:' || alert_id FROM ia
  UNION ALL SELECT incident_id, {S.rank_sql('severity')}, 'technique:' || unnest(techniques) FROM ia
  UNION ALL SELECT incident_id, rank, 'ioc:' || ioc_id FROM gi
), gn AS (
  SELECT incident_id, id, count(*) AS event_count, {S.SEVERITY_NAMES}[max(rank) + 1] AS severity FROM gn0 WHERE id IS NOT NULL GROUP BY 1, 2
), ge0 AS (
  SELECT incident_id, event_id, us, x.s AS source, x.t AS target, x.r AS relation FROM (
    SELECT incident_id, event_id, us, unnest([
      {{'s': 'user:' || "user", 't': 'cloud_account:' || cloud_account, 'r': 'operated in'}},
      CASE WHEN event_type = 'authentication' THEN {{'s': 'user:' || "user", 't': 'ip:' || source_ip, 'r': CASE WHEN status = 'success' THEN 'authenticated from' ELSE 'attempted from' END}} END,
      CASE WHEN event_type = 'authentication' THEN {{'s': 'user:' || "user", 't': 'host:' || host, 'r': CASE WHEN status = 'success' THEN 'logged in to' ELSE 'failed login to' END}} END,
      CASE WHEN event_type = 'discovery' THEN {{'s': 'user:' || "user", 't': 'process:' || host || '::' || process, 'r': 'executed'}} END,
      CASE WHEN event_type = 'discovery' THEN {{'s': 'process:' || host || '::' || process, 't': 'host:' || host, 'r': 'ran on'}} END,
      CASE WHEN event_type = 'network' THEN {{'s': 'host:' || host, 't': 'ip:' || destination_ip, 'r': 'connected to'}} END,
      CASE WHEN event_type = 'file' THEN {{'s': coalesce('user:' || "user", 'host:' || host), 't': 'file:' || host || '::' || file_path, 'r': 'modified'}} END,
      CASE WHEN event_type = 'file' THEN {{'s': 'file:' || host || '::' || file_path, 't': 'host:' || host, 'r': 'persists on'}} END,
      CASE WHEN event_type = 'privilege' THEN {{'s': 'user:' || "user", 't': 'host:' || host, 'r': 'escalated on'}} END,
      CASE WHEN event_type = 'account' THEN {{'s': 'user:' || "user", 't': 'host:' || host, 'r': 'account changed on'}} END]) AS x FROM gv)
  WHERE x.s IS NOT NULL AND x.t IS NOT NULL
  UNION ALL SELECT incident_id, NULL, NULL, 'alert:' || alert_id, replace(entity, 'cloud:', 'cloud_account:'), 'detected on' FROM ax JOIN ia USING (alert_id)
    WHERE EXISTS (SELECT 1 FROM gn WHERE gn.incident_id = ia.incident_id AND gn.id = replace(ax.entity, 'cloud:', 'cloud_account:'))
  UNION ALL SELECT incident_id, NULL, NULL, 'alert:' || alert_id, 'technique:' || unnest(techniques), 'maps to' FROM ia
  UNION ALL SELECT incident_id, event_id, us, source, target, 'matches' FROM (
    SELECT incident_id, event_id, us, 'ioc:' || ioc_id AS source, unnest(['ip:' || source_ip, 'ip:' || destination_ip, 'host:' || host]) AS target FROM gi) m
    WHERE target IS NOT NULL AND EXISTS (SELECT 1 FROM gn WHERE gn.incident_id = m.incident_id AND gn.id = m.target)
), gx AS (
  SELECT incident_id, source, target, relation, count(*) AS count,
    coalesce(array_to_string((list(event_id ORDER BY us, event_id) FILTER (event_id IS NOT NULL))[1:12], ','), '') AS event_ids
  FROM (SELECT DISTINCT incident_id, source, target, relation, event_id, us FROM ge0) GROUP BY 1, 2, 3, 4
), gc AS (SELECT incident_id, source, target, relation, count(*) AS count FROM ge0 GROUP BY 1, 2, 3, 4)"""


def _graph(spark, sf_dir):
    d = desk(spark, sf_dir)
    return graph.incident_graph(d.incident_events, d.alerts, d.alert_entities, d.ioc_matches)


@query("graph_nodes", with_cases("SELECT incident_id, id, severity, event_count FROM gn", STRETCH, _GRAPH))
def graph_nodes(spark, sf_dir):
    return _graph(spark, sf_dir)[0].select("incident_id", "id", "severity", "event_count")


@query("graph_edge_evidence", with_cases("""
SELECT DISTINCT incident_id, source, target, relation, event_id FROM ge0 WHERE event_id IS NOT NULL""", STRETCH, _GRAPH))
def graph_edge_evidence(spark, sf_dir):
    """Every event behind every edge."""
    d = desk(spark, sf_dir)
    return graph.edge_evidence(d.incident_events, d.alerts, d.alert_entities, d.ioc_matches).drop("us")


@query("graph_edges", with_cases("SELECT incident_id, source, target, relation, gc.count, gx.event_ids FROM gc JOIN gx USING (incident_id, source, target, relation)", STRETCH, _GRAPH))
def graph_edges(spark, sf_dir):
    return _graph(spark, sf_dir)[1].select(
        "incident_id", "source", "target", "relation", "count", F.coalesce(F.array_join("event_ids", ","), F.lit("")).alias("event_ids"))


@query("graph_pruned", with_cases("""
SELECT incident_id, total_nodes, total_edges, shown_nodes, coalesce(shown_edges, 0) AS shown_edges, total_nodes > shown_nodes OR total_edges > coalesce(shown_edges, 0) AS truncated FROM (
  SELECT n.incident_id, n.total_nodes, n.shown_nodes, coalesce(t.total_edges, 0) AS total_edges, s.shown_edges FROM
    (SELECT incident_id, count(*) AS total_nodes, count(*) FILTER (rn <= 5) AS shown_nodes FROM gr GROUP BY 1) n
    LEFT JOIN (SELECT incident_id, count(*) AS total_edges FROM gc GROUP BY 1) t USING (incident_id)
    LEFT JOIN (SELECT incident_id, least(4, count(*)) AS shown_edges FROM gc WHERE
        EXISTS (SELECT 1 FROM gr WHERE gr.incident_id = gc.incident_id AND gr.id = gc.source AND rn <= 5) AND
        EXISTS (SELECT 1 FROM gr WHERE gr.incident_id = gc.incident_id AND gr.id = gc.target AND rn <= 5) GROUP BY 1) s USING (incident_id))""", STRETCH, _GRAPH,
    "gr AS (SELECT *, row_number() OVER (PARTITION BY incident_id ORDER BY event_count DESC, id) AS rn FROM gn)"))
def graph_pruned(spark, sf_dir):
    """Totals of a picture cut to five nodes and four edges."""
    return graph.prune(*_graph(spark, sf_dir), max_nodes=5, max_edges=4)[2].select(
        "incident_id", "total_nodes", "total_edges", "shown_nodes", "shown_edges", "truncated")
