"""Hunts, lists, search, coverage, detection quality, response and reports."""

from __future__ import annotations

from pyspark.sql import functions as F

from eventwarden.model import micros
from eventwarden.plans import detect, evaluate, hunts, listing, reports, respond, timeline
from eventwarden.plans.desk import NOW_US, STRETCH, desk
from eventwarden.plans.hunts import BUILTIN, Hunt, HuntStep
from eventwarden.plans.search import classify_term, search, technique_hits
from eventwarden.registry import sql as S
from eventwarden.registry.base import query
from eventwarden.registry.dashboards import SUMMARY_SQL
from eventwarden.registry.sql import with_alerts, with_cases, with_ev


# ---- hunts ----------------------------------------------------------------------------------------
def _simple_hunt(name: str, where: str, order: str = "us DESC", now_us: int = NOW_US) -> None:
    hunt = BUILTIN[name]
    bound = f"us BETWEEN {now_us - hunt.last_minutes * 60_000_000} AND {now_us}"

    @query(f"hunt_{name}", with_ev(f"SELECT event_id, us FROM ev WHERE {where} AND {bound} ORDER BY {order}, event_id LIMIT {hunt.limit}"))
    def run(spark, sf_dir):
        return hunts.page(desk(spark, sf_dir).events, hunt, now_us).select("event_id", micros().alias("us"))


_simple_hunt("privilege_escalation", "event_type = 'privilege' AND status = 'success'", now_us=1_704_344_400_000_000)
_simple_hunt("persistence_mechanisms", "event_type = 'file' AND m_persistence_path")
_simple_hunt("external_authentication", "event_type = 'authentication' AND status = 'success' AND source_ip NOT LIKE '%10.%'")
_simple_hunt("cloud_privilege_grants", "m_iam_category IN ('privilege_grant', 'credential_creation', 'trust_policy_change')")
_simple_hunt("large_outbound", "event_type = 'network' AND bytes_out > 10000000", "bytes_out DESC")
_simple_hunt("enumeration_activity", "event_type = 'discovery'")


@query("hunt_alerts_awaiting_triage", with_cases("""
SELECT alert_id AS id, risk_score, severity, incident_id FROM ia WHERE severity IN ('critical', 'high') ORDER BY risk_score DESC, alert_id LIMIT 100""", STRETCH))
def hunt_alerts(spark, sf_dir):
    page = hunts.page(desk(spark, sf_dir).alerts, BUILTIN["alerts_awaiting_triage"], NOW_US)
    return hunts.alert_rows(page).select("id", "risk_score", "severity", "incident_id")


@query("hunt_totals", with_ev(f"""
SELECT 'privilege_escalation' AS hunt, count(*) AS total FROM ev WHERE event_type = 'privilege' AND status = 'success' AND us BETWEEN {NOW_US - 3_600_000_000} AND {NOW_US}
UNION ALL SELECT 'persistence_mechanisms', count(*) FROM ev WHERE event_type = 'file' AND m_persistence_path AND us BETWEEN {NOW_US - 604_800_000_000} AND {NOW_US}
UNION ALL SELECT 'enumeration_activity', count(*) FROM ev WHERE event_type = 'discovery' AND us BETWEEN {NOW_US - 86_400_000_000} AND {NOW_US}"""))
def hunt_totals(spark, sf_dir):
    """Totals beside the pages."""
    events = desk(spark, sf_dir).events
    parts = [hunts.total(events, BUILTIN[n], NOW_US).select(F.lit(n).alias("hunt"), "total")
             for n in ("privilege_escalation", "persistence_mechanisms", "enumeration_activity")]
    return parts[0].union(parts[1]).union(parts[2])


@query("hunt_second_page", with_ev("""
SELECT event_id FROM ev WHERE event_type = 'network' AND status = 'failure' ORDER BY bytes_out, event_id LIMIT 25 OFFSET 25"""))
def hunt_second_page(spark, sf_dir):
    hunt = Hunt(filters=(("event_type", "eq", "network"), ("status", "eq", "failure")), order_by="bytes_out", descending=False, limit=25, offset=25)
    return hunts.page(desk(spark, sf_dir).events, hunt, NOW_US).select("event_id")


@query("hunt_incidents_by_array", with_cases("""
SELECT incident_id AS id, risk_score FROM inc WHERE contains(',' || technique_ids || ',', ',T1071,') AND NOT contains(',' || technique_ids || ',', ',T1552,')""", STRETCH))
def hunt_incidents_by_array(spark, sf_dir):
    """Array fields: one technique wanted, another excluded."""
    hunt = Hunt("incidents", (("technique_id", "eq", "t1071"), ("technique_id", "not_in", ["T1552"])))
    return hunts.incident_rows(hunts.matching(desk(spark, sf_dir).incidents, hunt, NOW_US)).select("id", "risk_score")


def _ordered_sql(group: str, first: str, m: int, then: str, within: int) -> tuple[str, str]:
    """Two-step hunt: ``m`` events of one kind, then the next of the other, inside a window."""
    w = within * 1_000_000
    return f"""
hr AS (SELECT lower({group}) AS g, us, event_id, coalesce({first}, FALSE) AS s0, coalesce({then}, FALSE) AS s1 FROM ev WHERE {group} IS NOT NULL),
ha AS (SELECT *, row_number() OVER (PARTITION BY g ORDER BY us, event_id) AS rn FROM hr WHERE s0),
hc AS (SELECT a.g, a.us AS a_us, a.event_id AS a_id, a.rn, z.us AS z_us, z.event_id AS z_id FROM ha a JOIN ha z ON z.g = a.g AND z.rn = a.rn + {m} - 1 AND z.us - a.us <= {w}),
hn AS (SELECT hc.*, n.us AS n_us, n.event_id AS n_id FROM hc, LATERAL (
  SELECT us, event_id FROM hr x WHERE x.g = hc.g AND x.s1 AND (x.us, x.event_id) > (hc.z_us, hc.z_id) ORDER BY us, event_id LIMIT 1) n WHERE n.us - hc.a_us <= {w}),
hf AS (SELECT g, arg_min(rn, (a_us, a_id)) AS rn, arg_min(a_us, (a_us, a_id)) AS a_us, arg_min(n_us, (a_us, a_id)) AS n_us, arg_min(n_id, (a_us, a_id)) AS n_id FROM hn GROUP BY g),
he AS (SELECT ha.g, ha.event_id, 0 AS step FROM ha JOIN hf ON hf.g = ha.g AND ha.rn BETWEEN hf.rn AND hf.rn + {m} - 1 UNION ALL SELECT g, n_id, 1 FROM hf)""", "he"


_FAILED = "event_type = 'authentication' AND status = 'failure'"
_OK = "event_type = 'authentication' AND status = 'success'"
_LOGIN_HUNT = BUILTIN["failed_then_success"]


@query("hunt_failed_then_success", with_ev(
    "SELECT g AS source_ip, event_id, CAST(step AS BIGINT) AS step FROM he", _ordered_sql("source_ip", _FAILED, 3, _OK, 86_400)[0]))
def hunt_failed_then_success(spark, sf_dir):
    """Three failures then a success per address, inside a day, over the whole history."""
    from dataclasses import replace

    hunt = replace(_LOGIN_HUNT, last_minutes=None, within_seconds=86_400)
    _, found = hunts.sequence_hunt(desk(spark, sf_dir).events, hunt, NOW_US)
    return found.select(F.expr("substring(g, 2)").alias("source_ip"), "event_id", F.col("step").cast("bigint").alias("step"))


@query("hunt_sequence_matches", with_ev("""
SELECT hf.g AS "user", hf.a_us AS first_us, hf.n_us AS last_us, (hf.n_us - hf.a_us) // 1000000 AS span_seconds, count(*) AS event_count
FROM hf JOIN he USING (g) GROUP BY ALL""", _ordered_sql("\"user\"", "event_type = 'discovery'", 2, "event_type = 'file' AND (m_persistence_mechanism IS NULL OR m_persistence_mechanism <> 'cron')", 43_200)[0]))
def hunt_sequence_matches(spark, sf_dir):
    """Two enumeration commands, then a file change that is not a cron entry, per account."""
    hunt = Hunt(within_seconds=43_200, correlate_on=("user",), steps=(
        HuntStep("enumeration", (("event_type", "eq", "discovery"),), 2),
        HuntStep("file", (("event_type", "eq", "file"), ("file_path", "not_contains", "/etc/cron.d/")), 1)))
    per_key, _ = hunts.sequence_hunt(desk(spark, sf_dir).events, hunt, NOW_US)
    return per_key.select(F.get("group_key", F.lit(0)).alias("user"), "first_us", "last_us", "span_seconds", "event_count")


# ---- lists ----------------------------------------------------------------------------------------
@query("list_events", with_ev("""
SELECT event_id FROM ev WHERE event_type = 'authentication' AND status = 'failure' AND host = 'HOST-7' AND ts >= '2024-01-10' AND ts <= '2024-01-25' ORDER BY us DESC, event_id LIMIT 50"""))
def list_events(spark, sf_dir):
    return listing.events_page(desk(spark, sf_dir).events, event_type="authentication", status="failure", host="HOST-7",
                               since="2024-01-10 00:00:00", until="2024-01-25 00:00:00").select("event_id")


@query("list_alerts", with_alerts("""
SELECT alert_id, rule_id FROM sa0 WHERE severity IN ('critical', 'high') AND list_contains(techniques, 'T1078') AND contains(rule_id, 'PRIV') ORDER BY risk_score DESC, alert_id LIMIT 40""", STRETCH))
def list_alerts(spark, sf_dir):
    # the search also reads titles and rule names; no title of another rule holds the term
    return listing.alerts_page(desk(spark, sf_dir).alerts, severity=["critical", "high"], technique="T1078", q="privesc_", sort="risk_score",
                               limit=40).select("alert_id", "rule_id")


@query("list_incidents", with_cases("""
SELECT incident_id FROM inc WHERE severity IN ('critical', 'high') AND contains(',' || technique_ids || ',', ',T1071,')
 AND incident_id IN (SELECT incident_id FROM ien WHERE kind = 'host' AND value = 'HOST-12') ORDER BY last_us DESC, incident_id LIMIT 50""", STRETCH))
def list_incidents(spark, sf_dir):
    d = desk(spark, sf_dir)
    return listing.incidents_page(d.incidents, d.incident_entities, severity=["critical", "high"], host="HOST-12", technique="T1071").select("incident_id")


@query("list_hosts", with_ev("""
SELECT host_id, criticality FROM (SELECT DISTINCT host AS host_id, 1 + (k % 20) % 5 AS criticality, k % 20 AS n FROM ev WHERE host IS NOT NULL)
WHERE n % 2 = 0 AND contains(lower(host_id), 'host-1') ORDER BY criticality DESC, host_id LIMIT 100"""))
def list_hosts(spark, sf_dir):
    return listing.hosts_page(desk(spark, sf_dir).hosts, environment="production", q="host-1").select("host_id", "criticality")


@query("list_users", with_ev("""
SELECT user_id FROM (SELECT DISTINCT "user" AS user_id, u FROM ev WHERE "user" IS NOT NULL) WHERE u % 10 = 0 AND u % 17 <> 0 ORDER BY user_id LIMIT 100"""))
def list_users(spark, sf_dir):
    return listing.users_page(desk(spark, sf_dir).users, is_privileged=True, is_disabled=False).select("user_id")


@query("list_indicators", with_ev("""
SELECT ind.ioc_id, count(im.event_id) AS match_count FROM ind LEFT JOIN im USING (ioc_id) WHERE ind.ioc_type = 'ip' GROUP BY 1 HAVING count(im.event_id) > 0""", S.INDICATORS))
def list_indicators(spark, sf_dir):
    d = desk(spark, sf_dir)
    return listing.indicators_page(d.indicators, d.ioc_matches, matched_only=True, ioc_type="ip").select("ioc_id", "match_count")


@query("indicator_detail", with_cases("""
SELECT ind.ioc_id, count(DISTINCT im.event_id) AS events, count(DISTINCT ev.host) AS hosts, count(DISTINCT ie.incident_id) AS incidents
FROM ind LEFT JOIN im USING (ioc_id) LEFT JOIN ev ON ev.e = im.e LEFT JOIN ie ON ie.e = im.e GROUP BY 1""", STRETCH))
def indicator_detail(spark, sf_dir):
    d = desk(spark, sf_dir)
    return listing.indicator_detail(d.indicators, d.ioc_matches, d.incident_events).select("ioc_id", "events", "hosts", "incidents")


@query("audit_trail", with_ev("""
SELECT event_id AS audit_id, "user" AS actor, action, host AS target_id, status AS result FROM ev WHERE action = 'sudo' AND status = 'success' AND ts >= '2024-01-20' ORDER BY us DESC, event_id LIMIT 100"""))
def audit_trail(spark, sf_dir):
    """The event table read as an audit trail."""
    trail = desk(spark, sf_dir).events.select(
        F.col("event_id").alias("audit_id"), F.col("timestamp").alias("created_at"), F.col("user").alias("actor"), "action",
        F.col("host").alias("target_id"), F.col("status").alias("result"))
    return listing.audit_page(trail, action="sudo", result="success", since="2024-01-20 00:00:00").drop("created_at")


# ---- search ---------------------------------------------------------------------------------------
@query("classify_terms", with_ev("""
SELECT term, CASE WHEN term LIKE 'EVT-%' THEN 'event_id' WHEN term LIKE '10.%' OR term LIKE '203.%' THEN 'ip' WHEN regexp_matches(term, '^c{64}$') THEN 'hash' ELSE 'text' END AS kind
FROM (SELECT DISTINCT unnest([event_id, host, "user", source_ip, file_hash, file_path, action]) AS term FROM ev) WHERE term IS NOT NULL"""))
def classify_terms(spark, sf_dir):
    """What every distinct value of the event table would be taken for."""
    terms = desk(spark, sf_dir).events.select(F.explode(F.array_compact(F.array(
        "event_id", "host", "user", "source_ip", "file_hash", "file_path", "action"))).alias("term")).distinct()
    return terms.select("term", classify_term(F.col("term")).alias("kind"))


@query("entity_search", with_cases("""
SELECT * FROM (
  SELECT 'evt-77' AS term, 'events' AS category, event_id AS id, 1 AS rank FROM ev WHERE event_id = 'EVT-77'
  UNION ALL SELECT '203.0.113.91', 'events', event_id, row_number() OVER (ORDER BY us DESC, event_id) FROM ev WHERE source_ip = '203.0.113.91'
  UNION ALL SELECT '203.0.113.91', 'alerts', alert_id, row_number() OVER (ORDER BY detected_us DESC, alert_id) FROM al0 WHERE source_ip = '203.0.113.91'
  UNION ALL SELECT '203.0.113.91', 'indicators', 'IOC-91', 1
  UNION ALL SELECT '203.0.113.91', 'incidents', incident_id, row_number() OVER (ORDER BY last_us DESC, incident_id) FROM inc WHERE incident_id IN (SELECT incident_id FROM ik WHERE entity = 'ip:203.0.113.91')
  UNION ALL SELECT 'T1110.001', 'techniques', 'T1110.001', 1
  UNION ALL SELECT 'user-14', 'users', user_id, row_number() OVER (ORDER BY user_id) FROM (SELECT DISTINCT "user" AS user_id FROM ev WHERE lower("user") LIKE 'user-14%')
  UNION ALL SELECT 'user-14', 'alerts', alert_id, row_number() OVER (ORDER BY detected_us DESC, alert_id) FROM tl WHERE contains(lower(title), 'user-14')
  UNION ALL SELECT 'user-14', 'incidents', incident_id, row_number() OVER (ORDER BY last_us DESC, incident_id) FROM itl WHERE contains(lower(title), 'user-14')
) WHERE rank <= 10""", STRETCH, """
tl AS (
  SELECT al0.alert_id, al0.detected_us, CASE
    WHEN al0.rule_id IN ('PRIVESC_SUID_ENUM_001') THEN 'Setuid search by ' || al0."user"
    WHEN al0.rule_id IN ('CREDENTIAL_FILE_ACCESS_001', 'PRIVESC_GROUP_CHANGE_001', 'PRIVESC_WINDOWS_SPECIAL_PRIV_001', 'PERSISTENCE_BACKDOOR_ACCOUNT_001', 'LATERAL_MOVEMENT_001',
      'LATERAL_BREADTH_001', 'LATERAL_TOOL_TRANSFER_001', 'CLOUD_IAM_PRIVESC_001', 'CLOUD_LOG_TAMPERING_001', 'CLOUD_IAM_KEY_CHAIN_001', 'CLOUD_IAM_ANOMALY_001', 'VALID_ACCOUNT_ABUSE_001',
      'PRIVESC_SUDO_CHAIN_001', 'ACCOUNT_DISCOVERY_001', 'CLOUD_DISCOVERY_001') THEN al0."user" ELSE '' END AS title FROM al0),
itl AS (
  SELECT inc.incident_id, inc.last_us, CASE WHEN n = 1 THEN first ELSE '' END AS title FROM inc
  LEFT JOIN (SELECT incident_id, count(*) AS n, min(value) AS first FROM ien WHERE kind = 'user' AND role = 'affected' GROUP BY 1) USING (incident_id))"""))
def entity_search(spark, sf_dir):
    """Five terms of different kinds over every table."""
    d = desk(spark, sf_dir)
    found = search(["evt-77", "203.0.113.91", "T1110.001", "user-14"], events=d.events, alerts=d.alerts, incidents=d.incidents,
                   incident_keys=d.incident_keys, hosts=d.hosts, users=d.users, indicators=d.indicators)
    return found.select("term", "category", "id", F.col("rank").cast("bigint").alias("rank"))


@query("technique_search", with_alerts("""
SELECT tq.technique_id, tq.name, (SELECT count(*) FROM al0 WHERE list_contains(al0.techniques, tq.technique_id)) AS alert_count FROM tq WHERE contains(lower(name), 'account')""",
    STRETCH, S.catalogue_ctes()))
def technique_search(spark, sf_dir):
    return technique_hits(desk(spark, sf_dir).alerts, "Account")


# ---- coverage -------------------------------------------------------------------------------------
def _matrix(spark, sf_dir):
    d = desk(spark, sf_dir)
    return listing.coverage(detect.rule_table(spark, d.rules), d.techniques)


_COVER = "rt AS (SELECT rule_id, unnest(techniques) AS technique_id FROM rl)"


@query("coverage_matrix", with_cases("""
SELECT tt.tactic_id, tt.technique_id, coalesce(string_agg(DISTINCT rt.rule_id, ',' ORDER BY rt.rule_id), '') AS rules, count(rt.rule_id) > 0 AS covered,
  (SELECT count(*) FROM it WHERE it.technique_id = tt.technique_id) AS observed
FROM tt LEFT JOIN rt USING (technique_id) GROUP BY 1, 2""", STRETCH, _COVER))
def coverage_matrix(spark, sf_dir):
    return _matrix(spark, sf_dir).select("tactic_id", "technique_id", F.array_join("detection_rules", ",").alias("rules"), "covered", "observed")


@query("coverage_by_tactic", with_cases("""
SELECT tactic_id, tactic, count(DISTINCT technique_id) FILTER (technique_id IN (SELECT technique_id FROM rt)) AS covered_count, count(DISTINCT technique_id) AS total_count,
  CAST(sum(coalesce(o.n, 0)) AS BIGINT) AS observed FROM tt LEFT JOIN (SELECT technique_id, count(*) AS n FROM it GROUP BY 1) o USING (technique_id) GROUP BY 1, 2""", STRETCH, _COVER))
def coverage_by_tactic(spark, sf_dir):
    return listing.coverage_by_tactic(_matrix(spark, sf_dir)).drop("position")


@query("coverage_totals", with_cases("""
SELECT count(*) AS technique_count, count(*) FILTER (technique_id IN (SELECT technique_id FROM rt)) AS covered_techniques,
  count(*) FILTER (technique_id IN (SELECT technique_id FROM it)) AS observed_techniques,
  round(count(*) FILTER (technique_id IN (SELECT technique_id FROM rt)) / count(*), 3) AS coverage_ratio FROM tq""", STRETCH, _COVER))
def coverage_totals(spark, sf_dir):
    return listing.coverage_totals(_matrix(spark, sf_dir))


@query("uncovered_techniques", with_cases("SELECT technique_id, (SELECT count(*) FROM it WHERE it.technique_id = tq.technique_id) AS observed FROM tq WHERE technique_id NOT IN (SELECT technique_id FROM rt)", STRETCH, _COVER))
def uncovered_techniques(spark, sf_dir):
    return listing.uncovered(_matrix(spark, sf_dir))


@query("technique_detail", with_cases("""
SELECT tq.technique_id, (SELECT count(DISTINCT rule_id) FROM rt WHERE rt.technique_id = tq.technique_id) AS rules,
  (SELECT count(*) FROM al0 WHERE list_contains(al0.techniques, tq.technique_id)) AS alerts,
  (SELECT count(DISTINCT incident_id) FROM it WHERE it.technique_id = tq.technique_id) AS incidents FROM tq""", STRETCH, _COVER))
def technique_detail(spark, sf_dir):
    d = desk(spark, sf_dir)
    return listing.technique_detail(detect.rule_table(spark, d.rules), d.alerts, d.techniques).drop("name")


@query("incident_tactics", with_cases("""
SELECT incident_id, string_agg(tactic_id, ',' ORDER BY position) AS tactics FROM (SELECT DISTINCT incident_id, tactic_id, tt.position FROM itx JOIN tt USING (technique_id)) GROUP BY 1""", STRETCH))
def incident_tactics(spark, sf_dir):
    return listing.tactics_in_order(desk(spark, sf_dir).techniques).withColumn("tactics", F.array_join("tactics", ","))


# ---- detection quality ----------------------------------------------------------------------------
_MATRIX = """
tg AS (SELECT DISTINCT e FROM ae),
cm AS (
  SELECT count(*) FILTER (label = 'malicious' AND hit) AS true_positives, count(*) FILTER (label = 'benign' AND hit) AS false_positives,
    count(*) FILTER (label = 'benign' AND NOT hit) AS true_negatives, count(*) FILTER (label = 'malicious' AND NOT hit) AS false_negatives,
    count(*) FILTER (label = 'ambiguous') AS ambiguous_total, count(*) FILTER (label = 'ambiguous' AND hit) AS ambiguous_alerted
  FROM (SELECT label, e IN (SELECT e FROM tg) AS hit FROM ev)
)"""


@query("confusion_matrix", with_alerts("SELECT * FROM cm", STRETCH, _MATRIX))
def confusion_matrix(spark, sf_dir):
    d = desk(spark, sf_dir)
    return evaluate.confusion(d.events, d.alert_evidence)


@query("detection_metrics", with_alerts("""
SELECT round(p, 4) AS precision, round(r, 4) AS recall, round(2 * p * r / (p + r), 4) AS f1,
  round((true_positives + true_negatives) / (true_positives + true_negatives + false_positives + false_negatives), 4) AS accuracy,
  round(false_positives / (false_positives + true_negatives), 4) AS false_positive_rate, round(ambiguous_alerted / ambiguous_total, 4) AS ambiguous_alert_rate
FROM (SELECT *, true_positives / (true_positives + false_positives) AS p, true_positives / (true_positives + false_negatives) AS r FROM cm)""", STRETCH, _MATRIX))
def detection_metrics(spark, sf_dir):
    d = desk(spark, sf_dir)
    return evaluate.metrics(evaluate.confusion(d.events, d.alert_evidence)).select(
        "precision", "recall", "f1", "accuracy", "false_positive_rate", "ambiguous_alert_rate")


_EXPECTED = [(f"malicious-{i}", r) for i in range(5) for r in (
    "CREDENTIAL_FILE_ACCESS_001", "IOC_MATCH_001", "CLOUD_IAM_PRIVESC_001", "PRIVESC_SUDO_CHAIN_001")]
_EXPECTED_SQL = "ex AS (SELECT * FROM (VALUES " + ", ".join(f"('{s}', '{r}')" for s, r in _EXPECTED) + ") t(scenario, rule_id))"
_SCENARIO = """
sl AS (SELECT ae.alert_id, al0.rule_id, al0.detected_us, ev.label_scenario AS scenario, ev.label, ev.e FROM ae JOIN al0 USING (alert_id) JOIN ev USING (e)),
sb AS (
  SELECT label_scenario AS scenario, min(label) AS label, count(*) AS events, count(*) FILTER (e IN (SELECT e FROM tg)) AS detected_events, min(us) AS first_us FROM ev GROUP BY 1
), sx AS (
  SELECT sb.*, coalesce(n, 0) AS alert_count, first_alert, coalesce(rules, []) AS rules FROM sb LEFT JOIN (
    SELECT scenario, count(DISTINCT alert_id) AS n, min(detected_us) AS first_alert, list_sort(list(DISTINCT rule_id)) AS rules FROM sl GROUP BY 1) USING (scenario)
)"""


def _scenarios(spark, sf_dir):
    d = desk(spark, sf_dir)
    expected = spark.createDataFrame(_EXPECTED, "scenario string, rule_id string")
    return evaluate.per_scenario(d.events, d.alerts, d.alert_evidence, expected)


@query("scenario_recall", with_alerts("""
SELECT scenario, label, events, detected_events, round(detected_events / events, 4) AS event_recall, alert_count, array_to_string(rules, ',') AS rules_fired,
  CASE WHEN alert_count > 0 THEN round(greatest(0, first_alert - first_us) / 1000.0, 1) END AS latency_ms,
  coalesce(array_to_string(list_sort(list_filter(w, lambda x: list_contains(rules, x))), ','), '') AS expected_fired,
  coalesce(array_to_string(list_sort(list_filter(w, lambda x: NOT list_contains(rules, x))), ','), '') AS expected_missed
FROM sx LEFT JOIN (SELECT scenario, list(rule_id) AS w FROM ex GROUP BY 1) USING (scenario)""", STRETCH, _MATRIX, _SCENARIO, _EXPECTED_SQL))
def scenario_recall(spark, sf_dir):
    text = lambda c: F.coalesce(F.array_join(c, ","), F.lit("")).alias(c)
    return _scenarios(spark, sf_dir).select(
        "scenario", "label", "events", "detected_events", "event_recall", "alert_count", text("rules_fired"), "latency_ms",
        text("expected_fired"), text("expected_missed"))


@query("latency_stats", with_alerts("""
SELECT count(*) AS count, round(median(w) / 1000.0, 1) AS median_ms, round(avg(w) / 1000.0, 1) AS mean_ms,
  round(max(w) FILTER (rn = CAST(round_even(0.95 * (n - 1), 0) AS BIGINT)) / 1000.0, 1) AS p95_ms, round(min(w) / 1000.0, 1) AS min_ms, round(max(w) / 1000.0, 1) AS max_ms
FROM (SELECT w, row_number() OVER (ORDER BY w) - 1 AS rn, count(*) OVER () AS n FROM (
  SELECT greatest(0, first_alert - first_us) AS w FROM sx WHERE label = 'malicious' AND alert_count > 0))""", STRETCH, _MATRIX, _SCENARIO))
def latency_stats(spark, sf_dir):
    return evaluate.latency_stats(_scenarios(spark, sf_dir))


@query("per_rule_precision", with_alerts("""
SELECT rule_id, count(DISTINCT alert_id) AS alerts, count(*) FILTER (label = 'malicious') AS true_positive_events, count(*) FILTER (label = 'benign') AS false_positive_events,
  count(*) FILTER (label = 'ambiguous') AS ambiguous_events,
  CASE WHEN count(*) FILTER (label <> 'ambiguous') > 0 THEN round(count(*) FILTER (label = 'malicious') / count(*) FILTER (label <> 'ambiguous'), 4) ELSE 1.0 END AS event_precision
FROM sl GROUP BY 1""", STRETCH, _MATRIX, _SCENARIO))
def per_rule_precision(spark, sf_dir):
    d = desk(spark, sf_dir)
    return evaluate.per_rule(d.events, d.alerts, d.alert_evidence)


@query("silent_rules", with_alerts("SELECT rule_id FROM rl WHERE rule_id NOT IN (SELECT rule_id FROM al0)", STRETCH))
def silent_rules(spark, sf_dir):
    d = desk(spark, sf_dir)
    return evaluate.silent_rules(detect.rule_table(spark, d.rules), d.alerts)


@query("scenario_coverage", with_alerts("""
SELECT run_id, array_to_string(list_filter(x, lambda t: list_contains(d, t)), ',') AS covered, array_to_string(list_filter(x, lambda t: NOT list_contains(d, t)), ',') AS missed,
  array_to_string(list_filter(d, lambda t: NOT list_contains(x, t)), ',') AS additional, round(len(list_filter(x, lambda t: list_contains(d, t))) / len(x), 3) AS coverage_ratio
FROM (SELECT x.run_id, x.x, coalesce(d.d, []) AS d FROM (SELECT scenario AS run_id, list_sort(list(DISTINCT t)) AS x FROM (SELECT scenario, unnest(rl.techniques) AS t FROM ex JOIN rl USING (rule_id)) GROUP BY 1) x
LEFT JOIN (SELECT scenario AS run_id, list_sort(list(DISTINCT t)) AS d FROM (SELECT sl.scenario, unnest(rl.techniques) AS t FROM sl JOIN rl USING (rule_id) WHERE scenario LIKE 'malicious%') GROUP BY 1) d USING (run_id))""",
    STRETCH, _MATRIX, _SCENARIO, _EXPECTED_SQL))
def scenario_coverage(spark, sf_dir):
    """Techniques each malicious scenario should exercise against those that fired."""
    d = desk(spark, sf_dir)
    rules = detect.rule_table(spark, d.rules).select("rule_id", F.explode("technique_ids").alias("technique_id"))
    expected = spark.createDataFrame(_EXPECTED, "run_id string, rule_id string").join(rules, "rule_id").select("run_id", "technique_id")
    fired = d.alert_evidence.select("alert_id", "event_id").join(d.alerts.select("alert_id", F.explode("technique_ids").alias("technique_id")), "alert_id")
    scenarios = d.events.filter(F.col("label") == "malicious").select("event_id", F.col("label_scenario").alias("run_id"))
    text = lambda c: F.array_join(c, ",").alias(c)
    return evaluate.scenario_coverage(expected, fired.join(scenarios, "event_id").select("run_id", "technique_id")).select(
        "run_id", text("covered"), text("missed"), text("additional"), "coverage_ratio")


@query("stage_log", with_ev("""
SELECT label_scenario AS stage, count(*) AS record_count, array_to_string(list_sort(list(DISTINCT source)), ',') AS sources, min(us) AS first_us, max(us) AS last_us,
  (min(us) - 1704067200000000) // 1000000 AS offset_seconds FROM ev GROUP BY 1"""))
def stage_log(spark, sf_dir):
    return evaluate.stage_log(desk(spark, sf_dir).events, 1_704_067_200_000_000)


# ---- response and reports -------------------------------------------------------------------------
_PLAYBOOKS = "pb AS (SELECT * FROM (VALUES " + ", ".join(
    f"({i}, '{n}', {rules!r}, {techniques!r})" for i, (n, rules, techniques) in enumerate(respond.PLAYBOOKS)) + ") t(place, playbook_id, rules, techs))"
_RANKED = """
pr AS (SELECT incident_id, playbook_id, place, 3 * len(list_intersect(string_split(rule_ids, ','), rules)) + len(list_intersect(string_split(technique_ids, ','), techs)) AS score FROM inc, pb),
px AS (SELECT *, row_number() OVER (PARTITION BY incident_id ORDER BY score DESC, place) AS rn FROM pr WHERE score > 0)"""


@query("playbook_ranking", with_cases("SELECT incident_id, playbook_id, score, rn AS rank FROM px", STRETCH, _PLAYBOOKS, _RANKED))
def playbook_ranking(spark, sf_dir):
    return respond.rank_playbooks(desk(spark, sf_dir).incidents).select(
        "incident_id", "playbook_id", F.col("score").cast("bigint").alias("score"), F.col("rank").cast("bigint").alias("rank"))


@query("recommended_actions", with_cases("""
SELECT p.*, px.playbook_id FROM (
  SELECT incident_id, 'isolate_host' AS action_type, value AS target, CASE WHEN 1 + CAST(substr(value, 6) AS INTEGER) % 5 >= 4 THEN 'high' ELSE 'medium' END AS priority
    FROM ien WHERE kind = 'host' AND CAST(substr(value, 6) AS INTEGER) % 7 <> 0
      AND NOT (CAST(substr(incident_id, 10) AS INTEGER) % 3 = 0 AND value = (SELECT min(x.value) FROM ien x WHERE x.incident_id = ien.incident_id AND x.kind = 'host'))
  UNION ALL SELECT incident_id, 'disable_account', value, CASE WHEN CAST(substr(value, 6) AS INTEGER) % 10 = 0 THEN 'high' ELSE 'medium' END
    FROM ien WHERE kind = 'user' AND role = 'affected' AND CAST(substr(value, 6) AS INTEGER) % 17 <> 0
  UNION ALL SELECT incident_id, 'block_ioc', value, 'medium' FROM ien WHERE kind = 'source_ip' AND value LIKE '203.%'
  UNION ALL SELECT incident_id, 'collect_evidence', incident_id, 'high' FROM inc) p LEFT JOIN px ON px.incident_id = p.incident_id AND px.rn = 1""", STRETCH, _PLAYBOOKS, _RANKED))
def recommended_actions(spark, sf_dir):
    d = desk(spark, sf_dir)
    return respond.recommended_actions(d.incidents, d.incident_entities, d.hosts, d.users, d.response_actions)


@query("similar_incidents", with_cases("""
SELECT base_id, incident_id, similarity, rank FROM (
  SELECT base_id, incident_id, round(round(s, 9), 3) AS similarity, row_number() OVER (PARTITION BY base_id ORDER BY round(round(s, 9), 3) DESC, incident_id) AS rank FROM (
    SELECT b.incident_id AS base_id, c.incident_id,
      0.45 * len(list_intersect(b.t, c.t)) / len(list_distinct(list_concat(b.t, c.t))) + 0.30 * len(list_intersect(b.r, c.r)) / len(list_distinct(list_concat(b.r, c.r)))
      + 0.15 * len(list_intersect(b.k, c.k)) / len(list_distinct(list_concat(b.k, c.k))) + 0.10 * CASE WHEN b.severity = c.severity THEN 1 ELSE 0 END AS s
    FROM bs b JOIN bs c ON b.incident_id <> c.incident_id WHERE b.incident_id IN ('INC-2024-0003', 'INC-2024-0010', 'INC-2024-0042')) WHERE s > 0) WHERE rank <= 5""", STRETCH, """
bs AS (SELECT inc.incident_id, severity, string_split(technique_ids, ',') AS t, string_split(rule_ids, ',') AS r, coalesce(k, []) AS k FROM inc
  LEFT JOIN (SELECT incident_id, list(entity) AS k FROM ik GROUP BY 1) USING (incident_id))"""))
def similar_incidents(spark, sf_dir):
    d = desk(spark, sf_dir)
    found = respond.similar_incidents(d.incidents, d.incident_keys, ["INC-2024-0003", "INC-2024-0010", "INC-2024-0042"])
    return found.select("base_id", "incident_id", "similarity", F.col("rank").cast("bigint").alias("rank"))


@query("report_timeline", with_cases(f"""
SELECT incident_id, row, event_id, {SUMMARY_SQL} AS summary FROM (
  SELECT ie.incident_id, ev.*, row_number() OVER (PARTITION BY ie.incident_id ORDER BY us, event_id) AS row FROM ie JOIN ev USING (e)) WHERE row <= 120""", STRETCH))
def report_timeline(spark, sf_dir):
    return reports.report_sections(desk(spark, sf_dir))["timeline"].select("incident_id", F.col("row").cast("bigint").alias("row"), "event_id", "summary")


@query("report_sections", with_cases("""
SELECT 'overview' AS section, count(*) AS rows FROM inc
UNION ALL SELECT 'risk', 6 * count(*) FROM inc UNION ALL SELECT 'confidence', 6 * count(*) FROM inc
UNION ALL SELECT 'progression', count(*) FROM ich UNION ALL SELECT 'assets', count(*) FROM ien WHERE kind = 'host'
UNION ALL SELECT 'accounts', count(*) FROM ien WHERE kind = 'user' AND role = 'affected' UNION ALL SELECT 'targeted_accounts', count(*) FROM ien WHERE kind = 'user' AND role = 'targeted'
UNION ALL SELECT 'indicators', count(*) FROM (SELECT DISTINCT incident_id, ioc_id, matched_field FROM ie JOIN im USING (e))
UNION ALL SELECT 'addresses', count(*) FROM ien WHERE kind IN ('source_ip', 'destination_ip') UNION ALL SELECT 'attack_mapping', count(*) FROM it
UNION ALL SELECT 'detections', count(*) FROM ia UNION ALL SELECT 'root_cause', count(*) FROM inc
UNION ALL SELECT 'rules', count(*) FROM (SELECT DISTINCT incident_id, rule_id FROM ia) UNION ALL SELECT 'executive_summary', count(*) FROM inc
UNION ALL SELECT 'playbook', count(*) FROM px WHERE rn = 1""", STRETCH, _PLAYBOOKS, _RANKED))
def report_sections(spark, sf_dir):
    """Rows of every report section over all incidents."""
    sections = reports.report_sections(desk(spark, sf_dir))
    out = None
    for name in ("overview", "risk", "confidence", "progression", "assets", "accounts", "targeted_accounts", "indicators", "addresses",
                 "attack_mapping", "detections", "root_cause", "rules", "executive_summary", "playbook"):
        part = sections[name].agg(F.count("*").alias("rows")).select(F.lit(name).alias("section"), "rows")
        out = part if out is None else out.unionByName(part)
    return out


@query("root_cause", with_cases("""
SELECT inc.incident_id, f.event_id AS first_event_id, coalesce(ich.tactic, 'unclassified activity') AS initial_tactic,
  CASE WHEN t && ['T1110', 'T1110.001', 'T1110.003'] THEN 'credential_guessing' WHEN t && ['T1078', 'T1078.004'] THEN 'stolen_credentials' ELSE 'unknown' END AS entry,
  array_to_string(list_filter([CASE WHEN f.zero THEN 'second_root_account' END, CASE WHEN t && ['T1098', 'T1098.004'] THEN 'account_or_key_changed' END,
    CASE WHEN t && ['T1562', 'T1562.008'] THEN 'audit_logging_disabled' END], lambda x: x IS NOT NULL), ',') AS factors
FROM (SELECT *, string_split(technique_ids, ',') AS t FROM inc) inc
LEFT JOIN (SELECT incident_id, arg_min(event_id, (us, event_id)) AS event_id, bool_or(coalesce(m_uid_zero, FALSE)) AS zero FROM ie JOIN ev USING (e) GROUP BY 1) f USING (incident_id)
LEFT JOIN ich ON ich.incident_id = inc.incident_id AND ich.stage = 1""", STRETCH))
def root_cause(spark, sf_dir):
    d = desk(spark, sf_dir)
    return reports.root_cause(d.incidents, d.incident_events, d.chain).select(
        "incident_id", "first_event_id", "initial_tactic", "entry", F.array_join("factors", ",").alias("factors"))


@query("executive_summary", with_cases(f"""
SELECT incident_id, concat_ws('; ',
  'rating ' || severity || ', risk ' || CAST(round(risk_score, 0) AS INTEGER) || '/100', 'state open',
  'evidence ' || alert_count || ' detections, ' || event_count || ' events',
  'scope ' || coalesce(h.n, 0) || ' hosts, ' || coalesce(a.n, 0) || ' accounts, ' || coalesce(t.n, 0) || ' targeted',
  'time ' || strftime(make_timestamp(first_us), '%Y-%m-%d %H:%M:%S') || ' to ' || strftime(make_timestamp(last_us), '%Y-%m-%d %H:%M:%S'),
  CASE WHEN stages IS NOT NULL THEN 'stages ' || lower(stages) END, CASE WHEN origin IS NOT NULL THEN 'outside ' || origin END) AS body
FROM inc
LEFT JOIN (SELECT incident_id, count(*) AS n FROM ien WHERE kind = 'host' GROUP BY 1) h USING (incident_id)
LEFT JOIN (SELECT incident_id, count(*) AS n FROM ien WHERE kind = 'user' AND role = 'affected' GROUP BY 1) a USING (incident_id)
LEFT JOIN (SELECT incident_id, count(*) AS n FROM ien WHERE kind = 'user' AND role = 'targeted' GROUP BY 1) t USING (incident_id)
LEFT JOIN (SELECT incident_id, min(value) AS origin FROM ien WHERE kind = 'source_ip' AND value LIKE '203.%' GROUP BY 1) o USING (incident_id)
LEFT JOIN (SELECT incident_id, string_agg(tactic, ' > ' ORDER BY stage) AS stages FROM ich GROUP BY 1) s USING (incident_id)""", STRETCH))
def executive_summary(spark, sf_dir):
    """One paragraph per incident."""
    d = desk(spark, sf_dir)
    return reports.executive_summary(d.incidents, d.incident_entities)


@query("evidence_list", with_cases("SELECT incident_id, event_id, us FROM ie JOIN ev USING (e)", STRETCH))
def evidence_list(spark, sf_dir):
    """Evidence of every incident."""
    return timeline.evidence_list(desk(spark, sf_dir).incident_events)


@query("even_sample", with_ev("""
SELECT host, event_id FROM (
  SELECT *, greatest(0, 60 - least(hits, 60)) AS remaining FROM (
    SELECT host, event_id, us, t, count(*) OVER (PARTITION BY host) AS n, count(*) FILTER (t) OVER (PARTITION BY host) AS hits,
      row_number() OVER (PARTITION BY host, t ORDER BY us, event_id) AS rn
    FROM (SELECT host, event_id, us, event_type IN ('privilege', 'service') AS t FROM ev WHERE host IS NOT NULL)))
WHERE n <= 60 OR (t AND rn <= 60) OR (NOT t AND remaining > 0 AND (rn - 1) % greatest(1, (n - hits) // greatest(1, remaining)) = 0
  AND (rn - 1) // greatest(1, (n - hits) // greatest(1, remaining)) < remaining)"""))
def even_sample(spark, sf_dir):
    """Sixty events per host: privilege and service events first, the rest evenly spread."""
    rows = desk(spark, sf_dir).events.filter(F.col("host").isNotNull()).select("host", "event_id", "event_type", micros().alias("us"))
    return reports.even_sample(rows, "host", "us", F.col("event_type").isin("privilege", "service"), 60).select("host", "event_id")


@query("evidence_bundle", with_cases("""
SELECT incident_id, least(event_count, 60) AS events, event_count - least(event_count, 60) AS omitted, rule_ids AS rules FROM inc""", STRETCH))
def evidence_bundle(spark, sf_dir):
    return reports.evidence_bundle(desk(spark, sf_dir)).select(
        "incident_id", F.size("events").cast("bigint").alias("events"), "omitted", F.array_join("rules", ",").alias("rules"))
