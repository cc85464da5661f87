"""Detectors over the whole event table: matches, windows, ordered steps, indicators and baselines."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import functions as F

from eventwarden.functions.net import is_external
from eventwarden.model import micros
from eventwarden.operators import baseline
from eventwarden.operators.conditions import compile_selection
from eventwarden.operators.groups import group_text
from eventwarden.operators.indicators import match_indicators
from eventwarden.operators.match import match_rules
from eventwarden.operators.sequence import rule_sequence, sequence_evidence
from eventwarden.operators.threshold import ThresholdSpec, threshold_evidence
from eventwarden.plans import detect
from eventwarden.plans.desk import STRETCH, desk
from eventwarden.plans.lookback import lookback_candidates
from eventwarden.plans.rulepack import Rule, rule, rules_of, stretched
from eventwarden.registry import sql as S
from eventwarden.registry.base import query
from eventwarden.registry.sql import with_ev

# The test feed is sparse; the single-rule queries look through wider windows than the stored desk.
WIDE = 8640
DAY = 86_400


# ---- match ----------------------------------------------------------------------------------------
@query("match_rules_union", with_ev(
    "SELECT rule_id, event_id, array_to_string(list_transform(parts, lambda x: coalesce(x, '(none)')), '|') AS group_text FROM mt",
    S.match_ctes()))
def match_rules_union(spark, sf_dir):
    """Every match rule in one pass."""
    d = desk(spark, sf_dir)
    return match_rules(d.events, rules_of("match")).select("rule_id", "event_id", group_text("group_key").alias("group_text"))


def _match_rule(rule_id: str) -> None:
    @query(f"rule_{rule_id.lower()}", with_ev(
        f"SELECT event_id, array_to_string(list_transform(parts, lambda x: coalesce(x, '(none)')), '|') AS group_text FROM mt WHERE rule_id = '{rule_id}'",
        S.match_ctes()))
    def run(spark, sf_dir):
        return match_rules(desk(spark, sf_dir).events, [rule(rule_id)]).select(
            "event_id", group_text("group_key").alias("group_text"))


for _rule in rules_of("match"):
    _match_rule(_rule.id)


# ---- threshold ------------------------------------------------------------------------------------
def _specs(rules):
    return [ThresholdSpec(r, r.count, r.window_seconds, r.distinct_field, r.distinct_count) for r in rules]


def _span(evidence):
    return evidence.groupBy("rule_id", "g").agg(
        F.first("group_key").alias("group_key"), F.count("*").alias("match_count"), F.min("us").alias("first_us"),
        F.max("us").alias("last_us"), F.count_distinct("d").alias("values"),
    )


_FAILED_3 = Rule("FAILED_3", "threshold", "", "high", 0.8, "", (), (), selection={
    "event_type": "authentication", "status": "failure"}, group_by=("user",), count=3, window_seconds=DAY)

_COUNT_SQL = """
r AS (
  SELECT lower("user") AS g, us, event_id FROM ev WHERE event_type = 'authentication' AND status = 'failure'
), w AS (
  SELECT *, count(*) OVER win AS n, min(us) OVER win AS left_us FROM r
  WINDOW win AS (PARTITION BY g ORDER BY us RANGE BETWEEN 86400000000 PRECEDING AND CURRENT ROW)
), f AS (SELECT g, arg_min(left_us, us) AS left_us FROM w WHERE n >= 3 GROUP BY g)"""


@query("threshold_count", with_ev("""
SELECT coalesce(r.g, '(none)') AS "user", count(*) AS match_count, min(r.us) AS first_us, max(r.us) AS last_us
FROM r JOIN f ON r.g IS NOT DISTINCT FROM f.g WHERE r.us BETWEEN f.left_us AND f.left_us + 86400000000 GROUP BY 1""", _COUNT_SQL))
def threshold_count(spark, sf_dir):
    """Accounts with three failed logins inside a day: the first such window of each."""
    spans = _span(threshold_evidence(desk(spark, sf_dir).events, _specs([_FAILED_3])))
    return spans.select(group_text("group_key").alias("user"), "match_count", "first_us", "last_us")


@query("threshold_evidence", with_ev("""
SELECT coalesce(r.g, '(none)') AS "user", r.event_id FROM r JOIN f ON r.g IS NOT DISTINCT FROM f.g
WHERE r.us BETWEEN f.left_us AND f.left_us + 86400000000""", _COUNT_SQL))
def threshold_evidence_rows(spark, sf_dir):
    return threshold_evidence(desk(spark, sf_dir).events, _specs([_FAILED_3])).select(
        group_text("group_key").alias("user"), "event_id")


_FAILED_USERS = replace(_FAILED_3, id="FAILED_USERS", group_by=("source_ip",), distinct_field="user", distinct_count=2)


@query("threshold_distinct", with_ev("""
SELECT r.g AS source_ip, count(*) AS match_count, count(DISTINCT d) AS "values", min(r.us) AS first_us, max(r.us) AS last_us
FROM r JOIN f ON r.g = f.g WHERE r.us BETWEEN f.left_us AND f.left_us + 86400000000 GROUP BY 1""", """
r AS (
  SELECT source_ip AS g, us, event_id, lower("user") AS d FROM ev WHERE event_type = 'authentication' AND status = 'failure'
), w AS (
  SELECT a.g, a.us, a.event_id, min(b.us) AS left_us FROM r a JOIN r b ON a.g = b.g AND b.us BETWEEN a.us - 86400000000 AND a.us
  GROUP BY a.g, a.us, a.event_id HAVING count(*) >= 3 AND count(DISTINCT b.d) >= 2
), f AS (SELECT g, arg_min(left_us, us) AS left_us FROM w GROUP BY g)"""))
def threshold_distinct(spark, sf_dir):
    spans = _span(threshold_evidence(desk(spark, sf_dir).events, _specs([_FAILED_USERS])))
    return spans.select(group_text("group_key").alias("source_ip"), "match_count", "values", "first_us", "last_us")


def _threshold_rule(rule_id: str) -> None:
    @query(f"rule_{rule_id.lower()}", with_ev(
        "SELECT array_to_string(list_transform(any_value(parts), lambda x: coalesce(x, '(none)')), '|') AS group_text, "
        "count(*) AS match_count, min(us) AS first_us, max(us) AS last_us FROM te GROUP BY rule_id, g",
        S.threshold_ctes(WIDE, [rule_id])))
    def run(spark, sf_dir):
        chosen = rule(rule_id, stretched(WIDE))
        spans = _span(threshold_evidence(desk(spark, sf_dir).events, _specs([chosen])))
        return spans.select(group_text("group_key").alias("group_text"), "match_count", "first_us", "last_us")


for _rule in rules_of("threshold"):
    _threshold_rule(_rule.id)


# ---- sequence -------------------------------------------------------------------------------------
def _sequence_rule(rule_id: str, source: str, ctes: str, stretch: int = 144) -> None:
    @query(f"rule_{rule_id.lower()}", with_ev(
        "SELECT array_to_string(list_transform(parts, lambda x: coalesce(x, '(none)')), '|') AS group_text, event_id, "
        f"CAST(step AS BIGINT) AS step FROM {source}", ctes))
    def run(spark, sf_dir):
        chosen = rule(rule_id, stretched(stretch))
        evidence = sequence_evidence(desk(spark, sf_dir).events, [rule_sequence(chosen)])
        return evidence.select(group_text("group_key").alias("group_text"), "event_id", F.col("step_index").cast("bigint").alias("step"))


for _id, _factor in (("BRUTE_FORCE_003", 144), ("PRIVESC_SUDO_CHAIN_001", 1440), ("CLOUD_IAM_KEY_CHAIN_001", 144)):
    _sequence_rule(_id, "se", S.two_step_ctes(_factor, [_id]), _factor)
_sequence_rule("LATERAL_MOVEMENT_001", "le", S.lateral_ctes(144))


# ---- indicators -----------------------------------------------------------------------------------
@query("ioc_match", with_ev("SELECT ioc_id, event_id, matched_field, ioc_confidence FROM im", S.INDICATORS))
def ioc_match(spark, sf_dir):
    d = desk(spark, sf_dir)
    return match_indicators(d.events, d.indicators, ["source_ip", "destination_ip", "file_hash"]).select(
        "ioc_id", "event_id", "matched_field", "ioc_confidence")


@query("rule_ioc_match_001", with_ev("""
SELECT event_id, matched_field, ioc_severity AS severity, round(least(0.99, ioc_confidence * 0.85 + 0.1), 3) AS confidence FROM im""", S.INDICATORS))
def rule_ioc(spark, sf_dir):
    d = desk(spark, sf_dir)
    return detect.ioc_evidence(d.events, rules_of("ioc"), d.indicators).select("event_id", "matched_field", "severity", "confidence")


@query("ioc_match_counts", with_ev("""
SELECT ioc_id, count(*) AS matches, max(us) AS last_us FROM (SELECT DISTINCT ioc_id, event_id, matched_field, us FROM im) GROUP BY 1""", S.INDICATORS))
def ioc_match_counts(spark, sf_dir):
    """Match counter and last sighting per indicator."""
    return desk(spark, sf_dir).ioc_matches.groupBy("ioc_id").agg(F.count("*").alias("matches"), F.max("us").alias("last_us"))


# ---- baselines and anomalies ----------------------------------------------------------------------
@query("baseline_frequencies", with_ev("""
SELECT u_ref AS entity_ref, feature, v AS value, count(*) AS n, sum(count(*)) OVER (PARTITION BY u_ref, feature)::BIGINT AS observation_count
FROM ob GROUP BY u_ref, feature, v""", S.HISTORY))
def baseline_frequencies(spark, sf_dir):
    return baseline.frequency_table(desk(spark, sf_dir).events).select("entity_ref", "feature", "value", "n", "observation_count")


@query("baseline_top_values", with_ev("""
SELECT entity_ref, feature, value, n FROM (
  SELECT u_ref AS entity_ref, feature, v AS value, count(*) AS n,
         row_number() OVER (PARTITION BY u_ref, feature ORDER BY count(*) DESC, v) AS rn FROM ob GROUP BY 1, 2, 3)
WHERE rn <= 5""", S.HISTORY))
def baseline_top_values(spark, sf_dir):
    """Baselines keeping the five most observed values."""
    return baseline.frequency_table(desk(spark, sf_dir).events, keep=5).select("entity_ref", "feature", "value", "n")


@query("baseline_login_hours", with_ev("""
SELECT u_ref AS entity_ref, count(*) AS observations, count(DISTINCT v) AS distinct_hours, min(CAST(v AS BIGINT)) AS low, max(CAST(v AS BIGINT)) AS high
FROM ob WHERE feature = 'login_hours' GROUP BY 1""", S.HISTORY))
def baseline_login_hours(spark, sf_dir):
    hours = F.transform(F.map_keys("frequencies"), lambda k: k.cast("bigint"))
    wide = baseline.as_maps(baseline.frequency_table(desk(spark, sf_dir).events).filter("feature = 'login_hours'"))
    return wide.select("entity_ref", F.col("observation_count").alias("observations"),
                       F.size("frequencies").cast("bigint").alias("distinct_hours"), F.array_min(hours).alias("low"), F.array_max(hours).alias("high"))


@query("baseline_snapshot", with_ev("""
SELECT u_ref AS entity_ref, feature, v AS value, count(*) AS n FROM ob
WHERE u_ref IN (SELECT lower("user") FROM ev WHERE event_type = 'account' AND "user" IS NOT NULL) GROUP BY 1, 2, 3""", S.HISTORY))
def baseline_snapshot(spark, sf_dir):
    """Baselines of the accounts that had account changes."""
    events = desk(spark, sf_dir).events
    changed = events.filter("event_type = 'account'").select("user")
    return baseline.snapshot(baseline.frequency_table(events), changed).select("entity_ref", "feature", "value", "n")


@query("baseline_point_in_time", with_ev("""
SELECT s.event_id, ip_n, ip_d, ip_seen, ip_ext, host_n, host_seen, hour_n, hour_d, api_n, api_seen,
       CAST(hour_lo AS BIGINT) AS hour_lo, CAST(hour_hi AS BIGINT) AS hour_hi
FROM sce s JOIN hi USING (e)""", S.HISTORY))
def baseline_point_in_time(spark, sf_dir):
    """What each scored event's account had done before the event's hour."""
    events = desk(spark, sf_dir).events
    login = (F.col("event_type") == "authentication") & (F.col("status") == "success")
    scored = events.filter(F.col("user").isNotNull() & (login | F.col("cloud_account").isNotNull()))
    h = baseline.with_history(scored, events)
    return h.select(
        "event_id", F.col("source_ips_count").alias("ip_n"), F.col("source_ips_known").alias("ip_d"),
        F.col("source_ips_seen").alias("ip_seen"), F.coalesce("source_ips_external", F.lit(False)).alias("ip_ext"),
        F.col("hosts_count").alias("host_n"), F.col("hosts_seen").alias("host_seen"), F.col("login_hours_count").alias("hour_n"),
        F.col("login_hours_known").alias("hour_d"), F.col("cloud_apis_count").alias("api_n"), F.col("cloud_apis_seen").alias("api_seen"),
        F.col("login_hours_low").cast("bigint").alias("hour_lo"), F.col("login_hours_high").cast("bigint").alias("hour_hi"))


def _anomaly_rule(rule_id: str) -> None:
    @query(f"rule_{rule_id.lower()}", with_ev(
        f"SELECT event_id, score AS anomaly_score, severity, round(least(0.95, 0.40 + score * 0.55), 3) AS confidence FROM an WHERE rule_id = '{rule_id}'",
        S.HISTORY, S.ANOMALY))
    def run(spark, sf_dir):
        events = desk(spark, sf_dir).events
        return detect.anomaly_evidence(events, [rule(rule_id)], events).select("event_id", "anomaly_score", "severity", "confidence")


for _rule in rules_of("anomaly"):
    _anomaly_rule(_rule.id)


@query("anomaly_factors", with_ev("""
SELECT event_id, array_to_string(list_filter([CASE WHEN f_ip THEN 'new_source_ip' END, CASE WHEN f_ext THEN 'external_source' END,
  CASE WHEN f_off THEN 'off_hours' END, CASE WHEN f_host THEN 'new_host' END], lambda x: x IS NOT NULL), ',') AS factors
FROM as1 WHERE score >= 0.45""", S.HISTORY, S.ANOMALY))
def anomaly_factors(spark, sf_dir):
    """Which factors made each anomalous login."""
    events = desk(spark, sf_dir).events
    rows = detect.anomaly_evidence(events, [rule("VALID_ACCOUNT_ABUSE_001")], events)
    return rows.select("event_id", F.array_join(F.transform("factors", lambda f: f["name"]), ",").alias("factors"))


@query("off_hours", with_ev("""
SELECT s.event_id FROM sce s JOIN hi USING (e) WHERE s.event_type = 'authentication' AND s.status = 'success'
 AND hour_n >= 8 AND hour_d >= 4 AND hour_hi - hour_lo <= 22 AND hour(s.ts) NOT BETWEEN hour_lo AND hour_hi""", S.HISTORY))
def off_hours(spark, sf_dir):
    """Logins outside the account's observed hours, with a wide allowance for long days."""
    from eventwarden.operators.anomaly import off_hours as test

    events = desk(spark, sf_dir).events
    logins = events.filter((F.col("event_type") == "authentication") & (F.col("status") == "success") & F.col("user").isNotNull())
    h = baseline.with_history(logins, events)
    return h.filter(test("login_hours", F.hour("timestamp"), 8, {"max_active_span_hours": 22})).select("event_id")


@query("external_logins", with_ev("""
SELECT lower("user") AS "user", count(*) AS logins, count(DISTINCT source_ip) AS addresses FROM ev
WHERE event_type = 'authentication' AND status = 'success' AND source_ip LIKE '203.%' GROUP BY 1"""))
def external_logins(spark, sf_dir):
    logins = desk(spark, sf_dir).events.filter(
        compile_selection({"event_type": "authentication", "status": "success"}) & is_external(F.col("source_ip")))
    return logins.groupBy(F.lower("user").alias("user")).agg(F.count("*").alias("logins"), F.count_distinct("source_ip").alias("addresses"))


# ---- the whole pass -------------------------------------------------------------------------------
@query("detections", with_ev("""
SELECT rule_id, kind AS rule_type, severity, confidence, group_text, evidence_count, first_us, last_us FROM dt""", S.detection_ctes(STRETCH)))
def detections(spark, sf_dir):
    """Every detection of the pack."""
    return desk(spark, sf_dir).detections.select(
        "rule_id", "rule_type", "severity", "confidence", group_text("group_key").alias("group_text"), "evidence_count", "first_us", "last_us")


@query("detection_evidence", with_ev("SELECT rule_id, event_id, count(*) AS n FROM ed GROUP BY ALL", S.detection_ctes(STRETCH)))
def detection_evidence(spark, sf_dir):
    return desk(spark, sf_dir).evidence.groupBy("rule_id", "event_id").agg(F.count("*").alias("n"))


@query("detection_order", with_ev("""
SELECT row_number() OVER (ORDER BY last_us DESC, rule_id DESC, detection_id) AS place, rule_id, last_us FROM dt""", S.detection_ctes(STRETCH)))
def detection_order(spark, sf_dir):
    """The place of every detection in their fixed order."""
    placed = detect.detection_order(desk(spark, sf_dir).detections.select("detected_us", "rule_id", "detection_id"))
    return placed.select("place", "rule_id", F.col("detected_us").alias("last_us"))


@query("rule_firings", with_ev("""
SELECT rl.rule_id, count(dt.detection_id) AS trigger_count, max(dt.last_us) AS last_us FROM rl LEFT JOIN dt USING (rule_id) GROUP BY 1""", S.detection_ctes(STRETCH)))
def rule_firings(spark, sf_dir):
    """Firing counter and last firing per rule, silent rules included."""
    d = desk(spark, sf_dir)
    fired = d.detections.groupBy("rule_id").agg(F.count("*").alias("n"), F.max("last_us").alias("last_us"))
    table = detect.rule_table(spark, d.rules).select("rule_id")
    return table.join(fired, "rule_id", "left").select("rule_id", F.coalesce("n", F.lit(0)).alias("trigger_count"), "last_us")


@query("lookback_semi", with_ev("""
SELECT event_id FROM ev h WHERE us BETWEEN (SELECT min(us) FROM n) - 21600000000 AND (SELECT max(us) FROM n) AND (
     h.e IN (SELECT e FROM n) OR h.host IN (SELECT host FROM n) OR h."user" IN (SELECT "user" FROM n)
  OR h.cloud_account IN (SELECT cloud_account FROM n)
  OR h.source_ip IN (SELECT source_ip FROM n UNION SELECT destination_ip FROM n)
  OR h.destination_ip IN (SELECT source_ip FROM n UNION SELECT destination_ip FROM n))""",
    "n AS (SELECT * FROM ev WHERE us >= 1706140800000000 AND us < 1706144400000000)"))
def lookback_semi(spark, sf_dir):
    """History that a batch (one hour of the feed) needs: shared entities within six hours."""
    events = desk(spark, sf_dir).events
    batch = events.filter((micros() >= 1706140800000000) & (micros() < 1706144400000000))
    return lookback_candidates(events, batch, 21600).select("event_id")
