"""Alerts, their scores, and the incidents they form."""

from __future__ import annotations

import re

from pyspark.sql import functions as F

from eventwarden.operators import correlate
from eventwarden.plans import detect, incidents
from eventwarden.plans.desk import STRETCH, desk
from eventwarden.plans.rulepack import RULES
from eventwarden.registry import sql as S
from eventwarden.registry.base import query
from eventwarden.registry.sql import with_alerts, with_cases


# ---- alerts ---------------------------------------------------------------------------------------
@query("dedup_fold", with_alerts("""
SELECT alert_id, dedup_key, rule_id, kind AS rule_type, severity, confidence, group_text, detected_us, first_us, last_us,
       (detected_us - first_us) // 1000 AS detection_latency_ms, host, "user", source_ip, evidence_count, suppressed FROM al0""", STRETCH))
def dedup_fold(spark, sf_dir):
    return desk(spark, sf_dir).unscored_alerts.select(
        "alert_id", "dedup_key", "rule_id", "rule_type", "severity", "confidence", "group_text", "detected_us", "first_us", "last_us",
        "detection_latency_ms", "host", "user", "source_ip", "evidence_count", "suppressed")


@query("alert_links", with_alerts("SELECT alert_id, event_id FROM ae", STRETCH))
def alert_links(spark, sf_dir):
    return desk(spark, sf_dir).alert_evidence.select("alert_id", "event_id")


@query("alert_entities", with_alerts("SELECT alert_id, entity FROM ax", STRETCH))
def alert_entities(spark, sf_dir):
    return desk(spark, sf_dir).alert_entities


@query("alert_risk", with_alerts("SELECT alert_id, risk_score FROM sa0", STRETCH))
def alert_risk(spark, sf_dir):
    return desk(spark, sf_dir).scored_alerts.select("alert_id", "risk_score")


@query("risk_breakdown", with_alerts("""
SELECT alert_id, f.factor, f.contribution FROM (SELECT alert_id, unnest([
  {'factor': 'severity', 'contribution': r_severity}, {'factor': 'confidence', 'contribution': r_confidence},
  {'factor': 'asset', 'contribution': r_asset}, {'factor': 'behavioural', 'contribution': r_behavioural},
  {'factor': 'indicator', 'contribution': r_indicator}, {'factor': 'correlation', 'contribution': r_correlation}]) AS f FROM sa0)""", STRETCH))
def risk_breakdown(spark, sf_dir):
    return desk(spark, sf_dir).scored_alerts.select("alert_id", F.explode("risk_breakdown").alias("t")).select(
        "alert_id", "t.factor", "t.contribution")


def _title_sql() -> str:
    """Every rule's title in SQL: values of the trigger event, else of the group, else a mark."""
    branches = []
    for r in RULES:
        pieces = [] if r.title else [
            "'Known indicator seen: ' || coalesce(dt.parts[1], '(unknown)')" if r.kind == "ioc" else f"'{r.name}'"]
        for literal, name in re.findall(r"([^{]*)(?:\{([^}]*)\})?", r.title):
            if literal:
                pieces.append("'" + literal.replace("'", "''") + "'")
            if name:
                options = [f'CAST(ev."{name}" AS VARCHAR)'] if name in detect.TITLE_FIELDS else []
                if name in r.group_by:
                    options.append(f"dt.parts[{r.group_by.index(name) + 1}]")
                pieces.append(f"coalesce({', '.join([*options, chr(39) + '(unknown)' + chr(39)])})")
        branches.append(f"WHEN '{r.id}' THEN {' || '.join(pieces)}")
    return "CASE al0.rule_id " + " ".join(branches) + " END"


@query("alert_titles", with_alerts(
    f"SELECT alert_id, {_title_sql()} AS title FROM al0 JOIN dt USING (detection_id) JOIN ev ON ev.e = dt.trigger_e", STRETCH))
def alert_titles(spark, sf_dir):
    """Titles of all alerts, every rule's template filled."""
    return desk(spark, sf_dir).alerts.select("alert_id", "title")


def _group_words_sql() -> str:
    """Names and values of the group of threshold and sequence rules."""
    branches = []
    for r in RULES:
        if r.kind in ("threshold", "sequence"):
            words = " || ', ' || ".join(f"'{f}=' || coalesce(dt.parts[{i + 1}], '(none)')" for i, f in enumerate(r.group_by))
            branches.append(f"WHEN '{r.id}' THEN {words}")
    return "CASE al0.rule_id " + " ".join(branches) + " END"


def _rule_name_sql() -> str:
    return "CASE al0.rule_id " + " ".join(f"WHEN '{r.id}' THEN '{r.name.replace(chr(39), chr(39) * 2)}'" for r in RULES) + " END"


_SEEN_SQL = "concat_ws(', ', " + ", ".join(f"""'{c}=' || ev."{c}\"""" for c in detect.EXPLAINED_FIELDS) + ")"


@query("alert_explanations", with_alerts(f"""
SELECT alert_id, CASE al0.kind
  WHEN 'match' THEN {_rule_name_sql()} || ': ' || ev.event_type || '/' || coalesce(ev.action, 'event') || ' (' || {_SEEN_SQL} || ')'
  WHEN 'ioc' THEN CASE WHEN al0.ioc_id = 'IOC-200' THEN 'file_hash' ELSE 'source_ip' END || ' holds known indicator ' || al0.ioc_id
  WHEN 'threshold' THEN al0.evidence_count || ' events for ' || {_group_words_sql()}
    || ' within ' || greatest(1, (al0.last_us - al0.first_us) // 1000000) || 's (needs ' || need || ' in ' || win * {STRETCH} || 's)'
  WHEN 'sequence' THEN 'steps for ' || {_group_words_sql()} || ' within ' || greatest(1, (al0.last_us - al0.first_us) // 1000000) || 's of ' || win * {STRETCH} || 's'
  ELSE 'score ' || al0.score || ' from ' || coalesce(fc.n, 0) || ' factor(s)' END AS first_line
FROM al0 JOIN rl USING (rule_id, kind) JOIN dt USING (detection_id) JOIN ev ON ev.e = dt.trigger_e
LEFT JOIN fc ON fc.rule_id = al0.rule_id AND fc.e = dt.trigger_e""", STRETCH, """
fc AS (
  SELECT 'VALID_ACCOUNT_ABUSE_001' AS rule_id, e, f_ip::INT + f_ext::INT + f_off::INT + f_host::INT AS n FROM as1
  UNION ALL
  SELECT 'CLOUD_IAM_ANOMALY_001', e, f_api::INT + f_risk::INT + f_policy::INT + f_off::INT + f_ip::INT + f_mfa::INT FROM as2)"""))
def alert_explanations(spark, sf_dir):
    """First explanation line of all alerts, whatever their kind of rule."""
    return desk(spark, sf_dir).alerts.select("alert_id", F.get("explanation", F.lit(0)).alias("first_line"))


# ---- correlation ----------------------------------------------------------------------------------
@query("entity_islands", with_alerts("""
SELECT entity, min(first_us) AS first_us, max(last_us) AS last_us, count(*) AS alert_count FROM (
  SELECT *, sum(opens) OVER (PARTITION BY entity ORDER BY first_us, alert_id ROWS UNBOUNDED PRECEDING) AS run FROM (
    SELECT ax.entity, al0.alert_id, al0.first_us, al0.last_us,
      CASE WHEN al0.first_us - max(al0.last_us) OVER (PARTITION BY ax.entity ORDER BY al0.first_us, al0.alert_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) <= 1800000000
           THEN 0 ELSE 1 END AS opens
    FROM ax JOIN al0 USING (alert_id)))
GROUP BY entity, run""", STRETCH))
def entity_islands(spark, sf_dir):
    d = desk(spark, sf_dir)
    islands = correlate.entity_islands(d.unscored_alerts, d.alert_entities)
    return islands.join(d.unscored_alerts.select("alert_id", "first_us", "last_us"), "alert_id").groupBy("entity", "island").agg(
        F.min("first_us").alias("first_us"), F.max("last_us").alias("last_us"), F.count("*").alias("alert_count")).drop("island")


@query("incident_clusters", with_alerts("SELECT alert_id, cluster FROM cl", STRETCH, S.cluster_ctes()))
def incident_clusters(spark, sf_dir):
    d = desk(spark, sf_dir)
    return correlate.cluster_alerts(d.unscored_alerts, d.alert_entities)


@query("incident_numbers", with_cases("SELECT alert_id, incident_id FROM ia", STRETCH))
def incident_numbers(spark, sf_dir):
    return desk(spark, sf_dir).assigned


_SPLIT_US = 1_705_363_200_000_000  # 2024-01-16 00:00:00 UTC
_OLD_NEW = f"""
old AS (SELECT * FROM al0 WHERE first_us < {_SPLIT_US}), new AS (SELECT * FROM al0 WHERE first_us >= {_SPLIT_US}),
{S.cluster_ctes(1800, 'old', 'o_')},
{S.cluster_ctes(1800, 'new', 'n_')},
ent_o AS (SELECT DISTINCT cluster, entity FROM o_cl JOIN ax USING (alert_id)),
ent_n AS (SELECT DISTINCT cluster, entity FROM n_cl JOIN ax USING (alert_id)),
mt2 AS (
  SELECT DISTINCT n.cluster, o.cluster AS incident FROM ent_n n JOIN ent_o o USING (entity)
  JOIN n_cw nw ON nw.cluster = n.cluster JOIN o_cw ow ON ow.cluster = o.cluster
  WHERE ow.last_us >= nw.first_us - 1800000000 AND ow.first_us <= nw.last_us + 1800000000
)"""


def _split(spark, sf_dir):
    """Incidents of the first half of the feed, and clusters of the alerts that came after."""
    d = desk(spark, sf_dir)
    alerts, entities = d.unscored_alerts, d.alert_entities
    old, new = alerts.filter(F.col("first_us") < _SPLIT_US), alerts.filter(F.col("first_us") >= _SPLIT_US)
    parts = []
    for side in (old, new):
        own = entities.join(side.select("alert_id"), "alert_id", "left_semi")
        clusters = correlate.cluster_alerts(side, own)
        windows = correlate.cluster_windows(side, clusters)
        parts.append((windows, own.join(clusters, "alert_id").select("cluster", "entity").distinct()))
    (old_windows, old_entities), (new_windows, new_entities) = parts
    known = old_windows.select(F.col("cluster").alias("incident_id"), "first_us", "last_us", F.lit("open").alias("status"))
    return new_windows, new_entities, known, old_entities.withColumnRenamed("cluster", "incident_id")


@query("incident_matches", with_alerts("SELECT cluster, incident AS incident_id FROM mt2", STRETCH, _OLD_NEW))
def incident_matches(spark, sf_dir):
    """Active incidents each new cluster could join."""
    return correlate.matching_incidents(*_split(spark, sf_dir))


@query("incident_absorption", with_alerts("""
SELECT 'cluster' AS kind, g.id, (SELECT arg_min(o.cluster, (o.first_us, o.cluster)) FROM grp x JOIN o_cw o ON x.id = o.cluster AND x.side = 'i' WHERE x.root = g.root) AS target
FROM grp g WHERE g.side = 'c'
UNION ALL
SELECT 'incident', id, target FROM (
  SELECT g.id, (SELECT arg_min(o.cluster, (o.first_us, o.cluster)) FROM grp x JOIN o_cw o ON x.id = o.cluster AND x.side = 'i' WHERE x.root = g.root) AS target
  FROM grp g WHERE g.side = 'i') WHERE id <> target""", STRETCH, _OLD_NEW, """
el AS (SELECT 'c' AS s1, cluster AS a, 'i' AS s2, incident AS b FROM mt2 UNION SELECT 'i', incident, 'c', cluster FROM mt2),
gr(side, id, root) AS (SELECT DISTINCT s1, a, s1 || a FROM el UNION SELECT el.s2, el.b, gr.root FROM gr JOIN el ON el.s1 = gr.side AND el.a = gr.id),
grp AS (SELECT side, id, min(root) AS root FROM gr GROUP BY 1, 2)"""))
def incident_absorption(spark, sf_dir):
    """Which incident each matched cluster joins, and which incidents an older one takes over."""
    windows, entities, known, known_entities = _split(spark, sf_dir)
    matches = correlate.matching_incidents(windows, entities, known, known_entities)
    chosen, absorbed = correlate.merge_into_incidents(windows, matches, known)
    return chosen.select(F.lit("cluster").alias("kind"), F.col("cluster").alias("id"), F.col("incident_id").alias("target")).union(
        absorbed.select(F.lit("incident"), "incident_id", "into"))


@query("incident_rollup", with_cases("""
SELECT incident_id, alert_count, event_count, first_us, last_us, duration_seconds, confidence, risk_score, severity, ioc_count, technique_ids, rule_ids FROM inc""", STRETCH))
def incident_rollup(spark, sf_dir):
    return desk(spark, sf_dir).incidents.select(
        "incident_id", "alert_count", "event_count", "first_us", "last_us", "duration_seconds", "confidence", "risk_score", "severity",
        "ioc_count", F.array_join("technique_ids", ",").alias("technique_ids"), F.array_join("rule_ids", ",").alias("rule_ids"))


@query("incident_confidence", with_cases("SELECT incident_id, confidence, gap AS largest_gap_us, top_entity FROM inc", STRETCH))
def incident_confidence(spark, sf_dir):
    return desk(spark, sf_dir).incidents.select("incident_id", "confidence", "largest_gap_us", "top_entity")


@query("incident_events", with_cases(f"SELECT incident_id, ev.event_id, {S.SEVERITY_NAMES}[severity_rank + 1] AS severity FROM ie JOIN ev USING (e)", STRETCH))
def incident_events(spark, sf_dir):
    from eventwarden.model import severity_from_rank

    return desk(spark, sf_dir).incident_events.select("incident_id", "event_id", severity_from_rank(F.col("severity_rank")).alias("severity"))


@query("incident_entities", with_cases("SELECT incident_id, kind, value, role, events FROM ien", STRETCH))
def incident_entities(spark, sf_dir):
    return desk(spark, sf_dir).incident_entities


@query("incident_linking_entities", with_cases("""
SELECT incident_id, entity, alert_count FROM ik WHERE alert_count > 1""", STRETCH))
def incident_linking_entities(spark, sf_dir):
    return incidents.linking_entities(desk(spark, sf_dir).incident_keys)


@query("incident_events_by_type", with_cases("SELECT incident_id, event_type, count(*) AS n FROM ie JOIN ev USING (e) GROUP BY 1, 2", STRETCH))
def incident_events_by_type(spark, sf_dir):
    d = desk(spark, sf_dir)
    reason = incidents.correlation_reason(d.alerts, d.incident_events, d.incident_keys, d.incidents)
    return reason.select("incident_id", F.explode("events_by_type").alias("x")).select("incident_id", "x.event_type", "x.n")


@query("technique_rollup", with_cases("""
SELECT incident_id, technique_id, tactic_id, confidence, first_us, last_us, detected_us, rules, event_count FROM it""", STRETCH))
def technique_rollup(spark, sf_dir):
    return desk(spark, sf_dir).techniques.select(
        "incident_id", "technique_id", "tactic_id", "confidence", "first_us", "last_us", "detected_us",
        F.array_join("rule_ids", ",").alias("rules"), "event_count")


@query("technique_evidence", with_cases("SELECT DISTINCT incident_id, technique_id, event_id FROM ite", STRETCH))
def technique_evidence(spark, sf_dir):
    """All evidence of every technique."""
    d = desk(spark, sf_dir)
    return incidents.technique_evidence(d.alerts, d.alert_evidence).select("incident_id", "technique_id", "event_id")


@query("attack_chain", with_cases("SELECT incident_id, stage, tactic_id, tactic, first_us, last_us, detected_us, confidence, techniques FROM ich", STRETCH))
def attack_chain(spark, sf_dir):
    return desk(spark, sf_dir).chain.select(
        "incident_id", F.col("stage").cast("bigint").alias("stage"), "tactic_id", "tactic", "first_us", "last_us", "detected_us", "confidence",
        F.array_join(F.transform("techniques", lambda t: t["technique_id"]), ",").alias("techniques"))


@query("incident_titles", with_cases("""
SELECT inc.incident_id, substr(coalesce(st.stages, 'Suspicious activity') || ' on ' ||
  CASE WHEN h.n = 1 THEN h.first WHEN h.n > 1 THEN h.n || ' hosts' WHEN c.n > 0 THEN 'cloud account ' || c.first ELSE 'the environment' END ||
  CASE WHEN us.n = 1 THEN ' involving ' || us.first WHEN us.n > 1 THEN ' involving ' || us.n || ' accounts' ELSE '' END, 1, 255) AS title
FROM inc
LEFT JOIN (SELECT incident_id, string_agg(tactic, ' -> ' ORDER BY stage) AS stages FROM ich GROUP BY 1) st USING (incident_id)
LEFT JOIN (SELECT incident_id, count(*) AS n, min(value) AS first FROM ien WHERE kind = 'host' GROUP BY 1) h USING (incident_id)
LEFT JOIN (SELECT incident_id, count(*) AS n, min(value) AS first FROM ien WHERE kind = 'user' AND role = 'affected' GROUP BY 1) us USING (incident_id)
LEFT JOIN (SELECT incident_id, count(*) AS n, min(value) AS first FROM ien WHERE kind = 'cloud' GROUP BY 1) c USING (incident_id)""", STRETCH))
def incident_titles(spark, sf_dir):
    return desk(spark, sf_dir).incidents.select("incident_id", "title")


@query("detection_latency", with_alerts("""
SELECT kind AS rule_type, count(*) AS alerts, max((detected_us - first_us) // 1000) AS worst_ms FROM al0 GROUP BY 1""", STRETCH))
def detection_latency(spark, sf_dir):
    return desk(spark, sf_dir).alerts.groupBy("rule_type").agg(
        F.count("*").alias("alerts"), F.max("detection_latency_ms").alias("worst_ms"))


