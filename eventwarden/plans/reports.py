"""Incident report tables and evidence bundles."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from eventwarden.functions import net
from eventwarden.model import micros
from eventwarden.operators.groups import numbered
from eventwarden.plans.respond import rank_playbooks, recommended_actions
from eventwarden.plans.timeline import BUNDLE_KEYS, event_summary, metadata_map

TIMELINE_ROWS = 120
EXPLANATION_LINES = 6
BUNDLE_EVENTS = 60
DAY_US = 86_400_000_000


def duration_words(seconds: Column) -> Column:
    """``2h 05m``, ``5m 10s`` or ``40s``: the two largest units."""
    part = lambda unit, n: F.format_string(f"%d{unit}", n.cast("long"))
    hours, minutes, rest = F.floor(seconds / 3600), F.floor(seconds / 60) % 60, seconds % 60
    return F.when(hours > 0, F.concat_ws(" ", part("h", hours), part("m", minutes))).otherwise(
        F.when(minutes > 0, F.concat_ws(" ", part("m", minutes), part("s", rest))).otherwise(part("s", rest)))


def executive_summary(incidents: DataFrame, entities: DataFrame) -> DataFrame:
    """``(incident_id, body)``: the stored facts of an incident as labelled clauses, the rating first."""
    outside = entities.filter((F.col("kind") == "source_ip") & net.is_external(F.col("value"))).groupBy("incident_id").agg(
        F.min("value").alias("origin"))
    day = lambda c: F.date_format(F.timestamp_micros(c), "yyyy-MM-dd HH:mm:ss")
    number = lambda c: F.coalesce(F.col(c), F.lit(0)).cast("string")
    clause = lambda label, *parts: F.concat(F.lit(f"{label} "), *[p if isinstance(p, Column) else F.lit(p) for p in parts])
    body = F.concat_ws(
        "; ",
        clause("rating", F.col("severity"), ", risk ", F.round("risk_score", 0).cast("int").cast("string"), "/100"),
        clause("state", F.col("status")),
        clause("evidence", number("alert_count"), " detections, ", number("event_count"), " events"),
        clause("scope", number("hosts_count"), " hosts, ", number("users_count"), " accounts, ", number("targeted_count"), " targeted"),
        clause("time", day("first_us"), " to ", day("last_us")),
        F.when(F.size("stages") > 0, clause("stages", F.lower(F.array_join("stages", " > ")))),
        F.when(F.col("origin").isNotNull(), clause("outside", F.col("origin"))),
    )
    return incidents.join(outside, "incident_id", "left").select("incident_id", body.alias("body"))


def root_cause(incidents: DataFrame, events: DataFrame, chain: DataFrame) -> DataFrame:
    """Entry hypothesis and contributing factors per incident, from its techniques and earliest event."""
    first = events.groupBy("incident_id").agg(F.min_by("event_id", F.struct("us", "event_id")).alias("first_event_id"))
    opening = chain.filter("stage = 1").select("incident_id", F.col("tactic").alias("initial_tactic"))
    flagged = events.groupBy("incident_id").agg(F.max(F.array_contains("flags", "uid_zero")).alias("root_account"))
    has = lambda *ids: F.arrays_overlap("technique_ids", F.array(*[F.lit(i) for i in ids]))
    entry = (
        F.when(has("T1110", "T1110.001", "T1110.003"), "credential_guessing")
        .when(has("T1078", "T1078.004"), "stolen_credentials").otherwise("unknown")
    )
    factors = F.array_compact(F.array(
        F.when(F.coalesce("root_account", F.lit(False)), "second_root_account"),
        F.when(has("T1098", "T1098.004"), "account_or_key_changed"), F.when(has("T1562", "T1562.008"), "audit_logging_disabled")))
    return incidents.join(first, "incident_id", "left").join(opening, "incident_id", "left").join(flagged, "incident_id", "left").select(
        "incident_id", "first_event_id", F.coalesce("initial_tactic", F.lit("unclassified activity")).alias("initial_tactic"),
        entry.alias("entry"), factors.alias("factors"), "confidence")


def report_sections(desk) -> dict[str, DataFrame]:
    """One table per report section, keyed by ``incident_id``."""
    incidents, alerts, events, entities = desk.incidents, desk.alerts, desk.incident_events, desk.incident_entities
    order = Window.partitionBy("incident_id").orderBy("us", "event_id")
    told = events.select("incident_id", "event_id").join(desk.events.select(
        "event_id", micros().alias("us"), "event_type", "host", "user", event_summary().alias("summary")), "event_id")
    timeline = told.withColumn("row", F.row_number().over(order)).filter(F.col("row") <= TIMELINE_ROWS)
    used_rules = alerts.select("incident_id", "rule_id").distinct()
    return {
        "executive_summary": executive_summary(incidents, entities),
        "overview": incidents.select(
            "incident_id", "title", "status", "severity", "risk_score", "confidence", "first_us", "last_us",
            duration_words(F.col("duration_seconds")).alias("duration"), "alert_count", "event_count"),
        "risk": incidents.select("incident_id", F.explode("risk_breakdown").alias("c")).select("incident_id", "c.*"),
        "confidence": incidents.select("incident_id", F.explode("confidence_breakdown").alias("c")).select("incident_id", "c.*"),
        "progression": desk.chain.select("incident_id", "stage", "detected_us", "tactic_id", "tactic", "confidence",
                                         F.transform("techniques", lambda t: t["technique_id"]).alias("techniques")),
        "timeline": timeline,
        "assets": entities.filter("kind = 'host'").join(desk.hosts.withColumnRenamed("host_id", "value"), "value").select(
            "incident_id", F.col("value").alias("host_id"), "hostname", "os_family", "criticality", "environment", "is_isolated"),
        "accounts": entities.filter("kind = 'user' AND role = 'affected'").join(desk.users.withColumnRenamed("user_id", "value"), "value").select(
            "incident_id", F.col("value").alias("user_id"), "display_name", "user_type", "is_privileged", "is_disabled"),
        "targeted_accounts": entities.filter("kind = 'user' AND role = 'targeted'").select("incident_id", F.col("value").alias("user_id")),
        "indicators": events.select("incident_id", "event_id").join(desk.ioc_matches, "event_id").select(
            "incident_id", "ioc_id", "ioc_indicator", "ioc_type", "matched_field", "ioc_confidence").distinct(),
        "addresses": entities.filter("kind IN ('source_ip', 'destination_ip')").select("incident_id", "kind", "value"),
        "attack_mapping": desk.techniques.select(
            "incident_id", "technique_id", "name", "tactic_id", "tactic", "confidence", "event_count", "rule_ids", "first_us"),
        "detections": alerts.select("incident_id", "alert_id", "detected_us", "rule_id", "severity", "confidence", "detection_latency_ms", "title"),
        "explanations": alerts.select("incident_id", "alert_id", F.posexplode(F.slice("explanation", 1, EXPLANATION_LINES)).alias("line", "text")),
        "root_cause": root_cause(incidents, events, desk.chain),
        "rules": used_rules,
        "actions": desk.response_actions,
        "recommendations": recommended_actions(incidents, entities, desk.hosts, desk.users, desk.response_actions),
        "playbook": rank_playbooks(incidents).filter("rank = 1"),
    }


def even_sample(rows: DataFrame, key: str, time: str, trigger: Column, limit: int) -> DataFrame:
    """Up to ``limit`` rows per key: triggers first, then every n-th other row over the key's whole span.

    Keys with at most ``limit`` rows keep all of them. Rows are numbered slice by slice, never per key.
    """
    marked = rows.withColumn("_t", trigger).withColumn("_day", F.expr(f"{time} div {DAY_US}"))
    ranked = numbered(marked, [key, "_t"], "_day", [time, "event_id"], "_n")
    sizes = marked.groupBy(key).agg(F.count("*").alias("_all"), F.count_if("_t").alias("_hits"))
    left = F.greatest(F.lit(0), F.lit(limit) - F.least(F.col("_hits"), F.lit(limit)))
    step = F.greatest(F.lit(1), F.floor((F.col("_all") - F.col("_hits")) / left))
    index = F.col("_n") - 1
    context = (left > 0) & (index % step == 0) & (F.floor(index / step) < left)
    keep = (F.col("_all") <= limit) | (F.col("_t") & (F.col("_n") <= limit)) | (~F.col("_t") & context)
    return ranked.join(sizes, key).filter(keep).drop("_t", "_day", "_n", "_all", "_hits")


def evidence_payload() -> Column:
    """An event as a compact JSON document; empty parts are left out."""
    text = lambda c: F.when(F.col(f"`{c}`").cast("string") != "", F.col(f"`{c}`"))
    names = ["event_type", "source", "action", "status", "host", "user", "source_ip", "destination_ip", "destination_port", "process",
             "command_line", "file_path", "cloud_account", "cloud_service", "bytes_out"]
    meta = metadata_map(BUNDLE_KEYS)
    return F.to_json(F.struct(
        F.col("event_id").alias("id"), F.date_format("timestamp", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'").alias("timestamp"),
        *[text(c).alias(c) for c in names], F.when(F.size(meta) > 0, meta).alias("metadata")))


def evidence_bundle(desk, max_events: int = BUNDLE_EVENTS) -> DataFrame:
    """One document per incident: header, its alerts, assets, accounts, indicators and sampled events.

    The event list holds at most ``max_events``; the other lists hold one entry per alert or entity of an
    incident and stay as rows until the last step.
    """
    incidents, alerts = desk.incidents, desk.alerts
    links = desk.incident_events.select("incident_id", "event_id", "us")
    sample = even_sample(links, "incident_id", "us", F.lit(True), max_events)
    payload = sample.join(desk.events.withColumn("payload", evidence_payload()).select("event_id", "payload"), "event_id")
    listed = payload.groupBy("incident_id").agg(
        F.transform(F.array_sort(F.collect_list(F.struct("us", "event_id", "payload"))), lambda x: x["payload"]).alias("events"))
    own = alerts.groupBy("incident_id").agg(F.count("*").alias("alerts"), F.array_sort(F.collect_set("rule_id")).alias("rules"))
    return incidents.select(
        "incident_id", "title", "severity", "status", "confidence", "risk_score", "first_us", "last_us", "event_count",
        "hosts_first", "users_first", "targeted_first", "sources_first", "technique_ids",
    ).join(own, "incident_id").join(listed, "incident_id").withColumn("omitted", F.col("event_count") - F.size("events"))
