"""Incident tables derived from alerts and their evidence; always rebuilt, never patched."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from eventwarden import catalogue
from eventwarden.model import CORRELATION_WINDOW_SECONDS, severity_band, severity_from_rank, severity_rank
from eventwarden.operators import scoring
from eventwarden.operators.correlate import cluster_alerts, cluster_windows, largest_gap, number_incidents

MAX_TECHNIQUE_EVENTS = 50
MAX_STAGE_EVENTS = 25


@dataclass(frozen=True)
class Cases:
    """``alerts`` carries ``incident_id``; the rest are keyed by it."""

    alerts: DataFrame
    events: DataFrame
    entities: DataFrame
    techniques: DataFrame
    chain: DataFrame
    incidents: DataFrame


def assign_incidents(alerts: DataFrame, entities: DataFrame, window_seconds: int = CORRELATION_WINDOW_SECONDS) -> DataFrame:
    """``(alert_id, incident_id)`` from a one-shot clustering."""
    clusters = cluster_alerts(alerts, entities, window_seconds)
    ids = number_incidents(cluster_windows(alerts, clusters))
    return clusters.join(ids, "cluster").select("alert_id", "incident_id")


def incident_events(alerts: DataFrame, evidence: DataFrame) -> DataFrame:
    """Unique (incident, event) rows with the carried event columns and the worst alert severity."""
    links = evidence.join(alerts.select("alert_id", "incident_id", "severity"), "alert_id")
    columns = [c for c in evidence.columns if c not in ("alert_id", "event_id", "step", "step_index", "role", "rule_id", "detection_id", "detected_us")]
    return links.groupBy("incident_id", "event_id").agg(
        *[F.first(F.col(f"`{c}`")).alias(c) for c in columns],
        F.max(severity_rank(F.col("severity"))).alias("severity_rank"),
    )


def incident_entities(events: DataFrame) -> DataFrame:
    """``(incident_id, kind, value, role)``: hosts, accounts, addresses and cloud accounts of an incident.

    An account seen only on failures is ``targeted``; one with any other event is ``affected``.
    """
    def item(kind: str, column: str) -> Column:
        value = F.col(f"`{column}`")
        return F.when(value.isNotNull() & (value != ""), F.struct(F.lit(kind).alias("kind"), value.alias("value")))

    rows = events.select("incident_id", "status", F.explode(F.array_compact(F.array(
        item("host", "host"), item("user", "user"), item("source_ip", "source_ip"),
        item("destination_ip", "destination_ip"), item("cloud", "cloud_account"),
    ))).alias("e")).select("incident_id", "status", "e.*")
    grouped = rows.groupBy("incident_id", "kind", "value").agg(
        F.bool_or(F.col("status") != "failure").alias("acted"), F.count("*").alias("events"))
    role = F.when((F.col("kind") == "user") & ~F.col("acted"), "targeted").otherwise("affected")
    return grouped.select("incident_id", "kind", "value", role.alias("role"), "events")


def incident_keys(alerts: DataFrame, alert_entities: DataFrame) -> DataFrame:
    """``(incident_id, entity, alert_count)``: entity keys with the number of alerts touching each."""
    return alert_entities.join(alerts.select("alert_id", "incident_id"), "alert_id").groupBy("incident_id", "entity").agg(
        F.count("*").alias("alert_count"))


def technique_evidence(alerts: DataFrame, evidence: DataFrame) -> DataFrame:
    """``(incident_id, technique_id, event_id, us)``: all evidence of every technique, once each."""
    tagged = alerts.select("alert_id", "incident_id", F.explode(F.array_distinct("technique_ids")).alias("technique_id"))
    return evidence.select("alert_id", "event_id", "us").join(tagged, "alert_id").select(
        "incident_id", "technique_id", "event_id", "us").distinct()


def technique_rollup(alerts: DataFrame, evidence: DataFrame, preview: int = MAX_TECHNIQUE_EVENTS) -> DataFrame:
    """Per (incident, technique): confidence, first and last evidence, rules and the ``preview`` first evidence ids.

    All evidence is the rows of :func:`technique_evidence`.
    """
    spark = alerts.sparkSession
    tagged = alerts.select("alert_id", "incident_id", "rule_id", "confidence", "detected_us",
                           F.explode(F.array_distinct("technique_ids")).alias("technique_id"))
    span = evidence.groupBy("alert_id").agg(F.min("us").alias("a_first"), F.max("us").alias("a_last"))
    facts = tagged.join(span, "alert_id").groupBy("incident_id", "technique_id").agg(
        F.round(F.max("confidence"), 3).alias("confidence"), F.min("a_first").alias("first_us"),
        F.max("a_last").alias("last_us"), F.min("detected_us").alias("detected_us"),
        F.array_sort(F.collect_set("rule_id")).alias("rule_ids"),  # at most as many as rules
    )
    pairs = technique_evidence(alerts, evidence)
    rank = Window.partitionBy("incident_id", "technique_id").orderBy("us", "event_id")
    listed = pairs.withColumn("_rank", F.row_number().over(rank)).filter(F.col("_rank") <= preview).groupBy(
        "incident_id", "technique_id").agg(F.array_sort(F.collect_list(F.struct("us", "event_id"))).alias("listed"))
    counted = pairs.groupBy("incident_id", "technique_id").agg(F.count("*").alias("event_count"))
    primary = F.broadcast(catalogue.primary_tactics(spark))
    keys = ["incident_id", "technique_id"]
    return (
        facts.join(counted, keys).join(listed, keys).join(primary, "technique_id", "left")
        .withColumn("event_ids", F.transform("listed", lambda x: x["event_id"]))
    )


def attack_chain(techniques: DataFrame) -> DataFrame:
    """One row per (incident, tactic) in order of first detection; ``stage`` numbers them from 1."""
    staged = techniques.filter("tactic_id IS NOT NULL").groupBy("incident_id", "tactic_id").agg(
        F.first("tactic").alias("tactic"), F.first("position").alias("position"), F.min("first_us").alias("first_us"),
        F.max("last_us").alias("last_us"), F.min("detected_us").alias("detected_us"), F.max("confidence").alias("confidence"),
        F.array_sort(F.collect_list(F.struct("technique_id", "name", "confidence"))).alias("techniques"),
        F.slice(F.transform(F.array_sort(F.array_distinct(F.flatten(F.collect_list("listed")))),
                            lambda x: x["event_id"]), 1, MAX_STAGE_EVENTS).alias("event_ids"),
    )
    order = Window.partitionBy("incident_id").orderBy("detected_us", "position")  # at most 14 tactics
    return staged.withColumn("stage", F.row_number().over(order))


def _top_values(entities: DataFrame, condition: Column, name: str, k: int = 3) -> DataFrame:
    """Count and the k smallest values per incident, for titles and summaries."""
    chosen = entities.filter(condition).select("incident_id", "value").distinct()
    rank = Window.partitionBy("incident_id").orderBy("value")
    first = chosen.withColumn("_rank", F.row_number().over(rank)).filter(F.col("_rank") <= k).groupBy("incident_id").agg(
        F.array_sort(F.collect_list("value")).alias(f"{name}_first"))
    return chosen.groupBy("incident_id").agg(F.count("*").alias(f"{name}_count")).join(first, "incident_id")


def summarise_incidents(alerts: DataFrame, events: DataFrame, entities: DataFrame, keys: DataFrame, chain: DataFrame,
                        techniques: DataFrame, ioc_matches: DataFrame, hosts: DataFrame, users: DataFrame) -> DataFrame:
    """Incident rows with counts, confidence, risk, severity, title and summary."""
    spark = alerts.sparkSession
    behaviour = F.element_at(F.filter("risk_breakdown", lambda t: t["factor"] == "behavioural"), 1)["value"]
    base = alerts.groupBy("incident_id").agg(
        F.count("*").alias("alert_count"), F.min("first_us").alias("first_us"), F.max("last_us").alias("last_us"),
        F.min("detected_us").alias("first_alert_us"), F.round(F.avg("confidence"), 9).alias("mean_confidence"),
        F.max(severity_rank(F.col("severity"))).alias("base_rank"), F.max(behaviour).alias("anomaly"),
        F.array_sort(F.collect_set("rule_id")).alias("rule_ids"),  # at most as many as rules
        F.array_sort(F.array_distinct(F.flatten(F.collect_set("technique_ids")))).alias("technique_ids"),
    )
    volume = events.groupBy("incident_id").agg(
        F.count("*").alias("event_count"), F.array_distinct(F.flatten(F.collect_set("flags"))).alias("flags"))
    iocs = events.select("incident_id", "event_id").join(ioc_matches.select("event_id", "ioc_confidence"), "event_id").groupBy(
        "incident_id").agg(F.count("*").alias("ioc_count"), F.max("ioc_confidence").alias("ioc_best"))
    top = keys.groupBy("incident_id").agg(F.max("alert_count").alias("top_entity"), F.count("*").alias("entity_count"))
    gaps = largest_gap(alerts, ["incident_id"], "detected_us", 86_400_000_000)
    tactics = alerts.select("incident_id", F.explode("technique_ids").alias("technique_id")).distinct().join(
        F.broadcast(catalogue.technique_tactics(spark)), "technique_id").groupBy("incident_id").agg(
        F.count_distinct("tactic_id").alias("tactic_count"))
    affected = F.col("role") == "affected"
    assets = entities.filter("kind = 'host'").join(hosts.select(F.col("host_id").alias("value"), "criticality"), "value").groupBy(
        "incident_id").agg(F.max("criticality").alias("criticality"))
    rights = entities.filter((F.col("kind") == "user") & affected).join(
        users.select(F.col("user_id").alias("value"), "is_privileged"), "value").groupBy("incident_id").agg(
        F.max("is_privileged").alias("privileged"))
    stages = chain.groupBy("incident_id").agg(
        F.transform(F.array_sort(F.collect_list(F.struct("stage", "tactic"))), lambda s: s["tactic"]).alias("stages"))
    df = base
    for part in (
        volume, iocs, top, gaps, tactics, assets, rights, stages,
        _top_values(entities, F.col("kind") == "host", "hosts"),
        _top_values(entities, (F.col("kind") == "user") & affected, "users"),
        _top_values(entities, (F.col("kind") == "user") & ~affected, "targeted"),
        _top_values(entities, F.col("kind") == "source_ip", "sources"),
        _top_values(entities, F.col("kind") == "cloud", "clouds"),
    ):
        df = df.join(part, "incident_id", "left")
    zero = lambda c: F.coalesce(F.col(c), F.lit(0))
    for name in ("event_count", "ioc_count", "tactic_count", "hosts_count", "users_count", "targeted_count", "sources_count", "clouds_count"):
        df = df.withColumn(name, zero(name))
    df = scoring.with_confidence(
        df, mean_confidence=F.col("mean_confidence"), alerts=F.col("alert_count"), events=F.col("event_count"),
        top_entity=F.col("top_entity"), largest_gap_us=F.col("largest_gap_us"), tactics=F.col("tactic_count"),
        iocs=F.col("ioc_count"))
    df = scoring.with_risk(
        df, severity=severity_from_rank(F.col("base_rank")), confidence=F.col("confidence"),
        criticality=F.col("criticality"), privileged=F.coalesce("privileged", F.lit(False)), flags=F.col("flags"),
        anomaly=F.col("anomaly"), ioc_count=F.col("ioc_count"), ioc_confidence=F.coalesce("ioc_best", F.lit(0.0)),
        events=F.col("event_count"), tactics=F.col("tactic_count"), alerts=F.col("alert_count"))
    final = F.greatest(F.col("base_rank"), severity_rank(severity_band(F.col("risk_score"))))
    df = df.withColumn("severity", severity_from_rank(final)).withColumn(
        "duration_seconds", F.greatest(F.lit(0), F.expr("(last_us - first_us) div 1000000"))).withColumn("status", F.lit("open"))
    return df.withColumn("title", incident_title()).withColumn("summary", incident_summary()).drop(
        "base_rank", "flags", "criticality", "privileged", "anomaly")


def incident_title() -> Column:
    """Stages, target and actor, at most 255 characters."""
    stages = F.coalesce(F.array_join("stages", " -> "), F.lit("Suspicious activity"))
    hosts, users = F.col("hosts_count"), F.col("users_count")
    target = (
        F.when(hosts == 1, F.get("hosts_first", F.lit(0))).when(hosts > 1, F.concat(hosts, F.lit(" hosts")))
        .when(F.col("clouds_count") > 0, F.concat(F.lit("cloud account "), F.get("clouds_first", F.lit(0))))
        .otherwise("the environment")
    )
    actor = (
        F.when(users == 1, F.concat(F.lit(" involving "), F.get("users_first", F.lit(0))))
        .when(users > 1, F.concat(F.lit(" involving "), users, F.lit(" accounts"))).otherwise("")
    )
    return F.concat(stages, F.lit(" on "), target, actor)


def duration_text(seconds: Column) -> Column:
    minutes = F.expr("duration_seconds div 60")
    return F.when(seconds < 120, F.concat(seconds, F.lit("s"))).otherwise(
        F.concat(minutes, F.lit("m "), seconds % 60, F.lit("s")))


def incident_summary() -> Column:
    """One paragraph of stored facts."""
    listed = lambda c, none: F.coalesce(F.array_join(c, ", "), F.lit(none))
    return F.concat_ws(
        " ",
        F.concat(F.col("alert_count"), F.lit(" detection(s) from "), F.col("event_count"), F.lit(" event(s) over "),
                 duration_text(F.col("duration_seconds")), F.lit(".")),
        F.when(F.size("stages") > 0, F.concat(F.lit("Stages: "), F.lower(F.array_join("stages", ", then ")), F.lit("."))),
        F.concat(F.lit("Hosts: "), listed("hosts_first", "none"), F.lit(". Accounts: "), listed("users_first", "none"),
                 F.lit(". Sources: "), listed("sources_first", "none"), F.lit(".")),
        F.concat(F.lit("Confidence "), F.round(F.col("confidence") * 100, 0).cast("int"), F.lit("%, risk "),
                 F.round("risk_score", 0).cast("int"), F.lit("/100 ("), F.col("severity"), F.lit(").")),
    )


def linking_entities(keys: DataFrame) -> DataFrame:
    """``(incident_id, entity, alert_count)`` for every entity that several alerts of an incident touch."""
    return keys.filter("alert_count > 1").select("incident_id", "entity", "alert_count")


def correlation_reason(alerts: DataFrame, events: DataFrame, keys: DataFrame, incidents: DataFrame,
                       window_seconds: int = CORRELATION_WINDOW_SECONDS, linking: int = 10) -> DataFrame:
    """Why the alerts were joined: events by type, the ``linking`` most shared entities, contributing rules.

    All linking entities are the rows of :func:`linking_entities`.
    """
    by_type = events.groupBy("incident_id", "event_type").agg(F.count("*").alias("n")).groupBy("incident_id").agg(
        F.transform(F.array_sort(F.collect_list(F.struct((-F.col("n")).alias("o"), "event_type", "n"))),
                    lambda x: F.struct(x["event_type"].alias("event_type"), x["n"].alias("n"))).alias("events_by_type"))
    rank = Window.partitionBy("incident_id").orderBy(F.desc("alert_count"), "entity")
    shown = linking_entities(keys).withColumn("_rank", F.row_number().over(rank)).filter(F.col("_rank") <= linking).groupBy(
        "incident_id").agg(F.transform(
            F.array_sort(F.collect_list(F.struct("_rank", "entity", "alert_count"))),
            lambda x: F.struct(x["entity"].alias("entity"), x["alert_count"].alias("alert_count"))).alias("linking_entities"))
    facts = incidents.select("incident_id", "alert_count", "event_count", "rule_ids", "confidence", "duration_seconds")
    return facts.join(by_type, "incident_id", "left").join(shown, "incident_id", "left").withColumn(
        "window_seconds", F.lit(window_seconds))


def build_cases(alerts: DataFrame, evidence: DataFrame, alert_entities: DataFrame, ioc_matches: DataFrame,
                hosts: DataFrame, users: DataFrame, assigned: DataFrame) -> Cases:
    """All incident tables from alerts already assigned to incidents."""
    owned = alerts.join(assigned, "alert_id")
    events = incident_events(owned, evidence)
    entities = incident_entities(events)
    techniques = technique_rollup(owned, evidence)
    chain = attack_chain(techniques)
    keys = incident_keys(owned, alert_entities)
    rows = summarise_incidents(owned, events, entities, keys, chain, techniques, ioc_matches, hosts, users)
    return Cases(owned, events, entities, techniques, chain, rows)
