"""Hunts: filtered, ordered pages over events, alerts and incidents, and ordered multi-step hunts."""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import reduce
from operator import and_, or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from eventwarden.model import micros
from eventwarden.operators.conditions import compile_filters
from eventwarden.operators.groups import group_id
from eventwarden.operators.sequence import SequenceSpec, StepSpec, counted_rows, evidence_ranges, first_matches, step_rows

# Column and type behind each hunt field of the alert and incident datasets.
ALERT_COLUMNS = {
    "alert_id": "alert_id:string", "detected_at": "detected_us:bigint", "rule_id": "rule_id:string",
    "rule_type": "rule_type:string", "severity": "severity:string", "status": "status:string",
    "confidence": "confidence:double", "risk_score": "risk_score:double", "host": "host:string", "user": "user:string",
    "source_ip": "source_ip:string", "title": "title:string",
}
INCIDENT_COLUMNS = {
    "incident_id": "incident_id:string", "first_seen": "first_us:bigint", "last_seen": "last_us:bigint",
    "severity": "severity:string", "status": "status:string", "confidence": "confidence:double",
    "risk_score": "risk_score:double", "title": "title:string",
}
ALERT_ARRAYS = {"technique_id": "technique_ids"}
INCIDENT_ARRAYS = {"technique_id": "technique_ids", "host": "hosts", "user": "users", "source_ip": "source_ips"}


@dataclass(frozen=True)
class Hunt:
    """A validated hunt. ``filters`` are ``(field, operator, value)``; ``last_minutes`` counts back from a
    "now" given at run time, so results repeat."""

    dataset: str = "events"
    filters: tuple = ()
    logic: str = "and"
    start_us: int | None = None
    end_us: int | None = None
    last_minutes: int | None = None
    order_by: str | None = None
    descending: bool = True
    limit: int = 100
    offset: int = 0
    steps: tuple = ()
    within_seconds: int = 900
    correlate_on: tuple = ("source_ip",)


@dataclass(frozen=True)
class HuntStep:
    name: str
    filters: tuple = field(default_factory=tuple)
    min_count: int = 1


def _options(dataset: str) -> dict:
    if dataset == "alerts":
        return {"columns": ALERT_COLUMNS, "arrays": ALERT_ARRAYS}
    if dataset == "incidents":
        return {"columns": INCIDENT_COLUMNS, "arrays": INCIDENT_ARRAYS}
    return {}


def _time(dataset: str) -> Column:
    return {"events": micros(), "alerts": F.col("detected_us"), "incidents": F.col("last_us")}[dataset]


def _bounds(hunt: Hunt, now_us: int) -> tuple[int | None, int | None]:
    if hunt.last_minutes is None:
        return hunt.start_us, hunt.end_us
    end = hunt.end_us if hunt.end_us is not None else now_us
    return end - hunt.last_minutes * 60_000_000, end


def in_time_range(df: DataFrame, dataset: str, start_us: int | None, end_us: int | None) -> DataFrame:
    """Rows inside the closed range; event bounds are plain timestamp tests, so they reach the scan."""
    if dataset == "events":
        low = None if start_us is None else F.timestamp_micros(F.lit(start_us))
        high = None if end_us is None else F.timestamp_micros(F.lit(end_us))
        time = F.col("timestamp")
    else:
        low, high, time = start_us, end_us, _time(dataset)
    if start_us is not None:
        df = df.filter(time >= low)
    if end_us is not None:
        df = df.filter(time <= high)
    return df


def matching(df: DataFrame, hunt: Hunt, now_us: int) -> DataFrame:
    """Every row the hunt selects, without paging."""
    kept = df.filter(compile_filters(list(hunt.filters), hunt.logic, **_options(hunt.dataset))) if hunt.filters else df
    return in_time_range(kept, hunt.dataset, *_bounds(hunt, now_us))


def page(df: DataFrame, hunt: Hunt, now_us: int) -> DataFrame:
    """One page of a simple hunt, ordered with the id as tie-break."""
    ids = {"events": "event_id", "alerts": "alert_id", "incidents": "incident_id"}[hunt.dataset]
    if hunt.order_by is None or hunt.order_by == "timestamp":
        by = _time(hunt.dataset)
    elif hunt.dataset == "events":
        by = F.col(f"`{hunt.order_by}`")
    else:
        by = F.col(_options(hunt.dataset)["columns"][hunt.order_by].split(":")[0])
    ordered = matching(df, hunt, now_us).orderBy(by.desc_nulls_last() if hunt.descending else by.asc_nulls_first(), ids)
    return (ordered.offset(hunt.offset) if hunt.offset else ordered).limit(hunt.limit)


def total(df: DataFrame, hunt: Hunt, now_us: int) -> DataFrame:
    """Number of rows the hunt selects, beside the page."""
    return matching(df, hunt, now_us).agg(F.count("*").alias("total"))


def event_rows(events: DataFrame) -> DataFrame:
    return events.select(
        F.lit("event").alias("kind"), F.col("event_id").alias("id"), micros().alias("us"), "event_type", "source", "host",
        "user", "source_ip", "destination_ip", F.col("destination_port").cast("bigint").alias("destination_port"), "process",
        "command_line", "file_path", "cloud_account", "action", "status", "label")


def alert_rows(alerts: DataFrame) -> DataFrame:
    return alerts.select(
        F.lit("alert").alias("kind"), F.col("alert_id").alias("id"), F.col("detected_us").alias("us"), "rule_id", "rule_type",
        "title", "severity", "status", "confidence", "risk_score", "host", "user", "source_ip",
        F.array_join("technique_ids", ",").alias("technique_ids"), "incident_id")


def incident_rows(incidents: DataFrame) -> DataFrame:
    return incidents.select(
        F.lit("incident").alias("kind"), F.col("incident_id").alias("id"), F.col("last_us").alias("us"), "title", "severity",
        "status", "confidence", "risk_score", "alert_count", "event_count", F.array_join("technique_ids", ",").alias("technique_ids"))


# ---- ordered hunts --------------------------------------------------------------------------------
def sequence_hunt(events: DataFrame, hunt: Hunt, now_us: int) -> tuple[DataFrame, DataFrame]:
    """Matches of an ordered hunt: one row per correlation key, and one row per (key, step, event).

    A row is a candidate when it meets some step under SQL null rules; steps then match it under the
    matcher's rules, where a negation keeps a missing value. Keys whose parts are all empty are dropped.
    """
    sql = [compile_filters(list(s.filters)) for s in hunt.steps]
    candidate = reduce(or_, [F.coalesce(t, F.lit(False)) for t in sql])
    steps = tuple(
        StepSpec(s.name, F.coalesce(compile_filters(list(s.filters), null_negation=True), F.lit(False)) & candidate, s.min_count)
        for s in hunt.steps
    )
    parts = F.array(*[F.lower(F.coalesce(F.col(f"`{c}`"), F.lit(""))) for c in hunt.correlate_on])
    keyed = reduce(or_, [F.coalesce(F.col(f"`{c}`"), F.lit("")) != "" for c in hunt.correlate_on])
    scope = reduce(and_, [candidate, keyed] + ([F.coalesce(compile_filters(list(hunt.filters)), F.lit(False))] if hunt.filters else []))
    spec = SequenceSpec("hunt", steps, hunt.within_seconds, parts, (), scope, expand=False)
    rows = step_rows(in_time_range(events, "events", *_bounds(hunt, now_us)), [spec])
    depth = len(steps)
    counted = counted_rows(rows, depth)
    ranges = evidence_ranges(first_matches(rows, [spec], counted), depth, expand=False)
    ordinals = counted.select("g", "event_id", "us", F.explode(F.array(*[
        F.struct(F.lit(k).alias("step"), F.when(F.col(f"s{k}") == 1, F.col(f"c{k}")).alias("ord")) for k in range(depth)
    ])).alias("x")).select("g", "event_id", "us", "x.step", "x.ord").filter("ord IS NOT NULL")
    names = F.element_at(F.array(*[F.lit(s.name) for s in steps]), F.col("step") + 1)
    found = ordinals.join(ranges.select("g", "step", "lo", "hi"), ["g", "step"]).filter("ord BETWEEN lo AND hi").select(
        "g", "event_id", "us", "step", names.alias("step_name"))
    labels = rows.groupBy("g").agg(F.first("group_key").alias("group_key"))
    per_key = found.groupBy("g").agg(
        F.min("us").alias("first_us"), F.max("us").alias("last_us"), F.count("*").alias("event_count"),
    ).withColumn("span_seconds", F.expr("(last_us - first_us) div 1000000")).join(labels, "g")
    return per_key, found


def key_of(*columns: str) -> Column:
    return group_id(F.array(*[F.lower(F.coalesce(F.col(f"`{c}`"), F.lit(""))) for c in columns]))


# The ready-made hunts.
BUILTIN: dict[str, Hunt] = {
    "failed_then_success": Hunt(
        last_minutes=1440, within_seconds=900, correlate_on=("source_ip",), steps=(
            HuntStep("failures", (("event_type", "eq", "authentication"), ("status", "eq", "failure")), 3),
            HuntStep("success", (("event_type", "eq", "authentication"), ("status", "eq", "success")), 1),
        )),
    "privilege_escalation": Hunt(
        last_minutes=60, limit=200, filters=(("event_type", "eq", "privilege"), ("status", "eq", "success"))),
    "persistence_mechanisms": Hunt(
        last_minutes=10080, limit=200, filters=(("event_type", "eq", "file"), ("metadata.persistence_path", "eq", True))),
    "external_authentication": Hunt(
        last_minutes=1440, limit=200, filters=(
            ("event_type", "eq", "authentication"), ("status", "eq", "success"), ("source_ip", "not_contains", "10."))),
    "cloud_privilege_grants": Hunt(
        last_minutes=10080, limit=200, filters=(
            ("metadata.iam_category", "in", ["privilege_grant", "credential_creation", "trust_policy_change"]),)),
    "large_outbound": Hunt(
        last_minutes=10080, limit=100, order_by="bytes_out", filters=(
            ("event_type", "eq", "network"), ("bytes_out", "gt", 10_000_000))),
    "enumeration_activity": Hunt(last_minutes=1440, limit=300, filters=(("event_type", "eq", "discovery"),)),
    "alerts_awaiting_triage": Hunt(
        dataset="alerts", limit=100, order_by="risk_score", filters=(
            ("severity", "in", ["critical", "high"]), ("status", "eq", "new"))),
}
