"""The detection pass: events and a rule pack to detections, evidence, alerts and their risk."""

from __future__ import annotations

import logging
import re
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass

from pyspark.errors import PySparkException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from eventwarden.model import event_schema, micros
from eventwarden.operators import scoring
from eventwarden.operators.anomaly import anomalies, any_candidate
from eventwarden.operators.baseline import with_history, with_stored_history
from eventwarden.operators.conditions import compile_selection, field, single_tests
from eventwarden.operators.groups import group_text, numbered
from eventwarden.operators.indicators import match_indicators
from eventwarden.operators.match import match_rules
from eventwarden.operators.sequence import rule_sequence, sequence_evidence
from eventwarden.operators.threshold import ThresholdSpec, threshold_evidence
from eventwarden.plans.rulepack import RULES, Rule, rules_of

log = logging.getLogger(__name__)

# Event columns an alert needs from its evidence.
CARRIED = [
    "event_id", "event_type", "action", "status", "host", "user", "source_ip", "destination_ip",
    "process", "file_path", "cloud_account", "cloud_service",
]
TITLE_FIELDS = [
    "host", "user", "source_ip", "destination_ip", "process", "action", "status", "event_type",
    "cloud_account", "cloud_service", "file_path",
]
EXPLAINED_FIELDS = ["host", "user", "source_ip", "process", "file_path", "cloud_account"]

FACTOR_TYPE = "array<struct<name:string,weight:double,reason:string>>"


@dataclass(frozen=True)
class Detected:
    """Result of a pass. ``evidence`` is one row per (detection, event)."""

    detections: DataFrame
    evidence: DataFrame


def rule_table(spark: SparkSession, rules: list[Rule]) -> DataFrame:
    """The pack as rows; as many rows as rules."""
    rows = [
        (r.id, r.name, r.kind, r.severity, float(r.confidence), r.category, list(r.techniques), list(r.tactics),
         int(r.dedup_seconds), r.count, r.window_seconds, r.enabled)
        for r in rules
    ]
    return spark.createDataFrame(rows, (
        "rule_id string, rule_name string, rule_type string, rule_severity string, rule_confidence double, "
        "category string, technique_ids array<string>, tactics array<string>, dedup_seconds bigint, "
        "need int, window_seconds bigint, enabled boolean"
    ))


def behaviour_flags() -> Column:
    """Risk flags present on an event, as an array of at most ten names."""
    meta = lambda k: F.col(f"metadata.{k}")
    flags = [F.when(F.coalesce(meta(f), F.lit(False)), F.lit(f)) for f in scoring.BEHAVIOUR_FLAGS]
    indicators = meta("argument_indicators")
    derived = F.when(F.coalesce(F.size(indicators) > 0, F.lit(False)), F.when(
        F.array_contains(indicators, "credential_file_access"), "sensitive_file").otherwise("elevated"))
    return F.array_distinct(F.array_compact(F.array(*flags, derived)))


def _facts() -> list[Column]:
    """What evidence holds of an event; a small part of its width."""
    return [*[F.col(f"`{c}`") for c in CARRIED], behaviour_flags().alias("flags"),
            F.coalesce("metadata.target_user", "metadata.target_principal").alias("target")]


def _carry(df: DataFrame, *extra: Column) -> DataFrame:
    *own, flags, target = _facts()
    return df.select(*own, micros().alias("us"), flags, target, *extra)


def _carried(df: DataFrame, *extra: Column) -> DataFrame:
    """As :func:`_carry`, of rows that were cut to :func:`_facts` before."""
    return df.select(*[F.col(f"`{c}`") for c in CARRIED], "us", "flags", "target", *extra)


_NO_EXTRA = {
    "severity": "string", "confidence": "double", "anomaly_score": "double", "factors": FACTOR_TYPE,
    "ioc_id": "string", "matched_field": "string", "step": "string", "step_index": "int",
}


def _extras(**given: Column) -> list[Column]:
    return [given.get(n, F.lit(None)).cast(kind).alias(n) for n, kind in _NO_EXTRA.items()]


def match_evidence(events: DataFrame, rules: list[Rule]) -> DataFrame:
    rows = match_rules(events, rules)
    return _carry(rows, F.col("rule_id"), F.col("group_key"),
                  F.concat_ws(":", "rule_id", "event_id").alias("detection_id"), *_extras())


def ioc_evidence(events: DataFrame, rules: list[Rule], indicators: DataFrame) -> DataFrame:
    parts = []
    for rule in rules:
        rows = match_indicators(events, indicators, list(rule.ioc_fields), list(rule.ioc_types), rule.selection)
        confidence = F.round(F.least(F.lit(0.99), F.col("ioc_confidence") * rule.confidence + 0.1), 3)
        parts.append(_carry(
            rows, F.lit(rule.id).alias("rule_id"), F.array(F.lower("matched_value")).alias("group_key"),
            F.concat_ws(":", F.lit(rule.id), "event_id", "matched_field").alias("detection_id"),
            *_extras(severity=F.coalesce("ioc_severity", F.lit(rule.severity)), confidence=confidence,
                     ioc_id=F.col("ioc_id"), matched_field=F.col("matched_field")),
        ))
    return _union(parts)


def anomaly_evidence(events: DataFrame, rules: list[Rule], history: DataFrame | None = None,
                     stored: DataFrame | None = None) -> DataFrame:
    rows = events.filter(any_candidate(rules))
    rows = with_stored_history(rows, stored) if stored is not None else with_history(rows, history)
    lowered = lambda c: F.lower(F.coalesce(c, F.lit("")))
    return _carry(
        anomalies(rows, rules), F.col("rule_id"),
        F.array(lowered("user"), lowered("source_ip")).alias("group_key"),
        F.concat_ws(":", "rule_id", "event_id").alias("detection_id"),
        *_extras(severity=F.col("severity"), confidence=F.col("confidence"),
                 anomaly_score=F.col("anomaly_score"), factors=F.col("factors")),
    )


def threshold_rows(events: DataFrame, rules: list[Rule]) -> DataFrame:
    specs = [ThresholdSpec(r, r.count, r.window_seconds, r.distinct_field, r.distinct_count) for r in rules]
    rows = threshold_evidence(events, specs, _facts())
    return _carried(rows, F.col("rule_id"), F.col("group_key"),
                    F.concat_ws(":", "rule_id", "g").alias("detection_id"), *_extras())


def sequence_rows(events: DataFrame, rules: list[Rule]) -> DataFrame:
    rows = sequence_evidence(events, [rule_sequence(r) for r in rules], _facts())
    return _carried(rows, F.col("rule_id"), F.col("group_key"), F.concat_ws(":", "rule_id", "g").alias("detection_id"),
                    *_extras(step=F.col("step"), step_index=F.col("step_index")))


# what a malformed rule raises while its predicates and plans are built
RULE_ERRORS = (ValueError, KeyError, TypeError, AttributeError, re.error)


_SOUND: dict[tuple[str, str], bool] = {}


def _stand_in(kind: T.DataType) -> Column:
    """A value of a type, so that every test has something to look at."""
    if isinstance(kind, T.StructType):
        return F.struct(*[_stand_in(f.dataType).alias(f.name) for f in kind.fields])
    if isinstance(kind, T.ArrayType):
        return F.array(_stand_in(kind.elementType))
    if isinstance(kind, T.MapType):
        return F.create_map(_stand_in(kind.keyType), _stand_in(kind.valueType))
    plain = {"string": "1", "boolean": True, "timestamp": "2024-01-01 00:00:00"}.get(kind.typeName(), 1)
    return F.lit(plain).cast(kind)


def _tests(rule: Rule) -> list[Column]:
    """Every expression of a rule that reads an event."""
    tests = single_tests(rule.selection) + [t for s in rule.steps for t in single_tests(s.selection)]
    fields = [rule.distinct_field, *rule.group_by, *(name for name, _ in rule.constraints)]
    whole = [compile_selection(rule.selection), *(compile_selection(s.selection) for s in rule.steps)]
    return [*tests, *whole, *(field(name)[0].cast("string") for name in fields if name)]


def _runs(spark: SparkSession, rules: list[Rule]) -> bool:
    """Whether the engine takes every test of these rules, evaluated on one row of stand-in values."""
    try:
        row = spark.range(1).select(*[_stand_in(f.dataType).alias(f.name) for f in event_schema().fields])
        row.select(F.array(*[t.cast("string") for rule in rules for t in _tests(rule)])).collect()
    except (PySparkException, *RULE_ERRORS):
        return False
    return True


def sound_rules(spark: SparkSession, rules: list[Rule], skipped: list[str] | None = None) -> list[Rule]:
    """The rules the engine can run; the others are logged and their ids added to ``skipped``.

    A rule is tried by itself only where the rules do not run together, and once per application. If none runs alone, the
    fault is not the rules', and they are all returned: the pass then shows it.
    """
    app = spark.sparkContext.applicationId
    fresh = [r for r in rules if r.enabled and (app, repr(r)) not in _SOUND]
    if fresh:
        verdicts = [True] * len(fresh) if _runs(spark, fresh) else [_runs(spark, [r]) for r in fresh]
        if not any(verdicts) and len(fresh) > 1:
            return rules
        _SOUND.update({(app, repr(r)): verdict for r, verdict in zip(fresh, verdicts)})
    broken = [r.id for r in rules if not _SOUND.get((app, repr(r)), True)]
    if broken:
        log.error("rules that do not compile: %s", ", ".join(broken))
        if skipped is not None:
            skipped += broken
    return [r for r in rules if r.id not in broken]


def _union(parts: list[DataFrame]) -> DataFrame:
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def fresh_only(evidence: DataFrame, batch: DataFrame) -> DataFrame:
    """Detections with at least one evidence event in the batch; the others were found in an earlier pass."""
    ids = evidence.join(batch.select("event_id"), "event_id", "left_semi").select("detection_id").distinct()
    return evidence.join(ids, "detection_id", "left_semi")


def collect_evidence(events: DataFrame, rules: list[Rule], indicators: DataFrame | None = None,
                     history: DataFrame | None = None, stored: DataFrame | None = None,
                     candidates: DataFrame | None = None, skipped: list[str] | None = None) -> DataFrame:
    """Evidence of every rule. A rule that does not compile is logged and left out, its id added to ``skipped``.

    What the engine refuses (patterns, types, parameters) shows before the pass, on one row and rule by rule. Errors of the
    jobs after that are no rule errors: they are raised, so that the batch fails and is run again.

    In a micro-batch ``events`` are the new ones and ``candidates`` adds the history the stateful rules look
    back on; their detections count only when they hold a new event.
    """
    rules = sound_rules(events.sparkSession, rules, skipped)

    def stateful(build, rs):
        return build(events, rs) if candidates is None else fresh_only(build(candidates, rs), events)

    builders = {
        "match": lambda rs: match_evidence(events, rs),
        "threshold": lambda rs: stateful(threshold_rows, rs),
        "sequence": lambda rs: stateful(sequence_rows, rs),
        "ioc": lambda rs: ioc_evidence(events, rs, indicators),
        "anomaly": lambda rs: anomaly_evidence(events, rs, events if history is None else history, stored),
    }
    def run(kind: str) -> list[DataFrame]:
        chosen = rules_of(kind, rules)
        if not chosen or (kind == "ioc" and indicators is None):
            return []
        try:
            return [builders[kind](chosen)]
        except RULE_ERRORS:  # one broken rule must not stop the rest
            log.exception("a %s rule does not compile", kind)
            return [p for p in (_attempt(builders[kind], rule, skipped) for rule in chosen) if p is not None]

    # the kinds are independent, so their intermediate jobs share the cluster
    with ThreadPoolExecutor(max_workers=len(builders)) as pool:
        parts = [part for found in pool.map(run, builders) for part in found]
    return _union(parts)


def _attempt(build, rule: Rule, skipped: list[str] | None) -> DataFrame | None:
    try:
        return build([rule])
    except RULE_ERRORS:
        log.exception("rule %s does not compile", rule.id)
        if skipped is not None:
            skipped.append(rule.id)
        return None


def render_title(rule: Rule, values: dict[str, Column], group: Column) -> Column:
    """A rule's title with event values first, then group values, then ``(unknown)``."""
    if not rule.title:
        return F.lit(rule.name)
    fields = [f.replace("metadata.", "") for f in rule.group_by]
    pieces = []
    for literal, name in re.findall(r"([^{]*)(?:\{([^}]*)\})?", rule.title):
        if literal:
            pieces.append(F.lit(literal))
        if name:
            options = [values[name]] if name in values else []
            if name in fields:
                options.append(F.get(group, F.lit(fields.index(name))))
            pieces.append(F.coalesce(*options, F.lit("(unknown)")))
    return F.concat(*pieces)


def _by_rule(rules: list[Rule], pick) -> Column:
    expr = F.lit(None).cast("string")
    for rule in rules:
        expr = F.when(F.col("rule_id") == rule.id, pick(rule)).otherwise(expr)
    return expr


def _group_words(rule: Rule) -> Column:
    if not rule.group_by:
        return F.lit("")
    return F.concat_ws(", ", *[
        F.concat(F.lit(f"{f}="), F.coalesce(F.get("group_key", F.lit(i)), F.lit("(none)")))
        for i, f in enumerate(rule.group_by)
    ])


def explain() -> Column:
    """Sentences on why a detection fired, from its own values."""
    stamp = lambda c: F.date_format(F.timestamp_micros(c), "yyyy-MM-dd'T'HH:mm:ss'Z'")
    span = F.greatest(F.lit(1), F.expr("(last_us - first_us) div 1000000"))
    seen = F.concat_ws(", ", *[
        F.when(F.col(f"trigger.`{c}`").isNotNull(), F.concat(F.lit(f"{c}="), F.col(f"trigger.`{c}`")))
        for c in EXPLAINED_FIELDS
    ])
    match = F.array(F.concat(
        F.col("rule_name"), F.lit(": "), F.col("trigger.event_type"), F.lit("/"),
        F.coalesce("trigger.action", F.lit("event")), F.lit(" ("), seen, F.lit(")")))
    threshold = F.array(
        F.concat(F.col("evidence_count"), F.lit(" events for "), F.col("group_words"), F.lit(" within "), span,
                 F.lit("s (needs "), F.col("need"), F.lit(" in "), F.col("window_seconds"), F.lit("s)")),
        F.concat(F.lit("window "), stamp("first_us"), F.lit(" to "), stamp("last_us")))
    sequence = F.concat(
        F.array(F.concat(F.lit("steps for "), F.col("group_words"), F.lit(" within "), span, F.lit("s of "),
                         F.col("window_seconds"), F.lit("s"))),
        F.transform("steps", lambda s: F.concat(s["name"], F.lit(" x"), s["n"])))
    ioc = F.array(F.concat(F.col("matched_field"), F.lit(" holds known indicator "), F.col("ioc_id")))
    anomaly = F.concat(
        F.array(F.concat(F.lit("score "), F.col("anomaly_score"), F.lit(" from "), F.size("factors"), F.lit(" factor(s)"))),
        F.transform("factors", lambda f: f["reason"]))
    kind = F.col("rule_type")
    return (
        F.when(kind == "match", match).when(kind == "threshold", threshold).when(kind == "sequence", sequence)
        .when(kind == "ioc", ioc).otherwise(anomaly)
    )


def summarise(evidence: DataFrame, rules: list[Rule]) -> DataFrame:
    """One row per detection from its evidence rows."""
    spark = evidence.sparkSession
    body = F.struct(*[F.col(f"`{c}`") for c in CARRIED])
    steps = evidence.filter("step IS NOT NULL").groupBy("detection_id", "step_index").agg(
        F.first("step").alias("name"), F.count("*").alias("n")
    ).groupBy("detection_id").agg(
        F.array_sort(F.collect_list(F.struct("step_index", "name", "n"))).alias("steps"))  # one entry per step
    grouped = evidence.groupBy("detection_id").agg(
        F.first("rule_id").alias("rule_id"), F.first("group_key").alias("group_key"),
        F.count("*").alias("evidence_count"), F.min("us").alias("first_us"), F.max("us").alias("last_us"),
        F.max_by(body, F.struct(F.coalesce("step_index", F.lit(0)), "us", "event_id")).alias("trigger"),
        F.max("severity").alias("severity"), F.max("confidence").alias("confidence"),
        F.max("anomaly_score").alias("anomaly_score"), F.first("factors", ignorenulls=True).alias("factors"),
        F.max("ioc_id").alias("ioc_id"), F.max("matched_field").alias("matched_field"),
    ).join(steps, "detection_id", "left")
    table = F.broadcast(rule_table(spark, rules))
    df = grouped.join(table, "rule_id")
    span = F.greatest(F.lit(1), F.expr("(last_us - first_us) div 1000000"))
    base = F.col("rule_confidence")
    overshoot = F.greatest(F.lit(0.0), F.least(F.lit(0.15), 0.03 * (F.col("evidence_count") - F.col("need"))))
    tightness = 1.0 - F.least(F.lit(1.0), span / F.col("window_seconds"))
    confidence = (
        F.when(F.col("rule_type") == "threshold", F.round(F.least(F.lit(0.99), base + overshoot), 3))
        .when(F.col("rule_type") == "sequence", F.round(F.least(F.lit(0.99), base + 0.10 * tightness), 3))
        .otherwise(F.coalesce("confidence", base))
    )
    values = {name: F.col(f"trigger.`{name}`") for name in TITLE_FIELDS}
    title = _by_rule(rules, lambda r: (
        F.concat(F.lit("Known indicator seen: "), F.coalesce(F.get("group_key", F.lit(0)), F.lit("(unknown)")))
        if r.kind == "ioc" and not r.title else render_title(r, values, F.col("group_key"))
    ))
    return (
        df.withColumn("severity", F.coalesce("severity", "rule_severity"))
        .withColumn("confidence", confidence)
        .withColumn("title", title)
        .withColumn("group_words", _by_rule(rules, _group_words))
        .withColumn("explanation", explain())
        .withColumn("detected_us", F.col("last_us"))
        .withColumn("dedup_key", dedup_key())
        .drop("group_words", "rule_severity", "rule_confidence", "enabled", "steps")
    )


def dedup_key() -> Column:
    """Rule, group and time bucket: repeats inside the bucket share the key."""
    bucket = F.when(F.col("dedup_seconds") > 0, F.expr("last_us div (dedup_seconds * 1000000)")).otherwise(0)
    payload = F.concat_ws("|", "rule_id", F.array_join("group_key", "|", "None"), bucket.cast("string"))
    return F.concat(F.col("rule_id"), F.lit(":"), F.substring(F.sha2(payload, 256), 1, 24))


def detect(events: DataFrame, rules: list[Rule] | None = None, indicators: DataFrame | None = None,
           history: DataFrame | None = None, stored: DataFrame | None = None) -> Detected:
    """Run the pack over ``events``."""
    chosen = RULES if rules is None else rules
    evidence = collect_evidence(events, chosen, indicators, history, stored)
    return Detected(summarise(evidence, chosen), evidence)


def detection_order(detections: DataFrame) -> DataFrame:
    """The place of each detection: newest first, then by rule, ids break the remaining ties. Numbered day by day."""
    rows = detections.select("*", F.lit(0).alias("_all"), (-F.expr("detected_us div 86400000000")).alias("_day"))
    order = [F.desc("detected_us"), F.desc("rule_id"), "detection_id"]
    return numbered(rows, ["_all"], "_day", order, "place").drop("_all", "_day")


def alert_id(key: Column | str = "dedup_key") -> Column:
    return F.concat(F.lit("ALT-"), F.upper(F.substring(F.sha2(F.col(key) if isinstance(key, str) else key, 256), 1, 12)))


def fold_alerts(detections: DataFrame) -> DataFrame:
    """Fold repeats: the newest detection of a key creates the alert, the others only merge.

    A merge raises the confidence when higher and adds evidence; times, title and risk stay the newest's.
    """
    body = F.struct(*[F.col(c) for c in detections.columns if c != "dedup_key"])
    folded = detections.groupBy("dedup_key").agg(
        F.max_by(body, F.struct("detected_us", "detection_id")).alias("c"),
        F.max("confidence").alias("merged_confidence"),
        (F.count("*") - 1).alias("suppressed"),
    )
    out = folded.select("dedup_key", "merged_confidence", "suppressed", "c.*")
    return out.select(
        alert_id().alias("alert_id"), "dedup_key", "detection_id", "rule_id", "rule_name", "rule_type", "category",
        "severity", F.col("merged_confidence").alias("confidence"), F.col("confidence").alias("first_confidence"),
        "title", "explanation", "technique_ids", "tactics", "group_key", group_text("group_key").alias("group_text"),
        "detected_us", "first_us", "last_us",
        F.greatest(F.lit(0), F.expr("(detected_us - first_us) div 1000")).alias("detection_latency_ms"),
        F.lit("new").alias("status"), F.col("trigger.host").alias("host"), F.col("trigger.user").alias("user"),
        F.col("trigger.source_ip").alias("source_ip"), "evidence_count", "suppressed", "anomaly_score", "ioc_id",
        "matched_field", "dedup_seconds",
    )


def alert_evidence(detections: DataFrame, evidence: DataFrame) -> DataFrame:
    """Unique (alert, event) links with the carried event columns; the creating detection's step wins."""
    ids = detections.select("detection_id", alert_id().alias("alert_id"), "detected_us")
    linked = evidence.drop("severity", "confidence", "anomaly_score", "factors", "group_key", "matched_field", "ioc_id").join(ids, "detection_id")
    body = F.struct(*[F.col(f"`{c}`") for c in linked.columns if c not in ("alert_id", "event_id")])
    return linked.groupBy("alert_id", "event_id").agg(
        F.max_by(body, F.struct("detected_us", "detection_id")).alias("b")
    ).select("alert_id", "event_id", "b.*", F.lit("trigger").alias("role"))


def entity_keys(df: DataFrame, keep: list[str]) -> DataFrame:
    """Long form of the entities on event rows: one distinct ``(keep..., entity)`` per row."""
    prefixed = [("host", "host"), ("user", "user"), ("ip", "source_ip"), ("ip", "destination_ip"), ("cloud", "cloud_account")]
    present = F.array_compact(F.array(*[
        F.when((F.col(f"`{c}`").isNotNull()) & (F.col(f"`{c}`") != ""), F.concat(F.lit(f"{p}:"), F.col(f"`{c}`")))
        for p, c in prefixed
    ]))
    return df.select(*keep, F.explode(present).alias("entity")).distinct()


def score_alerts(alerts: DataFrame, evidence: DataFrame, ioc_matches: DataFrame, hosts: DataFrame,
                 users: DataFrame) -> DataFrame:
    """Alerts with ``risk_score`` and ``risk_breakdown``, from the creating detection's evidence."""
    own = evidence.join(alerts.select("alert_id", "detection_id"), "detection_id").select(
        "alert_id", "event_id", "host", "user", "flags")
    hits = ioc_matches.groupBy("event_id").agg(F.count("*").alias("iocs"))
    joined = (
        own.join(hosts.select(F.col("host_id").alias("host"), "criticality"), "host", "left")
        .join(users.select(F.col("user_id").alias("user"), "is_privileged"), "user", "left")
        .join(hits, "event_id", "left")
    )
    facts = joined.groupBy("alert_id").agg(
        F.max("criticality").alias("criticality"), F.coalesce(F.max("is_privileged"), F.lit(False)).alias("privileged"),
        F.array_distinct(F.flatten(F.collect_set("flags"))).alias("flags"),  # at most ten flag names
        F.coalesce(F.sum("iocs"), F.lit(0)).alias("iocs"),
    )
    from_ioc = F.col("ioc_id").isNotNull()
    scored = alerts.join(facts, "alert_id", "left").withColumn(
        "ioc_total", F.coalesce("iocs", F.lit(0)) + from_ioc.cast("int"))
    return scoring.with_risk(
        scored, severity=F.col("severity"), confidence=F.col("first_confidence"), criticality=F.col("criticality"),
        privileged=F.coalesce("privileged", F.lit(False)), flags=F.col("flags"), anomaly=F.col("anomaly_score"),
        ioc_count=F.col("ioc_total"), ioc_confidence=F.when(from_ioc, F.col("first_confidence")).otherwise(F.lit(0.0)),
        events=F.col("evidence_count"), tactics=F.size(F.array_distinct("tactics")), alerts=F.lit(1),
    ).drop("criticality", "privileged", "flags", "iocs", "ioc_total")


