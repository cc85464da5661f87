"""Detection quality on labelled events: one event is the unit, trigger evidence is a positive."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from eventwarden.model import micros
from eventwarden.operators.quantiles import order_statistics


def triggered(evidence: DataFrame) -> DataFrame:
    """Events that are trigger evidence of at least one alert."""
    return evidence.filter("role = 'trigger'").select("event_id").distinct()


def _labelled(events: DataFrame, evidence: DataFrame) -> DataFrame:
    hits = triggered(evidence).withColumn("detected", F.lit(True))
    slim = events.select("event_id", "label", "label_scenario", micros().alias("us"))
    return slim.join(hits, "event_id", "left").withColumn("detected", F.coalesce("detected", F.lit(False)))


def confusion(events: DataFrame, evidence: DataFrame) -> DataFrame:
    """One row of counts; ambiguous events are counted apart."""
    bad, good, unsure = (F.col("label") == x for x in ("malicious", "benign", "ambiguous"))
    hit = F.col("detected")
    return _labelled(events, evidence).agg(
        F.count_if(bad & hit).alias("true_positives"), F.count_if(good & hit).alias("false_positives"),
        F.count_if(good & ~hit).alias("true_negatives"), F.count_if(bad & ~hit).alias("false_negatives"),
        F.count_if(unsure).alias("ambiguous_total"), F.count_if(unsure & hit).alias("ambiguous_alerted"))


def _ratio(top: Column, bottom: Column) -> Column:
    return F.when(bottom > 0, top / bottom).otherwise(F.lit(0.0))


def metrics(matrix: DataFrame) -> DataFrame:
    """Precision, recall, F1, accuracy, false-positive rate and ambiguous alert rate; 0 on an empty base."""
    tp, fp, tn, fn = (F.col(c) for c in ("true_positives", "false_positives", "true_negatives", "false_negatives"))
    p, r = _ratio(tp, tp + fp), _ratio(tp, tp + fn)
    return matrix.select(
        "*", F.round(p, 4).alias("precision"), F.round(r, 4).alias("recall"), F.round(_ratio(2 * p * r, p + r), 4).alias("f1"),
        F.round(_ratio(tp + tn, tp + fp + tn + fn), 4).alias("accuracy"), F.round(_ratio(fp, fp + tn), 4).alias("false_positive_rate"),
        F.round(_ratio(F.col("ambiguous_alerted"), F.col("ambiguous_total")), 4).alias("ambiguous_alert_rate"))


def _event_alerts(events: DataFrame, alerts: DataFrame, evidence: DataFrame) -> DataFrame:
    links = evidence.filter("role = 'trigger'").select("alert_id", "event_id").join(
        alerts.select("alert_id", F.col("rule_id"), "detected_us"), "alert_id")
    return links.join(events.select("event_id", "label", "label_scenario"), "event_id")


def per_scenario(events: DataFrame, alerts: DataFrame, evidence: DataFrame, expected: DataFrame | None = None) -> DataFrame:
    """Recall, rules fired and first-alert latency per scenario; with ``expected(scenario, rule_id)`` also
    which expected rules fired and which stayed silent."""
    scenario = F.coalesce("label_scenario", F.lit("unlabelled")).alias("scenario")
    base = _labelled(events, evidence).groupBy(scenario).agg(
        F.coalesce(F.min("label"), F.lit("unlabelled")).alias("label"), F.count("*").alias("events"),
        F.count_if("detected").alias("detected_events"), F.min("us").alias("first_event_us"))
    links = _event_alerts(events, alerts, evidence)
    fired = links.groupBy(scenario).agg(
        F.count_distinct("alert_id").alias("alert_count"), F.min("detected_us").alias("first_alert_us"),
        F.array_sort(F.collect_set("rule_id")).alias("rules_fired"))  # at most as many as rules
    none = F.array().cast("array<string>")
    out = base.join(fired, "scenario", "left").withColumn("alert_count", F.coalesce("alert_count", F.lit(0))).withColumn(
        "rules_fired", F.coalesce("rules_fired", none)).withColumn(
        "event_recall", F.round(F.col("detected_events") / F.col("events"), 4)).withColumn(
        "detected", F.col("alert_count") > 0).withColumn(
        "latency_ms", F.when(F.col("detected"), F.round(F.greatest(F.lit(0.0), (F.col("first_alert_us") - F.col("first_event_us")) / 1000.0), 1)))
    if expected is None:
        return out
    wanted = expected.groupBy("scenario").agg(F.array_sort(F.collect_set("rule_id")).alias("expected_rules"))
    return out.join(wanted, "scenario", "left").withColumn(
        "expected_fired", F.array_sort(F.array_intersect("expected_rules", "rules_fired"))).withColumn(
        "expected_missed", F.array_sort(F.array_except("expected_rules", "rules_fired")))


def latency_stats(scenarios: DataFrame) -> DataFrame:
    """Count, median, mean, nearest-rank p95, minimum and maximum of the malicious scenarios' latency."""
    waits = scenarios.filter("label = 'malicious' AND detected").select(
        F.lit("all").alias("k"), F.greatest(F.lit(0), F.col("first_alert_us") - F.col("first_event_us")).alias("wait_us"))
    stats = order_statistics(waits, ["k"], "wait_us", 60_000_000)
    return stats.select("count", *[F.round(F.col(c) / 1000.0, 1).alias(f"{c}_ms") for c in ("median", "mean", "p95", "min", "max")])


def per_rule(events: DataFrame, alerts: DataFrame, evidence: DataFrame) -> DataFrame:
    """Alerts, labelled events and precision of every rule that fired."""
    links = _event_alerts(events, alerts, evidence)
    label = lambda x: F.count_if(F.col("label") == x)
    out = links.groupBy("rule_id").agg(
        F.count_distinct("alert_id").alias("alerts"), label("malicious").alias("true_positive_events"),
        label("benign").alias("false_positive_events"), label("ambiguous").alias("ambiguous_events"))
    tp, fp = F.col("true_positive_events"), F.col("false_positive_events")
    return out.withColumn("event_precision", F.when(tp + fp > 0, F.round(tp / (tp + fp), 4)).otherwise(1.0))


def silent_rules(rules: DataFrame, alerts: DataFrame) -> DataFrame:
    """Rules without a single alert."""
    return rules.select("rule_id").join(alerts.select("rule_id").distinct(), "rule_id", "left_anti")


def scenario_coverage(expected: DataFrame, detected: DataFrame) -> DataFrame:
    """Per run: techniques expected, detected, covered, missed, additional and the covered share.

    ``expected`` and ``detected`` hold ``(run_id, technique_id)``; both lists come from the catalogue.
    """
    collect = lambda df, name: df.groupBy("run_id").agg(F.array_sort(F.collect_set("technique_id")).alias(name))
    none = F.array().cast("array<string>")
    both = collect(expected, "expected").join(collect(detected, "detected"), "run_id", "full_outer").select(
        "run_id", F.coalesce("expected", none).alias("expected"), F.coalesce("detected", none).alias("detected"))
    covered = F.array_intersect("expected", "detected")
    return both.select(
        "*", covered.alias("covered"), F.array_except("expected", "detected").alias("missed"), F.array_except("detected", "expected").alias("additional"),
        F.when(F.size("expected") > 0, F.round(F.size(covered) / F.size("expected"), 3)).otherwise(0.0).alias("coverage_ratio"))


def stage_log(events: DataFrame, start_us: int) -> DataFrame:
    """Per scenario: records, sources, first and last time, offset from the start."""
    return events.groupBy(F.coalesce("label_scenario", F.lit("unlabelled")).alias("stage")).agg(
        F.count("*").alias("record_count"), F.array_join(F.array_sort(F.collect_set("source")), ",").alias("sources"),
        F.min(micros()).alias("first_us"), F.max(micros()).alias("last_us")).withColumn(
        "offset_seconds", F.expr(f"(first_us - {start_us}) div 1000000"))
