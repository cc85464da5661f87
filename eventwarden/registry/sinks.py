"""Sinks fed from the event table in overlapping batches and read back."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from eventwarden.plans import detect, evaluate
from eventwarden.plans.desk import STRETCH, desk
from eventwarden.registry import sql as S
from eventwarden.registry.base import query
from eventwarden.registry.sql import with_alerts, with_ev
from eventwarden.session import work_folder
from eventwarden.sinks import tables


def _folder(spark) -> str:
    return f"{work_folder(spark)}/sink-{uuid.uuid4().hex}"


@query("sink_append_events", with_ev("SELECT CAST(ts AS DATE)::VARCHAR AS day, event_type, count(*) AS n FROM ev GROUP BY 1, 2"))
def sink_append_events(spark, sf_dir):
    """Two overlapping batches appended by day and type: every event is stored once."""
    events, folder = desk(spark, sf_dir).events, _folder(spark)
    cut = F.lit("2024-01-12").cast("timestamp")
    tables.append_events(events.filter(F.col("timestamp") < cut + F.expr("INTERVAL 2 DAYS")), folder, 0)
    tables.append_events(events.filter(F.col("timestamp") >= cut), folder, 1)
    stored = spark.read.schema("event_id string, event_date string, event_type string").parquet(folder)
    return stored.groupBy(F.col("event_date").alias("day"), "event_type").agg(F.count("*").alias("n"))


@query("sink_alert_upsert", with_alerts("SELECT alert_id, confidence, detected_us, last_us FROM al0", STRETCH))
def sink_alert_upsert(spark, sf_dir):
    """Alerts folded from the older half of the detections, then merged with those of all."""
    detections, folder = desk(spark, sf_dir).detections, _folder(spark)
    half = detections.filter(F.col("detected_us") < 1_705_363_200_000_000)
    tables.upsert_alerts(detect.fold_alerts(half), folder)
    tables.upsert_alerts(detect.fold_alerts(detections), folder)
    columns = ["alert_id", "confidence", "detected_us", "last_us"]
    return spark.read.schema("alert_id string, confidence double, detected_us bigint, last_us bigint").parquet(folder).select(*columns)


@query("sink_evidence_insert", with_alerts("SELECT alert_id, event_id FROM ae", STRETCH))
def sink_evidence_insert(spark, sf_dir):
    """Evidence links inserted twice from overlapping parts, kept once."""
    links, folder = desk(spark, sf_dir).alert_evidence.select("alert_id", "event_id", tables.event_day(F.col("us")).alias("day")), _folder(spark)
    tables.insert_absent(links.filter(F.col("day") <= "2024-01-20"), folder, ["alert_id", "event_id"], "day")
    tables.insert_absent(links.filter(F.col("day") >= "2024-01-10"), folder, ["alert_id", "event_id"], "day")
    return spark.read.schema("alert_id string, event_id string").parquet(folder).select("alert_id", "event_id")


@query("sink_indicator_upsert", with_ev("""
SELECT CASE WHEN s.ioc_id IS NOT NULL THEN s.ioc_id ELSE 'NEW-' || f.ip END AS ioc_id, CASE WHEN f.ip IS NOT NULL THEN 0.9 ELSE s.ioc_confidence END AS confidence
FROM (SELECT * FROM ind WHERE ioc_type = 'ip') s FULL JOIN (SELECT DISTINCT source_ip AS ip FROM ev WHERE source_ip LIKE '203.%' AND k >= 80 AND k < 95) f ON s.ioc_key = f.ip""", S.INDICATORS))
def sink_indicator_upsert(spark, sf_dir):
    """Addresses seen in events merged into the stored indicators."""
    d = desk(spark, sf_dir)
    k = F.element_at(F.split("source_ip", r"\."), -1).cast("int")
    seen = d.events.filter(F.col("source_ip").startswith("203.") & (k >= 80) & (k < 95)).select("source_ip").distinct()
    fresh = seen.select(
        F.concat(F.lit("NEW-"), "source_ip").alias("ioc_id"), F.col("source_ip").alias("indicator"), F.lit("ip").alias("ioc_type"),
        F.lit(0.9).alias("confidence"), F.lit("high").alias("severity"), F.lit("seen").alias("source"), F.lit("").alias("description"),
        F.array(F.lit("seen")).alias("tags"), F.lit(True).alias("is_active"))
    merged, _ = tables.upsert_indicators(fresh, d.indicators.filter("ioc_type = 'ip'"))
    return merged.select("ioc_id", "confidence")


@query("sink_evaluation", with_alerts("""
SELECT count(*) FILTER (label = 'malicious' AND hit) AS true_positives, count(*) FILTER (label = 'benign' AND hit) AS false_positives
FROM (SELECT label, e IN (SELECT e FROM ae) AS hit FROM ev)""", STRETCH))
def sink_evaluation(spark, sf_dir):
    """Evaluation result written as a table."""
    d, folder = desk(spark, sf_dir), _folder(spark)
    tables.write_table(evaluate.metrics(evaluate.confusion(d.events, d.alert_evidence)), folder)
    return spark.read.schema("true_positives bigint, false_positives bigint").parquet(folder)


@query("quarantine_late", with_ev("""
SELECT event_id, CASE WHEN us > 1706486400000000 + 86400000000 THEN 'timestamp is more than 24h in the future' ELSE 'late' END AS reason
FROM ev WHERE us > 1706486400000000 + 86400000000 OR us < 1704240000000000"""))
def quarantine_late(spark, sf_dir):
    """Events behind a watermark or ahead of a clock."""
    from eventwarden.streaming.operators import late_or_future

    return late_or_future(desk(spark, sf_dir).events, 1_704_240_000_000_000, 1_706_486_400_000_000).select("event_id", "reason")


@query("unknown_techniques", with_ev("SELECT DISTINCT 'T' || (1000 + k) AS technique_id FROM ev WHERE 'T' || (1000 + k) NOT IN (SELECT technique_id FROM tq)", S.catalogue_ctes()))
def unknown_techniques(spark, sf_dir):
    """Technique ids made from the events that the catalogue lacks."""
    from eventwarden.catalogue import unknown_techniques as missing

    k = F.element_at(F.split("source_ip", r"\."), -1).cast("int")
    return missing(desk(spark, sf_dir).events.select(F.concat(F.lit("T"), (k + 1000).cast("string")).alias("technique_id")))


