"""The stored tables of one deployment: ingest once, detect once, query many times.

Events, alerts, evidence and incidents are written as Parquet to this application's folder in the shared
checkpoint location the first time they are asked for, and every later query reads them back with column
and partition pruning. A cluster deployment points the same functions at its warehouse tables.
"""

from __future__ import annotations

import hashlib
from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from eventwarden.model import event_schema
from eventwarden.operators.indicators import match_indicators
from eventwarden.plans import detect, incidents
from eventwarden.plans.rulepack import rule, stretched
from eventwarden.session import prepare, work_folder
from eventwarden.sources.bridge import bridge_events
from eventwarden.sources.inventory import discover_hosts, discover_users
from eventwarden.sources.replay import time_slices

# The test feed has about two events per account and day, so rule windows are stretched by this factor.
STRETCH = 96
# Files of the replayed feed: a micro-batch takes many of them in order, so that each is read by a task of its own.
SLICE_SECONDS = 3 * 3600
# "Now" of the test feed.
NOW_US = 1_706_659_200_000_000  # 2024-01-31 00:00:00 UTC


def demo_indicators(spark: SparkSession) -> DataFrame:
    """Ten addresses and one hash of the test feed."""
    addresses = spark.range(90, 100).select(
        F.concat(F.lit("IOC-"), "id").alias("ioc_id"), F.concat(F.lit("203.0.113."), "id").alias("indicator"),
        F.lit("ip").alias("ioc_type"), (F.lit(0.5) + (F.col("id") - 90) / 20.0).alias("confidence"),
        F.when(F.col("id") % 2 == 0, "high").otherwise("medium").alias("severity"),
    )
    hashes = spark.range(1).select(
        F.lit("IOC-200").alias("ioc_id"), F.lit("C" * 64).alias("indicator"), F.lit("hash").alias("ioc_type"),
        F.lit(0.95).alias("confidence"), F.lit("critical").alias("severity"),
    )
    return addresses.union(hashes).select(
        "*", F.lit("demo").alias("source"), F.lit("").alias("description"),
        F.array(F.lit("demo")).alias("tags"), F.lit(True).alias("is_active"))


class Desk:
    """Lazily stored tables over one data folder."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark = prepare(spark)
        self.sf_dir = sf_dir
        digest = hashlib.sha256(sf_dir.encode()).hexdigest()[:12]
        self.folder = f"{work_folder(spark)}/desk-{digest}"

    def _stored(self, name: str, df: DataFrame, partition: str | None = None) -> DataFrame:
        path = f"{self.folder}/{name}"
        writer = df.write.mode("overwrite")
        if partition:
            writer = writer.partitionBy(partition)
        writer.parquet(path)
        return self.spark.read.schema(df.schema).parquet(path).select(*[F.col(f"`{c}`") for c in df.columns])

    @cached_property
    def events(self) -> DataFrame:
        bridged = bridge_events(self.spark, self.sf_dir)
        stored = self._stored("events", bridged, "event_type")
        return stored.select(*[F.col(f"`{f.name}`") for f in event_schema().fields])

    @cached_property
    def event_slices(self) -> str:
        """Folder of the events in files of ``SLICE_SECONDS`` each, in time order."""
        folder = f"{self.folder}/event_slices"
        time_slices(self.events, folder, SLICE_SECONDS)
        return folder

    @cached_property
    def rules(self):
        return stretched(STRETCH)

    @cached_property
    def indicators(self) -> DataFrame:
        return demo_indicators(self.spark)

    @cached_property
    def hosts(self) -> DataFrame:
        number = F.substring("host_id", 6, 10).cast("int")
        found = discover_hosts(self.events).withColumn("criticality", 1 + number % 5).withColumn(
            "is_isolated", number % 7 == 0).withColumn(
            "environment", F.when(number % 2 == 0, "production").otherwise("staging"))
        return self._stored("hosts", found)

    @cached_property
    def users(self) -> DataFrame:
        number = F.substring("user_id", 6, 12).cast("int")
        found = discover_users(self.events).withColumn("is_privileged", number % 10 == 0).withColumn(
            "is_disabled", number % 17 == 0)
        return self._stored("users", found)

    @cached_property
    def ioc_matches(self) -> DataFrame:
        """Unique (indicator, event, field) hits of the indicator rule."""
        spec = rule("IOC_MATCH_001", self.rules)
        hits = match_indicators(self.events, self.indicators, list(spec.ioc_fields), list(spec.ioc_types))
        return self._stored("ioc_matches", hits.select(
            "ioc_id", "event_id", "matched_field", "matched_value", "ioc_type", "ioc_indicator", "ioc_confidence",
            "ioc_severity", "host", F.unix_micros("timestamp").alias("us")).distinct())

    @cached_property
    def evidence(self) -> DataFrame:
        return self._stored("evidence", detect.collect_evidence(self.events, self.rules, self.indicators))

    @cached_property
    def detections(self) -> DataFrame:
        return self._stored("detections", detect.summarise(self.evidence, self.rules))

    @cached_property
    def alert_evidence(self) -> DataFrame:
        return self._stored("alert_evidence", detect.alert_evidence(self.detections, self.evidence))

    @cached_property
    def alert_entities(self) -> DataFrame:
        """``(alert_id, entity)``; the merged alert carries its creating detection's entities."""
        own = self.evidence.join(self.unscored_alerts.select("alert_id", "detection_id"), "detection_id")
        return self._stored("alert_entities", detect.entity_keys(own, ["alert_id"]))

    @cached_property
    def unscored_alerts(self) -> DataFrame:
        return self._stored("unscored_alerts", detect.fold_alerts(self.detections))

    @cached_property
    def scored_alerts(self) -> DataFrame:
        return self._stored("scored_alerts", detect.score_alerts(
            self.unscored_alerts, self.evidence, self.ioc_matches, self.hosts, self.users))

    @cached_property
    def assigned(self) -> DataFrame:
        return self._stored("assigned", incidents.assign_incidents(self.unscored_alerts, self.alert_entities))

    @cached_property
    def alerts(self) -> DataFrame:
        return self._stored("alerts", self.scored_alerts.join(self.assigned, "alert_id"))

    @cached_property
    def incident_events(self) -> DataFrame:
        return self._stored("incident_events", incidents.incident_events(self.alerts, self.alert_evidence))

    @cached_property
    def incident_entities(self) -> DataFrame:
        return self._stored("incident_entities", incidents.incident_entities(self.incident_events))

    @cached_property
    def incident_keys(self) -> DataFrame:
        return self._stored("incident_keys", incidents.incident_keys(self.alerts, self.alert_entities))

    @cached_property
    def techniques(self) -> DataFrame:
        return self._stored("techniques", incidents.technique_rollup(self.alerts, self.alert_evidence))

    @cached_property
    def chain(self) -> DataFrame:
        return self._stored("chain", incidents.attack_chain(self.techniques))

    @cached_property
    def incidents(self) -> DataFrame:
        return self._stored("incidents", incidents.summarise_incidents(
            self.alerts, self.incident_events, self.incident_entities, self.incident_keys, self.chain,
            self.techniques, self.ioc_matches, self.hosts, self.users))

    @cached_property
    def response_actions(self) -> DataFrame:
        """Containment actions of the test feed: one on every third incident, by its number."""
        number = F.substring("incident_id", 10, 10).cast("bigint")
        return self.incidents.filter(number % 3 == 0).select(
            "incident_id", F.lit("isolate_host").alias("action_type"),
            F.coalesce(F.get("hosts_first", F.lit(0)), F.lit("none")).alias("target"),
            (F.col("first_alert_us") + (number % 50) * 60_000_000).alias("created_us"), F.lit("completed").alias("status"))


_DESKS: dict[tuple[str, str], Desk] = {}


def desk(spark: SparkSession, sf_dir: str) -> Desk:
    """The desk of this application and folder."""
    key = (spark.sparkContext.applicationId, sf_dir)
    if key not in _DESKS:
        _DESKS[key] = Desk(spark, sf_dir)
    prepare(spark)
    return _DESKS[key]


