"""The streaming pipeline: ingest, detect, alert and correlate in micro-batches."""

from __future__ import annotations

import uuid
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType

from eventwarden.model import CORRELATION_WINDOW_SECONDS, LOOKBACK_SECONDS, event_schema
from eventwarden.operators import baseline, correlate
from eventwarden.plans import detect, incidents
from eventwarden.plans.lookback import lookback_candidates
from eventwarden.plans.rulepack import RULES, Rule
from eventwarden.session import prepare, stage, together, work_folder
from eventwarden.sinks import tables
from eventwarden.sinks.incremental import IncrementalTable
from eventwarden.sources.inventory import discover_hosts, discover_users
from eventwarden.sources.normalize import normalize, split_rejects
from eventwarden.sources.replay import sliced_stream, time_slices
from eventwarden.streaming.operators import late_or_future

MERGED = "incident_id string, into string"
SPANS = "incident_id string, first_us bigint, last_us bigint"
METRICS_DDL = "metric string, value bigint, batch_id int"
IOC_MATCH_DDL = "ioc_id string, event_id string, matched_field string, ioc_confidence double, event_date string"


@dataclass
class Pipeline:
    """One deployment: a folder of tables, a rule pack and an indicator table."""

    spark: SparkSession
    folder: str
    rules: list[Rule] = field(default_factory=lambda: list(RULES))
    indicators: DataFrame | None = None
    lookback_seconds: int = LOOKBACK_SECONDS
    window_seconds: int = CORRELATION_WINDOW_SECONDS
    now: object = None
    # events this far behind the newest event of earlier batches are refused; None admits any lateness
    lateness_seconds: int | None = None
    _counts: dict = field(default_factory=dict, repr=False)

    def path(self, name: str) -> str:
        return f"{self.folder.rstrip('/')}/{name}"

    # ---- one batch -------------------------------------------------------------------------------
    def run_raw(self, raw: DataFrame, batch_id: int) -> None:
        """Normalize a batch of raw records, quarantine the refused ones, process the rest."""
        checked = stage(normalize(raw, self.now), "normalized")
        good, bad = split_rejects(checked)
        self._counts["events_rejected"] = self._batch_table("quarantine", bad, batch_id)
        names = event_schema().fieldNames()
        ids = good.withColumn("event_id", F.coalesce("event_id", F.concat(F.lit("EVT-"), F.upper(F.substring(F.sha2("record_id", 256), 1, 16)))))
        self.run_events(ids.select(*[F.col(f"`{n}`") for n in names]), batch_id)

    def run_events(self, events: DataFrame, batch_id: int) -> None:
        """Store a batch of canonical events and run detection, alerting and correlation on it.

        Every write is idempotent per batch, so a batch that failed half-way is simply run again.
        """
        admitted = self._on_time(stage(events.dropDuplicates(["event_id"]), "arrived"), batch_id)
        new = tables.append_events(admitted, self.path("events"), batch_id)
        ingested = new.count()
        if ingested:
            self._counts["events_ingested"] = ingested
            candidates, *_ = together(
                lambda: self._candidates(new),
                lambda: self._batch_table("watermarks", new.agg(F.max(F.unix_micros("timestamp")).alias("newest_us")), batch_id),
                *self._inventory(new, batch_id))
            alerts = self._detect(new, candidates, batch_id)
            # the baseline learns after detection: a batch is judged on what came before it
            together(lambda: self._learn(new, batch_id), lambda: alerts is None or self._correlate(alerts, batch_id))
        if self._counts:
            rows = self.spark.createDataFrame(sorted(self._counts.items()), "metric string, value bigint")
            self._batch_table("batch_metrics", rows, batch_id)
            self._counts = {}

    def _batch_table(self, name: str, rows: DataFrame, batch_id: int) -> int:
        """Rows of one batch; a batch that runs again replaces its own. Returns their number."""
        counted = Observation()
        rows.withColumn("batch_id", F.lit(batch_id)).observe(counted, F.count(F.lit(1)).alias("rows")).write.mode("overwrite").option(
            "partitionOverwriteMode", "dynamic").partitionBy("batch_id").parquet(self.path(name))
        return counted.get["rows"]

    def _on_time(self, events: DataFrame, batch_id: int) -> DataFrame:
        """The batch without late and future events, which go to the table ``late`` with a reason."""
        newest = None
        if self.lateness_seconds is not None and tables.exists(self.spark, self.path("watermarks")):
            newest = self.spark.read.schema("newest_us bigint, batch_id int").parquet(self.path("watermarks")).filter(
                F.col("batch_id") < batch_id).agg(F.max("newest_us")).first()[0]
        now = F.unix_micros(F.current_timestamp() if self.now is None else self.now)
        bound = F.lit(None if newest is None else newest - self.lateness_seconds * 1_000_000).cast("bigint")
        refused = stage(late_or_future(events, bound, now).select("event_id", "source", "reason", "raw"), "late")
        if refused.isEmpty():
            return events
        self._batch_table("late", refused, batch_id)
        return stage(events.join(refused.select("event_id"), "event_id", "left_anti").select(*events.columns), "on-time")

    def set_status(self, statuses: DataFrame) -> None:
        """Records ``(incident_id, status)``; the latest entry counts. Incidents that are not active take no more alerts."""
        statuses.select("incident_id", "status", F.current_timestamp().alias("at")).write.mode("append").parquet(
            self.path("incident_status"))

    def _statuses(self) -> DataFrame:
        stored = tables.read_or_empty(self.spark, self.path("incident_status"),
                                      StructType.fromDDL("incident_id string, status string, at timestamp"))
        return stored.groupBy("incident_id").agg(F.max_by("status", "at").alias("status"))

    # ---- tables that every batch adds to ---------------------------------------------------------
    def _incremental(self, name: str) -> IncrementalTable:
        inventory = lambda schema, key: (schema, [key], {
            f.name: {"first_seen": "min", "last_seen": "max"}.get(f.name, "first") for f in schema.fields if f.name != key}, None)
        if name in ("hosts", "users"):
            events = self.spark.createDataFrame([], event_schema())
            found, key = (discover_hosts(events), "host_id") if name == "hosts" else (discover_users(events), "user_id")
            spec = inventory(found.schema, key)
        else:
            ddl, keys, merge, bucket = {
                "baseline": ("entity_ref string, feature string, value string, n bigint", ["entity_ref", "feature", "value"], {"n": "sum"}, None),
                "membership": (self.MEMBERSHIP_DDL, ["alert_id"], {"incident_id": "last", "first_us": "min", "last_us": "max"}, None),
                "incident_spans": (SPANS, ["incident_id"], {"first_us": "min", "last_us": "max"}, None),
                "incident_entities": ("incident_id string, entity string", ["incident_id", "entity"], {}, "entity"),
                "incident_merges": (MERGED, ["incident_id"], {"into": "last"}, None),
                "incident_numbers": ("year string, used int", ["year"], {"used": "max"}, None),
            }[name]
            spec = StructType.fromDDL(ddl), keys, merge, bucket
        return IncrementalTable(self.spark, self.path(name), *spec)

    def _inventory(self, new: DataFrame, batch_id: int) -> list[Callable]:
        return [lambda: self._incremental("hosts").apply(discover_hosts(new), batch_id),
                lambda: self._incremental("users").apply(discover_users(new), batch_id)]

    def _learn(self, new: DataFrame, batch_id: int) -> None:
        self._incremental("baseline").apply(baseline.frequency_table(new, keep=None), batch_id)

    def _baseline(self, before: int | None = None, entities: DataFrame | None = None) -> DataFrame:
        counts = self._incremental("baseline").read(before, entities)
        totals = counts.groupBy("entity_ref", "feature").agg(F.sum("n").alias("observation_count"))
        return counts.join(totals, ["entity_ref", "feature"]).select("entity_ref", "feature", "value", "n", "observation_count")

    def _candidates(self, new: DataFrame) -> DataFrame:
        """The batch and the history its stateful rules look back on."""
        low, high = new.agg(F.min("timestamp"), F.max("timestamp")).first()
        first_day = F.date_format(F.lit(low) - F.expr(f"make_dt_interval(0, 0, 0, {int(self.lookback_seconds)})"), "yyyy-MM-dd")
        # only the days the look-back reaches are listed and read
        history = self.spark.read.schema(self._event_table_schema()).parquet(self.path("events")).filter(
            (F.col("event_date") >= first_day) & (F.col("event_date") <= F.date_format(F.lit(high), "yyyy-MM-dd")))
        history = history.select(*[F.col(f"`{n}`") for n in event_schema().fieldNames()])
        return stage(lookback_candidates(history, new, self.lookback_seconds, (low, high)), "candidates")

    def _detect(self, new: DataFrame, candidates: DataFrame, batch_id: int) -> DataFrame | None:
        stored = self._baseline(batch_id, new.filter(F.col("user").isNotNull()).select(F.lower("user").alias("entity_ref")))
        skipped: list[str] = []
        evidence = stage(detect.collect_evidence(
            new, self.rules, self.indicators, stored=stored, candidates=candidates,
            skipped=skipped), "evidence")
        if skipped:
            self._batch_table("skipped_rules", self.spark.createDataFrame([(r,) for r in sorted(set(skipped))], "rule_id string"), batch_id)
        if evidence.isEmpty():
            return None
        detections = stage(detect.summarise(evidence, self.rules), "detections")
        iocs = evidence.filter("ioc_id IS NOT NULL").select(
            "ioc_id", "event_id", "matched_field", tables.event_day(F.col("us")).alias("event_date"))
        if self.indicators is not None:
            iocs = iocs.join(self.indicators.select("ioc_id", F.col("confidence").alias("ioc_confidence")), "ioc_id", "left")
        else:
            iocs = iocs.withColumn("ioc_confidence", F.lit(None).cast("double"))
        iocs = iocs.select("ioc_id", "event_id", "matched_field", "ioc_confidence", "event_date")

        def alerts() -> DataFrame:
            hosts, users = (self._incremental(name).read(batch_id + 1, candidates.select(F.col(column).alias(key)))
                            for name, column, key in (("hosts", "host", "host_id"), ("users", "user", "user_id")))
            scored = detect.score_alerts(detect.fold_alerts(detections), evidence, iocs, hosts, users)
            return tables.upsert_alerts(scored, self.path("alerts"))

        links = detect.alert_evidence(detections, evidence).withColumn("event_date", tables.event_day(F.col("us")))
        touched, self._counts["ioc_matches"], *_ = together(
            alerts,
            lambda: tables.insert_absent(iocs, self.path("ioc_matches"), ["ioc_id", "event_id", "matched_field"], "event_date").count(),
            lambda: tables.insert_absent(links, self.path("alert_evidence"), ["alert_id", "event_id"], "event_date"),
            lambda: tables.insert_absent(detect.entity_keys(links, ["alert_id", "event_date"]), self.path("alert_entities"),
                                         ["alert_id", "entity"], "event_date"))
        return touched

    def _event_table_schema(self):
        schema = event_schema()
        return schema.add("batch_id", "long").add("event_date", "string")

    # ---- incidents -------------------------------------------------------------------------------
    MEMBERSHIP_DDL = "alert_id string, incident_id string, first_us bigint, last_us bigint"

    def _correlate(self, touched: DataFrame, batch_id: int) -> None:
        """Put the batch's new alerts into existing or new incidents; incidents that meet are merged.

        New is what no earlier batch placed: a repeat of an old alert changes no incident, and a batch that
        runs again places its alerts again.
        """
        member = self._incremental("membership").read(batch_id, touched)
        inserted = stage(touched.join(member.select("alert_id"), "alert_id", "left_anti"), "inserted")
        earliest = inserted.agg(F.min("first_us")).first()[0]
        if earliest is None:
            return
        low = earliest - self.window_seconds * 1_000_000
        entities = self.spark.read.schema("alert_id string, entity string, event_date string").parquet(self.path("alert_entities")).filter(
            F.col("event_date") >= tables.event_day(F.lit(low))).select("alert_id", "entity")
        own = stage(entities.join(inserted.select("alert_id"), "alert_id", "left_semi"), "own-entities")
        merges = self._incremental("incident_merges")
        gone = merges.read(batch_id)

        def met() -> tuple[DataFrame, DataFrame]:
            """Incidents that share an entity, by the name they go by now, and did not end before the window of the new alerts."""
            near = stage(self._current(self._incremental("incident_entities").read(batch_id, own), gone).distinct(), "near-incidents")
            return near, stage(self._incremental("incident_spans").read(batch_id, near).filter(F.col("last_us") >= low).join(
                self._statuses(), "incident_id", "left").withColumn("status", F.coalesce("status", F.lit("open"))), "known")

        clusters, (near, known) = together(
            lambda: stage(correlate.cluster_alerts(inserted, own, self.window_seconds), "clusters"), met)
        windows = correlate.cluster_windows(inserted, clusters)
        cluster_entities = own.join(clusters, "alert_id").select("cluster", "entity")
        matches = stage(correlate.matching_incidents(windows, cluster_entities, known, near, self.window_seconds), "matches")
        chosen, absorbed = correlate.merge_into_incidents(windows, matches, known)
        rest = windows.join(chosen.select("cluster"), "cluster", "left_anti")
        numbers = self._incremental("incident_numbers")
        taken = numbers.read(batch_id).select(F.concat_ws("-", F.lit("INC"), "year", F.col("used").cast("string")).alias("incident_id"))
        absorbed, fresh = together(
            lambda: stage(absorbed, "absorbed"), lambda: stage(correlate.number_incidents(rest, taken=taken), "fresh-incidents"))
        placed = stage(clusters.join(chosen.unionByName(fresh), "cluster").select("alert_id", "incident_id").join(
            inserted.select("alert_id", "first_us", "last_us"), "alert_id"), "placed")
        parts = F.split("incident_id", "-")
        used = fresh.groupBy(F.get(parts, F.lit(1)).alias("year")).agg(F.max(F.get(parts, F.lit(2)).cast("int")).alias("used"))
        # what an incident took over before now goes by the name of the one that takes it over
        onward = gone.join(absorbed.select(F.col("incident_id").alias("into"), F.col("into").alias("end")), "into")
        onward = onward.select("incident_id", F.col("end").alias("into"))
        taken_over = known.join(absorbed, "incident_id").select(F.col("into").alias("incident_id"), "first_us", "last_us")
        spans = placed.select("incident_id", "first_us", "last_us").unionByName(taken_over).groupBy("incident_id").agg(
            F.min("first_us").alias("first_us"), F.max("last_us").alias("last_us"))
        touching = placed.join(own, "alert_id").select("incident_id", "entity").distinct()
        self._counts["alerts"], merged, opened, *_ = together(
            lambda: self._incremental("membership").apply(placed, batch_id),
            lambda: self._batch_table("merged_incidents", absorbed, batch_id),
            lambda: fresh.select("incident_id").count(),
            lambda: numbers.apply(used, batch_id),
            lambda: merges.apply(absorbed.unionByName(onward), batch_id),
            lambda: self._incremental("incident_spans").apply(spans, batch_id),
            lambda: self._incremental("incident_entities").apply(touching, batch_id))
        self._counts["incidents"] = opened - merged

    @staticmethod
    def _current(rows: DataFrame, gone: DataFrame) -> DataFrame:
        """``rows`` with the incident that has taken theirs over."""
        others = [c for c in rows.columns if c != "incident_id"]
        return rows.join(gone, "incident_id", "left").select(F.coalesce("into", "incident_id").alias("incident_id"), *others)

    def tables(self) -> dict[str, DataFrame]:
        """Current tables of the deployment."""
        read = self.spark.read.parquet
        member = self._current(self._incremental("membership").read(), self._incremental("incident_merges").read()).select(
            "alert_id", "incident_id")
        return {
            "events": read(self.path("events")), "alerts": read(self.path("alerts")), "alert_evidence": read(self.path("alert_evidence")),
            "alert_entities": read(self.path("alert_entities")).select("alert_id", "entity"), "membership": member,
            "hosts": self._incremental("hosts").read(), "users": self._incremental("users").read(),
            "ioc_matches": tables.read_or_empty(self.spark, self.path("ioc_matches"), StructType.fromDDL(IOC_MATCH_DDL)), "baseline": self._baseline(),
        }

    def cases(self) -> incidents.Cases:
        """Incident tables rebuilt from the stored alerts."""
        t = self.tables()
        links = t["alert_evidence"].drop("event_date")
        return incidents.build_cases(t["alerts"].drop("alert_date", "incident_id"), links, t["alert_entities"], t["ioc_matches"], t["hosts"], t["users"], t["membership"])

    def replay(self, events: DataFrame, slice_seconds: int = 3600) -> int:
        """Feed a stored table slice by slice in time order, so that no rule sees an event before its time.

        The table is scanned once, into one file per slice; a file stream then takes one file per micro-batch. Returns the
        number of batches.
        """
        prepare(self.spark)
        work = f"{work_folder(self.spark)}/replay-{uuid.uuid4().hex}"
        time_slices(events, f"{work}/slices", slice_seconds)
        query = self.start_events(sliced_stream(self.spark, f"{work}/slices", events.schema), f"{work}/checkpoint")
        query.awaitTermination()
        return query.lastProgress["batchId"] + 1 if query.lastProgress else 0

    # ---- streams ---------------------------------------------------------------------------------
    def start_raw(self, raw_stream: DataFrame, checkpoint: str, available_now: bool = True) -> StreamingQuery:
        return self._start(raw_stream, self.run_raw, checkpoint, available_now)

    def start_events(self, event_stream: DataFrame, checkpoint: str, available_now: bool = True) -> StreamingQuery:
        return self._start(event_stream, self.run_events, checkpoint, available_now)

    def _start(self, stream: DataFrame, run, checkpoint: str, available_now: bool) -> StreamingQuery:
        prepare(self.spark)
        writer = stream.writeStream.foreachBatch(lambda df, batch_id: run(df, batch_id)).option("checkpointLocation", checkpoint)
        return (writer.trigger(availableNow=True) if available_now else writer).start()


def run_summary(p: Pipeline) -> DataFrame:
    """Counters of the deployment so far, from what each batch observed while it wrote."""
    counted = tables.read_or_empty(p.spark, p.path("batch_metrics"), StructType.fromDDL(METRICS_DDL))
    return counted.groupBy("metric").agg(F.sum("value").alias("value"))
