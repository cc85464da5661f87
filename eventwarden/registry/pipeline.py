"""What the micro-batch pipeline holds after several batches, and parts of it that only run inside a batch."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from eventwarden.model import micros
from eventwarden.operators.sequence import rule_sequence, sequence_evidence
from eventwarden.plans import detect
from eventwarden.plans.desk import STRETCH, desk
from eventwarden.plans.rulepack import rules_of, stretched
from eventwarden.registry import sql as S
from eventwarden.registry.base import query
from eventwarden.registry.sql import with_ev
from eventwarden.registry.streams import OPTIONAL_RULE, OPTIONAL_SQL
from eventwarden.session import work_folder
from eventwarden.sinks import tables
from eventwarden.sources.normalize import ingest
from eventwarden.sources.normalize.common import bounded_raw
from eventwarden.sources.raw import raw_records, read_canonical, read_raw_stream
from eventwarden.streaming.pipeline import Pipeline, run_summary

_END = "2024-02-05"
_RUNS: dict[tuple[str, str], Pipeline] = {}


def _replayed(spark, sf_dir) -> Pipeline:
    """The single-event rules over the whole feed, slice after slice of eight days; run once per application."""
    key = (spark.sparkContext.applicationId, sf_dir)
    if key not in _RUNS:
        d = desk(spark, sf_dir)
        p = Pipeline(spark, f"{d.folder}/pipeline", rules_of("match"), now=F.lit(_END).cast("timestamp"))
        p.replay(d.events, 8 * 86_400)
        _RUNS[key] = p
    return _RUNS[key]


_KEYED = """
keyed AS (
  SELECT mt.rule_id, us, event_id, mt.rule_id || ':' || substr(sha256(mt.rule_id || '|' || array_to_string(
           list_transform(parts, lambda x: coalesce(x, 'None')), '|') || '|' || (us // (CAST(dedup AS BIGINT) * 1000000))), 1, 24) AS dedup_key
  FROM mt JOIN rl USING (rule_id))"""


@query("pipeline_alerts", with_ev("""
SELECT rule_id, dedup_key, max(us) AS last_us, count(DISTINCT event_id) AS events FROM keyed GROUP BY 1, 2""",
       S.match_ctes(), S.rule_ctes(), _KEYED))
def pipeline_alerts(spark, sf_dir):
    """Alerts and their evidence after all batches: repeats across batches are merged."""
    t = _replayed(spark, sf_dir).tables()
    events = t["alert_evidence"].groupBy("alert_id").agg(F.count_distinct("event_id").alias("events"))
    return t["alerts"].join(events, "alert_id").select("rule_id", "dedup_key", "last_us", "events")


@query("pipeline_incidents", with_ev("SELECT dedup_key, 1::BIGINT AS incidents FROM keyed GROUP BY 1", S.match_ctes(), S.rule_ctes(), _KEYED))
def pipeline_incidents(spark, sf_dir):
    """Every alert lies in one incident, merges between batches included."""
    t = _replayed(spark, sf_dir).tables()
    return t["alerts"].join(t["membership"], "alert_id").groupBy("dedup_key").agg(F.count_distinct("incident_id").alias("incidents"))


@query("pipeline_hosts", with_ev("SELECT host AS host_id, min(us) AS first_us, max(us) AS last_us FROM ev WHERE host IS NOT NULL GROUP BY 1"))
def pipeline_hosts(spark, sf_dir):
    """The inventory that the batches' deltas add up to."""
    return _replayed(spark, sf_dir).tables()["hosts"].select("host_id", micros("first_seen").alias("first_us"), micros("last_seen").alias("last_us"))


@query("pipeline_baseline", with_ev("""
SELECT u_ref AS entity_ref, feature, v AS value, count(*) AS n, sum(count(*)) OVER (PARTITION BY u_ref, feature)::BIGINT AS observation_count
FROM ob GROUP BY u_ref, feature, v""", S.HISTORY))
def pipeline_baseline(spark, sf_dir):
    """The baseline learnt batch by batch."""
    return _replayed(spark, sf_dir).tables()["baseline"]


@query("pipeline_summary", with_ev("""
SELECT 'events_ingested' AS metric, count(*) AS value FROM ev UNION ALL SELECT 'alerts', count(DISTINCT dedup_key) FROM keyed""",
       S.match_ctes(), S.rule_ctes(), _KEYED))
def pipeline_summary(spark, sf_dir):
    """Counters observed while the batches were written."""
    return run_summary(_replayed(spark, sf_dir)).filter(F.col("metric").isin("events_ingested", "alerts"))


@query("pipeline_late", with_ev("""
SELECT l.event_id, 'late' AS reason FROM part l
WHERE l.us < (SELECT max(o.us) FROM part o WHERE o.b < l.b) - 864000000000""",
       "part AS (SELECT event_id, us, us // 1000000 % 3 AS b FROM ev)"))
def pipeline_late(spark, sf_dir):
    """Three batches over the same days: events over ten days behind what earlier batches held are refused."""
    d = desk(spark, sf_dir)
    p = Pipeline(spark, f"{d.folder}/late-{uuid.uuid4().hex}", rules_of("match")[:1], now=F.lit(_END).cast("timestamp"), lateness_seconds=864_000)
    for batch in range(3):
        p.run_events(d.events.filter(F.expr(f"unix_micros(timestamp) div 1000000 % 3 = {batch}")), batch)
    return spark.read.schema("event_id string, source string, reason string, raw string, batch_id int").parquet(p.path("late")).select(
        "event_id", "reason")


@query("detections_new_only", with_ev("""
SELECT rule_id, g, count(*) AS events FROM te WHERE (rule_id, g) IN (SELECT (rule_id, g) FROM te WHERE us >= 1704412800000000) GROUP BY 1, 2""",
       S.threshold_ctes(STRETCH)))
def detections_new_only(spark, sf_dir):
    """Detections of the threshold rules that hold an event of the newest days; older ones were found before."""
    events = desk(spark, sf_dir).events
    found = detect.threshold_rows(events, rules_of("threshold", stretched(STRETCH)))
    fresh = detect.fresh_only(found, events.filter(micros() >= 1704412800000000))
    group = F.translate(F.expr("substring(detection_id, length(rule_id) + 2)"), "\u001f", "|").alias("g")
    return fresh.groupBy("rule_id", group).agg(F.count("*").alias("events"))


@query("sequence_optional", with_ev("""
SELECT g, arg_min(a_us, (a_us, a_id)) AS first_us, arg_min(hit_us, (a_us, a_id)) AS hit_us FROM (
  SELECT a.g, a.us AS a_us, a.event_id AS a_id, c.us AS hit_us
  FROM op a
  LEFT JOIN LATERAL (SELECT x.us, x.event_id FROM op x WHERE x.g = a.g AND x.event_type = 'privilege'
                     AND (x.us, x.event_id) > (a.us, a.event_id) ORDER BY x.us, x.event_id LIMIT 1) b ON b.us - a.us <= 28800000000,
  LATERAL (SELECT x.us FROM op x WHERE x.g = a.g AND x.event_type = 'file'
           AND (x.us, x.event_id) > (coalesce(b.us, a.us), coalesce(b.event_id, a.event_id)) ORDER BY x.us, x.event_id LIMIT 1) c
  WHERE a.event_type = 'authentication' AND a.status = 'failure'
    AND c.us - coalesce(b.us, a.us) <= 36000000000 AND c.us - a.us <= 72000000000)
GROUP BY g""", OPTIONAL_SQL))
def sequence_optional(spark, sf_dir):
    """A rule with an optional step over the whole feed at once: the step is taken wherever it is there."""
    rows = sequence_evidence(desk(spark, sf_dir).events, [rule_sequence(OPTIONAL_RULE)])
    return rows.groupBy(F.translate("g", "\u001f", "|").alias("g")).agg(F.min("us").alias("first_us"), F.max("us").alias("hit_us"))


@query("raw_bounds", """
SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN CASE WHEN (doc_id * 7919) % 100000 + 8 > 65536 THEN 'raw record exceeds 65536 bytes' END
                    WHEN doc_id % 3 = 1 THEN CASE WHEN doc_id % 14 = 0 THEN 'record is not a JSON object' WHEN doc_id % 14 > 9 THEN 'raw record is nested too deeply' END
                    ELSE 'record is not a JSON object' END AS raw_reason FROM documents""")
def raw_bounds(spark, sf_dir):
    """Records of many sizes and depths, and what refuses them."""
    key = F.col("doc_id")
    wide = F.concat(F.lit('{"a":"'), F.expr("repeat('x', cast((doc_id * 7919) % 100000 as int))"), F.lit('"}'))
    deep = F.concat(F.expr("repeat('{\"a\":', cast(doc_id % 14 as int))"), F.lit("1"), F.expr("repeat('}', cast(doc_id % 14 as int))"))
    record = F.when(key % 3 == 0, wide).when(key % 3 == 1, deep).otherwise(F.concat(F.lit("not json "), key.cast("string")))
    rows = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", record.alias("record"))
    return bounded_raw(rows).select("doc_id", "raw_reason")


_DISPATCH = """
  SELECT 'linux_auth' AS source, FALSE AS bad FROM ev WHERE event_type IN ('authentication', 'privilege', 'account')
  UNION ALL SELECT 'windows_security', e % 41 = 0 FROM ev WHERE event_type IN ('authentication', 'privilege', 'account') OR (event_type = 'service' AND (e % 2 = 0 OR e % 41 = 0))
  UNION ALL SELECT CASE WHEN e % 10 = 0 THEN 'linux_auditd' ELSE 'edr_process' END, FALSE FROM ev WHERE event_type = 'discovery'
  UNION ALL SELECT 'network_flow', e % 47 = 0 OR e % 45 = 0 FROM ev WHERE event_type = 'network'
  UNION ALL SELECT 'file_integrity', FALSE FROM ev WHERE event_type = 'file' UNION ALL SELECT 'cloud_audit', FALSE FROM ev WHERE event_type = 'cloud_audit'"""


@query("ingest_split", with_ev(f"SELECT source, count(*) FILTER (NOT bad) AS kept, count(*) FILTER (bad) AS refused FROM ({_DISPATCH}) GROUP BY 1"))
def ingest_split(spark, sf_dir):
    """Good events and the quarantine of one ingest."""
    good, bad = ingest(raw_records(desk(spark, sf_dir).events), F.lit("2024-02-01").cast("timestamp"))
    counted = lambda df, name: df.groupBy("source").agg(F.count("*").alias(name))
    return counted(good, "kept").join(counted(bad, "refused"), "source", "full_outer").select(
        "source", F.coalesce("kept", F.lit(0)).alias("kept"), F.coalesce("refused", F.lit(0)).alias("refused"))


# the Windows job drops service events of unknown ids, which are among the raw records
_RAW = _DISPATCH.replace(" OR (event_type = 'service' AND (e % 2 = 0 OR e % 41 = 0))", " OR event_type = 'service'")


@query("raw_stream", with_ev(f"SELECT source, count(*) AS records FROM ({_RAW}) GROUP BY 1"))
def raw_stream(spark, sf_dir):
    """Raw records arriving as files, counted per source after the stream has run."""
    folder = f"{work_folder(spark)}/raw-stream-{uuid.uuid4().hex}"
    raw_records(desk(spark, sf_dir).events).repartition(6).write.json(f"{folder}/in")
    stream = read_raw_stream(spark, f"{folder}/in", 2).select("record_id", "source")
    run = stream.writeStream.format("parquet").option("checkpointLocation", f"{folder}/checkpoint").trigger(availableNow=True).start(f"{folder}/out")
    run.awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{folder}/out").groupBy("source").agg(F.count("*").alias("records"))


@query("canonical_read", with_ev("SELECT event_type, count(*) AS events, min(us) AS first_us, max(us) AS last_us FROM ev GROUP BY 1"))
def canonical_read(spark, sf_dir):
    """Stored canonical events read back under the explicit schema."""
    path = f"{work_folder(spark)}/canonical-{uuid.uuid4().hex}"
    tables.write_table(desk(spark, sf_dir).events, path)
    return read_canonical(spark, path).groupBy("event_type").agg(
        F.count("*").alias("events"), F.min(micros()).alias("first_us"), F.max(micros()).alias("last_us"))
