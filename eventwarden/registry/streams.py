"""Streaming operators run to the end over the whole event table (file source, all available data).

Operators with state read the events in time order, the files of three days per micro-batch, so every entry carries its state
over ten batches or more.
"""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from eventwarden.model import micros
from eventwarden.operators.sequence import rule_sequence
from eventwarden.operators.threshold import ThresholdSpec
from eventwarden.plans.desk import SLICE_SECONDS, desk
from eventwarden.plans.rulepack import Rule, Step, rules_of, stretched
from eventwarden.registry import sql as S
from eventwarden.registry.base import query
from eventwarden.registry.sql import with_ev
from eventwarden.session import work_folder
from eventwarden.sources.replay import sliced_stream
from eventwarden.streaming import operators as ops


def _stream(spark, sf_dir):
    """The stored events as a file stream."""
    d = desk(spark, sf_dir)
    schema = d.events.schema
    return spark.readStream.schema(schema).parquet(f"{d.folder}/events")


def _ordered(spark, sf_dir):
    """The events in time order, three days of slices per micro-batch."""
    d = desk(spark, sf_dir)
    return sliced_stream(spark, d.event_slices, d.events.schema, 3 * 86_400 // SLICE_SECONDS)


def _drain(stream):
    """Run a stream over everything available into a Parquet folder and read it back."""
    spark = stream.sparkSession
    folder = f"{work_folder(spark)}/stream-{uuid.uuid4().hex}"
    run = stream.writeStream.format("parquet").outputMode("append").option(
        "checkpointLocation", f"{folder}/checkpoint").trigger(availableNow=True).start(f"{folder}/out")
    run.awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{folder}/out")


def _end():
    """A "now" after the feed, so that no event counts as future."""
    return F.lit("2024-02-05").cast("timestamp")


@query("stream_match", with_ev("SELECT rule_id, event_id FROM mt", S.match_ctes()))
def stream_match(spark, sf_dir):
    return _drain(ops.match_stream(_stream(spark, sf_dir), rules_of("match"))).select("rule_id", "event_id")


@query("stream_ioc", with_ev("SELECT ioc_id, event_id, matched_field FROM im", S.INDICATORS))
def stream_ioc(spark, sf_dir):
    hits = ops.indicator_stream(_stream(spark, sf_dir), desk(spark, sf_dir).indicators, ["source_ip", "destination_ip", "file_hash"])
    return _drain(hits).select("ioc_id", "event_id", "matched_field")


@query("stream_dedup", with_ev("SELECT event_id, us FROM ev"))
def stream_dedup(spark, sf_dir):
    """Every event sent twice, kept once."""
    stream = _ordered(spark, sf_dir).select("event_id", "timestamp")
    twice = stream.withColumn("copy", F.explode(F.array(F.lit(1), F.lit(2)))).drop("copy")
    return _drain(ops.without_repeats(ops.admitted(twice, now=_end()))).select("event_id", micros().alias("us"))


@query("stream_tumbling", with_ev("""
SELECT us // 3600000000 * 3600000000 AS hour_us, status, count(*) AS n FROM ev GROUP BY 1, 2
HAVING hour_us + 3600000000 <= (SELECT max(us) FROM ev) - 3600000000"""))
def stream_tumbling(spark, sf_dir):
    """Hours closed by the watermark."""
    return _drain(ops.counts_by_hour(ops.admitted(_ordered(spark, sf_dir), now=_end())))


@query("stream_sliding", with_ev("""
SELECT us // 900000000 * 900000000 - i * 900000000 AS start_us, event_type, count(*) AS n FROM ev, range(4) t(i) GROUP BY 1, 2
HAVING start_us + 3600000000 <= (SELECT max(us) FROM ev) - 3600000000"""))
def stream_sliding(spark, sf_dir):
    return _drain(ops.sliding_counts(ops.admitted(_ordered(spark, sf_dir), now=_end())))


@query("stream_sessions", with_ev("""
SELECT "user", min(us) AS start_us, max(us) + 1800000000 AS end_us, count(*) AS n FROM (
  SELECT *, sum(opens) OVER (PARTITION BY "user" ORDER BY us, e ROWS UNBOUNDED PRECEDING) AS run FROM (
    SELECT "user", us, e, CASE WHEN us - lag(us) OVER (PARTITION BY "user" ORDER BY us, e) <= 1800000000 THEN 0 ELSE 1 END AS opens FROM ev WHERE "user" IS NOT NULL))
GROUP BY "user", run HAVING max(us) + 1800000000 <= (SELECT max(us) FROM ev) - 3600000000"""))
def stream_sessions(spark, sf_dir):
    """Activity runs per account, closed by half an hour of quiet."""
    return _drain(ops.activity_sessions(ops.admitted(_ordered(spark, sf_dir), now=_end())))


@query("stream_suppression", with_ev("""
SELECT DISTINCT rule_id, rule_id || ':' || substr(sha256(rule_id || '|' || array_to_string(list_transform(parts, lambda x: coalesce(x, 'None')), '|') || '|' || (us // 900000000)), 1, 24) AS dedup_key
FROM mt""", S.match_ctes()))
def stream_suppression(spark, sf_dir):
    """First detection of each dedup key."""
    return _drain(ops.suppressed_alerts(ops.admitted(_ordered(spark, sf_dir), now=_end()), rules_of("match"), 900)).select("rule_id", "dedup_key")


def _first_hits(hits):
    """First hit per rule and group, the parts of a group's key shown with a bar between them."""
    return hits.groupBy("rule_id", F.translate("g", "\u001f", "|").alias("g")).agg(F.min("hit_us").alias("hit_us"))


@query("stream_threshold", with_ev("SELECT rule_id, g, hit_us FROM th2", S.threshold_ctes(720), """
th2 AS (SELECT rule_id, g, min(hit_us) AS hit_us FROM th GROUP BY 1, 2)"""))
def stream_threshold(spark, sf_dir):
    """Stateful threshold rules: first hit of every group that fired."""
    ops.use_rocksdb(spark)
    specs = [ThresholdSpec(r, r.count, r.window_seconds, r.distinct_field, r.distinct_count) for r in rules_of("threshold", stretched(720))]
    hits = _drain(ops.threshold_stream(_ordered(spark, sf_dir), specs))
    return _first_hits(hits)


# A failed login, perhaps a privilege use, then a file event. Over a growing feed the privilege use counts as soon as it is
# there: what comes after it then has to follow it.
OPTIONAL_RULE = Rule(
    "OPTIONAL_STEP", "sequence", "Failed login, privilege use if any, file event", "low", 0.5, "demo", (), (),
    group_by=("user",), window_seconds=20 * 3600,
    steps=(Step("failed", {"event_type": "authentication", "status": "failure"}),
           Step("privilege", {"event_type": "privilege"}, max_gap_seconds=8 * 3600, optional=True),
           Step("file", {"event_type": "file"}, max_gap_seconds=10 * 3600)))

OPTIONAL_SQL = f"""
op AS (SELECT {S._key('[' + S._U + ']')} AS g, us, event_id, event_type, status FROM ev),
on_ AS (
  SELECT a.g, a.us AS a_us, b.us AS b_us, b.event_id AS b_id, c.us AS c_us, c.event_id AS c_id
  FROM op a
  LEFT JOIN LATERAL (SELECT x.us, x.event_id FROM op x WHERE x.g = a.g AND x.event_type = 'privilege'
                     AND (x.us, x.event_id) > (a.us, a.event_id) ORDER BY x.us, x.event_id LIMIT 1) b ON b.us - a.us <= 28800000000
  LEFT JOIN LATERAL (SELECT x.us, x.event_id FROM op x WHERE x.g = a.g AND x.event_type = 'file'
                     AND (x.us, x.event_id) > (a.us, a.event_id) ORDER BY x.us, x.event_id LIMIT 1) c ON TRUE
  WHERE a.event_type = 'authentication' AND a.status = 'failure'),
oc AS (
  SELECT o.g, CASE WHEN c_us - a_us <= 36000000000 AND (b_us IS NULL OR (c_us, c_id) < (b_us, b_id)) THEN c_us
                   WHEN d.us - b_us <= 36000000000 AND d.us - a_us <= 72000000000 THEN d.us END AS hit_us
  FROM on_ o
  LEFT JOIN LATERAL (SELECT x.us FROM op x WHERE x.g = o.g AND x.event_type = 'file' AND (x.us, x.event_id) > (o.b_us, o.b_id)
                     ORDER BY x.us, x.event_id LIMIT 1) d ON TRUE)
"""


@query("stream_sequence", with_ev("""
SELECT rule_id, g, max(us) AS hit_us FROM se GROUP BY 1, 2
UNION ALL SELECT rule_id, g, max(us) FROM le GROUP BY 1, 2
UNION ALL SELECT 'OPTIONAL_STEP', g, min(hit_us) FROM oc WHERE hit_us IS NOT NULL GROUP BY g
""", S.two_step_ctes(144), S.lateral_ctes(144), OPTIONAL_SQL))
def stream_sequence(spark, sf_dir):
    """Stateful ordered rules, with constraints and optional steps: first completion of every group that completed."""
    ops.use_rocksdb(spark)
    specs = [rule_sequence(r) for r in [*rules_of("sequence", stretched(144)), OPTIONAL_RULE]]
    hits = _drain(ops.sequence_stream(_ordered(spark, sf_dir), specs))
    return _first_hits(hits)
