"""Dashboards and entity profiles over the stored tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from eventwarden import catalogue
from eventwarden.model import ACTIVE_INCIDENT_STATUSES, OPEN_ALERT_STATUSES, SEVERITIES, micros
from eventwarden.operators.quantiles import order_statistics

HOUR_US = 3_600_000_000


def _grave() -> Column:
    return F.col("severity").isin("critical", "high")


def kpis(alerts: DataFrame, incidents: DataFrame, entities: DataFrame, hosts: DataFrame, users: DataFrame,
         events: DataFrame, now_us: int, window_hours: int = 24) -> DataFrame:
    """The counters of the dashboard, one row per metric."""
    active = F.col("status").isin(ACTIVE_INCIDENT_STATUSES)
    is_open = F.col("status").isin(OPEN_ALERT_STATUSES)
    since = F.timestamp_micros(F.lit(now_us - window_hours * HOUR_US))

    def metric(df: DataFrame, name: str) -> DataFrame:
        return df.agg(F.count("*").alias("value")).select(F.lit(name).alias("metric"), "value")

    in_incidents = entities.filter("kind = 'host'").join(incidents.filter(active).select("incident_id"), "incident_id", "left_semi").select(
        F.col("value").alias("host"))
    alerted = alerts.filter(is_open & _grave() & F.col("host").isNotNull()).select("host")
    parts = [
        metric(incidents.filter(active), "active_incidents"),
        metric(incidents.filter(active & (F.col("severity") == "critical")), "critical_incidents"),
        metric(alerts.filter(is_open & _grave()), "critical_alerts"),
        metric(alerts.filter(is_open), "open_alerts"),
        metric(in_incidents.union(alerted).distinct(), "hosts_at_risk"),
        metric(hosts.filter("is_isolated"), "isolated_hosts"),
        metric(users.filter("is_disabled"), "disabled_accounts"),
        metric(events.filter(F.col("ingested_at") >= since), "events_in_window"),
    ]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def mttd(incidents: DataFrame) -> DataFrame:
    """Median seconds from an incident's first event to its first alert."""
    waits = incidents.select(F.greatest(F.lit(0), F.col("first_alert_us") - F.col("first_us")).alias("wait"), F.lit(1).alias("k"))
    return order_statistics(waits, ["k"], "wait", 60_000_000).select(
        F.round(F.col("median") / 1e6, 2).alias("seconds"), F.col("count").alias("sample_size"))


def response_times(incidents: DataFrame, actions: DataFrame) -> DataFrame:
    """Per incident, whole seconds from its first alert to its first containment action."""
    first = actions.groupBy("incident_id").agg(F.min("created_us").alias("acted_us"))
    return incidents.join(first, "incident_id").select(
        "incident_id", F.greatest(F.lit(0), F.expr("(acted_us - first_alert_us) div 1000000")).alias("mttr_seconds"))


def mttr(incidents: DataFrame, actions: DataFrame) -> DataFrame:
    times = response_times(incidents, actions).withColumn("k", F.lit(1))
    return order_statistics(times, ["k"], "mttr_seconds", 60).select(
        F.round("median", 2).alias("seconds"), F.col("count").alias("sample_size"))


def severity_distribution(alerts: DataFrame, since_us: int) -> DataFrame:
    """Alerts per severity, zero where none."""
    spine = F.broadcast(alerts.sparkSession.createDataFrame([(s,) for s in SEVERITIES], "severity string"))
    counts = alerts.filter(F.col("detected_us") >= since_us).groupBy("severity").agg(F.count("*").alias("n"))
    return spine.join(counts, "severity", "left").select("severity", F.coalesce("n", F.lit(0)).alias("count"))


def alert_trend(alerts: DataFrame, now_us: int, hours: int = 24, buckets: int = 24) -> DataFrame:
    """Alerts by severity over equal time buckets up to now, empty buckets included."""
    since, width = now_us - hours * HOUR_US, hours * HOUR_US // buckets
    placed = alerts.filter((F.col("detected_us") >= since) & (F.col("detected_us") < since + width * buckets)).withColumn(
        "bucket", F.expr(f"(detected_us - {since}) div {width}"))
    counts = placed.groupBy("bucket").agg(
        F.count("*").alias("total"), *[F.count_if(F.col("severity") == s).alias(s) for s in ("critical", "high", "medium")],
        F.count_if(F.col("severity").isin("low", "info")).alias("low"))
    spine = alerts.sparkSession.range(buckets).select(F.col("id").alias("bucket"))
    return spine.join(counts, "bucket", "left").select(
        (F.lit(since) + F.col("bucket") * width).alias("bucket_us"),
        *[F.coalesce(c, F.lit(0)).alias(c) for c in ("total", "critical", "high", "medium", "low")])


def technique_distribution(alerts: DataFrame, limit: int = 12) -> DataFrame:
    """Most alerted techniques with their first tactic in kill-chain order."""
    counts = alerts.select(F.explode("technique_ids").alias("technique_id")).groupBy("technique_id").agg(F.count("*").alias("alert_count"))
    top = counts.orderBy(F.desc("alert_count"), "technique_id").limit(limit)
    return top.join(F.broadcast(catalogue.primary_tactics(alerts.sparkSession)), "technique_id", "left").select(
        "technique_id", "name", "tactic_id", "tactic", "alert_count")


# Half-open risk bands.
RISK_BANDS = [("0-25 (low)", 0.0, 26.0), ("26-50 (medium)", 26.0, 51.0), ("51-75 (high)", 51.0, 76.0), ("76-100 (critical)", 76.0, None)]


def risk_distribution(incidents: DataFrame) -> DataFrame:
    """Incidents per risk band; the bands tile the scale, so no row is lost."""
    cases = [F.count_if((F.col("risk_score") >= low) & (F.lit(True) if high is None else F.col("risk_score") < high)) for _, low, high in RISK_BANDS]
    rows = F.array(*[F.struct(F.lit(name).alias("band"), case.alias("count")) for (name, _, _), case in zip(RISK_BANDS, cases)])
    return incidents.agg(rows.alias("r")).select(F.explode("r").alias("x")).select("x.*")


def top_entities(alerts: DataFrame, limit: int = 8) -> DataFrame:
    """Most alerted hosts, accounts and source addresses."""
    parts = []
    for kind in ("host", "user", "source_ip"):
        counts = alerts.filter(F.col(f"`{kind}`").isNotNull()).groupBy(F.col(f"`{kind}`").alias("value")).agg(F.count("*").alias("alert_count"))
        parts.append(counts.orderBy(F.desc("alert_count"), "value").limit(limit).select(F.lit(kind).alias("kind"), "value", "alert_count"))
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


def top_per_key(df: DataFrame, key: str, values: list[str], k: int, count: str = "n") -> DataFrame:
    """The k most frequent value combinations per key.

    Rows are counted first; only the ranked counts are kept, cut to k before they are shuffled.
    """
    counts = df.groupBy(key, *values).agg(F.count("*").alias(count))
    rank = Window.partitionBy(key).orderBy(F.desc(count), *values)
    return counts.withColumn("rank", F.row_number().over(rank)).filter(F.col("rank") <= k)


def host_profile(events: DataFrame, alerts: DataFrame) -> DataFrame:
    """Event count and alerts by severity for every host."""
    seen = events.filter(F.col("host").isNotNull()).groupBy("host").agg(F.count("*").alias("event_count"))
    counts = alerts.filter(F.col("host").isNotNull()).groupBy("host").pivot("severity", SEVERITIES).agg(F.count("alert_id"))
    return seen.join(counts, "host", "left").fillna(0, SEVERITIES)


def host_top(events: DataFrame) -> DataFrame:
    """Per host: 20 most active accounts, 15 processes and 15 network peers."""
    on_host = events.filter(F.col("host").isNotNull())
    users = top_per_key(on_host.filter(F.col("user").isNotNull()), "host", ["user"], 20).select(
        "host", F.lit("user").alias("kind"), F.col("user").alias("value"), "n", "rank")
    processes = top_per_key(on_host.filter(F.col("process").isNotNull()), "host", ["process"], 15).select(
        "host", F.lit("process").alias("kind"), F.col("process").alias("value"), "n", "rank")
    peers = top_per_key(on_host.filter(F.col("destination_ip").isNotNull()), "host", ["destination_ip", "destination_port"], 15).select(
        "host", F.lit("peer").alias("kind"),
        F.concat_ws(":", "destination_ip", F.col("destination_port").cast("string")).alias("value"), "n", "rank")
    return users.unionByName(processes).unionByName(peers)


def user_auth_summary(events: DataFrame) -> DataFrame:
    """Successful, failed and total logins of every account."""
    logins = events.filter((F.col("event_type") == "authentication") & F.col("user").isNotNull())
    return logins.groupBy("user").agg(
        F.count_if(F.col("status") == "success").alias("success"), F.count_if(F.col("status") == "failure").alias("failure"),
        F.count("*").alias("total"))


def user_top(events: DataFrame) -> DataFrame:
    """Per account: 20 most used source addresses and hosts."""
    of_user = events.filter(F.col("user").isNotNull())
    ips = top_per_key(of_user.filter(F.col("source_ip").isNotNull()), "user", ["source_ip"], 20).select(
        "user", F.lit("source_ip").alias("kind"), F.col("source_ip").alias("value"), "n", "rank")
    hosts = top_per_key(of_user.filter(F.col("host").isNotNull()), "user", ["host"], 20).select(
        "user", F.lit("host").alias("kind"), F.col("host").alias("value"), "n", "rank")
    return ips.unionByName(hosts)


def entity_context(events: DataFrame, alerts: DataFrame, keys: DataFrame, kind: str) -> DataFrame:
    """Events, alerts and incidents touching every entity of one kind (host, user or ip)."""
    if kind == "ip":
        own = events.select("event_id", F.explode(F.array_distinct(F.array_compact(F.array("source_ip", "destination_ip")))).alias("value"))
        alert_value = F.col("source_ip")
    else:
        own = events.select("event_id", F.col(f"`{kind}`").alias("value"))
        alert_value = F.col(f"`{kind}`")
    counts = own.filter(F.col("value").isNotNull()).groupBy("value").agg(F.count("*").alias("events"))
    alerted = alerts.select(alert_value.alias("value")).filter(F.col("value").isNotNull()).groupBy("value").agg(F.count("*").alias("alerts"))
    cases = keys.filter(F.col("entity").startswith(f"{kind}:")).select(
        F.expr(f"substring(entity, {len(kind) + 2})").alias("value"), "incident_id").groupBy("value").agg(
        F.count_distinct("incident_id").alias("incidents"))
    return counts.join(alerted, "value", "left").join(cases, "value", "left").select(
        "value", "events", F.coalesce("alerts", F.lit(0)).alias("alerts"), F.coalesce("incidents", F.lit(0)).alias("incidents"))


def tumbling_hours(events: DataFrame) -> DataFrame:
    """Events per hour, the batches of a causal replay."""
    return events.groupBy(F.expr(f"unix_micros(timestamp) div {HOUR_US}").alias("hour")).agg(
        F.count("*").alias("events"), F.min(micros()).alias("first_us"), F.max(micros()).alias("last_us"))
