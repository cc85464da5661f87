"""Cloud identity analytics over audit events."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from eventwarden.functions import net
from eventwarden.model import SEVERITIES, micros, severity_band
from eventwarden.operators import scoring

# Categories that widen permissions or create credentials.
PRIVILEGE_CATEGORIES = ["privilege_grant", "credential_creation", "credential_modification", "trust_policy_change"]


def cloud_events(events: DataFrame, since_us: int | None = None, account: str | None = None) -> DataFrame:
    out = events.filter(F.col("cloud_account").isNotNull())
    if since_us is not None:
        out = out.filter(F.col("timestamp") >= F.timestamp_micros(F.lit(since_us)))
    return out.filter(F.col("cloud_account") == account) if account else out


def _category() -> Column:
    return F.col("metadata.iam_category")


def _counters() -> list[Column]:
    return [
        F.count_if(_category().isin(PRIVILEGE_CATEGORIES)).alias("privilege_operations"),
        F.count_if(_category() == "defense_evasion").alias("defense_evasion_operations"),
        F.min(micros()).alias("first_us"), F.max(micros()).alias("last_us"),
    ]


def account_summary(events: DataFrame, since_us: int | None = None) -> DataFrame:
    """One row per cloud account."""
    rows = cloud_events(events, since_us)
    return rows.groupBy("cloud_account").agg(
        F.coalesce(F.max("cloud_provider"), F.lit("aws")).alias("provider"), F.count("*").alias("event_count"),
        F.count_if(F.col("status") == "failure").alias("failed_count"), F.count_distinct("user").alias("identity_count"),
        # regions and services come from the provider's short lists
        F.array_join(F.array_sort(F.collect_set(F.coalesce("cloud_region", F.lit("unknown")))), ",").alias("regions"),
        F.array_join(F.array_sort(F.collect_set("cloud_service")), ",").alias("services"),
        *_counters(),
    )


def account_identities(events: DataFrame, since_us: int | None = None) -> DataFrame:
    """Distinct (account, identity) pairs; an account may hold any number."""
    return cloud_events(events, since_us).filter(F.col("user").isNotNull()).select("cloud_account", F.col("user").alias("identity")).distinct()


def identity_profiles(events: DataFrame, since_us: int | None = None) -> DataFrame:
    """One row per (identity, account) with its activity counters and risk."""
    rows = cloud_events(events, since_us).filter(F.col("user").isNotNull()).withColumn(
        "external_ip", F.when(net.is_external(F.col("source_ip")), F.col("source_ip")))
    policy = F.when(F.coalesce("metadata.high_risk_policy", F.lit(False)), F.col("metadata.policy"))
    keys = ["user", "cloud_account"]
    plain = rows.groupBy(*keys).agg(
        F.min_by("metadata.identity_type", F.struct("timestamp", "event_id")).alias("identity_type"), F.count("*").alias("api_calls"),
        F.count_if(F.col("status") == "failure").alias("denied_attempts"),
        F.count_if(~F.coalesce("metadata.mfa_authenticated", F.lit(True))).alias("no_mfa_calls"),
        F.array_join(F.array_sort(F.collect_set(policy)), ",").alias("high_risk_policies"), *_counters(),
    )
    item = lambda kind, c: F.struct(F.lit(kind).alias("kind"), F.col(c).alias("value"))
    distinct = rows.select(*keys, F.explode(F.array(
        item("api", "action"), item("ip", "source_ip"), item("external", "external_ip"), item("service", "cloud_service"),
    )).alias("x")).select(*keys, "x.kind", "x.value").filter("value IS NOT NULL").distinct()
    sizes = distinct.groupBy(*keys).agg(
        F.count_if(F.col("kind") == "api").alias("distinct_apis"), F.count_if(F.col("kind") == "ip").alias("source_ips"),
        F.count_if(F.col("kind") == "external").alias("external_ips"), F.count_if(F.col("kind") == "service").alias("services"))
    out = plain.join(sizes, keys, "left").fillna(0, ["distinct_apis", "source_ips", "external_ips", "services"])
    out = out.withColumn("factors", scoring.identity_terms(
        F.col("api_calls"), F.col("privilege_operations"), F.col("denied_attempts"), F.col("no_mfa_calls"),
        F.col("external_ips"), F.col("defense_evasion_operations")))
    out = out.withColumn("risk_score", scoring.sum_terms("factors", 1))
    return out.withColumn("risk_band", severity_band(F.col("risk_score"))).withColumnRenamed("user", "identity")


def risky_identities(events: DataFrame, alerts: DataFrame, since_us: int | None = None, limit: int = 25) -> DataFrame:
    """Identities ranked by risk, with their alerts by severity."""
    recent = alerts.filter(F.col("user").isNotNull())
    if since_us is not None:
        recent = recent.filter(F.col("detected_us") >= since_us)
    counts = recent.groupBy(F.col("user").alias("identity")).pivot("severity", SEVERITIES).agg(F.count("alert_id"))
    named = counts.select("identity", *[F.coalesce(s, F.lit(0)).alias(f"alerts_{s}") for s in SEVERITIES])
    top = identity_profiles(events, since_us).orderBy(F.desc("risk_score"), "identity", "cloud_account").limit(limit)
    return top.join(named, "identity", "left").fillna(0, [f"alerts_{s}" for s in SEVERITIES])


def iam_changes(events: DataFrame, since_us: int | None = None, limit: int = 100) -> DataFrame:
    """Permission-affecting calls, newest first."""
    rows = cloud_events(events, since_us).filter(_category().isNotNull() & (_category() != "authentication"))
    return rows.orderBy(F.desc("timestamp"), "event_id").limit(limit).select(
        "event_id", micros().alias("us"), F.col("user").alias("identity"), "cloud_account", F.col("action").alias("api_call"),
        F.col("cloud_service").alias("service"), F.col("cloud_region").alias("region"), F.col("cloud_resource").alias("resource"),
        _category().alias("category"), F.col("metadata.iam_risk").alias("risk"), F.col("metadata.policy").alias("policy"),
        F.coalesce("metadata.high_risk_policy", F.lit(False)).alias("high_risk_policy"),
        F.col("metadata.target_principal").alias("target_principal"), "source_ip",
        F.col("metadata.mfa_authenticated").alias("mfa_authenticated"), "status", F.col("metadata.error_code").alias("error_code"))


def overview(events: DataFrame, since_us: int | None = None) -> DataFrame:
    """Totals over the account summary."""
    return account_summary(events, since_us).agg(
        F.count("*").alias("account_count"), F.sum("identity_count").alias("identity_count"), F.sum("event_count").alias("event_count"),
        F.sum("privilege_operations").alias("privilege_operations"),
        F.sum("defense_evasion_operations").alias("defense_evasion_operations"))


def identity_graph(events: DataFrame, since_us: int | None = None) -> tuple[DataFrame, DataFrame]:
    """Nodes and edges (address, identity, call, resource, policy) of every identity."""
    rows = cloud_events(events, since_us).filter(F.col("user").isNotNull())
    label = lambda kind, c: F.concat(F.lit(f"{kind}:"), c)
    me = label("identity", F.col("user"))
    ip = label("ip", F.col("source_ip"))
    api = label("api_call", F.coalesce("action", F.lit("unknown")))
    resource = label("resource", F.col("cloud_resource"))
    policy = label("policy", F.col("metadata.policy"))
    nodes = F.array_compact(F.array(ip, api, resource, policy))
    edge = lambda s, t, r: F.when(s.isNotNull() & t.isNotNull(), F.struct(
        s.alias("source"), t.alias("target"), r.alias("relation")))
    edges = F.array_compact(F.array(
        edge(ip, me, F.lit("used by")), edge(me, api, F.when(F.col("status") == "failure", "denied").otherwise("called")),
        edge(api, resource, F.lit("targeted")), edge(api, policy, F.lit("applied"))))
    node_rows = rows.select(F.col("user").alias("identity"), F.explode(nodes).alias("id")).groupBy("identity", "id").agg(F.count("*").alias("count"))
    own = rows.select(F.col("user").alias("identity"), me.alias("id")).distinct().withColumn("count", F.lit(1).cast("bigint"))
    edge_rows = rows.select(F.col("user").alias("identity"), "event_id", micros().alias("us"), F.explode(edges).alias("x")).select(
        "identity", "event_id", "us", "x.*")
    keys = ["identity", "source", "target", "relation"]
    counts = edge_rows.groupBy(*keys).agg(F.count("*").alias("count"))
    order = Window.partitionBy(*keys).orderBy("us", "event_id")
    ids = edge_rows.withColumn("_rank", F.row_number().over(order)).filter(F.col("_rank") <= 10).groupBy(*keys).agg(
        F.transform(F.array_sort(F.collect_list(F.struct("_rank", "event_id"))), lambda x: x["event_id"]).alias("event_ids"))
    return node_rows.unionByName(own), counts.join(ids, keys)
