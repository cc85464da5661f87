"""Response planning and incident similarity."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from eventwarden.functions import net
from eventwarden.operators.scoring import SIMILARITY_WEIGHTS

# Rules and techniques that call for each playbook.
PLAYBOOKS = [
    ("PB-BRUTE-FORCE", ["BRUTE_FORCE_001", "BRUTE_FORCE_002", "BRUTE_FORCE_003"], ["T1110", "T1110.001", "T1110.003", "T1078"]),
    ("PB-PRIVESC",
     ["PRIVESC_SUID_ENUM_001", "PRIVESC_SUDO_CHAIN_001", "PRIVESC_GROUP_CHANGE_001", "PRIVESC_WINDOWS_SPECIAL_PRIV_001"],
     ["T1548", "T1548.001", "T1548.003", "T1068", "T1134", "T1098"]),
    ("PB-PERSISTENCE",
     ["PERSISTENCE_SCHEDULED_TASK_001", "PERSISTENCE_BACKDOOR_ACCOUNT_001", "PERSISTENCE_SERVICE_INSTALL_001"],
     ["T1053", "T1053.003", "T1543", "T1543.002", "T1136", "T1136.001", "T1098.004"]),
    ("PB-LATERAL",
     ["LATERAL_MOVEMENT_001", "LATERAL_BREADTH_001", "LATERAL_TOOL_TRANSFER_001"], ["T1021", "T1021.004", "T1570", "T1105", "T1078"]),
    ("PB-CLOUD-IAM",
     ["CLOUD_IAM_PRIVESC_001", "CLOUD_IAM_KEY_CHAIN_001", "CLOUD_LOG_TAMPERING_001", "CLOUD_DISCOVERY_001", "CLOUD_IAM_ANOMALY_001"],
     ["T1078.004", "T1098", "T1098.001", "T1098.003", "T1562", "T1562.008", "T1526"]),
]
PRIORITIES = {"high": 0, "medium": 1, "low": 2}


def rank_playbooks(incidents: DataFrame) -> DataFrame:
    """Playbooks per incident: three points per matching rule, one per matching technique."""
    listed = lambda values: F.array(*[F.lit(v) for v in values])
    scored = F.array(*[
        F.struct(F.lit(i).alias("place"), F.lit(name).alias("playbook_id"), (
            3 * F.size(F.array_intersect("rule_ids", listed(rules))) + F.size(F.array_intersect("technique_ids", listed(techniques)))
        ).alias("score")) for i, (name, rules, techniques) in enumerate(PLAYBOOKS)
    ])
    rows = incidents.select("incident_id", F.explode(scored).alias("p")).select("incident_id", "p.*").filter("score > 0")
    order = Window.partitionBy("incident_id").orderBy(F.desc("score"), "place")  # five playbooks
    return rows.withColumn("rank", F.row_number().over(order)).drop("place")


def recommended_actions(incidents: DataFrame, entities: DataFrame, hosts: DataFrame, users: DataFrame, taken: DataFrame) -> DataFrame:
    """Containment proposals per incident, each naming a target from its evidence, minus what was done."""
    own = lambda kind: entities.filter(F.col("kind") == kind).select("incident_id", F.col("value").alias("target"), "role")
    isolate = own("host").join(hosts.filter("NOT is_isolated").select(F.col("host_id").alias("target"), "criticality"), "target").select(
        "incident_id", F.lit("isolate_host").alias("action_type"), "target",
        F.when(F.col("criticality") >= 4, "high").otherwise("medium").alias("priority"))
    disable = own("user").filter("role = 'affected'").join(
        users.filter("NOT is_disabled").select(F.col("user_id").alias("target"), "is_privileged"), "target").select(
        "incident_id", F.lit("disable_account").alias("action_type"), "target",
        F.when(F.col("is_privileged"), "high").otherwise("medium").alias("priority"))
    block = own("source_ip").filter(net.is_external(F.col("target"))).select(
        "incident_id", F.lit("block_ioc").alias("action_type"), "target", F.lit("medium").alias("priority"))
    preserve = incidents.select(
        "incident_id", F.lit("collect_evidence").alias("action_type"), F.col("incident_id").alias("target"), F.lit("high").alias("priority"))
    every = isolate.unionByName(disable).unionByName(block).unionByName(preserve)
    open_ = every.join(taken.select("incident_id", "action_type", "target").distinct(), ["incident_id", "action_type", "target"], "left_anti")
    best = rank_playbooks(incidents).filter("rank = 1").select("incident_id", "playbook_id")
    return open_.join(best, "incident_id", "left")


def similar_incidents(incidents: DataFrame, keys: DataFrame, base_ids: list[str], limit: int = 5) -> DataFrame:
    """Incidents most alike the given ones: weighted overlap of techniques, rules, entities and severity.

    The request names a few incidents; every other incident is scored against each of them once, so work
    grows with the table and never with pairs inside a shared feature.
    """
    base = incidents.filter(F.col("incident_id").isin(base_ids)).select(
        F.col("incident_id").alias("base_id"), F.col("technique_ids").alias("b_techniques"), F.col("rule_ids").alias("b_rules"),
        F.col("severity").alias("b_severity"), F.coalesce("entity_count", F.lit(0)).alias("b_entities"))
    pairs = incidents.select(
        "incident_id", "technique_ids", "rule_ids", "severity", F.coalesce("entity_count", F.lit(0)).alias("entity_count")
    ).crossJoin(F.broadcast(base)).filter("incident_id <> base_id")  # the named incidents that exist: none, or a few rows
    wanted = keys.filter(F.col("incident_id").isin(base_ids)).select(F.col("incident_id").alias("base_id"), "entity")
    shared = keys.select("incident_id", "entity").join(wanted, "entity").groupBy("base_id", "incident_id").agg(F.count("*").alias("shared"))
    joined = pairs.join(shared, ["base_id", "incident_id"], "left").withColumn("shared", F.coalesce("shared", F.lit(0)))

    def overlap(a: str, b: str):
        union = F.size(F.array_union(a, b))
        return F.when(union > 0, F.size(F.array_intersect(a, b)) / union).otherwise(F.lit(0.0))

    union = F.col("entity_count") + F.col("b_entities") - F.col("shared")
    scored = joined.withColumn("techniques", overlap("technique_ids", "b_techniques")).withColumn("rules", overlap("rule_ids", "b_rules")).withColumn(
        "entities", F.when(union > 0, F.col("shared") / union).otherwise(F.lit(0.0))).withColumn(
        "severity_match", (F.col("severity") == F.col("b_severity")).cast("double"))
    w = SIMILARITY_WEIGHTS
    total = w["techniques"] * F.col("techniques") + w["rules"] * F.col("rules") + w["entities"] * F.col("entities") + w["severity"] * F.col("severity_match")
    kept = scored.withColumn("similarity", F.round(F.round(total, 9), 3)).filter(total > 0)
    order = Window.partitionBy("base_id").orderBy(F.desc("similarity"), "incident_id")
    return kept.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= limit).select(
        "base_id", "incident_id", "similarity", F.round("techniques", 3).alias("techniques"), F.round("rules", 3).alias("rules"),
        F.round("entities", 3).alias("entities"), "severity_match", "rank")
