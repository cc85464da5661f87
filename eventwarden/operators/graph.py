"""Attack graph of every incident as node and edge tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from eventwarden import catalogue
from eventwarden.model import severity_from_rank, severity_rank

MAX_NODES = 220
MAX_EDGES = 500
MAX_EDGE_EVENTS = 12


def _id(kind: str, value: Column) -> Column:
    return F.when(value.isNotNull() & (value != ""), F.concat(F.lit(f"{kind}:"), value))


def _parts() -> dict[str, Column]:
    c = lambda n: F.col(f"`{n}`")
    kind = c("event_type")
    at = F.coalesce(c("host"), F.lit("unknown"))
    runs = kind.isin("process", "discovery")
    return {
        "host": _id("host", c("host")), "user": _id("user", c("user")), "ip": _id("ip", c("source_ip")),
        "cloud": _id("cloud_account", c("cloud_account")),
        "process": F.when(runs & c("process").isNotNull(), F.concat(F.lit("process:"), at, F.lit("::"), c("process"))),
        "destination": F.when(kind == "network", _id("ip", c("destination_ip"))),
        "file": F.when((kind == "file") & c("file_path").isNotNull(), F.concat(F.lit("file:"), at, F.lit("::"), c("file_path"))),
        "target": F.when((kind == "privilege") & c("user").isNotNull(), _id("user", c("target"))),
    }


def _edge(source: Column, target: Column, relation: Column | str, when: Column | None = None) -> Column:
    present = source.isNotNull() & target.isNotNull() & (source != target)
    if when is not None:
        present = present & when
    label = F.lit(relation) if isinstance(relation, str) else relation
    return F.when(present, F.struct(source.alias("source"), target.alias("target"), label.alias("relation")))


def event_nodes(events: DataFrame) -> DataFrame:
    """``(incident_id, id, severity_rank)``: one row per appearance of a node in an incident's events."""
    return events.select("incident_id", "severity_rank", F.explode(F.array_compact(F.array(*_parts().values()))).alias("id"))


def event_edges(events: DataFrame) -> DataFrame:
    """``(incident_id, source, target, relation, event_id, us)`` by the type of each event."""
    p = _parts()
    kind, ok = F.col("event_type"), F.col("status") == "success"
    login = kind == "authentication"
    actor = F.coalesce(p["user"], p["host"])
    edges = F.array_compact(F.array(
        _edge(p["user"], p["cloud"], "operated in"),
        _edge(p["user"], p["ip"], F.when(ok, "authenticated from").otherwise("attempted from"), login),
        _edge(p["user"], p["host"], F.when(ok, "logged in to").otherwise("failed login to"), login),
        _edge(p["user"], p["process"], "executed"), _edge(p["process"], p["host"], "ran on"),
        _edge(F.coalesce(p["host"], p["ip"]), p["destination"], "connected to"),
        _edge(actor, p["file"], "modified"), _edge(p["file"], p["host"], "persists on"),
        _edge(p["user"], p["host"], "escalated on", kind == "privilege"),
        _edge(p["user"], p["target"], "elevated to"),
        _edge(p["user"], p["host"], "account changed on", kind == "account"),
    ))
    return events.select("incident_id", "event_id", "us", F.explode(edges).alias("x")).select("incident_id", "event_id", "us", "x.*")


def _nodes_and_rows(events: DataFrame, alerts: DataFrame, alert_entities: DataFrame, ioc_matches: DataFrame) -> tuple[DataFrame, DataFrame]:
    """All nodes, and one row per edge and the event (or alert) that shows it."""
    spark = events.sparkSession
    seen = event_nodes(events)
    rank = severity_rank(F.col("severity"))
    alert_nodes = alerts.select("incident_id", rank.alias("severity_rank"), F.concat(F.lit("alert:"), "alert_id").alias("id"))
    tagged = alerts.select("incident_id", "alert_id", rank.alias("severity_rank"), F.explode("technique_ids").alias("technique_id"))
    technique_nodes = tagged.select("incident_id", "severity_rank", F.concat(F.lit("technique:"), "technique_id").alias("id"))
    own_iocs = events.select("incident_id", "event_id", "us", "host", "source_ip", "destination_ip").join(
        ioc_matches.select("event_id", "ioc_id", "ioc_severity"), "event_id")
    ioc_nodes = own_iocs.select("incident_id", severity_rank(F.col("ioc_severity")).alias("severity_rank"), F.concat(F.lit("ioc:"), "ioc_id").alias("id"))
    every = seen.unionByName(alert_nodes).unionByName(technique_nodes).unionByName(ioc_nodes)
    kind = F.substring_index("id", ":", 1)
    value = F.expr("substring(id, locate(':', id) + 1)")
    names = F.broadcast(catalogue.techniques(spark).select(F.concat(F.lit("technique:"), "technique_id").alias("id"), F.col("name")))
    nodes = every.groupBy("incident_id", "id").agg(F.count("*").alias("event_count"), F.max("severity_rank").alias("_rank")).select(
        "incident_id", "id", kind.alias("kind"), value.alias("value"), severity_from_rank(F.col("_rank")).alias("severity"), "event_count")
    nodes = nodes.join(names, "id", "left").withColumn("label", F.concat_ws(" ", "value", "name")).drop("name")

    exists = nodes.select("incident_id", F.col("id").alias("target"))
    prefix = F.substring_index("entity", ":", 1)
    entity = F.when(prefix == "cloud", F.concat(F.lit("cloud_account"), F.expr("substring(entity, 6)"))).otherwise(F.col("entity"))
    none = [F.lit(None).cast("string").alias("event_id"), F.lit(None).cast("bigint").alias("us")]
    detected = alert_entities.join(alerts.select("alert_id", "incident_id"), "alert_id").select(
        "incident_id", *none, F.concat(F.lit("alert:"), "alert_id").alias("source"), entity.alias("target"), F.lit("detected on").alias("relation")
    ).join(exists, ["incident_id", "target"], "left_semi")
    maps = tagged.select("incident_id", *none, F.concat(F.lit("alert:"), "alert_id").alias("source"),
                         F.concat(F.lit("technique:"), "technique_id").alias("target"), F.lit("maps to").alias("relation"))
    matched = own_iocs.select(
        "incident_id", "event_id", "us", F.concat(F.lit("ioc:"), "ioc_id").alias("source"),
        F.explode(F.array_compact(F.array(_id("ip", F.col("source_ip")), _id("ip", F.col("destination_ip")), _id("host", F.col("host"))))).alias("target"),
        F.lit("matches").alias("relation"),
    ).join(exists, ["incident_id", "target"], "left_semi")
    rows = event_edges(events).unionByName(detected).unionByName(maps).unionByName(matched)
    return nodes, rows


EDGE = ["incident_id", "source", "target", "relation"]


def _evidence(rows: DataFrame) -> DataFrame:
    return rows.filter("event_id IS NOT NULL").select(*EDGE, "event_id", "us").distinct()


def edge_evidence(events: DataFrame, alerts: DataFrame, alert_entities: DataFrame, ioc_matches: DataFrame) -> DataFrame:
    """``(edge, event_id, us)``: every event behind every edge."""
    return _evidence(_nodes_and_rows(events, alerts, alert_entities, ioc_matches)[1])


def incident_graph(events: DataFrame, alerts: DataFrame, alert_entities: DataFrame, ioc_matches: DataFrame,
                   preview: int = MAX_EDGE_EVENTS) -> tuple[DataFrame, DataFrame]:
    """All nodes and edges of every incident, unpruned; an edge shows its ``preview`` first events."""
    nodes, rows = _nodes_and_rows(events, alerts, alert_entities, ioc_matches)
    counts = rows.groupBy(*EDGE).agg(F.count("*").alias("count"))
    order = Window.partitionBy(*EDGE).orderBy("us", "event_id")
    ids = _evidence(rows).withColumn("_rank", F.row_number().over(order)).filter(F.col("_rank") <= preview).groupBy(*EDGE).agg(
        F.transform(F.array_sort(F.collect_list(F.struct("_rank", "event_id"))), lambda x: x["event_id"]).alias("event_ids"))
    return nodes, counts.join(ids, EDGE, "left")


def prune(nodes: DataFrame, edges: DataFrame, max_nodes: int = MAX_NODES, max_edges: int = MAX_EDGES) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The picture of each incident: its busiest nodes, the busiest edges between them, and the totals."""
    node_rank = Window.partitionBy("incident_id").orderBy(F.desc("event_count"), "id")
    kept = nodes.withColumn("rank", F.row_number().over(node_rank)).filter(F.col("rank") <= max_nodes)
    ends = kept.select("incident_id", "id")
    inside = edges.join(ends.withColumnRenamed("id", "source"), ["incident_id", "source"], "left_semi").join(
        ends.withColumnRenamed("id", "target"), ["incident_id", "target"], "left_semi")
    edge_rank = Window.partitionBy("incident_id").orderBy(F.desc("count"), "source", "target", "relation")
    shown = inside.withColumn("rank", F.row_number().over(edge_rank)).filter(F.col("rank") <= max_edges)
    totals = nodes.groupBy("incident_id").agg(F.count("*").alias("total_nodes")).join(
        edges.groupBy("incident_id").agg(F.count("*").alias("total_edges")), "incident_id", "left").join(
        kept.groupBy("incident_id").agg(F.count("*").alias("shown_nodes")), "incident_id").join(
        shown.groupBy("incident_id").agg(F.count("*").alias("shown_edges")), "incident_id", "left").fillna(
        0, ["total_edges", "shown_edges"]).withColumn(
        "truncated", (F.col("total_nodes") > F.col("shown_nodes")) | (F.col("total_edges") > F.col("shown_edges")))
    return kept, shown, totals
