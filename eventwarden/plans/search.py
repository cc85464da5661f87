"""Global search: what a term is, and what it finds in each table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from eventwarden import catalogue
from eventwarden.functions import net

MAX_PER_CATEGORY = 10

# Shapes of the public ids.
ID_SHAPES = [
    ("incident_id", r"(?i)^INC-\d{4}-\d{4,}$"), ("alert_id", r"(?i)^ALT-[A-Z0-9]+$"), ("event_id", r"(?i)^EVT-[A-Z0-9]+$"),
    ("ioc_id", r"(?i)^IOC-[A-Z0-9]+$"), ("technique", r"(?i)^T\d{4}(\.\d{3})?$"),
]
HASH_SHAPE = r"(?i)^[a-f0-9]{32,128}$"


def classify_term(term: Column) -> Column:
    """incident_id, alert_id, event_id, ioc_id, technique, ip, hash, text or too_short."""
    text = F.trim(term)
    out = F.when(F.length(text) < 2, F.lit("too_short"))
    for name, shape in ID_SHAPES:
        out = out.when(text.rlike(shape), name)
    return out.when(net.is_valid(text), "ip").when(text.rlike(HASH_SHAPE), "hash").otherwise("text")


def _classified(spark: SparkSession, terms: list[str]) -> list[tuple[str, str]]:
    rows = spark.createDataFrame([(t.strip(),) for t in terms], "term string").select("term", classify_term(F.col("term")).alias("kind"))
    return [(r.term, r.kind) for r in rows.collect()]  # the caller's own short list


def _tag(df: DataFrame, category: str, found: list[tuple[str, Column]], id_column: str, label: Column, recency: Column) -> DataFrame | None:
    """Rows meeting each term's test in one pass, the ten most recent per term."""
    if not found:
        return None
    hits = F.array_compact(F.array(*[F.when(test, F.lit(term)) for term, test in found]))
    rows = df.withColumn("term", F.explode(hits)).select(
        "term", F.lit(category).alias("category"), F.col(id_column).alias("id"), label.alias("label"), recency.alias("_at"))
    rank = Window.partitionBy("term").orderBy(F.desc("_at"), "id")
    return rows.withColumn("rank", F.row_number().over(rank)).filter(F.col("rank") <= MAX_PER_CATEGORY).drop("_at")


def search(terms: list[str], *, events: DataFrame, alerts: DataFrame, incidents: DataFrame, incident_keys: DataFrame,
           hosts: DataFrame, users: DataFrame, indicators: DataFrame) -> DataFrame:
    """``(term, category, id, label, rank)`` for several terms at once; each table is read once."""
    spark = events.sparkSession
    plan: dict[str, list[tuple[str, Column]]] = {k: [] for k in ("events", "alerts", "incidents", "hosts", "users", "indicators", "techniques")}
    by_entity: list[str] = []
    lower = lambda c: F.lower(F.col(f"`{c}`"))
    for term, kind in _classified(spark, terms):
        low = term.lower()
        if kind == "incident_id":
            plan["incidents"].append((term, lower("incident_id") == low))
        elif kind == "alert_id":
            plan["alerts"].append((term, lower("alert_id") == low))
        elif kind == "event_id":
            plan["events"].append((term, lower("event_id") == low))
        elif kind == "ioc_id":
            plan["indicators"].append((term, lower("ioc_id") == low))
        elif kind == "technique":
            plan["techniques"].append((term, F.col("technique_id") == term.upper()))
        elif kind == "ip":
            plan["events"].append((term, (F.col("source_ip") == term) | (F.col("destination_ip") == term)))
            plan["alerts"].append((term, F.col("source_ip") == term))
            plan["indicators"].append((term, F.col("indicator") == term))
            plan["hosts"].append((term, F.col("ip_address") == term))
            by_entity.append(term)
        elif kind == "hash":
            plan["events"].append((term, lower("file_hash") == low))
            plan["indicators"].append((term, lower("indicator") == low))
        elif kind == "text":
            plan["hosts"].append((term, lower("host_id").startswith(low) | lower("hostname").startswith(low)))
            plan["users"].append((term, lower("user_id").startswith(low) | lower("display_name").contains(low)))
            plan["indicators"].append((term, lower("indicator").startswith(low)))
            plan["incidents"].append((term, lower("title").contains(low)))
            plan["alerts"].append((term, lower("title").contains(low) | lower("rule_id").startswith(low)))
            plan["techniques"].append((term, lower("name").contains(low)))
    if by_entity:
        own = incident_keys.filter(F.col("entity").isin([f"ip:{t}" for t in by_entity])).select("incident_id", F.expr("substring(entity, 4)").alias("_term"))
        touched = incidents.join(own, "incident_id").withColumnRenamed("_term", "term")
        rank = Window.partitionBy("term").orderBy(F.desc("last_us"), "incident_id")
        entity_rows = touched.select(
            "term", F.lit("incidents").alias("category"), F.col("incident_id").alias("id"), F.col("title").alias("label"),
            F.row_number().over(rank).alias("rank")).filter(F.col("rank") <= MAX_PER_CATEGORY)
    else:
        entity_rows = None
    nothing = F.lit(0)
    parts = [
        _tag(events, "events", plan["events"], "event_id", F.col("event_type"), F.col("timestamp")),
        _tag(alerts, "alerts", plan["alerts"], "alert_id", F.col("title"), F.col("detected_us")),
        _tag(incidents, "incidents", plan["incidents"], "incident_id", F.col("title"), F.col("last_us")),
        _tag(hosts, "hosts", plan["hosts"], "host_id", F.col("hostname"), nothing),
        _tag(users, "users", plan["users"], "user_id", F.col("display_name"), nothing),
        _tag(indicators, "indicators", plan["indicators"], "ioc_id", F.col("indicator"), nothing),
        _tag(catalogue.techniques(spark), "techniques", plan["techniques"], "technique_id", F.col("name"), nothing),
        entity_rows,
    ]
    found = [p for p in parts if p is not None]
    out = found[0]
    for part in found[1:]:
        out = out.unionByName(part)
    return out


def technique_hits(alerts: DataFrame, needle: str) -> DataFrame:
    """Techniques by id or name with their alert counts."""
    spark = alerts.sparkSession
    low = needle.lower()
    chosen = catalogue.techniques(spark).filter((F.lower("technique_id") == low) | F.lower("name").contains(low)).select("technique_id", "name")
    counts = alerts.select(F.explode("technique_ids").alias("technique_id")).groupBy("technique_id").agg(F.count("*").alias("alert_count"))
    return chosen.join(counts, "technique_id", "left").withColumn("alert_count", F.coalesce("alert_count", F.lit(0)))
