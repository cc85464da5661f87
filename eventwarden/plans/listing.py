"""Filtered, ordered pages over the stored tables, and the lookups behind them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from eventwarden import catalogue


def _equal(df: DataFrame, **wanted) -> DataFrame:
    for name, value in wanted.items():
        if value is not None:
            column = F.col(f"`{name}`")
            df = df.filter(column.isin(value) if isinstance(value, (list, tuple)) else column == value)
    return df


def _holds(term: str, *columns: str) -> Column:
    needle = term.lower()
    test = F.lower(F.col(f"`{columns[0]}`")).contains(needle)
    for name in columns[1:]:
        test = test | F.lower(F.col(f"`{name}`")).contains(needle)
    return test


def paged(df: DataFrame, order: list, limit: int, offset: int = 0) -> DataFrame:
    ordered = df.orderBy(*order)
    return (ordered.offset(offset) if offset else ordered).limit(limit)


def events_page(events: DataFrame, *, limit: int = 50, offset: int = 0, since=None, until=None, **equal) -> DataFrame:
    """Events by type, host, user, source address, status and time, newest first."""
    rows = _equal(events, **equal)
    if since is not None:
        rows = rows.filter(F.col("timestamp") >= F.lit(since).cast("timestamp"))
    if until is not None:
        rows = rows.filter(F.col("timestamp") <= F.lit(until).cast("timestamp"))
    return paged(rows, [F.desc("timestamp"), "event_id"], limit, offset)


SORTABLE_ALERTS = ["detected_us", "risk_score", "confidence", "severity", "rule_id"]


def alerts_page(alerts: DataFrame, *, limit: int = 50, offset: int = 0, technique: str | None = None, q: str | None = None,
                since_us: int | None = None, until_us: int | None = None, sort: str = "detected_us", descending: bool = True, **equal) -> DataFrame:
    """The alert queue: equality filters, technique membership, text search and an allow-listed order."""
    if sort not in SORTABLE_ALERTS:
        raise ValueError(f"cannot sort by {sort}")
    rows = _equal(alerts, **equal)
    if technique is not None:
        rows = rows.filter(F.array_contains("technique_ids", technique))
    if since_us is not None:
        rows = rows.filter(F.col("detected_us") >= since_us)
    if until_us is not None:
        rows = rows.filter(F.col("detected_us") <= until_us)
    if q:
        rows = rows.filter(_holds(q, "title", "rule_id", "rule_name"))
    return paged(rows, [F.desc(sort) if descending else F.asc(sort), "alert_id"], limit, offset)


def incidents_page(incidents: DataFrame, entities: DataFrame, *, limit: int = 50, offset: int = 0, host: str | None = None,
                   user: str | None = None, technique: str | None = None, since_us: int | None = None, sort: str = "last_us",
                   descending: bool = True, **equal) -> DataFrame:
    """Incidents by severity, status, affected host, involved account and technique."""
    rows = _equal(incidents, **equal)
    if since_us is not None:
        rows = rows.filter(F.col("last_us") >= since_us)
    for kind, value in (("host", host), ("user", user)):
        if value is not None:
            own = entities.filter((F.col("kind") == kind) & (F.col("value") == value)).select("incident_id")
            rows = rows.join(own, "incident_id", "left_semi")
    if technique is not None:
        rows = rows.filter(F.array_contains("technique_ids", technique))
    return paged(rows, [F.desc(sort) if descending else F.asc(sort), "incident_id"], limit, offset)


def hosts_page(hosts: DataFrame, *, q: str | None = None, limit: int = 100, offset: int = 0, **equal) -> DataFrame:
    rows = _equal(hosts, **equal)
    if q:
        rows = rows.filter(_holds(q, "host_id", "hostname"))
    return paged(rows, [F.desc("criticality"), "host_id"], limit, offset)


def users_page(users: DataFrame, *, q: str | None = None, limit: int = 100, offset: int = 0, **equal) -> DataFrame:
    rows = _equal(users, **equal)
    if q:
        rows = rows.filter(_holds(q, "user_id", "display_name"))
    return paged(rows, [F.desc("is_privileged"), "user_id"], limit, offset)


def indicator_counts(indicators: DataFrame, ioc_matches: DataFrame) -> DataFrame:
    counts = ioc_matches.groupBy("ioc_id").agg(F.count("*").alias("match_count"), F.max("us").alias("last_us"))
    return indicators.join(counts, "ioc_id", "left").withColumn("match_count", F.coalesce("match_count", F.lit(0)))


def indicators_page(indicators: DataFrame, ioc_matches: DataFrame, *, matched_only: bool = False, q: str | None = None,
                    limit: int = 100, offset: int = 0, **equal) -> DataFrame:
    rows = _equal(indicator_counts(indicators, ioc_matches), **equal)
    if matched_only:
        rows = rows.filter("match_count > 0")
    if q:
        rows = rows.filter(_holds(q, "indicator"))
    return paged(rows, [F.desc("match_count"), F.desc("confidence"), "ioc_id"], limit, offset)


def indicator_detail(indicators: DataFrame, ioc_matches: DataFrame, incident_events: DataFrame) -> DataFrame:
    """Per indicator: matched events, affected hosts and incidents."""
    events = ioc_matches.select("ioc_id", "event_id", "host").distinct()
    own = events.groupBy("ioc_id").agg(F.count_distinct("event_id").alias("events"))
    hosts = events.filter(F.col("host").isNotNull()).select("ioc_id", "host").distinct().groupBy("ioc_id").agg(F.count("*").alias("hosts"))
    cases = events.join(incident_events.select("incident_id", "event_id"), "event_id").groupBy("ioc_id").agg(
        F.count_distinct("incident_id").alias("incidents"))
    out = indicators.select("ioc_id", "indicator").join(own, "ioc_id", "left").join(hosts, "ioc_id", "left").join(cases, "ioc_id", "left")
    return out.fillna(0, ["events", "hosts", "incidents"])


def audit_page(trail: DataFrame, *, since=None, limit: int = 100, offset: int = 0, **equal) -> DataFrame:
    """Audit records by actor, action, target and result, newest first."""
    rows = _equal(trail, **equal)
    if since is not None:
        rows = rows.filter(F.col("created_at") >= F.lit(since).cast("timestamp"))
    return paged(rows, [F.desc("created_at"), "audit_id"], limit, offset)


# ---- ATT&CK ---------------------------------------------------------------------------------------
def coverage(rules: DataFrame, techniques: DataFrame) -> DataFrame:
    """Catalogue techniques per tactic with the rules covering them and how often incidents saw them.

    ``rules`` is the rule table, ``techniques`` the incident technique rows.
    """
    spark = rules.sparkSession
    covered = rules.filter("enabled").select("rule_id", F.explode("technique_ids").alias("technique_id")).groupBy("technique_id").agg(
        F.array_sort(F.collect_set("rule_id")).alias("detection_rules"))
    observed = techniques.groupBy("technique_id").agg(F.count("*").alias("observed"))
    catalog = catalogue.technique_tactics(spark)
    return catalog.join(covered, "technique_id", "left").join(observed, "technique_id", "left").select(
        "tactic_id", "tactic", "position", "technique_id", "name", F.col("detection_rules").isNotNull().alias("covered"),
        F.coalesce("detection_rules", F.array().cast("array<string>")).alias("detection_rules"), F.coalesce("observed", F.lit(0)).alias("observed"))


def coverage_by_tactic(matrix: DataFrame) -> DataFrame:
    return matrix.groupBy("tactic_id", "tactic", "position").agg(
        F.count_if("covered").alias("covered_count"), F.count("*").alias("total_count"), F.sum("observed").alias("observed"))


def coverage_totals(matrix: DataFrame) -> DataFrame:
    unique = matrix.select("technique_id", "covered", "observed").distinct()
    return unique.agg(F.count("*").alias("technique_count"), F.count_if("covered").alias("covered_techniques"),
                      F.count_if(F.col("observed") > 0).alias("observed_techniques")).withColumn(
        "coverage_ratio", F.round(F.col("covered_techniques") / F.col("technique_count"), 3))


def uncovered(matrix: DataFrame) -> DataFrame:
    """Techniques without a rule, with how often incidents saw them all the same."""
    return matrix.filter("NOT covered").select("technique_id", "observed").distinct()


def technique_detail(rules: DataFrame, alerts: DataFrame, techniques: DataFrame) -> DataFrame:
    """Per catalogue technique: rules, alerts and incidents naming it."""
    spark = rules.sparkSession
    count = lambda df, key, name: df.groupBy("technique_id").agg(F.count_distinct(key).alias(name))
    named = rules.select("rule_id", F.explode("technique_ids").alias("technique_id"))
    alerted = alerts.select("alert_id", F.explode("technique_ids").alias("technique_id"))
    out = catalogue.techniques(spark).select("technique_id", "name")
    out = out.join(count(named, "rule_id", "rules"), "technique_id", "left").join(count(alerted, "alert_id", "alerts"), "technique_id", "left")
    return out.join(count(techniques, "incident_id", "incidents"), "technique_id", "left").fillna(0, ["rules", "alerts", "incidents"])


def tactics_in_order(techniques: DataFrame) -> DataFrame:
    """Tactics an incident's techniques cover, in kill-chain order."""
    spark = techniques.sparkSession
    pairs = techniques.select("incident_id", "technique_id").join(F.broadcast(catalogue.technique_tactics(spark)), "technique_id").select(
        "incident_id", "position", "tactic_id").distinct()
    return pairs.groupBy("incident_id").agg(  # at most 14 tactics
        F.transform(F.array_sort(F.collect_list(F.struct("position", "tactic_id"))), lambda x: x["tactic_id"]).alias("tactics"))
