"""Alerts to incidents: shared entity and closeness in time, closed transitively."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from eventwarden.model import ACTIVE_INCIDENT_STATUSES, CORRELATION_WINDOW_SECONDS
from eventwarden.operators.groups import numbered, running_totals
from eventwarden.session import release, stage

DAY_US = 86_400_000_000
# Links, each counted from both ends, that a graph is finished with at once: some MB, while a round of jobs takes half a second.
FEW_PAIRS = 50_000


def entity_islands(alerts: DataFrame, entities: DataFrame, window_seconds: int = CORRELATION_WINDOW_SECONDS):
    """Per entity, runs of alerts whose activity lies within the window of each other.

    Returns ``(alert_id, entity, island)`` with ``island`` naming the run. Alerts of one entity that start
    in the same window-wide slice always belong together, so they are merged by a plain aggregation first;
    only the slices of an entity are put in order.
    """
    width = window_seconds * 1_000_000
    members = entities.join(alerts.select("alert_id", "first_us", "last_us"), "alert_id").withColumn(
        "slice", F.expr(f"first_us div {width}"))
    slices = members.groupBy("entity", "slice").agg(F.min("first_us").alias("first_us"), F.max("last_us").alias("last_us")).withColumn(
        "day", F.expr(f"first_us div {DAY_US}"))
    # how far earlier days reach: one row per entity and day is put in order
    days = Window.partitionBy("entity").orderBy("day").rowsBetween(Window.unboundedPreceding, -1)
    carried = slices.groupBy("entity", "day").agg(F.max("last_us").alias("last_us")).select(
        "entity", "day", F.max("last_us").over(days).alias("before"))
    inside = Window.partitionBy("entity", "day").orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)
    reach = F.greatest("before", F.max("last_us").over(inside))
    opened = slices.join(carried, ["entity", "day"]).withColumn("reach", reach).select(
        "entity", "day", "slice", F.when(F.col("reach").isNull() | (F.col("first_us") - F.col("reach") > width), 1).otherwise(0).alias("opens"))
    runs = running_totals(opened, ["entity"], "day", ["slice"], {"run": F.col("opens")})
    named = runs.select("entity", "slice", F.concat_ws("#", "entity", F.col("run").cast("string")).alias("island"))
    return members.join(named, ["entity", "slice"]).select("alert_id", "entity", "island")


def connected_components(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """``(id, label)`` with one label per component: the smallest id in it.

    Contraction: each round a node moves to the neighbour of smallest rank, its own included (ranks are hashes, new in every
    round), nodes that meet become one, and edges are kept between what is left. A component without edges is done and
    leaves; every shape shrinks by a constant factor a round, a path of n nodes in O(log n) rounds. The moves are put
    together backwards, from the smallest table to the largest, and a round's edges are removed once the next are written.
    A graph that is down to ``FEW_PAIRS`` takes no more rounds: its last moves are found by the driver.
    """
    pairs = stage(edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
                  .filter("a <> b").distinct(), "edges")
    moves: list[DataFrame] = []
    while left := pairs.count():
        if left <= FEW_PAIRS:
            moves.append(_settled(pairs))
            break
        ranked = lambda c, seed=len(moves): F.struct(F.xxhash64(F.col(c), F.lit(seed)).alias("rank"), F.col(c).alias("id"))
        moved = stage(pairs.groupBy("a").agg(F.min(ranked("b")).alias("near")).select(
            "a", F.least(F.col("near"), ranked("a"))["id"].alias("to")), "moves")
        moves.append(moved)
        ends = moved.select(F.col("a").alias("b"), F.col("to").alias("far"))
        rest = stage(pairs.join(moved, "a").select("to", "b").join(ends, "b").filter("to <> far").select(
            F.col("to").alias("a"), F.col("far").alias("b")).distinct(), "edges")
        release(pairs)
        pairs = rest
    release(pairs)
    alone = nodes.select("id").distinct()
    if not moves:
        return alone.withColumn("label", F.col("id"))
    places = moves[-1]
    for moved in reversed(moves[:-1]):
        later = places.select(F.col("a").alias("to"), F.col("to").alias("end"))
        places = moved.join(later, "to", "left").select("a", F.coalesce("end", "to").alias("to"))
    names = places.groupBy("to").agg(F.min("a").alias("label"))
    named = places.join(names, "to").select(F.col("a").alias("id"), "label")
    labels = stage(alone.join(named, "id", "left").select("id", F.coalesce("label", "id").alias("label")), "labels")
    for moved in moves:
        if hasattr(moved, "stage_path"):
            release(moved)
    return labels


def _settled(pairs: DataFrame) -> DataFrame:
    """``(a, to)`` for the nodes of a few pairs: each moves to the smallest node of its component."""
    found = pairs.toArrow()
    root: dict = {}

    def top(x):
        while (up := root.setdefault(x, x)) != x:
            root[x] = x = root[up]
        return x

    for a, b in zip(*(found.column(c).to_pylist() for c in ("a", "b"))):
        low, high = sorted((top(a), top(b)))
        root[high] = low
    kind = found.schema.field("a").type
    return pairs.sparkSession.createDataFrame(pa.table({
        "a": pa.array(list(root), kind), "to": pa.array([top(x) for x in root], kind)}))


def cluster_alerts(alerts: DataFrame, entities: DataFrame, window_seconds: int = CORRELATION_WINDOW_SECONDS) -> DataFrame:
    """``(alert_id, cluster)``: transitive closure of "shares an entity and is close in time".

    Components are found on the islands, linked where an alert lies on several; repeated links collapse
    before the first round. An alert without entities is its own cluster. The cluster is named after its
    smallest alert id.
    """
    islands = stage(entity_islands(alerts, entities, window_seconds), "islands")
    hubs = islands.groupBy("alert_id").agg(F.min("island").alias("hub"))
    edges = islands.join(hubs, "alert_id").filter("island <> hub").select(
        F.col("hub").alias("a"), F.col("island").alias("b")).distinct()
    labels = connected_components(islands.select(F.col("island").alias("id")), edges)
    labelled = hubs.join(labels.withColumnRenamed("id", "hub"), "hub").select("alert_id", "label")
    joined = alerts.select("alert_id").join(labelled, "alert_id", "left").withColumn(
        "label", F.coalesce("label", F.concat(F.lit("alone:"), F.col("alert_id"))))
    names = joined.groupBy("label").agg(F.min("alert_id").alias("cluster"))
    return joined.join(names, "label").select("alert_id", "cluster")


def cluster_windows(alerts: DataFrame, clusters: DataFrame) -> DataFrame:
    return alerts.join(clusters, "alert_id").groupBy("cluster").agg(
        F.min("first_us").alias("first_us"), F.max("last_us").alias("last_us"), F.count("*").alias("alert_count"))


def matching_incidents(windows: DataFrame, cluster_entities: DataFrame, incidents: DataFrame,
                       incident_entities: DataFrame, window_seconds: int = CORRELATION_WINDOW_SECONDS) -> DataFrame:
    """``(cluster, incident_id)`` for active incidents sharing an entity and lying within the window.

    Both sides are cut into time buckets, so a busy entity meets only the incidents around the same time.
    """
    width = window_seconds * 1_000_000
    bucket = 4 * width

    def spread(df: DataFrame, slack: int) -> DataFrame:
        low, high = F.expr(f"(first_us - {slack}) div {bucket}"), F.expr(f"(last_us + {slack}) div {bucket}")
        return df.withColumn("bucket", F.explode(F.sequence(low, high)))

    active = incidents.filter(F.col("status").isin(ACTIVE_INCIDENT_STATUSES)).select("incident_id", "first_us", "last_us")
    left = spread(cluster_entities.select("cluster", "entity").distinct().join(windows, "cluster"), width)
    right = spread(incident_entities.select("incident_id", "entity").distinct().join(active, "incident_id"), 0).select(
        "incident_id", "entity", "bucket", F.col("first_us").alias("i_first"), F.col("last_us").alias("i_last"))
    return left.join(right, ["entity", "bucket"]).filter(
        (F.col("i_last") >= F.col("first_us") - width) & (F.col("i_first") <= F.col("last_us") + width)
    ).select("cluster", "incident_id").distinct()


def merge_into_incidents(windows: DataFrame, matches: DataFrame, incidents: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Clusters matched to incidents, and incidents absorbed by an older one.

    Returns ``(cluster, incident_id)`` for every matched cluster and ``(incident_id, into)`` for every
    incident that another, older incident takes over. The oldest incident of a component keeps its id.
    """
    edges = matches.select(F.concat(F.lit("c:"), "cluster").alias("a"), F.concat(F.lit("i:"), "incident_id").alias("b"))
    nodes = edges.select(F.col("a").alias("id")).union(edges.select(F.col("b").alias("id")))
    labels = connected_components(nodes, edges)
    by_incident = labels.filter(F.col("id").startswith("i:")).withColumn("incident_id", F.expr("substring(id, 3)"))
    oldest = by_incident.join(incidents.select("incident_id", "first_us"), "incident_id").groupBy("label").agg(
        F.min_by("incident_id", F.struct("first_us", "incident_id")).alias("into"))
    chosen = labels.filter(F.col("id").startswith("c:")).join(oldest, "label").select(
        F.expr("substring(id, 3)").alias("cluster"), F.col("into").alias("incident_id"))
    absorbed = by_incident.join(oldest, "label").filter("incident_id <> into").select("incident_id", "into")
    return chosen, absorbed


def number_incidents(windows: DataFrame, prefix: str = "INC", taken: DataFrame | None = None) -> DataFrame:
    """``(cluster, incident_id)`` with ids numbered per year in order of first activity.

    Numbers continue after the highest number in ``taken.incident_id`` of the same year.
    """
    dated = windows.withColumn("year", F.year(F.timestamp_micros("first_us")).cast("string")).withColumn(
        "day", F.expr(f"first_us div {DAY_US}"))
    ranked = numbered(dated.select("cluster", "year", "day", "first_us"), ["year"], "day", ["first_us", "cluster"], "n")
    if taken is not None:
        parts = F.split("incident_id", "-")
        highest = taken.select(F.get(parts, F.lit(1)).alias("year"), F.get(parts, F.lit(2)).cast("int").alias("used"))
        highest = highest.groupBy("year").agg(F.max("used").alias("used"))
        ranked = ranked.join(highest, "year", "left").withColumn("n", F.col("n") + F.coalesce("used", F.lit(0)))
    number = F.when(F.col("n") > 9999, F.col("n").cast("string")).otherwise(F.lpad(F.col("n").cast("string"), 4, "0"))
    return ranked.select("cluster", F.concat_ws("-", F.lit(prefix), "year", number).alias("incident_id"))


def largest_gap(df: DataFrame, keys: list[str], time: str, slice_us: int) -> DataFrame:
    """Largest distance between consecutive times per key; null when a key has one time.

    Gaps inside a slice come from an ordered window over that slice, gaps between slices from the slices'
    ends, so no key is sorted as a whole.
    """
    inside = Window.partitionBy(*keys, "_slice").orderBy(time)
    rows = df.select(*keys, time).withColumn("_slice", F.expr(f"{time} div {slice_us}")).withColumn(
        "_gap", F.col(time) - F.lag(time).over(inside))
    slices = rows.groupBy(*keys, "_slice").agg(
        F.max("_gap").alias("_gap"), F.min(time).alias("_low"), F.max(time).alias("_high"))
    across = Window.partitionBy(*keys).orderBy("_slice")
    return slices.withColumn("_jump", F.col("_low") - F.lag("_high").over(across)).groupBy(*keys).agg(
        F.max(F.greatest("_gap", "_jump")).alias("largest_gap_us"))
