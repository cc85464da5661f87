"""Behavioural baselines: what an account has done before.

Long form is ``(entity_ref, feature, value, n)``. The point-in-time form gives, for each account and hour,
what was known strictly before that hour, from first-seen times and per-hour counts: nothing here sorts
an account's raw events, and the longest ordered run is one row per account and hour.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from eventwarden.functions import net
from eventwarden.model import micros
from eventwarden.session import stage

HOUR_US = 3_600_000_000

FEATURES = ["login_hours", "source_ips", "hosts", "cloud_apis", "cloud_hours"]


def observations(events: DataFrame) -> DataFrame:
    """``(entity_ref, feature, value, us)``: one row per thing an event teaches about its account."""
    login = (F.col("event_type") == "authentication") & (F.col("status") == "success")
    cloud = F.col("cloud_account").isNotNull() & F.col("action").isNotNull()
    hour = F.hour("timestamp").cast("string")

    def item(when: Column, feature: str, value: Column) -> Column:
        return F.when(when & value.isNotNull(), F.struct(F.lit(feature).alias("feature"), F.lower(value).alias("value")))

    items = F.array_compact(F.array(
        item(login, "login_hours", hour), item(login, "source_ips", F.col("source_ip")),
        item(login, "hosts", F.col("host")), item(cloud, "cloud_apis", F.col("action")),
        item(cloud, "cloud_hours", hour), item(cloud, "source_ips", F.col("source_ip")),
    ))
    return events.filter(F.col("user").isNotNull() & (F.col("user") != "") & (login | cloud)).select(
        F.lower("user").alias("entity_ref"), micros().alias("us"), F.explode(items).alias("o")
    ).select("entity_ref", "us", "o.feature", "o.value")


def frequency_table(events: DataFrame, keep: int | None = None) -> DataFrame:
    """``(entity_ref, feature, value, n, observation_count)``; with ``keep``, the most observed values only."""
    counts = observations(events).groupBy("entity_ref", "feature", "value").agg(F.count("*").alias("n"))
    totals = counts.groupBy("entity_ref", "feature").agg(F.sum("n").alias("observation_count"))
    return _most_observed(counts, keep).join(totals, ["entity_ref", "feature"])


def merge_frequencies(stored: DataFrame, fresh: DataFrame, keep: int | None = None) -> DataFrame:
    """Fold a batch's frequency table into the stored one."""
    both = stored.select("entity_ref", "feature", "value", "n").unionByName(
        fresh.select("entity_ref", "feature", "value", "n"))
    counts = both.groupBy("entity_ref", "feature", "value").agg(F.sum("n").alias("n"))
    totals = (
        stored.select("entity_ref", "feature", "observation_count").distinct()
        .unionByName(fresh.select("entity_ref", "feature", "observation_count").distinct())
        .groupBy("entity_ref", "feature").agg(F.sum("observation_count").alias("observation_count"))
    )
    return _most_observed(counts, keep).join(totals, ["entity_ref", "feature"])


def _most_observed(counts: DataFrame, keep: int | None) -> DataFrame:
    if keep is None:
        return counts
    best = Window.partitionBy("entity_ref", "feature").orderBy(F.desc("n"), "value")
    return counts.withColumn("_rank", F.row_number().over(best)).filter(F.col("_rank") <= keep).drop("_rank")


def as_maps(table: DataFrame) -> DataFrame:
    """Wide form: one value map per (account, feature); for tables cut by ``keep``, which bounds the maps."""
    return table.groupBy("entity_ref", "feature").agg(
        F.map_from_entries(F.array_sort(F.collect_list(F.struct("value", "n")))).alias("frequencies"),
        F.max("observation_count").alias("observation_count"),
    )


def snapshot(table: DataFrame, users: DataFrame) -> DataFrame:
    """Baseline rows of the accounts in ``users.user``."""
    wanted = users.filter(F.col("user").isNotNull()).select(F.lower("user").alias("entity_ref")).distinct()
    return table.join(wanted, "entity_ref", "left_semi")


def first_seen(seen: DataFrame) -> DataFrame:
    """Hour in which each value of a feature was first observed."""
    return seen.groupBy("entity_ref", "feature", "value").agg(
        F.expr(f"min(us) div {HOUR_US}").alias("first_bucket")
    )



def known_before(events: DataFrame, firsts: DataFrame | None = None) -> DataFrame:
    """Per (account, hour): counts and summaries of everything observed in earlier hours.

    Columns per feature: ``<feature>_count`` observations, ``<feature>_known`` distinct values; for the
    hour features also ``_low``/``_high``; ``source_ips_external`` tells whether any known address is
    external.
    """
    seen = observations(events)
    firsts = first_seen(seen) if firsts is None else firsts
    counted = seen.groupBy("entity_ref", "feature", F.expr(f"us div {HOUR_US}").alias("bucket")).agg(
        F.count("*").alias("n")
    ).select("entity_ref", "feature", "bucket", "n", F.lit(0).cast("bigint").alias("fresh"),
             F.lit(None).cast("int").alias("hour"), F.lit(None).cast("boolean").alias("external"))
    is_hour = F.col("feature").isin("login_hours", "cloud_hours")
    arrived = firsts.select(
        "entity_ref", "feature", F.col("first_bucket").alias("bucket"), F.lit(0).cast("bigint").alias("n"),
        F.lit(1).cast("bigint").alias("fresh"), F.when(is_hour, F.col("value").try_cast("int")).alias("hour"),
        F.when(F.col("feature") == "source_ips", net.is_external(F.col("value"))).alias("external"),
    )
    rows = counted.unionByName(arrived)
    per_hour = rows.groupBy("entity_ref", "bucket").agg(
        *[F.sum(F.when(F.col("feature") == f, F.col("n")).otherwise(0)).alias(f"{f}_count") for f in FEATURES],
        *[F.sum(F.when(F.col("feature") == f, F.col("fresh")).otherwise(0)).alias(f"{f}_known") for f in FEATURES],
        *[fn(F.when(F.col("feature") == f, F.col("hour"))).alias(f"{f}_{name}")
          for f in ("login_hours", "cloud_hours") for name, fn in (("low", F.min), ("high", F.max))],
        F.max(F.when(F.col("feature") == "source_ips", F.col("external"))).alias("source_ips_external"),
    )
    past = Window.partitionBy("entity_ref").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    sums = [f"{f}_{kind}" for f in FEATURES for kind in ("count", "known")]
    return per_hour.select(
        "entity_ref", "bucket",
        *[F.coalesce(F.sum(c).over(past), F.lit(0)).alias(c) for c in sums],
        *[fn(f"{f}_{name}").over(past).alias(f"{f}_{name}")
          for f in ("login_hours", "cloud_hours") for name, fn in (("low", F.min), ("high", F.max))],
        F.coalesce(F.max("source_ips_external").over(past), F.lit(False)).alias("source_ips_external"),
    )


def with_history(scored: DataFrame, history_events: DataFrame) -> DataFrame:
    """Scored events with what their account's baseline held before their hour.

    Adds the columns of :func:`known_before` and ``<feature>_seen`` for the event's own address, host and
    API call.
    """
    # read by the summaries and by each of the lookups below
    firsts = stage(first_seen(observations(history_events)), "firsts")
    known = known_before(history_events, firsts)
    keyed = scored.withColumn("entity_ref", F.lower("user")).withColumn("bucket", F.expr(f"unix_micros(timestamp) div {HOUR_US}"))
    out = keyed.join(known, ["entity_ref", "bucket"], "left").fillna(
        0, [f"{f}_{kind}" for f in FEATURES for kind in ("count", "known")])
    for feature, column in (("source_ips", "source_ip"), ("hosts", "host"), ("cloud_apis", "action")):
        lookup = firsts.filter(F.col("feature") == feature).select(
            "entity_ref", F.col("value").alias("_v"), F.col("first_bucket").alias("_first"))
        out = out.withColumn("_v", F.lower(column)).join(lookup, ["entity_ref", "_v"], "left")
        out = out.withColumn(f"{feature}_seen", F.coalesce(F.col("_first") < F.col("bucket"), F.lit(False)))
        out = out.drop("_v", "_first")
    return out.drop("bucket")


def with_stored_history(scored: DataFrame, table: DataFrame) -> DataFrame:
    """Scored events with a stored baseline, in the columns of :func:`with_history`.

    Streams use this: the stored table is updated after each batch, so it holds earlier batches only.
    """
    is_hour = lambda f: f in ("login_hours", "cloud_hours")
    summary = table.groupBy("entity_ref").agg(
        *[F.coalesce(F.max(F.when(F.col("feature") == f, F.col("observation_count"))), F.lit(0)).alias(f"{f}_count") for f in FEATURES],
        *[F.count(F.when(F.col("feature") == f, 1)).alias(f"{f}_known") for f in FEATURES],
        *[fn(F.when(F.col("feature") == f, F.col("value").try_cast("int"))).alias(f"{f}_{name}")
          for f in FEATURES if is_hour(f) for name, fn in (("low", F.min), ("high", F.max))],
        F.coalesce(F.max(F.when(F.col("feature") == "source_ips", net.is_external(F.col("value")))), F.lit(False)).alias("source_ips_external"),
    )
    out = scored.withColumn("entity_ref", F.lower("user")).join(summary, "entity_ref", "left").fillna(
        0, [f"{f}_{kind}" for f in FEATURES for kind in ("count", "known")])
    for feature, column in (("source_ips", "source_ip"), ("hosts", "host"), ("cloud_apis", "action")):
        lookup = table.filter(F.col("feature") == feature).select("entity_ref", F.col("value").alias("_v"), F.lit(True).alias("_hit"))
        out = out.withColumn("_v", F.lower(column)).join(lookup, ["entity_ref", "_v"], "left")
        out = out.withColumn(f"{feature}_seen", F.coalesce("_hit", F.lit(False))).drop("_v", "_hit")
    return out
