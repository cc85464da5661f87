"""History a batch of new events needs for its stateful rules."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from eventwarden.model import LOOKBACK_SECONDS
from eventwarden.session import stage


def _entities() -> Column:
    item = lambda prefix, c: F.when(F.col(f"`{c}`").isNotNull(), F.concat(F.lit(prefix), F.col(f"`{c}`")))
    return F.array_distinct(F.array_compact(F.array(
        item("host:", "host"), item("user:", "user"), item("ip:", "source_ip"), item("ip:", "destination_ip"),
        item("cloud:", "cloud_account"))))


def lookback_candidates(history: DataFrame, batch: DataFrame, lookback_seconds: int = LOOKBACK_SECONDS, span=None) -> DataFrame:
    """The batch plus earlier events sharing a host, account, address or cloud account with it.

    Only ids and entity keys travel through the joins that select; the batch side is one row per distinct entity,
    and the time bounds are two scalars that prune the history scan. Whole events are read between the times of the
    selected ones only: in a feed in time order, none of the batch's own stored events are among these.
    """
    low, high = batch.agg(F.min("timestamp"), F.max("timestamp")).first() if span is None else span
    if low is None:
        return batch
    start = F.lit(low) - F.expr(f"make_dt_interval(0, 0, 0, {int(lookback_seconds)})")
    window = history.filter((F.col("timestamp") >= start) & (F.col("timestamp") <= F.lit(high)))
    wanted = batch.select(F.explode(_entities()).alias("entity")).distinct()
    keyed = window.select("event_id", _entities().alias("entities")).join(
        batch.select("event_id"), "event_id", "left_anti").select("event_id", F.explode("entities").alias("entity"))
    ids = stage(keyed.join(wanted, "entity", "left_semi").select("event_id").distinct(), "related")
    us = F.unix_micros("timestamp")
    first, last = window.join(ids, "event_id", "left_semi").agg(F.min(us), F.max(us)).first()
    if first is None:
        return batch
    between = (F.col("timestamp") >= F.timestamp_micros(F.lit(first))) & (F.col("timestamp") <= F.timestamp_micros(F.lit(last)))
    return window.filter(between).join(ids, "event_id", "left_semi").unionByName(batch)


