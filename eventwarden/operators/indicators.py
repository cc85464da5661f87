"""Indicator matching: event fields against a feed of known values."""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from eventwarden.model import IOC_TYPES
from eventwarden.operators.conditions import compile_selection, field

# The indicator type each event field can carry.
FIELD_TYPES = {
    "source_ip": "ip", "destination_ip": "ip", "file_hash": "hash", "host": "hostname", "host_id": "hostname",
    "user": "username", "user_id": "username", "cloud_resource": "url", "file_path": "url",
}

INDICATOR_DDL = (
    "ioc_id string, indicator string, ioc_type string, confidence double, severity string, source string, "
    "description string, tags array<string>, is_active boolean"
)


def lookup_key(value: Column) -> Column:
    return F.lower(F.trim(value.cast("string")))


def active_index(indicators: DataFrame) -> DataFrame:
    """Active indicators, one per (type, value); the newest id wins where a feed repeats a value."""
    active = indicators.filter("is_active").withColumn("ioc_key", lookup_key(F.col("indicator")))
    body = F.struct(*[F.col(c) for c in active.columns if c not in ("ioc_type", "ioc_key")])
    return active.groupBy("ioc_type", "ioc_key").agg(F.max_by(body, "ioc_id").alias("i")).select(
        "ioc_type", "ioc_key", "i.*"
    )


def match_indicators(events: DataFrame, indicators: DataFrame, fields: list[str], types: list[str] | None = None,
                     selection: dict | None = None) -> DataFrame:
    """One row per (event, field, indicator): event columns, ``matched_field, matched_value`` and ``ioc_*``.

    The feed's size is not assumed: the join is left to Spark, which broadcasts it when its measured size
    allows and splits an oversized value otherwise.
    """
    usable = [f for f in fields if f in FIELD_TYPES and (not types or FIELD_TYPES[f] in types)]
    tagged = [
        F.when(field(f)[0].isNotNull(), F.struct(
            F.lit(f).alias("matched_field"), F.lit(FIELD_TYPES[f]).alias("ioc_type"),
            field(f)[0].cast("string").alias("matched_value"), lookup_key(field(f)[0]).alias("ioc_key"),
        )) for f in usable
    ]
    present = reduce(or_, [field(f)[0].isNotNull() for f in usable])
    stacked = (
        events.filter(compile_selection(selection) & present)
        .withColumn("_field", F.explode(F.array_compact(F.array(*tagged))))
        .select("*", "_field.*").drop("_field")
    )
    index = active_index(indicators).select(
        "ioc_type", "ioc_key", "ioc_id", F.col("indicator").alias("ioc_indicator"),
        F.col("confidence").alias("ioc_confidence"), F.col("severity").alias("ioc_severity"),
        F.col("source").alias("ioc_source"), F.col("description").alias("ioc_description"),
        F.col("tags").alias("ioc_tags"),
    )
    return stacked.join(index, ["ioc_type", "ioc_key"])


def feed_rows(documents: DataFrame) -> DataFrame:
    """Feed documents (``provenance``, ``indicators[]``) to indicator rows; unusable entries are dropped."""
    rows = documents.select("provenance", F.explode("indicators").alias("i")).select("provenance", "i.*")
    text = F.trim("indicator")
    kind = F.lower(F.trim("ioc_type"))
    return rows.filter((text != "") & kind.isin(IOC_TYPES)).select(
        F.concat(F.lit("IOC-"), F.upper(F.substring(F.sha2(F.concat_ws("|", kind, F.lower(text)), 256), 1, 12))).alias("ioc_id"),
        text.alias("indicator"), kind.alias("ioc_type"),
        F.coalesce(F.col("confidence").cast("double"), F.lit(0.5)).alias("confidence"),
        F.coalesce("severity", F.lit("medium")).alias("severity"),
        F.coalesce("source", F.lit("local-demo")).alias("source"),
        F.col("description"),
        F.concat(F.coalesce("tags", F.array().cast("array<string>")),
                 F.when(F.col("provenance").isNotNull(), F.array("provenance")).otherwise(F.array().cast("array<string>"))
                 ).alias("tags"),
        F.coalesce(F.col("is_active").cast("boolean"), F.lit(True)).alias("is_active"),
    )


FEED_DDL = (
    "provenance string, indicators array<struct<indicator string, ioc_type string, confidence double, "
    "severity string, source string, tags array<string>, description string, is_active boolean>>"
)


def read_feed(spark, path: str) -> DataFrame:
    """Indicator feed files (one JSON document each) to indicator rows."""
    return feed_rows(spark.read.schema(FEED_DDL).option("multiLine", True).json(path))
