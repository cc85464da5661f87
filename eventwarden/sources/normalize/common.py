"""Shared steps of the normalization jobs: field picking, timestamps, bounds and validation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from eventwarden.functions import net
from eventwarden.functions.net import let
from eventwarden.model import (
    EVENT_TYPES, EVENT_TYPES_BY_COLUMN, MAX_METADATA_KEYS, MAX_RAW_BYTES, SOURCES, STATUSES, TEXT_CAPS, metadata_struct,
)

MAX_RAW_DEPTH = 8


def parse(raw: DataFrame, schema: str) -> DataFrame:
    """Raw rows ``(record_id, source, record, ingested_at)`` with the record parsed once under an explicit schema."""
    return raw.withColumn("r", F.from_json("record", schema))


def first(*names: str) -> Column:
    """First of the record's fields that is present and not empty text."""
    return F.coalesce(*[present(F.col(f"r.`{n}`")) for n in names])


def present(column: Column) -> Column:
    return F.nullif(column, F.lit(""))


def whole(column: Column) -> Column:
    return column.try_cast("bigint")


def stamp(*columns: Column) -> Column:
    """First column that reads as a timestamp; a bare time is UTC. Null when none does."""
    return F.coalesce(*[F.try_to_timestamp(present(c)) for c in columns])


def normalized(parsed: DataFrame, values: dict[str, Column], metadata: dict[str, Column], time: Column, reject: Column | None = None) -> DataFrame:
    """Canonical columns plus ``record_id``, ``ts_fallback`` and the record-level ``reject`` reason.

    Texts stay whole; a record without a readable time takes its ingest time and says so.
    """
    out = parsed.withColumn("_time", time)
    meta = metadata_struct(**metadata)
    extra = {
        "timestamp": F.coalesce("_time", "ingested_at"), "ingested_at": F.col("ingested_at"), "raw": F.col("record"), "metadata": meta,
        "source": F.col("source"),
    }
    merged = {**extra, **values}
    columns = [
        meta.alias(n) if n == "metadata" else merged.get(n, F.lit(None)).cast(kind).alias(n)
        for n, kind in EVENT_TYPES_BY_COLUMN.items()
    ]
    why = F.lit(None) if reject is None else reject
    return out.select("record_id", *columns, F.col("_time").isNull().alias("ts_fallback"), why.cast("string").alias("reject"))


def _blank(column: Column) -> Column:
    return F.nullif(F.trim(column), F.lit(""))


def validate(df: DataFrame, now: Column | None = None) -> DataFrame:
    """Clean the canonical fields and list what is wrong with each row in ``reasons`` (empty: valid).

    Texts are trimmed, blank hosts and accounts become missing, addresses take their canonical form.
    """
    now = F.current_timestamp() if now is None else now
    texts = [c for c, kind in EVENT_TYPES_BY_COLUMN.items() if kind == "string" and c not in ("raw", "host", "user", "source_ip", "destination_ip")]
    out = df.withColumns({c: F.trim(F.col(f"`{c}`")) for c in texts})
    out = out.withColumns({"host": _blank(F.col("host")), "user": _blank(F.col("`user`"))})
    given = {c: F.when(~F.col(c).isin("", "-"), F.col(c)) for c in ("source_ip", "destination_ip")}
    out = out.withColumns({f"_{c}": given[c] for c in given})
    out = out.withColumns({c: net.canonical_ip(F.col(f"_{c}")) for c in given})
    why = lambda test, reason: F.when(test, F.lit(reason))
    meta_keys = F.size(F.coalesce("metadata.extra", F.create_map().cast("map<string,string>")))
    checks = [
        F.col("reject") if "reject" in out.columns else F.lit(None).cast("string"),
        why(~F.coalesce(F.col("event_type").isin(EVENT_TYPES), F.lit(False)), "unknown event_type"),
        why(~F.coalesce(F.col("status").isin(STATUSES), F.lit(False)), "unknown status"),
        why(~F.coalesce(F.col("source").isin(SOURCES), F.lit(False)), "unknown source"),
        why(F.col("timestamp").isNull(), "timestamp missing"),
        why(F.col("timestamp") > now + F.expr("INTERVAL 24 HOURS"), "timestamp is more than 24h in the future"),
        why(F.year("timestamp") < 2000, "timestamp predates the supported range"),
        why(F.col("_source_ip").isNotNull() & F.col("source_ip").isNull(), "invalid source_ip"),
        why(F.col("_destination_ip").isNotNull() & F.col("destination_ip").isNull(), "invalid destination_ip"),
        why(~F.coalesce(F.col("destination_port").between(0, 65535), F.lit(True)), "destination_port out of range"),
        why(F.coalesce(F.col("bytes_out") < 0, F.lit(False)), "negative bytes_out"),
        why(F.coalesce(F.col("process_id") < 0, F.lit(False)), "negative process_id"),
        why(meta_keys > MAX_METADATA_KEYS, "too many metadata keys"),
        *[why(F.coalesce(F.length(F.col(f"`{c}`")) > cap, F.lit(False)), f"{c} too long") for c, cap in TEXT_CAPS.items()],
        why(F.coalesce("host", "user", "source_ip", "cloud_account").isNull(), "no host, user, source_ip or cloud_account"),
    ]
    return out.withColumn("reasons", F.array_compact(F.array(*checks))).drop("_source_ip", "_destination_ip")


def depth_of(text: Column) -> Column:
    """How many objects and lists lie in each other, read off the marks outside quoted text; empty ones do not count."""
    bare = F.regexp_replace(F.regexp_replace(text, r'"(?:[^"\\]|\\.)*"', ""), r"\{\s*\}|\[\s*\]", "")
    marks = F.split(F.regexp_replace(bare, r"[^{}\[\]]", ""), "")
    steps = F.transform(marks, lambda c: F.when(c.isin("{", "["), 1).when(c.isin("}", "]"), -1).otherwise(0))
    walk = F.aggregate(
        steps, F.struct(F.lit(0).alias("now"), F.lit(0).alias("top")),
        lambda acc, s: F.struct((acc["now"] + s).alias("now"), F.greatest(acc["top"], acc["now"] + s).alias("top")))
    return let(walk, lambda w: w["top"])


def bounded_raw(raw: DataFrame) -> DataFrame:
    """Adds ``raw_reason`` for records over 64 KiB, nested too deeply or not JSON objects."""
    # only records with enough opening marks are walked; the record itself is level 0
    opened = F.length("record") - F.length(F.translate(F.col("record"), "{[", ""))
    return raw.withColumn("raw_reason", F.coalesce(
        F.when(F.octet_length("record") > MAX_RAW_BYTES, "raw record exceeds 65536 bytes"),
        F.when(F.try_parse_json("record").isNull() | ~F.col("record").rlike(r"^\s*\{"), "record is not a JSON object"),
        F.when((opened > MAX_RAW_DEPTH) & (depth_of(F.col("record")) > MAX_RAW_DEPTH + 1), "raw record is nested too deeply"),
    ))


def split_rejects(validated: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Good events, and the quarantine ``(record_id, source, reason, raw)``."""
    good = validated.filter(F.size("reasons") == 0)
    bad = validated.filter(F.size("reasons") > 0).select("record_id", "source", F.array_join("reasons", "; ").alias("reason"), "raw")
    return good, bad
