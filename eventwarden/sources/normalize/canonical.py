"""Records that already are canonical events, in JSON."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from eventwarden.functions.net import let
from eventwarden.model import EVENT_TYPES_BY_COLUMN, MAX_METADATA_DEPTH, MAX_METADATA_KEYS, METADATA_TYPES
from eventwarden.sources.normalize.common import depth_of, normalized, parse, present, stamp

# names in a record that differ from the column they fill
RECORD_NAMES = {"host": "host_id", "user": "user_id"}
FIELDS = {c: RECORD_NAMES.get(c, c) for c in EVENT_TYPES_BY_COLUMN if c not in ("metadata", "raw", "ingested_at", "is_demo")}
KNOWN = [*FIELDS.values(), "metadata", "raw_event"]
KNOWN_METADATA = [k for k in METADATA_TYPES if k != "extra"]


def _extra(metadata: Column) -> Column:
    """Keys that no rule, hunt or score reads, as text; values that are no scalars as JSON."""
    whole = F.from_json(metadata, "map<string,string>")
    return let(F.map_filter(whole, lambda key, _: ~key.isin(KNOWN_METADATA)), lambda m: F.when(F.size(m) > 0, m))


def canonical_events(raw: DataFrame) -> DataFrame:
    """Fields by name, known metadata by type, other metadata in ``extra``; unknown fields refuse the record."""
    df = parse(raw, ", ".join(f"`{n}` string" for n in KNOWN)).withColumn(
        "m", F.from_json("r.metadata", ", ".join(f"`{k}` {METADATA_TYPES[k]}" for k in KNOWN_METADATA)))
    text = F.coalesce("r.metadata", F.lit("{}"))
    unknown = F.array_sort(F.array_except(F.json_object_keys("record"), F.array(*[F.lit(k) for k in KNOWN])))
    reject = F.coalesce(
        F.when(F.size(unknown) > 0, F.concat(F.lit("unknown field "), F.array_join(unknown, ", "))),
        F.when(F.json_object_keys(text).isNull(), "metadata is no object"),
        F.when(F.size(F.json_object_keys(text)) > MAX_METADATA_KEYS, f"metadata has more than {MAX_METADATA_KEYS} keys"),
        F.when(depth_of(text) > MAX_METADATA_DEPTH, f"metadata nests deeper than {MAX_METADATA_DEPTH} levels"),
        F.when(stamp(F.col("r.timestamp")).isNull(), "timestamp is unreadable"))
    values = {c: present(F.col(f"r.`{n}`")) if kind == "string" else F.col(f"r.`{n}`").try_cast(kind)
              for c, n in FIELDS.items() if (kind := EVENT_TYPES_BY_COLUMN[c]) != "timestamp"}
    values["status"] = F.coalesce(values["status"], F.lit("unknown"))
    values["source"] = F.coalesce(values["source"], F.col("source"))
    metadata = {k: F.col(f"m.`{k}`") for k in KNOWN_METADATA} | {"extra": _extra(F.col("r.metadata"))}
    return normalized(df, values, metadata, stamp(F.col("r.timestamp")), reject)
