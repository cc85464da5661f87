"""Source-native records to canonical events."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from eventwarden.session import stage
from eventwarden.sources.normalize.canonical import canonical_events
from eventwarden.sources.normalize.common import bounded_raw, split_rejects, validate
from eventwarden.sources.normalize.hosts import edr_process, file_integrity, linux_auth, windows_security
from eventwarden.sources.normalize.network import cloud_audit, network_flow

# Sources and the job that reads each.
NORMALIZERS = {
    "linux_auth": linux_auth, "windows_security": windows_security, "edr_process": edr_process, "linux_auditd": edr_process,
    "network_flow": network_flow, "file_integrity": file_integrity, "cloud_audit": cloud_audit, "normalized": canonical_events,
}


def normalize(raw: DataFrame, now: Column | None = None, sources: list[str] | None = None) -> DataFrame:
    """Records of any source, dispatched and validated; ``reasons`` is empty on good rows.

    ``raw`` holds ``(record_id, source, record, ingested_at)``; records failing the raw bounds or naming an
    unknown source keep their place with a reason.
    """
    checked = bounded_raw(raw)
    usable = checked.filter("raw_reason IS NULL")
    parts = []
    for source in sources or list(NORMALIZERS):
        parts.append(NORMALIZERS[source](usable.filter(F.col("source") == source)))
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    valid = validate(out, now)
    known = F.col("source").isin(list(NORMALIZERS))
    refused = checked.filter(F.col("raw_reason").isNotNull() | ~known).select(
        "record_id", "source", F.col("record").alias("raw"), "ingested_at",
        F.array(F.coalesce("raw_reason", F.concat(F.lit("no normalizer for source "), "source"))).alias("reasons"))
    return valid.unionByName(refused, allowMissingColumns=True)


def ingest(raw: DataFrame, now: Column | None = None, strict: bool = False) -> tuple[DataFrame, DataFrame]:
    """Good events and the quarantine; ``strict`` fails the job when anything is refused.

    Normalized once: both sides read the staged result.
    """
    good, bad = split_rejects(stage(normalize(raw, now), "normalized"))
    if strict and not bad.isEmpty():
        raise ValueError(f"records refused: {[r.asDict() for r in bad.limit(5).collect()]}")
    return good, bad


__all__ = ["NORMALIZERS", "normalize", "ingest", "split_rejects", "validate"]
