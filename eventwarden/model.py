"""Canonical event schema and the vocabularies of the data model."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Vocabularies and caps of the canonical event.
EVENT_TYPES = [
    "authentication", "process", "network", "file", "cloud_audit",
    "account", "privilege", "scheduled_task", "service", "discovery",
]
STATUSES = ["success", "failure", "attempt", "unknown"]
SOURCES = [
    "linux_auth", "windows_security", "linux_auditd", "edr_process",
    "network_flow", "file_integrity", "cloud_audit", "normalized",
]
LABELS = ["benign", "malicious", "ambiguous"]
SEVERITIES = ["info", "low", "medium", "high", "critical"]
IOC_TYPES = ["ip", "domain", "url", "hash", "username", "hostname"]
OPEN_ALERT_STATUSES = ["new", "investigating", "escalated"]
ACTIVE_INCIDENT_STATUSES = ["open", "investigating", "contained"]

# Names that are longer than this are no names: the record is refused with a reason. Free texts (command lines, paths,
# messages, resources) have no cap.
TEXT_CAPS = {
    "event_id": 64, "host": 128, "user": 128, "source_ip": 64, "destination_ip": 64, "protocol": 16, "file_hash": 128,
    "cloud_provider": 32, "cloud_account": 128, "cloud_service": 64, "cloud_region": 48, "action": 128, "label": 16,
    "label_scenario": 64,
}
MAX_RAW_BYTES = 64 * 1024
MAX_METADATA_KEYS = 64
MAX_METADATA_DEPTH = 6
LOOKBACK_SECONDS = 3600
CORRELATION_WINDOW_SECONDS = 1800

STRING, BOOL, LONG, STRINGS = "string", "boolean", "bigint", "array<string>"

# Metadata keys read by rules, hunts, scores and timelines, with their types. Everything else a source
# carries goes to the ``extra`` map as text.
METADATA_TYPES: dict[str, str] = {
    "api_call": STRING, "argument_indicators": STRINGS, "auth_method": STRING, "base_name": STRING,
    "bytes_in": LONG, "cloud_discovery": BOOL, "cwd": STRING, "destination_is_private": BOOL,
    "direction": STRING, "discovery_category": STRING, "duration_ms": LONG, "elevated": BOOL,
    "error_code": STRING, "executable": STRING, "failure_reason": STRING, "gid": LONG, "group": STRING,
    "high_risk_policy": BOOL, "iam_category": STRING, "iam_risk": STRING, "identity_type": STRING,
    "integrity_level": STRING, "internal_lateral_candidate": BOOL, "interpreter": BOOL,
    "invalid_user": BOOL, "logon_type": LONG, "logon_type_name": STRING, "member": STRING,
    "mfa_authenticated": BOOL, "mode": STRING, "normalizer": STRING, "opened_by_uid": STRING,
    "outbound_external": BOOL, "owner": STRING, "packets": LONG, "parent_pid": LONG, "parsed": BOOL,
    "persistence_mechanism": STRING, "persistence_path": BOOL, "policy": STRING, "previous_hash": STRING,
    "privileged_group": BOOL, "privileges": STRINGS, "program": STRING, "read_only": BOOL,
    "reason": STRING, "remote_admin_protocol": BOOL, "sensitive_file": BOOL, "service": STRING,
    "service_name": STRING, "service_start_type": STRING, "setuid": BOOL, "size": LONG,
    "source_is_private": BOOL, "target_group": STRING, "target_principal": STRING, "target_user": STRING,
    "task_name": STRING, "tool": STRING, "tty": STRING, "uid": LONG, "uid_zero": BOOL,
    "user_agent": STRING, "windows_event_id": LONG, "working_directory": STRING,
    "extra": "map<string,string>",
}

EVENT_TYPES_BY_COLUMN: dict[str, str] = {
    "event_id": STRING, "timestamp": "timestamp", "ingested_at": "timestamp", "event_type": STRING,
    "source": STRING, "host": STRING, "user": STRING, "source_ip": STRING, "destination_ip": STRING,
    "destination_port": "int", "protocol": STRING, "bytes_out": LONG, "process": STRING,
    "process_id": "bigint", "parent_process": STRING, "command_line": STRING, "file_path": STRING,
    "file_hash": STRING, "cloud_provider": STRING, "cloud_account": STRING, "cloud_service": STRING,
    "cloud_resource": STRING, "cloud_region": STRING, "action": STRING, "status": STRING,
    "message": STRING, "metadata": None, "raw": STRING, "label": STRING, "label_scenario": STRING,
    "is_demo": BOOL,
}


def _metadata_ddl() -> str:
    return "struct<" + ",".join(f"`{k}`:{t}" for k, t in METADATA_TYPES.items()) + ">"


METADATA_DDL = _metadata_ddl()
EVENT_DDL = ", ".join(f"`{c}` {t or METADATA_DDL}" for c, t in EVENT_TYPES_BY_COLUMN.items())


def event_schema() -> T.StructType:
    """The canonical event as an explicit schema; never inferred."""
    return T.StructType.fromDDL(EVENT_DDL)


def metadata_struct(**values: Column) -> Column:
    """The typed metadata struct with the given keys set and the rest null."""
    unknown = set(values) - set(METADATA_TYPES)
    if unknown:
        raise KeyError(f"unknown metadata keys: {sorted(unknown)}")
    return F.struct(*[
        values.get(key, F.lit(None)).cast(kind).alias(key) for key, kind in METADATA_TYPES.items()
    ])


def canonical(df, values: dict[str, Column]):
    """Project ``df`` to the canonical columns, in order, null where no value is given."""
    columns = []
    for name, kind in EVENT_TYPES_BY_COLUMN.items():
        if name == "metadata":
            columns.append(values.get(name, metadata_struct()).alias(name))
        else:
            columns.append(values.get(name, F.lit(None)).cast(kind).alias(name))
    return df.select(*columns)


# Rule-facing names that differ from the column they read.
FIELD_ALIASES = {"host_id": "host", "user_id": "user", "process_name": "process"}


def micros(column: str | Column = "timestamp") -> Column:
    """Event time as whole microseconds; all window arithmetic runs on this."""
    return F.unix_micros(F.col(column) if isinstance(column, str) else column)


# ---- severity -------------------------------------------------------------------------------------
# Rank, risk weight and score bands.
SEVERITY_WEIGHT = {"info": 0.10, "low": 0.30, "medium": 0.55, "high": 0.80, "critical": 1.00}
SEVERITY_BANDS = [(76.0, "critical"), (51.0, "high"), (26.0, "medium")]


def severity_rank(column: Column) -> Column:
    expr = F.lit(0)
    for rank, name in enumerate(SEVERITIES):
        expr = F.when(column == name, F.lit(rank)).otherwise(expr)
    return expr


def severity_from_rank(rank: Column) -> Column:
    return F.get(F.array(*[F.lit(s) for s in SEVERITIES]), rank.cast("int"))


def severity_weight(column: Column) -> Column:
    expr = F.lit(0.3)
    for name, weight in SEVERITY_WEIGHT.items():
        expr = F.when(column == name, F.lit(weight)).otherwise(expr)
    return expr


def severity_band(score: Column) -> Column:
    expr = F.lit("low")
    for cut, name in reversed(SEVERITY_BANDS):
        expr = F.when(score >= cut, F.lit(name)).otherwise(expr)
    return expr
