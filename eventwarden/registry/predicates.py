"""Rule predicates, hunt filters and IP functions over the whole event table."""

from __future__ import annotations

from pyspark.sql import functions as F

from eventwarden.functions import net
from eventwarden.operators.conditions import compile_filters, compile_selection
from eventwarden.plans.desk import desk
from eventwarden.registry.base import query
from eventwarden.registry.sql import with_ev


def _ids(name: str, selection: dict, where: str) -> None:
    """A rule selection: ids of the events it keeps."""
    @query(name, with_ev(f"SELECT event_id FROM ev WHERE {where}"))
    def run(spark, sf_dir):
        return desk(spark, sf_dir).events.filter(compile_selection(selection)).select("event_id")


_ids("prd_eq", {"user": "user-8"}, "coalesce(lower(\"user\") = 'user-8', FALSE)")
_ids("prd_eq_boolean", {"metadata.cloud_discovery": True}, "coalesce(m_cloud_discovery, FALSE)")
_ids("prd_eq_false", {"metadata.mfa_authenticated": False}, "m_mfa IS NOT NULL AND NOT m_mfa")
_ids("prd_not_eq", {"metadata.iam_category": {"not_eq": "credential_creation"}},
     "m_iam_category IS NULL OR m_iam_category <> 'credential_creation'")
_ids("prd_in", {"action": ["LOGIN", "sudo", "StopLogging"]}, "lower(action) IN ('login', 'sudo', 'stoplogging')")
_ids("prd_not_in", {"user": {"not_in": ["user-1", "user-2"]}},
     "\"user\" IS NULL OR lower(\"user\") NOT IN ('user-1', 'user-2')")
_ids("prd_contains", {"command_line": {"contains": ["/etc/SHADOW", "-perm"]}},
     "coalesce(lower(command_line) LIKE '%/etc/shadow%' OR lower(command_line) LIKE '%-perm%', FALSE)")
_ids("prd_contains_list", {"metadata.argument_indicators": {"contains": ["suid_enumeration", "remote_download"]}},
     "coalesce(m_indicator IN ('suid_enumeration', 'remote_download'), FALSE)")
_ids("prd_not_contains", {"file_path": {"not_contains": "/etc/"}},
     "file_path IS NULL OR file_path NOT LIKE '%/etc/%'")
_ids("prd_startswith", {"source_ip": {"startswith": "203.0."}}, "source_ip LIKE '203.0.%'")
_ids("prd_endswith", {"file_path": {"endswith": [".SERVICE", "/shadow"]}},
     "coalesce(lower(file_path) LIKE '%.service' OR lower(file_path) LIKE '%/shadow', FALSE)")
_ids("prd_regex", {"command_line": {"regex": [r"^CURL\s+http", r"find\s.*-perm"]}},
     r"coalesce(regexp_matches(command_line, '(?i)^CURL\s+http') OR regexp_matches(command_line, '(?i)find\s.*-perm'), FALSE)")
_ids("prd_not_regex", {"host": {"not_regex": r"^host-1\d$"}},
     r"host IS NULL OR NOT regexp_matches(host, '(?i)^host-1\d$')")


@query("prd_regex_long", r"SELECT doc_id FROM documents WHERE regexp_matches(text, '(?i)licensed under the .* licen[sc]e')")
def prd_regex_long(spark, sf_dir):
    """A pattern anywhere in long texts: nothing is cut before it is searched."""
    rows = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", F.col("text").alias("command_line"))
    return rows.filter(compile_selection({"command_line": {"regex": r"licensed under the .* licen[sc]e"}})).select("doc_id")


_ids("prd_gt", {"bytes_out": {"gt": 2000000}}, "coalesce(bytes_out > 2000000, FALSE)")
_ids("prd_gte", {"destination_port": {"gte": 445}}, "coalesce(destination_port >= 445, FALSE)")
_ids("prd_lt", {"destination_port": {"lt": 443}}, "coalesce(destination_port < 443, FALSE)")
_ids("prd_lte", {"metadata.windows_event_id": {"lte": 4672}}, "coalesce(m_windows_event_id <= 4672, FALSE)")
_ids("prd_exists", {"metadata.failure_reason": {"exists": True}, "user": {"exists": True}},
     "m_failure_reason IS NOT NULL AND \"user\" IS NOT NULL")
_ids("prd_is_null", {"user": {"is_null": True}}, "\"user\" IS NULL")
_ids("prd_any_of", {"any_of": [
    {"event_type": "file", "metadata.sensitive_file": True},
    {"event_type": ["process", "discovery"], "command_line": {"contains": "/etc/shadow"}},
]}, "(event_type = 'file' AND coalesce(m_sensitive_file, FALSE)) OR "
    "(event_type IN ('process', 'discovery') AND coalesce(command_line LIKE '%/etc/shadow%', FALSE))")
_ids("prd_all_of", {"all_of": [{"event_type": "network"}, {"metadata.internal_lateral_candidate": True}], "status": "success"},
     "event_type = 'network' AND coalesce(m_internal_lateral_candidate, FALSE) AND status = 'success'")
_ids("prd_not", {"event_type": "authentication", "not": {"status": "failure"}},
     "event_type = 'authentication' AND NOT (status = 'failure')")
_ids("prd_case_sensitive", {"case_sensitive": True, "user": {"startswith": "USER-"},
                            "any_of": [{"action": "LOGIN"}, {"action": "EXEC"}]},
     "coalesce(\"user\" LIKE 'USER-%', FALSE) AND lower(action) IN ('login', 'exec')")
_ids("prd_metadata_and_alias", {"host_id": "host-3", "metadata.service": "SSH", "process_name": {"is_null": True}},
     "coalesce(lower(host) = 'host-3', FALSE) AND coalesce(m_service = 'ssh', FALSE) AND process IS NULL")


def _hunt(name: str, filters: list, where: str, logic: str = "and", **options) -> None:
    @query(name, with_ev(f"SELECT event_id FROM ev WHERE {where}"))
    def run(spark, sf_dir):
        return desk(spark, sf_dir).events.filter(compile_filters(filters, logic, **options)).select("event_id")


_hunt("hunt_eq_ne", [("user", "ne", "USER-8"), ("status", "eq", "FAILURE")],
      "lower(\"user\") <> 'user-8' AND status = 'failure'")
_hunt("hunt_in_not_in", [("event_type", "in", ["file", "Network"]), ("destination_port", "not_in", [22, 443])],
      "event_type IN ('file', 'network') AND destination_port NOT IN (22, 443)")
_hunt("hunt_contains", [("file_path", "contains", "."), ("file_path", "not_contains", "%")],
      "contains(file_path, '.') AND NOT contains(file_path, '%')")
_hunt("hunt_not_contains", [("source_ip", "not_contains", "10."), ("event_type", "eq", "authentication")],
      "NOT contains(source_ip, '10.') AND event_type = 'authentication'")
_hunt("hunt_edges", [("host", "startswith", "host-1"), ("host", "endswith", "9")],
      "lower(host) LIKE 'host-1%' AND host LIKE '%9'")
_hunt("hunt_compare", [("bytes_out", "gte", 100000), ("bytes_out", "lt", 5000000)],
      "bytes_out >= 100000 AND bytes_out < 5000000")
_hunt("hunt_time_compare", [("timestamp", "gt", "2024-01-20 00:00:00"), ("timestamp", "lte", "2024-01-21 12:00:00")],
      "ts > TIMESTAMP '2024-01-20 00:00:00' AND ts <= TIMESTAMP '2024-01-21 12:00:00'")
_hunt("hunt_exists", [("cloud_account", "exists", True), ("cloud_resource", "exists", False)],
      "cloud_account IS NOT NULL AND cloud_resource IS NULL")
_hunt("hunt_metadata_boolean", [("metadata.mfa_authenticated", "ne", "true"), ("metadata.read_only", "eq", True)],
      "NOT m_mfa AND m_read_only")
_hunt("hunt_or_logic", [("action", "eq", "stoplogging"), ("metadata.uid_zero", "eq", True), ("process", "eq", "find")],
      "action = 'StopLogging' OR m_uid_zero OR process = 'find'", logic="or")
_hunt("hunt_ne_drops_null", [("metadata.iam_category", "ne", "privilege_grant")], "m_iam_category <> 'privilege_grant'")
_hunt("hunt_step_ne_keeps_null", [("metadata.iam_category", "ne", "privilege_grant"), ("host", "not_in", ["host-1"]),
                                  ("command_line", "not_contains", "find")],
      "(m_iam_category IS NULL OR m_iam_category <> 'privilege_grant') AND (host IS NULL OR lower(host) <> 'host-1') "
      "AND (command_line IS NULL OR NOT contains(command_line, 'find'))", null_negation=True)


@query("ip_classify", with_ev("""
SELECT source_ip, CASE WHEN source_ip LIKE '10.%' THEN 'internal' ELSE 'external' END AS kind,
       source_ip NOT LIKE '10.%' AS external, source_ip LIKE '203.0.113.%' AS documentation, COUNT(*) AS n
FROM ev GROUP BY ALL"""))
def ip_classify(spark, sf_dir):
    ip = F.col("source_ip")
    return desk(spark, sf_dir).events.groupBy(ip).agg(F.count("*").alias("n")).select(
        "source_ip", net.classify(ip).alias("kind"), net.is_external(ip).alias("external"),
        net.is_documentation(ip).alias("documentation"), "n")


@query("ip_classify_built", """
WITH a AS (
  SELECT (l_orderkey % 256) || '.' || (l_partkey % 256) || '.' || (l_suppkey % 300) || '.' || l_linenumber AS ip,
         l_orderkey % 256 AS o1, l_partkey % 256 AS o2, l_suppkey % 300 AS o3
  FROM lineitem
)
SELECT CASE WHEN o3 > 255 THEN 'unknown'
            WHEN o1 = 10 OR o1 = 127 OR (o1 = 172 AND o2 BETWEEN 16 AND 31) OR (o1 = 192 AND o2 = 168)
              OR (o1 = 169 AND o2 = 254) OR (o1 = 100 AND o2 BETWEEN 64 AND 127) THEN 'internal'
            ELSE 'external' END AS kind,
       (o1 = 192 AND o2 = 0 AND o3 = 2) OR (o1 = 198 AND o2 = 51 AND o3 = 100) OR (o1 = 203 AND o2 = 0 AND o3 = 113) AS documentation,
       COUNT(*) AS n
FROM a GROUP BY ALL""")
def ip_classify_built(spark, sf_dir):
    """Classification of addresses built from the line items."""
    from eventwarden.sources.bridge import read_table

    lines = read_table(spark, sf_dir, "lineitem")
    ip = F.concat_ws(".", *[c.cast("string") for c in (
        F.col("l_orderkey") % 256, F.col("l_partkey") % 256, F.col("l_suppkey") % 300, F.col("l_linenumber"))])
    return lines.select(net.classify(ip).alias("kind"), net.is_documentation(ip).alias("documentation")).groupBy(
        "kind", "documentation").agg(F.count("*").alias("n"))


@query("event_projection", with_ev("""
SELECT 'event' AS kind, event_id AS id, us, event_type, source, host, "user", source_ip, destination_ip,
       CAST(destination_port AS BIGINT) AS destination_port, process, command_line, file_path, cloud_account, action, status, label
FROM ev"""))
def event_projection(spark, sf_dir):
    """Result row of the event dataset."""
    from eventwarden.plans.hunts import event_rows

    return event_rows(desk(spark, sf_dir).events)
