"""Weighted-factor anomaly scores against an account's baseline.

Input rows carry the baseline columns of :mod:`eventwarden.operators.baseline`; everything here is column
arithmetic. Each factor that contributes is kept with its weight and a sentence.
"""

from __future__ import annotations


from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from eventwarden.functions import net
from eventwarden.functions.net import let
from eventwarden.model import SEVERITIES, severity_from_rank
from eventwarden.operators.conditions import compile_selection


def off_hours(prefix: str, hour: Column, min_observations: int, params: dict) -> Column:
    """Hour outside the account's observed range, for accounts with a demonstrated schedule."""
    low, high = F.col(f"{prefix}_low"), F.col(f"{prefix}_high")
    return F.coalesce(
        (F.col(f"{prefix}_count") >= min_observations)
        & (F.col(f"{prefix}_known") >= int(params.get("min_distinct_hours", 4)))
        & (high - low <= int(params.get("max_active_span_hours", 18)))
        & ~hour.between(low, high),
        F.lit(False),
    )


def _factor(test: Column, name: str, weight: float, reason: Column) -> Column:
    return F.when(test, F.struct(
        F.lit(name).alias("name"), F.lit(float(weight)).alias("weight"), reason.alias("reason")))


def _clock(prefix: str) -> Column:
    pad = lambda c: F.lpad(F.col(c).cast("string"), 2, "0")
    return F.concat(pad(f"{prefix}_low"), F.lit(":00-"), pad(f"{prefix}_high"), F.lit(":59 UTC"))


def _verdict(factors: list[Column], rule, threshold: float) -> Column:
    """Struct of score, severity, confidence and factors where the score reaches the threshold, else null."""
    escalate = float(rule.params.get("escalate_severity_at", 0.80))
    base = SEVERITIES.index(rule.severity)
    raised = min(base + 1, len(SEVERITIES) - 1)

    def judge(found: Column) -> Column:
        total = F.aggregate(found, F.lit(0.0), lambda acc, f: acc + f["weight"])
        score = F.round(F.least(F.lit(1.0), total), 3)
        return F.when((score >= threshold) & (F.size(found) > 0), F.struct(
            F.lit(rule.id).alias("rule_id"), score.alias("anomaly_score"),
            severity_from_rank(F.when(score >= escalate, raised).otherwise(base)).alias("severity"),
            F.round(F.least(F.lit(0.95), 0.40 + score * 0.55), 3).alias("confidence"), found.alias("factors"),
        ))

    return let(F.array_compact(F.array(*factors)), judge)


def login_candidate(rule) -> Column:
    return (
        (F.col("event_type") == "authentication") & (F.col("status") == "success")
        & compile_selection(rule.selection) & (F.coalesce("user", F.lit("")) != "")
    )


def anomalous_login(rule) -> Column:
    """Verdict on a successful login that differs from the account's history on several dimensions."""
    p = rule.params
    least = int(p.get("min_observations", 8))
    ips, hosts, hours = F.col("source_ips_count"), F.col("hosts_count"), F.col("login_hours_count")
    enough = F.greatest(ips, hours, hosts) >= least
    new_ip = F.col("source_ip").isNotNull() & (ips >= least) & ~F.col("source_ips_seen")
    external = (
        new_ip & net.is_external(F.col("source_ip")) & (F.col("source_ips_known") > 0)
        & ~F.coalesce("source_ips_external", F.lit(False))
    )
    new_host = F.col("host").isNotNull() & (hosts >= least) & ~F.col("hosts_seen")
    factors = [
        _factor(new_ip, "new_source_ip", p.get("weight_new_source_ip", 0.30), F.format_string(
            "address %s is new for %s after %s logins from %s address(es)", "source_ip", "user", ips, "source_ips_known")),
        _factor(external, "external_source", p.get("weight_external_source", 0.25), F.format_string(
            "%s is the first external address of this account", "source_ip")),
        _factor(off_hours("login_hours", F.hour("timestamp"), least, p), "off_hours", p.get("weight_off_hours", 0.25),
                F.concat(F.lit("login at "), F.date_format("timestamp", "HH:mm"), F.lit(" UTC, usual hours "), _clock("login_hours"))),
        _factor(new_host, "new_host", p.get("weight_new_host", 0.20), F.format_string(
            "%s has not logged in to %s before (%s known host(s))", "user", "host", "hosts_known")),
    ]
    return F.when(enough, _verdict(factors, rule, float(p.get("threshold", 0.45))))


def cloud_candidate(rule) -> Column:
    return (
        (F.coalesce("cloud_account", F.lit("")) != "") & (F.coalesce("user", F.lit("")) != "")
        & compile_selection(rule.selection)
    )


def unusual_cloud_call(rule) -> Column:
    """Verdict on a control-plane call unlike the identity's history."""
    p = rule.params
    least = int(p.get("min_observations", 10))
    meta = lambda k: F.col(f"metadata.{k}")
    truthy = lambda c: F.coalesce(c, F.lit(False))
    risky = truthy(meta("iam_risk").isin("high", "critical"))
    new_api = (F.coalesce("action", F.lit("")) != "") & ~F.col("cloud_apis_seen")
    new_ip = F.col("source_ip").isNotNull() & (F.col("source_ips_known") > 0) & ~F.col("source_ips_seen")
    factors = [
        _factor(new_api, "new_api", p.get("weight_new_api", 0.35), F.format_string(
            "%s has not called %s in %s earlier calls (%s distinct)", "user", "action", "cloud_apis_count", "cloud_apis_known")),
        _factor(risky, "high_risk_api", p.get("weight_high_risk_api", 0.30), F.concat_ws(
            "", F.col("action"), F.lit(" is rated "), meta("iam_risk"), F.lit(" risk ("),
            F.coalesce(meta("iam_category"), F.lit("unknown")), F.lit(")"))),
        _factor(risky & truthy(meta("high_risk_policy")), "admin_policy", 0.10, F.concat_ws(
            "", F.lit("names the high-privilege policy "), meta("policy"))),
        _factor(off_hours("cloud_hours", F.hour("timestamp"), least, p), "off_hours", p.get("weight_off_hours", 0.20),
                F.concat(F.lit("call at "), F.date_format("timestamp", "HH:mm"), F.lit(" UTC, usual hours "), _clock("cloud_hours"))),
        _factor(new_ip, "new_source_ip", p.get("weight_new_source_ip", 0.20), F.format_string(
            "address %s is new for this identity (%s known)", "source_ip", "source_ips_known")),
        _factor(truthy(meta("mfa_authenticated") == F.lit(False)), "no_mfa", p.get("weight_no_mfa", 0.15),
                F.lit("the session had no second factor")),
    ]
    enough = F.col("cloud_apis_count") >= least
    return F.when(enough, _verdict(factors, rule, float(p.get("threshold", 0.50))))


DETECTORS = {
    "anomalous_authentication": (login_candidate, anomalous_login),
    "unusual_cloud_api_for_identity": (cloud_candidate, unusual_cloud_call),
}


def any_candidate(rules: list) -> Column:
    """Events any of the anomaly rules would look at."""
    tests = [DETECTORS[r.detector][0](r) for r in rules]
    out = tests[0]
    for test in tests[1:]:
        out = out | test
    return out


def anomalies(with_history: DataFrame, rules: list) -> DataFrame:
    """One row per (event, rule) whose score reaches the rule's threshold, for all rules in one pass."""
    verdicts = [F.when(DETECTORS[r.detector][0](r), DETECTORS[r.detector][1](r)) for r in rules]
    return with_history.withColumn("_v", F.explode(F.array_compact(F.array(*verdicts)))).select("*", "_v.*").drop("_v")
