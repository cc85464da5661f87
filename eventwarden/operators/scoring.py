"""Risk, confidence and ranking scores; every term is kept beside the total."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from eventwarden.model import severity_weight

# Weights and saturation points.
RISK_WEIGHTS = {
    "severity": 0.30, "confidence": 0.20, "asset": 0.15, "behavioural": 0.15, "indicator": 0.10, "correlation": 0.10,
}
BEHAVIOUR_FLAGS = {
    "uid_zero": (1.00, "account created with UID 0"),
    "high_risk_policy": (0.95, "high-privilege cloud policy named"),
    "privileged_group": (0.85, "privileged group changed"),
    "persistence_path": (0.80, "autostart location written"),
    "setuid": (0.80, "setuid bit set"),
    "elevated": (0.55, "privileges raised"),
    "internal_lateral_candidate": (0.60, "internal remote-admin connection"),
    "sensitive_file": (0.65, "credential file touched"),
    "invalid_user": (0.35, "login to an unknown account"),
    "outbound_external": (0.30, "outbound external connection"),
}
CORRELATION_SATURATION = 20
TACTIC_SATURATION = 5
UNKNOWN_ASSET = 0.40
CONFIDENCE_WEIGHTS = {
    "detection_confidence": 0.30, "evidence_volume": 0.20, "entity_consistency": 0.15,
    "temporal_consistency": 0.15, "technique_breadth": 0.15, "indicator_corroboration": 0.05,
}
MAX_CONFIDENCE = 0.98
VOLUME_SATURATION = 25
COHESIVE_GAP_SECONDS = 3600
IDENTITY_WEIGHTS = {
    "privilege_operations": 0.30, "denied_attempts": 0.20, "no_mfa": 0.15, "external_sources": 0.15,
    "defense_evasion": 0.20,
}
SIMILARITY_WEIGHTS = {"techniques": 0.45, "rules": 0.30, "entities": 0.15, "severity": 0.10}


def clamp(value: Column) -> Column:
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), value.cast("double")))


def _term(factor: str, value: Column) -> Column:
    weight = RISK_WEIGHTS[factor]
    bounded = clamp(value)
    return F.struct(
        F.lit(factor).alias("factor"), F.lit(weight).alias("weight"), F.round(bounded, 3).alias("value"),
        F.round(bounded * weight * 100, 2).alias("contribution"),
    )


def asset_value(criticality: Column, privileged: Column) -> Column:
    base = F.coalesce(criticality / 5.0, F.lit(UNKNOWN_ASSET))
    return F.when(privileged, F.least(F.lit(1.0), base + 0.15)).otherwise(base)


def behaviour_value(flags: Column, anomaly: Column) -> Column:
    """Strongest flag on the evidence, or the anomaly score when higher."""
    weights = [
        F.when(F.coalesce(F.array_contains(flags, name), F.lit(False)), F.lit(weight)).otherwise(F.lit(0.0))
        for name, (weight, _) in BEHAVIOUR_FLAGS.items()
    ]
    return F.greatest(*weights, F.coalesce(anomaly, F.lit(0.0)))


def indicator_value(count: Column, confidence: Column) -> Column:
    best = F.when(F.coalesce(confidence, F.lit(0.0)) != 0, confidence).otherwise(F.lit(0.6))
    return F.when(count == 0, F.lit(0.0)).otherwise(F.least(F.lit(1.0), best))


def correlation_value(events: Column, tactics: Column) -> Column:
    volume = F.log1p(F.greatest(F.lit(0), events).cast("double")) / F.lit(math.log1p(CORRELATION_SATURATION))
    breadth = F.least(F.lit(1.0), tactics / F.lit(float(TACTIC_SATURATION)))
    return 0.55 * volume + 0.45 * F.coalesce(breadth, F.lit(0.0))


def with_risk(df: DataFrame, *, severity: Column, confidence: Column, criticality: Column, privileged: Column,
              flags: Column, anomaly: Column, ioc_count: Column, ioc_confidence: Column, events: Column,
              tactics: Column, alerts: Column) -> DataFrame:
    """Adds ``risk_breakdown`` (six terms) and ``risk_score`` (their sum, one decimal, at most 100)."""
    terms = F.array(
        _term("severity", severity_weight(severity)),
        _term("confidence", confidence),
        _term("asset", asset_value(criticality, privileged)),
        _term("behavioural", behaviour_value(flags, anomaly)),
        _term("indicator", indicator_value(ioc_count, ioc_confidence)),
        _term("correlation", correlation_value(events, tactics)),
    )
    out = df.withColumn("risk_breakdown", terms)
    total = F.aggregate("risk_breakdown", F.lit(0.0), lambda acc, t: acc + t["contribution"])
    return out.withColumn("risk_score", F.round(F.least(F.lit(100.0), F.greatest(F.lit(0.0), F.round(total, 6))), 1))


def with_confidence(df: DataFrame, *, mean_confidence: Column, alerts: Column, events: Column, top_entity: Column,
                    largest_gap_us: Column, tactics: Column, iocs: Column) -> DataFrame:
    """Adds ``confidence_breakdown`` and ``confidence``: how sure we are the alerts are one attack.

    ``top_entity`` is the number of alerts touching the most common entity (null when none is known);
    ``largest_gap_us`` the largest gap between consecutive alerts (null for a single alert).
    """
    volume = F.log1p(F.greatest(F.lit(0), events).cast("double")) / F.lit(math.log1p(VOLUME_SATURATION))
    consistency = (
        F.when(top_entity.isNull(), F.lit(0.0)).when(alerts <= 1, F.lit(0.5)).otherwise(top_entity / alerts)
    )
    temporal = F.when(largest_gap_us.isNull(), F.lit(0.5)).otherwise(
        F.greatest(F.lit(0.0), 1.0 - (largest_gap_us / 1e6) / F.lit(float(COHESIVE_GAP_SECONDS))))
    values = {
        "detection_confidence": mean_confidence,
        "evidence_volume": volume,
        "entity_consistency": consistency,
        "temporal_consistency": temporal,
        "technique_breadth": F.least(F.lit(1.0), tactics / 5.0),
        "indicator_corroboration": F.when(iocs > 0, F.lit(1.0)).otherwise(F.lit(0.0)),
    }
    terms = F.array(*[
        F.struct(F.lit(name).alias("factor"), F.lit(CONFIDENCE_WEIGHTS[name]).alias("weight"),
                 F.round(clamp(value), 3).alias("value"), (clamp(value) * CONFIDENCE_WEIGHTS[name]).alias("contribution"))
        for name, value in values.items()
    ])
    out = df.withColumn("confidence_breakdown", terms)
    total = F.aggregate("confidence_breakdown", F.lit(0.0), lambda acc, t: acc + t["contribution"])
    return out.withColumn("confidence", F.round(F.round(F.least(F.lit(MAX_CONFIDENCE), total), 9), 3))


def identity_terms(calls: Column, privilege: Column, denied: Column, no_mfa: Column, external: Column,
                   evasion: Column) -> Column:
    """Five weighted terms of a cloud identity's risk."""
    values = {
        "privilege_operations": F.least(F.lit(1.0), privilege / 2.0),
        "denied_attempts": F.least(F.lit(1.0), denied / 3.0),
        "no_mfa": F.when(calls > 0, no_mfa / calls).otherwise(F.lit(0.0)),
        "external_sources": F.least(F.lit(1.0), external / 2.0),
        "defense_evasion": F.when(evasion > 0, F.lit(1.0)).otherwise(F.lit(0.0)),
    }
    return F.array(*[
        F.struct(F.lit(name).alias("factor"), F.lit(IDENTITY_WEIGHTS[name]).alias("weight"),
                 F.round(clamp(value), 3).alias("value"), (clamp(value) * IDENTITY_WEIGHTS[name] * 100).alias("contribution"))
        for name, value in values.items()
    ])


def sum_terms(terms: str, digits: int) -> Column:
    total = F.aggregate(terms, F.lit(0.0), lambda acc, t: acc + t["contribution"])
    return F.round(F.round(F.least(F.lit(100.0), total), 9), digits)
