"""Single-event detection: every match rule in one pass over the events."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from eventwarden.operators.conditions import compile_selection
from eventwarden.operators.groups import explode_rules, group_parts


def match_rules(events: DataFrame, rules: list) -> DataFrame:
    """One row per (event, rule): the event's columns plus ``rule_id`` and ``group_key``.

    A rule without a grouping groups by the event itself.
    """
    tagged = []
    for rule in rules:
        key = group_parts(list(rule.group_by)) if rule.group_by else F.array(F.col("event_id"))
        tagged.append((
            compile_selection(rule.selection),
            F.struct(F.lit(rule.id).alias("rule_id"), key.alias("group_key")),
        ))
    return explode_rules(events, tagged)
