"""Ordered multi-step detection for many rules in one job.

A match is greedy from an anchor (any event of the first step): each step takes its next ``min_count``
events after the previous step's last event, inside the window and the step's gap. The answer per group
is the earliest anchor whose match completes.

Each event carries running counts ``c_k`` of the events matching step k so far in its group. The events of
step k are then addressed by ordinal, and "the next m events of step k after this one" is the equi-join
``ordinal = c_k + m`` -- a unique key per row, so no join here depends on the size of a group. The counts
themselves come from :func:`running_totals`, which sorts slices of a group, never a whole one.

The evidence of a step is every event of that step from its first event's time up to the next step's
start, which is one contiguous ordinal range.
"""

from __future__ import annotations

from dataclasses import dataclass, field as dc_field
from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from eventwarden.model import micros
from eventwarden.operators.conditions import compile_selection, field
from eventwarden.operators.groups import explode_rules, group_id, group_parts, running_totals
from eventwarden.session import stage

SLICES_PER_WINDOW = 16


@dataclass(frozen=True)
class StepSpec:
    name: str
    test: Column
    min_count: int = 1
    max_gap_seconds: int | None = None
    optional: bool = False


@dataclass(frozen=True)
class SequenceSpec:
    rule_id: str
    steps: tuple[StepSpec, ...]
    window_seconds: int
    parts: Column
    constraints: tuple[tuple[str, int], ...] = dc_field(default_factory=tuple)
    scope: Column | None = None
    expand: bool = True


def rule_sequence(rule) -> SequenceSpec:
    """The spec of a sequence rule of the pack."""
    steps = tuple(
        StepSpec(s.name, compile_selection(s.selection), s.min_count, s.max_gap_seconds, s.optional)
        for s in rule.steps
    )
    return SequenceSpec(rule.id, steps, rule.window_seconds, group_parts(list(rule.group_by)), rule.constraints)


def _depth(specs: list[SequenceSpec]) -> int:
    return max(len(s.steps) for s in specs)


def _tag(spec: SequenceSpec, depth: int, checks: int) -> tuple[Column, Column]:
    tests = [F.coalesce(s.test, F.lit(False)) for s in spec.steps]
    any_step = reduce(or_, tests)
    if spec.scope is not None:
        any_step = any_step & spec.scope
    flags = [
        (tests[k] if k < len(tests) else F.lit(False)).cast("int").alias(f"s{k}") for k in range(depth)
    ]
    values = []
    for i in range(checks):
        value = F.lit(None).cast("string")
        if i < len(spec.constraints):
            value = F.lower(field(spec.constraints[i][0])[0].cast("string"))
        values.append(value.alias(f"v{i}"))
    slice_us = max(1_000_000, spec.window_seconds * 1_000_000 // SLICES_PER_WINDOW)
    return any_step, F.struct(
        F.lit(spec.rule_id).alias("rule_id"), spec.parts.alias("group_key"), group_id(spec.parts).alias("g"),
        micros().alias("us"), F.floor(micros() / F.lit(slice_us)).alias("slice"), *flags, *values,
    )


def step_rows(events: DataFrame, specs: list[SequenceSpec]) -> DataFrame:
    """Events matching any step of a rule, tagged with group, step flags and checked values."""
    depth, checks = _depth(specs), max(len(s.constraints) for s in specs)
    return explode_rules(events, [_tag(s, depth, checks) for s in specs])


def _by_rule(specs: list[SequenceSpec], pick, kind: str) -> Column:
    """A per-rule parameter as a column."""
    expr = F.lit(None).cast(kind)
    for spec in specs:
        value = pick(spec)
        if value is not None:
            expr = F.when(F.col("rule_id") == spec.rule_id, F.lit(value).cast(kind)).otherwise(expr)
    return expr


def _step(spec: SequenceSpec, k: int) -> StepSpec | None:
    return spec.steps[k] if k < len(spec.steps) else None


def counted_rows(rows: DataFrame, depth: int) -> DataFrame:
    """Tagged rows with, per step, the running count ``c``, the count strictly earlier in time ``b`` and
    the count up to and including this time ``a``."""
    slim = rows.select("rule_id", "g", "us", "slice", "event_id", *[f"s{k}" for k in range(depth)])
    counted = running_totals(
        slim, ["rule_id", "g"], "slice", ["us", "event_id"],
        totals={f"c{k}": F.col(f"s{k}") for k in range(depth)},
        before={f"b{k}": ("us", F.col(f"s{k}")) for k in range(depth)},
        through={f"a{k}": ("us", F.col(f"s{k}")) for k in range(depth)},
    )
    return stage(counted, "steps")


def _step_table(counted: DataFrame, k: int, depth: int, prefix: str) -> DataFrame:
    """Rows of step k addressed by ordinal, columns prefixed."""
    keep = ["us", "event_id", f"a{k}", *[f"c{i}" for i in range(depth)], *[f"b{i}" for i in range(depth)]]
    return counted.filter(F.col(f"s{k}") == 1).select(
        F.col("rule_id"), F.col("g"), F.col(f"c{k}").alias(f"{prefix}_ord"),
        *[F.col(c).alias(f"{prefix}_{c}") for c in keep],
    )


def _lookup(state: DataFrame, table: DataFrame, prefix: str, ordinal: Column, how: str) -> DataFrame:
    keyed = state.withColumn(f"{prefix}_ord", ordinal)
    return keyed.join(table, ["rule_id", "g", f"{prefix}_ord"], how)


def complete_matches(counted: DataFrame, specs: list[SequenceSpec]) -> DataFrame:
    """One row per anchor whose greedy match completes.

    Columns: ``rule_id, g, anchor_us, anchor_id`` and per step k ``ok{k}`` (the step matched), its first
    and last ordinals ``lo{k}, hi{k}``, first time ``f{k}_us``, last time ``l{k}_us`` and, at the step's
    first event, the strictly-earlier counts ``f{k}_b*``.
    """
    depth = _depth(specs)
    window = _by_rule(specs, lambda s: s.window_seconds * 1_000_000, "bigint")
    need = [
        _by_rule(specs, lambda s, k=k: _step(s, k).min_count if _step(s, k) else None, "int") for k in range(depth)
    ]
    gap = [
        _by_rule(
            specs,
            lambda s, k=k: _step(s, k).max_gap_seconds * 1_000_000
            if _step(s, k) and _step(s, k).max_gap_seconds else None,
            "bigint",
        ) for k in range(depth)
    ]
    optional = [
        F.coalesce(_by_rule(specs, lambda s, k=k: _step(s, k).optional if _step(s, k) else None, "boolean"), F.lit(True))
        for k in range(depth)
    ]
    multi = [any(_step(s, k) and _step(s, k).min_count > 1 for s in specs) for k in range(depth)]
    loose = [any(_step(s, k) is None or _step(s, k).optional for s in specs) for k in range(depth)]

    state = _step_table(counted, 0, depth, "f0").select(
        "*", F.col("f0_us").alias("anchor_us"), F.col("f0_event_id").alias("anchor_id"),
    ).withColumn("w", window)
    # the cursor sits just before the anchor, so step 0 is handled like every other step
    state = state.select("*", F.col("f0_us").alias("prev_us"), *[
        (F.col(f"f0_c{i}") - F.lit(1 if i == 0 else 0)).alias(f"cur{i}") for i in range(depth)
    ])
    for k in range(depth):
        how = "left" if loose[k] else "inner"
        first, last = f"f{k}", f"l{k}"
        if k:
            state = _lookup(state, _step_table(counted, k, depth, first), first, F.col(f"cur{k}") + 1, how)
        if multi[k]:
            state = _lookup(state, _step_table(counted, k, depth, last), last, F.col(f"cur{k}") + need[k], how)
        else:
            state = state.select("*", *[
                F.col(f"{first}_{c}").alias(f"{last}_{c}")
                for c in ["ord", "us", "event_id", f"a{k}", *[f"c{i}" for i in range(depth)]]
            ])
        inside = (
            (F.col(f"{last}_us") - F.col("anchor_us") <= F.col("w"))
            & (gap[k].isNull() | (F.col(f"{last}_us") - F.col("prev_us") <= gap[k]))
        )
        ok = F.coalesce(inside & F.col(f"{last}_us").isNotNull() & need[k].isNotNull(), F.lit(False))
        state = state.withColumn(f"ok{k}", ok).filter(F.col(f"ok{k}") | optional[k])
        cursor = [F.col(f"{last}_c{i}") for i in range(depth)]
        partial = [F.col(f"cur{i}") for i in range(depth)]
        if loose[k] and multi[k]:
            state, partial = _partial_cursor(state, counted, k, depth, need[k], gap[k])
        state = state.select(
            *[c for c in state.columns if not c.startswith(("cur", "prev_us", f"{last}_c", f"{last}_b", "p_"))],
            F.when(F.col(f"ok{k}"), F.col(f"{last}_us")).otherwise(F.col("prev_us")).alias("prev_us"),
            *[F.when(F.col(f"ok{k}"), c).otherwise(p).alias(f"cur{i}")
              for i, (c, p) in enumerate(zip(cursor, partial))],
        )
    matched_any = reduce(or_, [F.col(f"ok{k}") for k in range(depth)])
    return state.filter(matched_any)


def _partial_cursor(state: DataFrame, counted: DataFrame, k: int, depth: int, need: Column, gap: Column):
    """Cursor after an optional step that found some but too few events: at the last one found."""
    table = _step_table(counted, k, depth, "p")
    tries = state.filter(~F.col(f"ok{k}") & need.isNotNull()).select(
        "rule_id", "g", "anchor_us", "anchor_id", "w", "prev_us", F.col(f"cur{k}").alias("base"),
        F.explode(F.sequence(F.lit(1), F.greatest(need - 1, F.lit(1)))).alias("j"), gap.alias("gap"),
    ).withColumn("p_ord", F.col("base") + F.col("j")).join(table, ["rule_id", "g", "p_ord"])
    tries = tries.filter(
        (F.col("p_us") - F.col("anchor_us") <= F.col("w"))
        & (F.col("gap").isNull() | (F.col("p_us") - F.col("prev_us") <= F.col("gap")))
    )
    reached = tries.groupBy("rule_id", "g", "anchor_us", "anchor_id").agg(
        F.max_by(F.struct(*[f"p_c{i}" for i in range(depth)]), "p_ord").alias("p_reached")
    )
    joined = state.join(reached, ["rule_id", "g", "anchor_us", "anchor_id"], "left")
    return joined, [
        F.coalesce(F.col(f"p_reached.p_c{i}"), F.col(f"cur{i}")) for i in range(depth)
    ]


def evidence_ranges(matches: DataFrame, depth: int, expand: bool = True) -> DataFrame:
    """Ordinal range ``[lo, hi]`` of each matched step, one row per (anchor, step).

    With ``expand`` a step claims its events from its first event's time up to the next matched step's
    start (the last step: up to its own last event's time); without, only the events it collected.
    """
    rows = []
    for k in range(depth):
        later = [F.when(F.col(f"ok{j}"), F.col(f"f{j}_b{k}")) for j in range(k + 1, depth)]
        next_hi = F.coalesce(*later) if later else F.lit(None).cast("bigint")
        rows.append(F.when(F.col(f"ok{k}"), F.struct(
            F.lit(k).alias("step"),
            F.col(f"f{k}_ord").alias("first_ord"), F.col(f"l{k}_ord").alias("last_ord"),
            (F.col(f"f{k}_b{k}") + 1).alias("lo"), next_hi.alias("hi"), F.col(f"l{k}_a{k}").alias("end"),
        )))
    ranges = matches.select(
        "rule_id", "g", "anchor_us", "anchor_id", F.explode(F.array_compact(F.array(*rows))).alias("r")
    ).select("rule_id", "g", "anchor_us", "anchor_id", "r.*")
    if not expand:
        return ranges.select(
            "rule_id", "g", "anchor_us", "anchor_id", "step",
            F.col("first_ord").alias("lo"), F.col("last_ord").alias("hi"),
        )
    hi = F.coalesce("hi", "end")
    empty = hi < F.col("lo")
    return ranges.select(
        "rule_id", "g", "anchor_us", "anchor_id", "step",
        F.when(empty, F.col("first_ord")).otherwise(F.col("lo")).alias("lo"),
        F.when(empty, F.col("last_ord")).otherwise(hi).alias("hi"),
    )


def _check_distinct(matches: DataFrame, rows: DataFrame, specs: list[SequenceSpec],
                    index: int, depth: int) -> DataFrame:
    """Anchors whose evidence spans enough distinct values of one checked field.

    For two values the ends of each range decide: a range holds one value exactly when its first and last
    non-null rows agree and the value's own running count covers the whole range. No range is expanded.
    Larger limits expand the ranges.
    """
    checked = [s for s in specs if len(s.constraints) > index]
    limits = _by_rule(checked, lambda s: s.constraints[index][1], "int")
    ids = [s.rule_id for s in checked]
    value = f"v{index}"
    subject = matches.filter(F.col("rule_id").isin(ids))
    others = matches.filter(~F.col("rule_id").isin(ids))
    ranges = evidence_ranges(subject, depth)
    keys = ["rule_id", "g", "anchor_us", "anchor_id"]

    members = rows.filter(F.col("rule_id").isin(ids)).select(
        "rule_id", "g", "us", "slice", "event_id", F.col(value).alias("v"),
        F.explode(F.array_compact(F.array(*[F.when(F.col(f"s{k}") == 1, F.lit(k)) for k in range(depth)]))).alias("step"),
    )
    known = members.withColumn("known", F.col("v").isNotNull().cast("int"))
    per_step = stage(running_totals(
        known, ["rule_id", "g", "step"], "slice", ["us", "event_id"],
        totals={"ord": F.lit(1), "nord": F.col("known")},
    ), "values")
    if all(s.constraints[index][1] <= 2 for s in checked):
        # ordinals among the rows with a value, at both ends of each range
        at = per_step.select("rule_id", "g", "step", "ord", "nord", "known")
        lows = at.select("rule_id", "g", "step", F.col("ord").alias("lo"),
                         (F.col("nord") - F.col("known") + 1).alias("nlo"))
        highs = at.select("rule_id", "g", "step", F.col("ord").alias("hi"), F.col("nord").alias("nhi"))
        bounded = ranges.join(lows, ["rule_id", "g", "step", "lo"]).join(highs, ["rule_id", "g", "step", "hi"])
        bounded = bounded.filter("nhi >= nlo")
        valued = per_step.filter("known = 1").withColumn("vg", F.concat_ws("\u001f", "g", "v"))
        repeats = running_totals(
            valued, ["rule_id", "step", "vg"], "slice", ["us", "event_id"], totals={"seen": F.lit(1)},
        ).select("rule_id", "g", "step", "nord", "v", "seen")
        first = repeats.select("rule_id", "g", "step", F.col("nord").alias("nlo"), F.col("v").alias("v_lo"),
                               F.col("seen").alias("seen_lo"))
        last = repeats.select("rule_id", "g", "step", F.col("nord").alias("nhi"), F.col("v").alias("v_hi"),
                              F.col("seen").alias("seen_hi"))
        ended = bounded.join(first, ["rule_id", "g", "step", "nlo"]).join(last, ["rule_id", "g", "step", "nhi"])
        uniform = (F.col("v_lo") == F.col("v_hi")) & (
            F.col("seen_hi") - F.col("seen_lo") == F.col("nhi") - F.col("nlo")
        )
        passing = ended.groupBy(*keys).agg(
            F.bool_and(uniform).alias("uniform"), F.min("v_lo").alias("low"), F.max("v_lo").alias("high"),
        ).filter("NOT uniform OR low <> high").select(*keys)
    else:
        spread = ranges.join(per_step.filter("known = 1"), ["rule_id", "g", "step"]).filter("ord BETWEEN lo AND hi")
        passing = (
            spread.groupBy(*keys).agg(F.count_distinct("v").alias("values"))
            .withColumn("limit", limits).filter("values >= limit").select(*keys)
        )
    return subject.join(passing, keys, "left_semi").unionByName(others)


def first_matches(rows: DataFrame, specs: list[SequenceSpec], counted: DataFrame | None = None) -> DataFrame:
    """Per (rule, group), the match from the earliest anchor that completes and passes its constraints."""
    depth = _depth(specs)
    counted = counted_rows(rows, depth) if counted is None else counted
    matches = complete_matches(counted, specs)
    for index in range(max(len(s.constraints) for s in specs)):
        matches = _check_distinct(stage(matches, "matches"), rows, specs, index, depth)
    body = [c for c in matches.columns if c not in ("rule_id", "g")]
    return matches.groupBy("rule_id", "g").agg(
        F.min_by(F.struct(*body), F.struct("anchor_us", "anchor_id")).alias("m")
    ).select("rule_id", "g", "m.*")


def sequence_evidence(events: DataFrame, specs: list[SequenceSpec], keep: list[Column] | None = None) -> DataFrame:
    """Evidence rows of each group's first match: event columns, or those of ``keep`` (``event_id`` among them), plus
    ``rule_id, group_key, g, us, step, step_index``. An event is listed once per match, under the first step that claims
    it."""
    depth = _depth(specs)
    rows = step_rows(events, specs)
    marks = [f"s{k}" for k in range(depth)] + ["slice"] + [c for c in rows.columns if c.startswith("v") and c[1:].isdigit()]
    if keep is not None:
        # narrow by now, and read by every step below
        rows = stage(rows.select(*keep, "rule_id", "group_key", "g", "us", *marks), "tagged")
    counted = counted_rows(rows, depth)
    best = first_matches(rows, specs, counted)
    ranges = evidence_ranges(best, depth, expand=all(s.expand for s in specs))
    names = F.lit(None).cast("string")
    for spec in specs:
        for k, step in enumerate(spec.steps):
            names = F.when((F.col("rule_id") == spec.rule_id) & (F.col("step") == k), step.name).otherwise(names)
    per_step = counted.select("rule_id", "g", "event_id", F.explode(F.array(*[
        F.struct(F.lit(k).alias("step"), F.when(F.col(f"s{k}") == 1, F.col(f"c{k}")).alias("ord")) for k in range(depth)
    ])).alias("x")).select("rule_id", "g", "event_id", "x.step", "x.ord").filter("ord IS NOT NULL")
    chosen = (
        per_step.join(ranges, ["rule_id", "g", "step"]).filter("ord BETWEEN lo AND hi")
        .groupBy("rule_id", "g", "event_id").agg(F.min("step").alias("step"))
    )
    return (
        rows.drop(*marks).join(chosen, ["rule_id", "g", "event_id"])
        .withColumn("step_index", F.col("step")).withColumn("step", names)
    )
