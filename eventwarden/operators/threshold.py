"""Count-in-window detection with optional distinctness, for many rules in one job.

The answer per group is the earliest event ``r`` whose window ``[r - W, r]`` holds at least N events and,
when asked, at least K distinct values; the evidence is every event from the window's first event up to
W later.

Time is cut into cells of width W, so a window touches one cell and the one before it. Of a cell only
these rows can decide the answer:

* the first N and the last N rows (they settle every count up to N),
* the first row of the K earliest-appearing values and the last row of the K latest-appearing values.

That thinning is exact and bounds a cell to ``2N + 2K`` rows. It runs first on salted cells, so a group
holding a third of all rows is spread over all tasks, then on the merged cells. Before it, cells that no
window of N rows can touch are left out by their counts: in most groups no window comes near N.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from eventwarden.model import micros
from eventwarden.operators.conditions import compile_selection, field
from eventwarden.operators.groups import explode_rules, group_id, group_parts
from eventwarden.session import shuffle_width, stage


@dataclass(frozen=True)
class ThresholdSpec:
    """What one rule asks for; ``rule`` is any object with ``id``, ``selection`` and ``group_by``."""

    rule: object
    count: int
    window_seconds: int
    distinct_field: str | None = None
    distinct_count: int | None = None


def _value(spec: ThresholdSpec) -> Column:
    if not spec.distinct_field:
        return F.lit(None).cast("string")
    column, _ = field(spec.distinct_field)
    return F.lower(column.cast("string"))


def matching_rows(events: DataFrame, specs: list[ThresholdSpec]) -> DataFrame:
    """Events matching a rule's selection, tagged with group, window and limits."""
    tagged = []
    for spec in specs:
        parts = group_parts(list(spec.rule.group_by))
        tagged.append((compile_selection(spec.rule.selection), F.struct(
            F.lit(spec.rule.id).alias("rule_id"),
            parts.alias("group_key"),
            group_id(parts).alias("g"),
            micros().alias("us"),
            _value(spec).alias("d"),
            F.lit(spec.window_seconds * 1_000_000).cast("bigint").alias("w"),
            F.lit(spec.count).alias("n"),
            F.lit(spec.distinct_count if spec.distinct_field else None).cast("int").alias("kd"),
        )))
    return explode_rules(events, tagged)


def _thin(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Rows of each cell that can decide the answer; see the module text."""
    whole = Window.partitionBy(*keys)
    forward = whole.orderBy("us", "event_id")
    running = forward.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    of_value = Window.partitionBy(*keys, "d")
    has_value = F.col("d").isNotNull() & F.col("kd").isNotNull()
    # ranks from the end follow from the totals, so one order per value and one per cell are enough
    marked = (
        rows.withColumn("_vn", F.row_number().over(of_value.orderBy("us", "event_id")))
        .withColumn("_opens", ((F.col("_vn") == 1) & has_value).cast("int"))
        .withColumn("_closes", ((F.col("_vn") == F.count("*").over(of_value)) & has_value).cast("int"))
        .withColumn("_first", F.row_number().over(forward))
        .withColumn("_open_rank", F.sum("_opens").over(running))
        .withColumn("_closed", F.sum("_closes").over(running))
        .withColumn("_last", F.count("*").over(whole) - F.col("_first") + 1)
        .withColumn("_close_rank", F.sum("_closes").over(whole) - F.col("_closed") + F.col("_closes"))
    )
    keep = (
        (F.col("_first") <= F.col("n"))
        | (F.col("kd").isNotNull() & (F.col("_last") <= F.col("n")))
        | ((F.col("_opens") == 1) & (F.col("_open_rank") <= F.col("kd")))
        | ((F.col("_closes") == 1) & (F.col("_close_rank") <= F.col("kd")))
    )
    return marked.filter(keep).select(*rows.columns)


def crowded(rows: DataFrame) -> DataFrame:
    """Rows of the cells a window of N rows can touch: a cell that holds N together with the one before, and that one."""
    cells = rows.select("rule_id", "g", "n", F.explode(F.array("cell", F.col("cell") + 1)).alias("cell"))
    full = cells.groupBy("rule_id", "g", "cell", "n").agg(F.count("*").alias("held")).filter("held >= n")
    touched = full.select("rule_id", "g", F.explode(F.array("cell", F.col("cell") - 1)).alias("cell")).distinct()
    return rows.join(touched, ["rule_id", "g", "cell"], "left_semi")


def earliest_hits(rows: DataFrame) -> DataFrame:
    """Per (rule, group), the time of the earliest event that completes a window."""
    salts = shuffle_width(rows.sparkSession)
    slim = crowded(rows.select(
        "rule_id", "g", F.expr("us div w").alias("cell"), "us", "event_id", "d", "w", "n", "kd",
        F.pmod(F.xxhash64("event_id"), F.lit(salts)).alias("salt"),
    ))
    spread = _thin(slim, ["rule_id", "g", "cell", "salt"])
    merged = _thin(spread.drop("salt"), ["rule_id", "g", "cell"])
    # At most 2N + 2K rows per cell from here on. A row goes to its cell and, as context, to the next by its number: no
    # group is put in order, and the rows are made once.
    seat = lambda cell, own: F.struct(cell.alias("cell"), F.lit(own).alias("own"))
    placed = merged.withColumn("_seat", F.explode(F.array(seat(F.col("cell"), True), seat(F.col("cell") + 1, False))))
    cells = placed.groupBy("rule_id", "g", F.col("_seat.cell").alias("cell")).agg(
        F.first("w").alias("w"), F.first("n").alias("n"), F.first("kd").alias("kd"),
        F.collect_list(F.when(F.col("_seat.own"), F.struct("us", "d"))).alias("cur"),
        F.collect_list(F.struct("us", "d")).alias("ctx"),
    )

    def completes(r: Column) -> Column:
        inside = F.filter("ctx", lambda x: (x["us"] >= r["us"] - F.col("w")) & (x["us"] <= r["us"]))
        values = F.array_distinct(F.array_compact(F.transform(inside, lambda x: x["d"])))
        return (F.size(inside) >= F.col("n")) & (F.col("kd").isNull() | (F.size(values) >= F.col("kd")))

    hit = F.array_min(F.transform(F.filter("cur", completes), lambda r: r["us"]))
    return (
        cells.filter(F.size("ctx") >= F.col("n"))
        .select("rule_id", "g", hit.alias("hit_us"))
        .groupBy("rule_id", "g")
        .agg(F.min("hit_us").alias("hit_us"))
        .filter("hit_us IS NOT NULL")
    )


TAGS = ["rule_id", "group_key", "g", "us", "d", "w", "n", "kd"]


def threshold_evidence(events: DataFrame, specs: list[ThresholdSpec], keep: list[Column] | None = None) -> DataFrame:
    """Every event of each group's first qualifying window, with the rule's tag columns.

    Output is the event's columns, or those of ``keep``, plus ``TAGS``. No other column is joined, sorted or written. The
    joins are keyed by group against one row per group, so an oversized group is split by adaptive skew handling.
    """
    rows = matching_rows(events, specs)
    if keep is not None:
        # narrow by now, and read three times below
        rows = stage(rows.select(*keep, *TAGS), "matching")
    # written, so that the join below knows their size and few hits do not send all rows through a shuffle
    hits = stage(earliest_hits(rows), "hits")
    # events around the first hits only; read twice below, so they are written once
    near = stage(rows.join(hits, ["rule_id", "g"]).filter(
        F.col("us").between(F.col("hit_us") - F.col("w"), F.col("hit_us") + F.col("w"))
    ), "near")
    starts = near.filter("us <= hit_us").groupBy("rule_id", "g").agg(F.min("us").alias("start_us"))
    return (
        near.join(starts, ["rule_id", "g"])
        .filter(F.col("us").between(F.col("start_us"), F.col("start_us") + F.col("w")))
        .drop("hit_us", "start_us")
    )


def gate_new(evidence: DataFrame, keys: list[str], is_new: Column) -> DataFrame:
    """Keep only detections with at least one event of the current batch in their evidence."""
    fresh = evidence.filter(is_new).select(*keys).distinct()
    return evidence.join(fresh, keys, "left_semi")
