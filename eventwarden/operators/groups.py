"""Group keys and running totals that survive one hot group."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from eventwarden.operators.conditions import field

_SEPARATOR = "\u001f"


def group_parts(fields: list[str]) -> Column:
    """Case-folded key parts; a missing value stays null and forms its own group."""
    parts = []
    for name in fields:
        column, kind = field(name)
        parts.append(F.lower(column) if kind == "string" else column.cast("string"))
    return F.array(*parts).cast(T.ArrayType(T.StringType()))


def group_id(parts: Column) -> Column:
    """One text per key, null-safe, so joins and hash partitioning need no null handling."""
    marked = F.transform(parts, lambda p: F.when(p.isNull(), F.lit("~")).otherwise(F.concat(F.lit("="), p)))
    return F.array_join(marked, _SEPARATOR)


def group_text(parts: Column | str) -> Column:
    column = F.col(parts) if isinstance(parts, str) else parts
    return F.array_join(column, "|", "(none)")


def explode_rules(events: DataFrame, tagged: list[tuple[Column, Column]]) -> DataFrame:
    """One row per (event, matching rule) in a single pass.

    ``tagged`` pairs a predicate with the struct to attach; all structs share one type. The attached
    columns become top-level columns.
    """
    hits = F.array_compact(F.array(*[F.when(test, tag) for test, tag in tagged]))
    any_hit = tagged[0][0]
    for test, _ in tagged[1:]:
        any_hit = any_hit | test
    return events.filter(any_hit).withColumn("_tag", F.explode(hits)).select("*", "_tag.*").drop("_tag")


def running_totals(df: DataFrame, keys: list[str], slice_col: str, order: list, totals: dict[str, Column],
                   before: dict[str, tuple[str, Column]] | None = None,
                   through: dict[str, tuple[str, Column]] | None = None) -> DataFrame:
    """Running sums per key in event order, without putting a whole key in one task.

    Rows are summed per (key, slice) first, with map-side combine; the few slice totals of a key are
    prefix-summed; each slice then runs its own ordered window and adds its offset. The largest unit of
    sorted work is one slice of one key. ``slice_col`` must not decrease along ``order``.

    ``totals`` maps an output name to the summed column (inclusive of the row). ``before`` maps an output
    name to ``(time column, summed column)`` and counts rows strictly earlier than the row's time;
    ``through`` counts rows up to and including that time.
    """
    before, through = before or {}, through or {}
    timed = {**before, **through}
    slim = df.groupBy(*keys, slice_col).agg(
        *[F.sum(c).alias(f"_{n}") for n, c in totals.items()],
        *[F.sum(c).alias(f"_{n}") for n, (_, c) in timed.items()],
    )
    names = [*totals, *timed]
    earlier = Window.partitionBy(*keys).orderBy(slice_col).rowsBetween(Window.unboundedPreceding, -1)
    offsets = slim.select(
        *keys, slice_col, *[F.coalesce(F.sum(f"_{n}").over(earlier), F.lit(0)).alias(f"_{n}") for n in names]
    )
    inner = Window.partitionBy(*keys, slice_col).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    joined = df.join(offsets, [*keys, slice_col])
    columns = [(F.col(f"_{n}") + F.sum(c).over(inner)).alias(n) for n, c in totals.items()]
    for name, (time, c) in timed.items():
        until = Window.partitionBy(*keys, slice_col).orderBy(time).rangeBetween(
            Window.unboundedPreceding, -1 if name in before else 0
        )
        columns.append((F.col(f"_{name}") + F.coalesce(F.sum(c).over(until), F.lit(0))).alias(name))
    return joined.select(*[F.col(c) for c in df.columns], *columns)


def numbered(df: DataFrame, keys: list[str], slice_col: str, order: list, name: str) -> DataFrame:
    """Row numbers per key in order, sliced as in :func:`running_totals`."""
    return running_totals(df, keys, slice_col, order, {name: F.lit(1)})
