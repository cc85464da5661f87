"""Exact ranks and medians without collecting a column into one task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from eventwarden.operators.groups import running_totals


def value_ranks(df: DataFrame, keys: list[str], value: str, slice_width: int) -> DataFrame:
    """``(keys, value, n, upto, total)``: how many values are at most this one, per key.

    Equal values are counted together first; the counts are prefix-summed slice by slice.
    """
    counts = df.filter(F.col(value).isNotNull()).groupBy(*keys, value).agg(F.count("*").alias("n")).withColumn(
        "_slice", F.floor(F.col(value) / F.lit(slice_width)))
    ranked = running_totals(counts, keys, "_slice", [value], {"upto": F.col("n")})
    totals = counts.groupBy(*keys).agg(F.sum("n").alias("total"))
    return ranked.join(totals, keys).drop("_slice")


def at_rank(rank: Column, value: str) -> Column:
    """Aggregate: the value holding the zero-based rank."""
    return F.min(F.when(F.col("upto") > rank, F.col(value)))


def order_statistics(df: DataFrame, keys: list[str], value: str, slice_width: int) -> DataFrame:
    """Per key: count, median, mean, nearest-rank 95th percentile, minimum and maximum."""
    ranked = value_ranks(df, keys, value, slice_width)
    last = F.col("total") - 1
    low, high = at_rank(F.floor(last / 2), value), at_rank(F.ceil(last / 2), value)
    p95 = at_rank(F.bround(F.lit(0.95) * last, 0), value)
    out = ranked.groupBy(*keys).agg(
        F.max("total").alias("count"), low.alias("_low"), high.alias("_high"), p95.alias("p95"),
        F.sum(F.col(value).cast("double") * F.col("n")).alias("_sum"), F.min(value).alias("min"), F.max(value).alias("max"),
    )
    return out.select(
        *keys, "count", ((F.col("_low") + F.col("_high")) / 2.0).alias("median"), (F.col("_sum") / F.col("count")).alias("mean"),
        "p95", "min", "max")
