"""Connected components of a graph of long ids by contraction.

Each round every vertex moves to its neighbour of smallest rank (its own included; ranks are drawn anew each round), vertices
that moved to the same place become one, and links between what is left go on. Components without links left are done and
take no part in later rounds, so rounds shrink by a constant factor whatever a component's shape: a path of n vertices
takes O(log n) of them. At the end the moves are put together backwards, smallest table first. Links of a round are removed
when the next round's are written.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from eventwarden.llm.jobs import staged
from eventwarden.session import release


def labelled(links: DataFrame) -> DataFrame:
    """(id, label) for every id in ``links`` (a, b): one label per component, the smallest id in it."""
    pairs = staged(links.select("a", "b").union(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
                   .filter("a <> b").distinct(), "pairs")
    moves: list[DataFrame] = []
    while not pairs.isEmpty():
        rank = lambda c: F.struct(F.xxhash64(F.col(c), F.lit(len(moves))).alias("rank"), F.col(c).alias("id"))  # noqa: E731, B023
        near = pairs.groupBy("a").agg(F.min(rank("b")).alias("near"))
        moved = staged(near.select("a", F.least(F.col("near"), rank("a"))["id"].alias("to")), "moves")
        moves.append(moved)
        left = pairs.join(moved, "a").select(F.col("to").alias("x"), "b")
        right = moved.select(F.col("a").alias("b"), F.col("to").alias("y"))
        rest = staged(left.join(right, "b").filter("x <> y").select(F.col("x").alias("a"), F.col("y").alias("b")).distinct(), "pairs")
        release(pairs)
        pairs = rest
    release(pairs)
    if not moves:
        return links.select(F.col("a").alias("id"), F.col("b").alias("label")).limit(0)
    ends = moves[-1]
    for moved in reversed(moves[:-1]):
        far = ends.select(F.col("a").alias("to"), F.col("to").alias("end"))
        ends = moved.join(far, "to", "left").select("a", F.coalesce("end", "to").alias("to"))
    ends = staged(ends, "ends")
    for moved in moves:
        release(moved)
    names = ends.groupBy("to").agg(F.min("a").alias("label"))
    return ends.join(names, "to").select(F.col("a").alias("id"), "label")
