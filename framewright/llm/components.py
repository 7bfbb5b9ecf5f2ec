"""Connected components of a graph given as pairs of numbers, by alternating star steps.

A large-star step links every neighbour above a node to the node's smallest neighbour, a
small-star step those below; both are a combinable minimum and one join, and keep the
components. When the pairs no longer change, each node is linked to its component's smallest.
Every step's pairs are written to the shared folder, so that a lost executor replays one step.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from framewright.llm.common import BROADCAST_ROWS, shuffled
from framewright.session import materialise


def _star(pairs: DataFrame, large: bool, few: bool) -> DataFrame:
    """``pairs`` (u, v) with u > v, linked anew; the minima of ``few`` pairs are broadcast."""
    sides = pairs.unionByName(pairs.select(F.col("v").alias("u"), F.col("u").alias("v"))) if large else pairs
    least = sides.groupBy("u").agg(F.min("v").alias("m"))
    least = least.select("u", F.least("u", "m").alias("m"))
    met = F.broadcast(least) if few else shuffled(least)
    if not large:
        moved = pairs.join(met, "u").where(F.col("v") != F.col("m")).select(F.col("v").alias("u"), F.col("m").alias("v"))
        return moved.unionByName(least.select("u", F.col("m").alias("v"))).distinct()
    return sides.join(met, "u").where(F.col("v") > F.col("u")).select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()


def _mark(pairs: DataFrame):
    return pairs.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()


def components(pairs: DataFrame) -> DataFrame:
    """(id, component): every number that occurs in ``pairs`` (a, b) and the smallest that it reaches."""
    now = materialise(pairs.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "pairs")
    before, mark = None, _mark(now)
    while mark != before:
        before = mark
        few = mark[0] <= BROADCAST_ROWS  # a step does not add pairs
        now = materialise(_star(_star(now, True, few), False, few), "pairs")
        mark = _mark(now)
    roots = now.select(F.col("v").alias("id")).distinct()
    return now.select(F.col("u").alias("id"), F.col("v").alias("component")).unionByName(roots.select("id", F.col("id").alias("component")))
