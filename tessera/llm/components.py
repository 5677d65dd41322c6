"""Connected components of an edge table by alternating large-star and small-star steps.

No group is ever collected: each step is a grouped minimum and an equi-join, so a hub
costs its own edges only (adaptive execution splits its part of the join).  Each round
ends in a table of the shared folder; the round before is removed then.

Defined results: links with a null end are none; repeated links and links to itself change
nothing; without links there are no rows; more than ``most_rounds`` rounds raise (some
log2 of the longest chain are needed).
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import drop, materialize


def _large_star(edges: DataFrame) -> DataFrame:
    """Link each node's larger neighbours to the smallest node around it."""
    both = edges.select(F.col("a").alias("u"), F.col("b").alias("v")).unionByName(edges.select(F.col("b").alias("u"), F.col("a").alias("v")))
    least = both.groupBy("u").agg(F.least(F.col("u"), F.min("v")).alias("m"))
    return both.where("v > u").join(least, "u").select(F.col("v").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    """Link each node and its smaller neighbours to the smallest of them.  Needs a > b."""
    least = edges.groupBy("a").agg(F.min("b").alias("m"))
    moved = edges.join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b")
    return least.select("a", F.col("m").alias("b")).unionByName(moved).distinct()


def _mark(edges: DataFrame):
    return edges.agg(F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("h")).first()


def components(edges: DataFrame, most_rounds: int = 50) -> DataFrame:
    """(a, b) of bigint, any order, repeats and self-links allowed, to (node, root) for every
    linked node but the roots themselves; the root is a component's smallest node."""
    now = materialize(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b").distinct(), "links")
    before = _mark(now)
    for _ in range(most_rounds):
        if not before["n"]:
            break
        done, now = now, materialize(_small_star(_large_star(now)), "links")
        after = _mark(now)
        drop(done)
        if after == before:
            break
        before = after
    else:
        raise RuntimeError(f"components did not settle in {most_rounds} rounds")
    return now.select(F.col("a").alias("node"), F.col("b").alias("root"))
