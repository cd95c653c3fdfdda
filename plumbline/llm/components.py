"""Connected components by alternating large-star and small-star."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.llm.staging import Workspace


def _large_star(edges: DataFrame) -> DataFrame:
    """Each node hands its least neighbour (or itself) to its larger neighbours."""
    both = edges.select(F.col("a").alias("u"), F.col("b").alias("v")).union(edges.select("b", "a"))
    least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    return both.where("v > u").join(least, "u").select(F.col("m").alias("a"), F.col("v").alias("b")).distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    """Each node hands its least smaller neighbour to itself and its other smaller neighbours."""
    down = edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
    least = down.groupBy("u").agg(F.min("v").alias("m"))
    others = down.join(least, "u").where("v <> m").select(F.col("m").alias("a"), F.col("v").alias("b"))
    return others.union(least.select(F.col("m").alias("a"), F.col("u").alias("b"))).distinct()


def _state(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("a", "b"))).first())


def connected_components(edges: DataFrame, work: Workspace) -> DataFrame:
    """(node, component) for every node of the edges (a, b); the component is its least node.

    Loops and repeated edges are allowed.  Each round is staged, so a lost
    executor costs one read; rounds stop when the edges no longer change, which
    takes logarithmically many.  No edge reaches the driver.
    """
    now = work.stage(edges.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "edges")
    state = _state(now)
    while state[0]:
        large = work.stage(_large_star(now), "large")
        nxt = work.stage(_small_star(large), "small")
        new = _state(nxt)
        work.drop(large, now)
        now = nxt
        if new == state:
            break
        state = new
    return now.select(F.col("b").alias("node"), F.col("a").alias("component")).union(now.select("a", "a").distinct())
