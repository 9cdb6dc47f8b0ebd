"""Distributed union-find: alternating large and small stars over an edge table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import drop, materialize


def _state(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b") % 1_000_000_007)).first())


def components(edges: DataFrame, rounds: int = 200) -> DataFrame:
    """(node, root) of every node of ``edges`` (a, b): root is the least node it is linked with.

    Each step leaves a table in the shared folder. A node with many neighbours is an aggregate with partial sums and
    a join whose large side Spark may split. Loops and repeated edges do no harm; no edges give no rows. The rounds needed
    grow with the logarithm of a component's size; if ``rounds`` do not do, that is an error.
    """
    now = materialize(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
    state = _state(now)
    for _ in range(rounds):
        if not state[0]:
            break
        both = now.unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.join(least, "a").where("b > a and b <> m").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(least, "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        nxt = materialize(small.unionByName(least.select("a", F.col("m").alias("b"))).distinct(), "edges")
        after = _state(nxt)
        drop(now)
        now, state, before = nxt, after, state
        if state == before:
            break
    else:
        raise RuntimeError(f"components are not joined after {rounds} rounds")
    return now.groupBy("a").agg(F.min("b").alias("root")).select(F.col("a").alias("node"), "root").unionByName(now.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())


def edges(roots: DataFrame) -> DataFrame:
    """What ``components`` gave, as edges (a, b) that join the same nodes: with more edges they need few rounds."""
    return roots.select(F.col("node").alias("a"), F.col("root").alias("b"))
