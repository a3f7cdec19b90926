"""Connected components by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seedweave.session import write_stage

MAX_ROUNDS = 60


def _state(edges: DataFrame) -> tuple[int, int]:
    row = edges.agg(F.count(F.lit(1)), F.coalesce(F.bit_xor(F.xxhash64("a", "b")), F.lit(0))).first()
    return row[0], row[1]


def connected_components(edges: DataFrame) -> DataFrame:
    """(node, component) of every node of ``edges`` (a, b): the smallest node it reaches.

    Every round is a few aggregations and joins by node, written to the shared
    folder, so no neighbourhood is gathered and a lost executor repeats one
    round at most.  A star settles in two rounds and a chain in a number of
    rounds that grows with the logarithm of its length.  An empty table gives
    an empty table; loops and repeated edges are allowed.
    """
    now = write_stage(
        edges.where(F.col("a") != F.col("b"))
        .select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
        .distinct(),
        "edges",
    )
    state = _state(now)
    for _ in range(MAX_ROUNDS):
        if not state[0]:
            break
        now = write_stage(_small_star(_large_star(now)), "edges")
        previous, state = state, _state(now)
        if state == previous:
            break
    else:
        raise RuntimeError("components did not settle")
    nodes = now.select(F.col("a").alias("node"), F.col("b").alias("component"))
    roots = now.select(F.col("b").alias("node"), F.col("b").alias("component"))
    return nodes.unionByName(roots).groupBy("node").agg(F.min("component").alias("component"))


def _large_star(edges: DataFrame) -> DataFrame:
    """Larger neighbours of each node are tied to its smallest neighbour or itself."""
    both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.min("b").alias("m"))
    tied = both.join(least, "a").where(F.col("b") > F.col("a"))
    return tied.select(F.col("b").alias("a"), F.least("m", "a").alias("b")).where(F.col("a") != F.col("b")).distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    """Smaller neighbours of each node, and the node, are tied to the smallest of them."""
    least = edges.groupBy("a").agg(F.min("b").alias("m"))
    others = edges.join(least, "a").where(F.col("b") != F.col("m")).select(F.col("b").alias("a"), F.col("m").alias("b"))
    return others.unionByName(least.select("a", F.col("m").alias("b"))).distinct()
