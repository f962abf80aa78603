"""Connected components of an edge table, by random-order contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .runtime import cut, release


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of edges (a, b); nodes of one component share a root.

    Each round points every node at its neighbour that comes first in that
    round's hashed order (or at itself), relabels the edges and drops loops and
    repeats. The live graph shrinks by a constant factor a round, whatever the
    diameter. The rounds' pointers are followed from the last round to the
    first, each one join. Rounds are cut in the shared checkpoint folder;
    nothing but the question whether edges are left reaches the driver. An
    empty edge table gives no rows; loops and repeated edges are harmless.
    """
    live = cut(edges.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).where("a <> b").distinct())
    rounds = []
    while not live.isEmpty():
        order = lambda c, turn=len(rounds): F.struct(F.xxhash64(F.lit(turn), c).alias("rank"), c.alias("id"))
        both = live.unionByName(live.select(F.col("b").alias("a"), F.col("a").alias("b")))
        best = both.groupBy("a").agg(F.min(order(F.col("b"))).alias("m"))
        parent = cut(best.select(F.col("a").alias("node"), F.least("m", order(F.col("a")))["id"].alias("parent")))
        rounds.append(parent)
        left, right = parent.select(F.col("node").alias("a"), F.col("parent").alias("pa")), parent.select(F.col("node").alias("b"), F.col("parent").alias("pb"))
        after = cut(live.join(left, "a").join(right, "b").where("pa <> pb").select(F.least("pa", "pb").alias("a"), F.greatest("pa", "pb").alias("b")).distinct())
        release(live)
        live = after
    if not rounds:
        kind = dict(live.dtypes)["a"]
        return edges.sparkSession.createDataFrame([], f"node {kind}, root {kind}")
    found = rounds[-1].select("node", F.col("parent").alias("root"))
    for parent in reversed(rounds[:-1]):
        # Later rounds know only the nodes that still had edges; a parent they do not know is a root.
        found = parent.join(found.select(F.col("node").alias("parent"), "root"), "parent", "left").select("node", F.coalesce("root", "parent").alias("root"))
    out = cut(found)
    release(live, *rounds)
    return out
