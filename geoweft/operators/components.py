"""Connected components by repeated contraction, all in DataFrames."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from geoweft.session import checkpointed, counted, gathered

#: Rows of a partition, where a table is small.
EACH = 50_000


def _beside(df: DataFrame, nodes: int) -> DataFrame:
    """df, of at most so many nodes, for a join: by broadcast if there are at most EACH."""
    return F.broadcast(df) if nodes <= EACH else df


def connected_components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, component) for every node that has an edge; component is its smallest node.

    In a round every node points to that of its neighbours and itself which a
    hash puts first, follows the pointers four steps, and each edge is replaced
    by the one between the nodes its ends arrive at. Edges inside a group
    vanish; as the hash knows nothing of the graph, chains and stars alike
    shrink by a constant factor, so a component is one node after about
    log(size) rounds. The rounds' pointers, put together backwards, name each
    node's component. Rounds are checkpointed and tell the driver only whether
    edges are left. What a round reads is gathered first, and a graph of at
    most EACH / 2 edges joins its nodes by broadcast, which the estimate of a
    join of joins doesn't tell; so a small graph's rounds are a few tasks, not
    a few times as many as a shuffle has partitions.
    """
    current = edges.select(F.least(a, b).alias("a"), F.greatest(a, b).alias("b")).where("a < b").distinct()
    current, left_over = counted(current, "edges")
    rounds: list[tuple[DataFrame, int]] = []
    while left_over:
        # Edges have at most two nodes each.
        nodes = 2 * left_over
        close = lambda df, nodes=nodes: gathered(df, nodes, EACH)
        current = close(current)
        both = close(current.unionByName(current.select(F.col("b").alias("a"), F.col("a").alias("b"))))
        first = both.groupBy("a").agg(F.min_by("b", F.struct(F.xxhash64("b"), "b")).alias("m"))
        ahead = F.struct(F.xxhash64("m"), "m") < F.struct(F.xxhash64("a"), "a")
        points = first.select(F.col("a").alias("node"), F.when(ahead, F.col("m")).otherwise(F.col("a")).alias("parent"))
        points = close(checkpointed(close(points)))
        for _ in range(2):
            next_ = points.select(F.col("node").alias("parent"), F.col("parent").alias("farther"))
            points = close(points.join(_beside(next_, nodes), "parent").select("node", F.col("farther").alias("parent")))
        points = close(checkpointed(points))
        rounds.append((points, nodes))
        left = points.select(F.col("node").alias("a"), F.col("parent").alias("pa"))
        right = points.select(F.col("node").alias("b"), F.col("parent").alias("pb"))
        moved = current.join(_beside(left, nodes), "a").join(_beside(right, nodes), "b").where("pa <> pb")
        moved = moved.select(F.least("pa", "pb").alias("a"), F.greatest("pa", "pb").alias("b")).distinct()
        current, left_over = counted(close(moved), "edges")
    if not rounds:
        kind = edges.schema[a].dataType.simpleString()
        return edges.sparkSession.createDataFrame([], f"node {kind}, component {kind}")
    found, known = rounds[-1][0].withColumnRenamed("parent", "root"), rounds[-1][1]
    for points, nodes in reversed(rounds[:-1]):
        later = found.select(F.col("node").alias("parent"), F.col("root").alias("r"))
        found, known = points.join(_beside(later, known), "parent", "left").select("node", F.coalesce("r", "parent").alias("root")), nodes
    least = gathered(found.groupBy("root").agg(F.min("node").alias("component")), known, EACH)
    return found.join(_beside(least, known), "root").select("node", "component")


def with_edges(found: DataFrame, edges: DataFrame) -> DataFrame:
    """(node, component) of a graph and more edges (a, b). found: that of the graph, stored.

    The new edges are those between the components, so the old ones aren't gone
    through again.
    """
    of = lambda side: found.select(F.col("node").alias(side), F.col("component").alias(f"c{side}"))
    between = edges.join(of("a"), "a", "left").join(of("b"), "b", "left").select(F.coalesce("ca", "a").alias("a"), F.coalesce("cb", "b").alias("b"))
    later = connected_components(between)
    moved = later.select(F.col("node").alias("component"), F.col("component").alias("c"))
    old = found.join(moved, "component", "left").select("node", F.coalesce("c", "component").alias("component"))
    return old.unionByName(later.join(found.select("node"), "node", "left_anti"))
