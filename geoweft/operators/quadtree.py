"""Nearest targets through two linear quadtrees, for places where points are dense.

Both sides' points are keyed by square cells, the first as wide as the distance
and each further level half as wide. A cell is split while it has more than LEAF
points at different places; so a hot cell becomes many small ones, and an empty
region costs nothing. Cells of both trees are paired from the widest down, each
pair with the least and the greatest distance that points in the two can have, by
the boxes of the points themselves. A target cell that lies farther from a
feature cell than another reaches at most is dropped, with all that is in it;
what is left is split a level further, until leaves of neighbouring depths meet
leaves, and only their points are compared.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from geoweft.functions.geodesy import planar_distance
from geoweft.session import staged

#: Points of a leaf; levels at most, so that the finest cells have a 65,536th of the distance; pairs for each feature that need no tree.
LEAF, LEVELS, FEW = 4, 16, 50
NODE = ["level", "cx", "cy"]
BOX = ["x0", "y0", "x1", "y1"]


def _cell(metres: float, level: int) -> list[Column]:
    return [F.floor(F.col(c) / F.lit(metres) * (1 << level)) for c in ("x", "y")]


def dense_part(left: DataFrame, right: DataFrame, metres: float) -> tuple[DataFrame, int]:
    """(cx, cy) of the features' cells whose features would meet more than FEW targets each, stored, and their number."""
    counted = lambda df: df.groupBy(*[c.alias(n) for c, n in zip(_cell(metres, 0), ("cx", "cy"), strict=True)]).agg(F.count("*").alias("n"))
    around = F.explode(F.flatten(F.array(*[F.array(*[F.struct((F.col("cx") + i).alias("cx"), (F.col("cy") + j).alias("cy")) for i in (-1, 0, 1)]) for j in (-1, 0, 1)])))
    met = counted(right).select(around.alias("c"), "n").groupBy("c.cx", "c.cy").agg(F.sum("n").alias("met")).where(F.col("met") > FEW)
    cells = staged(counted(left).join(met, ["cx", "cy"]).select("cx", "cy"), "dense-cells")
    return cells, cells.count()


def tree(points: DataFrame, metres: float) -> tuple[DataFrame, DataFrame]:
    """(side, level, cx, cy, n, x0, y0, x1, y1, leaf) of all cells in use, and the points with their leaf's level, cx and cy, both stored.

    points: side and distinct x and y for each. A cell at the last level is a leaf whatever it holds.
    """
    deep = points.select("*", *[c.alias(n) for c, n in zip(_cell(metres, LEVELS), ("dx", "dy"), strict=True)])
    finest = deep.groupBy("side", "dx", "dy").agg(F.count("*").alias("n"), F.min("x").alias("x0"), F.min("y").alias("y0"), F.max("x").alias("x1"), F.max("y").alias("y1"))
    finest = staged(finest, "tree-finest")
    up = F.explode(F.sequence(F.lit(0), F.lit(LEVELS))).alias("level")
    shifted = [F.expr(f"shiftright({c}, {LEVELS} - level)").alias(n) for c, n in (("dx", "cx"), ("dy", "cy"))]
    cells = finest.select("*", up).select("side", "level", *shifted, "n", *BOX).groupBy("side", *NODE).agg(F.sum("n").alias("n"), F.min("x0").alias("x0"), F.min("y0").alias("y0"), F.max("x1").alias("x1"), F.max("y1").alias("y1"))
    cells = staged(cells, "tree-cells")
    split = cells.where((F.col("n") > LEAF) & (F.col("level") < LEVELS)).select("side", *NODE)
    parents = split.select("side", (F.col("level") + 1).alias("level"), F.col("cx").alias("px"), F.col("cy").alias("py"))
    below = cells.withColumn("px", F.shiftright("cx", 1)).withColumn("py", F.shiftright("cy", 1)).join(parents, ["side", "level", "px", "py"], "left_semi").drop("px", "py")
    leaf = (F.col("n") <= LEAF) | (F.col("level") == LEVELS)
    used = staged(cells.where("level = 0").unionByName(below).withColumn("leaf", leaf), "tree")
    leaves = finest.select("side", "dx", "dy", up).select("side", "dx", "dy", "level", *shifted).join(used.where("leaf").select("side", *NODE), ["side", *NODE])
    return used, staged(deep.join(leaves, ["side", "dx", "dy"]).drop("dx", "dy"), "tree-points")


def _named(cells: DataFrame, side: str) -> DataFrame:
    return cells.select(*[F.col(c).alias(f"{side}_{c}") for c in (*NODE, *BOX, "leaf")])


def _steps(cells: DataFrame, side: str) -> DataFrame:
    """What takes the place of a cell in the next round: itself if it is a leaf, else the cells in it."""
    own = [F.col(c).alias(f"{side}_{c}") for c in NODE]
    stay = cells.where("leaf").select(*own, F.struct(*NODE, *BOX, "leaf").alias(f"{side}_next"))
    parent = [(F.col("level") - 1).alias(f"{side}_level"), F.shiftright("cx", 1).alias(f"{side}_cx"), F.shiftright("cy", 1).alias(f"{side}_cy")]
    return stay.unionByName(cells.where("level > 0").select(*parent, F.struct(*NODE, *BOX, "leaf").alias(f"{side}_next")))


def _bounded(pairs: DataFrame, metres: float) -> DataFrame:
    """Pairs that can hold a nearest target; bound is the farthest that it can be from a feature of the cell."""
    away = [F.greatest(F.lit(0.0), F.col(f"b_{c}0") - F.col(f"a_{c}1"), F.col(f"a_{c}0") - F.col(f"b_{c}1")) for c in ("x", "y")]
    across = [F.greatest(F.col(f"b_{c}1") - F.col(f"a_{c}0"), F.col(f"a_{c}1") - F.col(f"b_{c}0")) for c in ("x", "y")]
    length = lambda d: F.sqrt(d[0] * d[0] + d[1] * d[1])
    own = Window.partitionBy("a_level", "a_cx", "a_cy")
    # A hair of room, since box distances and point distances round apart.
    found = pairs.withColumn("least", length(away)).withColumn("bound", F.min(F.least("bound", length(across) * (1 + 1e-9))).over(own))
    return found.where((F.col("least") <= F.col("bound")) & (F.col("least") <= metres)).drop("least")


def leaf_pairs(cells: DataFrame, metres: float) -> DataFrame:
    """Pairs of leaves (a_level, a_cx, a_cy, b_level, b_cx, b_cy) that hold each feature's nearest target. One number a round reaches the driver."""
    left, right = (cells.where(F.col("side") == s) for s in "ab")
    around = F.explode(F.array(*[F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i in (-1, 0, 1) for j in (-1, 0, 1)]))
    a = _named(left.where("level = 0"), "a").withColumn("s", around)
    a = a.withColumn("b_cx", F.col("a_cx") + F.col("s.i")).withColumn("b_cy", F.col("a_cy") + F.col("s.j")).drop("s")
    pairs = a.join(_named(right.where("level = 0"), "b"), ["b_cx", "b_cy"]).withColumn("bound", F.lit(float("inf")))
    steps = _steps(left, "a"), _steps(right, "b")
    settled = F.col("a_leaf") & F.col("b_leaf")
    keys = [f"{s}_{c}" for s in "ab" for c in NODE]
    done = []
    while True:
        pairs = staged(_bounded(pairs, metres), "tree-pairs")
        done.append(pairs.where(settled).select(*keys))
        if pairs.where(~settled).isEmpty():
            return reduce(DataFrame.unionByName, done)
        pairs = pairs.where(~settled).select(*keys, "bound")
        for side, step in zip("ab", steps, strict=True):
            own = [f"{side}_{c}" for c in NODE]
            kept = [c for c in pairs.columns if c not in own]
            pairs = pairs.join(step, own).select(*kept, *[F.col(f"{side}_next.{c}").alias(f"{side}_{c}") for c in (*NODE, *BOX, "leaf")])


def nearest(left: DataFrame, right: DataFrame, metres: float) -> DataFrame:
    """(feature_id, target_id, distance_m): each feature's nearest target within the distance, the smaller target_id of equals.

    left: feature_id, x, y; right: target_id, x, y. Points at one place are one
    in the trees, so repeated places make no pairs of each with each.
    """
    targets = right.groupBy("x", "y").agg(F.min("target_id").alias("target_id")).withColumn("side", F.lit("b"))
    features = left.select("x", "y").distinct().withColumn("side", F.lit("a"))
    cells, points = tree(targets.unionByName(features, allowMissingColumns=True), metres)
    pairs = leaf_pairs(cells, metres)
    ours = points.where("side = 'a'").select("x", "y", *[F.col(c).alias(f"a_{c}") for c in NODE])
    theirs = points.where("side = 'b'").select(F.col("x").alias("tx"), F.col("y").alias("ty"), "target_id", *[F.col(c).alias(f"b_{c}") for c in NODE])
    met = pairs.join(ours, [f"a_{c}" for c in NODE]).join(theirs, [f"b_{c}" for c in NODE])
    met = met.select("x", "y", "target_id", planar_distance("x", "y", "tx", "ty").alias("distance_m")).where(F.col("distance_m") <= metres)
    best = met.groupBy("x", "y").agg(F.min(F.struct("distance_m", "target_id")).alias("n"))
    return left.join(best, ["x", "y"]).select("feature_id", "n.target_id", "n.distance_m")
