"""Relations of lines by their edges: no geometry is compared whole, and nothing runs in Python but what lies along.

Lines are taken apart into edges, and each edge is copied to the cells that it
passes, not to those of its box. Edges meet by cell; the signs of the four turns
between two edges say whether they cross, touch or lie along each other. What
the edges of two lines do together decides the relation.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from geoweft.functions.geometry import EPS, related
from geoweft.session import staged, temporary

#: Edges pass a cell if they come so near to it: more than rounding and EPS, less than anything else.
NEAR = 1e-9
#: lines_with lets the first so many edges of a cell meet the others, then the next so many.
ROUNDS = (8, 256)
#: What at least one event of two lines is, and what all of them make, if a predicate holds.
EVENT = {"crosses": "cross and not along", "touches": "not cross and not along", "intersects": "true"}
PAIR = {"crosses": "cross and not along", "touches": "not cross and not along", "intersects": "true"}


def edges(lines: DataFrame, side: str, cell: float) -> DataFrame:
    """(id, key, x1, y1, x2, y2, ends, cx, cy), prefixed by side, for every edge and cell of lines (id, key, geom).

    ends: the line's boundary, the ends of its parts that occur an odd number of times.
    """
    rings = F.filter(F.flatten("geom.parts"), lambda r: F.size(r) > 1)
    last = lambda r: F.element_at(r, -1)
    points = F.flatten(F.transform(F.filter(rings, lambda r: r[0] != last(r)), lambda r: F.array(r[0], last(r))))
    rows = lines.select("id", "key", rings.alias("rings"), points.alias("points"))
    rows = rows.withColumn("ends", F.expr("filter(array_distinct(points), p -> size(filter(points, q -> q = p)) % 2 = 1)"))
    each = F.explode(F.expr("flatten(transform(rings, r -> transform(sequence(1, size(r) - 1), i -> struct(r[i - 1] as p, r[i] as q))))")).alias("e")
    rows = rows.select("id", "key", "ends", each).select("id", "key", "ends", *[F.col(f"e.{v}.{c}").alias(f"{c}{k}") for k, v in ((1, "p"), (2, "q")) for c in "xy"])
    rows = rows.where("x1 <> x2 or y1 <> y2")
    # Column by column, the rows that the edge spans there.
    low, high = F.least("x1", "x2") - NEAR, F.greatest("x1", "x2") + NEAR
    rows = rows.withColumn("cx", F.explode(F.sequence(F.floor(low / cell), F.floor(high / cell))))
    at = lambda x: F.col("y1") + (F.col("y2") - F.col("y1")) / F.nullif(F.col("x2") - F.col("x1"), F.lit(0.0)) * (F.greatest(F.least("x1", "x2"), F.least(F.greatest("x1", "x2"), x)) - F.col("x1"))
    steep = F.abs(F.col("x2") - F.col("x1")) <= F.lit(NEAR)
    a, b = at(F.col("cx") * cell - NEAR), at((F.col("cx") + 1) * cell + NEAR)
    down, up = F.when(steep, F.least("y1", "y2")).otherwise(F.least(a, b)) - NEAR, F.when(steep, F.greatest("y1", "y2")).otherwise(F.greatest(a, b)) + NEAR
    rows = rows.withColumn("cy", F.explode(F.sequence(F.floor(down / cell), F.floor(up / cell))))
    return rows.select("cx", "cy", *[F.col(c).alias(f"{side}_{c}") for c in ("id", "key", "x1", "y1", "x2", "y2", "ends")])


def _turn(a: str, b: str, p: str) -> Column:
    """1, 0 or -1: to which side of the edge from a to b the point lies; points are prefix and number, as b_1."""
    (s, i), (t, j), (u, k) = (v.split("_") for v in (a, b, p))
    v = F.expr(f"({t}_x{j} - {s}_x{i}) * ({u}_y{k} - {s}_y{i}) - ({t}_y{j} - {s}_y{i}) * ({u}_x{k} - {s}_x{i})")
    return F.when(v > EPS, 1).when(v < -EPS, -1).otherwise(0)


def _in_box(side: str, p: str) -> Column:
    u, k = p.split("_")
    return F.expr(" and ".join(f"{u}_{c}{k} >= least({side}_{c}1, {side}_{c}2) - {EPS!r}D and {u}_{c}{k} <= greatest({side}_{c}1, {side}_{c}2) + {EPS!r}D" for c in "xy"))


def events(met: DataFrame) -> DataFrame:
    """What two edges do: cross (interiors of both lines meet), along (more than a point in common), for edges that meet."""
    turns = {"b1": ("a_1", "a_2", "b_1"), "b2": ("a_1", "a_2", "b_2"), "a1": ("b_1", "b_2", "a_1"), "a2": ("b_1", "b_2", "a_2")}
    met = met.withColumns({f"t_{n}": _turn(*v) for n, v in turns.items()})
    proper = (F.col("t_b1") * F.col("t_b2") < 0) & (F.col("t_a1") * F.col("t_a2") < 0)
    on = {n: (F.col(f"t_{n}") == 0) & _in_box("b" if n[0] == "a" else "a", f"{n[0]}_{n[1]}") for n in turns}
    vertex = lambda n: F.struct(F.col(f"{n[0]}_x{n[1]}").alias("x"), F.col(f"{n[0]}_y{n[1]}").alias("y"))
    inside = [on[n] & ~F.array_contains("a_ends", vertex(n)) & ~F.array_contains("b_ends", vertex(n)) for n in turns]
    # How far along a's edge, from 0 to 1, the ends of b's lie.
    part = [F.expr(f"((b_x{k} - a_x1) * (a_x2 - a_x1) + (b_y{k} - a_y1) * (a_y2 - a_y1)) / nullif((a_x2 - a_x1) * (a_x2 - a_x1) + (a_y2 - a_y1) * (a_y2 - a_y1), 0)") for k in (1, 2)]
    shared = F.least(F.lit(1.0), F.greatest(*part)) - F.greatest(F.lit(0.0), F.least(*part))
    along = (F.col("t_b1") == 0) & (F.col("t_b2") == 0) & F.coalesce(shared > EPS, F.lit(False))
    meets = proper | on["a1"] | on["a2"] | on["b1"] | on["b2"] | along
    # Where edges cross, another part of a line can end.
    t = "((b_x1 - a_x1) * (b_y2 - b_y1) - (b_y1 - a_y1) * (b_x2 - b_x1)) / nullif((a_x2 - a_x1) * (b_y2 - b_y1) - (a_y2 - a_y1) * (b_x2 - b_x1), 0)"
    at = [F.expr(f"a_{c}1 + ({t}) * (a_{c}2 - a_{c}1)") for c in "xy"]
    ended = [F.exists(f"{s}_ends", lambda q: (F.abs(q["x"] - at[0]) <= EPS) & (F.abs(q["y"] - at[1]) <= EPS)) for s in "ab"]
    cross = (proper & ~F.coalesce(ended[0] | ended[1], F.lit(False))) | inside[0] | inside[1] | inside[2] | inside[3]
    return met.where(meets).select("a_id", "a_key", "b_id", "b_key", cross.alias("cross"), along.alias("along"))


def _keyed(lines: DataFrame, key: str) -> DataFrame:
    return lines.select(F.col(key).alias("id"), "geom", F.xxhash64("geom").alias("key"))


def _overlap() -> str:
    return " and ".join(f"least(a_{c}1, a_{c}2) <= greatest(b_{c}1, b_{c}2) + {NEAR!r}D and greatest(a_{c}1, a_{c}2) >= least(b_{c}1, b_{c}2) - {NEAR!r}D" for c in "xy")


def _folded(met: DataFrame) -> DataFrame:
    """(a_id, a_key, b_id, b_key, cross, along) of the lines whose edges meet."""
    return events(met.where(_overlap())).groupBy("a_id", "a_key", "b_id", "b_key").agg(F.bool_or("cross").alias("cross"), F.bool_or("along").alias("along"))


def line_pairs(a: DataFrame, b: DataFrame, predicate: str, cell: float) -> DataFrame:
    """(feature_id, target_id) of lines (a: feature_id, geom; b: target_id, geom) for which the predicate holds, each pair once."""
    a, b = _keyed(a, "feature_id"), _keyed(b, "target_id")
    met = edges(a, "a", cell).join(edges(b, "b", cell), ["cx", "cy"])
    if predicate == "contains":
        # Only a line along which the other lies can hold it; whether as far as it goes is for the kernel.
        open_ = events(met.where(_overlap())).where("along").select("a_id", "a_key", "b_id", "b_key").distinct()
        open_ = open_.join(a.select(F.col("id").alias("a_id"), F.col("key").alias("a_key"), F.col("geom").alias("a_geom")), ["a_id", "a_key"])
        open_ = open_.join(b.select(F.col("id").alias("b_id"), F.col("key").alias("b_key"), F.col("geom").alias("b_geom")), ["b_id", "b_key"])
        found = open_.where(related(predicate)(F.col("a_geom"), F.col("b_geom")))
    else:
        found = _folded(met).where(PAIR[predicate])
    return found.select(F.col("a_id").alias("feature_id"), F.col("b_id").alias("target_id"))


def lines_with(a: DataFrame, b: DataFrame, predicate: str, cell: float) -> DataFrame:
    """feature_id, each once, of the lines a for which the predicate holds with any line of b: crosses, touches or intersects.

    Where lines are dense most of them meet very many others, but one is
    enough. So in rounds a few edges of b in each cell, then more, meet the
    lines that are open; one partner of each is looked at whole, by all edges
    of the two, and lines for which the predicate holds go no further. What is
    open after that meets all of b, so no line is missed. Edges are stored, and
    runs its jobs at once; one number a round reaches the driver.
    """
    spark = a.sparkSession
    pair = ["a_id", "a_key", "b_id", "b_key"]
    with temporary(spark):
        left = staged(edges(_keyed(a, "feature_id").where("id is not null"), "a", cell), "lines")
        place = F.row_number().over(Window.partitionBy("cx", "cy").orderBy(F.xxhash64("b_id", "b_key", "b_x1", "b_y1"))).alias("place")
        right = staged(edges(_keyed(b, "target_id"), "b", cell).select("*", place), "lines-met")
        most = right.agg(F.max("place")).first()[0] or 0
        open_, low, found = left, 0, []
        for high in (*[n for n in ROUNDS if n < most], None):
            met = open_.join(right if high is None else right.where(F.col("place").between(low + 1, high)), ["cx", "cy"])
            hits = events(met.where(_overlap())).where(EVENT[predicate])
            if high is None:
                hits = hits.select(*pair).distinct()
            else:
                hits = hits.groupBy("a_id", "a_key").agg(F.min(F.struct("b_id", "b_key")).alias("b")).select("a_id", "a_key", "b.*")
            whole = hits.join(left, ["a_id", "a_key"]).join(right, ["b_id", "b_key", "cx", "cy"])
            found.append(staged(_folded(whole).where(PAIR[predicate]).select("a_id").distinct(), "lines-found"))
            if high is None:
                break
            open_, low = staged(open_.join(found[-1], "a_id", "left_anti"), "lines-open"), high
            if open_.isEmpty():
                break
        done = reduce(DataFrame.unionByName, found).select(F.col("a_id").alias("feature_id"))
        return staged(done, "lines-related", keep=True)
