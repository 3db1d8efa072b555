"""Metric joins: near, nearest_n, near_all, between, cluster.

Every distance join is an equi-join on square cells as wide as the distance,
the reference side copied to the nine cells around it, with the exact distance
as a further condition. It shuffles (or broadcasts, if the optimiser finds the
side small) but never loops over all pairs. Only ids, coordinates and cells
are joined; the features' columns are fetched by id afterwards.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from geoweft.functions.geodesy import joint_centre, metric_xy, planar_distance, projected, projected_ring_sql, segment_distance_sql
from geoweft.functions.geometry import LINES, area_relation_sql, distance, point_geometry, representative_point
from geoweft.functions.names import free_name
from geoweft.operators import quadtree
from geoweft.operators.components import connected_components
from geoweft.operators.filters import Where, reference_filter
from geoweft.session import staged

MOST_METRES = 5000.0


def _check(distance: float, name: str) -> None:
    if not 0 < distance <= MOST_METRES:
        raise ValueError(f"{name}: distance must be over 0 and at most {MOST_METRES:g} m")


def _is_points(df: DataFrame) -> bool:
    return {"lon", "lat"} <= set(df.columns)


def _as_points(df: DataFrame, key: str) -> DataFrame:
    """key, lon, lat: points as they are, other geometries by a point on them."""
    if _is_points(df):
        return df.select(key, "lon", "lat")
    at = representative_point("geom")
    return df.where("geom.type is not null").select(key, at.alias("_p")).select(key, "_p.lon", "_p.lat")


def _corners(df: DataFrame) -> DataFrame:
    if _is_points(df):
        return df.select("lon", "lat")
    low, high = (df.select(F.col(f"geom.x{e}").alias("lon"), F.col(f"geom.y{e}").alias("lat")) for e in ("min", "max"))
    return low.unionByName(high)


def zone(frames: list[DataFrame], meridian: float | None = None) -> float:
    """Central meridian of the metric zone of all frames together, unless it is given.

    This one number reaches the driver, in a job over the coordinates: what is
    built on it has constants in place of a join with the frames' boxes.
    """
    if meridian is not None:
        return meridian
    found = joint_centre(*map(_corners, frames)).first()
    return 3.0 if found is None or found["_meridian"] is None else found["_meridian"]


def _shapes(df: DataFrame, others: list[DataFrame], key: str, meridian: float | None) -> DataFrame:
    """key, shape (the geometry in metres), x0, y0, x1, y1."""
    rows = df.select(key, "lon", "lat").where("lon is not null and lat is not null") if _is_points(df) else df.select(key, "geom").where("geom.type is not null and geom.xmin is not null")
    if meridian is None:
        rows = rows.crossJoin(F.broadcast(joint_centre(_corners(df), *map(_corners, others)).select("_meridian")))  # one row
    else:
        rows = rows.withColumn("_meridian", F.lit(float(meridian)))
    if _is_points(df):
        placed = projected(rows, "lon", "lat", "_meridian", "x", "y")
        return placed.select(key, point_geometry(F.col("x"), F.col("y")).alias("shape", metadata={"shape": "point"}))
    rows = rows.withColumn("parts", F.expr(f"transform(geom.parts, part -> transform(part, ring -> {projected_ring_sql('ring', '_meridian')}))"))
    flat = F.flatten(F.flatten("parts"))
    xs, ys = F.transform(flat, lambda p: p["x"]), F.transform(flat, lambda p: p["y"])
    sides = {"xmin": F.array_min(xs), "ymin": F.array_min(ys), "xmax": F.array_max(xs), "ymax": F.array_max(ys)}
    shape = F.struct(F.col("geom.type").alias("type"), *[c.alias(n) for n, c in sides.items()], F.col("parts"))
    kind = df.schema["geom"].metadata.get("shape")
    return rows.select(key, shape.alias("shape", metadata={"shape": kind} if kind else {}))


@F.arrow_udf(T.DoubleType())
def _shape_distance(a: pa.Array, b: pa.Array) -> pa.Array:
    return pa.array([x and y and distance(x, y) for x, y in zip(a.to_pylist(), b.to_pylist())], pa.float64())


def _cells_along(df: DataFrame, side: float, grow: float) -> DataFrame:
    """df with cx, cy, once for each cell of that side met by the segment ax, ay, bx, by grown by so much: column by column, the rows that it spans there."""
    lo, hi = F.floor((F.least("ax", "bx") - grow) / side), F.floor((F.greatest("ax", "bx") + grow) / side)
    columns = df.withColumn("cx", F.explode(F.sequence(lo, hi)))
    slope = F.when(F.col("ax") != F.col("bx"), (F.col("by") - F.col("ay")) / (F.col("bx") - F.col("ax")))
    at = lambda x: F.when(slope.isNull(), None).otherwise(F.col("ay") + slope * (F.greatest(F.least("ax", "bx"), F.least(F.greatest("ax", "bx"), x)) - F.col("ax")))
    y0, y1 = at(F.col("cx") * side - grow), at((F.col("cx") + 1) * side + grow)
    low, high = F.coalesce(F.least(y0, y1), F.least("ay", "by")), F.coalesce(F.greatest(y0, y1), F.greatest("ay", "by"))
    return columns.withColumn("cy", F.explode(F.sequence(F.floor((low - grow) / side), F.floor((high + grow) / side))))


def _is_area(shape: str) -> Column:
    return F.col(f"{shape}.type").endswith("Polygon")


def _edges_sql(shape: str) -> str:
    """SQL text: the edges (p, q) of a shape; a point is one of no length."""
    return f"flatten(transform(flatten({shape}.parts), r -> transform(sequence(1, greatest(1, size(r) - 1)), i -> named_struct('p', r[i - 1], 'q', r[least(i, size(r) - 1)]))))"


def _apart_sql(a: tuple[str, str], b: tuple[str, str], c: tuple[str, str], d: tuple[str, str]) -> str:
    """SQL text: distance of the edge from a to b, also one of length zero, to that from c to d."""
    to = lambda p, q, r: segment_distance_sql(*p, *q, *r)
    turn = lambda p, q, r: f"sign(({q[0]} - {p[0]}) * ({r[1]} - {p[1]}) - ({q[1]} - {p[1]}) * ({r[0]} - {p[0]}))"
    crossing = f"{turn(a, b, c)} * {turn(a, b, d)} < 0 and {turn(c, d, a)} * {turn(c, d, b)} < 0"
    return f"case when {a[0]} = {b[0]} and {a[1]} = {b[1]} then {to(a, c, d)} when {crossing} then 0.0 else least({to(a, c, d)}, {to(b, c, d)}, {to(c, a, b)}, {to(d, a, b)}) end"


def _edges(df: DataFrame, key: str) -> DataFrame:
    """key, ax, ay, bx, by: the edges of the points and lines among shapes."""
    rows = df.where(~_is_area("shape")).select(key, F.explode(F.expr(_edges_sql("shape"))).alias("e"))
    return rows.select(key, *[F.col(f"e.{v}.{c}").alias(f"{n}{c}") for n, v in (("a", "p"), ("b", "q")) for c in "xy"])


def _edge_hits(left: DataFrame, right: DataFrame, metres: float) -> DataFrame:
    """As shape_hits_within, for points and lines: their edges meet by the cells along them, a point being an edge of no length."""
    side = max(float(metres), 250.0)

    def celled(df: DataFrame, key: str, grow: float) -> DataFrame:
        return _cells_along(_edges(df, key), side, grow)

    other = celled(right, "target_id", float(metres)).toDF("target_id", "cax", "cay", "cbx", "cby", "cx", "cy")
    if left.schema["shape"].metadata.get("shape") == "point":
        apart = segment_distance_sql("ax", "ay", "cax", "cay", "cbx", "cby")
    else:
        apart = _apart_sql(("ax", "ay"), ("bx", "by"), ("cax", "cay"), ("cbx", "cby"))
    met = celled(left, "feature_id", 0.0).join(other, ["cx", "cy"]).select("feature_id", "target_id", F.expr(apart).alias("distance_m"))
    return met.where(F.col("distance_m") <= float(metres))


def _kernel_hits(left: DataFrame, right: DataFrame, metres: float) -> DataFrame:
    """As shape_hits_within, for pairs with an area: cells of the boxes, one grown by the distance, then the exact distance in Arrow batches."""
    side = max(float(metres), 500.0)

    def celled(df: DataFrame, key: str, name: str, grow: float) -> DataFrame:
        cells = lambda a: F.sequence(F.floor((F.col(f"{name}.{a}min") - grow) / side), F.floor((F.col(f"{name}.{a}max") + grow) / side))
        return df.select(key, F.col("shape").alias(name)).withColumn("cx", F.explode(cells("x"))).withColumn("cy", F.explode(cells("y")))

    met = celled(left, "feature_id", "a", 0.0).join(celled(right, "target_id", "b", float(metres)), ["cx", "cy"]).where(_is_area("a") | _is_area("b"))
    for axis, cell in (("x", "cx"), ("y", "cy")):
        met = met.where((F.col(f"a.{axis}min") <= F.col(f"b.{axis}max") + metres) & (F.col(f"a.{axis}max") >= F.col(f"b.{axis}min") - metres))
        met = met.where(F.col(cell) == F.floor(F.greatest(F.col(f"a.{axis}min"), F.col(f"b.{axis}min") - metres) / side))  # the first common cell
    return met.select("feature_id", "target_id", _shape_distance("a", "b").alias("distance_m")).where(F.col("distance_m") <= metres)


def _thin(df: DataFrame) -> bool:
    return df.schema["shape"].metadata.get("shape") in ("point", "line")


def shape_hits_within(left: DataFrame, right: DataFrame, metres: float) -> DataFrame:
    """As shape_pairs_within, but a pair can come several times; the least distance is that of the pair."""
    hits = _edge_hits(left, right, metres)
    return hits if _thin(left) and _thin(right) else hits.unionByName(_kernel_hits(left, right, metres))


#: Places of a cell, or edges that they meet, that need no smaller cells; smaller cells at most.
PLACES, EDGES, SPLITS = 16, 64, 6


def _closest(units: DataFrame, edges: DataFrame, cells: list[str], metres: float, slack: float = 0.0) -> DataFrame:
    """The edges of each unit's cell at most metres from it (ux, uy) that are no farther than its nearest one and slack.

    The distance is taken twice, so that no pair is sorted or shuffled: first for
    the least one, a number for each unit, then for the edges that are so near.
    """
    away = F.expr(segment_distance_sql("ux", "uy", "ax", "ay", "bx", "by"))
    least = units.join(edges, cells).groupBy("ux", "uy").agg(F.min(away).alias("least"))
    bound = F.least(F.lit(float(metres)), F.col("least") + F.lit(float(slack)))
    near = units.join(least.select("ux", "uy", bound.alias("bound")), ["ux", "uy"])
    return near.join(edges, cells).where(away <= F.col("bound"))


def nearest_edges(points: DataFrame, edges: DataFrame, metres: float) -> DataFrame:
    """(feature_id, target_id, distance_m): each point's nearest target by its edges, the smaller target_id of equals.

    points: feature_id, x, y; edges: target_id, ax, ay, bx, by. Points at one
    place are one, and so are equal edges. Where many places of a cell would meet
    many edges, the cell is split four by four, and each part keeps only edges
    that can be the nearest of a place in it: those no farther from its middle
    than the nearest one and its diagonal. One number a round reaches the driver.
    """
    metres, side = float(metres), max(float(metres), 250.0)
    at = lambda c, s: F.floor(F.col(c) / F.lit(s))
    points = staged(points.select("feature_id", "x", "y"), "near-points")
    places = points.select(F.col("x").alias("ux"), F.col("y").alias("uy")).distinct()
    edges = edges.groupBy("ax", "ay", "bx", "by").agg(F.min("target_id").alias("target_id"))
    open_ = staged(places.withColumns({"cx": at("ux", side), "cy": at("uy", side)}), "near-places")
    known = _cells_along(edges, side, metres).join(open_.select("cx", "cy").distinct(), ["cx", "cy"], "left_semi")
    found: list[DataFrame] = []
    for split in range(SPLITS + 1):
        known = staged(known.select("cx", "cy", "target_id", "ax", "ay", "bx", "by"), "near-edges")
        loads = [df.groupBy("cx", "cy").agg(F.count("*").alias(n)) for df, n in ((open_, "places"), (known, "edges"))]
        dense = staged(loads[0].join(loads[1], ["cx", "cy"]).where((F.col("places") > PLACES) & (F.col("edges") > EDGES)).select("cx", "cy"), "near-dense")
        last = split == SPLITS or dense.isEmpty()
        usual = open_ if last else open_.join(dense, ["cx", "cy"], "left_anti")
        found.append(_closest(usual, known, ["cx", "cy"], metres).groupBy("ux", "uy", "bound").agg(F.min("target_id").alias("target_id")))
        if last:
            break
        side /= 4
        open_ = staged(open_.join(dense, ["cx", "cy"], "left_semi").withColumns({"px": F.col("cx"), "py": F.col("cy"), "cx": at("ux", side), "cy": at("uy", side)}), "near-places")
        middle = lambda c: (F.col(c) + 0.5) * F.lit(side)
        parts = open_.select("px", "py", middle("cx").alias("ux"), middle("cy").alias("uy")).distinct()
        diagonal = side * 2**0.5 * (1 + 1e-9) + 1e-6
        known = _closest(parts, known.withColumnsRenamed({"cx": "px", "cy": "py"}), ["px", "py"], metres + diagonal, diagonal)
        known = known.withColumns({"cx": at("ux", side), "cy": at("uy", side)})
        open_ = open_.drop("px", "py")
    best = reduce(DataFrame.unionByName, found).select(F.col("ux").alias("x"), F.col("uy").alias("y"), "target_id", "bound")
    return points.join(best, ["x", "y"]).select("feature_id", "target_id", F.col("bound").alias("distance_m"))


def nearest_shapes(left: DataFrame, right: DataFrame, metres: float) -> DataFrame:
    """As nearest_within, for shapes in metres."""
    if left.schema["shape"].metadata.get("shape") != "point":
        return _best(shape_hits_within(left, right, metres))
    points = left.select("feature_id", F.col("shape.xmin").alias("x"), F.col("shape.ymin").alias("y"))
    hits = nearest_edges(points, _edges(right, "target_id"), metres)
    return _best(hits if _thin(right) else hits.unionByName(_kernel_hits(left, right, metres)))


def shape_pairs_within(left: DataFrame, right: DataFrame, metres: float) -> DataFrame:
    """As pairs_within, for any geometries (shape, in metres). Points and lines need no Python; pairs with an area go to the kernel."""
    return shape_hits_within(left, right, metres).groupBy("feature_id", "target_id").agg(F.min("distance_m").alias("distance_m"))


def shapes_near_one(df: DataFrame, one: DataFrame, metres: float, key: str, meridian: float | None = None) -> DataFrame:
    """key of the features at most so far from the single area of one (target_id, geom).

    Points and lines by their edges and the first vertex of each part, which tells
    whether a part that is far from the area's edges is inside; areas by the kernel.
    """
    area = _shapes(one, [], "target_id", meridian).select(F.col("shape").alias("_one"), F.expr(_edges_sql("shape")).alias("_edges"))
    met = _shapes(df, [one], key, meridian).crossJoin(F.broadcast(area))  # one row
    inside = f"exists(transform(flatten(shape.parts), r -> named_struct('xmin', r[0].x, 'ymin', r[0].y)), v -> {area_relation_sql('intersects', '_one', 'v', True)})"
    apart = _apart_sql(("e.p.x", "e.p.y"), ("e.q.x", "e.q.y"), ("f.p.x", "f.p.y"), ("f.q.x", "f.q.y"))
    near = F.expr(f"{inside} or exists({_edges_sql('shape')}, e -> exists(_edges, f -> {apart} <= {float(metres)!r}D))")
    if met.schema["shape"].metadata.get("shape") in ("point", "line"):
        return met.where(near).select(key)
    of_area = _shape_distance(F.when(_is_area("shape"), F.col("shape")), "_one") <= metres
    return met.where(F.when(_is_area("shape"), of_area).otherwise(near)).select(key)


def _placed(df: DataFrame, others: list[DataFrame], key: str, meridian: float | None) -> DataFrame:
    df, others = _as_points(df, key), [_corners(o) for o in others]
    return metric_xy(df.select(key, "lon", "lat").where("lon is not null and lat is not null"), *[o.select("lon", "lat") for o in others], meridian=meridian)


def _rounded(metres: Column) -> Column:
    """Metres as text, half to even."""
    return F.bround(metres, 0).cast("long").cast("string")


def _feature(row: DataFrame, alias: str) -> Column:
    """A feature struct of all columns of row; other geometries than points stay nested structs."""
    attributes = [c for c in row.columns if c not in ("lon", "lat", "geom")]
    point = F.struct(F.lit("Point").alias("type"), F.array("lon", "lat").alias("coordinates")) if _is_points(row) else F.col("geom")
    properties = F.map_from_arrays(F.array(*map(F.lit, attributes)), F.array(*[F.col(c).cast("string") for c in attributes]))
    return F.struct(F.lit("Feature").alias("type"), point.alias("geometry"), properties.alias("properties")).alias(alias)


def pairs_within(left: DataFrame, right: DataFrame, distance: float) -> DataFrame:
    """(feature_id, target_id, distance_m) of points at most distance apart. left: feature_id, x, y; right: target_id, x, y."""
    cell = lambda c: F.floor(F.col(c) / distance)
    around = lambda c: F.explode(F.sequence(F.col(c) - 1, F.col(c) + 1))
    a = left.select("feature_id", "x", "y", cell("x").alias("cx"), cell("y").alias("cy"))
    b = right.select("target_id", F.col("x").alias("tx"), F.col("y").alias("ty"), cell("x").alias("bx"), cell("y").alias("by"))
    b = b.select("target_id", "tx", "ty", "by", around("bx").alias("cx")).select("target_id", "tx", "ty", "cx", around("by").alias("cy"))
    met = a.join(b, ["cx", "cy"]).select("feature_id", "target_id", planar_distance("x", "y", "tx", "ty").alias("distance_m"))
    return met.where(F.col("distance_m") <= distance)


def nearest_within(df: DataFrame, ref: DataFrame, metres: float, meridian: float | None = None, more: list[DataFrame] | None = None) -> DataFrame:
    """(feature_id, target_id, distance_m): each feature's nearest target, the smaller target_id of equals."""
    place, nearest = _metric(df, ref)
    meridian = zone([df, ref, *(more or [])], meridian)
    left = place(df, [ref, *(more or [])], "feature_id", meridian)
    right = place(ref, [df, *(more or [])], "target_id", meridian)
    if nearest is nearest_shapes:
        return nearest_shapes(left, right, metres)
    return nearest_points(staged(left, "near-features"), staged(right, "near-targets"), metres)


def nearest_points(left: DataFrame, right: DataFrame, metres: float) -> DataFrame:
    """As nearest_within, for stored metric points.

    Counts of cells tell beforehand how many targets each feature would meet.
    Where these are few, cells as wide as the distance are joined; features in
    denser cells find their target through quadtrees, which split such cells.
    """
    dense, n = quadtree.dense_part(left, right, metres)
    if not n:
        return _best(pairs_within(left, right, metres))
    left = left.withColumn("cx", F.floor(F.col("x") / metres)).withColumn("cy", F.floor(F.col("y") / metres))
    usual = left.join(dense, ["cx", "cy"], "left_anti").drop("cx", "cy")
    hot = staged(left.join(dense, ["cx", "cy"], "left_semi").drop("cx", "cy"), "near-dense")
    around = dense.select(F.explode(F.sequence(F.col("cx") - 1, F.col("cx") + 1)).alias("cx"), "cy").select("cx", F.explode(F.sequence(F.col("cy") - 1, F.col("cy") + 1)).alias("cy")).distinct()
    right_of = right.withColumn("cx", F.floor(F.col("x") / metres)).withColumn("cy", F.floor(F.col("y") / metres))
    targets = staged(right_of.join(around, ["cx", "cy"], "left_semi").drop("cx", "cy"), "near-dense")
    return _best(pairs_within(usual, right, metres)).unionByName(quadtree.nearest(hot, targets, metres))


def _metric(df: DataFrame, ref: DataFrame) -> tuple[Callable[..., DataFrame], Callable[..., DataFrame]]:
    """How to bring both to metres, and how to find each feature's nearest target."""
    return (_placed, nearest_points) if _is_points(df) and _is_points(ref) else (_shapes, nearest_shapes)


def _best(met: DataFrame) -> DataFrame:
    best = met.groupBy("feature_id").agg(F.min(F.struct("distance_m", "target_id")).alias("n"))
    return best.select("feature_id", "n.target_id", "n.distance_m")


def near(df: DataFrame, ref: DataFrame, distance_m: float, where: Where | None = None, meridian: float | None = None) -> DataFrame:
    """Features with a target at most distance_m away; adds distance_to_target_m, match_reason, nearest_target_feature.

    df has feature_id, ref target_id, both lon and lat. Order is for the sink:
    sort by distance_to_target_m, feature_id there.
    """
    _check(distance_m, "near")
    ref = reference_filter(ref, where)
    best = nearest_within(df, ref, distance_m, meridian)
    return _enriched(df, ref, best, F.concat(F.lit("נמצא במרחק "), _rounded(F.col("distance_m")), F.lit(" מ׳ מישות הייחוס (בטווח המבוקש: "), _rounded(F.lit(float(distance_m))), F.lit(" מ׳).")))


def _enriched(df: DataFrame, ref: DataFrame, best: DataFrame, reason: Column) -> DataFrame:
    """df's rows with what best has for them; columns of the names added here are replaced. reason is over distance_m."""
    added, match, target = "nearest_target_feature", free_name(df, "_match"), free_name(df, "_target")
    own = df.drop("distance_to_target_m", "match_reason", added)
    features = ref.select(F.col("target_id").alias(target), _feature(ref, added))
    best = best.join(features, best["target_id"] == features[target])
    best = best.select("feature_id", F.struct(F.col("distance_m").alias("distance_to_target_m"), reason.alias("match_reason"), added).alias(match))
    return own.join(best, "feature_id").select(*[own[c] for c in own.columns], f"{match}.*")


def nearest_n(df: DataFrame, ref: DataFrame, count: int, where: Where | None = None, meridian: float | None = None, radius: float = 500.0) -> DataFrame:
    """The count features closest to any target, at most 50.

    Doubles the radius until enough features have a target in it, or none can
    be missing; what is farther than the radius can't be among the closest.
    Metric positions are stored once, and only features without a target so far
    go on to the next radius. One number reaches the driver in each round.
    """
    if not 1 <= count <= 50:
        raise ValueError("nearest_n: count must be 1 to 50")
    ref = reference_filter(ref, where)
    reason = F.concat(F.lit("נבחר כאחת הישויות הקרובות ביותר; המרחק מישות הייחוס הוא "), _rounded(F.col("distance_m")), F.lit(" מ׳."))
    if df.isEmpty() or ref.isEmpty():
        return _enriched(df.limit(0), ref, nearest_within(df.limit(0), ref, radius, meridian), reason)
    place, nearest = _metric(df, ref)
    meridian = zone([df, ref], meridian)
    open_, targets = staged(place(df, [ref], "feature_id", meridian), "nearest-open"), staged(place(ref, [df], "target_id", meridian), "nearest-targets")
    rounds: list[DataFrame] = []
    found = 0
    while True:
        rounds.append(staged(nearest(open_, targets, radius), "nearest-found"))
        last = rounds[-1].count()
        found += last
        if found >= count or radius > 4e7:
            break
        open_ = open_.join(rounds[-1], "feature_id", "left_anti") if last else open_
        radius *= 2 if found else 4
    top = reduce(DataFrame.unionByName, rounds).orderBy("distance_m", "feature_id").limit(count)
    return _enriched(df, ref, top, reason)


def near_all(df: DataFrame, targets: list[tuple[DataFrame, Where | None]], distance_m: float = 300.0, count: int | None = None, names: list[str] | None = None, meridian: float | None = None) -> DataFrame:
    """Features within distance_m of every one of 2 to 5 reference sets, by mean distance; the first count of them.

    Each set is joined to the survivors of the ones before, and what it finds is stored.
    """
    _check(distance_m, "near_all")
    if not 2 <= len(targets) <= 5:
        raise ValueError("near_all: 2 to 5 targets")
    if count is not None and not 1 <= count <= 50:
        raise ValueError("near_all: count must be 1 to 50")
    names = names or [f"target_{k}" for k in range(1, len(targets) + 1)]
    refs = [reference_filter(r, w) for r, w in targets]
    meridian = zone([df, *refs], meridian)
    left, ids = df, None
    for k, ref in enumerate(refs):
        best = staged(nearest_within(left, ref, distance_m, meridian, [r for r in refs if r is not ref]), "near-all")
        feature = ref.select(F.col("target_id").alias(f"_t{k}"), _feature(ref, f"_f{k}"))
        best = best.join(feature, F.col("target_id") == F.col(f"_t{k}")).select("feature_id", F.col("distance_m").alias(f"_d{k}"), f"_f{k}")
        ids = best if ids is None else ids.join(best, "feature_id")
        left = df.join(ids.select("feature_id"), "feature_id", "left_semi")
    n = len(refs)
    own = df.drop("distance_to_targets_m", "matched_reference_features", "distance_to_target_m", "match_reason")
    found = free_name(own, "_found")
    ids = ids.select("feature_id", F.struct(*[c for c in ids.columns if c != "feature_id"]).alias(found))
    each = lambda c: F.col(f"{found}.{c}")
    mean = sum((each(f"_d{k}") for k in range(1, n)), each("_d0")) / n
    reason = F.concat(F.lit(f"נמצא בטווח {round(float(distance_m))} מ׳ מכל {n} ישויות הייחוס; מרחק ממוצע "), _rounded(mean), F.lit(" מ׳."))
    joined = own.join(ids, "feature_id")
    out = joined.select(
        *[joined[c] for c in own.columns],
        F.array(*[F.struct(F.lit(names[k]).alias("layer_id"), each(f"_d{k}").alias("distance_m")) for k in range(n)]).alias("distance_to_targets_m"),
        F.array(*[each(f"_f{k}") for k in range(n)]).alias("matched_reference_features"),
        mean.alias("distance_to_target_m"),
        reason.alias("match_reason"),
    )
    return out if count is None else out.orderBy("distance_to_target_m", "feature_id").limit(count)


def between(df: DataFrame, first: DataFrame, second: DataFrame, corridor_width_m: float = 100.0, where_first: Where | None = None, where_second: Where | None = None, max_pairs: int | None = 2500, meridian: float | None = None) -> DataFrame:
    """Features within corridor_width_m of a segment between a first and a second reference.

    The pairs of references are few by the guard; each segment is copied to
    the cells along it, so features meet segments by cell.
    """
    _check(corridor_width_m, "between")
    first, second = reference_filter(first, where_first), reference_filter(second, where_second)
    if max_pairs is not None:
        a, b = (r.limit(max_pairs + 1).count() for r in (first, second))
        if a * b > max_pairs:
            raise ValueError("between: too many reference pairs; filter each target to a specific entity")
    w = float(corridor_width_m)
    meridian = zone([df, first, second], meridian)
    ends = [_placed(r, [df, o], "target_id", meridian).select(F.col("x").alias(f"{n}x"), F.col("y").alias(f"{n}y")) for r, o, n in ((first, second, "a"), (second, first, "b"))]
    segments = ends[0].crossJoin(F.broadcast(ends[1]) if max_pairs is not None else ends[1])  # at most max_pairs rows
    if not _is_points(df):
        ring = F.array(F.struct(F.col("ax").alias("x"), F.col("ay").alias("y")), F.struct(F.col("bx").alias("x"), F.col("by").alias("y")))
        box = [F.least("ax", "bx").alias("xmin"), F.least("ay", "by").alias("ymin"), F.greatest("ax", "bx").alias("xmax"), F.greatest("ay", "by").alias("ymax")]
        lines = segments.select(F.monotonically_increasing_id().alias("target_id"), F.struct(F.lit("LineString").alias("type"), *box, F.array(F.array(ring)).alias("parts")).alias("shape", metadata=LINES))
        kept = shape_pairs_within(_shapes(df, [first, second], "feature_id", meridian), lines, w).select("feature_id").distinct()
        reason = f"הישות נמצאת במסדרון שבין שתי ישויות הייחוס (רוחב {round(w)} מ׳)."
        return df.join(kept, "feature_id", "left_semi").withColumn("match_reason", F.lit(reason))
    points = _placed(df, [first, second], "feature_id", meridian)
    side = max(w, 250.0)
    cells = _cells_along(segments, side, w)
    placed = points.select("feature_id", "x", "y", F.floor(F.col("x") / side).alias("px"), F.floor(F.col("y") / side).alias("py"))
    close = F.expr(segment_distance_sql("x", "y", "ax", "ay", "bx", "by")) <= w
    kept = placed.join(cells, (F.col("px") == F.col("cx")) & (F.col("py") == F.col("cy")) & close, "left_semi").select("feature_id")
    reason = f"הישות נמצאת במסדרון שבין שתי ישויות הייחוס (רוחב {round(w)} מ׳)."
    return df.join(kept, "feature_id", "left_semi").withColumn("match_reason", F.lit(reason))


def cluster(df: DataFrame, min_group_size: int, max_distance_m: float, meridian: float | None = None) -> DataFrame:
    """Features in groups of at least min_group_size, linked at most max_distance_m apart; cluster_id is the smallest feature_id."""
    _check(max_distance_m, "cluster")
    if not 2 <= min_group_size <= 20:
        raise ValueError("cluster: group size must be 2 to 20")
    meridian = zone([df], meridian)
    if not _is_points(df):
        shapes = _shapes(df, [], "feature_id", meridian)
        links = shape_pairs_within(shapes, shapes.withColumnRenamed("feature_id", "target_id"), max_distance_m).where("feature_id < target_id")
        named = connected_components(links, "feature_id", "target_id").select(F.col("node").alias("feature_id"), F.col("component").alias("cluster_id"))
        large = named.groupBy("cluster_id").agg(F.count("*").alias("n")).where(F.col("n") >= min_group_size)
        return df.drop("cluster_id").join(named.join(large, "cluster_id", "left_semi"), "feature_id")
    points = _placed(df, [], "feature_id", meridian)
    side = max_distance_m / 2**0.5 * (1 - 1e-12)
    cell = [F.floor(F.col(c) / side).alias(f"c{c}") for c in ("x", "y")]
    placed = staged(points.select("feature_id", "x", "y", *cell), "cluster-points")
    cells, links = dense_cells(placed, max_distance_m)
    found = connected_components(links)
    groups = cells.join(found, F.col("cell") == F.col("node"), "left").select("cx", "cy", "n", "least", F.coalesce("component", "cell").alias("group"))
    large = groups.groupBy("group").agg(F.sum("n").alias("size"), F.min("least").alias("cluster_id")).where(F.col("size") >= min_group_size)
    named = groups.join(large, "group").select("cx", "cy", "cluster_id")
    return df.drop("cluster_id").join(placed.join(named, ["cx", "cy"]).select("feature_id", "cluster_id"), "feature_id")


def dense_cells(placed: DataFrame, metres: float) -> tuple[DataFrame, DataFrame]:
    """(cx, cy, cell, n, least) and links (a, b) of cells, for points (feature_id, x, y, cx, cy) in cells so small that all points of one are near.

    However many points a cell has, it is one node, and two cells are linked or
    not. Most pairs of cells are settled by the eight outermost points of each;
    only for the others do points meet points, those near the other cell.
    """
    x, y, at = F.col("x"), F.col("y"), F.struct("x", "y")
    outer = [agg(at, by) for by in (x, y, x + y, x - y) for agg in (F.min_by, F.max_by)]
    sides = [agg(c).alias(f"{n}{k}") for n, c in (("x", x), ("y", y)) for agg, k in ((F.min, 0), (F.max, 1))]
    cells = placed.groupBy("cx", "cy").agg(F.count("*").alias("n"), F.min("feature_id").alias("least"), F.array(*outer).alias("outer"), *sides)
    cells = staged(cells.withColumn("cell", F.monotonically_increasing_id()), "cluster-cells")
    # Each pair of cells at most two apart once: from the left one, of one column from the lower.
    steps = F.array(*[F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i in range(3) for j in range(-2, 3) if (i, j) > (0, 0)])
    a = cells.select(F.col("cell").alias("a"), "cx", "cy", *[F.col(c).alias(f"a_{c}") for c in ("outer", "x0", "x1", "y0", "y1")], F.explode(steps).alias("s"))
    a = a.select("*", (F.col("cx") + F.col("s.i")).alias("bx"), (F.col("cy") + F.col("s.j")).alias("by")).drop("cx", "cy", "s")
    b = cells.select(F.col("cell").alias("b"), F.col("cx").alias("bx"), F.col("cy").alias("by"), *[F.col(c).alias(f"b_{c}") for c in ("outer", "x0", "x1", "y0", "y1")])
    gap = [F.greatest(F.lit(0.0), F.col(f"b_{c}0") - F.col(f"a_{c}1"), F.col(f"a_{c}0") - F.col(f"b_{c}1")) for c in ("x", "y")]
    limit = F.lit(float(metres))
    pairs = a.join(b, ["bx", "by"]).where(F.sqrt(gap[0] * gap[0] + gap[1] * gap[1]) <= limit)
    near = F.exists("a_outer", lambda p: F.exists("b_outer", lambda q: planar_distance(p["x"], p["y"], q["x"], q["y"]) <= limit))
    pairs = staged(pairs.select("a", "b", near.alias("near"), *[f"{k}_{c}" for k in "ab" for c in ("x0", "x1", "y0", "y1")]), "cluster-pairs")
    open_ = pairs.where("not near")

    def points_near(own: str, other: str) -> DataFrame:
        """(a, b, x, y): the points of one cell of each open pair that the other cell's points can reach."""
        away = [F.greatest(F.lit(0.0), F.col(f"{other}_{c}0") - F.col(c), F.col(c) - F.col(f"{other}_{c}1")) for c in ("x", "y")]
        of = placed.join(cells.select("cx", "cy", F.col("cell").alias(own)), ["cx", "cy"]).select(own, "x", "y")
        return open_.join(of, own).where(F.sqrt(away[0] * away[0] + away[1] * away[1]) <= limit).select("a", "b", "x", "y")

    left, right = points_near("a", "b"), points_near("b", "a").toDF("ra", "rb", "rx", "ry")
    meets = (F.col("a") == F.col("ra")) & (F.col("b") == F.col("rb")) & (planar_distance("x", "y", "rx", "ry") <= limit)
    settled = left.join(right, meets, "left_semi").select("a", "b").distinct()
    return cells, pairs.where("near").select("a", "b").unionByName(settled)
