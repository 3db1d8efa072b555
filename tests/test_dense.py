"""Dense layers: results equal brute force, and work stays near the size of the input."""

import random

import pytest
from pyspark.sql import functions as F

from geoweft.functions.geometry import LINES, distance, geometry_of, line_geometry, parse_wkt
from geoweft.operators import edges, proximity, topology


def random_lines(spark, n, key="feature_id", seed=3):
    """Lines of one to three parts on a coarse grid, some ids twice."""
    rng = random.Random(seed)
    rows = []
    for k in range(n):
        parts = [", ".join(f"{rng.randrange(7) / 10} {rng.randrange(7) / 10}" for _ in range(rng.randrange(2, 5))) for _ in range(rng.randrange(1, 4))]
        rows.append((k // 2 if k % 9 == 1 else k, f"MULTILINESTRING ({', '.join(f'({p})' for p in parts)})"))
    df = spark.createDataFrame(rows, f"{key} long, wkt string").select(key, geometry_of("wkt").alias("geom")).where("geom.type is not null").localCheckpoint()
    return df.select(key, F.col("geom").alias("geom", metadata=LINES))


@pytest.mark.parametrize("predicate", ["crosses", "touches", "intersects"])
@pytest.mark.parametrize("rounds", [(1, 3), ()])
def test_lines_with_a_partner_are_those_of_the_pairs(spark, monkeypatch, predicate, rounds):
    monkeypatch.setattr(edges, "ROUNDS", rounds)
    a, b = random_lines(spark, 40), random_lines(spark, 6, "target_id", seed=4)
    want = {r.feature_id for r in edges.line_pairs(a, b, predicate, 0.3).collect()}
    got = [r.feature_id for r in edges.lines_with(a, b, predicate, 0.3).collect()]
    assert set(got) == want and (predicate == "touches" or 0 < len(want))


def test_dense_crossings_do_not_make_all_pairs(spark, monkeypatch):
    """Of 1,200 long lines each crosses hundreds of others; one is enough to tell."""
    n, seen = 1200, []
    real = edges.events

    def counting(met):
        found = real(met)
        seen.append(found.count())
        return found

    monkeypatch.setattr(edges, "events", counting)
    at = [(F.xxhash64("id", F.lit(k)) % 100000).cast("double") / 1e6 for k in range(4)]
    lines = spark.range(n).select(F.col("id").alias("feature_id"), line_geometry(*at).alias("geom", metadata=LINES)).localCheckpoint()
    assert topology.crosses(lines, lines.withColumnRenamed("feature_id", "target_id"), cell=0.02).count() > 0.9 * n
    assert sum(seen) < 100 * n


SHAPES = ["POINT (0 0)", "POINT (900 40)", "MULTIPOINT ((50 50), (4000 10))", "LINESTRING (0 100, 3000 100)", "LINESTRING (-500 -500, 2500 900, 2500 3000)", "MULTILINESTRING ((0 0, 10 10), (700 -900, 700 900))", "POLYGON ((600 -100, 1200 -100, 1200 300, 600 300, 600 -100))", "LINESTRING (800 0, 810 10)"]


def in_metres(spark, key, kinds):
    rows = [(k, x) for k, x in enumerate(SHAPES) if x.split(" ")[0].removeprefix("MULTI") in kinds]
    return spark.createDataFrame(rows, f"{key} long, wkt string").select(key, geometry_of("wkt").alias("shape"))


def test_shape_distances_equal_the_kernel(spark):
    every = ("POINT", "LINESTRING", "POLYGON")
    got = {(r.feature_id, r.target_id): r.distance_m for r in proximity.shape_pairs_within(in_metres(spark, "feature_id", every), in_metres(spark, "target_id", every), 300).collect()}
    parsed = [parse_wkt(x) for x in SHAPES]
    want = {(i, j): d for i, a in enumerate(parsed) for j, b in enumerate(parsed) if (d := distance(a, b)) <= 300}
    assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-9 for k in want)


def test_points_meet_lines_and_lines_a_boundary_without_python(spark):
    lines = spark.range(3).select(F.col("id").alias("target_id"), line_geometry(F.lit(34.7), F.lit(32.0), F.lit(34.8), F.lit(32.1) + F.col("id") / 1000).alias("geom", metadata=LINES))
    points = spark.range(3).select(F.col("id").alias("feature_id"), F.lit(34.75).alias("lon"), F.lit(32.05).alias("lat"))
    area = lines.limit(1).select("target_id", geometry_of(F.lit("POLYGON ((34 32, 35 32, 35 33, 34 33, 34 32))")).alias("geom")).localCheckpoint()
    for found in (proximity.near(points, lines, 150, meridian=33.0), proximity.shapes_near_one(lines, area, 150, "target_id", 33.0)):
        plan = found._jdf.queryExecution().toString()
        assert "Arrow" not in plan and "Python" not in plan and found.count() == 3


def test_dense_places_and_lines_do_not_make_all_pairs(spark, monkeypatch):
    """Copies of places and lines count once, cells where many of them meet are split, and the nearest line is that of brute force."""
    seen = []
    real = proximity._closest

    def counting(units, edges, cells, *args):
        seen.append(units.join(edges, cells).count())
        return real(units, edges, cells, *args)

    monkeypatch.setattr(proximity, "_closest", counting)
    monkeypatch.setattr(proximity, "EDGES", 8)
    at = lambda k, wide: 34.75 + (F.xxhash64(F.col("id") % 300, F.lit(k)) % 1000).cast("double") * wide / 1000
    points = spark.range(3000).select(F.col("id").alias("feature_id"), at(1, 0.003).alias("lon"), (at(2, 0.003) - 2.7).alias("lat")).localCheckpoint()
    lines = spark.range(1500).select((F.col("id") + 1).alias("target_id"), line_geometry(at(3, 0.01), at(4, 0.01) - 2.7, at(5, 0.01), at(6, 0.01) - 2.7).alias("geom", metadata=LINES)).localCheckpoint()
    got = {r.feature_id: (r.target_id, r.distance_m) for r in proximity.nearest_within(points, lines, 150, 33.0).collect()}
    p = proximity._shapes(points.where("feature_id < 300"), [], "feature_id", 33.0).collect()
    t = proximity._shapes(lines.where("target_id <= 300"), [], "target_id", 33.0).collect()
    for a in p:
        d, best = min((distance(a.shape.asDict(True), b.shape.asDict(True)), b.target_id) for b in t)
        assert (a.feature_id in got) == (d <= 150)
        for k in range(a.feature_id, 3000, 300) if d <= 150 else ():
            assert got[k][0] == best and abs(got[k][1] - d) < 1e-9
    assert len(seen) > 2 and sum(seen) < 300 * 300
