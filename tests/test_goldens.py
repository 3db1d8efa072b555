"""Fixed answers on a small city: schools, roundabouts, moving buses, simple shapes."""

import json
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from geoweft.functions.geodesy import metric_xy
from geoweft.functions.geometry import LINES, geometry_of, line_geometry, parse_wkt, relation
from geoweft.operators import filters, moving, proximity, ranking, topology
from geoweft.plans.steps import OPERATIONS, SOURCES, Layer, PlanError, catalog_layers, check_plan, load_layer, near_boundary, register_op, register_source, run_plan

SCHOOLS = [
    (1, "north", "Tel Aviv", 34.7740, 32.0900),
    (2, "dizengoff school", "Tel Aviv", 34.7748, 32.0779),
    (3, "east", "Tel Aviv", 34.7900, 32.0850),
    (4, "far south", "Holon", 34.7720, 32.0160),
    (5, "far south two", "Holon", 34.7770, 32.0165),
    (6, "school-with_Dashes", "Ramat Gan", 34.8200, 32.0800),
    (7, None, None, 34.7750, 32.0785),
]
SQUARES = [(101, "Dizengoff Square", 34.7741, 32.0772), (102, "other square", 34.9000, 32.2000)]


@pytest.fixture(scope="module")
def schools(spark):
    return spark.createDataFrame(SCHOOLS, "feature_id long, name string, city string, lon double, lat double")


@pytest.fixture(scope="module")
def squares(spark):
    return spark.createDataFrame(SQUARES, "target_id long, name string, lon double, lat double")


def ids(df):
    return sorted(r.feature_id for r in df.select("feature_id").collect())


def test_zone_follows_the_data(spark):
    p = spark.createDataFrame([(-118.4912, 33.985)], "lon double, lat double")
    r = metric_xy(p).first()
    assert abs(r.x - 362271) < 2000 and abs(r.y - 3761500) < 2000


def test_near_and_reference_filter(schools, squares):
    found = proximity.near(schools, squares, 300)
    assert ids(found) == [2, 7]
    row = found.where("feature_id = 2").first()
    assert 90 < row.distance_to_target_m < 125
    assert f"{round(row.distance_to_target_m)} מ׳" in row.match_reason and "300 מ׳" in row.match_reason
    assert row.nearest_target_feature.properties["name"] == "Dizengoff Square"
    assert ids(proximity.near(schools, squares, 300, ("name", "contains", "OTHER"))) == []
    with pytest.raises(ValueError):
        proximity.near(schools, squares, 300, ("name", "eq", None))
    with pytest.raises(ValueError):
        proximity.near(schools, squares, 5001)


def test_nearest_n_beyond_the_matches(schools, squares):
    assert proximity.nearest_n(schools, squares, 50).count() == 7
    top = proximity.nearest_n(schools, squares, 2)
    assert sorted(r.feature_id for r in top.collect()) == [2, 7]
    assert proximity.nearest_n(schools.limit(0), squares, 2).count() == 0


def test_near_equals_brute_force(spark):
    a = spark.range(400).select(F.col("id").alias("feature_id"), (34.7 + (F.col("id") * 7919 % 997) / 5000).alias("lon"), (32.0 + (F.col("id") * 104729 % 991) / 5000).alias("lat"))
    b = a.where("feature_id % 7 = 0").withColumnRenamed("feature_id", "target_id")
    a, b = a.where("feature_id % 7 <> 0"), b
    got = {r.feature_id: (r.target_id, round(r.distance_m, 6)) for r in proximity.nearest_within(a, b, 700).collect()}
    x, y = metric_xy(a, b).collect(), metric_xy(b, a).collect()
    want = {}
    for p in x:
        d, t = min((((p.x - q.x) ** 2 + (p.y - q.y) ** 2) ** 0.5, q.target_id) for q in y)
        if d <= 700:
            want[p.feature_id] = (t, round(d, 6))
    assert got == want and want


def test_near_all_ranks_by_mean(spark):
    at = lambda rows, key: spark.createDataFrame(rows, f"{key} long, lon double, lat double")
    df = at([(1, 34.7700, 32.0700), (2, 34.7705, 32.0700), (3, 34.7600, 32.0700)], "feature_id")
    one, two = at([(1, 34.7701, 32.0701)], "target_id"), at([(1, 34.7710, 32.0700)], "target_id")
    found = proximity.near_all(df, [(one, None), (two, None)], 180, 2, ["a", "b"])
    rows = found.orderBy("distance_to_target_m").collect()
    assert [r.feature_id for r in rows] == [2, 1] or [r.feature_id for r in rows] == [1, 2]
    assert [d.layer_id for d in rows[0].distance_to_targets_m] == ["a", "b"]
    assert abs(rows[0].distance_to_target_m - sum(d.distance_m for d in rows[0].distance_to_targets_m) / 2) < 1e-9
    assert proximity.near_all(df, [(one, None), (two.limit(0), None)], 180).count() == 0


def test_between_and_pair_guard(spark):
    at = lambda rows, key: spark.createDataFrame(rows, f"{key} long, lon double, lat double")
    df = at([(1, 34.75, 32.05), (2, 34.75, 32.08)], "feature_id")
    a, b = at([(1, 34.74, 32.05)], "target_id"), at([(2, 34.76, 32.05)], "target_id")
    assert ids(proximity.between(df, a, b, 100)) == [1]
    with pytest.raises(ValueError):
        proximity.between(df, a.union(a), b.union(b), 100, max_pairs=3)


def test_cluster_is_transitive(spark):
    rows = [(k, 34.75 + k * 0.001, 32.0) for k in range(5)] + [(9, 34.9, 32.0), (10, 34.9, 32.0)]
    df = spark.createDataFrame(rows, "feature_id long, lon double, lat double")
    found = {r.feature_id: r.cluster_id for r in proximity.cluster(df, 3, 120).collect()}
    assert found == {k: 0 for k in range(5)}
    assert {r.feature_id for r in proximity.cluster(df, 2, 120).collect()} == {0, 1, 2, 3, 4, 9, 10}


def test_attribute_filters(schools):
    f = filters.attribute_filter
    assert ids(f(schools, "city", "eq", "Holon")) == [4, 5]
    assert ids(f(schools, "city", "neq", "Holon")) == [1, 2, 3, 6, 7]
    assert ids(f(schools, "lat", "gt", "32.084")) == [1, 3]
    assert ids(f(schools, "name", "contains", "WITH dashes")) == [6]
    assert ids(f(schools, "name", "fuzzy_contains", "dizengof scool")) == [2]
    with pytest.raises(ValueError):
        f(schools, "ghost", "eq", 1)


def test_hebrew_normalisation(spark):
    df = spark.createDataFrame([(1, "עירוני ד'"), (2, "בֵּית־סֵפֶר גרץ"), (3, "ת״א"), (4, None)], "feature_id long, name string")
    assert ids(filters.attribute_filter(df, "name", "contains", "עירוני ד׳")) == [1]
    assert ids(filters.attribute_filter(df, "name", "contains", "תא")) == [3]
    assert ids(filters.attribute_filter(df, "name", "fuzzy_contains", "ביתספר גרס")) == [2]


def test_time(spark):
    rows = [(1, "2026-07-08T00:00:00Z"), (2, "2026-07-08 23:59:59"), (3, "bad"), (4, None), (5, "2026-07-09")]
    df = spark.createDataFrame(rows, "feature_id long, at string")
    assert ids(filters.temporal_filter(df, "at", "2026-07-08", "2026-07-08T23:59:59Z")) == [1, 2]
    for a, b, column in (("x", "y", "at"), ("2026-07-09", "2026-07-08", "at"), ("2026-07-08", "2026-07-09", None)):
        with pytest.raises(ValueError):
            filters.temporal_filter(df, column, a, b)


FIXES = [
    (1, "bus-south", "2026-07-09T10:00:00Z", 34.78, 32.10),
    (2, "bus-south", "2026-07-09T11:00:00Z", 34.7804, 32.08),
    (3, "bus-north", "2026-07-09T10:00:00Z", 34.78, 32.05),
    (4, "bus-north", "2026-07-09T11:00:00Z", 34.78, 32.07),
    (5, "once", "2026-07-09T10:00:00Z", 34.7, 32.0),
    (6, None, "2026-07-09T12:00:00Z", 34.7, 32.0),
    (7, "patrol", "2026-07-09T10:00:00Z", 34.70, 32.00),
    (8, "patrol", "2026-07-09T10:10:00Z", 34.71, 32.00),
    (9, "patrol", "2026-07-09T10:20:00Z", 34.70, 32.00),
]


def test_moving(spark):
    df = spark.createDataFrame(FIXES, "feature_id long, netId string, eventTime string, lon double, lat double")
    assert ids(moving.latest_per_entity(df)) == [2, 4, 5, 9]
    south = moving.movement_direction(df, "south", min_distance_m=100).collect()
    assert [r.feature_id for r in south] == [2] and abs(south[0].movement_distance_m - 2217.65) < 2
    assert len(south[0].movement_path.coordinates) == 2 and south[0].movement_direction == "south"
    assert ids(moving.movement_direction(df, "any")) == [2, 4, 9]
    with pytest.raises(ValueError):
        moving.movement_direction(df, "up")


def shapes(spark, rows, key):
    df = spark.createDataFrame(rows, f"{key} long, wkt string")
    return df.select(key, geometry_of("wkt").alias("geom"))


def test_topology(spark):
    lines = shapes(spark, [(1, "LINESTRING(0 0,2 2)"), (2, "LINESTRING(5 5,6 6)")], "feature_id")
    bar = shapes(spark, [(1, "LINESTRING(0 2,2 0)")], "target_id")
    assert ids(topology.crosses(lines, bar, cell=1.0)) == [1]
    squares = shapes(spark, [(1, "POLYGON((0 0,1 0,1 1,0 1,0 0))"), (2, "POLYGON((5 0,6 0,6 1,5 1,5 0))"), (3, "POLYGON((0.5 0,2 0,2 1,0.5 1,0.5 0))")], "feature_id")
    other = shapes(spark, [(1, "POLYGON((1 0,2 0,2 1,1 1,1 0))")], "target_id")
    assert ids(topology.touches(squares, other, cell=1.0)) == [1]
    assert ids(topology.contains(squares, other, cell=1.0)) == [3]
    point = spark.createDataFrame([(1, 0.5, 0.5), (2, 1.0, 0.5)], "target_id long, lon double, lat double")
    assert ids(topology.contains(squares, point.where("target_id = 1"), cell=1.0)) == [1]
    assert ids(topology.contains(squares, point.where("target_id = 2"), cell=1.0)) == [3]
    box = filters.boundary_from_bbox(-1, -1, 0.6, 0.6)
    assert ids(filters.within_geometry(squares, box)) == [1, 3]


def test_directional_and_cells(schools):
    assert ids(ranking.directional(schools, "north")) == [1]
    assert ids(ranking.directional(schools, "east", 2)) == [3, 6]
    cells = {r.feature_id: r.cell for r in ranking.adaptive_cells(schools, 2, 6, (34.7, 32.0, 34.9, 32.2)).collect()}
    assert len(cells) == 7 and max(len(c) for c in cells.values()) > 1


def test_plans(spark, schools, squares):
    layers = {"schools": Layer(schools), "squares": Layer(squares.withColumnRenamed("target_id", "feature_id"))}
    plan = json.loads('{"steps":[{"id":"a","op":"load","layer":"schools"},{"id":"b","op":"within_geometry","input":"a"},{"id":"c","op":"near","input":"b","target_layer":"squares","distance_m":300,"target_field":"name","target_operator":"contains","target_value":"dizengoff"},{"id":"d","op":"count","input":"c"}],"output":"d"}')
    box = filters.boundary_from_bbox(34.76, 32.06, 34.79, 32.09)
    assert run_plan(spark, plan, layers, box, datetime(2026, 7, 9)).first()["count"] == 2
    known = {"schools", "squares"}
    good = plan["steps"]
    for steps, output, boundary in (
        ([], "d", False),
        (good, "d", False),
        ([good[0]], "a", True),
        ([good[0], good[0]], "a", False),
        ([{"id": "a", "op": "load", "layer": "ghost"}], "a", False),
        ([{"id": "a", "op": "nothing", "input": "x"}], "a", False),
        ([good[0], {"id": "n", "op": "near", "input": "a", "target_layer": "squares", "distance_m": 1, "target_field": "x"}], "n", False),
        ([good[0], {"id": "n", "op": "count", "input": "a"}, {"id": "m", "op": "directional", "direction": "north", "input": "n"}], "m", False),
    ):
        with pytest.raises(PlanError):
            check_plan({"steps": steps, "output": output}, known, boundary)


def test_distances_of_lines_and_areas(spark):
    areas = shapes(spark, [(1, "POLYGON((34.75 32.05,34.76 32.05,34.76 32.06,34.75 32.06,34.75 32.05))"), (2, "LINESTRING(34.80 32.05,34.81 32.05)"), (3, "POINT(34.9 32.2)")], "feature_id")
    ref = spark.createDataFrame([(7, 34.755, 32.0605), (8, 34.805, 32.0505), (9, 34.756, 32.055)], "target_id long, lon double, lat double")
    got = {r.feature_id: (r.target_id, r.distance_m) for r in proximity.nearest_within(areas, ref, 200).collect()}
    assert got[1] == (9, 0.0) and got[2][0] == 8 and 50 < got[2][1] < 60 and 3 not in got
    assert ids(proximity.near(areas, ref, 200)) == [1, 2]
    assert {r.feature_id: r.cluster_id for r in proximity.cluster(areas, 2, 5000).collect()} == {1: 1, 2: 1}
    a, b = (spark.createDataFrame([(1, x, 32.0555)], "target_id long, lon double, lat double") for x in (34.70, 34.80))
    assert ids(proximity.between(areas, a, b, 100)) == [1]


def test_boundary_grown_for_lines_and_areas(spark):
    """0.001 degrees of longitude are some 94 m at 32 north."""
    box = filters.boundary_from_bbox(34.76, 32.05, 34.79, 32.09)
    rows = [(1, "LINESTRING(34.7905 32.06,34.80 32.06)"), (2, "LINESTRING(34.795 32.06,34.80 32.06)"), (3, "POLYGON((34.77 32.06,34.78 32.06,34.78 32.07,34.77 32.06))"), (4, "LINESTRING(34.70 32.00,34.90 32.0495)")]
    df = shapes(spark, rows, "feature_id")
    assert ids(near_boundary(df, box, 100)) == [1, 3] and ids(near_boundary(df, box, 3000)) == [1, 2, 3, 4]
    points = spark.createDataFrame([(1, 34.7905, 32.06), (2, 34.795, 32.06)], "feature_id long, lon double, lat double")
    assert ids(near_boundary(points, box, 100)) == [1]
    # A plan's targets may be lines: one just outside the boundary is a target.
    plan = {"steps": [{"id": "a", "op": "load", "layer": "p"}, {"id": "b", "op": "within_geometry", "input": "a"}, {"id": "c", "op": "near", "input": "b", "target_layer": "l", "distance_m": 100}], "output": "c"}
    inside = spark.createDataFrame([(7, 34.7899, 32.06), (8, 34.77, 32.08)], "feature_id long, lon double, lat double")
    assert ids(run_plan(spark, plan, {"p": Layer(inside), "l": Layer(df.where("feature_id = 1"))}, box)) == [7]


def test_plans_read_day_first_times(spark):
    rows = [(1, "x", "01/02/2026 10:00:00", 34.7, 32.0), (2, "x", "02/01/2026 10:00:00", 34.8, 32.0), (3, "y", "never", 34.7, 32.0)]
    df = spark.createDataFrame(rows, "feature_id long, netId string, eventTime string, lon double, lat double")
    layers = {"m": Layer(df, "eventTime", time_formats=["dd/MM/yyyy HH:mm:ss"])}
    steps = [{"id": "a", "op": "load", "layer": "m"}, {"id": "b", "op": "latest_per_entity", "input": "a"}]
    assert ids(run_plan(spark, {"steps": steps, "output": "b"}, layers)) == [1]
    steps[1] = {"id": "b", "op": "movement_direction", "input": "a", "direction": "west"}
    assert ids(run_plan(spark, {"steps": steps, "output": "b"}, layers)) == [1]


def test_step_counts(spark, schools, squares):
    steps = [{"id": "a", "op": "load", "layer": "s"}, {"id": "b", "op": "attribute_filter", "input": "a", "field": "city", "operator": "eq", "value": "Holon"}, {"id": "c", "op": "count", "input": "b"}]
    counts = {}
    out = run_plan(spark, {"steps": steps, "output": "c"}, {"s": Layer(schools)}, counts=counts)
    assert out.first()["count"] == 2
    assert {k: o.get[f"{k}_rows"] for k, o in counts.items()} == {"a": 7, "b": 2, "c": 1}


def test_sources_and_operations_by_name(spark, schools):
    register_source("city", lambda spark, url, most="99": schools.where(f"feature_id <= {most}"))
    register_op("odd_only", lambda df, step, ctx: df.where("feature_id % 2 = 1"))
    try:
        rows = [("s", "schools", "", [], "city", "x://layers/s?param_most=5"), ("g", "ghost", "", [], "nowhere", "x://layers/g")]
        catalog = spark.createDataFrame(rows, "id string, name string, description string, tags array<string>, provider string, source_url string")
        assert ids(load_layer(spark, catalog, "s").features) == [1, 2, 3, 4, 5]
        assert ids(load_layer(spark, catalog, "s", equals=[("city", "Holon")]).features) == [4, 5]
        assert ids(load_layer(spark, catalog, "s", filters.boundary_from_bbox(34.77, 32.08, 34.79, 32.09)).features) == [1, 3]
        plan = {"steps": [{"id": "a", "op": "load", "layer": "s"}, {"id": "b", "op": "odd_only", "input": "a"}], "output": "b"}
        assert ids(run_plan(spark, plan, catalog_layers(spark, catalog, plan))) == [1, 3, 5]
        for ghost in ("g", "none"):
            with pytest.raises(PlanError):
                load_layer(spark, catalog, ghost)
    finally:
        SOURCES.pop("city")
        OPERATIONS.pop("odd_only")


def snyder(lon, lat, meridian):
    """The same projection by another series, in powers of the angle from the meridian."""
    from math import cos, radians, sin, sqrt, tan

    a, f = 6378137.0, 1 / 298.257223563
    e2 = f * (2 - f)
    p2, phi = e2 / (1 - e2), radians(lat)
    n, t, c, w = a / sqrt(1 - e2 * sin(phi) ** 2), tan(phi) ** 2, p2 * cos(phi) ** 2, cos(phi) * radians(lon - meridian)
    m = a * ((1 - e2 / 4 - 3 * e2**2 / 64 - 5 * e2**3 / 256 - 175 * e2**4 / 16384) * phi - (3 * e2 / 8 + 3 * e2**2 / 32 + 45 * e2**3 / 1024 + 105 * e2**4 / 4096) * sin(2 * phi) + (15 * e2**2 / 256 + 45 * e2**3 / 1024 + 525 * e2**4 / 16384) * sin(4 * phi) - (35 * e2**3 / 3072 + 175 * e2**4 / 12288) * sin(6 * phi) + 315 * e2**4 / 131072 * sin(8 * phi))
    x = 500000 + 0.9996 * n * (w + (1 - t + c) * w**3 / 6 + (5 - 18 * t + t * t + 72 * c - 58 * p2) * w**5 / 120)
    return x, 0.9996 * (m + n * tan(phi) * (w * w / 2 + (5 - t + 9 * c + 4 * c * c) * w**4 / 24 + (61 - 58 * t + t * t + 600 * c - 330 * p2) * w**6 / 720))


def test_projection_equals_another_series(spark):
    rows = [(k, m + 0.19 * (k % 31) - 2.85, -79.0 + 5.27 * (k % 31)) for k, m in enumerate([-177, -75, 3, 33, 177] * 31)]
    for m in (-177, -75, 3, 33, 177):
        own = [r for r in rows if abs(r[1] - m) < 3.1]
        df = spark.createDataFrame(own, "k long, lon double, lat double")
        got = {r.k: r for r in metric_xy(df, meridian=float(m)).collect()}
        assert len(got) == 31
        for k, lon, lat in own:
            x, y = snyder(lon, lat, m)
            assert abs(got[k].x - x) < 0.005 and abs(got[k].y - y) < 0.005


def slow_clusters(points, metres):
    parent = list(range(len(points)))

    def root(k):
        while parent[k] != k:
            parent[k] = parent[parent[k]]
            k = parent[k]
        return k

    for i, (x, y) in enumerate(points):
        for j in range(i):
            if ((x - points[j][0]) ** 2 + (y - points[j][1]) ** 2) ** 0.5 <= metres:
                a, b = sorted((root(i), root(j)))
                parent[b] = a
    return [root(k) for k in range(len(points))]


def test_clusters_equal_all_pairs(spark):
    """Points in cells of few, and pairs of cells that only inner points settle."""
    import random

    r = random.Random(8)
    rows = [(k, 34.8 + r.gauss(0, 0.01), 32.0 + r.gauss(0, 0.01)) for k in range(700)]
    df = spark.createDataFrame(rows, "feature_id long, lon double, lat double")
    at = {p.feature_id: (p.x, p.y) for p in metric_xy(df).collect()}
    for metres in (40.0, 90.0, 400.0):
        want = slow_clusters([at[k] for k in range(700)], metres)
        sizes = {c: want.count(c) for c in want}
        got = {p.feature_id: p.cluster_id for p in proximity.cluster(df, 2, metres).collect()}
        assert got == {k: c for k, c in enumerate(want) if sizes[c] > 1}


def test_a_hundred_thousand_points_in_one_cell(spark):
    df = spark.range(100_000).selectExpr("id AS feature_id", "34.8 + (id * 7919 % 100003) / 100003 * 0.0009 AS lon", "32.0 + (id * 104729 % 99991) / 99991 * 0.0009 AS lat")
    far = spark.createDataFrame([(200_000, 34.9, 32.0)], "feature_id long, lon double, lat double")
    found = proximity.cluster(df.unionByName(far), 2, 120).groupBy("cluster_id").count().collect()
    assert [(r.cluster_id, r["count"]) for r in found] == [(0, 100_000)]
    few = spark.range(2000).selectExpr("id AS feature_id", "34.8 + id / 2000 * 0.0009 AS lon", "32.0004D AS lat")
    assert proximity.near(few, df.withColumnRenamed("feature_id", "target_id"), 120).count() == 2000


def test_published_projections(spark):
    """Easting and northing as published for the CN Tower, and symmetry over the equator, a zone's middle and its edges."""
    p = spark.createDataFrame([(0, -79.387139, 43.642567)], "k long, lon double, lat double")
    r = metric_xy(p).first()
    assert abs(r.x - 630084) < 1 and abs(r.y - 4833438) < 1
    rows = [(0, 177.0, -45.0), (1, 174.0, -45.0), (2, 180.0, -45.0)]
    south = {r.k: r for r in metric_xy(spark.createDataFrame(rows, "k long, lon double, lat double"), meridian=177.0).collect()}
    assert abs(south[0].x - 500000) < 1e-6 and abs((south[1].x + south[2].x) / 2 - 500000) < 1e-6 and abs(south[1].y - south[2].y) < 1e-6
    # The quarter meridian of WGS84 is 10001965.729 m long.
    pole = metric_xy(spark.createDataFrame([(0, 3.0, 90.0)], "k long, lon double, lat double"), meridian=3.0).first()
    assert abs(pole.y - 0.9996 * 10001965.729) < 0.01
    zones = metric_xy(spark.createDataFrame([(0, 151.2153, -33.8568)], "k long, lon double, lat double")).first()
    assert 334000 < zones.x < 335500 and 6251000 < zones.y < 6253000


def test_line_relations_equal_the_kernel(spark):
    """Random lines of one or several parts on a coarse grid: crossings, touches, overlaps, closed rings and shared ends, by edges and by the kernel."""
    import random

    r = random.Random(4)
    grid = lambda: (float(r.randrange(5)), float(r.randrange(5)))
    bent = lambda: (r.uniform(0, 5), r.uniform(0, 5))

    def line():
        part = [r.choice([grid, grid, bent])() for _ in range(r.choice([2, 2, 3, 5]))]
        return part + [part[0]] if r.random() < 0.2 else part

    texts = []
    for _ in range(60):
        parts = [line() for _ in range(r.choice([1, 1, 1, 2]))]
        body = ["(" + ", ".join(f"{x!r} {y!r}" for x, y in p) + ")" for p in parts if len(set(p)) > 1]
        if body:
            texts.append(("LINESTRING " + body[0]) if len(body) == 1 else f"MULTILINESTRING ({', '.join(body)})")
    areas = ["POLYGON ((1 1, 3 1, 3 3, 1.5 3.5, 1 1))", "POLYGON ((0 0, 5 0, 5 5, 0 5, 0 0), (1 1, 2 1, 2 2, 1 2, 1 1))", "POINT (2 2)"]
    rows = [(k, t) for k, t in enumerate([*texts, *areas])]
    df = spark.createDataFrame(rows, "feature_id long, wkt string").withColumn("geom", geometry_of("wkt"))
    shapes = {k: parse_wkt(t) for k, t in rows}
    for predicate in ("crosses", "touches", "contains", "intersects"):
        want = {(a, b) for a in shapes for b in shapes if relation(shapes[a], shapes[b])[predicate]}
        for cell in (0.7, 3.0):
            got = topology.pairs(df, df.withColumnRenamed("feature_id", "target_id"), predicate, cell=cell).collect()
            assert len(got) == len(want) and {(x.feature_id, x.target_id) for x in got} == want, predicate


def test_lines_meet_lines_without_python(spark):
    ends = spark.createDataFrame([(1, 0.0, 0.0, 1.0, 1.0)], "feature_id long, a double, b double, c double, d double")
    line = ends.select("feature_id", line_geometry(F.col("a"), F.col("b"), F.col("c"), F.col("d")).alias("geom", metadata=LINES))
    plan = topology.crosses(line, line.withColumnRenamed("feature_id", "target_id"))._jdf.queryExecution().toString()
    assert "Arrow" not in plan and "Python" not in plan
