"""The registered queries of the geospatial operators, each with its twin in DuckDB SQL where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from geoweft.functions.geodesy import AXIS, FLATTENING, compass, coordinate_text, metric_xy, projection_sql
from geoweft.functions.geometry import geometry_of, point_of, representative_point
from geoweft.functions.text import clean_tags, normalize_text, sanitize
from geoweft.operators import filters, moving, profiling, proximity, ranking, topology
from geoweft.plans.steps import Layer, run_plan
from geoweft.sources import catalog, features
from geoweft.sources.layers import layer, layer_sql, parcels, roads, tiles

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}
BOX = (34.76, 32.06, 34.79, 32.09)
TRIANGLE = '{"type":"MultiPolygon","coordinates":[[[[34.72,32.02],[34.88,32.05],[34.79,32.18],[34.72,32.02]]]]}'


def query(sql: str | None = None):
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def _xy(lon: str = "lon", lat: str = "lat") -> str:
    x, y = projection_sql(lon, lat, "33.0")
    return f"{x} AS x, {y} AS y"


PLACES = f"p AS (SELECT *, {_xy()} FROM ({layer_sql('places')}))"
HUBS = f"h AS (SELECT *, {_xy()} FROM ({layer_sql('hubs')}))"
INCIDENTS = f"i AS (SELECT *, floor(x / 100)::BIGINT AS cx, floor(y / 100)::BIGINT AS cy FROM (SELECT feature_id, {_xy()} FROM ({layer_sql('incidents')})))"
TRACKS = f"t AS (SELECT *, {_xy()} FROM ({layer_sql('tracks')}))"
DISTANCE = "sqrt((p.x - h.x) * (p.x - h.x) + (p.y - h.y) * (p.y - h.y))"
NEAREST = f"n AS (SELECT p.*, h.target_id, {DISTANCE} AS d, row_number() OVER (PARTITION BY p.feature_id ORDER BY {DISTANCE}, h.target_id) AS rn FROM p, h)"
TILES = "t AS (SELECT n_nationkey AS id, cast(3470000 + (n_nationkey % 5) * 4000 AS double) / 100000 AS x0, cast(3470000 + (n_nationkey % 5) * 4000 + 4000 AS double) / 100000 AS x1, cast(3200000 + (n_nationkey // 5) * 4000 AS double) / 100000 AS y0, cast(3200000 + (n_nationkey // 5) * 4000 + 4000 AS double) / 100000 AS y1 FROM nation)"
ROADS = "r AS (SELECT a.target_id AS id, a.lon AS ax, a.lat AS ay, b.lon AS bx, b.lat AS b_y FROM h a JOIN h b ON b.target_id = a.target_id + 1)"


PARCELS = "t AS (SELECT c_custkey AS id, c_mktsegment, cast(3470000 + (c_custkey % 125) * 160 AS double) / 100000 AS x0, cast(3470000 + (c_custkey % 125) * 160 + 160 AS double) / 100000 AS x1, cast(3200000 + (c_custkey // 125) * 160 AS double) / 100000 AS y0, cast(3200000 + (c_custkey // 125) * 160 + 160 AS double) / 100000 AS y1 FROM customer)"
_MEET = "a.x0 <= b.x1 AND a.x1 >= b.x0 AND a.y0 <= b.y1 AND a.y1 >= b.y0"
_OVERLAP = "a.x0 < b.x1 AND a.x1 > b.x0 AND a.y0 < b.y1 AND a.y1 > b.y0"


def _snyder() -> str:
    """DuckDB: x and y by another series than the library's, in powers of the angle from the meridian, good to a tenth of a millimetre here."""
    e2 = FLATTENING * (2 - FLATTENING)
    p2 = e2 / (1 - e2)
    arc = f"{AXIS} * ({1 - e2 / 4 - 3 * e2**2 / 64 - 5 * e2**3 / 256 - 175 * e2**4 / 16384!r} * phi - {3 * e2 / 8 + 3 * e2**2 / 32 + 45 * e2**3 / 1024 + 105 * e2**4 / 4096!r} * sin(2 * phi) + {15 * e2**2 / 256 + 45 * e2**3 / 1024 + 525 * e2**4 / 16384!r} * sin(4 * phi) - {35 * e2**3 / 3072 + 175 * e2**4 / 12288!r} * sin(6 * phi) + {315 * e2**4 / 131072!r} * sin(8 * phi))"
    terms = f"SELECT feature_id, {AXIS} / sqrt(1 - {e2!r} * sin(phi) * sin(phi)) AS n, tan(phi) AS t, {p2!r} * cos(phi) * cos(phi) AS c, cos(phi) * turn AS a, {arc} AS m FROM (SELECT feature_id, radians(lat) AS phi, radians(lon - 33) AS turn FROM p)"
    x = f"500000 + 0.9996 * n * (a + (1 - t * t + c) * pow(a, 3) / 6 + (5 - 18 * t * t + pow(t, 4) + 72 * c - 58 * {p2!r}) * pow(a, 5) / 120)"
    y = f"0.9996 * (m + n * t * (a * a / 2 + (5 - t * t + 9 * c + 4 * c * c) * pow(a, 4) / 24 + (61 - 58 * t * t + pow(t, 4) + 600 * c - 330 * {p2!r}) * pow(a, 6) / 720))"
    return f"WITH p AS ({layer_sql('places')}), s AS ({terms}) SELECT feature_id, round({x}) AS x, round({y}) AS y FROM s"


def _target(column: str = "nearest_target_feature"):
    return F.col(f"{column}.properties")["target_id"].cast("long").alias("target_id")


def _hubs(spark: SparkSession, sf_dir: str, where: str | None = None) -> DataFrame:
    hubs = layer(spark, sf_dir, "hubs")
    return hubs.where(where) if where else hubs


@query(f"WITH {PLACES}, {HUBS}, {NEAREST} SELECT feature_id, target_id, round(d, 3) AS distance_m, 'נמצא במרחק ' || cast(cast(round_even(d, 0) AS bigint) AS varchar) || ' מ׳ מישות הייחוס (בטווח המבוקש: 300 מ׳).' AS match_reason FROM n WHERE rn = 1 AND d <= 300")
def near_places_hubs(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = proximity.near(layer(spark, sf_dir, "places"), _hubs(spark, sf_dir), 300)
    return found.select("feature_id", _target(), F.round("distance_to_target_m", 3).alias("distance_m"), "match_reason")


@query(f"WITH {PLACES}, {HUBS}, f AS (SELECT * FROM h WHERE contains(lower(s_name), lower('SUPPLIER#00000000'))), n AS (SELECT p.feature_id, min(sqrt((p.x - f.x) * (p.x - f.x) + (p.y - f.y) * (p.y - f.y))) AS d FROM p, f GROUP BY p.feature_id) SELECT feature_id, round(d, 3) AS distance_m FROM n WHERE d <= 1000")
def near_filtered_reference(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = proximity.near(layer(spark, sf_dir, "places"), _hubs(spark, sf_dir), 1000, ("s_name", "contains", "SUPPLIER#00000000"))
    return found.select("feature_id", F.round("distance_to_target_m", 3).alias("distance_m"))


@query(f"WITH {PLACES}, {HUBS}, {NEAREST} SELECT feature_id, target_id, round(d, 3) AS distance_m FROM n WHERE rn = 1 ORDER BY d, feature_id LIMIT 10")
def nearest_n_places_hubs(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = proximity.nearest_n(layer(spark, sf_dir, "places"), _hubs(spark, sf_dir), 10)
    return found.select("feature_id", _target(), F.round("distance_to_target_m", 3).alias("distance_m"))


@query(f"WITH {PLACES}, {HUBS}, e AS (SELECT p.feature_id, min({DISTANCE}) AS d FROM p, h WHERE h.target_id % 2 = 0 GROUP BY 1), o AS (SELECT p.feature_id, min({DISTANCE}) AS d FROM p, h WHERE h.target_id % 2 = 1 GROUP BY 1) SELECT feature_id, round((e.d + o.d) / 2, 3) AS mean_m, round(e.d, 3) AS first_m, round(o.d, 3) AS second_m FROM e JOIN o USING (feature_id) WHERE e.d <= 1000 AND o.d <= 1000")
def near_all_places(spark: SparkSession, sf_dir: str) -> DataFrame:
    targets = [(_hubs(spark, sf_dir, f"target_id % 2 = {k}"), None) for k in (0, 1)]
    found = proximity.near_all(layer(spark, sf_dir, "places"), targets, 1000)
    each = F.col("distance_to_targets_m")
    return found.select("feature_id", F.round("distance_to_target_m", 3).alias("mean_m"), F.round(each[0]["distance_m"], 3).alias("first_m"), F.round(each[1]["distance_m"], 3).alias("second_m"))


@query(f"WITH {PLACES}, {HUBS}, s AS (SELECT a.x AS ax, a.y AS ay, b.x AS bx, b.y AS b_y FROM h a, h b WHERE a.target_id IN (1, 2) AND b.target_id IN (3, 4)) SELECT feature_id, c_name FROM p WHERE EXISTS (SELECT 1 FROM s WHERE CASE WHEN (p.x - s.ax) * (s.bx - s.ax) + (p.y - s.ay) * (s.b_y - s.ay) <= 0 THEN sqrt((p.x - s.ax) * (p.x - s.ax) + (p.y - s.ay) * (p.y - s.ay)) WHEN (p.x - s.bx) * (s.ax - s.bx) + (p.y - s.b_y) * (s.ay - s.b_y) <= 0 THEN sqrt((p.x - s.bx) * (p.x - s.bx) + (p.y - s.b_y) * (p.y - s.b_y)) ELSE abs((s.bx - s.ax) * (p.y - s.ay) - (s.b_y - s.ay) * (p.x - s.ax)) / sqrt((s.bx - s.ax) * (s.bx - s.ax) + (s.b_y - s.ay) * (s.b_y - s.ay)) END <= 500)")
def between_hubs(spark: SparkSession, sf_dir: str) -> DataFrame:
    first, second = _hubs(spark, sf_dir, "target_id in (1, 2)"), _hubs(spark, sf_dir, "target_id in (3, 4)")
    return proximity.between(layer(spark, sf_dir, "places"), first, second, 500).select("feature_id", "c_name")


@query(f"""WITH RECURSIVE {INCIDENTS}, n AS (SELECT feature_id AS b, x AS bx, y AS b_y, cx + i AS cx, cy + j AS cy FROM i, range(-1, 2) AS r(i), range(-1, 2) AS s(j)),
e AS MATERIALIZED (SELECT feature_id AS a, b FROM i JOIN n USING (cx, cy) WHERE feature_id <> b AND sqrt((x - bx) * (x - bx) + (y - b_y) * (y - b_y)) <= 100),
r(node, label) USING KEY (node) AS (SELECT feature_id AS node, feature_id AS label FROM i UNION SELECT e.b, min(r.label) FROM r JOIN e ON e.a = r.node JOIN recurring.r AS o ON o.node = e.b WHERE r.label < o.label GROUP BY e.b)
SELECT node AS feature_id, label AS cluster_id FROM r WHERE label IN (SELECT label FROM r GROUP BY 1 HAVING count(*) >= 3)""")
def cluster_incidents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return proximity.cluster(layer(spark, sf_dir, "incidents"), 3, 100).select("feature_id", "cluster_id")


@query(f"SELECT feature_id, lon, lat FROM ({layer_sql('places')}) WHERE lon BETWEEN {BOX[0]} AND {BOX[2]} AND lat BETWEEN {BOX[1]} AND {BOX[3]}")
def within_box(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filters.within_geometry(layer(spark, sf_dir, "places"), filters.boundary_from_bbox(*BOX)).select("feature_id", "lon", "lat")


def _half(a: str, b: str) -> str:
    return f"(({b[0]}) - ({a[0]})) * (lat - ({a[1]})) - (({b[1]}) - ({a[1]})) * (lon - ({a[0]})) >= 0"


_CORNERS = [("34.72", "32.02"), ("34.88", "32.05"), ("34.79", "32.18")]


@query(f"SELECT feature_id FROM (SELECT feature_id, lon, lat FROM ({layer_sql('places')})) WHERE " + " AND ".join(_half(a, b) for a, b in zip(_CORNERS, _CORNERS[1:] + _CORNERS[:1])))
def within_triangle(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filters.within_geometry(layer(spark, sf_dir, "places"), filters.boundary_from_geojson(TRIANGLE)).select("feature_id")


@query(f"WITH {PLACES}, {TILES} SELECT feature_id, t.id AS boundary_id FROM p JOIN t ON lon BETWEEN x0 AND x1 AND lat BETWEEN y0 AND y1")
def within_many_tiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topology.within_any(layer(spark, sf_dir, "places"), tiles(spark, sf_dir, "boundary_id"), cell=0.02)


@query(f"WITH {TILES} SELECT a.id AS feature_id, b.id AS target_id FROM t a, t b WHERE a.x0 <= b.x1 AND a.x1 >= b.x0 AND a.y0 <= b.y1 AND a.y1 >= b.y0 AND NOT (a.x0 < b.x1 AND a.x1 > b.x0 AND a.y0 < b.y1 AND a.y1 > b.y0)")
def touches_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topology.pairs(tiles(spark, sf_dir), tiles(spark, sf_dir, "target_id"), "touches", cell=0.04)


@query(f"WITH {TILES} SELECT DISTINCT a.id AS feature_id, a2.n_name FROM t a JOIN nation a2 ON a2.n_nationkey = a.id, t b WHERE a.x0 <= b.x1 AND a.x1 >= b.x0 AND a.y0 <= b.y1 AND a.y1 >= b.y0 AND NOT (a.x0 < b.x1 AND a.x1 > b.x0 AND a.y0 < b.y1 AND a.y1 > b.y0)")
def touches_tiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topology.touches(tiles(spark, sf_dir), tiles(spark, sf_dir, "target_id"), cell=0.04).select("feature_id", "n_name")


@query(f"WITH {PARCELS} SELECT a.id AS feature_id, b.id AS target_id FROM t a, t b WHERE {_MEET} AND NOT ({_OVERLAP})")
def touches_parcels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topology.pairs(parcels(spark, sf_dir), parcels(spark, sf_dir, "target_id"), "touches", cell=0.0032)


@query(f"WITH {PLACES}, {PARCELS} SELECT t.id AS feature_id, p.feature_id AS target_id FROM t JOIN p ON lon > x0 AND lon < x1 AND lat > y0 AND lat < y1")
def contains_parcels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topology.pairs(parcels(spark, sf_dir), layer(spark, sf_dir, "places").withColumnRenamed("feature_id", "target_id"), "contains", cell=0.0032)


@query(f"WITH {HUBS}, {TILES} SELECT t.id AS feature_id, h.target_id FROM t JOIN h ON lon > x0 AND lon < x1 AND lat > y0 AND lat < y1")
def contains_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topology.pairs(tiles(spark, sf_dir), _hubs(spark, sf_dir), "contains", cell=0.02)


@query(f"WITH {HUBS}, {TILES} SELECT DISTINCT t.id AS feature_id FROM t JOIN h ON lon > x0 AND lon < x1 AND lat > y0 AND lat < y1")
def contains_hubs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topology.contains(tiles(spark, sf_dir), _hubs(spark, sf_dir), cell=0.02).select("feature_id")



@query(f"""WITH {HUBS}, {ROADS}, s AS (SELECT id, ax, ay, bx, b_y AS by_ FROM r),
q AS (SELECT a.id, sign((a.bx - a.ax) * (b.ay - a.ay) - (a.by_ - a.ay) * (b.ax - a.ax)) AS s1, sign((a.bx - a.ax) * (b.by_ - a.ay) - (a.by_ - a.ay) * (b.bx - a.ax)) AS s2, sign((b.bx - b.ax) * (a.ay - b.ay) - (b.by_ - b.ay) * (a.ax - b.ax)) AS s3, sign((b.bx - b.ax) * (a.by_ - b.ay) - (b.by_ - b.ay) * (a.bx - b.ax)) AS s4 FROM s a, s b)
SELECT DISTINCT id AS feature_id FROM q WHERE s1 * s2 < 0 AND s3 * s4 < 0""")
def crosses_roads(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topology.crosses(roads(spark, sf_dir), roads(spark, sf_dir, "target_id"), cell=0.02).select("feature_id")


@query("SELECT c_custkey AS feature_id, c_mktsegment FROM customer WHERE c_mktsegment = 'BUILDING'")
def attribute_eq(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filters.attribute_filter(layer(spark, sf_dir, "places"), "c_mktsegment", "eq", "BUILDING").select("feature_id", "c_mktsegment")


@query("SELECT c_custkey AS feature_id, CASE WHEN c_custkey % 7 <> 0 THEN c_mktsegment END AS segment FROM customer WHERE CASE WHEN c_custkey % 7 <> 0 THEN c_mktsegment END IS DISTINCT FROM 'BUILDING'")
def attribute_neq_keeps_nulls(spark: SparkSession, sf_dir: str) -> DataFrame:
    places = layer(spark, sf_dir, "places").select("feature_id", F.when(F.col("feature_id") % 7 != 0, F.col("c_mktsegment")).alias("segment"))
    return filters.attribute_filter(places, "segment", "neq", "BUILDING")


@query("SELECT c_custkey AS feature_id, c_acctbal FROM customer WHERE c_acctbal > 5000")
def attribute_gt(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filters.attribute_filter(layer(spark, sf_dir, "places"), "c_acctbal", "gt", "5000").select("feature_id", "c_acctbal")


@query("SELECT p_partkey AS feature_id, p_brand FROM part WHERE try_cast(replace(p_brand, 'Brand#', '') AS double) < 10")
def attribute_lt_from_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = spark.read.parquet(f"{sf_dir}/part.parquet").select(F.col("p_partkey").alias("feature_id"), "p_brand", F.regexp_replace("p_brand", "Brand#", "").alias("number"))
    return filters.attribute_filter(parts, "number", "lt", 10).select("feature_id", "p_brand")


@query("SELECT p_partkey AS feature_id, p_name FROM part WHERE contains(lower(p_name), 'red w')")
def attribute_contains(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = spark.read.parquet(f"{sf_dir}/part.parquet").select(F.col("p_partkey").alias("feature_id"), "p_name")
    return filters.attribute_filter(parts, "p_name", "contains", "Red-W")


@query(f"SELECT feature_id, o_orderdate FROM ({layer_sql('incidents')}) WHERE o_orderdate BETWEEN TIMESTAMP '1996-01-01 00:00:00' AND TIMESTAMP '1996-06-30 00:00:00'")
def temporal_incidents(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = filters.temporal_filter(layer(spark, sf_dir, "incidents"), "o_orderdate", "1996-01-01T00:00:00Z", "1996-06-30")
    return found.select("feature_id", "o_orderdate")


@query("SELECT o_orderkey AS feature_id FROM orders WHERE o_orderkey % 3 = 0 AND o_orderdate BETWEEN TIMESTAMP '1997-01-01' AND TIMESTAMP '1997-12-31 23:59:59'")
def temporal_day_first_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.when(F.col("feature_id") % 3 == 0, F.date_format("o_orderdate", "dd/MM/yyyy HH:mm:ss")).otherwise("soon")
    rows = layer(spark, sf_dir, "incidents").select("feature_id", text.alias("date"))
    return filters.temporal_filter(rows, "date", "1997-01-01", "1997-12-31T23:59:59Z", ["dd/MM/yyyy HH:mm:ss"]).select("feature_id")


@query(f"SELECT feature_id FROM ({layer_sql('tracks')}) WHERE event_time BETWEEN TIMESTAMP '2024-01-02 11:00:00' AND TIMESTAMP '2024-01-02 12:00:00'")
def look_back_tracks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filters.look_back(layer(spark, sf_dir, "tracks"), "event_time", filters.instant("2024-01-02T12:00:00Z")).select("feature_id")


@query(f"SELECT net_id, feature_id, event_time, lon, lat FROM (SELECT *, row_number() OVER (PARTITION BY net_id ORDER BY event_time DESC, feature_id DESC) AS rn FROM ({layer_sql('tracks')})) WHERE rn = 1")
def latest_per_entity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return moving.latest_per_entity(layer(spark, sf_dir, "tracks"), "net_id", "event_time").select("net_id", "feature_id", "event_time", "lon", "lat")


_ENDS = f"WITH {TRACKS}, o AS (SELECT *, row_number() OVER (PARTITION BY net_id ORDER BY event_time, feature_id) AS a, row_number() OVER (PARTITION BY net_id ORDER BY event_time DESC, feature_id DESC) AS b, count(*) OVER (PARTITION BY net_id) AS n FROM t), e AS (SELECT l.net_id, l.feature_id, l.x - f.x AS dx, l.y - f.y AS dy FROM o f JOIN o l USING (net_id) WHERE f.a = 1 AND l.b = 1 AND f.n >= 2)"
_ANY = f"WITH {TRACKS}, s AS (SELECT net_id, feature_id, event_time, sqrt((x - lag(x) OVER w) * (x - lag(x) OVER w) + (y - lag(y) OVER w) * (y - lag(y) OVER w)) AS d FROM t WINDOW w AS (PARTITION BY net_id ORDER BY event_time, feature_id))"


@query(_ENDS + " SELECT net_id, feature_id, round(sqrt(dx * dx + dy * dy), 2) AS distance_m FROM e WHERE abs(dy) >= abs(dx) AND dy < 0 AND sqrt(dx * dx + dy * dy) >= 100")
def movement_south(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = moving.movement_direction(layer(spark, sf_dir, "tracks"), "south", "net_id", "event_time", 100)
    return found.select("net_id", "feature_id", F.col("movement_distance_m").alias("distance_m"))


@query(_ENDS + " SELECT net_id, round(dx, 2) AS dx, round(dy, 2) AS dy, CASE WHEN dx = 0 AND dy = 0 THEN NULL WHEN abs(dy) >= abs(dx) THEN CASE WHEN dy > 0 THEN 'north' ELSE 'south' END WHEN dx > 0 THEN 'east' ELSE 'west' END AS direction FROM e")
def movement_compass(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = metric_xy(layer(spark, sf_dir, "tracks"))
    at = F.struct("event_time", "feature_id")
    ends = rows.groupBy("net_id").agg(F.min_by(F.struct("x", "y"), at).alias("a"), F.max_by(F.struct("x", "y"), at).alias("b"), F.count("*").alias("n")).where("n >= 2")
    dx, dy = F.col("b.x") - F.col("a.x"), F.col("b.y") - F.col("a.y")
    return ends.select("net_id", F.round(dx, 2).alias("dx"), F.round(dy, 2).alias("dy"), compass(dx, dy).alias("direction"))


@query(_ANY + " SELECT net_id, round(round(sum(d), 2), 1) AS path_m FROM s GROUP BY net_id HAVING count(*) >= 2 AND sum(d) >= 50")
def movement_any_path(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = moving.movement_direction(layer(spark, sf_dir, "tracks"), "any", "net_id", "event_time", 50)
    return found.select("net_id", F.round("movement_distance_m", 1).alias("path_m"))


@query(_ANY + " SELECT net_id, feature_id, round(d, 3) AS step_m FROM s")
def step_distances(spark: SparkSession, sf_dir: str) -> DataFrame:
    return moving.step_distances(layer(spark, sf_dir, "tracks"), "net_id", "event_time").select("net_id", "feature_id", F.round("step_m", 3).alias("step_m"))


@query(f"SELECT feature_id, lat FROM ({layer_sql('places')}) ORDER BY lat DESC, feature_id LIMIT 3")
def directional_north(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranking.directional(layer(spark, sf_dir, "places"), "north", 3).select("feature_id", "lat")


@query(f"WITH {HUBS}, {ROADS} SELECT id AS feature_id FROM r ORDER BY (least(ax, bx) + greatest(ax, bx)) / 2, id LIMIT 5")
def directional_west_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranking.directional(roads(spark, sf_dir), "west", 5).select("feature_id")


@query(f"WITH {PLACES}, {HUBS}, {NEAREST} SELECT count(*) AS count FROM n WHERE rn = 1 AND d <= 300")
def count_near(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filters.count(proximity.near(layer(spark, sf_dir, "places"), _hubs(spark, sf_dir), 300))


@query(_snyder())
def metric_projection(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metric_xy(layer(spark, sf_dir, "places")).select("feature_id", F.round("x").alias("x"), F.round("y").alias("y"))


@query(f"WITH {PLACES}, {HUBS}, {NEAREST} SELECT feature_id, round(d, 3) AS distance_m FROM n WHERE rn = 1 AND d <= 1000 AND c_mktsegment = 'BUILDING' AND lon BETWEEN 34.7 AND 34.9 AND lat BETWEEN 32.0 AND 32.2 ORDER BY lat DESC, feature_id LIMIT 1")
def plan_northernmost_near(spark: SparkSession, sf_dir: str) -> DataFrame:
    hubs = layer(spark, sf_dir, "hubs").withColumnRenamed("target_id", "feature_id")
    layers = {"places": Layer(layer(spark, sf_dir, "places")), "hubs": Layer(hubs)}
    plan = {
        "steps": [
            {"id": "s1", "op": "load", "layer": "places"},
            {"id": "s2", "op": "within_geometry", "input": "s1"},
            {"id": "s3", "op": "attribute_filter", "input": "s2", "field": "c_mktsegment", "operator": "eq", "value": "BUILDING"},
            {"id": "s4", "op": "near", "input": "s3", "target_layer": "hubs", "distance_m": 1000},
            {"id": "s5", "op": "directional", "input": "s4", "direction": "north", "count": 1},
        ],
        "output": "s5",
    }
    found = run_plan(spark, plan, layers, filters.boundary_from_bbox(34.7, 32.0, 34.9, 32.2))
    return found.select("feature_id", F.round("distance_to_target_m", 3).alias("distance_m"))


@query("SELECT count(*) AS count FROM orders WHERE o_orderstatus = 'F' AND o_orderdate BETWEEN TIMESTAMP '1998-01-01' AND TIMESTAMP '1998-01-31 23:59:59'")
def plan_count_incidents(spark: SparkSession, sf_dir: str) -> DataFrame:
    plan = {
        "steps": [
            {"id": "a", "op": "load", "layer": "incidents"},
            {"id": "b", "op": "temporal_filter", "input": "a", "from": "1998-01-01T00:00:00Z", "to": "1998-01-31T23:59:59Z"},
            {"id": "c", "op": "attribute_filter", "input": "b", "field": "o_orderstatus", "operator": "eq", "value": "F"},
            {"id": "d", "op": "count", "input": "c"},
        ],
        "output": "d",
    }
    return run_plan(spark, plan, {"incidents": Layer(layer(spark, sf_dir, "incidents"), "o_orderdate")})


_CATALOG_SQL = "c AS (SELECT 'L' || cast(p_partkey AS varchar) AS id, p_name AS name, p_type AS description, p_brand AS provider, 'x://layer/' || cast(p_partkey AS varchar) AS source_url FROM part WHERE p_partkey % 2 = 0), m AS (SELECT 'new ' || p_name AS name, 'seen' AS description, p_brand AS provider, 'x://layer/' || cast(p_partkey AS varchar) AS source_url FROM part WHERE p_partkey % 3 = 0)"


def _catalogs(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    part = spark.read.parquet(f"{sf_dir}/part.parquet")
    url = F.concat(F.lit("x://layer/"), F.col("p_partkey").cast("string")).alias("source_url")
    tags = F.array("p_type").alias("tags")
    old = part.where("p_partkey % 2 = 0").select(F.concat(F.lit("L"), F.col("p_partkey").cast("string")).alias("id"), F.col("p_name").alias("name"), F.col("p_type").alias("description"), tags, F.col("p_brand").alias("provider"), url)
    new = part.where("p_partkey % 3 = 0").select(F.concat(F.lit("new "), F.col("p_name")).alias("name"), F.lit("seen").alias("description"), F.array(F.lit("remote")).alias("tags"), F.col("p_brand").alias("provider"), url)
    return old, new


@query(f"WITH {_CATALOG_SQL} SELECT coalesce(c.provider, m.provider) AS provider, coalesce(c.source_url, m.source_url) AS source_url, coalesce(m.name, c.name) AS name, coalesce(m.description, c.description) AS description, coalesce(c.id, substr(sha256(m.provider || chr(10) || m.source_url), 1, 32)) AS id FROM c FULL JOIN m ON c.provider = m.provider AND c.source_url = m.source_url")
def catalog_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    return catalog.catalog_merge(*_catalogs(spark, sf_dir))[0].select("provider", "source_url", "name", "description", "id")


@query(f"WITH {_CATALOG_SQL}, b AS (SELECT c.id, m.name FROM c FULL JOIN m ON c.provider = m.provider AND c.source_url = m.source_url) SELECT count(*) FILTER (id IS NULL) AS added, count(*) FILTER (id IS NOT NULL AND name IS NOT NULL) AS updated, count(*) FILTER (name IS NULL) AS kept FROM b")
def catalog_merge_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return catalog.catalog_merge(*_catalogs(spark, sf_dir))[1]


@query(f"WITH {_CATALOG_SQL} SELECT id, CASE WHEN substr(id, length(id)) = '4' THEN 'edited' ELSE name END AS name, provider FROM c")
def catalog_update(spark: SparkSession, sf_dir: str) -> DataFrame:
    old = _catalogs(spark, sf_dir)[0]
    updates = old.where("id like '%4'").select("id", F.lit(" edited ").alias("name"), F.lit(None).cast("string").alias("description"), F.lit(None).cast("array<string>").alias("tags"))
    return catalog.catalog_update(old, updates).select("id", "name", "provider")


@query("SELECT cast(p_partkey AS varchar) AS layer_id, CASE WHEN p_size % 2 = 0 THEN 'legacy' ELSE 'auto' END AS query_mode, p_brand AS brand, CASE WHEN p_size % 3 = 0 THEN NULL WHEN p_size % 3 = 1 THEN 'seenAt' ELSE 'date' END AS temporal_field FROM part")
def catalog_url_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = spark.read.parquet(f"{sf_dir}/part.parquet")
    mode = F.when(F.col("p_size") % 2 == 0, "legacy").otherwise("odd")
    url = F.format_string("x://host/layers/%d/entities?query_mode=%s&param_brand=%s", F.col("p_partkey"), mode, F.replace(F.col("p_brand"), F.lit("#"), F.lit("%23")))
    tags = F.when(F.col("p_size") % 3 == 0, F.array(F.lit("no_temporal_field"))).when(F.col("p_size") % 3 == 1, F.array(F.lit("a"), F.lit("temporal_field: seenAt"))).otherwise(F.array(F.lit("b")))
    found = catalog.catalog_parts(part.select(url.alias("source_url"), tags.alias("tags")))
    return found.select("layer_id", "query_mode", F.col("parameters")["brand"].alias("brand"), "temporal_field")


@query("SELECT n_name AS name, 'NATION' AS first_tag, 2 AS n FROM nation WHERE n_nationkey < 1000")
def cleaned_tags(spark: SparkSession, sf_dir: str) -> DataFrame:
    nation = spark.read.parquet(f"{sf_dir}/nation.parquet")
    raw = F.array(F.lit("  NATION "), F.lit("nation"), F.lit(""), F.concat(F.lit("region "), F.col("n_regionkey").cast("string")), F.lit("bad/tag"))
    tags = clean_tags(raw, max_len=20, max_n=5, fold_case=True, pattern="[A-Za-z0-9 ]+")
    return nation.select(F.col("n_name").alias("name"), tags[0].alias("first_tag"), F.size(tags).alias("n"))


@query("SELECT p_partkey AS feature_id, upper(split_part(p_name, ' ', 1)) AS first_tag, 2 AS n FROM part")
def cleaned_part_tags(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = spark.read.parquet(f"{sf_dir}/part.parquet")
    word = F.split_part("p_name", F.lit(" "), F.lit(1))
    raw = F.array(F.concat(F.lit("  "), F.upper(word), F.lit(" ")), word, F.lit(""), F.concat(F.lit("size "), F.col("p_size").cast("string")), F.lit("bad/tag"))
    tags = clean_tags(raw, max_len=30, max_n=5, fold_case=True, pattern="[A-Za-z0-9 ]+")
    return part.select(F.col("p_partkey").alias("feature_id"), tags[0].alias("first_tag"), F.size(tags).alias("n"))


@query("WITH f AS (SELECT o_custkey AS id, min(o_orderkey) AS feature_id FROM orders WHERE o_custkey % 5 <> 0 GROUP BY 1) SELECT feature_id, id FROM f UNION ALL SELECT o_orderkey, NULL FROM orders WHERE o_custkey % 5 = 0")
def dedupe_first_by_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spark.read.parquet(f"{sf_dir}/orders.parquet").select(F.col("o_orderkey").alias("feature_id"), F.when(F.col("o_custkey") % 5 != 0, F.col("o_custkey")).alias("id"))
    return ranking.dedupe_by_id(rows, "id", ["feature_id"])


@query("SELECT DISTINCT l_returnflag, l_linestatus FROM lineitem")
def dedupe_whole_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranking.dedupe_rows(spark.read.parquet(f"{sf_dir}/lineitem.parquet").select("l_returnflag", "l_linestatus"))


@query("WITH r AS (SELECT CASE WHEN o_orderkey % 2 = 0 THEN o_custkey END AS id, o_orderstatus AS s, o_orderpriority AS p FROM orders) SELECT coalesce(cast(id AS varchar), s || p) AS k, count(*) AS n FROM (SELECT DISTINCT id, CASE WHEN id IS NULL THEN s END AS s, CASE WHEN id IS NULL THEN p END AS p FROM r) GROUP BY 1")
def dedupe_id_or_row(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spark.read.parquet(f"{sf_dir}/orders.parquet").select(F.when(F.col("o_orderkey") % 2 == 0, F.col("o_custkey")).alias("id"), F.col("o_orderstatus").alias("s"), F.col("o_orderpriority").alias("p"))
    found = ranking.dedupe_id_or_row(rows, "id")
    return found.groupBy(F.coalesce(F.col("id").cast("string"), F.concat("s", "p")).alias("k")).agg(F.count("*").alias("n"))


@query("SELECT o_orderkey, o_custkey, CASE WHEN o_custkey % 2 = 0 THEN c_name ELSE 'unknown' END AS name, CASE WHEN o_custkey % 2 = 0 THEN c_mktsegment END AS c_mktsegment FROM orders LEFT JOIN customer ON o_custkey = c_custkey")
def enrich_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    entities = spark.read.parquet(f"{sf_dir}/orders.parquet").select("o_orderkey", "o_custkey", F.lit("unknown").alias("name"))
    details = spark.read.parquet(f"{sf_dir}/customer.parquet").where("c_custkey % 2 = 0").select(F.col("c_custkey").alias("o_custkey"), F.col("c_name").alias("name"), "c_mktsegment")
    return features.enrich_entities(entities, details, "o_custkey")


@query(f"""WITH p AS (SELECT feature_id, least(15, floor((lon - 34.7) / (34.9 - 34.7) * 16))::INT AS cx, least(15, floor((lat - 32.0) / (32.2 - 32.0) * 16))::INT AS cy FROM ({layer_sql('places')})),
l AS (SELECT p.*, d, (cx >> (4 - d)) AS tx, (cy >> (4 - d)) AS ty FROM p, range(0, 5) AS r(d)),
s AS (SELECT d, tx, ty, count(*) AS n FROM l GROUP BY ALL),
c AS (SELECT feature_id, min(l.d) AS depth FROM l JOIN s USING (d, tx, ty) WHERE n <= 20 OR l.d = 4 GROUP BY 1)
SELECT feature_id, depth FROM c""")
def adaptive_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = ranking.adaptive_cells(layer(spark, sf_dir, "places"), 20, 4, (34.7, 32.0, 34.9, 32.2))
    return found.select("feature_id", F.length("cell").cast("long").alias("depth"))


@query("WITH v AS (SELECT p_type AS value, min(p_partkey) AS f FROM part GROUP BY 1) SELECT value FROM v ORDER BY f, value LIMIT 20")
def sample_field(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranking.sample_field(spark.read.parquet(f"{sf_dir}/part.parquet").withColumnRenamed("p_partkey", "feature_id"), "p_type")


@query("SELECT * FROM (VALUES ('o_custkey', 'number', false), ('o_orderstatus', 'string', false), ('o_totalprice', 'number', false), ('o_orderdate', 'date', true), ('o_orderpriority', 'string', false), ('flag', 'boolean', false), ('seen', 'date', false)) AS t(name, type, temporal) WHERE EXISTS (SELECT 1 FROM orders)")
def infer_schema(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spark.read.parquet(f"{sf_dir}/orders.parquet").withColumnRenamed("o_orderkey", "feature_id")
    rows = rows.withColumn("flag", F.col("o_custkey") % 2 == 0).withColumn("seen", F.when(F.col("feature_id") % 9 == 0, F.date_format("o_orderdate", "yyyy-MM-dd'T'HH:mm:ss'Z'")).otherwise("never"))
    return profiling.infer_schema(rows).select("name", "type", "temporal")


@query("WITH d AS (SELECT o_orderpriority AS v, min(o_orderkey) AS f FROM orders GROUP BY 1) SELECT v AS sample FROM d ORDER BY f LIMIT 5")
def profile_samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spark.read.parquet(f"{sf_dir}/orders.parquet").select(F.col("o_orderkey").alias("feature_id"), "o_orderpriority")
    return profiling.infer_schema(rows).select(F.explode("samples").alias("sample"))


@query("WITH e AS (SELECT event_id, cast(json_extract_string(props, '$.k') AS varchar) AS v FROM events), d AS (SELECT v, min(event_id) AS f FROM e WHERE v IS NOT NULL GROUP BY 1) SELECT 'k' AS name, 'number' AS type, v AS sample FROM d ORDER BY f LIMIT 5")
def property_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spark.read.parquet(f"{sf_dir}/events.parquet").select(F.col("event_id").alias("feature_id"), features.properties_of("props").alias("properties"))
    return profiling.property_profile(rows).select("name", "type", F.explode("samples").alias("sample"))


@query("SELECT * FROM (VALUES ('o_custkey', 'id', true), ('ghost', 'number', true), ('o_orderstatus', 'string', false), ('o_totalprice', 'number', false), ('o_orderdate', 'date', false), ('o_orderpriority', 'string', false)) AS t(name, type, declared) WHERE EXISTS (SELECT 1 FROM orders)")
def merge_schema(spark: SparkSession, sf_dir: str) -> DataFrame:
    declared = spark.createDataFrame([("o_custkey", "id"), ("ghost", "number")], "name string, type string")
    rows = spark.read.parquet(f"{sf_dir}/orders.parquet").withColumnRenamed("o_orderkey", "feature_id")
    return profiling.merge_schema(declared, profiling.infer_schema(rows)).select("name", "type", "declared")


@query("SELECT p_partkey AS feature_id, lower(trim(regexp_replace(replace(p_brand || '  - \"' || p_name || '\"_' || p_type, '\"', ''), '[\\s\\-_.]+', ' ', 'g'))) AS text FROM part")
def normalized_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = spark.read.parquet(f"{sf_dir}/part.parquet")
    raw = F.concat("p_brand", F.lit('  - "'), "p_name", F.lit('"_'), "p_type")
    return part.select(F.col("p_partkey").alias("feature_id"), normalize_text(raw).alias("text"))


@query("SELECT p_partkey AS feature_id, substr(trim(regexp_replace('  ' || p_name || chr(10) || ' ' || p_type, '\\s+', ' ', 'g')), 1, 12) AS text FROM part")
def sanitized_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = spark.read.parquet(f"{sf_dir}/part.parquet")
    return part.select(F.col("p_partkey").alias("feature_id"), sanitize(F.concat(F.lit("  "), "p_name", F.lit("\n "), "p_type"), 12).alias("text"))


@query(f"WITH {PLACES} SELECT feature_id, printf('%.6f, %.6f', lat, lon) AS latlon, printf('POINT (%.6f %.6f)', lon, lat) AS wkt FROM p")
def coordinate_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return layer(spark, sf_dir, "places").select("feature_id", coordinate_text(F.col("lon"), F.col("lat")).alias("latlon"), coordinate_text(F.col("lon"), F.col("lat"), "wkt").alias("wkt"))


@query(f"WITH {PLACES} SELECT feature_id, lon, lat FROM p WHERE feature_id % 3 <> 0")
def wkt_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.when(F.col("feature_id") % 3 == 0, "POINT EMPTY").otherwise(F.concat(F.lit("POINT ("), F.col("lon").cast("string"), F.lit(" "), F.col("lat").cast("string"), F.lit(" 0)")))
    lon, lat = point_of(F.col("wkt"))
    return layer(spark, sf_dir, "places").select("feature_id", text.alias("wkt")).select("feature_id", lon.alias("lon"), lat.alias("lat")).where("lon is not null")


@query(f"WITH {HUBS}, {ROADS} SELECT id AS feature_id, least(ax, bx) AS xmin, greatest(ax, bx) AS xmax, bx AS mid_lon FROM r")
def parsed_geometries(spark: SparkSession, sf_dir: str) -> DataFrame:
    ring = F.col("geom.parts")[0][0]
    text = F.concat(F.lit("LINESTRING("), F.array_join(F.transform(ring, lambda p: F.concat_ws(" ", p["x"].cast("string"), p["y"].cast("string"))), ", "), F.lit(")"))
    lines = roads(spark, sf_dir).select("feature_id", geometry_of(text).alias("geom"))
    return lines.select("feature_id", "geom.xmin", "geom.xmax", representative_point("geom")["lon"].alias("mid_lon"))


@query(f"WITH {PLACES}, {HUBS}, {NEAREST} SELECT feature_id, round(d, 3) AS distance_m FROM n WHERE rn = 1 AND d <= 2000 ORDER BY d, feature_id LIMIT 20")
def preview_near(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = ranking.preview(proximity.near(layer(spark, sf_dir, "places"), _hubs(spark, sf_dir), 2000))
    return found.select("feature_id", F.round("distance_to_target_m", 3).alias("distance_m"))


@query("SELECT count(*) AS n, count(*) FILTER (o_custkey % 2 = 0) AS left_rows FROM orders")
def union_of_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = spark.read.parquet(f"{sf_dir}/orders.parquet")
    both = ranking.union_pages(orders.where("o_custkey % 2 = 0").select("o_orderkey", "o_custkey"), orders.where("o_custkey % 2 = 1").select("o_orderkey"))
    return both.agg(F.count("*").alias("n"), F.count("o_custkey").alias("left_rows"))


@query(f"WITH {PLACES} SELECT feature_id, c_name AS name, lon, lat FROM p")
def geojson_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = features.feature_json(layer(spark, sf_dir, "places").select("feature_id", "c_name", "lon", "lat"))
    kind = "type string, geometry struct<type:string,coordinates:array<double>>, properties struct<feature_id:long,c_name:string>"
    return text.select(F.from_json("feature", kind).alias("f")).select("f.properties.feature_id", F.col("f.properties.c_name").alias("name"), F.col("f.geometry.coordinates")[0].alias("lon"), F.col("f.geometry.coordinates")[1].alias("lat"))


@query("SELECT CASE WHEN p_partkey % 2 = 0 THEN 'R' ELSE 'S' END || cast(p_partkey // 4 AS varchar) AS remote_id, min_by(substr(trim(p_name), 1, 200), p_partkey) AS name FROM part WHERE p_partkey % 5 <> 0 GROUP BY 1")
def remote_layers(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("p_partkey")
    ident = F.when(k % 5 != 0, F.concat(F.when(k % 2 == 0, "R").otherwise("S"), F.floor(k / 4).cast("string"), F.lit(" ")))
    raw = spark.read.parquet(f"{sf_dir}/part.parquet").select(ident.alias("layerId"), F.col("p_name").alias("title"), k.alias("place"))
    return catalog.normalize_remote_layers(raw, "x", "place")[0].select("remote_id", "name")
