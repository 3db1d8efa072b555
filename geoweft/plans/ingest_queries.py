"""More registered queries: landed pages of every source, the catalog, plans by name, profiles, fuzzy text."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from geoweft.functions.text import display_name, normalize_text, partial_ratio, plain_text
from geoweft.operators import filters, moving, profiling, ranking
from geoweft.plans.queries import BOX, DISTANCE, HUBS, PLACES, ROADS, query
from geoweft.plans.steps import Layer, catalog_layers, register_op, register_source, run_plan, step_trace
from geoweft.session import shared_dir
from geoweft.sources import catalog, features, layout
from geoweft.sources.layers import layer, layer_sql, roads

PAGE = 2000


def _pages(rows: DataFrame, number: str, key: str | None) -> DataFrame:
    """Pages (JSON text under value) of JSON objects under json, so many ids of a number column a page."""
    text = F.array_join(F.collect_list("json"), ",")
    body = F.concat(F.lit("["), text, F.lit("]")) if key is None else F.concat(F.lit(f'{{"total": 1, "{key}": ['), text, F.lit("]}"))
    return rows.groupBy(F.floor(F.col(number) / PAGE)).agg(body.alias("value")).select("value")


def _landed(spark: SparkSession, pages: DataFrame, name: str) -> str:
    """The pages as files, one each, in the shared folder."""
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    pages.write.option("maxRecordsPerFile", 1).text(path)
    return path


def _wkt(kind: str = "POINT") -> Column:
    return F.concat(F.lit(f"{kind} ("), F.col("lon").cast("string"), F.lit(" "), F.col("lat").cast("string"), F.lit(")"))


@query(f"SELECT cast(feature_id AS varchar) AS id, i.o_orderstatus AS status, o_orderpriority AS priority, strftime(i.o_orderdate, '%d/%m/%Y %H:%M:%S') AS date, cast(o_custkey AS varchar) AS area, lon, lat FROM ({layer_sql('incidents')}) i JOIN orders ON o_orderkey = feature_id WHERE feature_id % 7 <> 0")
def entities_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = spark.read.parquet(f"{sf_dir}/orders.parquet").select(F.col("o_orderkey").alias("feature_id"), "o_custkey", "o_orderpriority")
    rows = layer(spark, sf_dir, "incidents").join(orders, "feature_id")
    k = F.col("feature_id")
    listed = F.array(F.to_json(F.struct(F.lit(" status ").alias("FieldName"), F.struct(F.col("o_orderstatus").alias("displayValue")).alias("FieldValue"))), F.to_json(F.struct(F.col("o_orderpriority").alias("priority"))), F.lit('{"name":"date","value":"none"}'), F.lit('{"name":"geometry","value":1}'))
    entity = F.concat(
        F.lit('{"exclusive_id":{"entity_id":'), k.cast("string"), F.lit('},"date":"'), F.date_format("o_orderdate", "dd/MM/yyyy HH:mm:ss"),
        F.lit('","geo":{"wkt":"'), F.when(k % 7 == 0, "POINT (x)").otherwise(_wkt()), F.lit('","area":'), F.col("o_custkey").cast("string"),
        F.lit('},"property_list":['), F.array_join(listed, ","), F.lit("]}"),
    )
    found = filters.drop_invalid(features.read_entities(spark, _landed(spark, _pages(rows.select("feature_id", entity.alias("json")), "feature_id", "entities_list"), "entities")))
    p = F.col("properties")
    return found.select(*[p[n].alias(n) for n in ("id", "status", "priority", "date", "area")], F.col("geom.xmin").alias("lon"), F.col("geom.ymin").alias("lat"))


@query(f"SELECT cast(feature_id AS varchar) AS id, cast(net_id AS varchar) AS net_id, lon, lat FROM ({layer_sql('tracks')}) WHERE feature_id % 3 = 0")
def cube_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("feature_id")
    shape = F.when(k % 3 == 0, _wkt()).when(k % 3 == 1, "LINESTRING (1 2, 3 4)").otherwise("POINT EMPTY")
    rows = layer(spark, sf_dir, "tracks").select("feature_id", F.to_json(F.struct(k.alias("id"), F.col("net_id").alias("netId"), shape.alias("geometry"))).alias("json"))
    found = filters.drop_invalid(features.cube_rows(_pages(rows, "feature_id", "Results")))
    return features.flattened(found, "id", "netId").select("id", F.col("netId").alias("net_id"), "lon", "lat")


@query(f"SELECT cast(feature_id AS varchar) AS id, lon, lat FROM ({layer_sql('places')}) WHERE feature_id % 8 <> 7")
def position_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Eight forms of a geometry, the last of them broken."""
    lon, lat = F.col("lon").cast("string"), F.col("lat").cast("string")
    point = F.concat(F.lit('{"type":"Point","coordinates":['), lon, F.lit(","), lat, F.lit("]}"))
    forms = [F.concat(F.lit('"'), _wkt(), F.lit('"')), point, F.to_json(F.struct(point.alias("g"))), F.concat(F.lit("["), lon, F.lit(","), lat, F.lit("]"))]
    forms[2] = F.regexp_replace(F.regexp_replace(forms[2], r'^\{"g":', ""), r"\}$", "")
    forms += [F.concat(F.lit('{"lng":'), lon, F.lit(',"latitude":'), lat, F.lit("}")), F.concat(F.lit('{"geo":{"WKT":"'), _wkt(), F.lit('"}}')), F.concat(F.lit('{"type":"Feature","geometry":'), point, F.lit("}")), F.lit('{"lon":"x"}')]
    geometry = F.element_at(F.array(*forms), (F.col("feature_id") % 8 + 1).cast("int"))
    rows = layer(spark, sf_dir, "places").select("feature_id", F.concat(F.lit('{"id":'), F.col("feature_id").cast("string"), F.lit(',"geometry":'), geometry, F.lit("}")).alias("json"))
    found = filters.drop_invalid(features.position_rows(_pages(rows, "feature_id", None)))
    return features.flattened(found, "id").select("id", "lon", "lat")


@query(f"SELECT cast(feature_id AS varchar) AS id, c_name AS name, lon, lat FROM ({layer_sql('places')})")
def geojson_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Features through the sink, collections as files, and back; a layer without a file adds nothing."""
    places = layer(spark, sf_dir, "places").select("feature_id", "c_name", "lon", "lat")
    rows = places.select("feature_id", F.struct(*places.columns).alias("r")).select("feature_id", "r.c_name", "r.lon", "r.lat")
    made = features.feature_json(rows).select(F.col("feature").alias("json"), F.get_json_object("feature", "$.properties.feature_id").cast("long").alias("feature_id"))
    path = _landed(spark, _pages(made, "feature_id", "features"), "geojson")
    found = features.read_geojson(spark, path).unionByName(features.read_geojson(spark, f"{path}-missing"))
    return features.flattened(found, "feature_id", "c_name").select(F.col("feature_id").alias("id"), F.col("c_name").alias("name"), "lon", "lat")


@query("SELECT p_partkey AS feature_id FROM part WHERE p_brand IN ('Brand#1', 'Brand#12', 'Brand#22')")
def queryable_layers(spark: SparkSession, sf_dir: str) -> DataFrame:
    layers = spark.read.parquet(f"{sf_dir}/part.parquet").select(F.col("p_partkey").alias("feature_id"), F.col("p_brand").alias("provider"))
    return catalog.queryable(layers, ["Brand#1", "Brand#12", "Brand#22"]).select("feature_id")


@query("SELECT count(*) AS read, count(*) FILTER (event_id % 3 <> 0) AS rejected FROM events")
def rejected_geometries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows read and rejected, counted in the job that drops them."""
    k = F.col("feature_id")
    rows = layer(spark, sf_dir, "tracks").select("feature_id", F.when(k % 3 == 0, _wkt()).otherwise("POINT (1)").alias("wkt"))
    seen = Observation("geometries")
    filters.drop_invalid(features.with_geometry(rows, "wkt"), seen).write.format("noop").mode("overwrite").save()
    return spark.createDataFrame([(seen.get["read"], seen.get["rejected"])], "read long, rejected long")


@query(f"SELECT feature_id FROM ({layer_sql('places')})")
def guarded_places(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filters.guard_wgs84(layer(spark, sf_dir, "places")).select("feature_id")


@query(f"SELECT net_id, place, lon, lat FROM (SELECT *, row_number() OVER (PARTITION BY net_id ORDER BY event_time, feature_id) - 1 AS place, count(*) OVER (PARTITION BY net_id) AS n FROM ({layer_sql('tracks')})) WHERE n >= 2")
def movement_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Paths of all tracks that can have one, vertex by vertex."""
    found = moving.movement_direction(layer(spark, sf_dir, "tracks"), "any", "net_id", "event_time", 0.0)
    return found.select("net_id", F.posexplode("movement_path.coordinates").alias("place", "c")).select("net_id", F.col("place").cast("long").alias("place"), F.col("c")[0].alias("lon"), F.col("c")[1].alias("lat"))


@query("SELECT * FROM (SELECT 'a' AS step, count(*) AS n FROM orders UNION ALL SELECT 'b', count(*) FROM orders WHERE o_orderdate BETWEEN TIMESTAMP '1997-01-01' AND TIMESTAMP '1997-12-31 23:59:59' UNION ALL SELECT 'c', count(*) FROM orders WHERE o_orderstatus = 'O' AND o_orderdate BETWEEN TIMESTAMP '1997-01-01' AND TIMESTAMP '1997-12-31 23:59:59' UNION ALL SELECT 'd', 1)")
def plan_step_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    plan = {
        "steps": [
            {"id": "a", "op": "load", "layer": "incidents"},
            {"id": "b", "op": "temporal_filter", "input": "a", "from": "1997-01-01T00:00:00Z", "to": "1997-12-31T23:59:59Z"},
            {"id": "c", "op": "attribute_filter", "input": "b", "field": "o_orderstatus", "operator": "eq", "value": "O"},
            {"id": "d", "op": "count", "input": "c"},
        ],
        "output": "d",
    }
    counts: dict[str, Observation] = {}
    run_plan(spark, plan, {"incidents": Layer(layer(spark, sf_dir, "incidents"), "o_orderdate")}, counts=counts).write.format("noop").mode("overwrite").save()
    return spark.createDataFrame([(k, o.get[f"{k}_rows"]) for k, o in counts.items()], "step string, n long")


@query("WITH i AS (SELECT *, o_orderdate BETWEEN TIMESTAMP '1997-01-01' AND TIMESTAMP '1997-12-31 23:59:59' AS there FROM orders), n AS (SELECT count(*) AS a, count(*) FILTER (WHERE there) AS b, count(*) FILTER (WHERE there AND o_orderstatus = 'O') AS c FROM i) SELECT 'a' AS step, 'load' AS op, NULL AS input_rows, a AS output_rows FROM n UNION ALL SELECT 'b', 'temporal_filter', a, b FROM n UNION ALL SELECT 'c', 'attribute_filter', b, c FROM n UNION ALL SELECT 'd', 'count', c, 1 FROM n")
def plan_step_trace(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What each step of a plan got and gave, counted in the job that ran it."""
    steps = [
        {"id": "a", "op": "load", "layer": "incidents"},
        {"id": "b", "op": "temporal_filter", "input": "a", "from": "1997-01-01T00:00:00Z", "to": "1997-12-31T23:59:59Z"},
        {"id": "c", "op": "attribute_filter", "input": "b", "field": "o_orderstatus", "operator": "eq", "value": "O"},
        {"id": "d", "op": "count", "input": "c"},
    ]
    plan, counts = {"steps": steps, "output": "d"}, {}
    run_plan(spark, plan, {"incidents": Layer(layer(spark, sf_dir, "incidents"), "o_orderdate")}, counts=counts).write.format("noop").mode("overwrite").save()
    return step_trace(spark, plan, counts).select("step", "op", "input_rows", "output_rows")


@query("SELECT least(25, count(*)) AS first_rows, least(10, count(*)) AS random_rows, least(10, count(*)) AS distinct_rows, true AS same_seed_same_rows FROM part")
def sampled_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first rows, and random ones that the seed decides."""
    part = spark.read.parquet(f"{sf_dir}/part.parquet").select("p_partkey")
    some = [ranking.sample(part, 10, seed=5).agg(F.count("*").alias("random_rows"), F.count_distinct("p_partkey").alias("distinct_rows"), F.sum("p_partkey").alias(f"s{k}")) for k in (0, 1)]
    both = some[0].crossJoin(F.broadcast(some[1].select("s1")))  # one row each
    return both.crossJoin(F.broadcast(ranking.sample(part, 25).agg(F.count("*").alias("first_rows")))).select("first_rows", "random_rows", "distinct_rows", (F.col("s0") == F.col("s1")).alias("same_seed_same_rows"))


@query("SELECT c_custkey AS feature_id, CASE WHEN c_custkey % 3 = 0 THEN trim(c_name) WHEN c_custkey % 3 = 1 THEN c_mktsegment ELSE cast(c_custkey AS varchar) END AS display FROM customer")
def display_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("c_custkey")
    rows = spark.read.parquet(f"{sf_dir}/customer.parquet").select(k.alias("feature_id"), F.when(k % 3 == 0, F.concat(F.lit(" "), "c_name")).otherwise("  ").alias("name"), F.when(k % 3 == 1, F.col("c_mktsegment")).alias("title"), k.alias("id"))
    return rows.select("feature_id", display_name(rows).alias("display"))


@query("SELECT name, type, declared, sample FROM (SELECT 'o_orderstatus' AS name, 'code' AS type, true AS declared, v AS sample FROM (SELECT o_orderstatus AS v, min(o_orderkey) AS f FROM orders GROUP BY 1 ORDER BY f LIMIT 5) UNION ALL SELECT 'o_orderpriority', 'string', false, v FROM (SELECT o_orderpriority AS v, min(o_orderkey) AS f FROM orders GROUP BY 1 ORDER BY f LIMIT 5) UNION ALL SELECT 'ghost', 'number', true, NULL FROM (SELECT 1 FROM orders LIMIT 1))")
def declared_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spark.read.parquet(f"{sf_dir}/orders.parquet").select(F.col("o_orderkey").alias("feature_id"), "o_orderstatus", "o_orderpriority")
    declared = spark.createDataFrame([("o_orderstatus", "code"), ("ghost", "number")], "name string, type string")
    return profiling.with_declared(rows, declared).select("name", "type", "declared", F.explode_outer("samples").alias("sample"))


@query("SELECT least(10, count(*)) AS n, 4 AS fields, 20 AS longest FROM documents WHERE length(text) > 20")
def sample_payloads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A few random rows as JSON for a model to read, long values cut."""
    rows = spark.read.parquet(f"{sf_dir}/documents.parquet").where("length(text) > 20")
    payload = profiling.sample_payload(rows, ["doc_id", "lang", "source", "text"], seed=3, most_chars=20).select(F.from_json("sample", "map<string,string>").alias("m"))
    return payload.agg(F.count("*").alias("n"), F.max(F.size("m")).alias("fields"), F.max(F.length(F.col("m")["text"])).alias("longest"))


def _whole_hours(df: DataFrame, step: dict, ctx: object) -> DataFrame:
    return df.where(F.date_trunc(step["unit"], "event_time") == F.col("event_time"))


@query(f"SELECT count(*) AS count FROM ({layer_sql('tracks')}) WHERE date_trunc('second', event_time) = event_time")
def registered_operation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A plan with an operation that its user has added by name."""
    register_op("at_whole", _whole_hours)
    plan = {"steps": [{"id": "a", "op": "load", "layer": "tracks"}, {"id": "b", "op": "at_whole", "input": "a", "unit": "second"}, {"id": "c", "op": "count", "input": "b"}], "output": "c"}
    return run_plan(spark, plan, {"tracks": Layer(layer(spark, sf_dir, "tracks"), "event_time")})


@query(f"WITH {PLACES}, {HUBS}, n AS (SELECT p.feature_id, min({DISTANCE}) AS d FROM p, h WHERE c_mktsegment = 'MACHINERY' GROUP BY 1) SELECT feature_id, round(d, 3) AS distance_m FROM n WHERE d <= 800")
def catalog_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A plan over layers that the catalog names, loaded by the source of their provider with the URL's parameters."""

    def derived(spark: SparkSession, url: str, segment: str | None = None) -> DataFrame:
        found = layer(spark, sf_dir, url.split("?")[0].rsplit("/", 1)[1]).withColumnsRenamed({"target_id": "feature_id"})
        return filters.attribute_filter(found, "c_mktsegment", "eq", segment) if segment else found

    register_source("derived", derived)
    rows = [("P", "places", "", [], "derived", "x://host/layers/places?param_segment=MACHINERY"), ("H", "hubs", "", [], "derived", "x://host/layers/hubs"), ("G", "ghost", "", [], "other", "x://host/layers/ghost")]
    layers = spark.createDataFrame(rows, catalog.CATALOG)
    plan = {"steps": [{"id": "a", "op": "load", "layer": "P"}, {"id": "b", "op": "near", "input": "a", "target_layer": "H", "distance_m": 800}], "output": "b"}
    found = run_plan(spark, plan, catalog_layers(spark, layers, plan))
    return found.select("feature_id", F.round("distance_to_target_m", 3).alias("distance_m"))


@query("SELECT event_id AS feature_id FROM events WHERE event_id % 4 <> 0 AND date_trunc('second', ts) BETWEEN TIMESTAMP '2024-01-02 11:00:00' AND TIMESTAMP '2024-01-02 12:00:00'")
def catalog_plan_day_first(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A moving layer of the catalog whose times are text, day first, some unreadable: its last hour, by the formats and look-back of its source and tags."""

    def moving_source(spark: SparkSession, url: str) -> DataFrame:
        text = F.when(F.col("feature_id") % 4 == 0, "soon").otherwise(F.date_format("event_time", "dd/MM/yyyy HH:mm:ss"))
        return layer(spark, sf_dir, "tracks").select("feature_id", F.col("net_id").alias("netId"), text.alias("eventTime"), "lon", "lat")

    register_source("day-first", moving_source, lookback="1 hour")
    rows = [("T", "tracks", "", ["temporal_field:eventTime", "time_format:dd/MM/yyyy HH:mm:ss"], "day-first", "x://host/layers/tracks")]
    layers = spark.createDataFrame(rows, catalog.CATALOG)
    plan = {"steps": [{"id": "a", "op": "load", "layer": "T"}], "output": "a"}
    return run_plan(spark, plan, catalog_layers(spark, layers, plan), now=filters.instant("2024-01-02T12:00:00Z")).select("feature_id")


@query(f"SELECT feature_id, lon, lat FROM ({layer_sql('incidents')}) WHERE lon BETWEEN {BOX[0]} AND {BOX[2]} AND lat BETWEEN {BOX[1]} AND {BOX[3]} AND o_orderdate BETWEEN TIMESTAMP '1996-02-01 00:00:00' AND TIMESTAMP '1996-04-30 00:00:00'")
def laid_out_incidents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All incidents stored by month and place, then a box and three months read back from the files that can hold them."""
    path = f"{shared_dir(spark)}/layout-{uuid.uuid4().hex}"
    incidents = layer(spark, sf_dir, "incidents").withColumn("o_orderdate", F.col("o_orderdate").cast("timestamp"))
    layout.write_layer(incidents, path, int(spark.conf.get("spark.sql.shuffle.partitions")), "o_orderdate", "month")
    return layout.read_layer(spark, path, filters.boundary_from_bbox(*BOX), "o_orderdate", ("1996-02-01T00:00:00Z", "1996-04-30T00:00:00Z")).select("feature_id", "lon", "lat")


@query("SELECT (SELECT count(*) = 0 FROM orders WHERE o_orderstatus = 'P') AS partly_empty, (SELECT count(*) = 0 FROM orders WHERE o_orderstatus = '?') AS unknown_empty")
def empty_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = [filters.is_empty(filters.attribute_filter(layer(spark, sf_dir, "incidents"), "o_orderstatus", "eq", x)) for x in ("P", "?")]
    return spark.createDataFrame([tuple(found)], "partly_empty boolean, unknown_empty boolean")


@query("SELECT feature_id, net_id FROM (SELECT event_id AS feature_id, user_id AS net_id, row_number() OVER (PARTITION BY user_id ORDER BY date_trunc('second', ts) DESC, event_id DESC) AS rn FROM events WHERE event_id % 4 <> 0) WHERE rn = 1")
def plan_latest_day_first(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The newest fix of each entity where the layer's times are text, day first, some unreadable."""
    text = F.when(F.col("feature_id") % 4 == 0, "soon").otherwise(F.date_format("event_time", "dd/MM/yyyy HH:mm:ss"))
    tracks = layer(spark, sf_dir, "tracks").select("feature_id", F.col("net_id").alias("netId"), text.alias("eventTime"), "lon", "lat")
    plan = {"steps": [{"id": "a", "op": "load", "layer": "t"}, {"id": "b", "op": "latest_per_entity", "input": "a"}], "output": "b"}
    return run_plan(spark, plan, {"t": Layer(tracks, "eventTime", time_formats=["dd/MM/yyyy HH:mm:ss"])}).select("feature_id", F.col("netId").alias("net_id"))


_TO_ROAD = "((g.x - s.ax) * (s.bx - s.ax) + (g.y - s.ay) * (s.b_y - s.ay))"
_LENGTH = "((s.bx - s.ax) * (s.bx - s.ax) + (s.b_y - s.ay) * (s.b_y - s.ay))"


@query(f"""WITH {PLACES}, {HUBS}, {ROADS.replace('a.lon AS ax, a.lat AS ay, b.lon AS bx, b.lat AS b_y', 'a.x AS ax, a.y AS ay, b.x AS bx, b.y AS b_y')}, g AS (SELECT * FROM p WHERE lon BETWEEN 34.76 AND 34.82 AND lat BETWEEN 32.06 AND 32.12),
m AS (SELECT g.feature_id, CASE WHEN {_TO_ROAD} <= 0 THEN sqrt((g.x - s.ax) * (g.x - s.ax) + (g.y - s.ay) * (g.y - s.ay)) WHEN {_TO_ROAD} >= {_LENGTH} THEN sqrt((g.x - s.bx) * (g.x - s.bx) + (g.y - s.b_y) * (g.y - s.b_y))
  ELSE abs((s.bx - s.ax) * (g.y - s.ay) - (s.b_y - s.ay) * (g.x - s.ax)) / sqrt({_LENGTH}) END AS d FROM g, r s)
SELECT feature_id, round(min(d), 2) AS distance_m FROM m GROUP BY 1 HAVING min(d) <= 150""")
def plan_near_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A plan with a boundary and lines as targets: these count up to 150 m outside of it."""
    plan = {"steps": [{"id": "a", "op": "load", "layer": "places"}, {"id": "b", "op": "within_geometry", "input": "a"}, {"id": "c", "op": "near", "input": "b", "target_layer": "roads", "distance_m": 150}], "output": "c"}
    found = run_plan(spark, plan, {"places": Layer(layer(spark, sf_dir, "places")), "roads": Layer(roads(spark, sf_dir))}, filters.boundary_from_bbox(34.76, 32.06, 34.82, 32.12))
    return found.select("feature_id", F.round("distance_to_target_m", 2).alias("distance_m"))


@query("SELECT 'L' || cast(p_partkey AS varchar) AS id, p_name AS name, 1 AS n_tags FROM part WHERE p_partkey % 2 = 0 UNION ALL SELECT substr(sha256('new' || chr(10) || 'x://new/' || cast(p_partkey AS varchar)), 1, 32), p_name, 2 FROM part WHERE p_partkey % 2 = 1")
def catalog_inserted(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = spark.read.parquet(f"{sf_dir}/part.parquet")
    old = part.where("p_partkey % 2 = 0").select(F.concat(F.lit("L"), F.col("p_partkey").cast("string")).alias("id"), F.col("p_name").alias("name"), F.lit("").alias("description"), F.array(F.lit("kept")).alias("tags"), F.lit("old").alias("provider"), F.lit("x://old").alias("source_url"))
    new = part.where("p_partkey % 2 = 1").select(F.concat(F.lit("  "), "p_name", F.lit(" ")).alias("name"), F.lit("").alias("description"), F.array(F.lit(" a "), F.lit("b"), F.lit("a"), F.lit("")).alias("tags"), F.lit(" new ").alias("provider"), F.concat(F.lit("x://new/"), F.col("p_partkey").cast("string")).alias("source_url"))
    return catalog.catalog_insert(old, new).select("id", "name", F.size("tags").alias("n_tags"))


_SOUGHT = "red wigdet"


#: DuckDB: 100 times the best Indel likeness of the shorter text with a window of the longer; a row of common subsequences is a number.
_RATIOS = f"""WITH p AS (SELECT p_partkey, p_name, lower(p_name) AS t, '{_SOUGHT}' AS sought FROM part),
q AS (SELECT *, CASE WHEN len(t) <= len(sought) THEN t ELSE sought END AS s, CASE WHEN len(t) <= len(sought) THEN sought ELSE t END AS l FROM p),
m AS (SELECT *, (1::BIGINT << len(s)) - 1 AS full_row, list_transform(string_split(l, ''), lambda c: list_sum(list_transform(range(len(s)), lambda i: CASE WHEN s[i + 1] = c THEN 1::BIGINT << i ELSE 0::BIGINT END))::BIGINT) AS marks FROM q),
w AS (SELECT *, unnest(range(1 - len(s), len(l))) AS place FROM m),
x AS (SELECT *, list_slice(marks, greatest(place, 0) + 1, place + len(s)) AS part FROM w),
r AS (SELECT p_partkey, p_name, max(200.0 * (len(s) - bit_count(list_reduce(list_prepend(full_row, part), lambda a, b: ((a + (a & b)) | (a - (a & b))) & full_row))) / (len(s) + len(part))) AS ratio FROM x GROUP BY 1, 2)"""


@query(f"{_RATIOS} SELECT p_partkey AS feature_id, round(ratio, 6) AS ratio FROM r")
def partial_ratios(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = spark.read.parquet(f"{sf_dir}/part.parquet")
    return part.select(F.col("p_partkey").alias("feature_id"), F.round(partial_ratio(normalize_text("p_name"), plain_text(_SOUGHT)), 6).alias("ratio"))


@query(f"{_RATIOS} SELECT p_partkey AS feature_id, p_name FROM r WHERE ratio >= 80")
def attribute_fuzzy_contains(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = spark.read.parquet(f"{sf_dir}/part.parquet").select(F.col("p_partkey").alias("feature_id"), "p_name")
    return filters.attribute_filter(parts, "p_name", "fuzzy_contains", _SOUGHT)
