"""Landed JSON in its many shapes, GeoJSON in and out, catalog, profiles, streams."""

import json
import uuid

from pyspark.sql import Observation
from pyspark.sql import functions as F

from geoweft.functions.text import clean_tags, display_name, ratio_of
from geoweft.operators import filters, profiling, proximity, quadtree
from geoweft.operators.components import connected_components
from geoweft.sources import catalog, features
from geoweft.streaming.filters import latest_fix


def put(folder, name, value):
    (folder / name).write_text(json.dumps(value, ensure_ascii=False))
    return str(folder)


def test_cube_rows(spark, tmp_path):
    rows = [{"id": 1, "geometry": "POINT (34.78 32.08 0)"}, {"id": 2, "geometry": "LINESTRING (0 0,1 1)"}, {"id": 3, "geometry": "POINT (x)"}]
    path = put(tmp_path, "a.json", {"Results": rows})
    found, seen = features.read_cube_rows(spark, path), Observation("cube")
    good = filters.drop_invalid(found, seen).collect()
    assert [r.properties["id"] for r in good] == ["1"] and good[0].geom.xmin == 34.78
    assert seen.get == {"read": 3, "rejected": 2}


def test_entities(spark, tmp_path):
    entity = {
        "exclusive_id": {"entity_id": "e1"},
        "classification": {"triangle": "T", "source_id": 7},
        "date": "13/07/2026 08:30:00",
        "geo": {"wkt": "POLYGON((0 0,1 0,1 1,0 0))", "area": 5},
        "property_list": [{"FieldName": " height ", "FieldValue": {"displayValue": 3}}, {"colour": "red"}, {"name": "triangle", "value": "other"}, {"name": "geometry", "value": 1}],
    }
    for k in ("entities_list", "EntitiesList", "features", "Features", "entities", "Entities", "data", "Data", "results", "Results", "items", "Items"):
        page = spark.createDataFrame([(json.dumps({"total": 1, k: [{"id": 1, "geo": "POINT(1 2)"}]}),)], "value string")
        assert features.entity_rows(page).count() == 1
    row = features.read_entities(spark, put(tmp_path, "a.json", {"data": [entity, {"geo": {"wkt": "bad"}}]})).collect()
    assert dict(row[0].properties) == {"id": "e1", "triangle": "T", "source_id": "7", "date": "13/07/2026 08:30:00", "area": "5", "height": "3", "colour": "red"}
    assert row[0].geom.type == "Polygon" and (row[1].geom is None or row[1].geom.type is None)


def test_positions(spark, tmp_path):
    forms = ["POINT(1 2)", {"type": "Point", "coordinates": [1, 2]}, '{"type":"Point","coordinates":[1,2]}', [1, 2], {"lng": 1, "latitude": 2}, {"geo": {"WKT": "POINT(1 2)"}}, {"type": "Feature", "geometry": {"type": "Point", "coordinates": [1, 2]}}, "[1, 2]"]
    path = put(tmp_path, "a.json", [{"id": k, "geometry": g} for k, g in enumerate(forms)] + [{"id": 99, "geometry": {"lon": "x"}}])
    good = filters.drop_invalid(features.read_positions(spark, path)).collect()
    assert len(good) == len(forms) and all((r.geom.xmin, r.geom.ymin) == (1, 2) for r in good)


def test_geojson_round_trip(spark, tmp_path):
    layer = {"type": "FeatureCollection", "features": [{"type": "Feature", "geometry": {"type": "Point", "coordinates": [34.5, 32.5]}, "properties": {"name": "א", "n": 1}}]}
    found = features.flattened(features.read_geojson(spark, put(tmp_path, "a.geojson", layer)), "name", "n")
    assert [(r.name, r.n, r.lon, r.lat) for r in found.collect()] == [("א", "1", 34.5, 32.5)]
    again = json.loads(features.feature_collection(found.select("name", "geom")))
    assert again["features"][0]["geometry"] == {"type": "Point", "coordinates": [34.5, 32.5]}
    assert features.read_geojson(spark, str(tmp_path / "missing.geojson")).count() == 0


def test_names_and_declared_fields(spark):
    df = spark.createDataFrame([(1, " ", "t", "x"), (2, " n ", None, "y"), (3, None, " ", None)], "feature_id long, name string, title string, extra string")
    assert [r.d for r in df.select(display_name(df).alias("d"), "feature_id").orderBy("feature_id").collect()] == ["t", "n", None]
    declared = spark.createDataFrame([("title", "label"), ("ghost", "number")], "name string, type string")
    found = {r.name: (r.type, r.samples, r.declared) for r in profiling.with_declared(df, declared).collect()}
    assert found == {"title": ("label", ["t", " "], True), "ghost": ("number", [], True), "name": ("string", [" ", " n "], False), "extra": ("string", ["x", "y"], False)}


def test_guard(spark):
    import pytest

    df = spark.createDataFrame([(200.0, 1.0)], "lon double, lat double")
    with pytest.raises(Exception, match="outside WGS84"):
        filters.guard_wgs84(df).collect()
    assert filters.guard_wgs84(df.where("lon < 100")).count() == 0


def test_catalog(spark):
    old = spark.createDataFrame([("1", "a", "d", ["keep"], "p", "u1"), ("2", "b", "d", [], "p", "u2")], catalog.CATALOG)
    new = spark.createDataFrame([("A", "n", ["x"], "p", "u1"), ("C", "n", ["y"], "p", "u3")], "name string, description string, tags array<string>, provider string, source_url string")
    merged, counts = catalog.catalog_merge(old, new)
    rows = {r.source_url: r for r in merged.collect()}
    assert (rows["u1"].id, rows["u1"].name, rows["u1"].tags) == ("1", "A", ["keep"])
    assert rows["u2"].name == "b" and rows["u3"].tags == ["y"] and rows["u3"].id
    assert counts.first().asDict() == {"added": 1, "updated": 1, "kept": 1}
    raw = spark.createDataFrame([(" 7 ", None, 1), ("7", "again", 2), ("", "x", 3), (None, "y", 4)], "layerId string, title string, place int")
    layers, skipped = catalog.normalize_remote_layers(raw, "r", "place")
    assert [(r.remote_id, r.name) for r in layers.collect()] == [("7", "layer 7")] and skipped.first().skipped == 3
    assert catalog.queryable(old, ["q"]).isEmpty()
    assert catalog.catalog_insert(old, new).count() == 4


def test_tags(spark):
    df = spark.createDataFrame([([" A", "a", "", "b/c", "long tag"],)], "t array<string>")
    assert df.select(clean_tags(F.col("t"), max_len=4, max_n=2, fold_case=True, pattern="[A-Za-z ]+").alias("t")).first().t == ["A", "long"]


def test_profiles(spark):
    rows = [(1, "x", 1.5, True, "2026-01-01T00:00:00Z", None), (2, "y", None, None, "n", None)]
    df = spark.createDataFrame(rows, "feature_id long, s string, n double, b boolean, d string, time string")
    found = {r.name: r for r in profiling.infer_schema(df).collect()}
    assert {k: r.type for k, r in found.items()} == {"s": "string", "n": "number", "b": "boolean", "d": "date", "time": "date"}
    assert [k for k, r in found.items() if r.temporal] == ["time"] and found["s"].samples == ["x", "y"]
    assert profiling.sample_payload(df, ["s", "n"], 1).count() == 2


def test_ratio():
    assert ratio_of("abc", "xxabcxx") == 100 and ratio_of("", "a") == 0 and ratio_of("", "") == 100
    assert 60 < ratio_of("abxc", "zzabczz") < 100


def test_components(spark):
    edges = spark.createDataFrame([(k, k + 1) for k in range(40)] + [(100, 102), (102, 101)], "a long, b long")
    found = {r.node: r.component for r in connected_components(edges).collect()}
    assert found == {k: 0 for k in range(41)} | {100: 100, 101: 100, 102: 100}
    assert connected_components(edges.limit(0)).count() == 0


def test_stream(spark, tmp_path):
    rows = spark.sql("select id % 3 as netId, timestamp_seconds(id) as t, double(id) as lon, 0D as lat from range(30)")
    rows.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(rows.schema).parquet(str(tmp_path / "in"))
    kept = filters.within_geometry(stream, filters.boundary_from_bbox(5, -1, 25, 1))
    q = latest_fix(kept, "netId", "t").writeStream.outputMode("complete").format("memory").queryName("fixes").start()
    q.processAllAvailable()
    q.stop()
    assert sorted(r.lon for r in spark.sql("select * from fixes").collect()) == [23.0, 24.0, 25.0]


def test_temporary_tables_are_those_of_their_own_thread(spark):
    """What another thread stages while a temporary() is open stays, and what was staged inside goes."""
    import threading

    from geoweft.session import staged, temporary

    opened, written, found = threading.Event(), threading.Event(), []

    def other():
        opened.wait(60)
        found.append(staged(spark.range(5).toDF("x"), "other-thread"))
        written.set()

    thread = threading.Thread(target=other)
    thread.start()
    with temporary(spark):
        own = staged(spark.range(3).toDF("x"), "own")
        with temporary(spark):
            inner = staged(own, "inner")
        opened.set()
        written.wait(60)
        kept = staged(own, "kept", keep=True)
    thread.join()
    assert found[0].count() == 5 and kept.count() == 3
    for gone in (own, inner):
        path = spark._jvm.org.apache.hadoop.fs.Path(gone.inputFiles()[0])
        assert not path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path)


def test_operators_with_clashing_columns(spark):
    """Columns under every name that the operators use or add: those that are added are replaced, all others stay."""
    names = "_value _target _match _found target_id distance_m distance_to_target_m match_reason nearest_target_feature cluster_id distance_to_targets_m matched_reference_features x y cx cy dx dy side level n node component a b _d0 _f0 _t0 n2 least cell".split()
    rows = [(k, 34.70 + k % 7 / 1000, 32.05 + k % 5 / 1000, "Plain text" if k % 2 else "טקסט־רגיל", *["own"] * len(names)) for k in range(40)]
    df = spark.createDataFrame(rows, "feature_id long, lon double, lat double, name string, " + ", ".join(f"`{x}` string" for x in names))
    bare = df.select("feature_id", "lon", "lat", "name")
    ref = spark.createDataFrame([(k, 34.70 + k / 500, 32.05 + k / 700, "r") for k in range(4)], "target_id long, lon double, lat double, distance_m string")
    runs = {
        "near": lambda d: proximity.near(d, ref, 200),
        "nearest_n": lambda d: proximity.nearest_n(d, ref, 5),
        "near_all": lambda d: proximity.near_all(d, [(ref, None), (ref.where("target_id > 0"), None)], 300),
        "between": lambda d: proximity.between(d, ref.where("target_id = 0"), ref.where("target_id = 3"), 100),
        "cluster": lambda d: proximity.cluster(d, 2, 120),
        "contains": lambda d: filters.attribute_filter(d, "name", "contains", "רגיל"),
        "contains_ascii": lambda d: filters.attribute_filter(d, "name", "contains", "plain"),
        "fuzzy": lambda d: filters.attribute_filter(d, "name", "fuzzy_contains", "plain textt"),
    }
    for name, run in runs.items():
        got, plain = run(df), run(bare)
        assert len({c.lower() for c in got.columns}) == len(got.columns), name
        added = [c for c in plain.columns if c not in bare.columns]
        kept = [c for c in names if c not in added]
        assert got.count() == plain.count() > 0 and got.where(" or ".join(f"`{c}` <> 'own'" for c in kept)).isEmpty(), name
        assert sorted(map(str, got.select(plain.columns).collect())) == sorted(map(str, plain.collect())), name
    plan = runs["contains_ascii"](df)._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Join" not in plan


def test_laid_out_layers_open_few_files(spark):
    """A box and two days are in few files of a stored layer, and nothing is lost: null places and times are kept too."""
    from geoweft.session import shared_dir
    from geoweft.sources import layout

    rows = spark.range(6000).select(F.col("id").alias("feature_id"), (34 + (F.col("id") * 7919 % 1000) / 500).alias("lon"), (31 + (F.col("id") * 104729 % 1000) / 500).alias("lat"), F.expr("timestamp'2024-01-01 00:00:00' + make_dt_interval(0, id % 240)").alias("at"), F.lit("x").alias("place"))
    rows = rows.unionByName(spark.createDataFrame([(9001, None, None, None, "y"), (9002, 34.5, 31.5, None, "y")], rows.schema))
    flat, path = (f"{shared_dir(spark)}/{n}-{uuid.uuid4().hex}" for n in ("flat", "layout"))
    rows.repartition(40).write.parquet(flat)
    layout.write_layer(rows, path, 40, "at")
    box = filters.boundary_from_bbox(34.2, 31.2, 34.6, 31.6)
    between = ("2024-01-03T00:00:00Z", "2024-01-04T23:59:59Z")
    want = filters.temporal_filter(filters.within_geometry(spark.read.parquet(flat), box), "at", *between)
    got = layout.read_layer(spark, path, box, "at", between)
    assert sorted(map(str, got.select(want.columns).collect())) == sorted(map(str, want.collect())) and want.count() > 20
    assert layout.read_layer(spark, path).count() == rows.count()
    in_files = lambda df: df.select(F.input_file_name()).distinct().count()
    assert in_files(got) * 3 < in_files(want)
    plan = got._sc._jvm.PythonSQLUtils.explainString(got._jdf.queryExecution(), "formatted")
    assert "PartitionFilters: [isnotnull(layer_day" in plan and "GreaterThanOrEqual(lon" in plan


def test_near_in_dense_places(spark):
    """A hot cell, a far hot spot beside scattered points, many points at one place, and ties: as comparing all pairs does."""
    import random

    r = random.Random(5)
    spot = lambda n, x, y, size: [(x + r.uniform(0, size), y + r.uniform(0, size)) for _ in range(n)]
    features = [*spot(500, 0, 0, 700), *spot(30, -3000, 0, 4000), *[(10.0, 10.0)] * 50]
    targets = [*spot(500, 0, 0, 700), *spot(400, 900, 900, 5), *[(12.0, 10.0)] * 60, *[(8.0, 10.0)] * 60]
    left = spark.createDataFrame([(k, *p) for k, p in enumerate(features)], "feature_id long, x double, y double")
    right = spark.createDataFrame([(k, *p) for k, p in enumerate(targets)], "target_id long, x double, y double")
    want = {}
    for k, (x, y) in enumerate(features):
        d, t = min((((x - a) ** 2 + (y - b) ** 2) ** 0.5, n) for n, (a, b) in enumerate(targets))
        if d <= 800:
            want[k] = (t, d)
    got = {x.feature_id: (x.target_id, x.distance_m) for x in proximity.nearest_points(left, right, 800).collect()}
    assert got.keys() == want.keys() and all(got[k][0] == want[k][0] and abs(got[k][1] - want[k][1]) < 1e-9 for k in want)
    side = lambda df, s: df.select("x", "y").distinct().withColumn("side", F.lit(s))
    cells, points = quadtree.tree(side(left, "a").unionByName(side(right, "b")), 800)
    held = lambda s: points.where(F.col("side") == s).groupBy(*[F.col(c).alias(f"{s}_{c}") for c in quadtree.NODE]).agg(F.count("*").alias(f"n_{s}"))
    pairs = quadtree.leaf_pairs(cells, 800).join(held("a"), [f"a_{c}" for c in quadtree.NODE]).join(held("b"), [f"b_{c}" for c in quadtree.NODE])
    assert pairs.agg(F.sum(F.col("n_a") * F.col("n_b"))).first()[0] < 50 * len(features)
