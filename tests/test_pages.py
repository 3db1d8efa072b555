"""Landed pages: what is held in Python at once doesn't grow with the pages of a task."""

import json

import pyarrow as pa
from pyspark.sql import functions as F

from geoweft.sources import features


def test_a_task_with_many_pages_gets_few_at_once(spark):
    pages = spark.range(0, 40, 1, 1).select(F.concat(F.lit('{"features":[], "x":"'), F.repeat(F.lit("x"), 500_000), F.lit('"}')).alias("value"))

    def sizes(batches):
        for batch in batches:
            row = [[("bytes", str(batch.nbytes))]]
            yield pa.RecordBatch.from_arrays([pa.array(row, pa.map_(pa.string(), pa.string())), pa.nulls(1, features.ARROW)], names=["properties", "geom"])

    got = [int(r.properties["bytes"]) for r in features._rows_of(pages, sizes).collect()]
    assert sum(got) >= 40 * 500_000 and max(got) <= 2 * features.BYTES_EACH
    assert features.geojson_rows(pages).count() == 0


def test_a_large_page_leaves_in_stretches(spark):
    n = 2 * features.ROWS_EACH + 7
    page = json.dumps({"Results": [{"id": k, "geometry": f"POINT ({k % 90} 1)" if k % 3 else None, "a": None} for k in range(n)]})
    rows = features.cube_rows(spark.createDataFrame([(page,)], "value string")).collect()
    assert [r.properties for r in rows] == [{"id": str(k), "a": None} for k in range(n)]
    assert [r.geom and r.geom.xmin for r in rows] == [float(k % 90) if k % 3 else None for k in range(n)]


def test_a_missing_layer_starts_no_python(spark, tmp_path):
    empty = features.read_geojson(spark, f"{tmp_path}/missing")
    assert empty.schema == features.FEATURES and empty.count() == 0
    pages = spark.createDataFrame([('{"features":[{"properties":{"a":1},"geometry":null}]}',)], "value string")
    both = features.geojson_rows(pages).unionByName(empty)
    assert [r.properties for r in both.collect()] == [{"a": "1"}]
    plan = empty._jdf.queryExecution().executedPlan().toString()
    assert "ExistingRDD" not in plan and "Arrow" not in plan
