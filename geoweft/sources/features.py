"""Feature sources (landed JSON, GeoJSON) and the GeoJSON sink."""

from __future__ import annotations

import json
from collections.abc import Iterator
from typing import Any

import pandas as pd
import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from geoweft.functions.geometry import ARROW, GEOMETRY, geometry_of, parse_any

#: Keys under which services return their rows, ids, property lists, names and values.
ROW_KEYS = ("data", "Data", "results", "Results", "items", "Items", "entities", "Entities")
ENTITY_LIST_KEYS = ("entities_list", "EntitiesList", "features", "Features", "entities", "Entities", "data", "Data", "results", "Results", "items", "Items")
ID_KEYS = ("id", "entityId", "entity_id", "Id")
PROPERTY_KEYS = ("property_list", "PropertiesList", "PropertyList", "Property_List", "properties_list", "Properties", "properties")
NAME_KEYS = ("name", "Name", "key", "Key", "field", "fieldName", "FieldName", "field_name", "propertyName", "PropertyName", "property_name")
VALUE_KEYS = ("value", "Value", "fieldValue", "FieldValue", "field_value", "propertyValue", "PropertyValue", "property_value", "displayValue", "DisplayValue", "display_value")

FEATURES = T.StructType([T.StructField("properties", T.MapType(T.StringType(), T.StringType())), T.StructField("geom", GEOMETRY)])
TEXT_MAP = T.MapType(T.StringType(), T.StringType())


def _first(row: dict[str, Any], keys: tuple[str, ...]) -> Any:
    return next((row[k] for k in keys if k in row), None)


def _text(value: Any) -> str | None:
    return value if value is None or isinstance(value, str) else json.dumps(value, ensure_ascii=False)


def property_map(raw: Any) -> dict[str, str | None]:
    """A property list in any of its forms: a map, name and value pairs, one-key maps, JSON text of these, or one nested in another."""
    if isinstance(raw, str):
        try:
            raw = json.loads(raw)
        except ValueError:
            return {}
    if isinstance(raw, dict):
        nested = _first(raw, PROPERTY_KEYS)
        if isinstance(nested, (dict, list)):
            return property_map(nested)
        pairs = [(str(k), v) for k, v in raw.items()]
    elif isinstance(raw, list):
        pairs = []
        for item in (x for x in raw if isinstance(x, dict)):
            name, value = _first(item, NAME_KEYS), _first(item, VALUE_KEYS)
            if name is None and len(item) == 1:
                ((name, value),) = item.items()
            pairs.append(("" if name is None else str(name), value))
    else:
        return {}
    out = {}
    for name, value in pairs:
        if isinstance(value, dict) and (inner := _first(value, VALUE_KEYS)) is not None:
            value = inner
        if name.strip() and name.strip() != "geometry":
            out[name.strip()] = _text(value)
    return out


@F.pandas_udf(TEXT_MAP)
def properties_of(values: pd.Series) -> pd.Series:
    """property_map over a column of JSON text."""
    return values.map(lambda x: property_map(x) if x else {})


def entity_record(entity: dict[str, Any]) -> dict[str, Any]:
    """Attributes of a nested entity: identity, classification, date and area go before its property list."""
    source = entity["exclusive_id"] if isinstance(entity.get("exclusive_id"), dict) else entity
    number = _first(source, ID_KEYS)
    fixed: dict[str, Any] = {} if number is None else {"id": str(number)}
    for key, names in (("classification", ("triangle", "clearence_level", "source_id")), (None, ("date", "link")), ("geo", ("area", "perimeter"))):
        part = entity if key is None else entity.get(key)
        if isinstance(part, dict):
            fixed |= {n: part[n] for n in names if n in part}
    return {k: _text(v) for k, v in (property_map(_first(entity, PROPERTY_KEYS)) | fixed).items()}


def _rows(payload: Any, keys: tuple[str, ...]) -> list[dict[str, Any]]:
    if isinstance(payload, dict):
        if "geometry" in payload or "geo" in payload:
            return [payload]
        payload = next((payload[k] for k in keys if isinstance(payload.get(k), list)), None)
    if not isinstance(payload, list):
        raise ValueError("unrecognized response: no list of rows")
    return [x for x in payload if isinstance(x, dict)]


#: Rows that leave Python at once, and bytes of pages that reach it at once.
ROWS_EACH, BYTES_EACH = 1000, 4 << 20


def _reader(keys: tuple[str, ...], record):
    """Reads pages one at a time; a page's rows leave in stretches of ROWS_EACH."""
    kind = pa.schema([("properties", pa.map_(pa.string(), pa.string())), ("geom", ARROW)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for page in batch.column(0):
                rows = _rows(json.loads(page.as_py()), keys)
                for at in range(0, len(rows), ROWS_EACH):
                    made = [record(x) for x in rows[at : at + ROWS_EACH]]
                    properties = pa.array([list(x["properties"].items()) for x in made], kind.field("properties").type)
                    yield pa.RecordBatch.from_arrays([properties, pa.array([x["geom"] for x in made], ARROW)], schema=kind)

    return run


def _rows_of(pages: DataFrame, reader) -> DataFrame:
    """One row for each row of the pages (JSON text under value), the unreadable geometries null.

    Pages are large, so a batch of as many pages as of other rows would be a
    whole partition: batches go by bytes, however many pages a task has.
    """
    pages.sparkSession.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BYTES_EACH))
    return pages.select("value").mapInArrow(reader, FEATURES)


def _files(spark: SparkSession, path: str) -> DataFrame:
    """Landed pages: a file is a page."""
    return spark.read.text(path, wholetext=True)


def cube_rows(pages: DataFrame) -> DataFrame:
    """(properties, geom) of flat rows whose geometry is WKT; only points count as geometry. Drop the others with drop_invalid."""

    def record(row: dict[str, Any]) -> dict[str, Any]:
        geometry = parse_any(row["geometry"]) if isinstance(row.get("geometry"), str) else None
        return {"properties": {k: _text(v) for k, v in row.items() if k != "geometry"}, "geom": geometry if geometry and geometry["type"] == "Point" else None}

    return _rows_of(pages, _reader(ROW_KEYS, record))


def entity_rows(pages: DataFrame) -> DataFrame:
    """(properties, geom) of nested entities: geo.wkt and a property list."""

    def record(row: dict[str, Any]) -> dict[str, Any]:
        geo = row.get("geo")
        wkt = (geo.get("wkt") or geo.get("WKT")) if isinstance(geo, dict) else geo
        return {"properties": entity_record(row), "geom": parse_any(wkt) if isinstance(wkt, str) else None}

    return _rows_of(pages, _reader(ENTITY_LIST_KEYS, record))


def position_rows(pages: DataFrame) -> DataFrame:
    """(properties, geom) of position reports, whose geometry takes any of many forms."""

    def record(row: dict[str, Any]) -> dict[str, Any]:
        return {"properties": {k: _text(v) for k, v in row.items() if k != "geometry"}, "geom": parse_any(row.get("geometry"))}

    return _rows_of(pages, _reader(ROW_KEYS, record))


def geojson_rows(pages: DataFrame) -> DataFrame:
    """(properties, geom) of feature collections."""

    def record(row: dict[str, Any]) -> dict[str, Any]:
        return {"properties": {k: _text(v) for k, v in (row.get("properties") or {}).items()}, "geom": parse_any(row.get("geometry"))}

    return _rows_of(pages, _reader(("features",), record))


def read_cube_rows(spark: SparkSession, path: str) -> DataFrame:
    return cube_rows(_files(spark, path))


def read_entities(spark: SparkSession, path: str) -> DataFrame:
    return entity_rows(_files(spark, path))


def read_positions(spark: SparkSession, path: str) -> DataFrame:
    return position_rows(_files(spark, path))


def read_geojson(spark: SparkSession, path: str, limit: int | None = None) -> DataFrame:
    """geojson_rows of files; a missing one is an empty layer."""
    try:
        rows = geojson_rows(_files(spark, path))
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        # Not createDataFrame([]), whose scan starts a Python worker on every core.
        return spark.range(1).select(*[F.lit(None).cast(f.dataType).alias(f.name) for f in FEATURES]).where(F.lit(False))
    return rows if limit is None else rows.limit(limit)


def flattened(features: DataFrame, *names: str) -> DataFrame:
    """Properties as columns of their own, and flat lon and lat for points."""
    point = F.col("geom.type") == "Point"
    columns = [F.col("properties")[n].alias(n) for n in names]
    return features.select(*columns, F.when(point, F.col("geom.xmin")).alias("lon"), F.when(point, F.col("geom.ymin")).alias("lat"), "geom")


def with_geometry(df: DataFrame, text: str, out: str = "geom") -> DataFrame:
    return df.withColumn(out, geometry_of(F.col(text)))


def _geometry_json(df: DataFrame) -> Column:
    if "geom" not in df.columns:
        return F.to_json(F.struct(F.lit("Point").alias("type"), F.array("lon", "lat").alias("coordinates")))
    rings = F.transform("geom.parts", lambda part: F.transform(part, lambda ring: F.transform(ring, lambda p: F.array(p["x"], p["y"]))))
    kind = F.col("geom.type")
    shape = F.when(kind == "Point", F.to_json(rings[0][0][0])).when(kind.isin("LineString", "MultiPoint"), F.when(kind == "LineString", F.to_json(rings[0][0])).otherwise(F.to_json(F.transform(rings, lambda p: p[0][0]))))
    shape = shape.when(kind == "MultiLineString", F.to_json(F.transform(rings, lambda p: p[0]))).when(kind == "Polygon", F.to_json(rings[0])).otherwise(F.to_json(rings))
    return F.concat(F.lit('{"type":"'), kind, F.lit('","coordinates":'), shape, F.lit("}"))


def feature_json(df: DataFrame) -> DataFrame:
    """One GeoJSON feature as text for each row; columns besides the geometry are its properties."""
    own = [c for c in df.columns if c not in ("lon", "lat", "geom")]
    properties = F.to_json(F.struct(*[F.col(f"`{c}`") for c in own]), {"ignoreNullFields": "false"}) if own else F.lit("{}")
    return df.select(F.concat(F.lit('{"type":"Feature","geometry":'), _geometry_json(df), F.lit(',"properties":'), properties, F.lit("}")).alias("feature"))


def write_geojson(df: DataFrame, path: str) -> None:
    """Line-delimited GeoJSON features, written by all tasks."""
    feature_json(df).write.text(path)


def feature_collection(df: DataFrame, most: int = 10_000) -> str:
    """A small result as one collection; more than most rows are refused."""
    rows = feature_json(df).limit(most + 1).collect()
    if len(rows) > most:
        raise ValueError(f"over {most} features: use write_geojson")
    return '{"type":"FeatureCollection","features":[' + ",".join(r.feature for r in rows) + "]}"


def enrich_entities(entities: DataFrame, details: DataFrame, id_col: str) -> DataFrame:
    """Details over entities by id: a detail's value where it has one, else the entity's; entities without detail stay."""
    shared = [c for c in details.columns if c != id_col]
    other = details.select(F.col(id_col).alias("_id"), *[F.col(c).alias(f"_{c}") for c in shared])
    joined = entities.join(other, F.col(id_col) == F.col("_id"), "left")
    kept = [F.coalesce(F.col(f"_{c}"), F.col(c)).alias(c) if c in shared else F.col(c) for c in entities.columns]
    return joined.select(*kept, *[F.col(f"_{c}").alias(c) for c in shared if c not in entities.columns])
