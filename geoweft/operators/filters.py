"""Filters: boundary, attributes, time, reference entities, reject counts."""

from __future__ import annotations

from datetime import UTC, datetime
from typing import Any

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F
from pyspark.sql import types as T

from geoweft.functions import geometry as G
from geoweft.functions.text import normalize_text, partial_ratio, plain_text

FUZZY_LEAST = 80.0


def need(df: DataFrame, *columns: str) -> None:
    missing = sorted(set(columns) - set(df.columns))
    if missing:
        raise ValueError(f"no such column: {', '.join(missing)} (there are {', '.join(sorted(df.columns))})")


def boundary_edges(boundary: dict[str, Any]) -> list[tuple[float, float, float, float]]:
    return [(*a, *b) for part in G.parts_of(boundary)[1] for ring in part for a, b in zip(ring, ring[1:])]


def inside_sql(lon: str, lat: str, edges: list[tuple[float, float, float, float]]) -> str:
    """SQL text: point in or on the area of these edges, by crossings of a ray over a constant array."""
    rows = ", ".join(f"named_struct('ax', {a!r}D, 'ay', {b!r}D, 'bx', {c!r}D, 'by', {d!r}D)" for a, b, c, d in edges)
    on = f"((e.bx - e.ax) * ({lat} - e.ay) - (e.by - e.ay) * ({lon} - e.ax)) = 0 and {lon} between least(e.ax, e.bx) and greatest(e.ax, e.bx) and {lat} between least(e.ay, e.by) and greatest(e.ay, e.by)"
    hit = f"((e.ay > {lat}) <> (e.by > {lat})) and {lon} < (e.bx - e.ax) * ({lat} - e.ay) / (e.by - e.ay) + e.ax"
    return f"(exists(array({rows}), e -> {on}) or size(filter(array({rows}), e -> {hit})) % 2 = 1)"


def within_geometry(df: DataFrame, boundary: dict[str, Any] | None) -> DataFrame:
    """Rows whose point (lon, lat) or geometry (geom) meets the boundary, its edge included.

    The bounding box is a plain range on stored columns, so it reaches the
    Parquet scan. Points are tested by ray casting in generated code; other
    geometries by the kernel, after the box. With a boundary of one rectangle,
    points, rectangles and what lies inside need the box only.
    """
    if boundary is None:
        raise ValueError("within_geometry: no boundary")
    x0, y0, x1, y1 = (boundary[k] for k in ("xmin", "ymin", "xmax", "ymax"))
    edges = boundary_edges(boundary)
    rectangle = len(edges) == 4 and {(a, b) for a, b, _, _ in edges} == {(x0, y0), (x1, y0), (x1, y1), (x0, y1)}
    if "lon" in df.columns and "lat" in df.columns:
        boxed = df.where(F.col("lon").between(x0, x1) & F.col("lat").between(y0, y1))
        if rectangle:
            return boxed
        return boxed.where(F.expr(inside_sql("lon", "lat", edges)))
    need(df, "geom")
    boxed = df.where((F.col("geom.xmin") <= x1) & (F.col("geom.xmax") >= x0) & (F.col("geom.ymin") <= y1) & (F.col("geom.ymax") >= y0))
    if not rectangle:
        return boxed.where(_meets(boundary)(F.col("geom")))
    if df.schema["geom"].metadata.get("shape") == "box":
        return boxed
    # Points and rectangles that meet the box meet the boundary; so does what lies between its sides.
    within = (F.col("geom.xmin") >= x0) & (F.col("geom.xmax") <= x1) & (F.col("geom.ymin") >= y0) & (F.col("geom.ymax") <= y1)
    simple = F.coalesce(within | (F.col("geom.type") == "Point") | G.is_box("geom"), F.lit(False))
    return boxed.where(simple).unionByName(boxed.where(~simple).where(_meets(boundary)(F.col("geom"))))


def _meets(boundary: dict[str, Any]):
    @F.arrow_udf(T.BooleanType())
    def run(g: pa.Array) -> pa.Array:
        area = G.Shape(boundary)
        return pa.array([x is not None and bool(x["type"]) and G.relation(x, area)["intersects"] for x in g.to_pylist()], pa.bool_())

    return run


def boundary_from_bbox(minx: float, miny: float, maxx: float, maxy: float) -> dict[str, Any]:
    ring = [(minx, miny), (maxx, miny), (maxx, maxy), (minx, maxy), (minx, miny)]
    found = G.struct_of("MultiPolygon", [[ring]])
    assert found
    return found


def boundary_from_geojson(text: str) -> dict[str, Any]:
    found = G.parse_any(text)
    if not found or not found["type"].endswith("Polygon"):
        raise ValueError("a boundary is a polygon or multipolygon")
    return found


def attribute_filter(df: DataFrame, field: str, op: str, value: Any) -> DataFrame:
    """eq: raw equality; neq: keeps nulls; gt, lt: as numbers, what isn't one drops; contains: normalised
    substring; fuzzy_contains: best partial likeness of 80 or more. Null never matches a text test."""
    need(df, field)
    col = F.col(f"`{field}`")
    if op == "eq":
        return df.where(col == F.lit(value))
    if op == "neq":
        return df.where(~col.eqNullSafe(F.lit(value)))
    if op in ("gt", "lt"):
        number = col.try_cast("double")
        return df.where(number > float(value) if op == "gt" else number < float(value))
    if op == "contains":
        return _contains(df, col.cast("string"), plain_text(str(value)))
    if op == "fuzzy_contains":
        # Distinct values are few beside the rows; only they meet Python.
        text = col.cast("string")
        values = df.select(text.alias("_value")).where("_value is not null").distinct()
        good = values.where(partial_ratio(normalize_text("_value"), plain_text(str(value))) >= FUZZY_LEAST)
        return df.join(good, text == good["_value"], "left_semi")
    raise ValueError(f"no attribute operator {op!r}")


def _contains(df: DataFrame, text: Column, sought: str) -> DataFrame:
    """Rows whose normalised text has sought in it. Rows in ASCII need no Python; the others meet it where they are, so nothing is shuffled."""
    if df.isStreaming:
        return df.where(text.isNotNull() & normalize_text(text).contains(sought))
    plain = text.rlike(r"^[\x00-\x7F]*$")
    return df.where(plain & normalize_text(text, ascii_only=True).contains(sought)).unionByName(df.where(~plain).where(normalize_text(text).contains(sought)))


def time_of(col: Column, formats: list[str] | None = None) -> Column:
    """The column as a timestamp, by the first format that reads it; without formats by the usual ISO forms. Null if none."""
    if not formats:
        return col.try_cast("timestamp")
    return F.coalesce(*[F.try_to_timestamp(col.cast("string"), F.lit(f)) for f in formats])


def instant(value: str | datetime) -> datetime:
    """A moment in UTC; text without a zone is UTC."""
    found = value if isinstance(value, datetime) else datetime.fromisoformat(value.strip().replace("Z", "+00:00"))
    return found.replace(tzinfo=UTC) if found.tzinfo is None else found.astimezone(UTC)


def temporal_filter(df: DataFrame, time_col: str | None, from_: str | datetime, to: str | datetime, formats: list[str] | None = None) -> DataFrame:
    """Rows from one moment to another, both included; rows without a readable time drop."""
    if time_col is None:
        raise ValueError("temporal_filter: the layer has no temporal field")
    need(df, time_col)
    try:
        start, end = instant(from_), instant(to)
    except ValueError as e:
        raise ValueError(f"temporal_filter: invalid date range: {e}") from e
    if start > end:
        raise ValueError("temporal_filter: 'from' must not be after 'to'")
    kind = df.schema[time_col].dataType.simpleString()
    at = F.col(time_col) if kind == "timestamp" else F.col(time_col).cast("timestamp") if kind in ("timestamp_ntz", "date") else time_of(F.col(time_col), formats)
    return df.where(at.between(F.lit(start), F.lit(end)))


def look_back(df: DataFrame, time_col: str, now: datetime, lookback: str = "1 hour", formats: list[str] | None = None) -> DataFrame:
    """The last stretch of a moving layer before now; rows without a readable time drop."""
    end = F.lit(instant(now))
    text = df.schema[time_col].dataType.simpleString() == "string"
    at = time_of(F.col(time_col), formats) if text else F.col(time_col).cast("timestamp")
    return df.where(at.between(end - F.expr(f"interval {lookback}"), end))


Where = tuple[str | None, str | None, Any]


def reference_filter(ref: DataFrame, where: Where | None) -> DataFrame:
    """Reference entities by (field, eq or contains, value); contains is literal and blind to case."""
    if where is None or all(x is None for x in where):
        return ref
    if any(x is None for x in where):
        raise ValueError("a reference filter needs field, operator and value")
    field, op, value = where
    need(ref, field)
    if op == "eq":
        return ref.where(F.col(field) == F.lit(value))
    if op != "contains":
        raise ValueError(f"no reference operator {op!r}")
    return ref.where(F.lower(F.col(field).cast("string")).contains(str(value).lower()))


def drop_invalid(df: DataFrame, observation: Observation | None = None) -> DataFrame:
    """Rows with a geometry; an observation counts read and rejected rows in the same job."""
    good = F.col("geom.type").isNotNull() if "geom" in df.columns else F.col("lon").isNotNull() & F.col("lat").isNotNull()
    if observation is not None:
        df = df.observe(observation, F.count(F.lit(1)).alias("read"), F.sum((~good).cast("long")).alias("rejected"))
    return df.where(good)


def guard_wgs84(df: DataFrame) -> DataFrame:
    """Fails the job at the first coordinates outside longitude and latitude."""
    if "geom" in df.columns:
        bad = (F.col("geom.xmin") < -180) | (F.col("geom.xmax") > 180) | (F.col("geom.ymin") < -90) | (F.col("geom.ymax") > 90)
    else:
        bad = (F.abs("lon") > 180) | (F.abs("lat") > 90)
    return df.where(F.when(F.coalesce(bad, F.lit(False)), F.raise_error(F.lit("coordinates outside WGS84")).cast("boolean")).otherwise(True))


def observe_step(df: DataFrame, name: str, observation: Observation) -> DataFrame:
    """Counts a step's rows in the job that runs it."""
    return df.observe(observation, F.count(F.lit(1)).alias(f"{name}_rows"))


def is_empty(df: DataFrame) -> bool:
    return df.isEmpty()


def count(df: DataFrame) -> DataFrame:
    return df.agg(F.count(F.lit(1)).alias("count"))
