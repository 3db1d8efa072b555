"""Metric projection and planar measures as column expressions.

Storage is always WGS84 longitude and latitude. Metric x and y are computed
columns: UTM of the zone that holds the centre of all rows' common bounding
box, by the fourth-order Krueger series. Every expression is SQL text built
from plain math functions, so it stays inside generated code.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: WGS84 semi-major axis and flattening, UTM scale and false easting.
AXIS, FLATTENING, SCALE, EASTING, SOUTHING = 6378137.0, 1 / 298.257223563, 0.9996, 500000.0, 10000000.0


def _series() -> tuple[float, float, list[float]]:
    """Rectifying radius times scale, eccentricity, and the four series coefficients."""
    n = FLATTENING / (2 - FLATTENING)
    radius = AXIS / (1 + n) * (1 + n**2 / 4 + n**4 / 64)
    alpha = [
        n / 2 - 2 / 3 * n**2 + 5 / 16 * n**3 + 41 / 180 * n**4,
        13 / 48 * n**2 - 3 / 5 * n**3 + 557 / 1440 * n**4,
        61 / 240 * n**3 - 103 / 140 * n**4,
        49561 / 161280 * n**4,
    ]
    return SCALE * radius, 2 * n**0.5 / (1 + n), alpha


def _number(x: float) -> str:
    """A literal that every dialect reads as a double."""
    return f"{x:.17e}"


def projection_sql(lon: str, lat: str, meridian: str) -> tuple[str, str]:
    """SQL text of x and y for a point, given the central meridian. Runs in any dialect with hyperbolic functions."""
    scale, e, alpha = _series()
    sin = f"sin(radians({lat}))"
    t = f"sinh(atanh({sin}) - {_number(e)} * atanh({_number(e)} * {sin}))"
    turn = f"radians({lon} - {meridian})"
    xi = f"atan2({t}, cos({turn}))"
    eta = f"atanh(sin({turn}) / sqrt(1 + ({t}) * ({t})))"
    x = " + ".join(f"{_number(a)} * cos({2 * j} * {xi}) * sinh({2 * j} * {eta})" for j, a in enumerate(alpha, 1))
    y = " + ".join(f"{_number(a)} * sin({2 * j} * {xi}) * cosh({2 * j} * {eta})" for j, a in enumerate(alpha, 1))
    return f"({_number(EASTING)} + {_number(scale)} * ({eta} + {x}))", f"({_number(scale)} * ({xi} + {y}))"


def _steps(lon: str, lat: str, meridian: str, of: str) -> list[dict[str, str]]:
    """projection_sql in three steps: what each names comes, after the prefix ``of``, in the next. What x and y share is computed once."""
    scale, e, alpha = _series()
    sin = f"sin(radians({lat}))"
    east = " + ".join(f"{_number(a)} * cos({2 * j} * {of}xi) * sinh({2 * j} * {of}eta)" for j, a in enumerate(alpha, 1))
    north = " + ".join(f"{_number(a)} * sin({2 * j} * {of}xi) * cosh({2 * j} * {of}eta)" for j, a in enumerate(alpha, 1))
    return [
        {"t": f"sinh(atanh({sin}) - {_number(e)} * atanh({_number(e)} * {sin}))", "turn": f"radians({lon} - {meridian})"},
        {"xi": f"atan2({of}t, cos({of}turn))", "eta": f"atanh(sin({of}turn) / sqrt(1 + {of}t * {of}t))"},
        {"x": f"({_number(EASTING)} + {_number(scale)} * ({of}eta + {east}))", "y": f"({_number(scale)} * ({of}xi + {north}))"},
    ]


def projected(df: DataFrame, lon: str, lat: str, meridian: str, x: str, y: str) -> DataFrame:
    """Adds x and y step by step, each a column, so expressions stay small."""
    first, second, last = _steps(lon, lat, meridian, "_utm_")
    for step in (first, second):
        df = df.withColumns({f"_utm_{n}": F.expr(v) for n, v in step.items()})
    return df.withColumns({x: F.expr(last["x"]), y: F.expr(last["y"])}).drop("_utm_t", "_utm_turn", "_utm_xi", "_utm_eta")


def projected_ring_sql(ring: str, meridian: str) -> str:
    """SQL text: the vertices (x, y) of a ring, in degrees, brought to metres step by step."""
    for step in _steps("v.x", "v.y", meridian, "v."):
        ring = f"transform({ring}, v -> named_struct({', '.join(f'{n!r}, {e}' for n, e in step.items())}))"
    return ring


def joint_centre(*frames: DataFrame, lon: str = "lon", lat: str = "lat") -> DataFrame:
    """One row: central meridian of the UTM zone at the centre of the frames' common bounding box, and its hemisphere."""
    boxes = [f.agg(F.min(lon).alias("x0"), F.max(lon).alias("x1"), F.min(lat).alias("y0"), F.max(lat).alias("y1")) for f in frames]
    box = reduce(DataFrame.unionByName, boxes).agg(F.min("x0").alias("x0"), F.max("x1").alias("x1"), F.min("y0").alias("y0"), F.max("y1").alias("y1"))
    zone = F.least(F.floor(((F.col("x0") + F.col("x1")) / 2 + 180) / 6) + 1, F.lit(60))
    return box.select((zone * 6 - 183).cast("double").alias("_meridian"), ((F.col("y0") + F.col("y1")) < 0).alias("_south"))


def metric_xy(df: DataFrame, *others: DataFrame, meridian: float | None = None, lon: str = "lon", lat: str = "lat", x: str = "x", y: str = "y") -> DataFrame:
    """Adds metric x and y. The zone is that of df and others together unless a meridian is given."""
    if meridian is not None:
        return projected(df, lon, lat, repr(float(meridian)), x, y)
    centre = joint_centre(df, *others, lon=lon, lat=lat)
    placed = projected(df.crossJoin(F.broadcast(centre)), lon, lat, "_meridian", x, y)  # one row
    south = F.when(F.col("_south"), F.lit(SOUTHING)).otherwise(F.lit(0.0))
    return placed.withColumn(y, F.col(y) + south).drop("_meridian", "_south")


def planar_distance(x1: Column | str, y1: Column | str, x2: Column | str, y2: Column | str) -> Column:
    x1, y1, x2, y2 = (F.col(c) if isinstance(c, str) else c for c in (x1, y1, x2, y2))
    return F.sqrt((x1 - x2) * (x1 - x2) + (y1 - y2) * (y1 - y2))


def segment_distance_sql(px: str, py: str, ax: str, ay: str, bx: str, by: str) -> str:
    """SQL text: distance of a point to a segment, also one of length zero. No part is nested in another, so generated code stays small."""
    dx, dy, ex, ey, fx, fy = f"({bx} - {ax})", f"({by} - {ay})", f"({px} - {ax})", f"({py} - {ay})", f"({px} - {bx})", f"({py} - {by})"
    along, square = f"({ex} * {dx} + {ey} * {dy})", f"({dx} * {dx} + {dy} * {dy})"
    return f"case when {along} <= 0 then sqrt({ex} * {ex} + {ey} * {ey}) when {along} >= {square} then sqrt({fx} * {fx} + {fy} * {fy}) else abs({dx} * {ey} - {dy} * {ex}) / sqrt({square}) end"


def compass(dx: Column, dy: Column) -> Column:
    """The dominant axis's direction; north or south where both axes are equal; null without movement."""
    vertical = F.abs(dy) >= F.abs(dx)
    return F.when((dx == 0) & (dy == 0), None).when(vertical, F.when(dy > 0, "north").otherwise("south")).otherwise(F.when(dx > 0, "east").otherwise("west"))


def coordinate_text(lon: Column, lat: Column, style: str = "latlon") -> Column:
    """latlon: two numbers of six decimals; dms: degrees, minutes, seconds and hemisphere; wkt: a point."""
    if style == "latlon":
        return F.format_string("%.6f, %.6f", lat, lon)
    if style == "wkt":
        return F.format_string("POINT (%.6f %.6f)", lon, lat)
    if style != "dms":
        raise ValueError(f"no coordinate style {style!r}")

    def part(value: Column, plus: str, minus: str) -> Column:
        hundredths = F.round(F.abs(value) * 360000).cast("long")
        degrees, rest = F.floor(hundredths / 360000), hundredths % 360000
        return F.format_string("%d°%d′%.2f″%s", degrees.cast("long"), F.floor(rest / 6000).cast("long"), (rest % 6000) / 100.0, F.when(value < 0, minus).otherwise(plus))

    return F.concat(part(lat, "N", "S"), F.lit(" "), part(lon, "E", "W"))
