"""Stored layers laid out for box and time filters.

A layer's rows are dealt into ranges of a space-filling curve, each range being
files of its own, and by the day, month or year of their time where they have
one. A file then holds a small piece of the map, so the least and greatest
coordinates in its footer let a box filter pass it over, and a range of time
opens the folders of that time only. Reading puts both filters in plain form on the stored columns.
"""

from __future__ import annotations

from datetime import datetime
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from geoweft.functions.names import free_name
from geoweft.operators.filters import instant, need, temporal_filter, within_geometry

#: Folder columns by the stretch of time that a folder holds.
PERIODS = {"day": "layer_day", "month": "layer_month", "year": "layer_year"}
BITS = 16


def _spread(x: Column) -> Column:
    """The lower BITS bits, a free one after each."""
    for shift, mask in ((8, 0x00FF00FF), (4, 0x0F0F0F0F), (2, 0x33333333), (1, 0x55555555)):
        x = x.bitwiseOR(F.shiftleft(x, shift)).bitwiseAND(F.lit(mask))
    return x


def morton(lon: Column, lat: Column) -> Column:
    """Place on a Z curve over the whole map, cells of a 65,536th of it a side; null without coordinates."""
    whole = (1 << BITS) - 1
    cell = lambda c, low, width: F.least(F.lit(whole), F.greatest(F.lit(0), F.floor((c - low) / width * (whole + 1)))).cast("long")
    placed = _spread(cell(lon, -180.0, 360.0)).bitwiseOR(F.shiftleft(_spread(cell(lat, -90.0, 180.0)), 1))
    return F.when(lon.isNotNull() & lat.isNotNull(), placed)


def write_layer(df: DataFrame, path: str, files: int, time: str | None = None, period: str = "day") -> None:
    """Writes a layer of points (lon, lat) or geometries (geom) in about so many ranges, by periods of the timestamp column time if one is named.

    A period should hold a file's worth of rows at least: every range writes a file for each period it meets.

    Rows without coordinates or time are kept, in ranges and a folder of their
    own; rows of one place can be many, as ranges are cut by the whole key and
    then by a hash of the row.
    """
    points = {"lon", "lat"} <= set(df.columns)
    need(df, *(["lon", "lat"] if points else ["geom"]), *([time] if time else []))
    lon, lat = (F.col("lon"), F.col("lat")) if points else ((F.col("geom.xmin") + F.col("geom.xmax")) / 2, (F.col("geom.ymin") + F.col("geom.ymax")) / 2)
    place, salt = free_name(df, "place"), free_name(df, "salt")
    rows = df.withColumns({place: morton(lon, lat), salt: F.xxhash64(*[F.col(f"`{c}`").cast("string") for c in df.columns if c != "geom"])})
    order = [place, salt]
    if time:
        folder = PERIODS[period]
        rows = rows.withColumn(folder, F.to_date(time) if period == "day" else F.trunc(F.to_date(time), period))
        order = [folder, *order]
    writer = rows.repartitionByRange(files, *order).sortWithinPartitions(*order).drop(place, salt).write
    (writer.partitionBy(PERIODS[period]) if time else writer).parquet(path)


def read_layer(spark: SparkSession, path: str, boundary: dict[str, Any] | None = None, time: str | None = None, between: tuple[str | datetime, str | datetime] | None = None) -> DataFrame:
    """A layer as write_layer stored it, in a boundary and between two moments of its time column; the files of other places and days stay closed."""
    rows = spark.read.parquet(path)
    if between is not None:
        first, last = (F.lit(instant(x).date()) for x in between)
        for period, folder in PERIODS.items():
            if folder in rows.columns:
                rows = rows.where(F.col(folder).between(first if period == "day" else F.trunc(first, period), last))
        rows = temporal_filter(rows, time, *between)
    rows = rows.drop(*PERIODS.values())
    return rows if boundary is None else within_geometry(rows, boundary)
