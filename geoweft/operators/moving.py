"""Moving entities: latest fix, movement, step distances."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from geoweft.functions.geodesy import metric_xy, planar_distance
from geoweft.operators.filters import need, time_of

DIRECTIONS = ("north", "south", "east", "west", "any")


def _fixes(df: DataFrame, entity: str, time: str, formats: list[str] | None) -> DataFrame:
    """Rows with entity and readable time, the time as _t."""
    need(df, entity, time)
    kind = df.schema[time].dataType.simpleString()
    at = F.col(time).cast("timestamp") if kind in ("timestamp", "timestamp_ntz", "date") else time_of(F.col(time), formats)
    return df.withColumn("_t", at).where(F.col(entity).isNotNull() & F.col("_t").isNotNull())


def latest_per_entity(df: DataFrame, entity: str = "netId", time: str = "eventTime", formats: list[str] | None = None) -> DataFrame:
    """The newest row of each entity, of equal times that with the greater feature_id.

    max_by combines before the shuffle, so an entity with very many fixes
    sends one row from each task.
    """
    rows = _fixes(df, entity, time, formats)
    newest = rows.groupBy(entity).agg(F.max_by(F.struct(*df.columns), F.struct("_t", "feature_id")).alias("r"))
    return newest.select("r.*")


def step_distances(df: DataFrame, entity: str, time: str, formats: list[str] | None = None, meridian: float | None = None) -> DataFrame:
    """(entity, feature_id, step_m): distance from the fix before; null at the first."""
    rows = metric_xy(_fixes(df, entity, time, formats), meridian=meridian)
    order = Window.partitionBy(entity).orderBy("_t", "feature_id")
    return rows.select(entity, "feature_id", planar_distance(F.col("x"), F.col("y"), F.lag("x").over(order), F.lag("y").over(order)).alias("step_m"))


def _matches(direction: str, dx: Column, dy: Column) -> Column:
    axis, other = (dy, dx) if direction in ("north", "south") else (dx, dy)
    return (F.abs(axis) >= F.abs(other)) & (axis > 0 if direction in ("north", "east") else axis < 0)


def movement_direction(df: DataFrame, direction: str, entity: str = "netId", time: str = "eventTime", min_distance_m: float = 50.0, formats: list[str] | None = None, meridian: float | None = None, with_path: bool = True) -> DataFrame:
    """Latest fix of the entities that moved at least so far in a direction; adds movement_distance_m, movement_direction, movement_path.

    A direction counts displacement from first to last fix along its axis, any
    counts the path. Entities need two fixes. First and last are aggregates;
    only any needs the fixes in order. The path is gathered for the entities
    that pass, and is as long as their fixes.
    """
    if direction not in DIRECTIONS:
        raise ValueError(f"no direction {direction!r}")
    if not 0 <= min_distance_m <= 50000:
        raise ValueError("movement_direction: distance must be 0 to 50000 m")
    rows = metric_xy(_fixes(df, entity, time, formats), meridian=meridian)
    at = F.struct("_t", "feature_id")
    ends = rows.groupBy(entity).agg(F.min_by(F.struct("x", "y"), at).alias("a"), F.max_by(F.struct("x", "y"), at).alias("b"), F.max_by("feature_id", at).alias("_last"), F.count("*").alias("n"))
    dx, dy = F.col("b.x") - F.col("a.x"), F.col("b.y") - F.col("a.y")
    if direction == "any":
        steps = step_distances(df, entity, time, formats, meridian).groupBy(entity).agg(F.sum("step_m").alias("d"))
        moved = ends.where("n >= 2").join(steps, entity)
    else:
        moved = ends.where("n >= 2").where(_matches(direction, dx, dy)).withColumn("d", F.sqrt(dx * dx + dy * dy))
    moved = moved.where(F.col("d") >= min_distance_m).select(F.col(entity).alias("_entity"), F.col("_last"), F.round("d", 2).alias("movement_distance_m"))
    latest = df.join(moved, (F.col(entity) == F.col("_entity")) & (F.col("feature_id") == F.col("_last")))
    out = latest.withColumn("movement_direction", F.lit(direction))
    if with_path:
        path = rows.join(moved.select("_entity"), F.col(entity) == F.col("_entity"), "left_semi").groupBy(F.col(entity).alias("_who"))
        path = path.agg(F.transform(F.array_sort(F.collect_list(F.struct("_t", "feature_id", "lon", "lat"))), lambda p: F.array(p["lon"], p["lat"])).alias("c"))
        path = path.select("_who", F.struct(F.lit("LineString").alias("type"), F.col("c").alias("coordinates")).alias("movement_path"))
        out = out.join(path, F.col("_entity") == F.col("_who"))
    return out.select(*df.columns, "movement_distance_m", "movement_direction", *(["movement_path"] if with_path else []))
