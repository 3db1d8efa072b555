"""Operations and sources by name, and plans as one chain of them.

A plan is {"steps": [{"id", "op", "input", ...}], "output": id}. Its checks
come before any job; the steps fold into one DataFrame, which the optimiser
sees whole but where an operation stores what it goes over several times.
Metric steps look up their rows' zone first, one number. Steps act in the order written: nothing is pushed below
a step that it doesn't commute with, except by the optimiser itself.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field
from datetime import datetime
from math import cos, radians
from typing import Any

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from geoweft.functions.geodesy import metric_xy, segment_distance_sql
from geoweft.functions.geometry import GEOMETRY
from geoweft.operators import filters, moving, proximity, ranking, topology
from geoweft.operators.filters import boundary_edges
from geoweft.session import staged
from geoweft.sources import catalog as catalogs

Step = dict[str, Any]


@dataclass
class Layer:
    """A layer's features (with feature_id), its time column, and how far back a moving layer is read by default."""

    features: DataFrame
    temporal_field: str | None = None
    lookback: str | None = None
    time_formats: list[str] | None = None


@dataclass
class Context:
    spark: SparkSession
    layers: dict[str, Layer]
    boundary: dict[str, Any] | None = None
    now: datetime | None = None
    temporal: dict[str, Layer] = field(default_factory=dict)

    def load(self, name: str, buffer_m: float | None = None, narrow: bool = True) -> DataFrame:
        """A layer's rows in the boundary, or within buffer_m of it."""
        layer = self.layers[name]
        df = layer.features
        if layer.lookback and self.now and layer.temporal_field:
            df = filters.look_back(df, layer.temporal_field, self.now, layer.lookback, layer.time_formats)
        if self.boundary is None or not narrow:
            return df
        return filters.within_geometry(df, self.boundary) if not buffer_m else near_boundary(df, self.boundary, buffer_m)

    def targets(self, name: str, buffer_m: float | None = None) -> DataFrame:
        return self.load(name, buffer_m).withColumnRenamed("feature_id", "target_id")


Operation = Callable[[DataFrame | None, Step, Context], DataFrame]
OPERATIONS: dict[str, Operation] = {}
SOURCES: dict[str, Callable[..., DataFrame]] = {}


def register_op(name: str, run: Operation | None = None):
    """Adds an operation; as a decorator without run."""
    if run is None:
        return lambda f: register_op(name, f) or f
    OPERATIONS[name] = run
    return None


#: For each source, the formats of its times where these aren't ISO, and how far back its layers are read by default.
SOURCE_TIMES: dict[str, tuple[list[str] | None, str | None]] = {}


def register_source(name: str, load: Callable[..., DataFrame], time_formats: list[str] | None = None, lookback: str | None = None) -> None:
    """Adds a layer source for a provider: a function of (spark, source_url, **parameters) that returns features.

    A layer's own tags, time_format:... (as often as there are formats) and
    lookback:..., go before the source's time_formats and lookback.
    """
    SOURCES[name] = load
    SOURCE_TIMES[name] = time_formats, lookback


def near_boundary(df: DataFrame, boundary: dict[str, Any], metres: float) -> DataFrame:
    """Features in the boundary or at most so far from it, by metric distance to it; no buffer is made.

    A degree of latitude has over 110 km, one of longitude that times the
    cosine: the box in degrees reaches the scan, the distance is exact. Points
    are measured to the boundary's edges, lines and areas as near measures them.
    """
    y0, y1 = boundary["ymin"], boundary["ymax"]
    dy = metres / 110_000
    dx = metres / (110_000 * max(0.01, cos(radians(max(abs(y0), abs(y1)) + dy))))
    if "lon" not in df.columns:
        return _shapes_near_boundary(df, boundary, metres, dx, dy)
    boxed = df.where(F.col("lon").between(boundary["xmin"] - dx, boundary["xmax"] + dx) & F.col("lat").between(y0 - dy, y1 + dy))
    meridian = ((boundary["xmin"] + boundary["xmax"]) / 2 + 180) // 6 * 6 - 177
    edges = boundary_edges(boundary)
    inside = F.expr(filters.inside_sql("lon", "lat", edges))
    rows = [(a, b, c, d) for a, b, c, d in edges]
    ends = df.sparkSession.createDataFrame(rows, "ax0 double, ay0 double, bx0 double, by0 double")
    ends = metric_xy(ends, meridian=meridian, lon="ax0", lat="ay0", x="ax", y="ay")
    ends = metric_xy(ends, meridian=meridian, lon="bx0", lat="by0", x="bx", y="by").agg(F.collect_list(F.struct("ax", "ay", "bx", "by")).alias("_edges"))
    placed = metric_xy(boxed, meridian=meridian, x="_x", y="_y").crossJoin(F.broadcast(ends))  # one row, the boundary's edges
    close = F.exists("_edges", lambda e: F.expr("true")) if not rows else F.expr(f"exists(_edges, e -> {segment_distance_sql('_x', '_y', 'e.ax', 'e.ay', 'e.bx', 'e.by')} <= {float(metres)!r})")
    return placed.where(inside | close).drop("_x", "_y", "_edges")


def _shapes_near_boundary(df: DataFrame, boundary: dict[str, Any], metres: float, dx: float, dy: float) -> DataFrame:
    x0, x1, y0, y1 = boundary["xmin"] - dx, boundary["xmax"] + dx, boundary["ymin"] - dy, boundary["ymax"] + dy
    boxed = df.where((F.col("geom.xmin") <= x1) & (F.col("geom.xmax") >= x0) & (F.col("geom.ymin") <= y1) & (F.col("geom.ymax") >= y0))
    meridian = ((boundary["xmin"] + boundary["xmax"]) / 2 + 180) // 6 * 6 - 177
    area = df.sparkSession.createDataFrame([(0, boundary)], T.StructType([T.StructField("target_id", T.LongType()), T.StructField("geom", GEOMETRY)]))
    key = "feature_id" if "feature_id" in df.columns else "target_id"
    near = staged(proximity.shapes_near_one(boxed, area, metres, key, meridian).select(F.col(key).alias("_near_id")), "near-boundary")
    return boxed.join(near, F.col(key) == F.col("_near_id"), "left_semi")


def _where(step: Step, prefix: str) -> filters.Where | None:
    found = tuple(step.get(f"{prefix}_{k}") for k in ("field", "operator", "value"))
    return None if all(x is None for x in found) else found


@register_op("load")
def _load(_: DataFrame | None, step: Step, ctx: Context) -> DataFrame:
    return ctx.load(step["layer"])


@register_op("within_geometry")
def _within(df: DataFrame, step: Step, ctx: Context) -> DataFrame:
    return filters.within_geometry(df, ctx.boundary)


@register_op("attribute_filter")
def _attribute(df: DataFrame, step: Step, ctx: Context) -> DataFrame:
    return filters.attribute_filter(df, step["field"], step["operator"], step["value"])


@register_op("temporal_filter")
def _temporal(df: DataFrame, step: Step, ctx: Context) -> DataFrame:
    layer = ctx.temporal[step["input"]]
    return filters.temporal_filter(df, layer.temporal_field, step["from"], step["to"], layer.time_formats)


@register_op("near")
def _near(df: DataFrame, step: Step, ctx: Context) -> DataFrame:
    return proximity.near(df, ctx.targets(step["target_layer"], step["distance_m"]), step["distance_m"], _where(step, "target"))


@register_op("nearest_n")
def _nearest_n(df: DataFrame, step: Step, ctx: Context) -> DataFrame:
    return proximity.nearest_n(df, ctx.targets(step["target_layer"]), step["count"], _where(step, "target"))


@register_op("near_all")
def _near_all(df: DataFrame, step: Step, ctx: Context) -> DataFrame:
    distance = step.get("distance_m", 300)
    targets = [(ctx.targets(t["layer"], distance), _where({f"t_{k}": v for k, v in t.items()}, "t")) for t in step["targets"]]
    return proximity.near_all(df, targets, distance, step.get("count"), [t["layer"] for t in step["targets"]])


@register_op("between")
def _between(df: DataFrame, step: Step, ctx: Context) -> DataFrame:
    width = step.get("corridor_width_m", 100)
    return proximity.between(df, ctx.targets(step["first_target_layer"], width), ctx.targets(step["second_target_layer"], width), width, _where(step, "first_target"), _where(step, "second_target"))


@register_op("cluster")
def _cluster(df: DataFrame, step: Step, ctx: Context) -> DataFrame:
    return proximity.cluster(df, step["min_group_size"], step["max_distance_m"])


def _relation(run):
    return lambda df, step, ctx: run(df, ctx.targets(step["target_layer"]), _where(step, "target"))


register_op("crosses", _relation(topology.crosses))
register_op("touches", _relation(topology.touches))
register_op("contains", _relation(topology.contains))


def _formats(step: Step, ctx: Context) -> list[str] | None:
    """Time formats of the layer that the step's rows come from."""
    layer = ctx.temporal.get(step["input"])
    return layer.time_formats if layer else None


@register_op("latest_per_entity")
def _latest(df: DataFrame, step: Step, ctx: Context) -> DataFrame:
    return moving.latest_per_entity(df, step.get("entity_field", "netId"), step.get("time_field", "eventTime"), _formats(step, ctx))


@register_op("movement_direction")
def _movement(df: DataFrame, step: Step, ctx: Context) -> DataFrame:
    return moving.movement_direction(df, step["direction"], step.get("entity_field", "netId"), step.get("time_field", "eventTime"), step.get("min_distance_m", 50), _formats(step, ctx))


@register_op("directional")
def _directional(df: DataFrame, step: Step, ctx: Context) -> DataFrame:
    return ranking.directional(df, step["direction"], step.get("count", 1))


@register_op("count")
def _count(df: DataFrame, step: Step, ctx: Context) -> DataFrame:
    return filters.count(df)


class PlanError(ValueError):
    """A plan that can't run, found before any job."""


def check_plan(plan: dict[str, Any], layers: set[str], has_boundary: bool) -> None:
    """Ids unique, inputs earlier, layers known, filter triples whole, boundary exactly with within_geometry, output last, count terminal."""
    steps = plan.get("steps") or []
    if not steps:
        raise PlanError("the plan has no steps")
    seen: dict[str, Step] = {}
    for step in steps:
        name, op = step.get("id"), step.get("op")
        if op not in OPERATIONS:
            raise PlanError(f"step {name!r}: unknown operation {op!r}")
        if name in seen:
            raise PlanError(f"step id {name!r} twice")
        if op != "load" and step.get("input") not in seen:
            raise PlanError(f"step {name!r}: input {step.get('input')!r} is no earlier step")
        if op != "load" and seen[step["input"]]["op"] == "count":
            raise PlanError(f"step {name!r}: a count can't be an input")
        used = [step[k] for k in ("layer", "target_layer", "first_target_layer", "second_target_layer") if k in step]
        for target in step.get("targets", []):
            used.append(target.get("layer"))
            _whole(name, [target.get(k) for k in ("field", "operator", "value")])
        for layer in used:
            if layer not in layers:
                raise PlanError(f"step {name!r}: layer {layer!r} is not in the catalog")
        for prefix in ("target", "first_target", "second_target"):
            _whole(name, [step.get(f"{prefix}_{k}") for k in ("field", "operator", "value")])
        if op == "within_geometry" and not has_boundary:
            raise PlanError(f"step {name!r}: within_geometry without a boundary")
        seen[name] = step
    if has_boundary and not any(s["op"] == "within_geometry" for s in steps):
        raise PlanError("a boundary is given, but no step applies within_geometry")
    if plan.get("output") != steps[-1]["id"]:
        raise PlanError(f"output {plan.get('output')!r} must be the last step")
    if any(s["op"] == "count" for s in steps[:-1]):
        raise PlanError("count must be the last step")


def _whole(name: str, values: list[Any]) -> None:
    if any(v is not None for v in values) and any(v is None for v in values):
        raise PlanError(f"step {name!r}: a target filter needs field, operator and value")


def run_plan(spark: SparkSession, plan: dict[str, Any], layers: dict[str, Layer], boundary: dict[str, Any] | None = None, now: datetime | None = None, counts: dict[str, Observation] | None = None) -> DataFrame:
    """The plan's output as one lazy DataFrame.

    counts, an empty dict, gets an Observation for each step: the rows that left
    it, under "<id>_rows", once the output has been computed. Counted steps are
    walls that the optimiser moves no filter across.
    """
    check_plan(plan, set(layers), boundary is not None)
    ctx = Context(spark, layers, boundary, now)
    results: dict[str, DataFrame] = {}
    for step in plan["steps"]:
        source = step.get("input")
        found = OPERATIONS[step["op"]](results.get(source), step, ctx)
        if counts is not None:
            counts[step["id"]] = Observation(f"step {step['id']}")
            found = filters.observe_step(found, step["id"], counts[step["id"]])
        results[step["id"]] = found
        layer = layers[step["layer"]] if step["op"] == "load" else ctx.temporal.get(source)
        if layer is not None:
            ctx.temporal[step["id"]] = layer
    return results[plan["output"]]


def step_trace(spark: SparkSession, plan: dict[str, Any], counts: dict[str, Observation]) -> DataFrame:
    """(step, op, input, input_rows, output_rows) of a plan whose output has been computed with counts; a load has no input."""
    rows = {name: int(x.get[f"{name}_rows"]) for name, x in counts.items()}
    found = [(s["id"], s["op"], s.get("input"), rows.get(s.get("input")), rows[s["id"]]) for s in plan["steps"]]
    return spark.createDataFrame(found, "step string, op string, input string, input_rows long, output_rows long")


def load_layer(spark: SparkSession, catalog: DataFrame, layer_id: str, boundary: dict[str, Any] | None = None, equals: list[tuple[str, Any]] | None = None, between: tuple[Any, Any] | None = None, limit: int | None = None) -> Layer:
    """A layer of the catalog, by its id, through the source registered for its provider.

    The source gets the catalog's URL and the query parameters in it. boundary,
    equals (field, value pairs) and between (two moments of the layer's time
    column) narrow the rows; they are plain filters, so those on stored columns
    reach the scan. limit is for samples: any so many rows.
    """
    found = catalogs.catalog_parts(catalog.where(F.col("id") == layer_id)).head()
    if found is None:
        raise PlanError(f"layer {layer_id!r} is not in the catalog")
    if found.provider not in SOURCES:
        raise PlanError(f"layer {layer_id!r}: no source for provider {found.provider!r}")
    rows = SOURCES[found.provider](spark, found.source_url, **(found.parameters or {}))
    time = found.temporal_field if found.temporal_field in rows.columns else None
    tags = [x.partition(":") for x in found.tags or [] if x]
    formats, lookback = SOURCE_TIMES.get(found.provider, (None, None))
    formats = [v for k, _, v in tags if k == "time_format" and v] or formats
    lookback = next((v for k, _, v in tags if k == "lookback" and v), lookback)
    for name, value in equals or []:
        rows = filters.attribute_filter(rows, name, "eq", value)
    if between is not None:
        rows = filters.temporal_filter(rows, time, *between, formats)
    if boundary is not None:
        rows = filters.within_geometry(rows, boundary)
    return Layer(rows if limit is None else rows.limit(limit), time, lookback if time else None, formats)


def catalog_layers(spark: SparkSession, catalog: DataFrame, plan: dict[str, Any]) -> dict[str, Layer]:
    """The layers that a plan names, loaded from the catalog; those it doesn't know are left out, which check_plan reports."""
    names = {s[k] for s in plan.get("steps", []) for k in ("layer", "target_layer", "first_target_layer", "second_target_layer") if k in s}
    names |= {t["layer"] for s in plan.get("steps", []) for t in s.get("targets", []) if "layer" in t}
    known = catalogs.queryable(catalog, list(SOURCES)).where(F.col("id").isin(sorted(names))).select("id").collect()  # at most the plan's layers
    return {r.id: load_layer(spark, catalog, r.id) for r in known}
