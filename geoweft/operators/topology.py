"""Topological joins: crosses, touches, contains, and points in many areas.

Boxes meet by grid cell first (an equi-join), then the exact predicate runs on
the candidate pairs; the result is a semi join on the input. Planar, in
degrees. Cells default to a hundredth of a degree; a geometry is copied to
every cell of its box, so give a cell about as large as the usual geometry.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from geoweft.functions.geometry import area_relation_sql, box_relation, is_box, point_geometry, relation
from geoweft.operators.edges import line_pairs, lines_with
from geoweft.operators.filters import Where, need, reference_filter

REASONS = {
    "crosses": "הישות חוצה ישות בשכבת הייחוס.",
    "touches": "גבול הישות נוגע בגבול ישות בשכבת הייחוס ללא חפיפה פנימית.",
    "contains": "הישות מכילה במלואה ישות משכבת הייחוס.",
}


def _cells(low: Column, high: Column, cell: float) -> Column:
    return F.sequence(F.floor(low / cell), F.floor(high / cell))


def _boxed(df: DataFrame, key: str, cell: float, prefix: str) -> DataFrame:
    geom = F.col("geom") if "geom" in df.columns else point_geometry(F.col("lon"), F.col("lat"))
    rows = df.select(F.col(key).alias(f"{prefix}id"), geom.alias(f"{prefix}geom")).where(F.col(f"{prefix}geom.type").isNotNull() & F.col(f"{prefix}geom.xmin").isNotNull())
    g = f"{prefix}geom"
    rows = rows.withColumn("cx", F.explode(_cells(F.col(f"{g}.xmin"), F.col(f"{g}.xmax"), cell)))
    return rows.withColumn("cy", F.explode(_cells(F.col(f"{g}.ymin"), F.col(f"{g}.ymax"), cell)))


def _boxes_meet() -> Column:
    return (F.col("a_geom.xmin") <= F.col("b_geom.xmax")) & (F.col("a_geom.xmax") >= F.col("b_geom.xmin")) & (F.col("a_geom.ymin") <= F.col("b_geom.ymax")) & (F.col("a_geom.ymax") >= F.col("b_geom.ymin"))


def _kind(df: DataFrame) -> str | None:
    """point, box or line where the columns say that all rows are; else None."""
    if "geom" not in df.columns:
        return "point"
    return df.schema["geom"].metadata.get("shape")


def pairs(df: DataFrame, ref: DataFrame, predicate: str, cell: float = 0.01) -> DataFrame:
    """(feature_id, target_id) for which the predicate holds, each pair once.

    Lines meet lines by their edges. Points and rectangles, and points against
    areas, are decided by built-in expressions; only other pairs go to the
    kernel. Where columns tell that all rows are points, rectangles or lines,
    the plan has no kernel.
    """
    return _pairs(df, ref, predicate, cell, line_pairs)


def _pairs(df: DataFrame, ref: DataFrame, predicate: str, cell: float, of_lines: Callable[[DataFrame, DataFrame, str, float], DataFrame]) -> DataFrame:
    """As pairs; what of_lines finds among lines and lines is added, by the columns that it has."""
    known = _kind(df), _kind(ref)
    if known == ("line", "line"):
        return of_lines(df, ref, predicate, cell)
    a, b = _boxed(df, "feature_id", cell, "a_"), _boxed(ref, "target_id", cell, "b_")
    met = a.join(b, ["cx", "cy"]).where(_boxes_meet())
    # Boxes that share several cells are tested in the first of them only.
    first_x = F.floor(F.greatest("a_geom.xmin", "b_geom.xmin") / cell)
    first_y = F.floor(F.greatest("a_geom.ymin", "b_geom.ymin") / cell)
    met = met.where((F.col("cx") == first_x) & (F.col("cy") == first_y))
    ids = [F.col("a_id").alias("feature_id"), F.col("b_id").alias("target_id")]
    if set(known) <= {"point", "box"}:
        return met.where(box_relation(predicate, "a_geom", known[0], "b_geom", known[1])).select(*ids)
    lines = [df.where(_is_line("geom")) if "geom" in df.columns else None for df in (df, ref)]
    met = met.where(~(_is_line("a_geom") & _is_line("b_geom")))
    shapes = {g: F.when(F.col(f"{g}.type") == "Point", "point").when(is_box(g), "box").when(F.col(f"{g}.type").endswith("Polygon"), "area").otherwise("other") for g in ("a_geom", "b_geom")}
    met = met.withColumn("_a", shapes["a_geom"]).withColumn("_b", shapes["b_geom"])
    simple = F.lit(None).cast("boolean")
    for one in ("point", "box"):
        for two in ("point", "box"):
            simple = F.when((F.col("_a") == one) & (F.col("_b") == two), box_relation(predicate, "a_geom", one, "b_geom", two)).otherwise(simple)
    simple = F.when((F.col("_a") == "area") & (F.col("_b") == "point"), F.expr(area_relation_sql(predicate, "a_geom", "b_geom", True))).otherwise(simple)
    simple = F.when((F.col("_a") == "point") & (F.col("_b") == "area"), F.expr(area_relation_sql(predicate, "b_geom", "a_geom", False))).otherwise(simple)
    met = met.withColumn("_simple", simple).where(F.coalesce("_simple", F.lit(True)))
    # One pass: geometries go along only where the expressions haven't decided.
    open_ = [F.when(F.col("_simple").isNull(), F.col(g)).alias(g) for g in ("a_geom", "b_geom")]
    kinds = [f"{n} {df.schema[n].dataType.simpleString()}" for df, n in ((df, "feature_id"), (ref, "target_id"))]
    found = met.select(*ids, *open_).mapInArrow(_kernel(predicate), ", ".join(kinds))
    return found if None in lines else found.unionByName(of_lines(*lines, predicate, cell), allowMissingColumns=True)


def _kernel(predicate: str):
    """Ids of the rows for which the predicate holds; rows without geometries are known to be among them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in batches:
            both = zip(part.column(2).to_pylist(), part.column(3).to_pylist())
            kept = [x is None or relation(x, y)[predicate] for x, y in both]
            yield part.select([0, 1]).filter(pa.array(kept, pa.bool_()))

    return run


def _is_line(g: str) -> Column:
    return F.col(f"{g}.type").isin("LineString", "MultiLineString")


def _related(df: DataFrame, ref: DataFrame, predicate: str, where: Where | None, cell: float) -> DataFrame:
    need(df, "feature_id")
    # Which lines are related, not to how many: pairs of dense lines are very many.
    one_each = not (predicate == "contains" or df.isStreaming or ref.isStreaming)
    found = _pairs(df, reference_filter(ref, where), predicate, cell, lines_with if one_each else line_pairs).select("feature_id")
    return df.join(found, "feature_id", "left_semi").withColumn("match_reason", F.lit(REASONS[predicate]))


def crosses(df: DataFrame, ref: DataFrame, where: Where | None = None, cell: float = 0.01) -> DataFrame:
    """Features whose interior crosses a reference: lines through lines or areas."""
    return _related(df, ref, "crosses", where, cell)


def touches(df: DataFrame, ref: DataFrame, where: Where | None = None, cell: float = 0.01) -> DataFrame:
    """Features that meet a reference on boundaries only."""
    return _related(df, ref, "touches", where, cell)


def contains(df: DataFrame, ref: DataFrame, where: Where | None = None, cell: float = 0.01) -> DataFrame:
    """Features that hold a reference whole, not on the boundary alone."""
    return _related(df, ref, "contains", where, cell)


def within_any(df: DataFrame, boundaries: DataFrame, cell: float = 0.01) -> DataFrame:
    """(feature_id, boundary_id): the areas, of many, that each feature meets, edges included."""
    found = pairs(df, boundaries.withColumnRenamed("boundary_id", "target_id"), "intersects", cell)
    return found.withColumnRenamed("target_id", "boundary_id")
