"""Top-k, samples, previews, sets, and skew-aware cells."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from geoweft.operators.filters import need


def directional(df: DataFrame, direction: str, count: int = 1) -> DataFrame:
    """The count most northern, southern, eastern or western features by bounding-box centre; equals by feature_id."""
    if count < 1:
        raise ValueError("directional: count must be 1 or more")
    if direction not in ("north", "south", "east", "west"):
        raise ValueError(f"no direction {direction!r}")
    axis = "y" if direction in ("north", "south") else "x"
    flat = "lat" if axis == "y" else "lon"
    centre = F.col(flat) if flat in df.columns else (F.col(f"geom.{axis}min") + F.col(f"geom.{axis}max")) / 2
    order = centre.desc_nulls_last() if direction in ("north", "east") else centre.asc_nulls_last()
    return df.orderBy(order, "feature_id").limit(count)


def sample(df: DataFrame, n: int, seed: int | None = None) -> DataFrame:
    """The first n rows, or n random ones that the seed decides."""
    return df.limit(n) if seed is None else df.orderBy(F.rand(seed)).limit(n)


def preview(df: DataFrame, n: int = 20, internal: tuple[str, ...] = ("match_reason", "nearest_target_feature", "matched_reference_features", "distance_to_targets_m")) -> DataFrame:
    """The nearest n rows, those without distance last, without internal columns."""
    order = [F.col("distance_to_target_m").asc_nulls_last()] if "distance_to_target_m" in df.columns else []
    keys = [F.col("feature_id")] if "feature_id" in df.columns else []
    out = df.orderBy(*order, *keys) if order or keys else df
    return out.limit(n).drop(*internal)


def _row_key(df: DataFrame) -> Column:
    return F.to_json(F.struct(*[F.col(f"`{c}`") for c in sorted(df.columns)]))


def dedupe_rows(df: DataFrame) -> DataFrame:
    """Distinct rows, maps included."""
    if not any("map<" in t for _, t in df.dtypes):
        return df.dropDuplicates()
    return df.withColumn("_key", _row_key(df)).dropDuplicates(["_key"]).drop("_key")


def dedupe_by_id(df: DataFrame, id_col: str, order: list[str]) -> DataFrame:
    """The first row of each id in order; rows without id all stay."""
    need(df, id_col, *order)
    first = F.struct(*order)
    rows = df.where(F.col(id_col).isNotNull()).groupBy(id_col).agg(F.min_by(F.struct(*df.columns), first).alias("r")).select("r.*")
    return rows.unionByName(df.where(F.col(id_col).isNull()))


def dedupe_id_or_row(df: DataFrame, id_col: str) -> DataFrame:
    """One row for each id; rows without id by their whole content."""
    key = F.coalesce(F.concat(F.lit("id:"), F.col(id_col).cast("string")), _row_key(df))
    return df.withColumn("_key", key).dropDuplicates(["_key"]).drop("_key")


def union_pages(*pages: DataFrame) -> DataFrame:
    """All pages or tiles, columns by name, missing ones null."""
    out = pages[0]
    for page in pages[1:]:
        out = out.unionByName(page, allowMissingColumns=True)
    return out


def sample_field(df: DataFrame, field: str, limit: int = 20, most_chars: int = 80) -> DataFrame:
    """value: distinct values of a field in order of first feature_id, at most 20; none for an unknown field."""
    limit = min(limit, 20)
    if field not in df.columns:
        return df.sparkSession.createDataFrame([], "value string")
    text = F.substring(F.col(f"`{field}`").cast("string"), 1, most_chars)
    found = df.select(text.alias("value"), "feature_id").where("value is not null").groupBy("value").agg(F.min("feature_id").alias("first"))
    return found.orderBy("first", "value").limit(limit).select("value")


def adaptive_cells(df: DataFrame, max_rows_per_cell: int, max_depth: int = 5, box: tuple[float, float, float, float] = (-180.0, -90.0, 180.0, 90.0)) -> DataFrame:
    """Adds cell: the quadkey of the largest tile around the point with at most max_rows_per_cell rows, or of max_depth.

    Rows are counted once, at full depth; coarser counts add up from these few
    rows. At most 4^max_depth tiles meet the rows again, broadcast while that is
    under a hundred thousand.
    """
    if not 1 <= max_depth <= 12:
        raise ValueError("adaptive_cells: depth must be 1 to 12")
    x0, y0, x1, y1 = box
    side = 1 << max_depth
    column = F.least(F.lit(side - 1), F.greatest(F.lit(0), F.floor((F.col("lon") - x0) / (x1 - x0) * side))).cast("int")
    row = F.least(F.lit(side - 1), F.greatest(F.lit(0), F.floor((F.col("lat") - y0) / (y1 - y0) * side))).cast("int")
    digits = [(F.shiftright(column, d).bitwiseAND(1) + 2 * F.shiftright(row, d).bitwiseAND(1)).cast("string") for d in range(max_depth - 1, -1, -1)]
    keyed = df.withColumn("_deep", F.concat(*digits))
    counts = keyed.groupBy("_deep").agg(F.count("*").alias("n"))
    levels = counts.select("_deep", "n", F.explode(F.sequence(F.lit(0), F.lit(max_depth))).alias("depth")).withColumn("tile", F.expr("substring(_deep, 1, depth)"))
    sizes = levels.groupBy("tile", "depth").agg(F.sum("n").alias("size")).where((F.col("size") <= max_rows_per_cell) | (F.col("depth") == max_depth))
    chosen = levels.join(sizes, ["tile", "depth"]).groupBy("_deep").agg(F.min_by("tile", "depth").alias("cell"))
    return keyed.join(F.broadcast(chosen) if max_depth <= 8 else chosen, "_deep").drop("_deep")


