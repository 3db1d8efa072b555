"""Layer profiles: inferred fields, property profiles, schema merge, samples."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Names that are times whatever they hold, the best first.
TIME_FIELDS = ("eventTime", "arriveTime", "timestamp", "time", "datetime")
SAMPLES, SAMPLE_CHARS, PROPERTY_CHARS = 5, 80, 40
ISO = r"^\s*\d{4}-?\d{2}-?\d{2}T\d{2}(:?\d{2}(:?\d{2}([.,]\d+)?)?)?(Z|[+-]\d{2}:?\d{2})?\s*$"
NUMBER = r"^\s*[-+]?(\d+\.?\d*|\.\d+)([eE][-+]?\d+)?\s*$"
PROFILE = "name string, type string, samples array<string>"


def _long(df: DataFrame, fields: list[str]) -> DataFrame:
    """(feature_id, place, name, kind, value): a row for each field of each row; kind is what the column's type says."""

    def kind(c: str) -> str:
        t = df.schema[c].dataType.simpleString()
        return "boolean" if t == "boolean" else "date" if t.startswith(("timestamp", "date")) else "number" if t in ("tinyint", "smallint", "int", "bigint", "float", "double") or t.startswith("decimal") else "string"

    cells = F.array(*[F.struct(F.lit(k).alias("place"), F.lit(c).alias("name"), F.lit(kind(c)).alias("kind"), F.col(f"`{c}`").cast("string").alias("value")) for k, c in enumerate(fields)])
    return df.select("feature_id", F.explode(cells).alias("c")).select("feature_id", "c.*")


def _samples(long: DataFrame, most_chars: int) -> DataFrame:
    """(name, samples): the first distinct values by feature_id, at most five.

    Each distinct value keeps its first row. Of each of a thousand parts of a
    field five stay by a ranked window, which Spark cuts before its shuffle
    too, and of these few rows five.
    """
    distinct = long.where("value is not null").groupBy("name", F.substring("value", 1, most_chars).alias("sample")).agg(F.min("feature_id").alias("first"))
    parts = distinct.withColumn("part", F.pmod(F.xxhash64("sample"), F.lit(1000)))
    for keys in (["name", "part"], ["name"]):
        rank = F.row_number().over(Window.partitionBy(*keys).orderBy("first", "sample"))
        parts = parts.withColumn("rank", rank).where(F.col("rank") <= SAMPLES)
    listed = parts.groupBy("name").agg(F.array_sort(F.collect_list(F.struct("first", "sample"))).alias("s"))
    return listed.select("name", F.col("s.sample").alias("samples"))


def infer_schema(df: DataFrame, fields: list[str] | None = None) -> DataFrame:
    """(name, type, samples, temporal) by field: date for known names or any ISO moment, else boolean, number or string.

    temporal marks the layer's time field: the first known name, else the first date.
    """
    fields = fields or [c for c in df.columns if c not in ("feature_id", "geometry", "geom", "lon", "lat")]
    long = _long(df, fields)
    there = F.col("value").isNotNull()
    iso = (F.col("kind") == "string") & F.col("value").rlike(ISO)
    types = long.groupBy("place", "name").agg(
        F.max("kind").alias("kind"),
        F.coalesce(F.bool_or(F.when(there, iso)), F.lit(False)).alias("any_iso"),
        F.count_if(there).alias("n"),
    )
    date = F.col("name").isin(*TIME_FIELDS) | F.col("any_iso") | ((F.col("kind") == "date") & (F.col("n") > 0))
    kind = F.when(date, "date").when((F.col("n") > 0) & F.col("kind").isin("boolean", "number"), F.col("kind")).otherwise("string")
    typed = types.select("place", "name", kind.alias("type"))
    rank = F.coalesce(*[F.when(F.col("name") == n, F.lit(k)) for k, n in enumerate(TIME_FIELDS)], F.when(F.col("type") == "date", F.col("place") + len(TIME_FIELDS)))
    best = typed.agg(F.min_by("name", rank).alias("best"))  # one row over as many rows as fields
    out = typed.join(_samples(long, SAMPLE_CHARS), "name", "left").crossJoin(F.broadcast(best))
    return out.select("name", "type", F.coalesce("samples", F.array().cast("array<string>")).alias("samples"), F.coalesce(F.col("name") == F.col("best"), F.lit(False)).alias("temporal"))


def property_profile(df: DataFrame, properties: str = "properties") -> DataFrame:
    """(name, type, samples) of a map column: type by the first value, number or string; samples of 40 characters."""
    long = df.select("feature_id", F.explode(properties).alias("name", "value"))
    first = long.groupBy("name").agg(F.min_by("value", "feature_id").alias("v"))
    kind = F.when(F.col("v").rlike(NUMBER), "number").otherwise("string")
    return first.select("name", kind.alias("type")).join(_samples(long, PROPERTY_CHARS), "name", "left").select("name", "type", F.coalesce("samples", F.array().cast("array<string>")).alias("samples"))


def with_declared(df: DataFrame, declared: DataFrame) -> DataFrame:
    """(name, type, samples): declared fields (name, type) with samples of df, its other fields as strings."""
    found = infer_schema(df).select("name", F.lit("string").alias("type"), "samples")
    return merge_schema(declared, found)


def merge_schema(declared: DataFrame, sampled: DataFrame) -> DataFrame:
    """Declared types win and get the samples; fields that were only sampled follow."""
    b = sampled.select(F.col("name").alias("_name"), F.col("type").alias("_type"), "samples")
    both = declared.select("name", "type").join(b, F.col("name") == F.col("_name"), "full_outer")
    return both.select(F.coalesce("name", "_name").alias("name"), F.coalesce("type", "_type").alias("type"), F.coalesce("samples", F.array().cast("array<string>")).alias("samples"), F.col("name").isNotNull().alias("declared"))


def sample_payload(df: DataFrame, fields: list[str], seed: int = 0, most_rows: int = 10, most_fields: int = 20, most_chars: int = 200) -> DataFrame:
    """Random rows as JSON text of their first fields, names to 60 and values to 200 characters."""
    cells: list[Column] = [F.substring(F.col(f"`{c}`").cast("string"), 1, most_chars).alias(c[:60]) for c in fields[:most_fields]]
    return df.orderBy(F.rand(seed)).limit(most_rows).select(F.to_json(F.struct(*cells), {"ignoreNullFields": "false"}).alias("sample"))
