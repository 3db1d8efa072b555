"""The layer catalog as a DataFrame: reading, URL parts, merging, editing."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from geoweft.functions.text import clean_tags

CATALOG = "id string, name string, description string, tags array<string>, provider string, source_url string"
#: Path segments of catalog URLs that aren't ids, and limits of remote layers.
NOT_IDS = ("entities", "layers", "cube", "v1", "db")
MODES = ("auto", "match_not", "legacy")
MOST_NAME, MOST_DESCRIPTION, MOST_TAGS = 200, 2000, 20


def catalog(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(CATALOG).parquet(path)


def queryable(layers: DataFrame, providers: list[str]) -> DataFrame:
    return layers.where(F.col("provider").isin(providers))


def catalog_parts(layers: DataFrame, reserved: tuple[str, ...] = NOT_IDS) -> DataFrame:
    """Adds layer_id (last segment of the URL that isn't reserved), query_mode, parameters, temporal_field."""
    url = F.trim("source_url")
    path = F.regexp_replace(F.regexp_replace(url, r"[?#].*$", ""), r"^[A-Za-z][A-Za-z0-9+.-]*:", "")
    segments = F.filter(F.split(path, "/"), lambda s: (s != "") & ~F.lower(s).isin(*reserved))
    query = F.regexp_extract(url, r"\?([^#]*)", 1)
    pairs = F.filter(F.transform(F.split(query, "&"), lambda p: F.struct(F.try_url_decode(F.substring_index(p, "=", 1)).alias("k"), F.try_url_decode(F.when(p.contains("="), F.regexp_extract(p, r"=(.*)$", 1))).alias("v"))), lambda p: F.coalesce(p["v"], F.lit("")) != "")
    modes = F.filter(pairs, lambda p: p["k"] == "query_mode")
    first_mode = F.get(modes, F.lit(0))["v"]
    named = F.transform(F.filter(pairs, lambda p: p["k"].startswith("param_")), lambda p: F.struct(F.substring(p["k"], 7, 1 << 20).alias("k"), p["v"].alias("v")))
    keys = F.array_distinct(F.transform(named, lambda p: p["k"]))
    parameters = F.map_from_arrays(keys, F.transform(keys, lambda k: F.get(F.filter(named, lambda p: p["k"] == k), F.lit(0))["v"]))
    told = F.filter(F.coalesce("tags", F.array().cast("array<string>")), lambda t: (t == "no_temporal_field") | t.startswith("temporal_field:"))
    tag = F.get(told, F.lit(0))
    field = F.when(tag.isNull(), "date").when(tag == "no_temporal_field", None).otherwise(F.trim(F.regexp_replace(tag, "^temporal_field:", "")))
    return layers.select(
        "*",
        F.try_element_at(segments, F.lit(-1)).alias("layer_id"),
        F.when(first_mode.isin(*MODES), first_mode).otherwise("auto").alias("query_mode"),
        parameters.alias("parameters"),
        F.when(field != "", field).alias("temporal_field"),
    )


def normalize_remote_layers(raw: DataFrame, provider: str = "remote", order: str | None = None, unnamed: str = "layer ") -> tuple[DataFrame, DataFrame]:
    """(layers, skipped): remote layers under their many key spellings, the first of each id; skipped has one count.

    raw has any of the id, name, description and tag columns, exclusive_id.id, and an order column for first.
    """

    def first(*names: str):
        there = [F.when(F.col(n).cast("string") != "", F.col(n).cast("string")) for n in names if n in raw.columns]
        return F.coalesce(*there, F.lit(None).cast("string"))

    number = first("id", "layerId", "layer_id", "Id")
    if "exclusive_id" in raw.columns:
        number = F.coalesce(number, F.col("exclusive_id.id").cast("string"))
    tags = next((F.col(n) if raw.schema[n].dataType.simpleString().startswith("array") else F.array(F.col(n)) for n in ("tags", "category", "group") if n in raw.columns), F.array().cast("array<string>"))
    ident = F.trim(number)
    name, description = F.trim(first("display_name", "name", "title", "alias", "Name")), F.trim(first("unclassified_description", "description", "comments", "Description"))
    rows = raw.select(
        ident.alias("remote_id"),
        F.substring(F.coalesce(name, F.concat(F.lit(unnamed), ident)), 1, MOST_NAME).alias("name"),
        F.substring(F.coalesce(description, F.lit("")), 1, MOST_DESCRIPTION).alias("description"),
        clean_tags(tags, max_n=MOST_TAGS).alias("tags"),
        F.lit(provider).alias("provider"),
        F.concat(F.lit(f"{provider}://layer/"), ident).alias("source_url"),
        (F.col(order) if order else F.monotonically_increasing_id()).alias("_order"),
    )
    good = F.coalesce(F.col("remote_id") != "", F.lit(False))
    firsts = rows.where(good).groupBy("remote_id").agg(F.min_by(F.struct(*rows.columns), "_order").alias("r")).select("r.*").drop("_order")
    counts = rows.agg((F.count("*") - F.count_distinct(F.when(good, F.col("remote_id")))).alias("skipped"))
    return firsts, counts


def catalog_merge(layers: DataFrame, remote: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(merged, counts) keyed on (provider, source_url): remote names and descriptions win, ids and tags stay, new layers
    come in with an id made of their key; counts: added, updated, kept."""
    a = layers.select(*[F.col(c).alias(f"a_{c}") for c in layers.columns])
    b = remote.select(*[F.col(c).alias(f"b_{c}") for c in ("name", "description", "tags", "provider", "source_url")])
    both = a.join(b, (F.col("a_provider") == F.col("b_provider")) & (F.col("a_source_url") == F.col("b_source_url")), "full_outer")
    new = F.col("a_id").isNull()
    made = F.substring(F.sha2(F.concat_ws("\n", "b_provider", "b_source_url"), 256), 1, 32)
    merged = both.select(
        F.coalesce("a_id", made).alias("id"),
        F.coalesce("b_name", "a_name").alias("name"),
        F.coalesce("b_description", "a_description").alias("description"),
        F.when(new, F.col("b_tags")).otherwise(F.col("a_tags")).alias("tags"),
        F.coalesce("a_provider", "b_provider").alias("provider"),
        F.coalesce("a_source_url", "b_source_url").alias("source_url"),
    )
    counts = both.agg(
        F.sum(new.cast("long")).alias("added"),
        F.sum((~new & F.col("b_provider").isNotNull()).cast("long")).alias("updated"),
        F.sum(F.col("b_provider").isNull().cast("long")).alias("kept"),
    )
    return merged, counts


def catalog_update(layers: DataFrame, updates: DataFrame) -> DataFrame:
    """Name, description and tags by id where the update has them; provider and URL stay."""
    new = updates.select(F.col("id").alias("_id"), F.col("name").alias("_name"), F.col("description").alias("_description"), F.col("tags").alias("_tags"))
    joined = layers.join(new, F.col("id") == F.col("_id"), "left")
    return joined.select("id", F.coalesce(F.trim("_name"), "name").alias("name"), F.coalesce(F.trim("_description"), "description").alias("description"), F.coalesce(clean_tags_or_null("_tags"), F.col("tags")).alias("tags"), "provider", "source_url")


def clean_tags_or_null(column: str):
    return F.when(F.col(column).isNotNull(), clean_tags(F.col(column)))


def catalog_insert(layers: DataFrame, rows: DataFrame) -> DataFrame:
    """The rows added, their texts trimmed and tags cleaned."""
    texts = [F.trim(c).alias(c) for c in ("name", "description", "provider", "source_url")]
    made = F.substring(F.sha2(F.concat_ws("\n", F.trim("provider"), F.trim("source_url")), 256), 1, 32).alias("id")
    return layers.unionByName(rows.select(made, *texts, clean_tags(F.col("tags")).alias("tags")))

