"""Layers derived from the relational test tables by integer arithmetic and one division."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from geoweft.functions.geometry import BOXES, LINES, box_geometry, line_geometry

#: SQL text of each layer, the same for Spark and for a check in another engine ({micros}: microseconds of ts since 1970).
SQL = {
    "places": "SELECT c_custkey AS feature_id, c_name, c_mktsegment, c_acctbal, c_nationkey, cast(3470000 + (cast(c_custkey AS bigint) * 7919) % 20000 AS double) / 100000 AS lon, cast(3200000 + (cast(c_custkey AS bigint) * 104729) % 20000 AS double) / 100000 AS lat FROM customer",
    "hubs": "SELECT s_suppkey AS target_id, s_name, cast(3470000 + (cast(s_suppkey AS bigint) * s_suppkey * 17 + cast(s_suppkey AS bigint) * 6151) % 20000 AS double) / 100000 AS lon, cast(3200000 + (cast(s_suppkey AS bigint) * s_suppkey * 29 + cast(s_suppkey AS bigint) * 3571) % 20000 AS double) / 100000 AS lat FROM supplier",
    "incidents": "SELECT o_orderkey AS feature_id, o_orderdate, o_orderstatus, cast(3470000 + (cast(o_custkey AS bigint) * 7919) % 20000 + (o_orderkey % 37) * 5 AS double) / 100000 AS lon, cast(3200000 + (cast(o_custkey AS bigint) * 104729) % 20000 + (o_orderkey % 41) * 5 AS double) / 100000 AS lat FROM orders",
    "tracks": "SELECT event_id AS feature_id, user_id AS net_id, ts AS event_time, cast(3470000 + (u * 7919) % 20000 + (u % 3 - 1) * h * 10 + event_id % 7 AS double) / 100000 AS lon, cast(3200000 + (u * 104729) % 20000 + (u % 5 - 2) * h * 10 + event_id % 11 AS double) / 100000 AS lat FROM (SELECT *, cast(user_id AS bigint) AS u, cast(floor(({micros} - 1704067200000000) / 3600000000.0) AS bigint) AS h FROM events) e",
}
MICROS = {"spark": "unix_micros(cast(ts AS timestamp))", "duckdb": "epoch_us(ts)"}
TABLES = {"places": "customer", "hubs": "supplier", "incidents": "orders", "tracks": "events"}


def layer(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A point layer over one of the tables."""
    query = SQL[name].format(micros=MICROS["spark"])
    return spark.sql(query.replace(f"FROM {TABLES[name]}", "FROM {t}"), t=spark.read.parquet(f"{sf_dir}/{TABLES[name]}.parquet"))


def layer_sql(name: str) -> str:
    return SQL[name].format(micros=MICROS["duckdb"])


def tiles(spark: SparkSession, sf_dir: str, key: str = "feature_id") -> DataFrame:
    """A square of 0.04 degrees for each nation; neighbours share edges exactly."""
    k = F.col("n_nationkey").cast("long")
    x, y = 3470000 + (k % 5) * 4000, 3200000 + F.floor(k / 5) * 4000
    degrees = lambda c: c.cast("double") / 100000
    nation = spark.read.parquet(f"{sf_dir}/nation.parquet")
    return nation.select(F.col("n_nationkey").alias(key), "n_name", box_geometry(degrees(x), degrees(y), degrees(x + 4000), degrees(y + 4000)).alias("geom", metadata=BOXES))


def parcels(spark: SparkSession, sf_dir: str, key: str = "feature_id") -> DataFrame:
    """A square of 0.0016 degrees for each customer, a hundred and twenty-five to a row; neighbours share edges exactly."""
    k = F.col("c_custkey").cast("long")
    x, y = 3470000 + (k % 125) * 160, 3200000 + F.floor(k / 125) * 160
    degrees = lambda c: c.cast("double") / 100000
    customer = spark.read.parquet(f"{sf_dir}/customer.parquet")
    return customer.select(k.alias(key), "c_mktsegment", box_geometry(degrees(x), degrees(y), degrees(x + 160), degrees(y + 160)).alias("geom", metadata=BOXES))


def roads(spark: SparkSession, sf_dir: str, key: str = "feature_id") -> DataFrame:
    """A segment from each hub to the next."""
    hubs = layer(spark, sf_dir, "hubs").select("target_id", "lon", "lat")
    following = hubs.select((F.col("target_id") - 1).alias("target_id"), F.col("lon").alias("lon2"), F.col("lat").alias("lat2"))
    joined = hubs.join(following, "target_id")
    return joined.select(F.col("target_id").alias(key), line_geometry(F.col("lon"), F.col("lat"), F.col("lon2"), F.col("lat2")).alias("geom", metadata=LINES))
