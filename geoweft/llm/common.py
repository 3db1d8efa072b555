"""Small helpers shared by the corpus operators."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from geoweft.functions.names import free_name
from geoweft.session import shared_dir, staged, temporary

__all__ = ["shared_dir", "staged", "temporary", "table", "text_slices", "shuffle_partitions", "free_name", "numbered", "looked_up"]

HOT = 500


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table of whole texts. Python gets it a thousand rows at a time, whatever their length."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "1000")
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def numbered(docs: DataFrame, wanted: str) -> tuple[DataFrame, str]:
    """docs, stored with a number for each row, and that column's name.

    Rows get their numbers once, with their texts: what is read again later,
    by whatever splits, goes by the same numbers.
    """
    key = free_name(docs, wanted)
    return staged(docs.withColumn(key, F.monotonically_increasing_id()), "numbered", compression="zstd"), key


def looked_up(rows: DataFrame, lookup: DataFrame, keys: list[str], times: str, total: int) -> DataFrame:
    """rows joined to lookup, which is stored, has a row for each of its keys, and in times how many rows need it.

    Keys of over one in HOT of total are at most HOT; these are joined by
    broadcast and no task gets all their rows. The others are shuffled.
    """
    hot = F.broadcast(lookup.where(F.col(times) > total // HOT).drop(times))
    usual = lookup.where(F.col(times) <= total // HOT).drop(times)
    return rows.join(hot, keys).unionByName(rows.join(hot, keys, "left_anti").join(usual, keys))


def text_slices(batches: Iterator[pa.RecordBatch], text: int = 1, most_bytes: int = 1 << 20) -> Iterator[pa.RecordBatch]:
    """Cuts record batches so that the texts of one slice hold about most_bytes, or one row."""
    for batch in batches:
        column, start, held = batch.column(text), 0, 0
        sizes = pa.compute.fill_null(pa.compute.binary_length(column), 0).to_pylist()
        for i, size in enumerate(sizes):
            if held and held + size > most_bytes:
                yield batch.slice(start, i - start)
                start, held = i, 0
            held += size
        if start < batch.num_rows:
            yield batch.slice(start)
