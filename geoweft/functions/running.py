"""Running totals over any number of rows without a one-task window."""

from __future__ import annotations

from itertools import pairwise

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from geoweft.session import staged


def range_numbered(df: DataFrame, order: list[str], ranges: int, out: str, name: str) -> DataFrame:
    """df, stored in at most so many ranges of the order columns together; ``out`` is a row's range.

    Ranges are cut by all order columns, so many rows of one first value, or
    without one, are dealt out like others. Equal rows share a range.
    """
    return staged(df.repartitionByRange(ranges, *order).withColumn(out, F.spark_partition_id()), name)


def order_buckets(df: DataFrame, column: str, buckets: int) -> list[float]:
    """At most ``buckets`` - 1 split points that deal the values of a numeric
    column into ranges of about equal size. Only these numbers reach the driver.
    The error is a quarter of a range, down to a hundred-thousandth of the rows.
    A whole number that fills a range and more gets one of its own."""
    steps = [i / buckets for i in range(1, buckets)]
    found = df.stat.approxQuantile(column, steps, max(1e-5, 1 / (4 * buckets))) if steps else []
    return sorted({*found, *(x - 1 for x, y in pairwise(found) if x == y)})


def bucket_of(column: Column, splits: list[float]) -> Column:
    """Number of split points below the value: a monotone bucket number; null goes to -1.

    A binary search over a constant array, so a row costs log(buckets) steps.
    """
    if not splits:
        return F.when(column.isNull(), F.lit(-1)).otherwise(F.lit(0))
    depth = len(splits).bit_length()
    beyond = (1 << 63) - 1
    # One literal, however many splits: the optimiser folds it into a constant.
    edges = F.split(F.lit(",".join(str(int(x)) for x in splits + [beyond] * ((1 << depth) - len(splits)))), ",").cast("array<bigint>")
    steps = F.array(*[F.lit(1 << k) for k in range(depth - 1, -1, -1)])
    found = F.aggregate(steps, F.lit(0), lambda at, step: F.when(F.get(edges, at + step - 1) < column, at + step).otherwise(at))
    return F.when(column.isNull(), F.lit(-1)).otherwise(found)


def running_total(df: DataFrame, value: str, order: list[str], bucket: str, out: str, by: list[str] | None = None) -> DataFrame:
    """Adds ``out``: the sum of ``value`` over the rows before, in ``order`` within ``by``.

    ``bucket`` is a column that rises with the first order column. Rows are
    summed per bucket first; only the bucket sums meet in one window, and the
    rows of one bucket in another, so no task sees more than a bucket.
    Equal order keys are told apart by no rule of this function: give a
    complete order.
    """
    by = by or []
    keys = [*by, bucket]
    sums = df.groupBy(*keys).agg(F.sum(value).alias("_sum"))
    across = Window.partitionBy(*by) if by else Window.partitionBy(F.lit(0))
    sums = sums.withColumn("_base", F.sum("_sum").over(across.orderBy(bucket)) - F.col("_sum")).drop("_sum")
    same = [df[k].eqNullSafe(sums[k]) for k in keys]
    joined = df.join(sums, on=[*same], how="inner").drop(*[sums[k] for k in keys])
    within = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return joined.withColumn(out, (F.sum(value).over(within) - F.col(value) + F.col("_base")).cast("long")).drop("_base")
