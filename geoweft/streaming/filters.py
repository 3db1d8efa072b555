"""The row-wise operators on streams.

within_geometry, attribute_filter (but for fuzzy_contains) and temporal_filter
keep no state and start no job, so they run on readStream as they are.
latest_fix keeps one row an entity in the state store.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from geoweft.operators.filters import attribute_filter, temporal_filter, within_geometry

__all__ = ["attribute_filter", "temporal_filter", "within_geometry", "latest_fix"]


def latest_fix(stream: DataFrame, entity: str, time: str, late: str = "10 minutes") -> DataFrame:
    """The newest row of each entity so far, for update or complete mode; rows later than the watermark may be dropped."""
    rows = stream.withWatermark(time, late)
    return rows.groupBy(entity).agg(F.max_by(F.struct(*stream.columns), time).alias("r")).select("r.*")
