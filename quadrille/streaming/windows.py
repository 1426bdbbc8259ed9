"""Streams of boxes: selection by a fixed window, join with a still table, counts by event time."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import shapes as S
from ..operators import join, select


def intersecting(stream: DataFrame, shape: S.Shape) -> DataFrame:
    """Needs no state."""
    return select.intersecting(stream, shape)


def join_static(stream: DataFrame, table: DataFrame, g: float, levels: int = 4) -> DataFrame:
    """Pairs of a stream's boxes with a still table's; g is given, since a stream has no extents. Large boxes go to coarser levels."""
    return join.grid_join(stream, table, g=g, levels=levels)


def counts_by_time(stream: DataFrame, time: str, window: str, late: str) -> DataFrame:
    """Boxes by window of event time; rows later than the watermark are dropped."""
    return stream.withWatermark(time, late).groupBy(F.window(time, window)).agg(F.count("*").alias("rows"))
