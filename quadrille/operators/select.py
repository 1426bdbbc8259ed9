"""Selections by shape, nearest neighbours, paging and result shapes."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import moving as M
from ..functions import shapes as S
from ..functions import temporal as T
from .join import left


def intersecting(t: DataFrame, shape: S.Shape) -> DataFrame:
    """Rows whose box meets the shape; box comparisons also reach the scan."""
    box = left()
    found = t.where(S.intersects(box, S.mbr(shape)))
    if isinstance(shape, S.Region):
        return found
    return found.where(S.intersects(shape, box))


def contained(t: DataFrame, shape: S.Shape) -> DataFrame:
    """Rows whose box lies in the shape; points and segments hold nothing."""
    return t.where(S.contains(S.mbr(shape), left()) & S.contains(shape, left()))


def at_point(t: DataFrame, x: float, y: float) -> DataFrame:
    return intersecting(t, S.Point(x, y))


def nearest(t: DataFrame, shape: S.Shape, k: int, distance: Column | None = None) -> DataFrame:
    """The k rows nearest to a shape with all ties at the k-th distance; none for k = 0.

    Two passes over the rows and no sort of all: the k-th distance by a top-k, then a filter.
    """
    d = distance if distance is not None else S.distance(shape, left())
    ranked = t.withColumn("distance", d)
    if k <= 0:
        return ranked.limit(0)
    edge = ranked.select("distance").orderBy("distance").limit(k).agg(F.max("distance").alias("__edge"))
    return ranked.crossJoin(F.broadcast(edge)).where(F.col("distance") <= F.col("__edge")).drop("__edge")


def page(t: DataFrame, start: int, limit: int, *order: str) -> DataFrame:
    """Rows start to start + limit - 1 in order of id; limit 0 gives all."""
    if not limit:
        return t
    return t.orderBy(*(order or ("id",))).offset(start).limit(limit)


def ids(t: DataFrame) -> DataFrame:
    return t.select("id")


def count(t: DataFrame) -> DataFrame:
    return t.agg(F.count("*").alias("rows"))


def in_time(t: DataFrame, shape: S.Shape, span: T.Span, own: S.Shape | None = None) -> DataFrame:
    """Rows of a table with t0 and t1 that meet a shape in space and a period strictly."""
    own = own or left()
    return t.where(T.intersects_in_time(shape, span, own, T.Span("t0", "t1")))


def covered_in_time(t: DataFrame, shape: S.Shape, span: T.Span, own: S.Shape | None = None) -> DataFrame:
    return t.where(T.contains_in_time(shape, span, own or left(), T.Span("t0", "t1")))


def moving_in_time(t: DataFrame, box: S.Region, span: T.Span, point: bool = False) -> DataFrame:
    """Moving rows that meet a fixed box within a period, with when they do."""
    own = M.Moving.point() if point else M.Moving.box()
    return t.withColumn("meets", M.intersects_during(M.Moving.fixed(box, span), own)).where("meets.hit")


def visit(t: DataFrame, visitor: Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]], schema: str) -> DataFrame:
    """A user's function over the rows found, by Arrow batches."""
    return t.mapInPandas(visitor, schema)


def snapshot(t: DataFrame, at: float, point: bool = False) -> DataFrame:
    """Places at a time, held within each row's period."""
    box = (M.Moving.point() if point else M.Moving.box()).box_at(at)
    if point:
        return t.select("id", box.xlo.alias("x"), box.ylo.alias("y"))
    return t.select("id", box.xlo.alias("xlo"), box.ylo.alias("ylo"), box.xhi.alias("xhi"), box.yhi.alias("yhi"))
