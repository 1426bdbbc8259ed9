"""Shapes with a time of validity, and intervals with open and closed ends."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import shapes as S


@dataclass
class Span:
    """A period from t0 to t1."""

    t0: Column
    t1: Column

    def __post_init__(self) -> None:
        self.t0, self.t1 = S._column(self.t0), S._column(self.t1)


def overlaps(a: Span, b: Span) -> Column:
    """Half-open overlap: periods that only meet don't, nor do empty ones."""
    return (a.t0 < b.t1) & (a.t1 > b.t0)


def covers(a: Span, b: Span) -> Column:
    return (a.t0 <= b.t0) & (a.t1 >= b.t1)


def intersects_in_time(a: S.Shape, sa: Span, b: S.Shape, sb: Span) -> Column:
    return overlaps(sa, sb) & S.intersects(a, b)


def contains_in_time(a: S.Shape, sa: Span, b: S.Shape, sb: Span, compat: bool = False) -> Column:
    """compat negates the test of time for points, a known slip."""
    return _timed(covers(sa, sb), b, compat) & S.contains(a, b)


def touches_in_time(a: S.Shape, sa: Span, b: S.Shape, sb: Span, compat: bool = False) -> Column:
    return _timed(overlaps(sa, sb), b, compat) & S.touches(a, b)


def _timed(test: Column, shape: S.Shape, compat: bool) -> Column:
    return ~test if compat and isinstance(shape, S.Point) else test


def equal_in_time(a: S.Shape, sa: Span, b: S.Shape, sb: Span) -> Column:
    return S.equal(a, b) & S.near(sa.t0, sb.t0) & S.near(sa.t1, sb.t1)


OPEN, CLOSED, LEFT_OPEN, RIGHT_OPEN = "open", "closed", "left_open", "right_open"


@dataclass
class Interval(Span):
    """A period whose column ``kind`` tells which ends belong to it; right_open by default."""

    kind: Column | str = RIGHT_OPEN

    def __post_init__(self) -> None:
        if isinstance(self.t0, (int, float)) and isinstance(self.t1, (int, float)) and self.t0 > self.t1:
            raise ValueError("an interval can't end before it starts")
        super().__post_init__()
        self.kind = F.lit(self.kind) if isinstance(self.kind, str) else self.kind

    @property
    def has_low(self) -> Column:
        return self.kind.isin(CLOSED, RIGHT_OPEN)

    @property
    def has_high(self) -> Column:
        return self.kind.isin(CLOSED, LEFT_OPEN)


def _holds(a: Interval, t: Column) -> Column:
    return ((a.t0 < t) | ((a.t0 == t) & a.has_low)) & ((t < a.t1) | ((t == a.t1) & a.has_high))


def intervals_intersect(a: Interval, b: Interval) -> Column:
    """Whether the later start comes before the earlier end, or both meet in a point that either interval holds."""
    start, end = F.greatest(a.t0, b.t0), F.least(a.t1, b.t1)
    return (start < end) | ((start == end) & _holds(a, start) & _holds(b, start))


def interval_contains(a: Interval, b: Interval) -> Column:
    low = (a.t0 < b.t0) | ((a.t0 == b.t0) & (a.has_low | ~b.has_low))
    high = (a.t1 > b.t1) | ((a.t1 == b.t1) & (a.has_high | ~b.has_high))
    return low & high


def interval_equal(a: Interval, b: Interval) -> Column:
    return (a.kind == b.kind) & S.near(a.t0, b.t0) & S.near(a.t1, b.t1)


