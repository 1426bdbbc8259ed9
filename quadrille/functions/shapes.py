"""Plane shapes whose coordinates are Columns, and predicates and measures between them.

Coordinates are plain double columns, so comparisons reach the Parquet scan and run in
generated code. Boxes are closed. Pairs for which nothing is defined raise
NotImplementedError. Boxes of any dimension are pairs of arrays (the ``*_nd`` functions).
"""

from __future__ import annotations

import math
from dataclasses import dataclass, fields

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed value: the tolerance of equality, of 64-bit floating point.
EPSILON = 2.220446049250313e-16


def _column(x: Column | float | str) -> Column:
    return F.col(x) if isinstance(x, str) else x if isinstance(x, Column) else F.lit(float(x))


def near(a: Column, b: Column) -> Column:
    return F.abs(a - b) <= F.lit(EPSILON)


def _all(*terms: Column) -> Column:
    out = terms[0]
    for t in terms[1:]:
        out = out & t
    return out


@dataclass
class Shape:
    """Coordinates may be given as Columns, column names or numbers."""

    def __post_init__(self) -> None:
        for f in fields(self):
            setattr(self, f.name, _column(getattr(self, f.name)))

    @classmethod
    def of(cls, alias: str | None = None, **names: str):
        """The shape in columns named as its coordinates, of an aliased table."""
        prefix = f"{alias}." if alias else ""
        return cls(*(F.col(prefix + names.get(f.name, f.name)) for f in fields(cls)))


@dataclass
class Region(Shape):
    xlo: Column
    ylo: Column
    xhi: Column
    yhi: Column


@dataclass
class Point(Shape):
    x: Column
    y: Column


@dataclass
class Segment(Shape):
    x1: Column
    y1: Column
    x2: Column
    y2: Column

    @property
    def ends(self) -> tuple[Point, Point]:
        return Point(self.x1, self.y1), Point(self.x2, self.y2)


@dataclass
class Ball(Shape):
    cx: Column
    cy: Column
    r: Column

    @property
    def middle(self) -> Point:
        return Point(self.cx, self.cy)


def _no(what: str, a: Shape, b: Shape):
    raise NotImplementedError(f"{what} of {type(a).__name__} and {type(b).__name__}")


def dimension(shape: Shape) -> Column:
    return F.lit(2)


def mbr(s: Shape) -> Region:
    """Smallest box around a shape."""
    match s:
        case Region():
            return s
        case Point():
            return Region(s.x, s.y, s.x, s.y)
        case Segment():
            return Region(F.least(s.x1, s.x2), F.least(s.y1, s.y2), F.greatest(s.x1, s.x2), F.greatest(s.y1, s.y2))
        case Ball():
            return Region(s.cx - s.r, s.cy - s.r, s.cx + s.r, s.cy + s.r)


def area(s: Shape) -> Column:
    match s:
        case Region():
            return (s.xhi - s.xlo) * (s.yhi - s.ylo)
        case Ball():
            return F.lit(math.pi) * s.r * s.r
    return F.lit(0.0)


def ball_volume(r: Column, dim: int, compat: bool = False) -> Column:
    """Volume of a ball of any dimension; compat halves odd dimensions as whole numbers do."""
    half = dim // 2 if compat else dim / 2
    return F.lit(math.pi**half / math.gamma(half + 1)) * F.pow(r, F.lit(dim))


def center(s: Shape) -> Point:
    match s:
        case Point():
            return s
        case Ball():
            return s.middle
    b = mbr(s)
    return Point((b.xlo + b.xhi) / 2, (b.ylo + b.yhi) / 2)


def margin(b: Region) -> Column:
    """Sum of the extents times 2 to the power of the dimension less one."""
    return ((b.xhi - b.xlo) + (b.yhi - b.ylo)) * 2


def clip(a: Region, b: Region) -> Region:
    """Common box; null where the boxes are apart."""
    hit = intersects(a, b)
    sides = F.greatest(a.xlo, b.xlo), F.greatest(a.ylo, b.ylo), F.least(a.xhi, b.xhi), F.least(a.yhi, b.yhi)
    return Region(*(F.when(hit, s) for s in sides))


def clip_area(a: Region, b: Region) -> Column:
    return F.coalesce(area(clip(a, b)), F.lit(0.0))


def union(a: Region, b: Region) -> Region:
    return Region(F.least(a.xlo, b.xlo), F.least(a.ylo, b.ylo), F.greatest(a.xhi, b.xhi), F.greatest(a.yhi, b.yhi))


def _turn(ax: Column, ay: Column, bx: Column, by: Column, cx: Column, cy: Column) -> Column:
    """Twice the signed area of a triangle: positive if c is on the left of a to b."""
    return (bx - ax) * (cy - ay) - (cx - ax) * (by - ay)


def _cross(s: Segment, t: Segment) -> Column:
    """Whether two segments share a point, ends included."""
    a = _turn(s.x1, s.y1, s.x2, s.y2, t.x1, t.y1)
    b = _turn(s.x1, s.y1, s.x2, s.y2, t.x2, t.y2)
    c = _turn(t.x1, t.y1, t.x2, t.y2, s.x1, s.y1)
    d = _turn(t.x1, t.y1, t.x2, t.y2, s.x2, s.y2)
    proper = ((a > 0) != (b > 0)) & ((c > 0) != (d > 0)) & (a != 0) & (b != 0) & (c != 0) & (d != 0)

    def on(turn: Column, x: Column, y: Column, s: Segment) -> Column:
        box = mbr(s)
        return (turn == 0) & x.between(box.xlo, box.xhi) & y.between(box.ylo, box.yhi)

    return proper | on(a, t.x1, t.y1, s) | on(b, t.x2, t.y2, s) | on(c, s.x1, s.y1, t) | on(d, s.x2, s.y2, t)


def intersects(a: Shape, b: Shape) -> Column:
    match a, b:
        case Region(), Region():
            return _all(a.xlo <= b.xhi, a.xhi >= b.xlo, a.ylo <= b.yhi, a.yhi >= b.ylo)
        case (Region(), Point()) | (Point(), Region()):
            box, p = (a, b) if isinstance(a, Region) else (b, a)
            return contains(box, p)
        case (Region(), Segment()) | (Segment(), Region()):
            box, s = (a, b) if isinstance(a, Region) else (b, a)
            corners = [(box.xlo, box.ylo), (box.xhi, box.ylo), (box.xhi, box.yhi), (box.xlo, box.yhi)]
            out = contains(box, s.ends[0]) | contains(box, s.ends[1])
            for p, q in zip(corners, corners[1:] + corners[:1], strict=True):
                out = out | _cross(s, Segment(*p, *q))
            return out
        case Segment(), Segment():
            return _cross(a, b)
        case Ball(), _:
            return distance(a.middle, b) <= a.r if not isinstance(b, (Segment, Ball)) else distance(b, a.middle) <= a.r
    _no("intersection", a, b)


def contains(a: Shape, b: Shape, compat: bool = False) -> Column:
    """Whether a holds all of b; compat keeps two known slips of balls (dimension for radius, radius taken twice)."""
    match a, b:
        case Region(), Region():
            return _all(a.xlo <= b.xlo, a.xhi >= b.xhi, a.ylo <= b.ylo, a.yhi >= b.yhi)
        case Region(), Point():
            return _all(b.x >= a.xlo, b.x <= a.xhi, b.y >= a.ylo, b.y <= a.yhi)
        case (Point() | Segment()), _:
            return F.lit(False)
        case Ball(), Point():
            return distance(a.middle, b) <= (F.lit(2.0) if compat else a.r)
        case Ball(), Segment():
            return contains(a, b.ends[0], compat) & contains(a, b.ends[1], compat)
        case Ball(), Region():
            dx = F.greatest(F.abs(a.cx - b.xlo), F.abs(a.cx - b.xhi))
            dy = F.greatest(F.abs(a.cy - b.ylo), F.abs(a.cy - b.yhi))
            return F.sqrt(dx * dx + dy * dy) <= a.r
        case Ball(), Ball():
            apart = distance(a.middle, b.middle)
            return F.greatest(apart - a.r, F.lit(0.0)) <= a.r - b.r if compat else apart <= a.r - b.r
    _no("containment", a, b)


def touches(a: Shape, b: Shape) -> Column:
    """Boxes: some axis on which low sides or high sides coincide. Balls: the distance is the radius."""
    match a, b:
        case Region(), Region():
            return near(a.xlo, b.xlo) | near(a.xhi, b.xhi) | near(a.ylo, b.ylo) | near(a.yhi, b.yhi)
        case (Region(), Point()) | (Point(), Region()):
            box, p = (a, b) if isinstance(a, Region) else (b, a)
            return near(box.xlo, p.x) | near(box.xhi, p.x) | near(box.ylo, p.y) | near(box.yhi, p.y)
        case Point(), Point():
            return equal(a, b)
        case Ball(), (Point() | Region()):
            return near(distance(a.middle, b), a.r)
        case Ball(), (Segment() | Ball()):
            return near(distance(b, a.middle), a.r)
    _no("touching", a, b)


shares_boundary = touches


def equal(a: Shape, b: Shape) -> Column:
    if type(a) is not type(b):
        _no("equality", a, b)
    return _all(*(near(x, y) for x, y in zip(astuple_columns(a), astuple_columns(b), strict=True)))


def astuple_columns(s: Shape) -> tuple[Column, ...]:
    return tuple(getattr(s, f.name) for f in fields(s))


def distance(a: Shape, b: Shape) -> Column:
    """Euclidean distance, 0 when they overlap; of a segment and a point, that to the whole line."""
    match a, b:
        case Region(), Region():
            dx = F.greatest(a.xlo - b.xhi, b.xlo - a.xhi, F.lit(0.0))
            dy = F.greatest(a.ylo - b.yhi, b.ylo - a.yhi, F.lit(0.0))
            return F.sqrt(dx * dx + dy * dy)
        case (Region(), Point()) | (Point(), Region()):
            box, p = (a, b) if isinstance(a, Region) else (b, a)
            return distance(box, mbr(p))
        case Point(), Point():
            return F.sqrt((a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y))
        case (Segment(), Point()) | (Point(), Segment()):
            s, p = (a, b) if isinstance(a, Segment) else (b, a)
            return line_distance(s, p)
        case (Ball(), _) | (_, Ball()):
            ball, other = (a, b) if isinstance(a, Ball) else (b, a)
            if isinstance(other, Ball):
                return F.greatest(F.greatest(distance(ball.middle, other.middle) - other.r, F.lit(0.0)) - ball.r, F.lit(0.0))
            return F.greatest(distance(other, ball.middle) - ball.r, F.lit(0.0))
    _no("distance", a, b)


def line_distance(s: Segment, p: Point) -> Column:
    """Distance of a point to the infinite line through a segment."""
    return F.abs(signed_line_distance(s, p))


def signed_line_distance(s: Segment, p: Point) -> Column:
    """Distance to the line, positive to the left of the direction of travel.

    The area that the segment and the point span, over the segment's length. A segment of no
    length counts as an upright line.
    """
    along = Point(s.x2 - s.x1, s.y2 - s.y1)
    length = F.hypot(along.x, along.y)
    spanned = along.x * (p.y - s.y1) - along.y * (p.x - s.x1)
    return F.when(length > 0, spanned / length).otherwise(p.x - s.x1)


def farthest_line_distance(s: Segment, b: Region) -> Column:
    """Largest signed distance of the corners of a box."""
    corners = [Point(x, y) for x in (b.xlo, b.xhi) for y in (b.ylo, b.yhi)]
    return F.greatest(*(signed_line_distance(s, c) for c in corners))


def perpendicular_angle(s: Segment) -> Column:
    """Angle above minus and up to plus half pi of the ray across a segment: half pi if it is level."""
    run, rise = s.x1 - s.x2, s.y2 - s.y1
    return F.atan2(F.when(rise == 0, F.abs(run)).otherwise(run * F.signum(rise) + 0.0), F.abs(rise))


def intersects_nd(alo: Column, ahi: Column, blo: Column, bhi: Column) -> Column:
    return F.forall(F.zip_with(alo, bhi, lambda x, y: x <= y), lambda t: t) & F.forall(F.zip_with(ahi, blo, lambda x, y: x >= y), lambda t: t)


def contains_nd(alo: Column, ahi: Column, blo: Column, bhi: Column) -> Column:
    return F.forall(F.zip_with(alo, blo, lambda x, y: x <= y), lambda t: t) & F.forall(F.zip_with(ahi, bhi, lambda x, y: x >= y), lambda t: t)


def area_nd(lo: Column, hi: Column) -> Column:
    return F.aggregate(F.zip_with(lo, hi, lambda x, y: y - x), F.lit(1.0), lambda t, x: t * x)


def margin_nd(lo: Column, hi: Column) -> Column:
    return F.aggregate(F.zip_with(lo, hi, lambda x, y: y - x), F.lit(0.0), lambda t, x: t + x) * F.pow(F.lit(2.0), F.size(lo) - 1)


def coordinate(values: Column, place: int) -> Column:
    """One coordinate, from 0; a place out of bounds is an error."""
    return F.element_at(values, place + 1)


def infinite_box() -> Region:
    """The box that holds nothing: neutral for union."""
    return Region(float("inf"), float("inf"), float("-inf"), float("-inf"))
