"""Linearly moving points and boxes, as Columns.

A moving thing is where its coordinates say at t0 and moves at constant speed until t1. For
the predicates over a period, side by side differences are linear in time, so each axis
narrows the period to the solution of two linear inequalities; boxes must not shrink.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import shapes as S
from .temporal import Span, covers


@dataclass
class Side:
    """One coordinate: its place at t0 and its speed."""

    at: Column
    v: Column


@dataclass
class Moving:
    """Low and high sides by axis; for a point they are the same."""

    low: list[Side]
    high: list[Side]
    span: Span

    @classmethod
    def box(cls, alias: str | None = None) -> Moving:
        c = _names(alias)
        return cls([Side(c("xlo"), c("vxlo")), Side(c("ylo"), c("vylo"))], [Side(c("xhi"), c("vxhi")), Side(c("yhi"), c("vyhi"))], Span(c("t0"), c("t1")))

    @classmethod
    def point(cls, alias: str | None = None) -> Moving:
        c = _names(alias)
        sides = [Side(c("x"), c("vx")), Side(c("y"), c("vy"))]
        return cls(sides, sides, Span(c("t0"), c("t1")))

    @classmethod
    def fixed(cls, box: S.Region, span: Span) -> Moving:
        zero = F.lit(0.0)
        return cls([Side(box.xlo, zero), Side(box.ylo, zero)], [Side(box.xhi, zero), Side(box.yhi, zero)], span)

    def extrapolated(self, s: Side, t: Column) -> Column:
        return s.at + s.v * (t - self.span.t0)

    def clamped(self, s: Side, t: Column) -> Column:
        """Place at t, which is held within the period."""
        return self.extrapolated(s, F.greatest(self.span.t0, F.least(self.span.t1, t)))

    def box_at(self, t: Column | float) -> S.Region:
        """Box at a time, held within the period."""
        t = S._column(t)
        return S.Region(*(self.clamped(s, t) for s in (*self.low, *self.high)))

    def velocity(self) -> S.Region:
        return S.Region(*(s.v for s in (*self.low, *self.high)))

    def shrinking(self) -> Column:
        return (self.high[0].v < self.low[0].v) | (self.high[1].v < self.low[1].v)


def _names(alias: str | None):
    return lambda name: F.col(f"{alias}.{name}" if alias else name)


def _alive(a: Moving, t: Column) -> Column:
    return (a.span.t0 <= t) & (t < a.span.t1)


def _boxes(a: Moving, b: Moving, t: Column) -> tuple[S.Region, S.Region]:
    return tuple(S.Region(*(m.extrapolated(s, t) for s in (*m.low, *m.high))) for m in (a, b))


def intersects_at(a: Moving, b: Moving, t: Column | float) -> Column:
    t = S._column(t)
    return _alive(a, t) & _alive(b, t) & S.intersects(*_boxes(a, b, t))


def contains_at(a: Moving, b: Moving, t: Column | float) -> Column:
    t = S._column(t)
    return _alive(a, t) & _alive(b, t) & S.contains(*_boxes(a, b, t))


def common_period(a: Moving, b: Moving, period: Span | None = None) -> Span:
    starts, ends = [a.span.t0, b.span.t0], [a.span.t1, b.span.t1]
    if period:
        starts.append(period.t0)
        ends.append(period.t1)
    return Span(F.greatest(*starts), F.least(*ends))


def intersects_during(a: Moving, b: Moving, period: Span | None = None) -> Column:
    """struct(hit, t0, t1): whether the boxes meet within the common period, and from when until when.

    A meeting at the very end of the period does not count.
    """
    p = common_period(a, b, period)
    starts, ends, never = [p.t0], [p.t1], F.lit(False)
    for k in (0, 1):
        for m, n in ((a, b), (b, a)):
            # gap(t) = low side of m - high side of n must be 0 or less.
            gap = m.extrapolated(m.low[k], p.t0) - n.extrapolated(n.high[k], p.t0)
            speed = m.low[k].v - n.high[k].v
            zero = p.t0 + F.try_divide(-gap, speed)
            starts.append(F.when(speed < 0, zero))
            ends.append(F.when(speed > 0, zero))
            never = never | ((speed == 0) & (gap > 0))
    found = F.struct(F.greatest(*starts).alias("first"), F.least(*ends).alias("last"), ((p.t0 < p.t1) & ~never).alias("possible"), p.t1.alias("end"))

    def judged(f: Column) -> Column:
        hit = f["possible"] & (f["first"] <= f["last"]) & (f["first"] < f["end"])
        return F.struct(hit.alias("hit"), F.when(hit, f["first"]).alias("t0"), F.when(hit, f["last"]).alias("t1"))

    return _let(found, judged)


def _let(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value), with the value worked out once."""
    return F.get(F.transform(F.array(value), use), 0)


def contains_during(a: Moving, b: Moving, period: Span | None = None) -> Column:
    """Whether a lives through b's part of the period and holds b all along: linear sides ask for both ends only."""
    p = Span(F.greatest(b.span.t0, period.t0), F.least(b.span.t1, period.t1)) if period else b.span
    at = [S.contains(*_boxes(a, b, t)) for t in (p.t0, p.t1)]
    return (p.t0 < p.t1) & covers(a.span, p) & at[0] & at[1]


def contains_after(a: Moving, b: Moving, t: Column | float) -> Column:
    return contains_during(a, b, Span(t, b.span.t1))


def _extents(a: Moving, t: Column) -> list[tuple[Column, Column]]:
    return [(a.extrapolated(h, t) - a.extrapolated(low, t), h.v - low.v) for low, h in zip(a.low, a.high, strict=True)]


def _within(a: Moving, period: Span | None) -> Span:
    return Span(F.greatest(a.span.t0, period.t0), F.least(a.span.t1, period.t1)) if period else a.span


def swept_measure(extents: list[tuple[Column, Column]], h: Column) -> Column:
    """Integral over a time h of the product of extents, given as (size at first, growth), of any number of axes."""
    powers = [F.lit(1.0)]  # of the time, by rising exponent
    for size, growth in extents:
        grown = [F.lit(0.0), *(c * growth for c in powers)]
        powers = [c * size + g for c, g in zip([*powers, F.lit(0.0)], grown, strict=True)]
    out = F.lit(0.0)
    for k in range(len(powers), 0, -1):
        out = (out + powers[k - 1] / k) * h
    return F.when(h <= 0, 0.0).otherwise(out)


def swept_area(a: Moving, period: Span | None = None) -> Column:
    """Integral of the area over time; 0 over an empty period."""
    p = _within(a, period)
    return swept_measure(_extents(a, p.t0), p.t1 - p.t0)


def swept_surface(a: Moving, period: Span | None = None) -> Column:
    """Integral of the sum of the extents over time."""
    p = _within(a, period)
    h = p.t1 - p.t0
    (x, u), (y, v) = _extents(a, p.t0)
    return F.when(h <= 0, 0.0).otherwise(h * (x + y) + h * h * (u + v) / 2)


def center_distance(a: Moving, b: Moving, period: Span | None = None) -> Column:
    """Integral of the distance of the centers over the common period.

    With offset d and relative speed w, the distance is sqrt(w.w t^2 + 2 d.w t + d.d); the
    antiderivative is taken around the time of closest approach, which keeps it stable.
    """
    p = common_period(a, b, period)
    h = p.t1 - p.t0

    def middle(m: Moving, k: int) -> tuple[Column, Column]:
        return (m.extrapolated(m.low[k], p.t0) + m.extrapolated(m.high[k], p.t0)) / 2, (m.low[k].v + m.high[k].v) / 2

    pairs = [(middle(a, k), middle(b, k)) for k in (0, 1)]
    dx, dy = (q[0] - r[0] for r, q in pairs)
    wx, wy = (q[1] - r[1] for r, q in pairs)
    known = F.struct((wx * wx + wy * wy).alias("a"), (dx * dx + dy * dy).alias("d"), (dx * wx + dy * wy).alias("b"), h.alias("h"))

    def total(c: Column) -> Column:
        off = F.greatest(c["d"] - F.try_divide(c["b"] * c["b"], c["a"]), F.lit(0.0))
        near = -F.try_divide(c["b"], c["a"])  # time of closest approach
        return _let(F.struct(c["a"].alias("a"), c["d"].alias("d"), c["h"].alias("h"), off.alias("o"), near.alias("n"), F.sqrt(c["a"]).alias("w")), closed)

    def closed(c: Column) -> Column:
        def integral(t: Column) -> Column:
            z = c["w"] * (t - c["n"])
            root = F.sqrt(z * z + c["o"])
            return (z * root + F.when(c["o"] > 0, c["o"] * F.log(F.try_divide(F.abs(z) + root, F.sqrt(c["o"]))) * F.signum(z)).otherwise(0.0)) / (F.lit(2.0) * c["w"])

        return F.when(c["h"] <= 0, 0.0).when(c["a"] == 0, c["h"] * F.sqrt(c["d"])).otherwise(integral(c["h"]) - integral(F.lit(0.0)))

    return _let(known, total)


def overlap_integral(a: Moving, b: Moving, period: Span | None = None) -> Column:
    """Integral of the area of the boxes' common part over the common period.

    Between the times at which two sides meet, each axis' common extent is linear or not
    positive; so the period is cut at those times and each piece integrated exactly.
    """
    p = common_period(a, b, period)
    names = [f"{m}{e}{k}" for k in (0, 1) for m in "ab" for e in "lh"]
    sides = [(m, s) for k in (0, 1) for m in (a, b) for s in (m.low[k], m.high[k])]
    known = F.struct((p.t1 - p.t0).alias("h"), *(m.extrapolated(s, p.t0).alias(n) for n, (m, s) in zip(names, sides, strict=True)), *(s.v.alias(f"v{n}") for n, (_, s) in zip(names, sides, strict=True)))

    def total(c: Column) -> Column:
        meets = []
        for k in (0, 1):
            for x, y in (("al", "bl"), ("ah", "bh"), ("al", "bh"), ("ah", "bl")):
                meets.append(F.try_divide(c[f"{y}{k}"] - c[f"{x}{k}"], c[f"v{x}{k}"] - c[f"v{y}{k}"]))
        cuts = F.array_sort(F.filter(F.array(F.lit(0.0), c["h"], *meets), lambda t: t.isNotNull() & (t >= 0) & (t <= c["h"])))
        return F.when(c["h"] <= 0, 0.0).otherwise(_let(cuts, lambda ts: F.aggregate(F.transform(ts, lambda t, i: piece(c, t, F.get(ts, i + 1))), F.lit(0.0), lambda s, x: s + x)))

    def extent(c: Column, k: int, t: Column) -> Column:
        high = F.least(*(c[f"{m}h{k}"] + c[f"v{m}h{k}"] * t for m in "ab"))
        return F.greatest(high - F.greatest(*(c[f"{m}l{k}"] + c[f"v{m}l{k}"] * t for m in "ab")), F.lit(0.0))

    def piece(c: Column, t: Column, end: Column) -> Column:
        def sum_of(q: Column) -> Column:  # Simpson's rule, exact for squares
            return sum((extent(c, 0, x) * extent(c, 1, x) * w for x, w in ((q["t"], 1), ((q["t"] + q["e"]) / 2, 4), (q["e"], 1))), F.lit(0.0)) * (q["e"] - q["t"]) / 6

        return F.when(end.isNotNull(), _let(F.struct(t.alias("t"), end.alias("e")), sum_of)).otherwise(0.0)

    return _let(known, total)


def union_in_time(a: Moving, b: Moving, since: Column | None = None) -> Moving:
    """Box around both from a's start (or ``since``): low sides take the lesser place and speed."""
    t = since if since is not None else a.span.t0

    def joined(x: list[Side], y: list[Side], pick) -> list[Side]:
        return [Side(pick(a.extrapolated(s, t), b.extrapolated(r, t)), pick(s.v, r.v)) for s, r in zip(x, y, strict=True)]

    start = F.least(a.span.t0, b.span.t0) if since is None else t
    return Moving(joined(a.low, b.low, F.least), joined(a.high, b.high, F.greatest), Span(start, F.greatest(a.span.t1, b.span.t1)))
