"""Extents, normalisation, grouped boxes and histograms."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from .join import SIDES

#: Fixed value: the smallest positive normal double, which the compatible extent starts its maxima from.
TINY = 2.2250738585072014e-308


def bounds(t: DataFrame, *by: str) -> DataFrame:
    """Box around all rows, or around each group."""
    return t.groupBy(*by).agg(F.min("xlo").alias("xlo"), F.min("ylo").alias("ylo"), F.max("xhi").alias("xhi"), F.max("yhi").alias("yhi"))


def bounds_in_time(t: DataFrame, *by: str) -> DataFrame:
    return t.groupBy(*by).agg(F.min("xlo").alias("xlo"), F.min("ylo").alias("ylo"), F.max("xhi").alias("xhi"), F.max("yhi").alias("yhi"), F.min("t0").alias("t0"), F.max("t1").alias("t1"))


def moving_bounds(t: DataFrame, at: Column, *by: str) -> DataFrame:
    """Moving box around each group's rows from a common time on."""
    def reach(side: str) -> Column:
        return F.col(side) + F.col(f"v{side}") * (at - F.col("t0"))

    low = [f(e).alias(n) for n in ("xlo", "ylo") for f, e, n in ((F.min, reach(n), n), (F.min, F.col(f"v{n}"), f"v{n}"))]
    high = [f(e).alias(n) for n in ("xhi", "yhi") for f, e, n in ((F.max, reach(n), n), (F.max, F.col(f"v{n}"), f"v{n}"))]
    return t.groupBy(*by).agg(*low, *high, F.first(at).alias("t0"), F.max("t1").alias("t1"))


def normalize(t: DataFrame, compat: bool = False, scale: float = 100.0) -> DataFrame:
    """Coordinates scaled by the table's own extent to 0 .. scale; 0 on an axis without extent.

    compat takes the largest value to be at least the smallest positive number, as the
    original tools do, so axes with negative values only are scaled against zero.
    """
    top = (lambda c: F.greatest(F.max(c), F.lit(TINY))) if compat else F.max
    ext = t.agg(F.min("xlo").alias("__x0"), F.min("ylo").alias("__y0"), top("xhi").alias("__x1"), top("yhi").alias("__y1"))
    out = t.crossJoin(F.broadcast(ext))

    def scaled(c: str) -> Column:
        a = c[0]
        return F.coalesce(F.try_divide(F.col(c) - F.col(f"__{a}0"), F.col(f"__{a}1") - F.col(f"__{a}0")) * scale, F.lit(0.0)).alias(c)

    return out.select(*(scaled(c) if c in SIDES else F.col(f"`{c}`") for c in t.columns))


def by_cell(t: DataFrame, g: float) -> DataFrame:
    """Rows by the cell of their lower left corner."""
    return t.groupBy(F.floor(F.col("xlo") / g).alias("cx"), F.floor(F.col("ylo") / g).alias("cy")).agg(F.count("*").alias("rows"))


def by_partition(t: DataFrame, parts: int, *key: str) -> DataFrame:
    """Rows by partition, if dealt by the sum of the key columns."""
    total = sum((F.col(k) for k in key[1:]), F.col(key[0]))
    return t.groupBy(F.pmod(total, F.lit(parts)).alias("part")).agg(F.count("*").alias("rows"))


def observed(t: DataFrame, name: str = "boxes") -> tuple[DataFrame, Observation]:
    """The rows as they are, and an observation of their number, box bytes and bounds once an action has read them."""
    seen = Observation(name)
    sides = [f(c).alias(c) for c, f in (("xlo", F.min), ("ylo", F.min), ("xhi", F.max), ("yhi", F.max))]
    return t.observe(seen, F.count(F.lit(1)).alias("rows"), (F.count(F.lit(1)) * 40).alias("bytes"), *sides), seen
