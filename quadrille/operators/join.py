"""Box joins as equi-joins on grid cells, cut further where they are full.

Each box is put in the cells it covers; boxes are joined within a cell and the exact
predicate decides. A pair is kept only in the cell that holds the lower left corner of the
common box, so it comes out once without a distinct. Boxes too large for the grid belong
to a coarser level; a pair is made on the level of its larger box, so levels share no pair.
Skewed cells are split by adaptive execution, as the join is an ordinary equi-join.

Left and right tables have columns id, xlo, ylo, xhi, yhi and any others. Results have the
left columns as they are and the right ones with the suffix ``_r``.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import shapes as S

SIDES = ("xlo", "ylo", "xhi", "yhi")
#: Cells that a box covers on its level, at most, and the ratio of cell sides of two levels.
MOST_CELLS, STEP = 64, 8.0
#: Rows that a cell should hold, and how many times a full one is halved at most.
ROWS_PER_CELL, MOST_SPLITS = 16.0, 20
Predicate = Callable[[S.Region, S.Region], Column]


@dataclass
class Extents:
    """What a grid is chosen by."""

    rows: int
    mean: float
    largest: float
    width: float


def extents(*tables: DataFrame) -> Extents:
    """One aggregation over all tables."""
    every = tables[0].select(*SIDES)
    for t in tables[1:]:
        every = every.unionAll(t.select(*SIDES))
    side = F.greatest(F.col("xhi") - F.col("xlo"), F.col("yhi") - F.col("ylo"))
    spread = F.greatest(F.max("xhi") - F.min("xlo"), F.max("yhi") - F.min("ylo"))
    r = every.agg(F.count("*").alias("n"), F.avg(side).alias("mean"), F.max(side).alias("most"), spread.alias("width")).first()
    return Extents(r["n"], r["mean"] or 0.0, r["most"] or 0.0, r["width"] or 0.0)


def cell_side(e: Extents, rows_per_cell: float = ROWS_PER_CELL) -> float:
    """A cell holds some rows and is no smaller than a usual box."""
    by_rows = e.width * math.sqrt(rows_per_cell / max(e.rows, 1))
    return max(by_rows, e.mean, e.width * 1e-6) or 1.0


def _cells(t: DataFrame, g: float) -> DataFrame:
    def span(low: str, high: str) -> Column:
        return F.sequence(F.floor(F.col(low) / g), F.floor(F.col(high) / g))

    return t.withColumn("__cx", F.explode(span("xlo", "xhi"))).withColumn("__cy", F.explode(span("ylo", "yhi")))


def _level(g: float, levels: int) -> Column:
    """The finest level on which a box covers few enough cells."""
    out = F.lit(levels - 1)
    for k in range(levels - 2, -1, -1):
        side = g * STEP**k
        cells = (F.floor(F.col("xhi") / side) - F.floor(F.col("xlo") / side) + 1) * (F.floor(F.col("yhi") / side) - F.floor(F.col("ylo") / side) + 1)
        out = F.when(cells <= MOST_CELLS, k).otherwise(out)
    return out


def _renamed(s: DataFrame) -> DataFrame:
    return s.select(*(F.col(f"`{c}`").alias(f"{c}_r") for c in s.columns))


def right(alias: str = "") -> S.Region:
    return S.Region(*(F.col(f"{c}_r") for c in SIDES))


def left() -> S.Region:
    return S.Region(*(F.col(c) for c in SIDES))


def grid_join(r: DataFrame, s: DataFrame, g: float | None = None, predicate: Predicate | None = None, levels: int | None = None, split: bool = False) -> DataFrame:
    """Pairs whose boxes intersect and fulfil a predicate (which must imply that they do).

    Without g, or without levels, one aggregation over both sides chooses them. With split,
    full cells of the finest level are cut further.
    """
    if g is None or levels is None:
        g, levels = _chosen(extents(r, s), g, levels)
    out = None
    if levels > 1:
        r, s = (t.withColumn("__level", _level(g, levels)) for t in (r, s))
    for k in range(levels):
        if levels == 1:
            lanes = [(r, s)]
        else:
            lanes = [(r.where(F.col("__level") == k), s.where(F.col("__level") <= k))]
            if k:
                lanes.append((r.where(F.col("__level") < k), s.where(F.col("__level") == k)))
        for a, b in lanes:
            full = full_cells(g, a, b) if split and k == 0 else None
            pairs = _one_level(a.drop("__level"), b.drop("__level"), g * STEP**k, predicate, full)
            out = pairs if out is None else out.unionAll(pairs)
    return out


def _chosen(e: Extents, g: float | None = None, levels: int | None = None) -> tuple[float, int]:
    g = g or cell_side(e)
    reach = math.sqrt(MOST_CELLS) - 1
    return g, levels or 1 + max(0, math.ceil(math.log(max(e.largest / (g * reach), 1.0), STEP)))


def _one_level(r: DataFrame, s: DataFrame, g: float, predicate: Predicate | None, full: DataFrame | None = None) -> DataFrame:
    a, b = _cells(r, g), _cells(_renamed(s).select("*", *(F.col(f"{c}_r").alias(c) for c in SIDES)), g)
    cell, keys = (F.col("__cx"), F.col("__cy")), ["__cx", "__cy"]
    if full is not None:
        a, b = (_parts(t, full, g) for t in (a, b))
        keys += ["__px", "__py"]
    b = b.drop(*SIDES, "__parts")
    x, y = left(), right()
    corner = F.greatest(x.xlo, y.xlo), F.greatest(x.ylo, y.ylo)
    owner = (cell[0] == F.floor(corner[0] / g)) & (cell[1] == F.floor(corner[1] / g))
    if full is not None:
        owner = owner & (F.col("__px") == _part(corner[0], cell[0], g)) & (F.col("__py") == _part(corner[1], cell[1], g))
    out = a.join(b, keys).where(S.intersects(x, y) & owner)
    if predicate:
        out = out.where(predicate(x, y))
    return out.drop(*keys, "__parts")


def _parts(t: DataFrame, full: DataFrame, g: float) -> DataFrame:
    """Rows in cells, copied into the parts of full cells that they cover."""
    t = t.join(full, ["__cx", "__cy"], "left").withColumn("__parts", F.coalesce("__parts", F.lit(1.0)))
    for name, low, high, cell in (("__px", "xlo", "xhi", "__cx"), ("__py", "ylo", "yhi", "__cy")):
        t = t.withColumn(name, F.explode(F.sequence(*(_part(F.col(v), F.col(cell), g) for v in (low, high)))))
    return t


def naive_join(r: DataFrame, s: DataFrame, predicate: Predicate | None = None) -> DataFrame:
    """All pairs compared: the plan to check others by, for small inputs."""
    hit = S.intersects(left(), right())
    return r.join(_renamed(s), hit & predicate(left(), right()) if predicate else hit)


def full_cells(g: float, *tables: DataFrame) -> DataFrame:
    """(__cx, __cy, __parts) of the cells with far more rows than a cell should hold, and parts along each side.

    The place that the rows take up comes from the spread of their centers, 12 times the
    product of the deviations as for an even spread. Parts are no smaller than the quadratic
    mean of the sides there, so a box covers about four of them in the mean.
    """
    every = None
    for t in tables:
        x, y = ((F.col(lo) + F.col(hi)) / 2 for lo, hi in (("xlo", "xhi"), ("ylo", "yhi")))
        side = F.greatest(F.col("xhi") - F.col("xlo"), F.col("yhi") - F.col("ylo"))
        t = t.select(F.floor(x / g).alias("__cx"), F.floor(y / g).alias("__cy"), x.alias("x"), y.alias("y"), (side * side).alias("square"))
        every = t if every is None else every.unionAll(t)
    cells = every.groupBy("__cx", "__cy").agg(F.count("*").alias("rows"), F.sqrt(F.avg("square")).alias("side"), F.stddev_pop("x").alias("dx"), F.stddev_pop("y").alias("dy"))
    side = F.greatest("side", F.lit(g * 0.5**MOST_SPLITS))
    place = 12 * F.greatest("dx", side) * F.greatest("dy", side)
    halved = F.greatest(F.least(F.ceil(F.log2(F.col("rows") / ROWS_PER_CELL * g * g / place) / 2), F.floor(F.log2(g / side))), F.lit(0))
    full = cells.where(F.col("rows") > 4 * ROWS_PER_CELL).select("__cx", "__cy", F.pow(F.lit(2.0), halved).alias("__parts"))
    return full.where(F.col("__parts") > 1)


def _part(v: Column, cell: Column, g: float) -> Column:
    """Which part of its cell a value lies in, the outer ones for values outside: never falls as v grows."""
    n = F.col("__parts")
    return F.greatest(F.least(F.floor((v - cell * g) / g * n), n.cast("long") - 1), F.lit(0).cast("long"))


def tile_join(r: DataFrame, s: DataFrame, g: float | None = None, predicate: Predicate | None = None, levels: int | None = None) -> DataFrame:
    """As grid_join, with full cells cut into parts that follow the density: for strongly skewed places.

    The full cells are joined to the rows on the cell, so their number is bounded by rows and
    not by what a plan or a driver holds.
    """
    return grid_join(r, s, g, predicate, levels, split=True)


def plan_join(r: DataFrame, s: DataFrame, predicate: Predicate | None = None) -> DataFrame:
    """The grid, or with full cells cut if there are any: one look at the cells' counts. Both give the same pairs."""
    e = extents(r, s)
    g, levels = _chosen(e)
    small = (t.where(_level(g, levels) == 0) if levels > 1 else t for t in (r, s))
    return grid_join(r, s, g, predicate, levels, split=not full_cells(g, *small).isEmpty())


def contains_join(r: DataFrame, s: DataFrame, g: float | None = None) -> DataFrame:
    return grid_join(r, s, g, S.contains)


def self_join(r: DataFrame, window: S.Region | None = None, g: float | None = None) -> DataFrame:
    """Ordered pairs of different ids that intersect each other and both the window."""
    if window is not None:
        r = r.where(S.intersects(left(), window))
    return grid_join(r, r, g).where(F.col("id") != F.col("id_r"))


def semi_join(r: DataFrame, s: DataFrame, g: float | None = None, anti: bool = False) -> DataFrame:
    """The rows of r that meet a row of s, or with anti those that meet none."""
    met = grid_join(r, s, g).select("id").distinct()
    return r.join(met, "id", "left_anti" if anti else "left_semi")


def outer_join(r: DataFrame, s: DataFrame, g: float | None = None, full: bool = False) -> DataFrame:
    """The pairs, the rows of r that meet none with nulls for the right side and, if full, those of s likewise."""
    pairs = grid_join(r, s, g).select(*r.columns, *(f"{c}_r" for c in s.columns))
    out = pairs.unionByName(semi_join(r, s, g, anti=True), allowMissingColumns=True)
    return out.unionByName(_renamed(semi_join(s, r, g, anti=True)), allowMissingColumns=True) if full else out


def with_clip(pairs: DataFrame) -> DataFrame:
    """Adds the common box and its area to joined pairs."""
    box = S.clip(left(), right())
    return pairs.select("*", box.xlo.alias("cxlo"), box.ylo.alias("cylo"), box.xhi.alias("cxhi"), box.yhi.alias("cyhi"), S.clip_area(left(), right()).alias("clip_area"))


def count_pairs(pairs: DataFrame) -> DataFrame:
    """Number of pairs and an order-free checksum of their ids."""
    return pairs.agg(F.count("*").alias("pairs"), F.coalesce(F.sum(F.col("id") * 31 + F.col("id_r")), F.lit(0)).cast("long").alias("checksum"))
