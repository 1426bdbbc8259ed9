"""Readers and writers of box text and of geometry text, and a seeded generator."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators.join import SIDES

#: The format of a box row is "op id xlo ylo xhi yhi", op is 1.
INSERT = 1


def valid() -> Column:
    """Boxes without null or NaN and with low sides no higher than high ones."""
    ok = F.lit(True)
    for c in SIDES:
        ok = ok & F.col(c).isNotNull() & ~F.isnan(c)
    return ok & (F.col("xlo") <= F.col("xhi")) & (F.col("ylo") <= F.col("yhi"))


def parsed_mbr(lines: DataFrame) -> DataFrame:
    """op, id and sides of lines (value); null where a line has another number of fields or no number."""
    field = lambda i, kind: F.when(F.size("fields") == 6, F.get("fields", F.lit(i)).try_cast(kind))
    # Behind an explode, so that no filter repeats the splitting for each field.
    split = lines.select("value", F.explode(F.array(F.split(F.trim("value"), r"\s+"))).alias("fields"))
    return split.select("value", field(0, "int").alias("op"), field(1, "long").alias("id"), *(field(i, "double").alias(c) for i, c in enumerate(SIDES, 2)))


def _box_row() -> Column:
    return F.coalesce(F.col("op").isNotNull() & F.col("id").isNotNull() & valid(), F.lit(False))


def boxes_of(lines: DataFrame, strict: bool = False) -> DataFrame:
    """Boxes of lines (value). Another operation than 1 is an error, with ``strict`` each other bad line too.

    The test is part of the filter, so it holds whichever columns are used later.
    """
    error = lambda what: F.raise_error(F.concat(F.lit(f"{what}: "), F.col("value"))).cast("boolean")
    bad = error("not a box") if strict else F.lit(False)
    keep = F.when(F.col("op") != INSERT, error("unknown operation")).when(_box_row(), True).otherwise(bad)
    return parsed_mbr(lines).where(keep).select("id", *SIDES)


def read_mbr(spark: SparkSession, path: str, strict: bool = False) -> DataFrame:
    """Boxes of a text file, as ``boxes_of``; what is left out is told by ``mbr_rejects``."""
    return boxes_of(spark.read.text(path), strict)


def mbr_rejects(lines: DataFrame) -> DataFrame:
    """Lines (value) that are no box: fields missing or no numbers, NaN, low sides above high ones, another operation."""
    return parsed_mbr(lines).where(~_box_row() | (F.col("op") != INSERT)).select("value")


def mbr_lines(t: DataFrame) -> DataFrame:
    """Rows as text, with 15 significant digits."""
    return t.select(F.concat_ws(" ", F.lit(INSERT).cast("string"), F.col("id").cast("string"), *(F.format_string("%.15g", F.col(c)) for c in SIDES)).alias("value"))


def write_mbr(t: DataFrame, path: str, mode: str = "errorifexists") -> None:
    mbr_lines(t).write.mode(mode).text(path)


def numbered(spark: SparkSession, path: str) -> DataFrame:
    """Lines with their numbers from 0, by file name and place in the file.

    Lines are counted by split; a line's number is its place in its split and the lines of
    the splits before, of which there is one row each.
    """
    at = F.monotonically_increasing_id()
    lines = spark.read.text(path).select("value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("start"), at.alias("at"))
    splits = lines.groupBy("file", "start").agg(F.count("*").alias("rows"), F.min("at").alias("first"))
    before = F.sum("rows").over(Window.orderBy("file", "start").rowsBetween(Window.unboundedPreceding, -1))
    splits = splits.select("file", "start", "first", F.coalesce(before, F.lit(0)).alias("before"))
    return lines.join(F.broadcast(splits), ["file", "start"]).select((F.col("at") - F.col("first") + F.col("before")).alias("id"), "value")


def _sides(coordinates: Column) -> list[Column]:
    """Box of a text "x y, x y"."""
    points = F.filter(F.transform(F.split(coordinates, ","), lambda p: F.split(F.trim(p), r"\s+")), lambda p: F.size(p) >= 2)
    out = []
    for f, low in ((F.array_min, True), (F.array_max, False)):
        for place in (0, 1):
            out.append(f(_numbers(points, place)).alias(("xlo", "ylo")[place] if low else ("xhi", "yhi")[place]))
    return out


def _numbers(points: Column, place: int) -> Column:
    return F.transform(points, lambda p: F.get(p, F.lit(place)).try_cast("double"))


def quoted_wkt(lines: DataFrame) -> DataFrame:
    """Boxes of lines (id, value) with a geometry in the first double quotes: all coordinates of all rings."""
    inner = F.regexp_replace(F.regexp_replace(F.get(F.split("value", '"'), F.lit(1)), r"^\s*\S+\s*", ""), "[()]", " ")
    return lines.select("id", *_sides(inner), "value")


def polygon_wkt(lines: DataFrame) -> DataFrame:
    """Boxes of the first ring after each POLYGON of a line; sides are null if there is none."""
    rings = F.regexp_extract_all("value", F.lit(r"POLYGON[^(]*[(]+([^)]*)[)]"), F.lit(1))
    joined = F.when(F.size(rings) > 0, F.array_join(rings, ","))
    return lines.select("id", *_sides(joined), "value")


def accepted(boxes: DataFrame) -> DataFrame:
    return boxes.where(valid()).select("id", *SIDES)


def rejected(boxes: DataFrame) -> DataFrame:
    """Lines that gave no valid box; their numbers stay unused."""
    return boxes.where(~F.coalesce(valid(), F.lit(False))).select("id", "value")


def generate(spark: SparkSession, n: int, seed: int = 0, width: float = 99.9, side: float = 0.01, partitions: int = 8) -> DataFrame:
    """n boxes of one size at random places; the same for the same seed and partitions."""
    t = spark.range(0, n, 1, partitions).select("id", (F.rand(seed) * width).alias("xlo"), (F.rand(seed + 1) * width).alias("ylo"))
    return t.select("id", "xlo", "ylo", (F.col("xlo") + side).alias("xhi"), (F.col("ylo") + side).alias("yhi"))


def random_columns(t: DataFrame, seed: int = 0, low: float = 0.0, high: float = 1.0) -> DataFrame:
    """Adds uniform, a whole number under 2**31 and a coin."""
    return t.select("*", (F.rand(seed) * (high - low) + low).alias("uniform"), F.floor(F.rand(seed + 1) * (1 << 31)).alias("whole"), (F.rand(seed + 2) < 0.5).alias("coin"))
