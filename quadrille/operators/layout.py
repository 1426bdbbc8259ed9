"""Sort-tile-recursive layout, its statistics and checks, clustered writes, and changes.

``str_leaves`` numbers leaves exactly. Its two orders are global, so it spends a range
shuffle on each: rows are ranked by (range partition, place in it) with counts of the
partitions, never by one window over everything.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import shapes as S
from .join import SIDES

FILL, CAPACITY = 0.7, 100


def ranked(t: DataFrame, *order: str, name: str = "rank") -> DataFrame:
    """Rank from 0 in a global order: ranges are sorted on their own and shifted by the rows before them."""
    dealt = t.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("__part", F.spark_partition_id()).persist()
    counts = dealt.groupBy("__part").count()
    # One row for each partition.
    before = counts.withColumn("__before", F.sum("count").over(Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)))
    inner = F.row_number().over(Window.partitionBy("__part").orderBy(*order))
    out = dealt.withColumn("__inner", inner).join(F.broadcast(before.select("__part", "__before")), "__part")
    return out.withColumn(name, (F.col("__inner") - 1 + F.coalesce("__before", F.lit(0))).cast("long")).drop("__part", "__inner", "__before")


def str_leaves(t: DataFrame, per_leaf: int = int(CAPACITY * FILL)) -> DataFrame:
    """Adds leaf, the number of the leaf node: slabs by x center, chunks of a slab by y center; ties by id."""
    n = t.count()
    leaves = max(1, math.ceil(n / per_leaf))
    slab_rows = math.ceil(math.sqrt(leaves)) * per_leaf
    x = ranked(t.withColumn("__x", F.col("xlo") + F.col("xhi")), "__x", "id", name="__rx")
    x = x.withColumn("__slab", F.floor(F.col("__rx") / slab_rows)).withColumn("__y", F.col("ylo") + F.col("yhi"))
    y = F.row_number().over(Window.partitionBy("__slab").orderBy("__y", "id")) - 1
    chunks = slab_rows // per_leaf
    return x.withColumn("leaf", (F.col("__slab") * chunks + F.floor(y / per_leaf)).cast("long")).drop("__x", "__rx", "__slab", "__y")


def nodes(leaves: DataFrame) -> DataFrame:
    """Of each leaf its box, number of rows and ids."""
    return leaves.groupBy("leaf").agg(
        F.count("*").alias("rows"), F.min("xlo").alias("xlo"), F.min("ylo").alias("ylo"), F.max("xhi").alias("xhi"), F.max("yhi").alias("yhi"), F.sort_array(F.collect_list("id")).alias("ids")
    )


def level_sizes(rows: int, per_leaf: int = int(CAPACITY * FILL)) -> list[int]:
    """Nodes on each level, leaves first, until one is left."""
    out = [max(1, math.ceil(rows / per_leaf))]
    while out[-1] > 1:
        out.append(math.ceil(out[-1] / per_leaf))
    return out


def statistics(leaves: DataFrame, per_leaf: int = int(CAPACITY * FILL)) -> DataFrame:
    """Rows, leaves, fullest leaf, and height of the tree above."""
    sizes = leaves.groupBy("leaf").count().agg(F.sum("count").alias("rows"), F.count("*").alias("leaves"), F.max("count").alias("fullest"))
    base = F.greatest(F.col("leaves"), F.lit(1)).cast("double")
    height = F.lit(1) + F.greatest(F.ceil(F.log(base) / F.lit(math.log(per_leaf)) - 1e-12), F.lit(0))
    return sizes.select("rows", "leaves", "fullest", height.cast("long").alias("height"))


def faults(leaves: DataFrame, described: DataFrame, per_leaf: int = CAPACITY) -> DataFrame:
    """Leaves whose described box is not that of their rows, or that hold too many; none if the layout is valid."""
    own = nodes(leaves)
    a, b = (S.Region.of(x) for x in ("a", "b"))
    return own.alias("a").join(described.alias("b"), "leaf", "full").where(~F.coalesce(S.equal(a, b), F.lit(False)) | (F.col("a.rows") > per_leaf)).select("leaf")


def write(t: DataFrame, path: str, g: float, mode: str = "errorifexists") -> None:
    """Rows clustered by cell, so that a window query skips row groups by the sides' minima and maxima."""
    z = F.floor(F.col("xlo") / g)
    t.withColumn("__cx", z).withColumn("__cy", F.floor(F.col("ylo") / g)).repartitionByRange("__cx", "__cy").sortWithinPartitions("__cx", "__cy", "xlo").drop("__cx", "__cy").write.mode(mode).parquet(path)


def insert(t: DataFrame, rows: DataFrame) -> DataFrame:
    """Rows added; columns that one side lacks become null."""
    return t.unionByName(rows, allowMissingColumns=True)


def delete(t: DataFrame, rows: DataFrame) -> DataFrame:
    """Rows without those of the same id and box."""
    same = (F.col("t.id") == F.col("d.id")) & S.equal(S.Region.of("t"), S.Region.of("d"))
    return t.alias("t").join(rows.select("id", *SIDES).alias("d"), same, "left_anti")


def found(t: DataFrame, rows: DataFrame) -> DataFrame:
    """The given rows with ``found``: whether t has a row of the same id and box, which delete would take."""
    same = (F.col("t.id") == F.col("d.id")) & S.equal(S.Region.of("t"), S.Region.of("d"))
    marked = rows.alias("d").join(t.select("id", *SIDES).alias("t"), same, "left_semi")
    missing = rows.alias("d").join(t.select("id", *SIDES).alias("t"), same, "left_anti")
    return marked.withColumn("found", F.lit(True)).unionAll(missing.withColumn("found", F.lit(False)))


def z_order(t: DataFrame, g: float, bits: int = 16) -> DataFrame:
    """Adds z, the cell numbers' bits in turn: a key that keeps near cells together."""
    def spread(c):
        v = F.floor(F.col(c) / g).cast("long") + (1 << (bits - 1))
        return sum((F.shiftleft(F.shiftright(v, i).bitwiseAND(1), 2 * i) for i in range(bits)), F.lit(0).cast("long"))

    return t.withColumn("z", spread("xlo") + spread("ylo") * 2)
