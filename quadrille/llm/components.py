"""Connected components of an edge table, by alternating large and small stars.

Each step links a node's larger neighbours (large star) or its smaller ones (small star)
to the smallest of them, until nothing changes; that takes about the square of the
logarithm of the number of nodes steps at most, far fewer in practice. Steps are group
minima and joins; their results are checkpointed in the folder of spark.checkpoint.dir.
Up to ``few`` edges, which are counted first, one task does the same by union-find, as each
step of the other way costs several shuffles. Null ends and loops are no edges; repeated
edges count once; no edges give no rows.
"""

from __future__ import annotations

import gc
import tempfile
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def checkpointed(df: DataFrame) -> DataFrame:
    """Cuts the lineage in the cluster's shared folder; a folder of its own only in local mode, where none is set."""
    spark = df.sparkSession
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        folder = shared_folder(spark)
        if not folder and not (context.master == "local" or context.master.startswith("local[")):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        context.setCheckpointDir(folder or tempfile.mkdtemp(prefix="checkpoint"))
    return df.checkpoint()


def shared_folder(spark: SparkSession) -> str | None:
    return spark.conf.get("spark.checkpoint.dir", None)


def release(spark: SparkSession) -> None:
    """Lets Spark delete the shuffle files of frames that are gone, which it does once the driver collects its garbage."""
    gc.collect()
    spark._jvm.System.gc()


def _in_one_task(edges: DataFrame) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        root: dict[int, int] = {}

        def find(x: int) -> int:
            while (up := root.setdefault(x, x)) != x:
                root[x] = root.setdefault(up, up)
                x = root[x]
            return x

        for batch in batches:
            for a, b in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                a, b = find(a), find(b)
                root[max(a, b)] = min(a, b)
        nodes = list(root)
        yield pa.RecordBatch.from_arrays([pa.array(nodes, pa.int64()), pa.array([find(x) for x in nodes], pa.int64())], names=["node", "component"])

    return edges.coalesce(1).mapInArrow(run, "node long, component long")


def _star(edges: DataFrame, larger: bool) -> DataFrame:
    """Edges (a, b) with a > b in and out."""
    both = edges.select(F.col("a").alias("u"), F.col("b").alias("v"))
    if larger:
        both = both.unionAll(edges.select(F.col("b").alias("u"), F.col("a").alias("v")))
    least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
    joined = both.join(least, "u")
    if larger:
        out = joined.where("v > u").select(F.col("v").alias("a"), F.col("m").alias("b"))
    else:
        out = joined.where("v != m").select(F.col("v").alias("a"), F.col("m").alias("b")).unionAll(least.select(F.col("u").alias("a"), F.col("m").alias("b")))
    return out.where("a != b").distinct()


def components(edges: DataFrame, most_steps: int | None = None, few: int = 1 << 14) -> DataFrame:
    """(node, component) for the nodes of edges (a, b): the smallest node reachable. Edges up to ``few`` go to one task. An error if that takes over ``most_steps``, where given."""
    now = checkpointed(edges.where("a is not null and b is not null and a != b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    if most_steps is None and now.count() <= few:
        return checkpointed(_in_one_task(now))
    mark, steps = None, 0
    while True:
        if most_steps is not None and steps >= most_steps:
            raise RuntimeError(f"components not done after {steps} steps")
        steps += 1
        now = checkpointed(_star(_star(now, True), False))
        # Stars only: every node has one edge, to a node that has none.
        seen = now.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if tuple(seen) == mark:
            break
        mark = tuple(seen)
    return now.select(F.col("a").alias("node"), F.col("b").alias("component"))
