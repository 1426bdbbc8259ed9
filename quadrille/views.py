"""Tables of shapes derived from the driver's tables by integer arithmetic, in Spark and in DuckDB."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

_KEYS = {"rect_r": ("orders", "o_orderkey"), "rect_s": ("customer", "c_custkey"), "pt": ("supplier", "s_suppkey"), "seg": ("part", "p_partkey"), "ball": ("supplier", "s_suppkey"), "tpoint": ("events", "event_id"), "trect": ("events", "event_id"), "mpoint": ("events", "event_id"), "mrect": ("events", "event_id"), "rect_grp": ("orders", "o_orderkey")}


def _sides(k: Column) -> dict[str, Column]:
    xlo, ylo = (k * 7919 % 100000) / F.lit(1000.0), (k * 104729 % 100000) / F.lit(1000.0)
    return {"xlo": xlo, "ylo": ylo, "xhi": xlo + (k % 97) / F.lit(100.0), "yhi": ylo + (k % 89) / F.lit(100.0)}


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    table, key = _KEYS[name]
    t = spark.read.parquet(f"{sf_dir}/{table}.parquet")
    k = F.col(key).cast("long")
    s = _sides(k)
    box = [s[c].alias(c) for c in ("xlo", "ylo", "xhi", "yhi")]
    point = [s["xlo"].alias("x"), s["ylo"].alias("y")]
    id_ = k.alias("id")
    if name in ("rect_r", "rect_s"):
        return t.select(id_, *box)
    if name == "rect_grp":
        return t.select(id_, *box, F.col("o_orderpriority").alias("grp"))
    if name == "pt":
        return t.select(id_, *point)
    if name == "seg":
        return t.select(id_, *(s[c].alias(n) for c, n in (("xlo", "x1"), ("ylo", "y1"), ("xhi", "x2"), ("yhi", "y2"))))
    if name == "ball":
        return t.select(id_, s["xlo"].alias("cx"), s["ylo"].alias("cy"), ((k % 50) / F.lit(10.0)).alias("r"))
    t0 = F.unix_micros(F.col("ts").cast("timestamp")) / F.lit(1000000.0)
    span = [t0.alias("t0"), (t0 + 600).alias("t1")]
    vx, vy = (k % 21 - 10) / F.lit(100.0), (k % 19 - 9) / F.lit(100.0)
    if name == "tpoint":
        return t.select(id_, *point, *span)
    if name == "trect":
        return t.select(id_, *box, *span)
    if name == "mpoint":
        return t.select(id_, *point, *span, vx.alias("vx"), vy.alias("vy"))
    return t.select(id_, *box, *span, vx.alias("vxlo"), vy.alias("vylo"), (vx + (k % 5) / F.lit(100.0)).alias("vxhi"), (vy + (k % 7) / F.lit(100.0)).alias("vyhi"))


def view_sql(*names: str) -> str:
    """A WITH clause that defines the views in DuckDB."""
    out = []
    for name in names:
        table, k = _KEYS[name]
        x, y = f"({k} * 7919 % 100000) / 1000.0::double", f"({k} * 104729 % 100000) / 1000.0::double"
        xh, yh = f"{x} + ({k} % 97) / 100.0::double", f"{y} + ({k} % 89) / 100.0::double"
        box = f"{x} AS xlo, {y} AS ylo, {xh} AS xhi, {yh} AS yhi"
        t0 = "epoch_us(ts) / 1000000.0::double"
        span = f"{t0} AS t0, {t0} + 600 AS t1"
        vx, vy = f"({k} % 21 - 10) / 100.0::double", f"({k} % 19 - 9) / 100.0::double"
        columns = {
            "rect_r": box, "rect_s": box, "rect_grp": f"{box}, o_orderpriority AS grp", "pt": f"{x} AS x, {y} AS y", "seg": f"{x} AS x1, {y} AS y1, {xh} AS x2, {yh} AS y2",
            "ball": f"{x} AS cx, {y} AS cy, ({k} % 50) / 10.0::double AS r", "tpoint": f"{x} AS x, {y} AS y, {span}", "trect": f"{box}, {span}", "mpoint": f"{x} AS x, {y} AS y, {span}, {vx} AS vx, {vy} AS vy",
            "mrect": f"{box}, {span}, {vx} AS vxlo, {vy} AS vylo, {vx} + ({k} % 5) / 100.0::double AS vxhi, {vy} + ({k} % 7) / 100.0::double AS vyhi",
        }[name]
        out.append(f"{name} AS (SELECT {k}::bigint AS id, {columns} FROM {table})")
    return "WITH " + ", ".join(out) + " "
