import math
import random

import pytest
from pyspark.sql import functions as F

from quadrille.functions import moving as M
from quadrille.functions import shapes as S
from quadrille.functions import temporal as T
from quadrille.operators import aggregate, join, layout, select
from quadrille.plans.index import BoxIndex, Options
from quadrille.sources import callback, text
from quadrille.streaming import windows

BOX = "id long, xlo double, ylo double, xhi double, yhi double"


def boxes(spark, rows):
    return spark.createDataFrame([(i, *map(float, r)) for i, r in enumerate(rows, 1)], BOX)


def value(spark, column):
    return spark.range(1).select(column.alias("v")).first()["v"]


@pytest.fixture(scope="module")
def mixed(spark):
    """Small, large, degenerate boxes, on both signs, many with sides on whole numbers."""
    r = random.Random(4)

    def some(n):
        out = []
        for _ in range(n):
            x, y, w = r.choice([r.uniform(-20, 20), r.randint(-20, 20)]), r.choice([r.uniform(-20, 20), r.randint(-20, 20)]), r.choice([0, 0.3, 1, 2, 15])
            out.append((x, y, x + w, y + r.choice([0, w, 1])))
        return [*out, (-1000, -1000, 1000, 1000)]

    return boxes(spark, some(80)), boxes(spark, some(60))


def pairs(df):
    return sorted((r["id"], r["id_r"]) for r in df.select("id", "id_r").collect())


def test_joins_agree(spark, mixed):
    a, b = mixed
    want = pairs(join.naive_join(a, b))
    assert pairs(join.grid_join(a, b)) == want
    for g in (0.5, 1.0, 7.0):
        assert pairs(join.grid_join(a, b, g=g)) == want
    for g in (None, 1.0, 7.0, 40.0):
        assert pairs(join.tile_join(a, b, g)) == want
    assert sorted((y, x) for x, y in pairs(join.grid_join(b, a))) == want
    assert pairs(join.plan_join(a, b)) == want
    assert pairs(join.contains_join(a, b)) == pairs(join.naive_join(a, b, S.contains))


def test_full_cells_are_cut(spark):
    """Most rows in one place: few candidates share a part, no box is copied into many."""
    r = random.Random(5)

    def some(n):
        return boxes(spark, [(x, y, x + r.uniform(0, 0.002), y + r.uniform(0, 0.002)) for x, y in ((r.gauss(-3, 0.05), r.gauss(2, 0.05)) for _ in range(n))] + [(-100, -100, -99, -99), (100, 100, 101, 101)])

    a, b = some(1500), some(1500)
    full = join.full_cells(5.0, a, b)
    assert full.count() == 1 and full.first()["__parts"] >= 8
    held = join._parts(join._cells(a, 5.0), full, 5.0)
    assert held.groupBy("__px", "__py").count().agg(F.max("count")).first()[0] < 300 and held.count() < 4 * 1502
    assert pairs(join.tile_join(a, b, 5.0)) == pairs(join.naive_join(a, b)) == pairs(join.plan_join(a, b))


def test_self_join_and_semi(spark, mixed):
    a, b = mixed
    every = pairs(join.naive_join(a, a))
    assert pairs(join.self_join(a)) == [p for p in every if p[0] != p[1]]
    met = {x for x, _ in pairs(join.naive_join(a, b))}
    assert {r["id"] for r in join.semi_join(a, b).collect()} == met
    assert join.semi_join(a, b, anti=True).count() == a.count() - len(met)
    outer = join.outer_join(a, b, full=True)
    assert outer.where("id_r is null").count() == a.count() - len(met) and outer.where("id is null").count() == join.semi_join(b, a, anti=True).count()
    assert pairs(outer.where("id is not null and id_r is not null")) == pairs(join.naive_join(a, b))


def test_empty_sides(spark, mixed):
    none = spark.createDataFrame([], BOX)
    assert join.count_pairs(join.grid_join(none, mixed[0])).first()["pairs"] == 0
    assert join.count_pairs(join.grid_join(none, none)).first()["checksum"] == 0


def test_toy_rectangles(spark):
    t = boxes(spark, [(0, 0, 2, 2), (1, 1, 3, 3), (3.5, 3, 5, 5), (-0.5, -0.5, 0.5, 0.5)])
    assert join.self_join(t).count() == 4
    assert join.grid_join(t, t).count() == 8


def test_edge_cases(spark):
    a = S.Region(0, 0, 1, 1)
    assert value(spark, S.intersects(a, S.Region(1, 1, 2, 2))) and not value(spark, S.touches(a, S.Region(1, 1, 2, 2)))
    assert value(spark, S.intersects(a, S.Region(1, 0, 2, 1))) and value(spark, S.touches(a, S.Region(1, 0, 2, 1)))
    assert value(spark, S.contains(a, a)) and value(spark, S.distance(a, a)) == 0 and value(spark, S.equal(a, a))
    assert value(spark, S.contains(a, S.Region(1, 1, 1, 1)))
    assert value(spark, S.distance(a, S.Region(4, 5, 6, 7))) == 5 and value(spark, S.clip_area(a, S.Region(4, 5, 6, 7))) == 0
    assert value(spark, S.line_distance(S.Segment(0, 0, 1, 0), S.Point(100, 3))) == 3
    assert value(spark, S.intersects(S.Segment(0, 0, 2, 2), S.Segment(0, 2, 2, 0)))
    assert not value(spark, S.intersects(S.Segment(0, 0, 1, 1), S.Segment(2, 2, 3, 3)))
    assert value(spark, S.contains(S.Ball(0, 0, 5), S.Ball(1, 0, 3))) and not value(spark, S.contains(S.Ball(0, 0, 5), S.Ball(3, 0, 3)))
    assert value(spark, S.contains(S.Ball(0, 0, 1), S.Point(1.5, 0), compat=True)) and not value(spark, S.contains(S.Ball(0, 0, 1), S.Point(1.5, 0)))
    assert not value(spark, S.contains(S.Point(0, 0), S.Point(0, 0)))
    with pytest.raises(NotImplementedError):
        S.intersects(S.Point(0, 0), S.Point(0, 0))
    assert value(spark, S.ball_volume(F.lit(1.0), 3)) == pytest.approx(4.18879, abs=1e-5)
    assert value(spark, S.ball_volume(F.lit(1.0), 3, compat=True)) == pytest.approx(math.pi / math.gamma(2))
    lo, hi = F.array(F.lit(0.0), F.lit(0.0), F.lit(0.0)), F.array(F.lit(1.0), F.lit(2.0), F.lit(3.0))
    assert value(spark, S.area_nd(lo, hi)) == 6 and value(spark, S.margin_nd(lo, hi)) == 24 and value(spark, S.intersects_nd(lo, hi, hi, hi))


def test_time(spark):
    s = T.Span
    assert not value(spark, T.overlaps(s(0.0, 10.0), s(10.0, 20.0))) and not value(spark, T.overlaps(s(5.0, 5.0), s(5.0, 5.0)))
    meet = {(a, b): value(spark, T.intervals_intersect(T.Interval(0.0, 1.0, a), T.Interval(1.0, 2.0, b))) for a in (T.OPEN, T.CLOSED, T.LEFT_OPEN, T.RIGHT_OPEN) for b in (T.OPEN, T.CLOSED, T.LEFT_OPEN, T.RIGHT_OPEN)}
    assert {k for k, v in meet.items() if v} == {(a, b) for a in (T.CLOSED, T.LEFT_OPEN) for b in (T.CLOSED, T.RIGHT_OPEN)}
    assert value(spark, T.interval_contains(T.Interval(0.0, 1.0, T.OPEN), T.Interval(0.0, 1.0, T.OPEN)))
    assert not value(spark, T.interval_contains(T.Interval(0.0, 1.0, T.OPEN), T.Interval(0.0, 1.0, T.CLOSED)))


def test_moving_integrals(spark):
    r = random.Random(9)
    rows = []
    for i in range(30):
        x, y = r.uniform(-5, 5), r.uniform(-5, 5)
        vx, vy = r.uniform(-1, 1), r.uniform(-1, 1)
        rows.append((i, x, y, x + r.uniform(0, 4), y + r.uniform(0, 4), 1.0, 9.0, vx, vy, vx + r.choice([0, 0.3]), vy + r.choice([0, 0.2])))
    t = spark.createDataFrame(rows, BOX + ", t0 double, t1 double, vxlo double, vylo double, vxhi double, vyhi double")
    m, still = M.Moving.box(), M.Moving.fixed(S.Region(-2, -2, 2, 2), T.Span(0.0, 100.0))
    got = t.select("id", M.swept_area(m).alias("area"), M.overlap_integral(m, still).alias("shared"), M.center_distance(m, still).alias("gap"), M.intersects_during(still, m).alias("meets"), M.contains_during(still, m).alias("held")).collect()
    n = 8000
    for row, g in zip(rows, got, strict=True):
        area = shared = gap = 0.0
        hits, held = [], True
        for k in range(n):
            dt = (k + 0.5) * 8 / n
            xlo, ylo, xhi, yhi = (c + v * dt for c, v in zip(row[1:5], row[7:], strict=True))
            area += (xhi - xlo) * (yhi - ylo) * 8 / n
            w, h = min(xhi, 2) - max(xlo, -2), min(yhi, 2) - max(ylo, -2)
            shared += max(w, 0) * max(h, 0) * 8 / n
            gap += (((xlo + xhi) / 2) ** 2 + ((ylo + yhi) / 2) ** 2) ** 0.5 * 8 / n
            if w >= 0 and h >= 0:
                hits.append(1 + dt)
            held &= xlo >= -2 and ylo >= -2 and xhi <= 2 and yhi <= 2
        assert g["area"] == pytest.approx(area, abs=1e-3) and g["shared"] == pytest.approx(shared, abs=1e-3) and g["gap"] == pytest.approx(gap, abs=1e-3)
        assert g["meets"]["hit"] == bool(hits) and g["held"] == held
        if hits:
            assert g["meets"]["t0"] == pytest.approx(hits[0], abs=2e-3) and g["meets"]["t1"] == pytest.approx(hits[-1], abs=2e-3)


def test_nearest_and_pages(spark):
    t = boxes(spark, [(1, 0, 1, 0), (-1, 0, -1, 0), (0, 1, 0, 1), (5, 5, 5, 5)])
    assert select.nearest(t, S.Point(0, 0), 2).count() == 3
    assert select.nearest(t, S.Point(0, 0), 0).count() == 0
    assert [r["id"] for r in select.page(t, 1, 2).collect()] == [2, 3] and select.page(t, 3, 0).count() == 4
    assert select.contained(t, S.Segment(0, 0, 9, 9)).count() == 0


def test_normalize(spark):
    t = boxes(spark, [(-10, 1, -10, 1), (-5, 1, -5, 1)])
    assert [r["xlo"] for r in aggregate.normalize(t).orderBy("id").collect()] == [0, 100]
    assert [r["xlo"] for r in aggregate.normalize(t, compat=True).orderBy("id").collect()] == [0, 50]
    assert [r["ylo"] for r in aggregate.normalize(t).collect()] == [0, 0]


def test_wkt(spark):
    lines = [
        ("POLYGON ((1 2, 3 4, -5 6), (100 100, 101 101))\ta", (-5, 2, 3, 6)),
        ("MULTIPOLYGON (((0 0, 2 1)), ((9 9, 10 10)))", (0, 0, 2, 1)),
        ("GEOMETRYCOLLECTION (POLYGON ((0 0, 1 1)), POLYGON ((5 -5, 6 6)))", (0, -5, 6, 6)),
        ("LINESTRING (0 0, 1 1)", None),
    ]
    t = text.polygon_wkt(spark.createDataFrame([(i, v) for i, (v, _) in enumerate(lines)], "id long, value string"))
    got = {r["id"]: tuple(r)[1:] for r in text.accepted(t).collect()}
    assert got == {i: w for i, (_, w) in enumerate(lines) if w} and [r["id"] for r in text.rejected(t).collect()] == [3]
    quoted = ['x\t"POLYGON ((1 2, 3 4, -5 6), (100 100, 101 101))"\ta', '"LINESTRING (0 0, -1.5 1e1)",q', "no quotes"]
    t = text.quoted_wkt(spark.createDataFrame(list(enumerate(quoted)), "id long, value string"))
    assert sorted(tuple(r) for r in text.accepted(t).collect()) == [(0, -5, 2, 101, 101), (1, -1.5, 0, 0, 10)]


def test_text_files(spark, tmp_path):
    t = text.generate(spark, 500, seed=3)
    assert t.collect() == text.generate(spark, 500, seed=3).collect()
    text.write_mbr(t, str(tmp_path / "a"))
    back = text.read_mbr(spark, str(tmp_path / "a"))
    assert back.count() == 500 and back.agg(F.sum("id")).first()[0] == sum(range(500))
    (tmp_path / "b").write_text("1 7 0 0 1 1\n1 8 2 0 1 1\n1 9 NaN 0 1 1\n1 10 0 0 5 5")
    assert sorted(r["id"] for r in text.read_mbr(spark, str(tmp_path / "b")).collect()) == [7, 10]
    (tmp_path / "c").write_text("2 7 0 0 1 1\n")
    with pytest.raises(Exception, match="unknown operation"):
        text.read_mbr(spark, str(tmp_path / "c")).count()
    (tmp_path / "e").write_text("1 7 0 0 1 1\n1 8 0 0 1\n1 x 0 0 1 1\n1 9 2 0 1 1\n")
    assert [r["id"] for r in text.read_mbr(spark, str(tmp_path / "e")).collect()] == [7]
    assert text.mbr_rejects(spark.read.text(str(tmp_path / "e"))).count() == 3
    with pytest.raises(Exception, match="not a box"):
        text.read_mbr(spark, str(tmp_path / "e"), strict=True).count()
    (tmp_path / "d").write_text("a\nb\nc\n")
    assert [tuple(r) for r in text.numbered(spark, str(tmp_path / "d")).collect()] == [(0, "a"), (1, "b"), (2, "c")]
    (tmp_path / "f").mkdir()
    for name, n in (("a", 3), ("b", 2000), ("c", 5)):
        (tmp_path / "f" / name).write_text("".join(f"{name}{i}\n" for i in range(n)))
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4k")
    try:
        found = sorted(map(tuple, text.numbered(spark, str(tmp_path / "f")).collect()))
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert found == list(enumerate(f"{name}{i}" for name, n in (("a", 3), ("b", 2000), ("c", 5)) for i in range(n)))


def test_lines_and_intervals(spark):
    up, down, level, back, none = (S.Segment(0.0, 0.0, *xy) for xy in ((0.0, 2.0), (0.0, -2.0), (2.0, 0.0), (-2.0, 0.0), (0.0, 0.0)))
    at = S.Point(3.0, 1.0)
    assert [value(spark, S.signed_line_distance(s, at)) for s in (up, down, level, back, none)] == [-3, 3, 1, -1, 3]
    assert [value(spark, S.perpendicular_angle(s)) for s in (up, down, level, back, none)] == pytest.approx([0, 0, math.pi / 2, math.pi / 2, 0])
    assert value(spark, S.perpendicular_angle(S.Segment(0.0, 0.0, 1.0, -1.0))) == pytest.approx(math.pi / 4)
    same = lambda kind: value(spark, T.intervals_intersect(T.Interval(5.0, 5.0, kind), T.Interval(5.0, 5.0, kind)))
    assert same(T.CLOSED) and not same(T.RIGHT_OPEN)
    with pytest.raises(ValueError):
        T.Interval(2.0, 1.0)


def test_callback_source(spark, tmp_path):
    def read(part, parts):
        for i in range(part, 10, parts):
            yield (i, 0.0, 0.0, float(i), 1.0)

    target = str(tmp_path / "out")

    def write(rows):
        with open(target, "a") as f:
            f.writelines(f"{r['id']}\n" for r in rows)

    callback.register(spark, "called", read, write, partitions=3)
    t = spark.read.format("called").load()
    assert sorted(r["id"] for r in t.collect()) == list(range(10))
    t.coalesce(1).write.format("called").mode("append").save()
    assert sorted(map(int, open(target).read().split())) == list(range(10))


def test_index(spark, mixed, tmp_path):
    a, b = mixed
    index = BoxIndex(a, Options(leaf_capacity=10, near_minimum_overlap=4))
    assert index.is_valid() and index.leaves().agg(F.max("rows")).first()[0] <= 7
    index.save(str(tmp_path / "i"))
    again = BoxIndex.open(spark, str(tmp_path / "i"))
    assert again.rows.count() == a.count() and pairs(again.join(BoxIndex(b))) == pairs(join.naive_join(a, b))
    assert index.insert(b.limit(5)).rows.count() == a.count() + 5
    assert index.delete(a.limit(3)).rows.count() == a.count() - 3 and index.delete(boxes(spark, [(777, 0, 778, 1)])).rows.count() == a.count()
    assert again.is_valid() and again.leaves().count() == index.leaves().count()
    shifted = spark.read.parquet(str(tmp_path / "i" / "rows")).withColumn("xhi", F.col("xhi") + (F.col("id") == 5).cast("double") * 2000)
    shifted.write.parquet(str(tmp_path / "j" / "rows"))
    spark.read.parquet(str(tmp_path / "i" / "leaves")).write.parquet(str(tmp_path / "j" / "leaves"))
    assert not BoxIndex.open(spark, str(tmp_path / "j")).is_valid()
    paged = BoxIndex(a, Options(result_limit=3, result_offset=2))
    assert pairs(paged.join(BoxIndex(b))) == pairs(join.naive_join(a, b))[2:5] and paged.nearest(S.Point(0, 0), 9).count() == 3
    assert [r["found"] for r in layout.found(a, a.limit(2).unionAll(boxes(spark, [(777, 0, 778, 1)]))).collect()].count(True) == 2
    rows, seen = aggregate.observed(a)
    assert rows.count() == seen.get["rows"] == a.count() and seen.get["xhi"] == 1000
    with pytest.raises(ValueError):
        Options(fill=1.5)
    broken = layout.nodes(layout.str_leaves(a, 7)).withColumn("xlo", F.col("xlo") - 1)
    assert layout.faults(layout.str_leaves(a, 7), broken).count() > 0
    assert layout.level_sizes(15000) == [215, 4, 1]


def test_streams(spark, mixed, tmp_path):
    a, b = mixed
    a.withColumn("at", F.timestamp_seconds(F.col("id") * 30)).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(BOX + ", at timestamp").parquet(str(tmp_path / "in"))
    for name, df, mode in (("met", windows.join_static(stream.drop("at"), b, g=4.0, levels=4), "append"), ("seen", windows.intersecting(stream, S.Region(0, 0, 5, 5)), "append"), ("by_time", windows.counts_by_time(stream, "at", "10 minutes", "1 minute"), "complete")):
        df.writeStream.format("memory").queryName(name).outputMode(mode).trigger(availableNow=True).start().awaitTermination(120)
    assert pairs(spark.table("met")) == pairs(join.naive_join(a, b))
    assert spark.table("seen").count() == select.intersecting(a, S.Region(0, 0, 5, 5)).count()
    assert spark.table("by_time").agg(F.sum("rows")).first()[0] == a.count()


def test_plans(spark, tmp_path):
    text.generate(spark, 200).write.parquet(str(tmp_path / "p"))
    t = spark.read.parquet(str(tmp_path / "p"))
    plan = select.intersecting(t, S.Region(0, 0, 5, 5)).select("id")._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [IsNotNull" in plan and "LessThanOrEqual(xlo,5.0)" in plan
    plan = join.grid_join(t, t, g=1.0, levels=1)._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan
