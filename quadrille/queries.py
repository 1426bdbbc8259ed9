"""The queries over the driver's tables, each with its DuckDB statement."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import moving as M
from .functions import shapes as S
from .functions import temporal as T
from .operators import aggregate, join, layout, select
from .sources import text
from .views import view, view_sql

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}
MEET = "r.xlo <= s.xhi AND r.xhi >= s.xlo AND r.ylo <= s.yhi AND r.yhi >= s.ylo"
HOLD = "r.xlo <= s.xlo AND r.xhi >= s.xhi AND r.ylo <= s.ylo AND r.yhi >= s.yhi"
#: 2024-01-01 12:00 and 2024-01-02 00:00 in epoch seconds.
NOON, MIDNIGHT = 1704110400.0, 1704153600.0


def query(views: str, sql: str | None = None):
    """Registers a query that takes the named views, and its statement."""

    def add(f: Callable[..., DataFrame]) -> Callable[..., DataFrame]:
        names = views.split()
        QUERIES[f.__name__] = lambda spark, sf_dir: f(*(view(spark, sf_dir, n) for n in names))
        if sql is not None:
            SQL[f.__name__] = view_sql(*dict.fromkeys(names)) + sql
        return f

    return add


def window() -> S.Region:
    return S.Region(20, 20, 30, 30)


_COUNT = f"SELECT count(*)::bigint AS pairs, coalesce(sum(31 * r.id + s.id), 0)::bigint AS checksum FROM rect_r r, rect_s s WHERE {MEET}"


@query("rect_r rect_s", _COUNT)
def join_count(r, s):
    return join.count_pairs(join.grid_join(r, s))


@query("rect_r rect_s", _COUNT)
def join_count_planned(r, s):
    return join.count_pairs(join.plan_join(r, s))


@query("rect_r rect_s", _COUNT)
def join_count_tiles(r, s):
    return join.count_pairs(join.tile_join(r, s))


@query("rect_r rect_s", _COUNT)
def join_count_levels(r, s):
    """A grid far finer than the boxes, so that several levels take part."""
    return join.count_pairs(join.grid_join(r, s, g=0.05))


@query("rect_r rect_s", f"SELECT r.id AS id, s.id AS id_r FROM rect_r r, rect_s s WHERE {MEET}")
def join_pairs(r, s):
    return join.grid_join(r, s).select("id", "id_r")


def _join_sql(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The join in SQL text: cells, equality, predicate and owner cell."""
    for n in ("rect_r", "rect_s"):
        view(spark, sf_dir, n).createOrReplaceTempView(n)
    cells = "SELECT *, explode(sequence(floor(xlo), floor(xhi))) AS cx FROM {0}"
    both = "SELECT *, explode(sequence(floor(ylo), floor(yhi))) AS cy FROM (" + cells + ")"
    return spark.sql(
        f"SELECT count(r.id) AS intersections FROM ({both.format('rect_r')}) r JOIN ({both.format('rect_s')}) s ON r.cx = s.cx AND r.cy = s.cy "
        f"WHERE {MEET} AND r.cx = floor(greatest(r.xlo, s.xlo)) AND r.cy = floor(greatest(r.ylo, s.ylo))"
    )


QUERIES["join_sql"] = _join_sql
SQL["join_sql"] = view_sql("rect_r", "rect_s") + f"SELECT count(r.id)::bigint AS intersections FROM rect_r r, rect_s s WHERE {MEET}"


@query("rect_s pt", "SELECT count(*)::bigint AS pairs, coalesce(sum(31 * r.id + p.id), 0)::bigint AS checksum FROM rect_s r, pt p WHERE p.x BETWEEN r.xlo AND r.xhi AND p.y BETWEEN r.ylo AND r.yhi")
def join_count_naive(r, p):
    """All pairs compared, of two small tables."""
    return join.count_pairs(join.naive_join(r, p.select("id", F.col("x").alias("xlo"), F.col("y").alias("ylo"), F.col("x").alias("xhi"), F.col("y").alias("yhi"))))


@query("rect_r rect_s", f"SELECT r.id AS id, s.id AS id_r FROM rect_r r, rect_s s WHERE {HOLD}")
def join_contains(r, s):
    return join.contains_join(r, s).select("id", "id_r")


_CLIP = "greatest(r.xlo, s.xlo) AS cxlo, greatest(r.ylo, s.ylo) AS cylo, least(r.xhi, s.xhi) AS cxhi, least(r.yhi, s.yhi) AS cyhi"


@query("rect_r rect_s", f"SELECT id, id_r, cxlo, cylo, cxhi, cyhi, (cxhi - cxlo) * (cyhi - cylo) AS clip_area FROM (SELECT r.id AS id, s.id AS id_r, {_CLIP} FROM rect_r r, rect_s s WHERE {MEET})")
def join_clip_area(r, s):
    return join.with_clip(join.grid_join(r, s)).select("id", "id_r", "cxlo", "cylo", "cxhi", "cyhi", "clip_area")


@query("rect_r rect_s", f"SELECT floor(greatest(r.xlo, s.xlo) / 10)::bigint AS cx, floor(greatest(r.ylo, s.ylo) / 10)::bigint AS cy, count(*)::bigint AS pairs FROM rect_r r, rect_s s WHERE {MEET} GROUP BY ALL")
def join_count_by_cell(r, s):
    x, y = F.floor(F.greatest("xlo", "xlo_r") / 10), F.floor(F.greatest("ylo", "ylo_r") / 10)
    return join.grid_join(r, s).groupBy(x.alias("cx"), y.alias("cy")).agg(F.count("*").alias("pairs"))


@query("rect_r rect_s", f"SELECT r.id AS id FROM rect_r r WHERE EXISTS (SELECT 1 FROM rect_s s WHERE {MEET})")
def join_semi(r, s):
    return join.semi_join(r, s).select("id")


@query("rect_r rect_s", f"SELECT count(*)::bigint AS rows FROM rect_r r WHERE NOT EXISTS (SELECT 1 FROM rect_s s WHERE {MEET})")
def join_anti(r, s):
    return select.count(join.semi_join(r, s, anti=True))


@query("rect_s", f"SELECT r.id AS id, s.id AS id_r FROM rect_s r, rect_s s WHERE {MEET} AND r.id <> s.id")
def self_join_all(s):
    return join.self_join(s).select("id", "id_r")


_IN = "{0}.xlo <= 50 AND {0}.xhi >= 0 AND {0}.ylo <= 50 AND {0}.yhi >= 0"


@query("rect_s", f"SELECT r.id AS id, s.id AS id_r FROM rect_s r, rect_s s WHERE {MEET} AND r.id <> s.id AND {_IN.format('r')} AND {_IN.format('s')}")
def self_join_window(s):
    return join.self_join(s, S.Region(0, 0, 50, 50)).select("id", "id_r")


@query("rect_r", "SELECT id FROM rect_r WHERE xlo <= 30 AND xhi >= 20 AND ylo <= 30 AND yhi >= 20")
def window_intersects(r):
    return select.intersecting(r, window()).select("id")


@query("rect_r", "SELECT count(*)::bigint AS rows FROM rect_r WHERE xlo <= 30 AND xhi >= 20 AND ylo <= 30 AND yhi >= 20")
def window_count(r):
    return select.count(select.intersecting(r, window()))


@query("rect_r", "SELECT * FROM rect_r WHERE xlo >= 20 AND xhi <= 30 AND ylo >= 20 AND yhi <= 30")
def window_contains(r):
    return select.contained(r, window())


@query("rect_s rect_r", "SELECT r.id AS id, count(*)::bigint AS found FROM rect_s r, rect_r s WHERE " + MEET + " GROUP BY r.id")
def windows_batch(queries, data):
    """Many window queries at once."""
    return join.grid_join(queries, data).groupBy("id").agg(F.count("*").alias("found"))


@query("rect_r", "SELECT id FROM rect_r WHERE 60.5 BETWEEN xlo AND xhi AND 54.0 BETWEEN ylo AND yhi")
def point_location(r):
    return select.at_point(r, 60.5, 54.0).select("id")


def _turn(a: str, b: str, c: str) -> str:
    (ax, ay), (bx, by), (cx, cy) = (p.split() for p in (a, b, c))
    return f"(({bx} - {ax}) * ({cy} - {ay}) - ({cx} - {ax}) * ({by} - {ay}))"


def _cross_sql(p: str, q: str, u: str, v: str) -> str:
    """Segments p-q and u-v share a point, by orientations."""
    a, b, c, d = _turn(p, q, u), _turn(p, q, v), _turn(u, v, p), _turn(u, v, q)

    def on(t: str, z: str, m: str, n: str) -> str:
        (zx, zy), (mx, my), (nx, ny) = (w.split() for w in (z, m, n))
        return f"({t} = 0 AND {zx} BETWEEN least({mx}, {nx}) AND greatest({mx}, {nx}) AND {zy} BETWEEN least({my}, {ny}) AND greatest({my}, {ny}))"

    return f"(({a} > 0 AND {b} < 0 OR {a} < 0 AND {b} > 0) AND ({c} > 0 AND {d} < 0 OR {c} < 0 AND {d} > 0) OR {on(a, u, p, q)} OR {on(b, v, p, q)} OR {on(c, p, u, v)} OR {on(d, q, u, v)})"


def _box_line_sql(p: str, q: str) -> str:
    corners = ["xlo ylo", "xhi ylo", "xhi yhi", "xlo yhi"]
    inside = " OR ".join(f"({x} BETWEEN xlo AND xhi AND {y} BETWEEN ylo AND yhi)" for x, y in (e.split() for e in (p, q)))
    return f"({inside} OR " + " OR ".join(_cross_sql(p, q, a, b) for a, b in zip(corners, corners[1:] + corners[:1], strict=True)) + ")"


@query("rect_r", f"SELECT id FROM rect_r WHERE {_box_line_sql('10.0::double 10.0::double', '40.0::double 55.0::double')}")
def segment_intersects(r):
    return select.intersecting(r, S.Segment(10, 10, 40, 55)).select("id")


@query("seg", f"SELECT id FROM seg WHERE {_cross_sql('x1 y1', 'x2 y2', '0.0::double 0.0::double', '100.0::double 99.0::double')}")
def segments_cross(s):
    return s.where(S.intersects(S.Segment.of(), S.Segment(0, 0, 100, 99))).select("id")


_DX, _DY = "greatest(xlo - 50, 50 - xhi, 0)", "greatest(ylo - 50, 50 - yhi, 0)"


@query("rect_r", f"SELECT id FROM rect_r WHERE sqrt({_DX} * {_DX} + {_DY} * {_DY}) <= 7.5")
def ball_intersects(r):
    return select.intersecting(r, S.Ball(50, 50, 7.5)).select("id")


_FX, _FY = "greatest(abs(50 - xlo), abs(50 - xhi))", "greatest(abs(50 - ylo), abs(50 - yhi))"


@query("rect_r", f"SELECT id FROM rect_r WHERE sqrt({_FX} * {_FX} + {_FY} * {_FY}) <= 7.5")
def ball_contains(r):
    return select.contained(r, S.Ball(50, 50, 7.5)).select("id")


@query("ball", "SELECT a.id AS id, b.id AS id_r, sqrt((a.cx - b.cx) * (a.cx - b.cx) + (a.cy - b.cy) * (a.cy - b.cy)) <= a.r - b.r AS holds, greatest(greatest(sqrt((a.cx - b.cx) * (a.cx - b.cx) + (a.cy - b.cy) * (a.cy - b.cy)) - b.r, 0) - a.r, 0) AS apart FROM ball a, ball b WHERE sqrt((a.cx - b.cx) * (a.cx - b.cx) + (a.cy - b.cy) * (a.cy - b.cy)) <= a.r + b.r")
def balls_meet(b):
    """Pairs of balls by a grid join of their boxes."""
    box = S.mbr(S.Ball.of())
    t = b.select("*", box.xlo.alias("xlo"), box.ylo.alias("ylo"), box.xhi.alias("xhi"), box.yhi.alias("yhi"))
    p, q = S.Ball.of(), S.Ball(F.col("cx_r"), F.col("cy_r"), F.col("r_r"))
    out = join.grid_join(t, t).where(S.distance(p.middle, q.middle) <= p.r + q.r)
    return out.select("id", "id_r", S.contains(p, q).alias("holds"), S.distance(p, q).alias("apart"))


def _knn_sql(table: str, distance: str, k: int) -> str:
    return f"SELECT id, distance FROM (SELECT id, {distance} AS distance, rank() OVER (ORDER BY {distance}) AS place FROM {table}) WHERE place <= {k}"


@query("rect_r", _knn_sql("rect_r", f"sqrt({_DX} * {_DX} + {_DY} * {_DY})", 10))
def knn_point(r):
    return select.nearest(r, S.Point(50, 50), 10).select("id", "distance")


_RX, _RY = "greatest(xlo - 63, 60 - xhi, 0)", "greatest(ylo - 62, 60 - yhi, 0)"


@query("rect_r", _knn_sql("rect_r", f"sqrt({_RX} * {_RX} + {_RY} * {_RY})", 25))
def knn_region(r):
    return select.nearest(r, S.Region(60, 60, 63, 62), 25).select("id", "distance")


@query("rect_s", _knn_sql("rect_s", f"greatest(sqrt({_DX} * {_DX} + {_DY} * {_DY}) - 2.5, 0)", 12))
def knn_ball(s):
    return select.nearest(s, S.Ball(50, 50, 2.5), 12).select("id", "distance")


@query("rect_r", _knn_sql("rect_r", "abs(xlo - 33) + abs(ylo - 44)", 15))
def knn_custom_metric(r):
    d = F.abs(F.col("xlo") - 33) + F.abs(F.col("ylo") - 44)
    return select.nearest(r, S.Point(33, 44), 15, d).select("id", "distance")


@query("rect_r", "SELECT id FROM rect_r WHERE xlo <= 30 AND xhi >= 20 AND ylo <= 30 AND yhi >= 20 ORDER BY id LIMIT 20 OFFSET 40")
def page_ids(r):
    return select.page(select.intersecting(r, window()).select("id"), 40, 20)


_BOX = "min(xlo) AS xlo, min(ylo) AS ylo, max(xhi) AS xhi, max(yhi) AS yhi"


@query("rect_r", f"SELECT {_BOX} FROM rect_r")
def bounds(r):
    return aggregate.bounds(r)


def _scaled(shift: int, top: str) -> str:
    cols = ", ".join(f"coalesce(({c} - {c[0]}0) / nullif({c[0]}1 - {c[0]}0, 0) * 100.0::double, 0) AS {c}" for c in ("xlo", "ylo", "xhi", "yhi"))
    shifted = ", ".join(f"{c} - {shift} AS {c}" for c in ("xlo", "ylo", "xhi", "yhi"))
    return f", t AS (SELECT id, {shifted} FROM rect_r), e AS (SELECT min(xlo) AS x0, min(ylo) AS y0, {top.format('max(xhi)')} AS x1, {top.format('max(yhi)')} AS y1 FROM t) SELECT id, {cols} FROM t, e"


@query("rect_r", _scaled(0, "{}"))
def extent_normalize(r):
    return aggregate.normalize(r)


@query("rect_r", _scaled(200, "greatest({}, 2.2250738585072014e-308)"))
def extent_normalize_compat(r):
    return aggregate.normalize(r.select("id", *((F.col(c) - 200).alias(c) for c in join.SIDES)), compat=True)


for _n in ("extent_normalize", "extent_normalize_compat"):
    SQL[_n] = SQL[_n].replace(" , t AS", ", t AS")


@query("rect_grp", f"SELECT grp, {_BOX} FROM rect_grp GROUP BY grp")
def group_mbr(r):
    return aggregate.bounds(r, "grp")


@query("trect", f"SELECT (id % 10)::bigint AS grp, {_BOX}, min(t0) AS t0, max(t1) AS t1 FROM trect GROUP BY ALL")
def group_mbr_time(t):
    return aggregate.bounds_in_time(t.withColumn("grp", F.col("id") % 10), "grp")


_R = "({0} + v{0} * ({1} - t0))"
_AT = str(MIDNIGHT) + "::double"


@query("mrect", f"SELECT (id % 10)::bigint AS grp, {', '.join(f'round({f}({_R.format(c, _AT)}), 6) AS {c}, {f}(v{c}) AS v{c}' for c, f in (('xlo', 'min'), ('ylo', 'min'), ('xhi', 'max'), ('yhi', 'max')))}, max(t1) AS t1 FROM mrect GROUP BY ALL")
def group_mbr_moving(t):
    out = aggregate.moving_bounds(t.withColumn("grp", F.col("id") % 10), F.lit(MIDNIGHT), "grp")
    return out.select("grp", *(F.round(c, 6).alias(c) for c in join.SIDES), *(f"v{c}" for c in join.SIDES), "t1")


@query("rect_r", "SELECT floor(xlo / 5)::bigint AS cx, floor(ylo / 5)::bigint AS cy, count(*)::bigint AS rows FROM rect_r GROUP BY ALL")
def cell_histogram(r):
    return aggregate.by_cell(r, 5.0)


@query("rect_r", "SELECT (id % 16)::bigint AS part, count(*)::bigint AS rows FROM rect_r GROUP BY ALL")
def partition_histogram(r):
    return aggregate.by_partition(r, 16, "id")


_SPAN = f"t0 < {MIDNIGHT} AND t1 > {NOON}"


@query("tpoint", f"SELECT id FROM tpoint WHERE x BETWEEN 0 AND 50 AND y BETWEEN 0 AND 50 AND {_SPAN}")
def time_intersects(t):
    return select.in_time(t, S.Region(0, 0, 50, 50), T.Span(NOON, MIDNIGHT), S.Point.of()).select("id")


@query("trect", f"SELECT id FROM trect WHERE xlo >= 0 AND xhi <= 50 AND ylo >= 0 AND yhi <= 50 AND t0 >= {NOON} AND t1 <= {MIDNIGHT}")
def time_contains(t):
    return select.covered_in_time(t, S.Region(0, 0, 50, 50), T.Span(NOON, MIDNIGHT)).select("id")


_NEAR = " OR ".join(f"abs({c} - {e}) <= 2.220446049250313e-16" for c, e in (("xlo", "floor(xlo * 10) / 10"), ("xhi", "floor(xhi * 10) / 10"), ("ylo", "floor(ylo)"), ("yhi", "floor(yhi)")))


def _coarse() -> S.Region:
    """Each row's own box on a coarse raster: shares a side with some rows' boxes."""
    return S.Region(F.floor(F.col("xlo") * 10) / 10, F.floor("ylo"), F.floor(F.col("xhi") * 10) / 10, F.floor("yhi"))


@query("trect", f"SELECT id FROM trect WHERE ({_NEAR}) AND t1 > {NOON}")
def time_touches(t):
    return t.where(T.touches_in_time(S.Region.of(), T.Span("t0", "t1"), _coarse(), T.Span(NOON, 1e12))).select("id")


@query("trect", "SELECT id, (abs(xlo - floor(xlo * 10) / 10) <= 2.220446049250313e-16) AS same, (abs(t0 - floor(t0 / 3) * 3) <= 2.220446049250313e-16) AS same_period FROM trect")
def time_equal(t):
    """Boxes and periods with one side moved to a raster, against themselves."""
    box, moved = S.Region.of(), S.Region(F.floor(F.col("xlo") * 10) / 10, "ylo", "xhi", "yhi")
    span, late = T.Interval("t0", "t1"), T.Interval(F.floor(F.col("t0") / 3) * 3, "t1")
    return t.select("id", T.equal_in_time(box, span, moved, span).alias("same"), T.interval_equal(span, late).alias("same_period"))


_IN50 = "x BETWEEN 0 AND 50 AND y BETWEEN 0 AND 50"


@query("tpoint", f"SELECT id, ({_IN50} AND t0 >= {NOON} AND t1 <= {MIDNIGHT}) AS held, ({_IN50} AND NOT (t0 >= {NOON} AND t1 <= {MIDNIGHT})) AS held_compat, (x = floor(x) AND {_SPAN}) AS touched, (x = floor(x) AND NOT ({_SPAN})) AS touched_compat FROM tpoint")
def time_points(t):
    """Points in a box and a period, and on a side of a box, also with the known slip of time."""
    box, span, own = S.Region(0, 0, 50, 50), T.Span(NOON, MIDNIGHT), T.Span("t0", "t1")
    p, around = S.Point.of(), S.Region(F.floor("x"), F.col("y") - 1, F.floor("x") + 2, F.col("y") + 1)
    return t.select(
        "id", T.contains_in_time(box, span, p, own).alias("held"), T.contains_in_time(box, span, p, own, compat=True).alias("held_compat"),
        T.touches_in_time(around, span, p, own).alias("touched"), T.touches_in_time(around, span, p, own, compat=True).alias("touched_compat"),
    )


@query("tpoint", f"SELECT id, (CASE WHEN t0 > {MIDNIGHT} OR t1 < {NOON} THEN false WHEN t0 = {MIDNIGHT} THEN true WHEN t1 = {NOON} THEN false ELSE true END) AS meets, (t0 >= {NOON} AND t1 <= {MIDNIGHT}) AS inside FROM tpoint")
def interval_relations(t):
    """Right-open periods against a closed one."""
    a, b = T.Interval("t0", "t1"), T.Interval(NOON, MIDNIGHT, T.CLOSED)
    return t.select("id", T.intervals_intersect(a, b).alias("meets"), T.interval_contains(b, a).alias("inside"))


_CLAMP = f"greatest(t0, least(t1, {_AT}))"


@query("mpoint", f"SELECT id, round(x + vx * ({_CLAMP} - t0), 6) AS x, round(y + vy * ({_CLAMP} - t0), 6) AS y FROM mpoint")
def snapshot_points(t):
    return select.snapshot(t, MIDNIGHT, point=True).select("id", F.round("x", 6).alias("x"), F.round("y", 6).alias("y"))


@query("mrect", f"SELECT id, {', '.join(f'round({c} + v{c} * ({_CLAMP} - t0), 6) AS {c}' for c in ('xlo', 'ylo', 'xhi', 'yhi'))} FROM mrect")
def snapshot_boxes(t):
    return select.snapshot(t, MIDNIGHT).select("id", *(F.round(c, 6).alias(c) for c in join.SIDES))


def _still(t0: float = NOON, t1: float = MIDNIGHT, side: float = 50) -> M.Moving:
    return M.Moving.fixed(S.Region(0, 0, side, side), T.Span(t0, t1))


def _at(c: str, t: str = _AT) -> str:
    return _R.format(c, t)


#: A time of each row's own, for a quarter of the rows after its end.
_OWN = "(t0 + id % 4 * 250.0::double)"


def _own_time():
    return F.col("t0") + F.col("id") % 4 * 250.0


@query("mrect", f"SELECT id FROM mrect WHERE {_OWN} < t1 AND {_at('xlo', _OWN)} <= 60 AND {_at('xhi', _OWN)} >= 0 AND {_at('ylo', _OWN)} <= 60 AND {_at('yhi', _OWN)} >= 0")
def moving_at_time(t):
    return t.where(M.intersects_at(M.Moving.box(), _still(0.0, 1e12, 60), _own_time())).select("id")


@query("mrect", f"SELECT id FROM mrect WHERE {_OWN} < t1 AND {_at('xlo', _OWN)} >= 0 AND {_at('xhi', _OWN)} <= 60 AND {_at('ylo', _OWN)} >= 0 AND {_at('yhi', _OWN)} <= 60")
def moving_contains_at_time(t):
    return t.where(M.contains_at(_still(0.0, 1e12, 60), M.Moving.box(), _own_time())).select("id")


@query("mrect", f"SELECT id, {', '.join(f'v{c} AS v{c}' for c in ('xlo', 'ylo', 'xhi', 'yhi'))}, (vxhi < vxlo OR vyhi < vylo) AS shrinking FROM mrect")
def moving_speeds(t):
    m = M.Moving.box()
    v = m.velocity()
    return t.select("id", *(getattr(v, c).alias(f"v{c}") for c in join.SIDES), m.shrinking().alias("shrinking"))


@query("mrect", "SELECT id, xlo, ylo, xhi, greatest(yhi, 50.0::double) AS yhi, least(vxlo, 0.0::double) AS vxlo, least(vylo, 0.0::double) AS vylo, greatest(vxhi, 0.0::double) AS vxhi, greatest(vyhi, 0.0::double) AS vyhi FROM (SELECT id, least(xlo, 0.0::double) AS xlo, least(ylo, 0.0::double) AS ylo, greatest(xhi, 50.0::double) AS xhi, yhi, vxlo, vylo, vxhi, vyhi FROM mrect)")
def moving_union(t):
    """Each moving box joined with a fixed one, from the box's own start on."""
    u = M.union_in_time(M.Moving.box(), _still(0.0, 1e12), F.col("t0"))
    names = [("xlo", u.low[0]), ("ylo", u.low[1]), ("xhi", u.high[0]), ("yhi", u.high[1])]
    return t.select("id", *(side.at.alias(c) for c, side in names), *(side.v.alias(f"v{c}") for c, side in names))


@query("mrect", f"SELECT id, round(distance, 6) AS distance FROM (SELECT id, distance, rank() OVER (ORDER BY distance) AS place FROM (SELECT id, sqrt(greatest(xlo - 50, 50 - xhi, 0) * greatest(xlo - 50, 50 - xhi, 0) + greatest(ylo - 50, 50 - yhi, 0) * greatest(ylo - 50, 50 - yhi, 0)) AS distance FROM (SELECT id, {', '.join(f'{c} + v{c} * ({_CLAMP} - t0) AS {c}' for c in ('xlo', 'ylo', 'xhi', 'yhi'))} FROM mrect))) WHERE place <= 10")
def knn_at_time(t):
    """Nearest moving boxes at a time."""
    return select.nearest(select.snapshot(t, MIDNIGHT), S.Point(50, 50), 10).select("id", F.round("distance", 6).alias("distance"))


def _when(parts: list[tuple[str, str]], rest: str) -> str:
    """Hits of inequalities gap + speed * t <= 0 within (p0, p1), t from p0."""
    first = "greatest(p0" + "".join(f", CASE WHEN {v} < 0 THEN p0 - ({g}) / ({v}) ELSE p0 END" for g, v in parts) + ")"
    last = "least(p1" + "".join(f", CASE WHEN {v} > 0 THEN p0 - ({g}) / ({v}) ELSE p1 END" for g, v in parts) + ")"
    never = " AND ".join(f"NOT ({v} = 0 AND {g} > 0)" for g, v in parts)
    return f", w AS (SELECT id, {first} AS f, {last} AS l, p1, p0, ({never}) AS ok FROM (SELECT *, greatest(t0, {NOON}::double) AS p0, least(t1, {_AT}) AS p1 FROM {rest})) SELECT id, round(f - p0, 6) AS since, round(l - p0, 6) AS until FROM w WHERE ok AND p0 < p1 AND f <= l AND f < p1"


def _p(c: str) -> str:
    return f"({c} + v{c} * (p0 - t0))"


def _when_columns(t: DataFrame, meets: str = "meets") -> DataFrame:
    p0 = F.greatest(F.col("t0"), F.lit(NOON))
    return t.select("id", F.round(F.col(f"{meets}.t0") - p0, 6).alias("since"), F.round(F.col(f"{meets}.t1") - p0, 6).alias("until"))


@query("mrect", _when([(f"{_p('xlo')} - 50", "vxlo"), (f"0 - {_p('xhi')}", "(-vxhi)"), (f"{_p('ylo')} - 50", "vylo"), (f"0 - {_p('yhi')}", "(-vyhi)")], "mrect"))
def moving_in_time(t):
    return _when_columns(select.moving_in_time(t, S.Region(0, 0, 50, 50), T.Span(NOON, MIDNIGHT)))


@query("mpoint", _when([(f"{_p('x')} - 50", "vx"), (f"0 - {_p('x')}", "(-vx)"), (f"{_p('y')} - 50", "vy"), (f"0 - {_p('y')}", "(-vy)")], "mpoint"))
def moving_point_in_time(t):
    return _when_columns(select.moving_in_time(t, S.Region(0, 0, 50, 50), T.Span(NOON, MIDNIGHT), point=True))


for _n in ("moving_in_time", "moving_point_in_time"):
    SQL[_n] = SQL[_n].replace(" , w AS", ", w AS")


@query("mrect", "SELECT id FROM mrect WHERE " + " AND ".join(f"{_R.format(lo, t)} >= 0 AND {_R.format(hi, t)} <= 50" for lo, hi in (("xlo", "xhi"), ("ylo", "yhi")) for t in ("t0", "t1")) + f" AND t0 >= {NOON} AND t1 <= {MIDNIGHT}")
def moving_contains(t):
    return t.where(M.contains_during(_still(), M.Moving.box())).select("id")


_BOTH_ENDS = "{0} BETWEEN 0 AND 50 AND {1} BETWEEN 0 AND 50"


def _point_at(t: str) -> str:
    return _BOTH_ENDS.format(_at("x", t), _at("y", t))


@query("mpoint", f"SELECT id FROM mpoint WHERE {_point_at('t0')} AND {_point_at('t1')} AND t0 >= {NOON} AND t1 <= {MIDNIGHT}")
def moving_point_contains(t):
    return t.where(M.contains_during(_still(), M.Moving.point())).select("id")


_MID = "(t0 + 300.0::double)"


@query("mpoint", f"SELECT id FROM mpoint WHERE {_point_at(_MID)} AND {_point_at('t1')} AND {_MID} >= {NOON} AND t1 <= {MIDNIGHT}")
def moving_point_contains_after(t):
    """Held from the middle of each point's own period on."""
    return t.where(M.contains_after(_still(), M.Moving.point(), F.col("t0") + 300)).select("id")


@query("mrect", "SELECT id, round(h * x * y + h * h * (x * v + u * y) / 2 + h * h * h * u * v / 3, 4) AS swept FROM (SELECT id, t1 - t0 AS h, xhi - xlo AS x, yhi - ylo AS y, vxhi - vxlo AS u, vyhi - vylo AS v FROM mrect)")
def swept_area(t):
    return t.select("id", F.round(M.swept_area(M.Moving.box()), 4).alias("swept"))


@query("mrect", "SELECT id, round(h * (x + y) + h * h * (u + v) / 2, 4) AS swept FROM (SELECT id, t1 - t0 AS h, xhi - xlo AS x, yhi - ylo AS y, vxhi - vxlo AS u, vyhi - vylo AS v FROM mrect)")
def swept_surface(t):
    return t.select("id", F.round(M.swept_surface(M.Moving.box()), 4).alias("swept"))


_PARTS = "SELECT id, h, x, y, z, u, v, w FROM (SELECT id, t1 - t0 AS h, xhi - xlo AS x, yhi - ylo AS y, (id % 7)::double AS z, vxhi - vxlo AS u, vyhi - vylo AS v, id % 3 / 100.0::double AS w FROM mrect)"


@query("mrect", f"SELECT id, round(h * x + h * h * u / 2, 4) AS swept_line, round(h * x * y * z + h * h * (u * y * z + x * v * z + x * y * w) / 2 + h * h * h * (u * v * z + u * y * w + x * v * w) / 3 + h * h * h * h * u * v * w / 4, 2) AS swept_solid FROM ({_PARTS})")
def swept_extents(t):
    """Swept measures of one and three dimensions."""
    m = M.Moving.box()
    x, y = M._extents(m, m.span.t0)
    z = ((F.col("id") % 7).cast("double"), F.col("id") % 3 / 100.0)
    h = m.span.t1 - m.span.t0
    return t.select("id", F.round(M.swept_measure([x], h), 4).alias("swept_line"), F.round(M.swept_measure([x, y, z], h), 2).alias("swept_solid"))


_CENTER_SQL = """, c AS (SELECT id, t1 - t0 AS h, 25 - (xlo + xhi) / 2 AS dx, 25 - (ylo + yhi) / 2 AS dy, -(vxlo + vxhi) / 2 AS wx, -(vylo + vyhi) / 2 AS wy FROM mrect),
q AS (SELECT id, h, wx * wx + wy * wy AS a, dx * dx + dy * dy AS d, dx * wx + dy * wy AS b FROM c)
SELECT id, round(CASE WHEN a = 0 THEN h * sqrt(d) ELSE (z1 * r1 - z0 * r0 + CASE WHEN o > 0 THEN o * (asinh(z1 / sqrt(o)) - asinh(z0 / sqrt(o))) ELSE 0 END) / (2 * sqrt(a)) END, 3) AS travelled
FROM (SELECT *, sqrt(z0 * z0 + o) AS r0, sqrt(z1 * z1 + o) AS r1 FROM (SELECT *, CASE WHEN a = 0 THEN 0 ELSE sqrt(a) * b / a END AS z0, CASE WHEN a = 0 THEN 0 ELSE sqrt(a) * (h + b / a) END AS z1, CASE WHEN a = 0 THEN 0 ELSE greatest(d - b * b / a, 0) END AS o FROM q))"""


@query("mrect", _CENTER_SQL)
def center_distance(t):
    still = M.Moving.fixed(S.Region(0, 0, 50, 50), T.Span(0.0, 1e12))
    return t.select("id", F.round(M.center_distance(M.Moving.box(), still), 3).alias("travelled"))


SQL["center_distance"] = SQL["center_distance"].replace(" , c AS", ", c AS")


def _common(k: str, t: str) -> str:
    return f"greatest(least({k}hi + v{k}hi * {t}, 50.0::double) - greatest({k}lo + v{k}lo * {t}, 0.0::double), 0.0::double)"


_MEETS = ", ".join(f"({side} - {c}) / nullif(v{c}, 0)" for c in ("xlo", "ylo", "xhi", "yhi") for side in ("0.0::double", "50.0::double"))
_PIECES = " + ".join(f"{w} * {_common('x', t)} * {_common('y', t)}" for w, t in ((1, "t"), (4, "((t + e) / 2)"), (1, "e")))
_OVERLAP_SQL = f""", c AS (SELECT *, t1 - t0 AS h FROM mrect), k AS (SELECT *, list_distinct(list_filter([0.0::double, h, {_MEETS}], lambda t: t >= 0 AND t <= h)) AS cuts FROM c),
u AS (SELECT * EXCLUDE (cuts), unnest(cuts) AS t FROM k), p AS (SELECT *, lead(t) OVER (PARTITION BY id ORDER BY t) AS e FROM u)
SELECT id, round(coalesce(sum(({_PIECES}) * (e - t) / 6) FILTER (e IS NOT NULL), 0), 3) AS shared FROM p GROUP BY id"""


@query("mrect", _OVERLAP_SQL)
def overlap_integral(t):
    """Piecewise integral over sorted crossings."""
    still = M.Moving.fixed(S.Region(0, 0, 50, 50), T.Span(0.0, 1e12))
    return t.select("id", F.round(M.overlap_integral(M.Moving.box(), still), 3).alias("shared"))


SQL["overlap_integral"] = SQL["overlap_integral"].replace(" , c AS", ", c AS")


_LEAVES = """, n AS (SELECT ceil(count(*) / 70.0) AS p FROM rect_r), s AS (SELECT ceil(sqrt(p))::bigint * 70 AS rows FROM n),
x AS (SELECT *, row_number() OVER (ORDER BY xlo + xhi, id) - 1 AS rx FROM rect_r), y AS (SELECT x.*, rx // s.rows AS slab, s.rows AS per FROM x, s),
z AS (SELECT *, slab * (per // 70) + (row_number() OVER (PARTITION BY slab ORDER BY ylo + yhi, id) - 1) // 70 AS leaf FROM y) """


@query("rect_r", _LEAVES + f"SELECT leaf::bigint AS leaf, count(*)::bigint AS rows, {_BOX}, sum(id)::bigint AS id_sum FROM z GROUP BY leaf")
def str_leaves(r):
    return layout.nodes(layout.str_leaves(r)).select("leaf", F.col("rows").cast("long").alias("rows"), *join.SIDES, F.aggregate("ids", F.lit(0).cast("long"), lambda a, x: a + x).alias("id_sum"))


@query("rect_r", _LEAVES + "SELECT sum(c)::bigint AS rows, count(*)::bigint AS leaves, max(c)::bigint AS fullest, (1 + ceil(ln(count(*)) / ln(70) - 1e-12))::bigint AS height FROM (SELECT count(*) AS c FROM z GROUP BY leaf)")
def layout_stats(r):
    return layout.statistics(layout.str_leaves(r))


@query("rect_r", _LEAVES + "SELECT leaf::bigint AS leaf FROM z GROUP BY leaf HAVING leaf % 3 = 0 OR min(xlo) < min(xlo) FILTER (id % 100 <> 7) OR min(ylo) < min(ylo) FILTER (id % 100 <> 7) OR max(xhi) > max(xhi) FILTER (id % 100 <> 7) OR max(yhi) > max(yhi) FILTER (id % 100 <> 7)")
def layout_valid(r):
    """Leaves whose description no longer fits: a third were spoilt, and then every hundredth row left."""
    placed = layout.str_leaves(r)
    described = layout.nodes(placed).withColumn("xlo", F.when(F.col("leaf") % 3 == 0, F.col("xlo") - 1).otherwise(F.col("xlo")))
    return layout.faults(placed.where("id % 100 <> 7"), described)


@query("rect_r", _LEAVES + "SELECT leaf::bigint AS leaf, sum(id)::bigint AS id_sum FROM z GROUP BY leaf HAVING min(xlo) >= 10 AND min(ylo) >= 10 AND max(xhi) <= 80 AND max(yhi) <= 80")
def covered_leaves(r):
    """Ids by leaf, of the leaves that lie in a window as a whole."""
    held = select.contained(layout.nodes(layout.str_leaves(r)), S.Region(10, 10, 80, 80))
    return held.select("leaf", F.aggregate("ids", F.lit(0).cast("long"), lambda a, x: a + x).alias("id_sum"))


for _n in ("str_leaves", "layout_stats", "layout_valid", "covered_leaves"):
    SQL[_n] = SQL[_n].replace(" , n AS", ", n AS")


@query("rect_r rect_s", "SELECT count(*)::bigint AS rows FROM (SELECT * FROM rect_r UNION ALL SELECT * FROM rect_s) WHERE xlo <= 30 AND xhi >= 20 AND ylo <= 30 AND yhi >= 20")
def insert_then_count(r, s):
    return select.count(select.intersecting(layout.insert(r, s), window()))


@query("rect_r rect_s", "SELECT count(*)::bigint AS rows FROM rect_r r WHERE NOT EXISTS (SELECT 1 FROM rect_s s WHERE s.id = r.id)")
def delete_then_count(r, s):
    return select.count(layout.delete(r, s))


@query("rect_r rect_s", "SELECT s.id AS id, (r.id IS NOT NULL) AS found FROM rect_s s LEFT JOIN rect_r r ON r.id = s.id AND s.id % 3 = 0")
def delete_found(r, s):
    """Which of the rows to delete are there; two thirds were moved before."""
    moved = s.withColumn("xlo", F.when(F.col("id") % 3 == 0, F.col("xlo")).otherwise(F.col("xlo") - 1))
    return layout.found(r, moved).select("id", "found")


@query("rect_s rect_r", f"SELECT r.id AS id, s.id AS id_r FROM rect_s r LEFT JOIN (SELECT * FROM rect_r WHERE id % 5 = 0) s ON {MEET}")
def join_left_outer(s, r):
    return join.outer_join(s, r.where("id % 5 = 0")).select("id", "id_r")


@query("pt rect_r", "SELECT p.id AS id, r.id AS id_r FROM pt p JOIN rect_r r ON p.x BETWEEN r.xlo AND r.xhi AND p.y BETWEEN r.ylo AND r.yhi")
def points_located(p, r):
    """Many point queries at once."""
    at = p.select("id", F.col("x").alias("xlo"), F.col("y").alias("ylo"), F.col("x").alias("xhi"), F.col("y").alias("yhi"))
    return join.grid_join(at, r).select("id", "id_r")


_EPS = "2.220446049250313e-16"


@query("rect_r", f"SELECT id, (xhi - xlo) * (yhi - ylo) AS area, (xlo + xhi) / 2 AS cx, (ylo + yhi) / 2 AS cy, ((xhi - xlo) + (yhi - ylo)) * 2 AS margin, sqrt({_RX} * {_RX} + {_RY} * {_RY}) AS distance, coalesce(CASE WHEN xlo <= 63 AND xhi >= 60 AND ylo <= 62 AND yhi >= 60 THEN (least(xhi, 63) - greatest(xlo, 60)) * (least(yhi, 62) - greatest(ylo, 60)) END, 0) AS shared, (abs(xlo - 60) <= {_EPS} OR abs(xhi - 63) <= {_EPS} OR abs(ylo - 60) <= {_EPS} OR abs(yhi - 62) <= {_EPS}) AS touches FROM rect_r")
def geom_scalars(r):
    b, q = S.Region.of(), S.Region(60, 60, 63, 62)
    c = S.center(b)
    return r.select("id", S.area(b).alias("area"), c.x.alias("cx"), c.y.alias("cy"), S.margin(b).alias("margin"), S.distance(b, q).alias("distance"), S.clip_area(b, q).alias("shared"), S.touches(b, q).alias("touches"))


@query("ball", f"SELECT id, abs(sqrt((cx - (cx + r)) * (cx - (cx + r))) - r) <= {_EPS} AS touches, abs(greatest(cx + r - cx, 0) - r) <= {_EPS} AS touches_box, pi() * r * r AS area FROM ball")
def ball_touches(b):
    """Balls against the point and the box at the end of their radius."""
    ball, end = S.Ball.of(), F.col("cx") + F.col("r")
    y = F.col("cy")
    return b.select("id", S.touches(ball, S.Point(end, y)).alias("touches"), S.touches(ball, S.Region(end, y - 1, end + 1, y + 1)).alias("touches_box"), S.area(ball).alias("area"))


@query("rect_r", "SELECT id, (xhi - xlo) * (yhi - ylo) * 3 AS volume, ((xhi - xlo) + (yhi - ylo) + 3) * 4 AS margin, (xlo <= 60 AND xhi >= 20 AND ylo <= 60 AND yhi >= 20 AND id % 10 <= 5 AND id % 10 + 3 >= 4) AS meets, (xlo >= 20 AND xhi <= 60 AND ylo >= 20 AND yhi <= 60 AND id % 10 >= 4 AND id % 10 + 3 <= 5) AS held, ylo AS second, 2 AS dimension FROM rect_r")
def geom_solid(r):
    """Boxes of three dimensions, as arrays."""
    z = (F.col("id") % 10).cast("double")
    lo, hi = F.array(F.col("xlo"), F.col("ylo"), z), F.array(F.col("xhi"), F.col("yhi"), z + 3)
    low, high = (F.array(*(F.lit(float(v)) for v in vs)) for vs in ((20, 20, 4), (60, 60, 5)))
    return r.select(
        "id", S.area_nd(lo, hi).alias("volume"), S.margin_nd(lo, hi).alias("margin"), S.intersects_nd(lo, hi, low, high).alias("meets"), S.contains_nd(low, high, lo, hi).alias("held"),
        S.coordinate(lo, 1).alias("second"), S.dimension(S.Region.of()).alias("dimension"),
    )


_D = f"(CASE WHEN abs(x2 - x1) <= {_EPS} THEN (CASE WHEN y1 < y2 THEN x1 - {{0}} ELSE {{0}} - x1 END) WHEN abs(y2 - y1) <= {_EPS} THEN (CASE WHEN x1 < x2 THEN {{1}} - y1 ELSE y1 - {{1}} END) ELSE ((x1 - {{0}}) * (y2 - y1) - (x2 - x1) * (y1 - {{1}})) / nullif(sqrt((x2 - x1) * (x2 - x1) + (y2 - y1) * (y2 - y1)), 0) END)"


@query("seg", f"SELECT id, round(abs({_D.format(50, 50)}), 6) AS distance, round({_D.format(50, 50)}, 6) AS signed, round(greatest({', '.join(_D.format(x, y) for x in (20, 30) for y in (20, 30))}), 6) AS farthest, round(CASE WHEN abs(x1 - x2) <= {_EPS} THEN 0 WHEN abs(y1 - y2) <= {_EPS} THEN pi() / 2 ELSE atan(-(x1 - x2) / nullif(y1 - y2, 0)) END, 6) AS angle FROM seg")
def line_distance(s):
    line, p = S.Segment.of(), S.Point(50, 50)
    return s.select("id", F.round(S.line_distance(line, p), 6).alias("distance"), F.round(S.signed_line_distance(line, p), 6).alias("signed"), F.round(S.farthest_line_distance(line, window()), 6).alias("farthest"), F.round(S.perpendicular_angle(line), 6).alias("angle"))


@query("rect_r", "SELECT id, round(xlo, 9) AS xlo, round(ylo, 9) AS ylo, round(xhi, 9) AS xhi, round(yhi, 9) AS yhi FROM rect_r WHERE id % 7 != 3")
def mbr_text_lines(r):
    """Box rows as text and read again from it, every seventh line spoilt."""
    return _rounded(text.boxes_of(_spoilt(r)))


@query("rect_r", "SELECT (id % 14 // 7)::bigint AS kind, count(*)::bigint AS rows FROM rect_r WHERE id % 7 = 3 GROUP BY ALL")
def mbr_text_rejects(r):
    """The spoilt lines by what is wrong: a field too few, or sides the wrong way round."""
    f = F.size(F.split("value", " "))
    return text.mbr_rejects(_spoilt(r)).groupBy((f - 5).cast("long").alias("kind")).agg(F.count("*").alias("rows"))


def _spoilt(r: DataFrame) -> DataFrame:
    bad = r.where("id % 7 = 3").select("id", "xlo", "ylo", (F.col("xlo") - 1).alias("xhi"), "yhi")
    short = F.regexp_replace("value", " [^ ]*$", "")
    lines = text.mbr_lines(bad)
    odd = F.get(F.split("value", " "), F.lit(1)).cast("long") % 14 >= 7
    return text.mbr_lines(r.where("id % 7 != 3")).unionAll(lines.select(F.when(odd, F.col("value")).otherwise(short).alias("value")))


def _line(s: DataFrame, quoted: bool) -> DataFrame:
    """Geometry text made of boxes: a ring and, in the unquoted form, a hole that does not count."""
    ring = F.format_string("%.15g %.15g, %.15g %.15g, %.15g %.15g", F.col("xlo"), F.col("ylo"), F.col("xhi"), F.col("ylo"), F.col("xhi"), F.col("yhi"))
    if quoted:
        return s.select("id", F.concat(F.lit('a,"POLYGON (('), ring, F.lit('))",b')).alias("value"))
    return s.select("id", F.concat(F.lit("POLYGON (("), ring, F.lit("), (-9 -9, 999 999))\tb")).alias("value"))


def _rounded(t: DataFrame) -> DataFrame:
    return t.select("id", *(F.round(c, 9).alias(c) for c in join.SIDES))


@query("rect_s", "SELECT id, round(xlo, 9) AS xlo, round(ylo, 9) AS ylo, round(xhi, 9) AS xhi, round(yhi, 9) AS yhi FROM rect_s")
def wkt_polygons(s):
    return _rounded(text.accepted(text.polygon_wkt(_line(s, False))))


@query("rect_s", "SELECT id, round(xlo, 9) AS xlo, round(ylo, 9) AS ylo, round(xhi, 9) AS xhi, round(yhi, 9) AS yhi FROM rect_s")
def wkt_quoted(s):
    return _rounded(text.accepted(text.quoted_wkt(_line(s, True))))
