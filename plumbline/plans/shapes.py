"""Parcels, sight lines, approximate places and what else is made from geometry."""

from __future__ import annotations

from pyspark.sql import functions as F

from plumbline.functions import geometry
from plumbline.operators import graph, parcels, planning, snaps, splits
from plumbline.plans.measurements import rounded
from plumbline.plans.networks import repeated_levels
from plumbline.plans.registry import Registry
from plumbline.tables import spread, table

shapes = Registry()

_RECT = """rect AS (SELECT c_custkey AS k, c_acctbal AS x0, c_nationkey * 40.0 AS y0, c_acctbal + 5 + (c_custkey % 9) * (CASE WHEN c_custkey % 100 = 0 THEN 50 ELSE 1 END) AS x1, c_nationkey * 40.0 + 10 + c_custkey % 37 AS y1 FROM customer)"""


def _rects(spark, sf_dir):
    """Rectangles, one in a hundred of them long."""
    k = F.col("c_custkey")
    x0, y0 = F.col("c_acctbal"), F.col("c_nationkey") * 40.0
    x1, y1 = x0 + 5 + (k % 9) * F.when(k % 100 == 0, 50).otherwise(1), y0 + 10 + k % 37
    return spread(table(spark, sf_dir, "customer")).select(k.alias("k"), geometry.polygon([(x0, y0), (x1, y0), (x1, y1), (x0, y1)]).alias("p"))


@shapes.query(f"""
WITH {_RECT} SELECT a.k AS a, b.k AS b, round((least(a.x1, b.x1) - greatest(a.x0, b.x0)) * (least(a.y1, b.y1) - greatest(a.y0, b.y0)), 4) AS area FROM rect a JOIN rect b
ON a.k < b.k AND a.x0 < b.x1 AND b.x0 < a.x1 AND a.y0 < b.y1 AND b.y0 < a.y1 WHERE (least(a.x1, b.x1) - greatest(a.x0, b.x0)) * (least(a.y1, b.y1) - greatest(a.y0, b.y0)) > 0.001""")
def parcel_overlap_areas(spark, sf_dir):
    return rounded(parcels.overlaps(_rects(spark, sf_dir), "k", "p", 0.001), 4)


@shapes.query(f"""
WITH {_RECT}, line AS (SELECT s_suppkey AS s, s_acctbal AS ax, s_suppkey % 900 * 1.0 AS ay, s_acctbal + 400.0 AS bx, s_suppkey % 900 * 1.0 AS by FROM supplier)
SELECT s, EXISTS (SELECT 1 FROM rect WHERE ay BETWEEN y0 AND y1 AND x0 <= bx AND x1 >= ax) AS blocked FROM line""")
def sight_lines(spark, sf_dir):
    """Level lines of sight through a field of rectangles."""
    s = spread(table(spark, sf_dir, "supplier"))
    y = F.col("s_suppkey") % 900 * 1.0
    lines = s.select(F.col("s_suppkey").alias("s"), F.col("s_acctbal").alias("ax"), y.alias("ay"), (F.col("s_acctbal") + 400.0).alias("bx"), y.alias("by"))
    return parcels.blocked_lines(lines, "s", _rects(spark, sf_dir), "p")


@shapes.query("""
WITH c AS (SELECT p_partkey AS k, CAST(p_partkey % 50 AS DOUBLE) AS i, CAST(p_partkey // 50 AS DOUBLE) AS j FROM part WHERE p_partkey % 7 <> 0),
e AS (SELECT k, i AS x0, j AS y0, i + 1 AS x1, j AS y1 FROM c UNION ALL SELECT k, i, j + 1, i + 1, j + 1 FROM c UNION ALL SELECT k, i, j, i, j + 1 FROM c UNION ALL SELECT k, i + 1, j, i + 1, j + 1 FROM c)
SELECT min(k) AS k, x0, y0, x1, y1 FROM e GROUP BY x0, y0, x1, y1 HAVING count(*) = 1""")
def parcel_gaps(spark, sf_dir):
    """The outlines of a field of unit squares in which every seventh is missing."""
    k = F.col("p_partkey")
    i, j = (k % 50).cast("double"), F.floor(k / 50).cast("double")
    squares = table(spark, sf_dir, "part").filter(k % 7 != 0).select(k.alias("k"), geometry.polygon([(i, j), (i + 1, j), (i + 1, j + 1), (i, j + 1)]).alias("p"))
    return parcels.open_sides(squares, "k", "p")


@shapes.query(f"""WITH {_RECT} SELECT k, round((x1 - x0) * (y1 - y0), 4) AS area, round(2 * (x1 - x0 + y1 - y0), 4) AS perimeter, round((x0 + x1) / 2, 4) AS x, round((y0 + y1) / 2, 4) AS y,
  x0 < 5000 AND x1 > 5000 AND y0 < 500 AND y1 > 500 AS around, round(CASE WHEN x1 <= 5000 THEN 0 ELSE (x1 - greatest(x0, 5000)) * (y1 - y0) END, 4) AS east FROM rect""")
def parcel_measures(spark, sf_dir):
    """Area, perimeter, centroid, a point-in-polygon test, and what lies east of a line."""
    x, y = geometry.centroid("p")
    _, right = geometry.split_by_line(F.col("p"), F.lit(5000.0), F.lit(0.0), F.lit(5000.0), F.lit(1.0))
    rows = _rects(spark, sf_dir).select("k", geometry.signed_area("p").alias("area"), geometry.perimeter("p").alias("perimeter"), x.alias("x"), y.alias("y"), geometry.contains("p", F.lit(5000.0), F.lit(500.0)).alias("around"), geometry.signed_area(right).alias("east"))
    return rounded(rows, 4)


@shapes.query("""
WITH e AS (SELECT s_suppkey AS net, 10.0 + (s_suppkey % 7) * 0.01 AS x1, 20.0 AS y1, 5.0 AS x2, -7.0 + (s_suppkey % 5) * 0.01 AS y2, 15.0 AS x3, 13.0 + (s_suppkey % 3) * 0.01 AS y3 FROM supplier),
c AS (SELECT net, x1 + x2 - x3 AS ce, y1 + y2 - y3 AS cn, sqrt(x1 * x1 + y1 * y1) + sqrt(x2 * x2 + y2 * y2) + sqrt(x3 * x3 + y3 * y3) AS len FROM e)
SELECT net, 'B|C|v2' AS loop, 3 AS n_edges, round(CAST(ce AS DOUBLE), 6) AS closure_e, round(CAST(cn AS DOUBLE), 6) AS closure_n, round(len, 6) AS length, round(0.02 + len * 5e-5, 6) AS tolerance, sqrt(ce * ce + cn * cn) <= 0.02 + len * 5e-5 AS pass FROM c""")
def vector_loops(spark, sf_dir):
    """Closures of satellite vectors around a triangle."""
    k = F.col("s_suppkey")
    edge = lambda i, a, b, e, n: F.struct(F.lit(i).alias("edge_id"), F.lit(a).alias("a"), F.lit(b).alias("b"), e.alias("de"), n.alias("dn"))
    edges = F.array(edge("v1", "A", "B", 10.0 + (k % 7) * 0.01, F.lit(20.0)), edge("v2", "B", "C", F.lit(5.0), -7.0 + (k % 5) * 0.01), edge("v3", "A", "C", F.lit(15.0), 13.0 + (k % 3) * 0.01))
    rows = table(spark, sf_dir, "supplier").select(k.alias("net"), F.explode(edges).alias("e")).select("net", "e.*")
    return rounded(graph.vector_loop_closures(rows, 0.02, 50.0))


@shapes.query("""
WITH s AS (SELECT s_suppkey AS net, s_acctbal AS x, CAST(s_nationkey AS DOUBLE) AS y, radians(s_suppkey % 360) AS az FROM supplier)
SELECT net, 1 AS station, round(x, 4) AS x, round(y, 4) AS y FROM s UNION ALL SELECT net, 2, round(x + 100 * sin(az), 4), round(y + 100 * cos(az), 4) FROM s
UNION ALL SELECT net, 3, round(x + 100 * sin(az) + 50 * sin(az + 1), 4), round(y + 100 * cos(az) + 50 * cos(az + 1), 4) FROM s
UNION ALL SELECT net, 4, round(x + 100 * sin(az) + 50 * sin(az + 1) - 25 * sin(az + 2), 4), round(y + 100 * cos(az) + 50 * cos(az + 1) - 25 * cos(az + 2), 4) FROM s""")
def bootstrap_places(spark, sf_dir):
    """Approximate places along a chain of legs, the last of them observed backwards; a station without a leg has none."""
    k = F.col("s_suppkey")
    s = table(spark, sf_dir, "supplier").select(k.alias("net"), F.col("s_acctbal").alias("x"), F.col("s_nationkey").cast("double").alias("y"), F.radians((k % 360).cast("double")).alias("az"))
    leg = lambda a, b, az, d: F.struct(F.lit(a).alias("from_id"), F.lit(b).alias("to_id"), az.alias("azimuth"), F.lit(d).alias("distance"))
    legs = s.select("net", F.explode(F.array(leg(1, 2, F.col("az"), 100.0), leg(2, 3, F.col("az") + 1, 50.0), leg(4, 3, F.col("az") + 2, 25.0), leg(8, 9, F.col("az"), 1.0))).alias("l")).select("net", "l.*")
    return rounded(planning.bootstrap(s.select("net", F.lit(1).alias("station"), "x", "y"), legs), 4)


@shapes.query("""
WITH p AS (SELECT a.s_suppkey AS f, b.s_suppkey AS t, b.s_acctbal - a.s_acctbal AS de, b.s_nationkey - a.s_nationkey AS dn FROM supplier a JOIN supplier b ON b.s_suppkey = a.s_suppkey + 1)
SELECT f AS obs_id, 'dist' AS type, round(sqrt(de * de + dn * dn), 5) AS value FROM p UNION ALL SELECT f, 'bearing', round(atan2(de, dn) - floor(atan2(de, dn) / (2 * pi())) * 2 * pi(), 5) FROM p UNION ALL SELECT f, 'lev', 2.0 FROM p""")
def planned_values(spark, sf_dir):
    """What planned observations would read, from the geometry."""
    s = table(spark, sf_dir, "supplier").select(F.lit(1).alias("net"), F.col("s_suppkey").alias("station"), F.col("s_acctbal").alias("x"), F.col("s_nationkey").cast("double").alias("y"), (F.col("s_suppkey") * 2.0).alias("h"))
    kinds = F.explode(F.array(*map(F.lit, ("dist", "bearing", "lev"))))
    obs = s.select("net", F.col("station").alias("obs_id"), kinds.alias("type"), F.col("station").alias("from_id"), (F.col("station") + 1).alias("to_id"), F.lit(None).cast("long").alias("at_id"), F.lit(None).cast("double").alias("value"))
    return rounded(planning.populate(obs, s).filter("value is not null").select("obs_id", "type", "value"), 5)


@shapes.query("""
WITH RECURSIVE n AS (SELECT o_custkey // 2 AS net, o_orderkey % 20 AS a, (o_orderkey + 1 + o_custkey) % 20 AS b FROM orders), e AS (SELECT DISTINCT net, a, b FROM (SELECT net, a, b FROM n UNION ALL SELECT net, b, a FROM n) WHERE a <> b AND a <> 7 AND b <> 7),
r AS (SELECT DISTINCT net, a AS s, a AS r FROM e UNION SELECT r.net, e.b, r.r FROM r JOIN e ON e.net = r.net AND e.a = r.s), m AS (SELECT net, s, min(r) AS root FROM r GROUP BY net, s)
SELECT net, count(*) AS stations, count(DISTINCT root) AS pieces FROM m GROUP BY net""")
def connectivity_without(spark, sf_dir):
    """The stations that are left, and into how many pieces they fall, when station 7 is taken out of every network."""
    n = table(spark, sf_dir, "orders").select(F.floor(F.col("o_custkey") / 2).alias("net"), (F.col("o_orderkey") % 20).alias("a"), ((F.col("o_orderkey") + 1 + F.col("o_custkey")) % 20).alias("b"))
    return planning.pieces_without(n, 7)


@shapes.query("""
WITH v AS (SELECT s_suppkey AS net, unnest([1, 2, 3, 4, 5, 6]) AS i FROM supplier), r AS (SELECT net, 1.0 + ((net * (7 * i + 3) + i * i) % 11 - 5) * 0.001 AS v FROM v), m AS (SELECT net, avg(v) AS m FROM r GROUP BY net),
s AS (SELECT r.net, sum((v - m) ** 2) / 0.002 ** 2 AS ss FROM r JOIN m USING (net) GROUP BY r.net)
SELECT net, CAST(5 AS BIGINT) AS dof, round(ss, 5) AS ss, ss BETWEEN 0.8312116 AND 12.8325020 AS pass FROM s""")
def chi_square_tests(spark, sf_dir):
    """The global test of every network with one free height."""
    from plumbline.operators import adjustment

    obs, stations = repeated_levels(spark, sf_dir)
    summary = adjustment.degrees_of_freedom(adjustment.adjust(obs, stations).rows)
    return rounded(adjustment.chi_square_tests(summary).select("net", "dof", "ss", "pass"), 5)


@shapes.query(f"""
WITH {_RECT}, r AS (SELECT k, x1 - x0 AS w, y1 - y0 AS h, (k % 9 + 0.5) / 9 * (x1 - x0) * (y1 - y0) AS t FROM rect)
SELECT k, round(atan(CASE WHEN t <= w * h / 2 THEN 2 * t / (h * h) ELSE w * w / (2 * (w * h - t)) END), 6) AS azimuth, round(t, 4) AS left_area, round(w * h - t, 4) AS right_area FROM r""")
def area_splits(spark, sf_dir):
    """Each rectangle cut from its lower left corner, so that a share of it lies to the left."""
    rows = _rects(spark, sf_dir)
    rows = rows.select("k", "p", F.col("p")[0]["x"].alias("px"), F.col("p")[0]["y"].alias("py"), (geometry.signed_area("p") * (F.col("k") % 9 + 0.5) / 9).alias("area"))
    out = splits.split_by_area(rows, "k", "p", "px", "py", "area")
    return out.select("k", F.round("azimuth", 6).alias("azimuth"), F.round("left_area", 4).alias("left_area"), F.round("right_area", 4).alias("right_area"))


_SNAP = 6.0


@shapes.query(f"""
WITH seg AS (SELECT s_suppkey AS id, 100.0 * s_suppkey AS x FROM supplier), s2 AS (SELECT id * 10 AS seg_id, x AS ax, 0.0 AS ay, x + 40 AS bx, 40.0 AS b_y FROM seg UNION ALL SELECT id * 10 + 1, x, 40.0, x + 40, 0.0 FROM seg UNION ALL SELECT id * 10 + 2, x + 40, 0.0, x, 40.0 FROM seg),
cur AS (SELECT id AS cursor_id, x + CASE id % 4 WHEN 0 THEN 0.0 WHEN 1 THEN 18.0 WHEN 2 THEN 10.0 ELSE 80.0 END AS cx, CASE id % 4 WHEN 0 THEN 1.0 WHEN 1 THEN 20.0 WHEN 2 THEN 12.0 ELSE 0.0 END AS cy FROM seg),
ends AS (SELECT seg_id, ax AS x, ay AS y, 'endpoint' AS kind FROM s2 UNION ALL SELECT seg_id, bx, b_y, 'endpoint' FROM s2 UNION ALL SELECT seg_id, (ax + bx) / 2, (ay + b_y) / 2, 'midpoint' FROM s2),
crossing AS (SELECT id * 10 AS seg_id, x + 20 AS x, 20.0 AS y, 'intersection' AS kind FROM seg),
foot AS (SELECT cursor_id, seg_id, ax + t * (bx - ax) AS x, ay + t * (b_y - ay) AS y, 'nearest' AS kind FROM (SELECT *, greatest(0, least(1, ((cx - ax) * (bx - ax) + (cy - ay) * (b_y - ay)) / 3200)) AS t FROM s2 JOIN cur ON cursor_id = seg_id // 10)),
c AS (SELECT cursor_id, seg_id, x, y, kind, sqrt((x - cx) ** 2 + (y - cy) ** 2) AS dist FROM (SELECT * FROM ends UNION ALL SELECT * FROM crossing) e JOIN cur ON cursor_id = seg_id // 10 UNION ALL SELECT cursor_id, seg_id, x, y, kind, sqrt((x - cx) ** 2 + (y - cy) ** 2) FROM foot JOIN cur USING (cursor_id)),
d AS (SELECT *, CASE kind WHEN 'endpoint' THEN 1 WHEN 'intersection' THEN 2 WHEN 'midpoint' THEN 3 ELSE 4 END AS k FROM c WHERE dist <= {_SNAP} QUALIFY row_number() OVER (PARTITION BY cursor_id, kind, round(x, 9), round(y, 9) ORDER BY seg_id) = 1)
SELECT cursor_id, kind, seg_id, round(CAST(x AS DOUBLE), 5) AS x, round(CAST(y AS DOUBLE), 5) AS y, round(CAST(dist AS DOUBLE), 5) AS dist, CAST(row_number() OVER (PARTITION BY cursor_id ORDER BY round(dist, 9), k, seg_id) AS INTEGER) AS rank FROM d""")
def snap_candidates(spark, sf_dir):
    """Where a cursor may snap to: two segments that cross, one of them drawn twice in either direction."""
    s = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("id"), (100.0 * F.col("s_suppkey")).alias("x"))
    line = lambda n, ay, by, turned: F.struct((F.col("id") * 10 + n).alias("seg_id"), (F.col("x") + (40 if turned else 0)).alias("ax"), F.lit(ay).alias("ay"), (F.col("x") + (0 if turned else 40)).alias("bx"), F.lit(by).alias("by"))
    segments = s.select(F.explode(F.array(line(0, 0.0, 40.0, False), line(1, 40.0, 0.0, False), line(2, 0.0, 40.0, True))).alias("l")).select("l.*")
    at = lambda values, other: F.when(F.col("id") % 4 == 0, values[0]).when(F.col("id") % 4 == 1, values[1]).when(F.col("id") % 4 == 2, values[2]).otherwise(other)
    cursors = s.select(F.col("id").alias("cursor_id"), (F.col("x") + at((0.0, 18.0, 10.0), 80.0)).alias("x"), at((1.0, 20.0, 12.0), 0.0).alias("y"))
    out = snaps.snap_candidates(cursors, segments, _SNAP)
    return out.select("cursor_id", "kind", "seg_id", *(F.round(F.round(c, 5) + 0.0, 5).alias(c) for c in ("x", "y", "dist")), "rank")


def _blocks(spark, sf_dir):
    """For each supplier a block of three by three units without its middle: the lowest row is one parcel, the others are squares, some of them
    clockwise, so the corners of squares lie on the side of the long one."""
    square = lambda n, i, j, w=1: F.struct(F.lit(n).alias("n"), F.lit(i).alias("i"), F.lit(j).alias("j"), F.lit(w).alias("w"))
    cells = F.array(square(0, 0, 0, 3), *(square(3 * j + i, i, j) for i in range(3) for j in (1, 2) if (i, j) != (1, 1)))
    rows = spread(table(spark, sf_dir, "supplier")).select(F.col("s_suppkey").alias("s"), F.explode(cells).alias("c"))
    x, y = 10.0 * F.col("s") + F.col("c.i"), F.col("s") % 7 + F.col("c.j") + 0.5
    at = lambda dx, dy: F.struct((x + dx).alias("x"), (y + dy).alias("y"))
    shape = F.array(at(0, 0), at(F.col("c.w"), 0), at(F.col("c.w"), 1), at(0, 1))
    return rows.select((F.col("s") * 10 + F.col("c.n")).alias("k"), F.when(F.col("c.n") % 2 == 0, shape).otherwise(F.reverse(shape)).alias("p"))


@shapes.query("""
WITH s AS (SELECT 10.0 * s_suppkey AS x, s_suppkey % 7 + 0.5 AS y FROM supplier)
SELECT CAST(x AS DOUBLE) AS x, CAST(y AS DOUBLE) AS y, 10 AS n_sides, 9.0::DOUBLE AS area, false AS is_gap FROM s UNION ALL SELECT x + 1, y + 1, 4, 1.0, true FROM s""")
def parcel_loops(spark, sf_dir):
    """The outline of each block, and the hole in it."""
    return rounded(parcels.gap_loops(_blocks(spark, sf_dir), "k", "p")[0], 5)


@shapes.query("""
WITH s AS (SELECT 10.0 * s_suppkey AS x, s_suppkey % 7 + 0.5 AS y FROM supplier), c AS (SELECT x, y, unnest([0, 1, 2, 3, 4, 5, 6, 7, 8, 9]) AS place, unnest([0, 0, 0, 0, 1, 2, 3, 3, 3, 3]) AS dx, unnest([0, 1, 2, 3, 3, 3, 3, 2, 1, 0]) AS dy FROM s),
g AS (SELECT x + 1 AS x, y + 1 AS y, unnest([0, 1, 2, 3]) AS place, unnest([0, 0, 1, 1]) AS dx, unnest([0, 1, 1, 0]) AS dy FROM s)
SELECT CAST(x AS DOUBLE) AS x, CAST(y AS DOUBLE) AS y, place, CAST(x + dx AS DOUBLE) AS px, CAST(y + dy AS DOUBLE) AS py FROM (SELECT * FROM c UNION ALL SELECT * FROM g)""")
def loop_corners(spark, sf_dir):
    """The corners of all loops in order."""
    return parcels.gap_loops(_blocks(spark, sf_dir), "k", "p")[1]


@shapes.query("""
WITH p AS (SELECT s_nationkey AS g, s_suppkey AS k, s_acctbal AS x FROM supplier), r AS (SELECT *, row_number() OVER (PARTITION BY g ORDER BY k) AS n FROM p)
SELECT g, count(*) AS members FROM r GROUP BY g""")
def complete_linkage(spark, sf_dir):
    """Greedy groups of points that are all near each other; their members add up to all."""
    points = table(spark, sf_dir, "supplier").select(F.col("s_nationkey").alias("g"), F.col("s_suppkey").alias("k"), F.col("s_acctbal").alias("x"), F.lit(0.0).alias("y"))
    out = planning.complete_linkage(points, "g", "k", 1500.0)
    return out.groupBy("g").agg(F.count(F.lit(1)).alias("members"))
