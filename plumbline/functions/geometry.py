"""Polygons as arrays of points (x, y), without repeating the first one, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from plumbline.functions.numbers import col

POINTS = "array<struct<x:double,y:double>>"


def polygon(points: list[tuple]) -> Column:
    """A polygon of points given as numbers or columns."""
    part = lambda v: (v if isinstance(v, Column) else F.lit(v)).cast("double")
    return F.array(*(F.struct(part(x).alias("x"), part(y).alias("y")) for x, y in points))


def _edges(p: Column) -> Column:
    """(a, b) of each side, the last back to the first."""
    n = F.size(p)
    side = lambda i: F.struct(F.get(p, i).alias("a"), F.get(p, (i + 1) % n).alias("b"))
    empty = F.array().cast("array<struct<a:struct<x:double,y:double>,b:struct<x:double,y:double>>>")
    return F.when(n > 0, F.transform(F.sequence(F.lit(0), n - 1), side)).otherwise(empty)


def _sum(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda a, v: a + v)


def _cross(e: Column) -> Column:
    return e["a"]["x"] * e["b"]["y"] - e["b"]["x"] * e["a"]["y"]


def signed_area(p) -> Column:
    """Positive if the points run counter-clockwise."""
    return _sum(F.transform(_edges(col(p)), _cross)) / 2


def perimeter(p) -> Column:
    return _sum(F.transform(_edges(col(p)), lambda e: F.hypot(e["b"]["x"] - e["a"]["x"], e["b"]["y"] - e["a"]["y"])))


def centroid(p) -> tuple[Column, Column]:
    """Of the area; null for a polygon without one."""
    edges, area = _edges(col(p)), signed_area(p)
    part = lambda k: _sum(F.transform(edges, lambda e: (e["a"][k] + e["b"][k]) * _cross(e)))
    return tuple(F.when(F.abs(area) > 1e-12, part(k) / (6 * area)) for k in "xy")


def contains(p, x, y) -> Column:
    """Whether a point is inside, by the crossings of a line to the right of it; points on a side may be either."""
    x, y = col(x), col(y)
    hits = F.filter(_edges(col(p)), lambda e: ((e["a"]["y"] > y) != (e["b"]["y"] > y)) & (x < (e["b"]["x"] - e["a"]["x"]) * (y - e["a"]["y"]) / (e["b"]["y"] - e["a"]["y"]) + e["a"]["x"]))
    return F.size(hits) % 2 == 1


def _turn(ax, ay, bx, by, px, py) -> Column:
    return (bx - ax) * (py - ay) - (by - ay) * (px - ax)


def segments_meet(ax, ay, bx, by, cx, cy, dx, dy) -> Column:
    """Whether two segments have a point in common."""
    ax, ay, bx, by, cx, cy, dx, dy = map(col, (ax, ay, bx, by, cx, cy, dx, dy))
    s1, s2, s3, s4 = (F.signum(t) for t in (_turn(ax, ay, bx, by, cx, cy), _turn(ax, ay, bx, by, dx, dy), _turn(cx, cy, dx, dy, ax, ay), _turn(cx, cy, dx, dy, bx, by)))
    within = lambda ux, uy, vx, vy, px, py: px.between(F.least(ux, vx), F.greatest(ux, vx)) & py.between(F.least(uy, vy), F.greatest(uy, vy))
    touch = (
        ((s1 == 0) & within(ax, ay, bx, by, cx, cy)) | ((s2 == 0) & within(ax, ay, bx, by, dx, dy)) | ((s3 == 0) & within(cx, cy, dx, dy, ax, ay)) | ((s4 == 0) & within(cx, cy, dx, dy, bx, by))
    )
    return ((s1 * s2 < 0) & (s3 * s4 < 0)) | touch


def blocks(p, ax, ay, bx, by) -> Column:
    """Whether a polygon stands in the way between two points."""
    cuts = F.exists(_edges(col(p)), lambda e: segments_meet(ax, ay, bx, by, e["a"]["x"], e["a"]["y"], e["b"]["x"], e["b"]["y"]))
    return cuts | contains(p, ax, ay)


def half_plane(p: Column, ax: Column, ay: Column, bx: Column, by: Column) -> Column:
    """What of a polygon lies left of the line from a to b."""
    side = lambda v: _turn(ax, ay, bx, by, v["x"], v["y"])

    def kept(e):
        u, v = side(e["a"]), side(e["b"])
        t = u / (u - v)
        cut = F.struct((e["a"]["x"] + t * (e["b"]["x"] - e["a"]["x"])).alias("x"), (e["a"]["y"] + t * (e["b"]["y"] - e["a"]["y"])).alias("y"))
        own = F.struct(e["a"]["x"].alias("x"), e["a"]["y"].alias("y"))
        none = F.array().cast(POINTS)
        return F.concat(F.when(u >= 0, F.array(own)).otherwise(none), F.when(u * v < 0, F.array(cut)).otherwise(none))

    return F.flatten(F.transform(_edges(p), kept))


def clip(p, q) -> Column:
    """The part of polygon ``p`` within the convex polygon ``q``, whose points run counter-clockwise: ``p`` is cut by the line of each side."""
    return F.aggregate(_edges(col(q)), col(p).cast(POINTS), lambda left, e: half_plane(left, e["a"]["x"], e["a"]["y"], e["b"]["x"], e["b"]["y"]).cast(POINTS))


def split_by_line(p, ax, ay, bx, by) -> tuple[Column, Column]:
    """What of a convex polygon lies left and right of a line."""
    p, ax, ay, bx, by = map(col, (p, ax, ay, bx, by))
    return half_plane(p, ax, ay, bx, by), half_plane(p, bx, by, ax, ay)
