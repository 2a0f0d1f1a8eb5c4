"""Splits of convex parcels by a line through a point: with a given bearing, or so that the part to its left has a given area.

For an area the line is swept around the point. Its forward end passes from side to side at the corners, its backward end at the corners' opposite
directions; between two such events both ends stay on one side each. Prefix sums of the triangles from the point to the sides give the
area to the left at every event, so a window over a parcel's sorted events finds the intervals that hold the area asked for. Within one the area is a
rational function of where the forward end lies on its side, and the place is a root of a quadratic: no angle is tried.

Defined cases: parcels may run either way round; the point may lie inside or on a side. A parcel with fewer than three corners or a point outside
has no split, nor has one where no line through the point leaves the area asked for. Of several lines the one with the least azimuth is
taken. Parts of less than ``LEAST_AREA`` are none.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from plumbline.functions import geometry

LEAST_AREA = 1e-9
_TURN = 2 * math.pi


def _ccw(p: str) -> Column:
    return F.when(geometry.signed_area(p) < 0, F.reverse(F.col(p))).otherwise(F.col(p))


def split_by_bearing(parcels: DataFrame, shape: str, x: str, y: str, azimuth: str) -> DataFrame:
    """``parcels`` with left, right, left_area and right_area of the line through (x, y) with an azimuth (radians, clockwise from north); null
    where the line leaves less than ``LEAST_AREA`` on a side, or the azimuth is null."""
    rows = parcels.withColumn("__p", _ccw(shape))
    bx, by = F.col(x) + F.sin(azimuth), F.col(y) + F.cos(azimuth)
    left, right = geometry.split_by_line("__p", F.col(x), F.col(y), bx, by)
    rows = rows.withColumns({"left": left, "right": right})
    rows = rows.withColumns({f"{s}_area": geometry.signed_area(s) for s in ("left", "right")})
    good = F.coalesce((F.col("left_area") > LEAST_AREA) & (F.col("right_area") > LEAST_AREA), F.lit(False))
    return rows.withColumns({c: F.when(good, F.col(c)) for c in ("left", "right", "left_area", "right_area")}).drop("__p")


def _cross(ax, ay, bx, by) -> Column:
    return ax * by - ay * bx


def area_azimuths(parcels: DataFrame, key: str, shape: str, x: str, y: str, area: str) -> DataFrame:
    """(key, azimuth) of the line through (x, y) that leaves ``area`` to its left, for parcels that have one."""
    rows = parcels.select(F.col(key).alias("k"), _ccw(shape).alias("p"), F.col(x).alias("px"), F.col(y).alias("py"), F.col(area).alias("target")).filter(F.size("p") > 2)
    sides = rows.select("k", "px", "py", "target", F.posexplode(geometry._edges(F.col("p"))).alias("i", "e"))
    sides = sides.select("k", "i", "target", *((F.col(f"e.{p}.{c}") - F.col(f"p{c}")).alias(f"{p}{c}") for p in "ab" for c in "xy")).filter("ax <> bx or ay <> by")
    sides = sides.withColumn("tri", _cross(F.col("ax"), F.col("ay"), F.col("bx"), F.col("by")) / 2)
    # Inside or on a side: no triangle runs the other way round.
    every = Window.partitionBy("k")
    size = F.max(F.abs("ax") + F.abs("ay")).over(every)
    sides = sides.withColumn("inside", F.min("tri").over(every) >= -1e-12 * size * size).filter("inside")
    sides = sides.withColumns({"before": F.sum("tri").over(every.orderBy("i").rowsBetween(Window.unboundedPreceding, -1)), "total": F.sum("tri").over(every)})
    sides = sides.withColumn("before", F.coalesce("before", F.lit(0.0))).filter((F.col("ax") != 0) | (F.col("ay") != 0))

    # Events: at a corner the forward end comes to its side; half a turn on, the backward end does.
    side = F.struct("ax", "ay", (F.col("bx") - F.col("ax")).alias("dx"), (F.col("by") - F.col("ay")).alias("dy"), "tri", "before", "i")
    angle = F.pmod(F.atan2("ay", "ax"), F.lit(_TURN))
    none = F.lit(None).cast("struct<ax:double,ay:double,dx:double,dy:double,tri:double,before:double,i:int>")
    both = F.array(F.struct(angle.alias("at"), side.alias("ahead"), none.alias("behind")), F.struct(F.pmod(angle + math.pi, F.lit(_TURN)).alias("at"), none.alias("ahead"), side.alias("behind")))
    events = sides.select("k", "target", "total", "i", F.explode(both).alias("v")).select("k", "target", "total", "i", "v.*")
    order = Window.partitionBy("k").orderBy("at", "i")
    so_far, whole = order.rowsBetween(Window.unboundedPreceding, 0), order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    now = lambda c: F.coalesce(F.last(c, ignorenulls=True).over(so_far), F.last(c, ignorenulls=True).over(whole))
    spans = events.withColumns({"f": now("ahead"), "g": now("behind"), "end": F.coalesce(F.lead("at").over(order), F.min("at").over(whole) + _TURN)})
    spans = spans.filter(F.col("end") > F.col("at") + 1e-15)

    a = {c: F.col(f"f.{c}") for c in ("ax", "ay", "dx", "dy", "tri", "before")}
    b = {c: F.col(f"g.{c}") for c in ("ax", "ay", "dx", "dy", "tri", "before")}
    # Left of the line lies what is swept from its forward end, at share t of side f, to its backward end, at share s of side g; the rest of a turn
    # is added where the sums start anew between them.
    base = b["before"] - a["before"] + F.when(F.col("g.i") < F.col("f.i"), F.col("total")).otherwise(0.0)
    gap = F.col("target") - base
    # base - t tri_f + s tri_g = target, where the two ends and the point are in line: s = -(c0 + c1 t) / (e0 + e1 t).
    c0, c1 = _cross(a["ax"], a["ay"], b["ax"], b["ay"]), _cross(a["dx"], a["dy"], b["ax"], b["ay"])
    e0, e1 = _cross(a["ax"], a["ay"], b["dx"], b["dy"]), _cross(a["dx"], a["dy"], b["dx"], b["dy"])
    q2, q1, q0 = a["tri"] * e1, a["tri"] * e0 + gap * e1 + b["tri"] * c1, gap * e0 + b["tri"] * c0
    under = q1 * q1 - 4 * q2 * q0
    # Less than nothing by rounding is a double root.
    real = under >= -1e-12 * (q1 * q1 + F.abs(4 * q2 * q0))
    root = F.sqrt(F.greatest(under, F.lit(0.0)))
    big = -(q1 + F.when(q1 < 0, -root).otherwise(root)) / 2
    on_f = F.array(F.when(real, F.try_divide(q0, big)), F.when(real, F.try_divide(big, q2)))
    # A side through the point has no triangle: there the other end alone tells the area.
    flat = lambda side: side["tri"] <= 1e-12 * F.col("total")
    t_alone, s_alone = F.try_divide(-gap, a["tri"]), F.try_divide(gap, b["tri"])
    ahead = lambda t: F.atan2(a["ay"] + t * a["dy"], a["ax"] + t * a["dx"])
    behind = F.atan2(-(b["ay"] + s_alone * b["dy"]), -(b["ax"] + s_alone * b["dx"]))
    ways = F.when(flat(a), F.array(F.when(~flat(b), behind))).when(flat(b), F.array(ahead(t_alone))).otherwise(F.transform(on_f, ahead))
    inside = lambda w: (F.pmod(w - F.col("at"), F.lit(_TURN)) <= F.col("end") - F.col("at") + 1e-9) | (F.pmod(w - F.col("at"), F.lit(_TURN)) >= _TURN - 1e-9)
    found = spans.select("k", F.explode(F.filter(ways, lambda w: w.isNotNull() & inside(w))).alias("w"))
    azimuth = F.pmod(math.pi / 2 - F.col("w"), F.lit(_TURN))
    # A full turn by rounding is none.
    return found.groupBy("k").agg(F.min(F.when(azimuth > _TURN - 1e-12, 0.0).otherwise(azimuth)).alias("azimuth")).select(F.col("k").alias(key), "azimuth")


def split_by_area(parcels: DataFrame, key: str, shape: str, x: str, y: str, area: str) -> DataFrame:
    """``parcels`` with azimuth, left, right, left_area and right_area of the line through (x, y) that leaves ``area`` to its left; null without one."""
    found = area_azimuths(parcels, key, shape, x, y, area).withColumnRenamed(key, "__k")
    return split_by_bearing(parcels.join(found, F.col(key) == F.col("__k"), "left").drop("__k"), shape, x, y, "azimuth")
