"""Points near a cursor that it may snap to: ends, crossings, middles and feet on segments.

Segments and cursors stand in grid cells of their own size (``parcels.meeting_boxes``), so that a cursor meets the segments near it and a segment those it
may cross, and only such pairs are looked at. Crossings are found once for all cursors. A crossing belongs to the lesser of its two segments; segments
that lie along one another, or touch at a common end, have none.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from plumbline.operators.parcels import meeting_boxes
from plumbline.tables import cut

#: Kinds in order of preference, at equal distance.
KINDS = ("endpoint", "intersection", "midpoint", "nearest")
#: Decimals to which points of a kind are one.
DECIMALS = 9


def _boxed(segments: DataFrame) -> DataFrame:
    box = {f"{c}{i}": f(f"a{c}", f"b{c}") for c in "xy" for i, f in enumerate((F.least, F.greatest))}
    return segments.select("seg_id", *(F.col(c).cast("double").alias(c) for c in ("ax", "ay", "bx", "by"))).filter("ax + ay + bx + by is not null").withColumns(box)


def crossings(segments: DataFrame) -> DataFrame:
    """(seg_id, other_id, x, y) of the points where segments (seg_id, ax, ay, bx, by) cross or one ends on the other."""
    rows = cut(_boxed(segments), "snap-segments")
    pairs = meeting_boxes(rows, rows).filter("a_seg_id < b_seg_id")
    dx, dy = F.col("a_bx") - F.col("a_ax"), F.col("a_by") - F.col("a_ay")
    ex, ey = F.col("b_bx") - F.col("b_ax"), F.col("b_by") - F.col("b_ay")
    fx, fy = F.col("b_ax") - F.col("a_ax"), F.col("b_ay") - F.col("a_ay")
    turn = dx * ey - dy * ex
    t, u = F.try_divide(fx * ey - fy * ex, turn), F.try_divide(fx * dy - fy * dx, turn)
    slack = 1e-12
    hit = (F.abs(turn) > slack * F.hypot(dx, dy) * F.hypot(ex, ey)) & t.between(-slack, 1 + slack) & u.between(-slack, 1 + slack)
    at_end = lambda v: (v <= slack) | (v >= 1 - slack)
    found = pairs.filter(hit & ~(at_end(t) & at_end(u)))
    return found.select(F.col("a_seg_id").alias("seg_id"), F.col("b_seg_id").alias("other_id"), (F.col("a_ax") + t * dx).alias("x"), (F.col("a_ay") + t * dy).alias("y"))


def snap_candidates(cursors: DataFrame, segments: DataFrame, tolerance: float, points: DataFrame | None = None) -> DataFrame:
    """(cursor_id, kind, seg_id, x, y, dist, rank) of what lies within ``tolerance`` of each cursor (cursor_id, x, y), nearest first. Points of one kind and
    place count once, for the least segment. ``points`` (seg_id, kind, x, y) are others to snap to, such as stations. Rows with a null place have none."""
    rows = _boxed(segments)
    at = lambda kind, x, y: F.struct(F.lit(kind).alias("kind"), x.alias("x"), y.alias("y"))
    own = F.array(
        at("endpoint", F.col("ax"), F.col("ay")), at("endpoint", F.col("bx"), F.col("by")), at("midpoint", (F.col("ax") + F.col("bx")) / 2, (F.col("ay") + F.col("by")) / 2)
    )
    places = rows.select("seg_id", F.explode(own).alias("p")).select("seg_id", "p.*")
    places = places.unionByName(crossings(segments).select("seg_id", F.lit("intersection").alias("kind"), "x", "y"))
    if points is not None:
        places = places.unionByName(points.select("seg_id", "kind", "x", "y").filter("x + y is not null"))
    places = places.withColumns({"x0": F.col("x"), "x1": F.col("x"), "y0": F.col("y"), "y1": F.col("y")})
    near = cursors.filter("x + y is not null").select("cursor_id", "x", "y").withColumns({"x0": F.col("x") - tolerance, "x1": F.col("x") + tolerance, "y0": F.col("y") - tolerance, "y1": F.col("y") + tolerance})
    near = cut(near, "snap-cursors")

    fixed = meeting_boxes(near, places).select(F.col("a_cursor_id").alias("cursor_id"), F.col("b_kind").alias("kind"), F.col("b_seg_id").alias("seg_id"), F.col("b_x").alias("x"), F.col("b_y").alias("y"), F.col("a_x").alias("cx"), F.col("a_y").alias("cy"))
    met = meeting_boxes(near, rows)
    dx, dy = F.col("b_bx") - F.col("b_ax"), F.col("b_by") - F.col("b_ay")
    share = F.try_divide((F.col("a_x") - F.col("b_ax")) * dx + (F.col("a_y") - F.col("b_ay")) * dy, dx * dx + dy * dy)
    t = F.when(share.isNotNull(), F.greatest(F.lit(0.0), F.least(F.lit(1.0), share))).otherwise(0.0)
    feet = met.select(F.col("a_cursor_id").alias("cursor_id"), F.lit("nearest").alias("kind"), F.col("b_seg_id").alias("seg_id"), (F.col("b_ax") + t * dx).alias("x"), (F.col("b_ay") + t * dy).alias("y"), F.col("a_x").alias("cx"), F.col("a_y").alias("cy"))
    found = fixed.unionByName(feet).withColumn("dist", F.hypot(F.col("x") - F.col("cx"), F.col("y") - F.col("cy"))).filter(F.col("dist") <= tolerance)
    key = [F.round(c, DECIMALS).alias(f"k{c}") for c in "xy"]
    one = found.groupBy("cursor_id", "kind", *key).agg(F.min(F.struct("seg_id", "x", "y", "dist")).alias("f")).select("cursor_id", "kind", "f.*")
    order = Window.partitionBy("cursor_id").orderBy(F.round("dist", DECIMALS), F.array_position(F.array(*map(F.lit, KINDS)), F.col("kind")), "kind", "seg_id", "x", "y")
    return one.withColumn("rank", F.row_number().over(order)).select("cursor_id", "kind", "seg_id", "x", "y", "dist", "rank")
