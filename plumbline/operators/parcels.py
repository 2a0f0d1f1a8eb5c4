"""Parcels and sight lines: joins through a grid, then exact geometry on the pairs that meet; outlines as ordered rings.

Rings come from lone sides by pointer doubling: each side stands twice, once for either direction, and points to the side that goes on at its
end. A round doubles the stretch that a pointer spans, and carries the least side in it and how many steps away that is; when nothing is
less any more, every side knows its ring and its place. So a ring of n sides takes about log n rounds of one join, and is never gathered.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.functions import geometry
from plumbline.tables import cut


def _bounds(df: DataFrame, shape: str) -> DataFrame:
    xs, ys = F.transform(shape, lambda p: p["x"]), F.transform(shape, lambda p: p["y"])
    return df.withColumns({"x0": F.array_min(xs), "x1": F.array_max(xs), "y0": F.array_min(ys), "y1": F.array_max(ys)})


def _level(axis: str) -> Column:
    """The level whose cells, of length 2 ** level along an axis, are as long as the box."""
    return F.ceil(F.log2(F.greatest(F.col(f"{axis}1") - F.col(f"{axis}0"), F.lit(1e-6)))).cast("int")


def _cells(df: DataFrame, axis: str) -> DataFrame:
    """``df`` once for each cell c_<axis> of level l_<axis> that its box touches along an axis."""
    size = F.pow(F.lit(2.0), F.col(f"l_{axis}"))
    return df.withColumn(f"c_{axis}", F.explode(F.sequence(F.floor(F.col(f"{axis}0") / size), F.floor(F.col(f"{axis}1") / size))))


_KEYS = ["l_x", "c_x", "l_y", "c_y"]


def _ways(a: DataFrame, b: DataFrame):
    """(rows of a, rows of b, condition) of the joins in which all boxes that overlap meet. A cell has a level for each axis, so that it is as long and as wide as
    boxes are. Along an axis the smaller box climbs to the levels that occur among the others; equal levels meet from one side only. So a box stands
    in at most four cells of a level, however sizes differ."""
    own = {"a": a, "b": b}
    own = {t: df.withColumns({f"own_{axis}": _level(axis) for axis in "xy"}) for t, df in own.items()}
    found = {t: df.select("own_x", "own_y").distinct().collect() for t, df in own.items()}  # a few powers of two
    levels = {(t, axis): sorted({r[f"own_{axis}"] for r in rows if r[f"own_{axis}"] is not None}) for t, rows in found.items() for axis in "xy"}

    def side(tag, climbs):
        rows, other = own[tag], "b" if tag == "a" else "a"
        for axis in "xy":
            at = F.col(f"own_{axis}")
            if climbs[axis]:
                at = F.explode(F.filter(F.array(*map(F.lit, levels[other, axis])), lambda k: k >= F.col(f"own_{axis}")))  # noqa: B023
            rows = _cells(rows.withColumn(f"l_{axis}", at), axis)
        return rows.select(*(F.col(c).alias(f"{tag}_{c}") for c in rows.columns))

    same = [F.col(f"a_{k}") == F.col(f"b_{k}") for k in _KEYS]
    apart = [F.col(f"a_{c}0") <= F.col(f"b_{c}1") for c in "xy"] + [F.col(f"b_{c}0") <= F.col(f"a_{c}1") for c in "xy"]
    for up in ({"x": x, "y": y} for x in (True, False) for y in (True, False)):
        meets = lambda axis: any(u <= v if up[axis] else u > v for u in levels["a", axis] for v in levels["b", axis])  # noqa: B023, E731
        if not (meets("x") and meets("y")):
            continue
        order = [F.col(f"a_own_{c}") <= F.col(f"b_own_{c}") if up[c] else F.col(f"a_own_{c}") > F.col(f"b_own_{c}") for c in "xy"]
        yield side("a", up), side("b", {c: not u for c, u in up.items()}), reduce(lambda x, y: x & y, [*same, *order, *apart])


def meeting_boxes(a: DataFrame, b: DataFrame) -> DataFrame:
    """Pairs of rows of ``a`` (columns a_...) and ``b`` (columns b_...) whose boxes x0, y0, x1, y1 overlap, each once."""
    columns = [f"{t}_{c}" for t, df in (("a", a), ("b", b)) for c in df.columns]
    # A pair counts in the cell of the overlap's lower corner alone.
    first = [F.floor(F.greatest(f"a_{c}0", f"b_{c}0") / F.pow(F.lit(2.0), F.col(f"a_l_{c}"))) == F.col(f"a_c_{c}") for c in "xy"]
    found = [x.join(y, on & first[0] & first[1]).select(*columns) for x, y, on in _ways(a, b)]
    if not found:
        empty = [df.filter(F.lit(False)).select(*(F.col(c).alias(f"{t}_{c}") for c in df.columns)) for t, df in (("a", a), ("b", b))]
        return empty[0].crossJoin(empty[1])
    return reduce(DataFrame.unionByName, found)


def _is_box(shape: str) -> Column:
    """Whether a convex polygon is its own bounding box."""
    corner = lambda p: p["x"].isin(F.col("x0"), F.col("x1")) & p["y"].isin(F.col("y0"), F.col("y1"))
    return (F.size(shape) == 4) & (F.size(F.array_distinct(shape)) == 4) & F.forall(shape, corner)


def overlaps(parcels: DataFrame, key: str, shape: str, least: float = 1e-6) -> DataFrame:
    """(a, b, area) of convex parcels, counter-clockwise, that overlap by more than ``least``, a < b. Upright rectangles need no clipping."""
    rows = _bounds(parcels.select(F.col(key).alias("k"), F.col(shape).alias("p")), "p").withColumn("box", _is_box("p"))
    pairs = meeting_boxes(rows, rows).filter("a_k < b_k")
    side = lambda c: F.least(f"a_{c}1", f"b_{c}1") - F.greatest(f"a_{c}0", f"b_{c}0")
    # The clipped polygon is bound to a name, or each of its corners would be clipped anew.
    clipped = F.transform(F.array(geometry.clip("a_p", "b_p")), lambda p: F.abs(geometry.signed_area(p)))[0]
    area = F.when(F.col("a_box") & F.col("b_box"), side("x") * side("y")).otherwise(clipped)
    return pairs.select(F.col("a_k").alias("a"), F.col("b_k").alias("b"), area.alias("area")).filter(F.col("area") > least)


def blocked_lines(lines: DataFrame, key: str, obstacles: DataFrame, shape: str) -> DataFrame:
    """``key`` and blocked of every sight line (ax, ay, bx, by): whether any obstacle stands in its way. The first one found is enough."""
    box = {"x0": F.least("ax", "bx"), "x1": F.greatest("ax", "bx"), "y0": F.least("ay", "by"), "y1": F.greatest("ay", "by")}
    a = lines.select(F.col(key).alias("k"), "ax", "ay", "bx", "by").withColumns(box)
    b = _bounds(obstacles.select(F.col(shape).alias("p")), "p").withColumn("box", _is_box("p"))
    # Where both are upright, they meet if their boxes do.
    upright = F.col("b_box") & ((F.col("a_ax") == F.col("a_bx")) | (F.col("a_ay") == F.col("a_by")))
    blocks = F.when(upright, F.lit(True)).otherwise(geometry.blocks("b_p", "a_ax", "a_ay", "a_bx", "a_by"))
    found = [x.join(y, on & blocks, "left_semi").select(F.col("a_k").alias("h")) for x, y, on in _ways(a, b)]
    if not found:
        return lines.select(key, F.lit(False).alias("blocked"))
    hit = reduce(DataFrame.unionByName, found).distinct()
    return lines.select(key).join(hit, F.col(key) == F.col("h"), "left").select(key, F.col("h").isNotNull().alias("blocked"))


def _point(c: str, digits: int) -> Column:
    # A zero without a sign: sides are compared by their points.
    return F.struct((F.round(F.col(f"{c}.x"), digits) + 0.0).alias("x"), (F.round(F.col(f"{c}.y"), digits) + 0.0).alias("y"))


def boundary_sides(parcels: DataFrame, key: str, shape: str, digits: int = 4, split: bool = True) -> DataFrame:
    """(k, a, b) of all sides of all parcels, counter-clockwise, points rounded to so many digits. With ``split`` a side is cut where another parcel's
    corner lies on it."""
    ccw = F.when(geometry.signed_area(shape) < 0, F.reverse(F.col(shape))).otherwise(F.col(shape))
    rows = parcels.select(F.col(key).alias("k"), F.explode(geometry._edges(ccw)).alias("e"))
    sides = rows.select("k", _point("e.a", digits).alias("a"), _point("e.b", digits).alias("b")).filter("a <> b")
    if not split:
        return sides
    sides = cut(sides, "sides")
    corners = sides.select(F.col("a.x").alias("x"), F.col("a.y").alias("y")).distinct().withColumns({"x0": F.col("x"), "x1": F.col("x"), "y0": F.col("y"), "y1": F.col("y")})
    boxes = sides.select("k", "a", "b", *(f(f"a.{c}", f"b.{c}").alias(f"{c}{i}") for c in "xy" for i, f in enumerate((F.least, F.greatest))))
    dx, dy = F.col("a_b.x") - F.col("a_a.x"), F.col("a_b.y") - F.col("a_a.y")
    px, py = F.col("b_x") - F.col("a_a.x"), F.col("b_y") - F.col("a_a.y")
    along, off = (px * dx + py * dy) / (dx * dx + dy * dy), F.abs(px * dy - py * dx) / F.hypot(dx, dy)
    met = meeting_boxes(boxes, corners).filter((off <= 0.5 * 10.0**-digits) & (along > 0) & (along < 1))
    at = F.struct(along.alias("t"), F.struct(F.col("b_x").alias("x"), F.col("b_y").alias("y")).alias("p"))
    cuts = met.select(F.col("a_k").alias("m_k"), F.col("a_a").alias("m_a"), F.col("a_b").alias("m_b"), at.alias("at")).distinct()
    cuts = cuts.filter("at.p <> m_a and at.p <> m_b").groupBy("m_k", "m_a", "m_b").agg(F.sort_array(F.collect_list("at")).alias("at"))
    found = sides.join(cuts, (F.col("k") == F.col("m_k")) & (F.col("a") == F.col("m_a")) & (F.col("b") == F.col("m_b")), "left")
    points = F.flatten(F.array(F.array("a"), F.coalesce(F.transform("at", lambda x: x["p"]), F.array().cast("array<struct<x:double,y:double>>")), F.array("b")))
    steps = F.transform(F.sequence(F.lit(1), F.size("ps") - 1), lambda i: F.struct(F.element_at("ps", i).alias("a"), F.element_at("ps", i + 1).alias("b")))
    return found.withColumn("ps", points).select("k", F.explode(steps).alias("s")).select("k", "s.a", "s.b")


def lone_sides(parcels: DataFrame, key: str, shape: str, digits: int = 4, split: bool = True) -> DataFrame:
    """(k, a, b) of the sides that one parcel alone has, as the parcel runs."""
    sides = boundary_sides(parcels, key, shape, digits, split)
    ends = sides.groupBy(F.least("a", "b").alias("u"), F.greatest("a", "b").alias("v"))
    return ends.agg(F.count(F.lit(1)).alias("n"), F.min(F.struct("k", "a", "b")).alias("s")).filter("n = 1").select("s.*")


def odd_corners(lone: DataFrame) -> DataFrame:
    """(p, n) of the corners where other than two lone sides meet: no ring goes through them."""
    return lone.select(F.explode(F.array("a", "b")).alias("p")).groupBy("p").agg(F.count(F.lit(1)).alias("n")).filter("n <> 2")


def rings(lone: DataFrame, most_rounds: int = 60) -> DataFrame:
    """(ring, place, point, size) of every corner of the rings that ``lone`` sides (a, b) close, in order: from the ring's least corner, by which
    it is named, towards the lesser of its neighbours. Sides in chains that don't close, or that meet at odd corners, are in no ring."""
    darts = lone.select("a", "b").unionByName(lone.select(F.col("b").alias("a"), F.col("a").alias("b")))
    out = darts.groupBy("a").agg(F.collect_set("b").alias("to"), F.count(F.lit(1)).alias("n")).filter("n = 2 and size(to) = 2").select(F.col("a").alias("at"), "to")
    follow = darts.join(out, F.col("b") == F.col("at")).withColumn("on", F.when(F.col("to")[0] == F.col("a"), F.col("to")[1]).otherwise(F.col("to")[0]))
    dart = lambda a, b: F.struct(F.col(a).alias("a"), F.col(b).alias("b"))
    jump = cut(follow.select(dart("a", "b").alias("d"), dart("b", "on").alias("at"), dart("a", "b").alias("low"), F.lit(0).cast("long").alias("steps"), F.lit(1).cast("long").alias("span")), "rings")
    before = None
    for _ in range(most_rounds):
        then = jump.select(F.col("d").alias("t_d"), F.col("at").alias("t_at"), F.col("low").alias("t_low"), F.col("steps").alias("t_steps"))
        # A chain that ends loses its sides, from its end on.
        both = jump.join(then, F.col("at") == F.col("t_d"))
        nearer = F.col("low") <= F.col("t_low")
        jump = cut(
            both.select(
                "d", F.col("t_at").alias("at"), F.least("low", "t_low").alias("low"),
                F.when(nearer, F.col("steps")).otherwise(F.col("span") + F.col("t_steps")).alias("steps"), (F.col("span") * 2).alias("span"),
            ),
            "rings",
        )
        state = jump.agg(F.count(F.lit(1)), F.sum(F.xxhash64("d", "low").cast("decimal(38,0)"))).first()
        if state == before:
            break
        before = state
    else:
        raise RuntimeError(f"a ring is longer than 2 ** {most_rounds} sides")
    # Either direction is a ring of its own; the one that begins towards the lesser neighbour stays.
    sizes = jump.groupBy("low").agg(F.count(F.lit(1)).alias("size"))
    first = sizes.groupBy("low.a").agg(F.min(F.struct("low", "size")).alias("f")).select(F.col("f.low").alias("f_low"), F.col("f.size").alias("size"))
    rows = jump.join(first, F.col("low") == F.col("f_low"))
    return rows.select(F.col("low.a").alias("ring"), F.pmod(F.col("size") - F.col("steps"), F.col("size")).alias("place"), F.col("d.a").alias("point"), "size")


def gap_loops(parcels: DataFrame, key: str, shape: str, digits: int = 4) -> tuple[DataFrame, DataFrame]:
    """(loops, corners) of what parcels leave open. Loops: x and y of the least corner, n_sides, area, and is_gap, true for a hole between parcels,
    false for an outline of the whole. Corners: x, y of the loop, place, px, py. Loops with an odd corner are left out."""
    lone = cut(lone_sides(parcels, key, shape, digits), "lone-sides")
    found = cut(rings(lone), "gap-rings")
    # A parcel lies to the left of its sides, so a hole runs clockwise.
    ends = found.select(F.col("ring").alias("r"), F.col("point").alias("p"), "size")
    cross = F.col("a.x") * F.col("b.y") - F.col("b.x") * F.col("a.y")
    sides = lone.join(ends, F.col("a") == F.col("p"))
    loops = sides.groupBy("r").agg(F.count(F.lit(1)).alias("n_sides"), (F.sum(cross) / 2).alias("signed"))
    loops = loops.select(F.col("r.x").alias("x"), F.col("r.y").alias("y"), "n_sides", F.abs("signed").alias("area"), (F.col("signed") < 0).alias("is_gap"))
    corners = found.select(F.col("ring.x").alias("x"), F.col("ring.y").alias("y"), "place", F.col("point.x").alias("px"), F.col("point.y").alias("py"))
    return loops, corners


def open_sides(parcels: DataFrame, key: str, shape: str, digits: int = 4) -> DataFrame:
    """(key, x0, y0, x1, y1) of sides that one parcel alone has, whichever way they run: the outlines of gaps and of the whole. Points are
    compared to so many digits."""
    rows = parcels.select(F.col(key).alias("k"), F.explode(geometry._edges(F.col(shape))).alias("e"))
    at = lambda p: F.struct(F.round(F.col(f"e.{p}.x"), digits).alias("x"), F.round(F.col(f"e.{p}.y"), digits).alias("y"))
    ends = rows.select("k", F.least(at("a"), at("b")).alias("u"), F.greatest(at("a"), at("b")).alias("v")).filter("u <> v")
    lone = ends.groupBy("u", "v").agg(F.count(F.lit(1)).alias("n"), F.min("k").alias("k")).filter("n = 1")
    return lone.select(F.col("k").alias(key), F.col("u.x").alias("x0"), F.col("u.y").alias("y0"), F.col("v.x").alias("x1"), F.col("v.y").alias("y1"))
