"""Polygons, clipping, groups and ways against plain calculations."""

import math
import random

from pyspark.sql import functions as F

from plumbline.functions import geometry as g
from plumbline.operators import parcels, planning

SHAPES = "k int, p array<struct<x:double,y:double>>"


def turned_square(cx, cy, half, angle):
    return [(cx + half * math.sqrt(2) * math.cos(angle + math.pi / 2 * i), cy + half * math.sqrt(2) * math.sin(angle + math.pi / 2 * i)) for i in range(4)]


def plain_area(p):
    return sum(a[0] * b[1] - b[0] * a[1] for a, b in zip(p, p[1:] + p[:1])) / 2


def plain_clip(p, q):
    for a, b in zip(q, q[1:] + q[:1]):
        side = lambda v: (b[0] - a[0]) * (v[1] - a[1]) - (b[1] - a[1]) * (v[0] - a[0])  # noqa: B023, E731
        out = []
        for u, v in zip(p, p[1:] + p[:1]):
            su, sv = side(u), side(v)
            if su >= 0:
                out.append(u)
            if su * sv < 0:
                t = su / (su - sv)
                out.append((u[0] + t * (v[0] - u[0]), u[1] + t * (v[1] - u[1])))
        p = out
    return p


def test_overlaps_of_turned_squares(spark):
    r = random.Random(5)
    squares = [turned_square(r.uniform(0, 60), r.uniform(0, 60), r.choice([1, 2, 3, 30]), r.uniform(0, 7)) for _ in range(40)]
    df = spark.createDataFrame(list(enumerate(squares)), SHAPES)
    got = {(x["a"], x["b"]): x["area"] for x in parcels.overlaps(df, "k", "p", 1e-9).collect()}
    want = {(i, j): a for i in range(40) for j in range(i + 1, 40) if (c := plain_clip(squares[i], squares[j])) and (a := abs(plain_area(c))) > 1e-9}
    assert set(got) == set(want) and all(abs(got[k] - want[k]) < 1e-6 for k in want) and len(want) > 30
    assert parcels.overlaps(df.limit(0), "k", "p").collect() == []


def test_points_and_lines(spark):
    u = [(0, 0), (4, 0), (4, 4), (3, 1), (1, 1), (0, 4)]  # a notch
    df = spark.createDataFrame([(0, [tuple(map(float, v)) for v in u])], SHAPES)
    left, right = g.split_by_line(F.col("p"), F.lit(2.0), F.lit(0.0), F.lit(2.0), F.lit(1.0))
    row = df.select(
        g.contains("p", F.lit(0.5), F.lit(2.0)), g.contains("p", F.lit(2.0), F.lit(2.0)), g.blocks("p", F.lit(-1.0), F.lit(5.0), F.lit(5.0), F.lit(5.0)), g.blocks("p", F.lit(-1.0), F.lit(2.0), F.lit(5.0), F.lit(2.0)),
        g.blocks("p", F.lit(0.2), F.lit(0.2), F.lit(0.3), F.lit(0.3)), g.signed_area("p"), g.centroid("p")[0], g.signed_area(left), g.signed_area(right), g.segments_meet(*map(F.lit, (0.0, 0.0, 2.0, 0.0, 2.0, 0.0, 2.0, 5.0))),
    ).first()
    area = plain_area(u)
    assert list(row[:5]) == [True, False, False, True, True] and row[5] == area and abs(row[6] - 2) < 1e-12 and abs(row[7] - area / 2) < 1e-9 and abs(row[8] - area / 2) < 1e-9 and row[9] is True
    empty = spark.createDataFrame([(0, [])], SHAPES).select(g.signed_area("p"), g.centroid("p")[0]).first()
    assert empty[0] == 0.0 and empty[1] is None


def test_ways_and_groups(spark):
    known = spark.createDataFrame([(1, "a", 0.0, 0.0)], "net int, station string, x double, y double")
    legs = spark.createDataFrame([(1, "a", "b", 0.0, 10.0), (1, "c", "b", math.pi / 2, 5.0), (1, "x", "y", 0.0, 1.0)], "net int, from_id string, to_id string, azimuth double, distance double")
    got = {r["station"]: (round(r["x"], 6), round(r["y"], 6)) for r in planning.bootstrap(known, legs).collect()}
    assert got == {"a": (0.0, 0.0), "b": (0.0, 10.0), "c": (-5.0, 10.0)}
    edges = spark.createDataFrame([(1, 1, 2), (1, 2, 3), (1, 3, 4)], "net int, a int, b int")
    pieces = lambda *a: [(r["stations"], r["pieces"]) for r in planning.pieces_without(edges, *a).collect()]
    assert pieces(9) == [(4, 1)] and pieces(2) == [(2, 1)] and pieces(2, (1, 3)) == [(3, 1)]
    points = spark.createDataFrame([(1, f"P{i}", float(x), 0.0) for i, x in enumerate([0, 1, 2, 1.5, 9, 10])] + [(1, "P10", 2.5, 0.0)], "g int, k string, x double, y double")
    groups = {r["k"]: r["group"] for r in planning.complete_linkage(points, "g", "k", 1.0).collect()}
    assert groups == {"P0": 0, "P1": 0, "P2": 1, "P3": 1, "P4": 2, "P5": 2, "P10": 1}
