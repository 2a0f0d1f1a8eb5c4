"""Rings from lone sides: order against a walk, long ones, and chains that don't close."""

import math
import random

from pyspark.sql import functions as F

from plumbline.operators import parcels

SIDE = "a struct<x:double,y:double>, b struct<x:double,y:double>"


def walk(points):
    """The ring from its least corner towards the lesser neighbour."""
    n, i = len(points), min(range(len(points)), key=points.__getitem__)
    step = 1 if points[(i + 1) % n] < points[i - 1] else -1
    return [points[(i + step * k) % n] for k in range(n)]


def test_order_of_rings_and_open_chains(spark):
    r = random.Random(2)
    circles = [[(100.0 * c + round(math.cos(2 * math.pi * k / n), 6), round(math.sin(2 * math.pi * k / n), 6)) for k in range(n)] for c, n in enumerate((3, 4, 7, 64, 1, 2))]
    sides = [(p, ring[(k + 1) % len(ring)]) for ring in circles[:4] for k, p in enumerate(ring)]
    sides += [((900.0 + k, 0.0), (901.0 + k, 0.0)) for k in range(9)]  # a chain
    sides += [((0.0, 50.0), (1.0, 50.0)), ((1.0, 50.0), (1.0, 51.0)), ((1.0, 51.0), (0.0, 50.0)), ((1.0, 50.0), (5.0, 55.0))]  # a ring with a tail
    sides = [s if r.random() < 0.5 else s[::-1] for s in sides]
    r.shuffle(sides)
    lone = spark.createDataFrame(sides, SIDE)
    got = {}
    for row in parcels.rings(lone).orderBy("place").collect():
        got.setdefault(tuple(row["ring"]), []).append(tuple(row["point"]))
    assert got == {min(c): walk(c) for c in circles[:4]}
    assert {(tuple(x["p"]), x["n"]) for x in parcels.odd_corners(lone).collect()} == {((900.0, 0.0), 1), ((909.0, 0.0), 1), ((1.0, 50.0), 3), ((5.0, 55.0), 1)}


def test_a_ring_of_ten_thousand_sides(spark):
    n = 10_000
    at = lambda k: F.struct(F.round(1000 * F.cos(2 * math.pi * k / n), 5).alias("x"), F.round(1000 * F.sin(2 * math.pi * k / n), 5).alias("y"))
    lone = spark.range(n).select(at(F.col("id")).alias("a"), at((F.col("id") + 1) % n).alias("b"))
    rows = parcels.rings(lone).select("place", "size", "point.x", "point.y").collect()
    assert len(rows) == n and {r["place"] for r in rows} == set(range(n)) and {r["size"] for r in rows} == {n}
    points = [(round(1000 * math.cos(2 * math.pi * k / n), 5), round(1000 * math.sin(2 * math.pi * k / n), 5)) for k in range(n)]
    got = [(r["x"], r["y"]) for r in sorted(rows)]
    assert all(math.dist(p, q) < 1e-4 for p, q in zip(got, walk(points)))


def test_sides_are_split_at_corners_of_others(spark):
    square = lambda x, y, w, h: [(x, y), (x + w, y), (x + w, y + h), (x, y + h)]
    rows = [(1, square(0.0, 0.0, 6.0, 1.0)), (2, square(0.0, 1.0, 2.0, 2.0)[::-1]), (3, square(4.0, 1.0, 2.0, 2.0)), (4, square(0.0, 3.0, 6.0, 1.0)), (5, square(20.0, 20.0, 1.0, 1.0))]
    df = spark.createDataFrame(rows, "k int, p array<struct<x:double,y:double>>")
    loops, _ = parcels.gap_loops(df, "k", "p")
    assert sorted(map(tuple, loops.collect())) == [(0.0, 0.0, 8, 24.0, False), (2.0, 1.0, 4, 4.0, True), (20.0, 20.0, 4, 1.0, False)]
    assert parcels.gap_loops(df.limit(0), "k", "p")[0].collect() == []
