"""Splits by area against the area that was asked for, and against a sweep of lines."""

import math
import random

from plumbline.operators import splits

SHAPE = "k int, p array<struct<x:double,y:double>>, px double, py double, area double"


def left_area(points, x, y, az):
    """By cutting the polygon with the half-plane."""
    side = lambda p: math.sin(az) * (p[1] - y) - math.cos(az) * (p[0] - x)
    out = []
    for a, b in zip(points, points[1:] + points[:1]):
        u, v = side(a), side(b)
        if u >= 0:
            out.append(a)
        if u * v < 0:
            out.append((a[0] + u / (u - v) * (b[0] - a[0]), a[1] + u / (u - v) * (b[1] - a[1])))
    return sum(a[0] * b[1] - b[0] * a[1] for a, b in zip(out, out[1:] + out[:1])) / 2


def test_split_by_area(spark):
    r = random.Random(5)
    rows, convex = [], {}
    for k in range(120):
        n = r.randint(3, 9)
        angles = sorted(r.uniform(0, 2 * math.pi) for _ in range(n))
        points = [(50 * k + (20 + k) * math.cos(t), 7 + 15 * math.sin(t)) for t in angles]
        w = [r.random() for _ in points]
        px, py = (sum(v * p[c] for v, p in zip(w, points)) / sum(w) for c in (0, 1))
        if k % 5 == 1:  # on a side
            t = r.random()
            px, py = (points[0][c] + t * (points[1][c] - points[0][c]) for c in (0, 1))
        if k % 5 == 2:  # at a corner
            px, py = points[0]
        if k % 5 == 3 and k > 50:  # outside
            px += 1000.0
        total = sum(a[0] * b[1] - b[0] * a[1] for a, b in zip(points, points[1:] + points[:1])) / 2
        area = total * r.choice([0.02, 0.3, 0.5, 0.61, 0.97])
        convex[k] = points, px, py, area, total
        rows.append((k, points if k % 2 else points[::-1], px, py, area))
    rows += [(900, [(0.0, 0.0), (1.0, 1.0)], 0.5, 0.5, 0.1), (901, None, 0.0, 0.0, 1.0), (902, rows[0][1], rows[0][2], rows[0][3], None)]
    got = {x["k"]: x for x in splits.split_by_area(spark.createDataFrame(rows, SHAPE), "k", "p", "px", "py", "area").collect()}
    assert len(got) == len(rows) and all(got[k]["left"] is None for k in (900, 901, 902))
    split = 0
    for k, (points, px, py, area, total) in convex.items():
        if k % 5 == 3 and k > 50:
            assert got[k]["azimuth"] is None
            continue
        sweep = [left_area(points, px, py, math.radians(a / 4)) - area for a in range(1440)]
        crossing = [a for a in range(1440) if sweep[a] * sweep[(a + 1) % 1440] <= 0]
        assert (got[k]["azimuth"] is not None) or not crossing, k
        if got[k]["azimuth"] is not None:
            split += 1
            az = got[k]["azimuth"]
            assert abs(left_area(points, px, py, az) - area) < 1e-6, (k, az)
            assert abs(got[k]["left_area"] - area) < 1e-6 and abs(got[k]["left_area"] + got[k]["right_area"] - total) < 1e-6
            assert not crossing or math.degrees(az) <= crossing[0] / 4 + 0.25 + 1e-6, k
    assert split > 60


def test_split_by_bearing(spark):
    square = [(0.0, 0.0), (4.0, 0.0), (4.0, 4.0), (0.0, 4.0)]
    rows = [(1, square, 1.0, 1.0, 0.0), (2, square[::-1], 1.0, 1.0, math.pi / 2), (3, square, 9.0, 9.0, 0.0), (4, square, 0.0, 0.0, 0.0)]
    df = spark.createDataFrame(rows, SHAPE).withColumnRenamed("area", "az")
    got = {x["k"]: (x["left_area"], x["right_area"]) for x in splits.split_by_bearing(df, "p", "px", "py", "az").collect()}
    assert got[1] == (4.0, 12.0) and got[2] == (12.0, 4.0) and got[3] == got[4] == (None, None)
