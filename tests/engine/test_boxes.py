"""Joins of boxes of very different shapes."""

import random

from pyspark.sql import functions as F

from plumbline.functions import geometry
from plumbline.operators import parcels


def _boxes(n, seed):
    rng, out = random.Random(seed), []
    for k in range(n):
        x, y = rng.uniform(-50, 50), rng.uniform(-50, 50)
        out.append((k, x, y, x + rng.choice([0.0, 0.3, 5.0, 60.0]), y + rng.choice([0.0, 0.5, 7.0, 40.0])))
    return out


def test_each_pair_once(spark):
    a, b = _boxes(60, 1), _boxes(70, 2)
    frame = lambda rows: spark.createDataFrame(rows, "k long, x0 double, y0 double, x1 double, y1 double")
    got = [(r["a_k"], r["b_k"]) for r in parcels.meeting_boxes(frame(a), frame(b)).collect()]
    want = [(p[0], q[0]) for p in a for q in b if p[1] <= q[3] and q[1] <= p[3] and p[2] <= q[4] and q[2] <= p[4]]
    assert sorted(got) == sorted(want)
    assert parcels.meeting_boxes(frame([]), frame(b)).count() == 0


def test_long_lines_meet_few_rows(spark):
    """A long level line stands in cells of its own length, but not of that width."""
    lines = spark.createDataFrame([(k, 0.0, float(k), 400.0, float(k)) for k in range(100)], "k long, x0 double, y0 double, x1 double, y1 double")
    boxes = spark.range(4000).select("id", (F.col("id") % 40 * 10.0).alias("x0"), F.floor(F.col("id") / 40).cast("double").alias("y0")).withColumns({"x1": F.col("x0") + 5, "y1": F.col("y0") + 0.5})
    keys = ["l_x", "c_x", "l_y", "c_y"]
    tried = 0
    for x, y, _ in parcels._ways(lines, boxes):
        left, right = (df.select(*(F.col(f"{t}_{k}").alias(k) for k in keys)) for t, df in (("a", x), ("b", y)))
        tried += left.join(right, keys).count()
    assert tried < 4000 * 100 / 10


def test_areas_of_boxes_and_others(spark):
    at = lambda *ps: geometry.polygon(list(ps))
    one = spark.range(1)
    rows = one.select(F.lit(1).alias("k"), at((0, 0), (4, 0), (4, 2), (0, 2)).alias("p")).unionByName(one.select(F.lit(2).alias("k"), at((3, 1), (9, 1), (9, 9), (3, 9)).alias("p")))
    rows = rows.unionByName(one.select(F.lit(3).alias("k"), at((0, 0), (2, 0), (0, 2)).alias("p")))
    assert {(r["a"], r["b"]): round(r["area"], 9) for r in parcels.overlaps(rows, "k", "p").collect()} == {(1, 2): 1.0, (1, 3): 2.0}
