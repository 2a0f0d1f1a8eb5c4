import math

import pytest
from pyspark.errors import PySparkException

from plumbline.operators import adjustment

OBS = "net int, obs_id int, type string, from_id int, to_id int, at_id int, value double, value_n double, sigma double, set_id string, flip180 boolean, hi double, ht double"
PLACES = "net int, station int, x double, y double, h double, fixed boolean"
TRUE = {1: (0.0, 0.0, 10.0), 2: (100.0, 0.0, 12.0), 3: (90.0, 110.0, 31.0), 4: (-5.0, 95.0, 18.0)}


def place(free):
    off = lambda s, k: 0.0 if s not in free else (0.04, -0.03, 0.05)[k]
    return [(1, s, *(v[k] + off(s, k) for k in range(3)), s not in free) for s, v in TRUE.items()]


def network(spark, only=None):
    rows = []

    def add(kind, a, b, value, set_id=None, flip=None, hi=None, ht=None):
        rows.append((1, len(rows), kind, a, b, None, value, None, 1e-5, set_id, flip, hi, ht))

    for a in TRUE:
        for b in TRUE:
            if a == b:
                continue
            dx, dy, dh = (TRUE[b][k] - TRUE[a][k] for k in range(3))
            az = math.atan2(dx, dy)
            add("direction", a, b, (az + math.pi - 0.01 + a) % (2 * math.pi), f"s{a}" if a != 3 else None)
            add("zenith", a, b, math.atan2(math.hypot(dx, dy), dh + 1.4 - 1.6), hi=1.6, ht=1.4)
            if (a, b) in ((1, 3), (2, 4)):
                add("dir", a, b, (az + math.pi) % (2 * math.pi), flip=True)
                add("dir", b, a, (az + math.pi) % (2 * math.pi))
    return spark.createDataFrame([r for r in rows if only is None or r[2] in only], OBS)


def test_directions_bearings_and_zeniths(spark):
    obs, stations = network(spark), spark.createDataFrame(place({3, 4}), PLACES)
    out = adjustment.adjust(obs, stations)
    assert out.converged
    for r in out.stations.collect():
        assert (r["x"], r["y"], r["h"]) == pytest.approx(TRUE[r["station"]], abs=1e-5)
    s = adjustment.degrees_of_freedom(out.rows).first()
    # 12 directions, 12 zeniths and 4 bearings; 6 coordinates and 4 orientations.
    assert (s["n_eq"], s["n_par"], s["dof"]) == (28, 10, 18) and s["s0"] < 1e-3
    stats = adjustment.residual_statistics(out.rows, adjustment.solve_networks(adjustment.normal_equations(out.rows), covariance=True), adjustment.degrees_of_freedom(out.rows))
    assert sum(r["redundancy"] for r in stats.collect()) == pytest.approx(18)


def test_derivatives(spark):
    """Coefficients against differences of the misclosures themselves."""
    obs, at = network(spark), place({1, 2, 3, 4})
    turned = adjustment.orientations(obs, spark.createDataFrame(at, PLACES)).collect()
    turned = spark.createDataFrame(turned, "o_net int, o_p string, o double")
    rows = lambda places: {r["obs_id"]: r for r in adjustment.equations(obs, spark.createDataFrame(places, PLACES), turned).collect()}
    base, step = rows(at), 1e-4
    for k, axis in enumerate("xyh"):
        moved = [tuple(v + step if i == 2 + k and r[1] == 3 else v for i, v in enumerate(r)) for r in at]
        for i, r in rows(moved).items():
            want = sum(t["a"] for t in base[i]["terms"] if t["p"] == f"3:{axis}")
            assert (base[i]["misclosure"] - r["misclosure"]) / step == pytest.approx(want, abs=1e-6)


GROUND = OBS + ", scale double, convergence double, prism double, mode string, refraction double"


def on_the_ground(spark):
    """Every line with a scale, a convergence, a prism constant and refraction of its own."""
    rows = []

    def add(kind, a, b, value, *more, set_id=None, hi=0.0, ht=0.0):
        rows.append((1, len(rows), kind, a, b, None, value, None, 1e-5 if kind != "dist" else 1e-4, set_id, None, hi, ht, *more))

    for a in TRUE:
        for b in TRUE:
            if a == b:
                continue
            dx, dy, dh = (TRUE[b][k] - TRUE[a][k] for k in range(3))
            scale, turn, k = 0.9996 + 1e-5 * a, 0.01 * b, 0.13 + 0.01 * a
            flat, az = math.hypot(dx, dy) / scale, math.atan2(dx, dy)
            add("dist", a, b, flat - 0.03, scale, None, 0.03, None, None)
            add("dist", a, b, math.hypot(flat, dh + 1.5 - 1.7), scale, None, None, "slope", None, hi=1.7, ht=1.5)
            add("bearing", a, b, (az + turn) % (2 * math.pi), None, turn, None, None, None)
            add("direction", a, b, (az + turn - 0.7 - a) % (2 * math.pi), None, turn, None, None, None, set_id=f"s{a}")
            add("zenith", a, b, math.atan2(flat, dh) + (1 - k) * flat / (2 * 6_371_000.0), scale, None, None, None, k)
    return spark.createDataFrame(rows, GROUND)


def test_scale_convergence_prism_and_refraction(spark):
    obs = on_the_ground(spark)
    out = adjustment.adjust(obs, spark.createDataFrame(place({3, 4}), PLACES))
    assert out.converged
    for r in out.stations.collect():
        assert (r["x"], r["y"], r["h"]) == pytest.approx(TRUE[r["station"]], abs=1e-5)
    turned = spark.createDataFrame(adjustment.orientations(obs, spark.createDataFrame(place({1, 2, 3, 4}), PLACES)).collect(), "o_net int, o_p string, o double")
    at = place({1, 2, 3, 4})
    rows = lambda places: {(r["obs_id"], r["part"]): r for r in adjustment.equations(obs, spark.createDataFrame(places, PLACES), turned).collect()}
    base, step = rows(at), 1e-4
    for k, axis in enumerate("xyh"):
        moved = [tuple(v + step if i == 2 + k and r[1] == 3 else v for i, v in enumerate(r)) for r in at]
        for i, r in rows(moved).items():
            want = sum(t["a"] for t in base[i]["terms"] if t["p"] == f"3:{axis}")
            assert (base[i]["misclosure"] - r["misclosure"]) / step == pytest.approx(want, abs=2e-6)


def test_unknown_types_are_errors(spark):
    obs, stations = network(spark, {"dir"}).replace("dir", "azimut", "type"), spark.createDataFrame(place({3, 4}), PLACES)
    with pytest.raises(PySparkException, match="unknown type"):
        adjustment.equations(obs, stations).collect()


VECTORS = "net int, obs_id int, type string, from_id int, to_id int, at_id int, value double, value_n double, value_u double, sigma double, sigma_n double, sigma_u double, corr_en double, corr_eu double, corr_nu double"


def test_correlated_vectors_and_control_equal_the_full_weight_matrix(spark):
    """Two vectors with full covariances and a station held to a correlated target, against the normal equations by matrices."""
    import numpy as np

    r = np.random.default_rng(3)
    rows, n, u = [], np.zeros((3, 3)), np.zeros(3)
    at = np.array([49.9, 70.2, 12.1])
    for i in range(2):
        s, c = r.uniform(0.002, 0.01, 3), r.uniform(-0.6, 0.6, 3)
        v = np.array([50.0, 70.0, 2.0]) + r.normal(0, 0.01, 3)
        cov = np.diag(s) @ np.array([[1, c[0], c[1]], [c[0], 1, c[2]], [c[1], c[2], 1]]) @ np.diag(s)
        w = np.linalg.inv(cov)
        n, u = n + w, u + w @ (v - (at - [0, 0, 10]))
        rows.append((1, i, "gps", 1, 2, None, *map(float, v), *map(float, s), *map(float, c)))
    sx, sy, sh, corr, target = 0.02, 0.03, 0.05, 0.7, np.array([50.03, 69.98, 12.01])
    w = np.zeros((3, 3))
    w[:2, :2] = np.linalg.inv([[sx * sx, corr * sx * sy], [corr * sx * sy, sy * sy]])
    w[2, 2] = 1 / sh**2
    n, u = n + w, u + w @ (target - at)
    schema = "net int, station int, x double, y double, h double, fixed boolean, sx double, sy double, sh double, corr_xy double, target_x double, target_y double, target_h double"
    places = [(1, 1, 0.0, 0.0, 10.0, True, *[None] * 7), (1, 2, *map(float, at), False, sx, sy, sh, corr, *map(float, target))]
    stations = spark.createDataFrame(places, schema)
    obs = spark.createDataFrame(rows, VECTORS)
    got = adjustment.normal_equations(adjustment.equations(obs, stations)).collect()
    axis = {"2:x": 0, "2:y": 1, "2:h": 2}
    for g in got:
        want = u[axis[g["i"]]] if g["j"] is None else n[axis[g["i"]], axis[g["j"]]]
        assert g["value"] == pytest.approx(want, rel=1e-9)
    out = adjustment.adjust(obs, stations)
    p = {x["station"]: x for x in out.stations.collect()}[2]
    assert (p["x"], p["y"], p["h"]) == pytest.approx(tuple(at + np.linalg.solve(n, u)), abs=1e-9) and out.converged
    assert adjustment.degrees_of_freedom(out.rows).first()["dof"] == 6


def levels(spark, values, net=1):
    rows = [(net, i, "lev", 1, 2, None, v, None, 0.002) for i, v in enumerate(values)]
    obs = spark.createDataFrame(rows, "net int, obs_id int, type string, from_id int, to_id int, at_id int, value double, value_n double, sigma double")
    return obs, spark.createDataFrame([(net, 1, 0.0, 0.0, 10.0, True), (net, 2, 0.0, 0.0, 11.2, False)], PLACES)


def test_robust_weights_and_outliers(spark):
    values = [1.0, 1.001, 0.999, 1.002, 0.998, 1.3]
    obs, stations = levels(spark, values)
    h = 1.2  # as the loop does it: weights from the residuals before
    for turn in range(15):
        w = [1.0 if turn == 0 or abs(v - h) / 0.002 <= 1.5 else max(0.001, 1.5 / (abs(v - h) / 0.002)) for v in values]
        new = sum(a * b for a, b in zip(w, values)) / sum(w)
        if abs(new - h) <= 1e-6:
            break
        h = new
    out = adjustment.adjust(obs, stations, robust_k=1.5)
    assert {r["station"]: r["h"] for r in out.stations.collect()}[2] == pytest.approx(10 + new, abs=1e-6)
    result, marked = adjustment.deweight_outliers(obs, stations, threshold=2.0, cycles=2)
    assert [(r["obs_id"], r["times"]) for r in marked.collect()] == [(5, 2)]
    w = [1 / 0.002**2] * 5 + [1 / 0.032**2]
    assert {r["station"]: r["h"] for r in result.stations.collect()}[2] == pytest.approx(10 + sum(a * b for a, b in zip(w, values)) / sum(w), abs=1e-9)


def test_networks_come_to_rest_on_their_own(spark):
    """An exact network rests after two rounds, a distorted one takes longer, one without control can't be solved or is damped; none
    holds up another."""
    exact, at = levels(spark, [1.2, 1.2])
    far, place_far = levels(spark, [1.0, 1.0], 2)
    loose = exact.withColumn("net", exact["net"] + 2)
    free = at.withColumn("net", at["net"] + 2).withColumn("fixed", at["fixed"] & (at["station"] > 5))
    out = adjustment.adjust(exact.unionByName(far).unionByName(loose), at.unionByName(place_far).unionByName(free))
    got = {r["net"]: r for r in out.summary.collect()}
    assert got[1]["iterations"] == 1 and got[2]["iterations"] == 2 and got[1]["converged"] and got[2]["converged"]
    assert got[1]["damping"] == 0.0 and got[3]["damping"] > 0


def test_drop_worst_leaves_exact_networks_alone(spark):
    obs, stations = levels(spark, [1.0, 1.0, 1.0])
    assert adjustment.drop_worst(obs, stations, threshold=0.5, cycles=1)[1].collect() == []


def test_control_rows_are_named_apart(spark):
    """As many names as held stations, however many a network has; the rows of one station share its name."""
    from pyspark.sql import functions as F
    from pyspark.sql import types as T

    places = spark.range(60_000).select((F.col("id") % 2).alias("net"), F.concat(F.lit("P"), "id").alias("station"), *(F.lit(1.0).alias(c) for c in "xyh"), (F.col("id") % 5 == 0).alias("fixed"), *(F.when(F.col("id") % 3 > 0, 0.01).alias(f"s{c}") for c in "xyh"))
    rows = adjustment.control_equations(places, T.LongType())
    held = places.filter("not fixed and sx is not null").groupBy("net").count()
    got = rows.groupBy("net").agg(F.count_distinct("obs_id").alias("names"), F.count(F.lit(1)).alias("rows"), F.max("obs_id").alias("high"))
    assert {(r["net"], r["names"], r["rows"], r["high"]) for r in got.collect()} == {(r["net"], r["count"], 3 * r["count"], -1) for r in held.collect()}
    names = adjustment.control_equations(places, T.StringType()).filter("net = 1").select("obs_id").distinct()
    assert names.filter("obs_id = 'control P1'").count() == 1
