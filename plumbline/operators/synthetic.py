"""Seeded networks with known truth, and what an adjustment makes of many of them.

Every random number of a network is a column expression of the network's seed and the number's place: the generator's state after n draws is the seed plus n
times a constant, so no row waits for another, rows need no order, and a lost task draws the same numbers again.

A network is a ring of stations around a centre; the ring's first station and the centre are fixed. Neighbours and spokes are observed by distances, and each free
station reads directions to its neighbours and the centre. Approximate places are off by up to 0.75 m.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.functions.angles import azimuth
from plumbline.functions.numbers import col
from plumbline.operators.adjustment import adjust, chi_square_tests, degrees_of_freedom
from plumbline.tables import cut

#: The generator's step, and the spread of approximate places.
STEP = 0x6D2B79F5
SPREAD = 1.5
_MASK = (1 << 32) - 1
#: Where the numbers of each use begin.
_SHAPE, _PLACES, _NOISE = 0, 1 << 20, 1 << 21


def _let(value: Column, then) -> Column:
    """``then(value)``, with the value worked out once."""
    return F.transform(F.array(value), then)[0]


def _times(a: Column, b: Column) -> Column:
    """The low 32 bits of the product of two numbers of 32 bits."""
    high = F.shiftleft((a * F.shiftright(b, 16)).bitwiseAND(F.lit(0xFFFF)), 16)
    return (a * b.bitwiseAND(F.lit(0xFFFF)) + high).bitwiseAND(F.lit(_MASK))


def uniform(seed, n) -> Column:
    """The n-th number (from 1) in [0, 1) of the 32-bit generator with a seed; both are taken by their low 32 bits."""
    low = lambda c: col(c).cast("long").bitwiseAND(F.lit(_MASK))
    whole = lambda v: v.bitwiseAND(F.lit(_MASK))
    state = whole(low(seed) + _times(low(n), F.lit(STEP).cast("long")))
    first = lambda s: _times(s.bitwiseXOR(F.shiftright(s, 15)), s.bitwiseOR(F.lit(1)))
    second = lambda t: t.bitwiseXOR(whole(t + _times(t.bitwiseXOR(F.shiftright(t, 7)), t.bitwiseOR(F.lit(61)))))
    return _let(_let(_let(state, first), second), lambda t: t.bitwiseXOR(F.shiftright(t, 14))) / 4294967296.0


def gaussian(seed, n) -> Column:
    """A standard normal number from the numbers n and n + 1."""
    u, v = (F.greatest(uniform(seed, col(n) + k), F.lit(1e-12)) for k in (0, 1))
    return F.sqrt(-2 * F.log(u)) * F.cos(2 * math.pi * v)


def seeded_networks(seeds: DataFrame, size: int = 6, radius: float = 200.0, sigma_m: float = 0.002, sigma_rad: float = 7e-6, noisy: bool = True) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(obs, stations, truth) of a network for each row of ``seeds`` (net, seed): ``size`` ring stations P1 ... and the centre P0."""
    ring = seeds.select("net", "seed", F.explode(F.sequence(F.lit(0), F.lit(size))).alias("i"))
    angle = 2 * math.pi * (F.col("i") - 1 + 0.5 * (uniform("seed", 2 * F.col("i") + _SHAPE + 1) - 0.5)) / size
    out = radius * (0.8 + 0.4 * uniform("seed", 2 * F.col("i") + _SHAPE + 2))
    centre = F.col("i") == 0
    truth = ring.select("net", "seed", "i", *(F.when(centre, 0.0).otherwise(out * f(angle)).alias(c) for c, f in (("x", F.sin), ("y", F.cos))))
    name = lambda c: F.concat(F.lit("P"), F.col(c).cast("string"))
    off = lambda k: F.when(F.col("i") <= 1, 0.0).otherwise(SPREAD * (uniform("seed", 2 * F.col("i") + _PLACES + k) - 0.5))
    stations = truth.select("net", name("i").alias("station"), (F.col("x") + off(1)).alias("x"), (F.col("y") + off(2)).alias("y"), F.lit(0.0).alias("h"), (F.col("i") <= 1).alias("fixed"))

    # Each ring station sees the next one, the one before and the centre.
    after = F.when(F.col("i") == size, 1).otherwise(F.col("i") + 1)
    before = F.when(F.col("i") == 1, size).otherwise(F.col("i") - 1)
    sight = lambda k, to, kind: F.struct(F.lit(k).alias("k"), to.alias("j"), F.lit(kind).alias("type"))
    sights = F.array(sight(0, after, "dist"), sight(1, F.lit(0), "dist"), sight(2, after, "direction"), sight(3, before, "direction"), sight(4, F.lit(0), "direction"))
    ends = truth.filter("i > 0").select("net", "seed", "i", F.col("x").alias("fx"), F.col("y").alias("fy"), F.explode(sights).alias("s"))
    ends = ends.select("net", "seed", "i", "fx", "fy", "s.k", "s.j", "s.type")
    to = truth.select(F.col("net").alias("t_net"), F.col("i").alias("t_i"), F.col("x").alias("tx"), F.col("y").alias("ty"))
    rows = ends.join(to, (F.col("net") == F.col("t_net")) & (F.col("j") == F.col("t_i")))
    dx, dy = F.col("tx") - F.col("fx"), F.col("ty") - F.col("fy")
    number = 5 * F.col("i") + F.col("k")
    noise = gaussian("seed", 2 * number + _NOISE + 1) if noisy else F.lit(0.0)
    sigma = F.when(F.col("type") == "dist", sigma_m).otherwise(sigma_rad)
    # A circle's zero lies anywhere: the orientation is unknown.
    circle = 2 * math.pi * uniform("seed", F.col("i") + _NOISE // 2 * 3)
    value = F.when(F.col("type") == "dist", F.hypot(dx, dy)).otherwise(azimuth(dx, dy) - circle) + noise * sigma
    obs = rows.select(
        "net", number.cast("long").alias("obs_id"), "type", name("i").alias("from_id"), name("j").alias("to_id"), F.lit(None).cast("string").alias("at_id"), value.alias("value"),
        F.lit(None).cast("double").alias("value_n"), sigma.alias("sigma"), name("i").alias("set_id"),
    )
    return obs, stations, truth.select("net", name("i").alias("station"), "x", "y")


def recovery(obs: DataFrame, stations: DataFrame, truth: DataFrame) -> DataFrame:
    """(net, converged, worst, rms, s0, dof, chi_pass) of every network: how far its adjusted free stations lie from the truth, and its global test."""
    done = adjust(obs, stations)
    at = truth.select(F.col("net").alias("t_net"), F.col("station").alias("t_s"), F.col("x").alias("tx"), F.col("y").alias("ty"))
    off = done.stations.filter("not fixed").join(at, (F.col("net") == F.col("t_net")) & (F.col("station") == F.col("t_s"))).withColumn("d2", (F.col("x") - F.col("tx")) ** 2 + (F.col("y") - F.col("ty")) ** 2)
    far = off.groupBy(F.col("net").alias("o_net")).agg(F.sqrt(F.max("d2")).alias("worst"), F.sqrt(F.avg("d2")).alias("rms"))
    state = done.summary.select(F.col("net").alias("c_net"), "converged")
    tests = chi_square_tests(cut(degrees_of_freedom(cut(done.rows, "recovery-rows")), "recovery-tests"))
    out = tests.join(far, F.col("net") == F.col("o_net")).join(state, F.col("net") == F.col("c_net"), "left")
    return out.select("net", F.coalesce("converged", F.lit(False)).alias("converged"), "worst", "rms", "s0", "dof", F.col("pass").alias("chi_pass"))


def monte_carlo(runs: DataFrame) -> DataFrame:
    """One row over ``recovery`` of many seeds: runs, converged, mean_rms, worst, mean_s0 and the share of runs that pass the global test."""
    return runs.agg(
        F.count(F.lit(1)).alias("runs"), F.count_if("converged").alias("converged"), F.avg("rms").alias("mean_rms"), F.max("worst").alias("worst"), F.avg("s0").alias("mean_s0"), F.avg(F.col("chi_pass").cast("double")).alias("passed")
    )
