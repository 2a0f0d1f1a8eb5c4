"""Numbers of the generator against a plain loop."""

import math

from pyspark.sql import functions as F

from plumbline.operators import synthetic


def loop(seed, n):
    """The first n numbers, one after the other, in signed 32-bit steps."""
    mask, state, out = (1 << 32) - 1, seed & 0xFFFFFFFF, []
    for _ in range(n):
        state = (state + 0x6D2B79F5) & mask
        t = ((state ^ (state >> 15)) * (1 | state)) & mask
        t ^= (t + (((t ^ (t >> 7)) * (61 | t)) & mask)) & mask
        out.append(((t ^ (t >> 14)) & mask) / 4294967296)
    return out


def test_numbers_are_those_of_a_loop(spark):
    seeds = [0, 1, 42, 0x9E3779B9, (1 << 32) - 1, 1 << 33, -7]
    df = spark.createDataFrame([(s,) for s in seeds], "seed long").select("seed", F.explode(F.sequence(F.lit(1), F.lit(200))).alias("n"))
    got = {(r["seed"], r["n"]): (r["u"], r["g"]) for r in df.select("seed", "n", synthetic.uniform("seed", "n").alias("u"), synthetic.gaussian("seed", "n").alias("g")).collect()}
    for s in seeds:
        want = loop(s, 201)
        assert [got[s, n][0] for n in range(1, 201)] == want[:200]
        for n in range(1, 201):
            u, v = max(want[n - 1], 1e-12), max(want[n], 1e-12)
            assert math.isclose(got[s, n][1], math.sqrt(-2 * math.log(u)) * math.cos(2 * math.pi * v), abs_tol=1e-9)
    far = spark.range(1).select(synthetic.uniform(F.lit(3), F.lit(5_000_000_000)).alias("u")).first()["u"]
    state = (3 + 5_000_000_000 * 0x6D2B79F5 - 0x6D2B79F5) & 0xFFFFFFFF
    assert far == loop(state, 1)[0]
