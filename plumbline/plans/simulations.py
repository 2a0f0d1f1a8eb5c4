"""Seeded numbers and networks."""

from __future__ import annotations

from pyspark.sql import functions as F

from plumbline.operators import synthetic
from plumbline.plans.registry import Registry
from plumbline.tables import spread, table

simulations = Registry()


@simulations.query("""
WITH s AS (SELECT o_orderkey AS k, ((o_orderkey * 7919) % 4294967296 + (o_custkey + 1) * 1831565813) % 4294967296 AS s FROM orders),
t AS (SELECT k, CAST((CAST(xor(s, s >> 15) AS HUGEINT) * (s | 1)) % 4294967296 AS BIGINT) AS t FROM s),
u AS (SELECT k, xor(t, CAST((t + (CAST(xor(t, t >> 7) AS HUGEINT) * (t | 61)) % 4294967296) % 4294967296 AS BIGINT)) AS t FROM t)
SELECT k AS o_orderkey, round(xor(t, t >> 14) / 4294967296.0::DOUBLE, 9) AS number FROM u""")
def seeded_numbers(spark, sf_dir):
    """For each order some number of a generator with a seed of its own."""
    k = F.col("o_orderkey")
    return table(spark, sf_dir, "orders").select("o_orderkey", F.round(synthetic.uniform(k * 7919, F.col("o_custkey") + 1), 9).alias("number"))


def _seeds(spark, sf_dir):
    return spread(table(spark, sf_dir, "supplier")).select(F.col("s_suppkey").alias("net"), (F.col("s_suppkey") * 1009 + 5).alias("seed"))


@simulations.query("SELECT s_suppkey AS net, true AS converged, 0.0::DOUBLE AS worst, CAST(30 - 10 - 6 AS BIGINT) AS dof FROM supplier")
def exact_recovery(spark, sf_dir):
    """Networks without noise: the truth comes back."""
    out = synthetic.recovery(*synthetic.seeded_networks(_seeds(spark, sf_dir), noisy=False))
    return out.select("net", "converged", F.round("worst", 5).alias("worst"), "dof")


@simulations.query("SELECT count(*) AS runs, count(*) AS converged, true AS recovered, true AS as_expected FROM supplier")
def monte_carlo(spark, sf_dir):
    """Networks with noise: none is off by 3 cm, and residuals are as large as their sigmas say."""
    out = synthetic.monte_carlo(synthetic.recovery(*synthetic.seeded_networks(_seeds(spark, sf_dir))))
    return out.select("runs", "converged", (F.col("worst") < 0.03).alias("recovered"), (F.col("mean_s0").between(0.9, 1.1) & (F.col("passed") > 0.85)).alias("as_expected"))
