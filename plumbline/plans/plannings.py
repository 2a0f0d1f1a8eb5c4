"""Planning of networks: candidate sets for each supplier's network."""

from __future__ import annotations

from pyspark.sql import functions as F

from plumbline.operators import scenarios
from plumbline.plans.registry import Registry
from plumbline.tables import table

plannings = Registry()

TARGET, MOST = 0.0016, 2
_KINDS = ("cross-tie", "brace-point", "existing-set", "cross-tie")


def _planned(spark, sf_dir):
    """A free station by one vector from a fixed one, and four sets of a vector each, some of them as good as others."""
    k = F.col("s_suppkey")
    s = table(spark, sf_dir, "supplier").select(k.alias("net"), (0.004 + (k % 5) * 0.001).alias("s0"))
    row = [F.lit("gps").alias("type"), F.lit(1).alias("from_id"), F.lit(2).alias("to_id"), F.lit(None).cast("int").alias("at_id"), F.lit(None).cast("double").alias("value"), F.lit(None).cast("double").alias("value_n")]
    obs = s.select("net", F.lit(1).alias("obs_id"), *row, F.col("s0").alias("sigma"))
    sets = F.array(*(F.struct(F.lit(i).alias("i"), F.lit(kind).alias("kind")) for i, kind in enumerate(_KINDS, 1)))
    each = s.select("net", F.explode(sets).alias("c"))
    sigma = 0.002 + ((F.col("net") * F.col("c.i")) % 4) * 0.0005
    candidates = each.select("net", (F.col("c.i") + 1).alias("obs_id"), *row, sigma.alias("sigma"), F.concat(F.lit("s"), F.col("c.i").cast("string")).alias("scenario"), "c.kind")
    places = F.array(*(F.struct(F.lit(i).alias("station"), F.lit(x).alias("x"), F.lit(y).alias("y"), F.lit(0.0).alias("h"), F.lit(f).alias("fixed")) for i, x, y, f in ((1, 0.0, 0.0, True), (2, 30.0, 40.0, False))))
    return obs, s.select("net", F.explode(places).alias("p")).select("net", "p.*"), candidates


_SETS = f"""n AS (SELECT s_suppkey AS net, 0.004 + (s_suppkey % 5) * 0.001 AS s0 FROM supplier),
c AS (SELECT net, s0, i, ['{"', '".join(_KINDS)}'][i] AS kind, 0.002 + ((net * i) % 4) * 0.0005 AS s FROM n, range(1, 5) t(i)),
o AS (SELECT *, CASE kind WHEN 'existing-set' THEN 1 WHEN 'cross-tie' THEN 2 ELSE 3 END AS k, round(sqrt(CAST(1 / (1 / (s0 * s0)) AS DOUBLE)), 10) AS was, round(CAST(sqrt(1 / (1 / (s0 * s0) + 1 / (s * s))) AS DOUBLE), 10) AS m FROM c)"""


@plannings.query(f"""
WITH {_SETS} SELECT net, 's' || i AS scenario, CAST(row_number() OVER (PARTITION BY net ORDER BY m, k, i) AS INTEGER) AS rank, round(m - was, 8) AS d_worst_major, round(m - was, 8) AS d_path_worst, round((m - was) * -88875, 3) AS score, m <= {TARGET} AS reached FROM o""")
def planning_scores(spark, sf_dir):
    """Every candidate set of every network, scored by a low-rank change of its covariance."""
    rows = scenarios.recommendations(*_planned(spark, sf_dir), target=TARGET, most=4)
    return rows.select("net", "scenario", "rank", *(F.round(c, 8).alias(c) for c in ("d_worst_major", "d_path_worst")), F.round("score", 3).alias("score"), "reached")


@plannings.query(f"""
WITH {_SETS}, g AS (SELECT net, was, i, row_number() OVER w AS step, round(sqrt(1 / (1 / (s0 * s0) + sum(1 / (s * s)) OVER w)), 10) AS m FROM o WINDOW w AS (PARTITION BY net ORDER BY m, k, i)),
e AS (SELECT net, min(was) AS was, coalesce(min(step) FILTER (m <= {TARGET}), {MOST}) AS steps FROM g WHERE step <= {MOST} GROUP BY net)
SELECT g.net, m <= {TARGET} AS reached, CAST(steps AS INTEGER) AS n_steps, round(m, 8) AS worst_major, CAST(4 - steps AS INTEGER) AS remaining, CASE WHEN m > {TARGET} THEN 'limit' END AS reason,
  (SELECT string_agg('s' || i, ',' ORDER BY step) FROM g h WHERE h.net = g.net AND h.step <= steps) AS taken FROM g JOIN e ON e.net = g.net AND g.step = steps""")
def threshold_plan(spark, sf_dir):
    """Sets added one after the other until the station is good enough, two at most."""
    plan, steps = scenarios.threshold_plan(*_planned(spark, sf_dir), TARGET, MOST)
    taken = steps.groupBy(F.col("net").alias("t_net")).agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("step", "scenario"))), lambda x: x["scenario"]), ",").alias("taken"))
    return plan.join(taken, F.col("net") == F.col("t_net"), "left").drop("t_net").withColumn("worst_major", F.round("worst_major", 8))
