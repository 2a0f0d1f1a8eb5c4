"""Networks that grow with the tables: one for each supplier, or for groups of orders."""

from __future__ import annotations

from pyspark.sql import functions as F

from plumbline.operators import adjustment, graph, precision
from plumbline.plans.measurements import rounded
from plumbline.plans.registry import Registry
from plumbline.plans.reviews import SHOTS_SQL, shots
from plumbline.tables import cut, spread, table

networks = Registry()

#: Every so many suppliers have a grid of LARGE x LARGE stations, the others a square of 4.
EVERY, LARGE = 40, 8


def grids(spark, sf_dir):
    """A braced grid for each supplier: two fixed corners, approximate places off by centimetres, all sides, diagonals and levels to a
    millimetre, so that the truth must come back."""
    k = F.when(F.col("s_suppkey") % EVERY == 0, LARGE).otherwise(2)
    n = spread(table(spark, sf_dir, "supplier")).select(F.col("s_suppkey").alias("net"), k.cast("int").alias("k"), (100.0 + F.col("s_suppkey") % 50).alias("s"))
    cells = n.withColumn("i", F.explode(F.sequence(F.lit(0), F.col("k") - 1))).withColumn("j", F.explode(F.sequence(F.lit(0), F.col("k") - 1)))
    number = F.col("j") * F.col("k") + F.col("i") + 1
    truth = cells.select("net", "k", "i", "j", number.alias("station"), (F.col("s") * F.col("i")).alias("tx"), (F.col("s") * F.col("j")).alias("ty"), number.cast("double").alias("th"))
    fixed = (F.col("j") == 0) & (F.col("i") <= 1)
    off = F.when(fixed, 0.0).otherwise(0.03)
    stations = truth.select("net", "station", (F.col("tx") + off).alias("x"), (F.col("ty") - off).alias("y"), (F.col("th") + off).alias("h"), fixed.alias("fixed"))
    steps = F.array(*(F.struct(F.lit(a).alias("di"), F.lit(b).alias("dj"), F.lit(c).alias("oi")) for a, b, c in ((1, 0, 0), (0, 1, 0), (1, 1, 0), (-1, 1, 1))))
    ends = truth.select("net", "k", "i", "j", "tx", "ty", "th", "station", F.explode(steps).alias("d"))
    to_i, to_j = F.col("i") + F.col("d.di"), F.col("j") + F.col("d.dj")
    ends = ends.filter((to_i >= 0) & (to_i < F.col("k")) & (to_j < F.col("k"))).withColumn("to_id", to_j * F.col("k") + to_i + 1)
    side = F.col("tx") / F.greatest(F.col("i"), F.lit(1))
    step = F.when(F.col("i") > 0, side).otherwise(F.col("ty") / F.greatest(F.col("j"), F.lit(1)))
    step = F.when((F.col("i") == 0) & (F.col("j") == 0), F.lit(100.0) + F.col("net") % 50).otherwise(step)
    dist = step * F.sqrt((F.abs("d.di") + F.abs("d.dj")).cast("double"))
    key = F.col("station") * 100_000 + F.col("to_id") * 10
    both = F.array(F.struct(F.lit("dist").alias("type"), key.alias("obs_id"), dist.alias("value")), F.struct(F.lit("lev").alias("type"), (key + 1).alias("obs_id"), (F.col("to_id") - F.col("station")).cast("double").alias("value")))
    obs = ends.select("net", F.col("station").alias("from_id"), "to_id", F.explode(both).alias("o"))
    obs = obs.select("net", F.col("o.obs_id").alias("obs_id"), F.col("o.type").alias("type"), "from_id", "to_id", F.lit(None).cast("int").alias("at_id"), F.col("o.value").alias("value"), F.lit(None).cast("double").alias("value_n"), F.lit(0.001).alias("sigma"))
    return obs, stations


_GRID = f"""n AS (SELECT s_suppkey AS net, CASE WHEN s_suppkey % {EVERY} = 0 THEN {LARGE} ELSE 2 END AS k, 100.0 + s_suppkey % 50 AS s FROM supplier),
c AS (SELECT net, k, s, unnest(range(k * k)) AS p FROM n)"""


@networks.query(f"""
WITH {_GRID} SELECT net, CAST(p + 1 AS INTEGER) AS station, round(CAST(s * (p % k) AS DOUBLE), 4) AS x, round(CAST(s * (p // k) AS DOUBLE), 4) AS y, CAST(p + 1 AS DOUBLE) AS h, true AS converged FROM c""")
def network_adjust(spark, sf_dir):
    """Gauss-Newton on all networks together; exact observations give back the true coordinates."""
    obs, stations = grids(spark, sf_dir)
    out = adjustment.adjust(obs, stations)
    state = out.summary.select(F.col("net").alias("__n"), "converged")
    rows = out.stations.join(state, F.col("net") == F.col("__n"), "left")
    # A tiny offset keeps -0.0 from the result.
    return rows.select("net", "station", *(F.round(F.round(c, 4) + 0.0, 4).alias(c) for c in ("x", "y", "h")), F.coalesce("converged", F.lit(True)).alias("converged"))


@networks.query(f"SELECT s_suppkey AS net, 100041 AS obs_id FROM supplier WHERE s_suppkey % {EVERY} <> 0 AND s_suppkey % 3 = 0")
def auto_adjust(spark, sf_dir):
    """In a third of the squares one levelled height is wrong by 5 cm: a cycle of adjusting and dropping the worst row finds just those.
    With 6 degrees of freedom no standardised residual can pass 2.45, hence the threshold."""
    obs, stations = grids(spark, sf_dir)
    wrong = (F.col("obs_id") == 100041) & (F.col("net") % EVERY != 0) & (F.col("net") % 3 == 0)
    return adjustment.drop_worst(obs.withColumn("value", F.when(wrong, F.col("value") + 0.05).otherwise(F.col("value"))), stations, threshold=2.0, cycles=1)[1]


def _noise(n):
    return f"((s_suppkey * {7 * n + 3} + {n * n}) % 11 - 5) * 0.001"


_RUNS = 6
_REPEATED = "r AS (" + " UNION ALL ".join(f"SELECT s_suppkey AS net, {i} AS obs_id, 1.0 + {_noise(i)} AS v FROM supplier" for i in range(1, _RUNS + 1)) + ")"


def repeated_levels(spark, sf_dir):
    """One free height in each network, levelled six times with noise."""
    s = spread(table(spark, sf_dir, "supplier")).select(F.col("s_suppkey").alias("net"))
    runs = F.array(*(F.struct(F.lit(i).alias("obs_id"), (1.0 + ((F.col("net") * (7 * i + 3) + i * i) % 11 - 5) * 0.001).alias("value")) for i in range(1, _RUNS + 1)))
    obs = s.select("net", F.explode(runs).alias("o")).select("net", "o.obs_id", F.lit("lev").alias("type"), F.lit(1).alias("from_id"), F.lit(2).alias("to_id"), F.lit(None).cast("int").alias("at_id"), "o.value", F.lit(None).cast("double").alias("value_n"), F.lit(0.002).alias("sigma"))
    place = F.array(*(F.struct(F.lit(k).alias("station"), F.lit(h).alias("h"), F.lit(f).alias("fixed")) for k, h, f in ((1, 10.0, True), (2, 11.1, False))))
    stations = s.select("net", F.explode(place).alias("p")).select("net", "p.station", F.lit(0.0).alias("x"), F.lit(0.0).alias("y"), "p.h", "p.fixed")
    return obs, stations


@networks.query(f"""
WITH {_REPEATED}, b AS (SELECT net, sqrt(sum((v - m) ** 2) / 0.002 ** 2 / {_RUNS - 1}) AS base FROM (SELECT *, avg(v) OVER (PARTITION BY net) AS m FROM r) GROUP BY net),
c AS (SELECT net, obs_id FROM (SELECT *, abs(v - avg(v) OVER (PARTITION BY net)) AS t FROM r) QUALIFY row_number() OVER (PARTITION BY net ORDER BY round(t, 9) DESC, obs_id) <= 3),
o AS (SELECT c.net, c.obs_id, sqrt(sum((r.v - w.m) ** 2) / 0.002 ** 2 / {_RUNS - 2}) AS s0 FROM c JOIN r ON r.net = c.net AND r.obs_id <> c.obs_id
  JOIN (SELECT c.net, c.obs_id, avg(r.v) AS m FROM c JOIN r ON r.net = c.net AND r.obs_id <> c.obs_id GROUP BY ALL) w ON w.net = c.net AND w.obs_id = c.obs_id GROUP BY ALL)
SELECT o.net, o.obs_id, round(s0, 5) AS s0, round(base, 5) AS base_s0, round(s0 - base, 5) AS delta_s0 FROM o JOIN b ON o.net = b.net""")
def leave_one_out_impact(spark, sf_dir):
    """The three observations of each network with the largest residuals, left out one by one."""
    from pyspark.sql.window import Window

    obs, stations = repeated_levels(spark, sf_dir)
    rows = cut(adjustment.adjust(obs, stations).rows, "impact-rows")
    w = Window.partitionBy("net").orderBy(F.round(F.abs("misclosure"), 9).desc(), "obs_id")
    picks = rows.withColumn("n", F.row_number().over(w)).filter("n <= 3").select("net", "obs_id")
    return rounded(adjustment.leave_one_out(obs, stations, picks, rows), 5)


_ANGLES = (0.3, 1.4, 2.6)


@networks.query(f"""
WITH d AS (SELECT s_suppkey AS net, unnest([{', '.join(map(str, _ANGLES))}]) AS a, 0.002 + (s_suppkey % 7) * 0.001 AS s FROM supplier), w AS (SELECT net, a, 1 / (s * CASE WHEN a < 1 THEN 1 ELSE 2 END) ** 2 AS w FROM d),
n AS (SELECT net, sum(w * sin(a) * sin(a)) AS xx, sum(w * cos(a) * cos(a)) AS yy, sum(w * sin(a) * cos(a)) AS xy FROM w GROUP BY net),
q AS (SELECT net, yy / (xx * yy - xy * xy) AS e, xx / (xx * yy - xy * xy) AS n, -xy / (xx * yy - xy * xy) AS en FROM n)
SELECT net, 1 AS station, round(2 * sqrt((e + n) / 2 + sqrt(((n - e) / 2) ** 2 + en ** 2)), 7) AS major, round(2 * sqrt((e + n) / 2 - sqrt(((n - e) / 2) ** 2 + en ** 2)), 7) AS minor,
  round((degrees(atan2(2 * en, n - e) / 2) + 180) % 180, 5) AS azimuth FROM q""")
def error_ellipses(spark, sf_dir):
    """A free station held by three distances, the second and third half as good as the first."""
    s = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("net"), (0.002 + (F.col("s_suppkey") % 7) * 0.001).alias("s"))
    import math

    ends = F.array(*(F.struct(F.lit(i + 2).alias("k"), F.lit(100 * math.sin(a)).alias("x"), F.lit(100 * math.cos(a)).alias("y"), F.lit(1 if a < 1 else 2).alias("w")) for i, a in enumerate(_ANGLES)))
    e = s.select("net", "s", F.explode(ends).alias("e"))
    obs = e.select("net", F.col("e.k").alias("obs_id"), F.lit("dist").alias("type"), F.lit(1).alias("from_id"), F.col("e.k").alias("to_id"), F.lit(None).cast("int").alias("at_id"), F.lit(100.0).alias("value"), F.lit(None).cast("double").alias("value_n"), (F.col("s") * F.col("e.w")).alias("sigma"))
    stations = e.select("net", F.col("e.k").alias("station"), F.col("e.x").alias("x"), F.col("e.y").alias("y"), F.lit(0.0).alias("h"), F.lit(True).alias("fixed"))
    stations = stations.unionByName(s.select("net", F.lit(1).alias("station"), F.lit(0.0).alias("x"), F.lit(0.0).alias("y"), F.lit(0.0).alias("h"), F.lit(False).alias("fixed")))
    q = adjustment.solve_networks(adjustment.normal_equations(adjustment.equations(obs, stations)), covariance=True)
    out = adjustment.ellipses(q, 2.0)
    return out.select("net", F.col("station").cast("int").alias("station"), F.round("major", 7).alias("major"), F.round("minor", 7).alias("minor"), F.round("azimuth", 5).alias("azimuth"))


@networks.query("""
WITH c AS (SELECT s_suppkey AS net, 0.001 + (s_suppkey % 5) * 0.001 AS s1, 0.001 + (s_suppkey % 3) * 0.002 AS s2, 11 + (s_suppkey % 4) * 0.01 AS target FROM supplier)
SELECT net, 2 AS station, round((target / (s1 * s1) + 11.02 / (s2 * s2)) / (1 / (s1 * s1) + 1 / (s2 * s2)), 6) AS h FROM c
UNION ALL SELECT net, 3, round(((target + 1) / (s2 * s2) + 12.03 / (s1 * s1)) / (1 / (s1 * s1) + 1 / (s2 * s2)), 6) FROM c""")
def weighted_control(spark, sf_dir):
    """Two heights of each network, each held to a target by its own sigma and levelled once: the weighted means."""
    k = F.col("s_suppkey")
    s = table(spark, sf_dir, "supplier").select(k.alias("net"), (0.001 + (k % 5) * 0.001).alias("s1"), (0.001 + (k % 3) * 0.002).alias("s2"), (11 + (k % 4) * 0.01).alias("target"))
    line = lambda i, to, v, sigma: s.select("net", F.lit(i).alias("obs_id"), F.lit("lev").alias("type"), F.lit(1).alias("from_id"), F.lit(to).alias("to_id"), F.lit(None).cast("int").alias("at_id"), F.lit(v).alias("value"), F.lit(None).cast("double").alias("value_n"), F.col(sigma).alias("sigma"))
    obs = line(1, 2, 1.02, "s2").unionByName(line(2, 3, 2.03, "s1"))
    none = F.lit(None).cast("double")
    held = lambda i, h, sigma, target: s.select("net", F.lit(i).alias("station"), F.lit(0.0).alias("x"), F.lit(0.0).alias("y"), F.lit(h).alias("h"), F.lit(False).alias("fixed"), none.alias("sx"), none.alias("sy"), F.col(sigma).alias("sh"), target.alias("target_h"))
    free = held(2, 10.9, "s1", F.col("target")).unionByName(held(3, 11.9, "s2", F.col("target") + 1))
    base = s.select("net", F.lit(1).alias("station"), F.lit(0.0).alias("x"), F.lit(0.0).alias("y"), F.lit(10.0).alias("h"), F.lit(True).alias("fixed"), none.alias("sx"), none.alias("sy"), none.alias("sh"), none.alias("target_h"))
    return rounded(adjustment.adjust(obs, free.unionByName(base)).stations.filter("not fixed").select("net", "station", "h"))


@networks.query("""
WITH n AS (SELECT s_suppkey AS net, 0.9996 + (s_suppkey % 9) * 0.0001 AS s, (s_suppkey % 5) * 0.01 AS c, 300.0 + s_suppkey % 200 AS d, 0.1 + (s_suppkey % 4) * 0.02 AS k FROM supplier)
SELECT net, round(d * s * sin(0.7 - c), 4) AS x, round(d * s * cos(0.7 - c), 4) AS y, round(d / tan(1.55 - (1 - k) * d / 12742000.0), 4) AS h FROM n""")
def ground_reductions(spark, sf_dir):
    """A station by a ground distance, a bearing and a zenith: scale, convergence, curvature and refraction are in the equations."""
    k = F.col("s_suppkey")
    s = table(spark, sf_dir, "supplier").select(k.alias("net"), (0.9996 + (k % 9) * 0.0001).alias("scale"), ((k % 5) * 0.01).alias("c"), (300.0 + k % 200).alias("d"), (0.1 + (k % 4) * 0.02).alias("k"))
    none = F.lit(None).cast("double")
    row = lambda i, kind, v, scale, turn, refraction, prism: F.struct(F.lit(i).alias("obs_id"), F.lit(kind).alias("type"), v.alias("value"), scale.alias("scale"), turn.alias("convergence"), refraction.alias("refraction"), F.lit(prism).cast("double").alias("prism"))
    rows = F.array(row(1, "dist", F.col("d") - 0.02, F.col("scale"), none, none, 0.02), row(2, "bearing", F.lit(0.7), none, F.col("c"), none, None), row(3, "zenith", F.lit(1.55), F.col("scale"), none, F.col("k"), None))
    ends = [F.lit(1).alias("from_id"), F.lit(2).alias("to_id"), F.lit(None).cast("int").alias("at_id"), none.alias("value_n"), F.when(F.col("o.type") == "dist", 0.002).otherwise(1e-5).alias("sigma")]
    obs = s.select("net", F.explode(rows).alias("o")).select("net", "o.*", *ends)
    at = lambda i, x, y, f: s.select("net", F.lit(i).alias("station"), F.lit(x).alias("x"), F.lit(y).alias("y"), F.lit(0.0).alias("h"), F.lit(f).alias("fixed"))
    out = adjustment.adjust(obs, at(1, 0.0, 0.0, True).unionByName(at(2, 230.0, 250.0, False)))
    return out.stations.filter("not fixed").select("net", *(F.round(c, 4).alias(c) for c in "xyh"))


_RHO = 0.3


@networks.query(f"""
WITH {_REPEATED}, v AS (SELECT net, obs_id, v, 0.001 * (1 + obs_id % 3) AS s, obs_id <= 4 AS grouped FROM r), k AS (SELECT {_RHO} / (1 - {_RHO} + 4 * {_RHO}) AS k),
g AS (SELECT net, (sum(1 / (s * s)) - any_value(k) * sum(1 / s) ** 2) / (1 - {_RHO}) AS n, (sum(v / (s * s)) - any_value(k) * sum(1 / s) * sum(v / s)) / (1 - {_RHO}) AS u FROM v, k WHERE grouped GROUP BY net),
o AS (SELECT net, sum(1 / (s * s)) AS n, sum(v / (s * s)) AS u FROM v WHERE NOT grouped GROUP BY net)
SELECT g.net, round(10 + (g.u + o.u) / (g.n + o.n), 7) AS h FROM g JOIN o ON g.net = o.net""")
def correlated_levels(spark, sf_dir):
    """A height levelled six times with unequal sigmas; four of the lines are equally correlated."""
    obs, stations = repeated_levels(spark, sf_dir)
    obs = obs.withColumns({"sigma": 0.001 * (1 + F.col("obs_id") % 3), "grp": F.when(F.col("obs_id") <= 4, F.lit("a"))})
    out = adjustment.adjust(obs, stations, correlated=("grp", _RHO))
    return out.stations.filter("not fixed").select("net", F.round("h", 7).alias("h"))


@networks.query("""
WITH c AS (SELECT s_suppkey AS net, 0.002 AS se, 0.003 + (s_suppkey % 4) * 0.001 AS sn, ((s_suppkey % 9) - 4) * 0.2 AS r FROM supplier),
p AS (SELECT net, 1 / (se * se * (1 - r * r)) AS a, 1 / (sn * sn * (1 - r * r)) AS b, -r / (se * sn * (1 - r * r)) AS c FROM c),
q AS (SELECT net, a + 1 / 0.000016 AS aa, b + 1 / 0.000016 AS bb, c AS cc, a * 50.01 + c * 70.02 + 49.99 / 0.000016 AS u, c * 50.01 + b * 70.02 + 70.0 / 0.000016 AS v FROM p)
SELECT net, round((u * bb - v * cc) / (aa * bb - cc * cc), 6) AS x, round((v * aa - u * cc) / (aa * bb - cc * cc), 6) AS y FROM q""")
def correlated_vectors(spark, sf_dir):
    """A station from two satellite vectors, one with correlated components."""
    k = F.col("s_suppkey")
    s = table(spark, sf_dir, "supplier").select(k.alias("net"), (0.003 + (k % 4) * 0.001).alias("sn"), ((k % 9 - 4) * 0.2).alias("r"))
    one = lambda i, e, n, se, sn, r: s.select("net", F.lit(i).alias("obs_id"), F.lit("gps").alias("type"), F.lit(1).alias("from_id"), F.lit(2).alias("to_id"), F.lit(None).cast("int").alias("at_id"), F.lit(e).alias("value"), F.lit(n).alias("value_n"), F.lit(se).alias("sigma"), sn.alias("sigma_n"), r.alias("corr_en"))
    obs = one(1, 50.01, 70.02, 0.002, F.col("sn"), F.col("r")).unionByName(one(2, 49.99, 70.0, 0.004, F.lit(0.004), F.lit(0.0)))
    at = lambda i, x, y, f: s.select("net", F.lit(i).alias("station"), F.lit(x).alias("x"), F.lit(y).alias("y"), F.lit(0.0).alias("h"), F.lit(f).alias("fixed"))
    out = adjustment.adjust(obs, at(1, 0.0, 0.0, True).unionByName(at(2, 49.0, 71.0, False)))
    return rounded(out.stations.filter("station = 2").select("net", "x", "y"))


@networks.query("""
WITH c AS (SELECT s_suppkey AS net, 0.002 + (s_suppkey % 5) * 0.001 AS s FROM supplier) SELECT net, 2 AS from_id, 3 AS to_id, round(s * sqrt(2), 7) AS sigma_e, round(s * sqrt(2), 7) AS sigma_n, round(s * sqrt(2), 7) AS sigma_dist, round(s * sqrt(2) / 50, 9) AS sigma_az FROM c
UNION ALL SELECT net, 1, 2, round(s, 7), round(s, 7), round(s, 7), round(s / 50, 9) FROM c""")
def relative_precision(spark, sf_dir):
    """Two free stations, each from one vector of a fixed one: a pair of free ends, and one with a fixed end."""
    s = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("net"), (0.002 + (F.col("s_suppkey") % 5) * 0.001).alias("s"))
    one = lambda i, to, e, n: s.select("net", F.lit(i).alias("obs_id"), F.lit("gps").alias("type"), F.lit(1).alias("from_id"), F.lit(to).alias("to_id"), F.lit(None).cast("int").alias("at_id"), F.lit(e).alias("value"), F.lit(n).alias("value_n"), F.col("s").alias("sigma"))
    at = lambda i, x, y, f: s.select("net", F.lit(i).alias("station"), F.lit(x).alias("x"), F.lit(y).alias("y"), F.lit(0.0).alias("h"), F.lit(f).alias("fixed"))
    stations = at(1, 0.0, 0.0, True).unionByName(at(2, 30.0, 40.0, False)).unionByName(at(3, 60.0, 80.0, False))
    rows = adjustment.equations(one(1, 2, 30.0, 40.0).unionByName(one(2, 3, 60.0, 80.0)), stations)
    q = adjustment.solve_networks(adjustment.normal_equations(rows), covariance=True)
    pairs = s.select("net", F.explode(F.array(F.struct(F.lit(2).alias("from_id"), F.lit(3).alias("to_id")), F.struct(F.lit(1).alias("from_id"), F.lit(2).alias("to_id")))).alias("p")).select("net", "p.*")
    out = precision.relative_precision(q, pairs, stations)
    return out.select("net", "from_id", "to_id", *(F.round(c, 7).alias(c) for c in ("sigma_e", "sigma_n", "sigma_dist")), F.round("sigma_az", 9).alias("sigma_az"))


@networks.query(f"""
WITH {SHOTS_SQL}, a AS (SELECT net, least(from_id % 12, to_id % 12) || '|' || greatest(from_id % 12, to_id % 12) AS pair, string_agg(DISTINCT type, ',' ORDER BY type) AS types FROM shots WHERE obs_id % 3 = 0 GROUP BY ALL),
b AS (SELECT DISTINCT net, least(from_id % 12, to_id % 12) || '|' || greatest(from_id % 12, to_id % 12) AS pair FROM shots WHERE obs_id % 7 = 0 AND from_id % 12 <> to_id % 12)
SELECT coalesce(a.net, b.net) AS net, coalesce(a.pair, b.pair) AS pair, a.pair IS NOT NULL AS connected, b.pair IS NOT NULL AS requested, coalesce(types, '') AS types FROM a FULL JOIN b ON a.net = b.net AND a.pair = b.pair""")
def connected_pairs(spark, sf_dir):
    obs = shots(spark, sf_dir).withColumns({"from_id": F.col("from_id") % 12, "to_id": F.col("to_id") % 12})
    return precision.connected_and_requested(obs.filter("obs_id % 3 = 0"), obs.filter("obs_id % 7 = 0"))


@networks.query(f"""WITH {SHOTS_SQL}, p AS (SELECT from_id AS a, to_id AS b FROM shots WHERE type = 'dist'), e AS (SELECT a, b FROM p UNION ALL SELECT b, a FROM p) SELECT a, count(*) AS n, count(DISTINCT b) AS others FROM e GROUP BY a""")
def pair_lookup(spark, sf_dir):
    """Pairs found from either end."""
    p = shots(spark, sf_dir).filter("type = 'dist'").select(F.col("from_id").alias("a"), F.col("to_id").alias("b"))
    return precision.both_directions(p, "a", "b").groupBy("a").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("b").alias("others"))


_PLACES = """places AS (SELECT c_custkey % 20 AS net, c_custkey AS station, c_custkey % 61 = 0 AND c_custkey % 20 > 2 AS fixed, CASE WHEN c_custkey % 97 = 0 THEN 0.01 END AS s FROM customer)"""


def _places(spark, sf_dir):
    k = F.col("c_custkey")
    return table(spark, sf_dir, "customer").select((k % 20).alias("net"), k.alias("station"), F.coalesce((k % 61 == 0) & (k % 20 > 2), F.lit(False)).alias("fixed"), *(F.when(k % 97 == 0, 0.01).alias(c) for c in ("sx", "sy", "sh")))


@networks.query(f"""
WITH {SHOTS_SQL}, {_PLACES}, c AS (SELECT net, count(*) FILTER (fixed OR s IS NOT NULL) AS n FROM places GROUP BY net), k AS (SELECT net, bool_or(type IN ('dist', 'gps')) AS d, bool_or(type IN ('angle', 'direction')) AS a FROM shots WHERE net % 4 <> 1 GROUP BY net)
SELECT c.net, n AS xy_control, n AS h_control, coalesce(d, false) AS has_distance, coalesce(a, false) AS has_angle, CASE WHEN n = 0 THEN 'fail' WHEN n < 2 THEN 'warn' ELSE 'ok' END AS status,
  CASE WHEN NOT (coalesce(d, false) OR n >= 2 OR (n >= 1 AND NOT coalesce(a, false))) THEN 'fail' WHEN n < 2 THEN 'warn' ELSE 'ok' END AS plane_status FROM c LEFT JOIN k ON c.net = k.net""")
def datum_sufficiency(spark, sf_dir):
    """Whether each network is fixed in space, and in plane."""
    obs, places = shots(spark, sf_dir).filter("net % 4 <> 1"), _places(spark, sf_dir)
    plane = precision.datum_sufficiency(obs, places, True).select(F.col("net").alias("n"), F.col("status").alias("plane_status"))
    return precision.datum_sufficiency(obs, places, False).join(plane, F.col("net") == F.col("n")).drop("n")


@networks.query(f"""
WITH {SHOTS_SQL}, e AS (SELECT net, type, mode, unnest(CASE WHEN type = 'angle' THEN [at_id, from_id, to_id] ELSE [from_id, to_id] END) AS station FROM shots)
SELECT net, station, bool_or(type NOT IN ('lev', 'zenith')) AS horizontal, bool_or(type IN ('lev', 'zenith') OR (type = 'dist' AND mode IS NOT DISTINCT FROM 'slope')) AS vertical FROM e GROUP BY ALL""")
def touched_stations(spark, sf_dir):
    return precision.touched_stations(shots(spark, sf_dir))


@networks.query(f"""
WITH {SHOTS_SQL}, {_PLACES}, e AS (SELECT net, type, mode, unnest(CASE WHEN type = 'angle' THEN [at_id, from_id, to_id] ELSE [from_id, to_id] END) AS station FROM shots),
t AS (SELECT net, station, bool_or(type NOT IN ('lev', 'zenith')) AS hor, bool_or(type IN ('lev', 'zenith') OR (type = 'dist' AND mode IS NOT DISTINCT FROM 'slope')) AS ver FROM e GROUP BY ALL)
SELECT p.net, p.station, NOT coalesce(hor, false) AS hold_xy, NOT coalesce(ver, false) AS hold_h FROM places p LEFT JOIN t ON p.net = t.net AND p.station = t.station WHERE NOT fixed AND (NOT coalesce(hor, false) OR NOT coalesce(ver, false))""")
def automatic_holds(spark, sf_dir):
    return precision.automatic_holds(_places(spark, sf_dir), shots(spark, sf_dir), False)


@networks.query(f"""WITH {_PLACES} SELECT net, 3 * count(*) AS n, count(*) AS x, count(*) AS y, count(*) AS h, count(*) FILTER (station % 2 = 0) AS correlated FROM places WHERE s IS NOT NULL AND NOT fixed GROUP BY net""")
def control_summary(spark, sf_dir):
    from pyspark.sql import types as T

    at = _places(spark, sf_dir).withColumns({"x": F.lit(1.0), "y": F.lit(2.0), "h": F.lit(3.0), "corr_xy": F.when(F.col("station") % 2 == 0, 0.4)})
    return precision.control_summary(adjustment.control_equations(at, T.LongType()))


@networks.query(f"""
WITH {SHOTS_SQL}, g AS (SELECT net, set_id, sigma FROM shots WHERE type = 'direction'), s AS (SELECT net || set_id AS grp, count(*) AS n, sum(1 / sigma) AS s1, sum(1 / (sigma * sigma)) AS s2 FROM g GROUP BY 1),
b AS (SELECT *, CASE WHEN n > 1 THEN 0.25 / (0.75 * (0.75 + n * 0.25)) ELSE 0 END AS b FROM s)
SELECT grp, n, n * (n - 1) // 2 AS pairs, round(CASE WHEN n > 1 THEN 1 / 0.75 - b ELSE 1 END, 8) AS diagonal, round(CASE WHEN n > 1 THEN b * (s1 * s1 - s2) / 2 / (n * (n - 1) / 2) END, 4) AS mean_off_diagonal FROM b""")
def correlated_sets(spark, sf_dir):
    rows = shots(spark, sf_dir).filter("type = 'direction'").withColumn("grp", F.concat("net", "set_id"))
    out = precision.correlated_sets(rows, "grp", "sigma", 0.25)
    return out.select("grp", "n", "pairs", F.round("diagonal", 8).alias("diagonal"), F.round("mean_off_diagonal", 4).alias("mean_off_diagonal"))


@networks.query("""
WITH c AS (SELECT s_suppkey, 1.0 + s_suppkey % 3 AS a, 2.0 + s_suppkey % 4 AS b, (s_suppkey % 5) * 0.3 - CASE WHEN s_suppkey % 11 = 0 THEN 100 ELSE 0 END AS c FROM supplier)
SELECT s_suppkey, round(CASE WHEN a * b - c * c > 1e-24 THEN b / (a * b - c * c) ELSE 1 / a END, 6) AS w_ee, round(CASE WHEN a * b - c * c > 1e-24 THEN a / (a * b - c * c) ELSE 1 / b END, 6) AS w_nn, round(CASE WHEN a * b - c * c > 1e-24 THEN -c / (a * b - c * c) ELSE 0 END, 6) AS w_en FROM c""")
def gps_weights(spark, sf_dir):
    k = F.col("s_suppkey")
    s = table(spark, sf_dir, "supplier").select("s_suppkey", (1.0 + k % 3).alias("a"), (2.0 + k % 4).alias("b"), ((k % 5) * 0.3 - F.when(k % 11 == 0, 100).otherwise(0)).alias("c"))
    return rounded(s.select("s_suppkey", *(v.alias(n) for n, v in precision.gps_weights("a", "b", "c").items())))


@networks.query("""
WITH e AS (SELECT user_id, radians(value) AS r, radians(event_id % 40) AS z FROM events), m AS (SELECT user_id, atan2(sum(sin(r - z)), sum(cos(r - z))) AS o FROM e GROUP BY user_id),
d AS (SELECT user_id, o, (r - z - o) - ceil((r - z - o - pi()) / (2 * pi())) * 2 * pi() AS off FROM e JOIN m USING (user_id))
SELECT user_id, count(*) AS n, round(min(o), 6) AS orientation, round(avg(off), 6) AS mean, round(sqrt(avg(off * off)), 6) AS rms, round(max(abs(off)), 6) AS max_abs FROM d GROUP BY user_id""")
def direction_prefit(spark, sf_dir):
    e = table(spark, sf_dir, "events").select("user_id", F.radians("value").alias("r"), F.radians(F.col("event_id") % 40).alias("z"))
    return rounded(precision.prefit_directions(e, ["user_id"], "r", "z"))


@networks.query(f"""
WITH {SHOTS_SQL}, g AS (SELECT *, 20.0 + obs_id % 80 AS d, 15.0 + line % 60 AS b, (obs_id % 9 - 4) * 0.5 AS u, (obs_id % 31) * 0.1 AS a, CASE obs_id % 3 WHEN 0 THEN 'default' WHEN 1 THEN 'explicit' ELSE 'fixed' END AS src FROM shots),
t AS (SELECT *, CASE type WHEN 'dist' THEN CASE WHEN mode = 'slope' THEN (d * d * 0.000005 + 2 * u * u * 0.000009) / (d * d + u * u) ELSE 0.000005 END WHEN 'direction' THEN 0.000005 / (d * d)
  WHEN 'angle' THEN greatest(0.000005 / (d * d) + 0.000005 / (b * b) - 2 * 0.000005 * cos(a) / (d * b), 0) ELSE 0 END AS added FROM g)
SELECT obs_id, round(sqrt(sigma * sigma + CASE WHEN src = 'default' THEN added ELSE 0 END), 8) AS sigma FROM t""")
def centred_sigmas(spark, sf_dir):
    k = F.col("obs_id")
    obs = shots(spark, sf_dir)
    d, b, u, a = (20.0 + k % 80).cast("double"), (15.0 + F.col("line") % 60).cast("double"), (k % 9 - 4) * 0.5, (k % 31) * 0.1
    source = F.when(k % 3 == 0, "default").when(k % 3 == 1, "explicit").otherwise("fixed")
    sigma = precision.centred_sigma("type", "sigma", source, F.lit(0.001), F.lit(0.002), F.lit(0.003), d, b, a, d, u, F.col("mode").eqNullSafe("slope"))
    return obs.select("obs_id", F.round(sigma, 8).alias("sigma"))


def _level_edges(spark, sf_dir):
    """A ring of three edges and a fourth station on a spur for each supplier, with heights that don't quite close."""
    k = F.col("s_suppkey")
    edge = lambda e, a, b, dh, km: F.struct(F.lit(e).alias("edge_id"), F.lit(a).alias("a"), F.lit(b).alias("b"), dh.alias("dh"), km.alias("length_km"))
    edges = F.array(edge("e1", "P1", "P2", 1.0 + (k % 7) * 0.001, 1.0 + k % 3), edge("e2", "P2", "P10", 2.0 + (k % 5) * 0.001, 2.0 + k % 2), edge("e3", "P1", "P10", 3.0 + (k % 4) * 0.001, F.lit(1.5) + k % 4), edge("e4", "P10", "P11", F.lit(0.5), F.lit(9.0)))
    return table(spark, sf_dir, "supplier").select(k.alias("net"), F.explode(edges).alias("e")).select("net", "e.*")


@networks.query("""
WITH e AS (SELECT s_suppkey AS net, 1.0 + (s_suppkey % 7) * 0.001 AS h1, 2.0 + (s_suppkey % 5) * 0.001 AS h2, 3.0 + (s_suppkey % 4) * 0.001 AS h3, 1.0 + s_suppkey % 3 + 2.0 + s_suppkey % 2 + 1.5 + s_suppkey % 4 AS km FROM supplier)
SELECT net, 'P2|P10|e2' AS loop, 3 AS n_edges, round(CAST(h1 + h2 - h3 AS DOUBLE), 6) AS closure, round(CAST(km AS DOUBLE), 6) AS length_km, round(0.001 + 0.002 * sqrt(km), 6) AS tolerance, abs(h1 + h2 - h3) <= 0.001 + 0.002 * sqrt(km) AS pass FROM e""")
def loop_closures(spark, sf_dir):
    """The edge off the tree that grows from P1 closes one loop in each network."""
    return rounded(graph.loop_closures(_level_edges(spark, sf_dir), 0.001, 0.002))


@networks.query("""
WITH e AS (SELECT s_suppkey AS net, 1.0 + s_suppkey % 3 AS a, 2.0 + s_suppkey % 2 AS b, 1.5 + s_suppkey % 4 AS c FROM supplier),
w AS (SELECT net, {'w': 0.0, 't': 0.0, 'h': 0} AS p1, least({'w': a, 't': a, 'h': 1}, {'w': greatest(c, b), 't': c + b, 'h': 2}) AS p2, least({'w': c, 't': c, 'h': 1}, {'w': greatest(a, b), 't': a + b, 'h': 2}) AS p10 FROM e),
n AS (SELECT net, 'P1' AS node, p1 AS p FROM w UNION ALL SELECT net, 'P2', p2 FROM w UNION ALL SELECT net, 'P10', p10 FROM w UNION ALL SELECT net, 'P11', {'w': greatest(p10.w, 9.0), 't': p10.t + 9.0, 'h': p10.h + 1} FROM w)
SELECT net, node, CAST(p.w AS DOUBLE) AS worst, CAST(p.t AS DOUBLE) AS total, CAST(p.h AS INTEGER) AS hops FROM n""")
def minimax_paths(spark, sf_dir):
    edges = _level_edges(spark, sf_dir).select("net", "a", "b", F.col("length_km").alias("weight"))
    anchors = edges.select("net", F.lit("P1").alias("node")).distinct()
    return rounded(graph.minimax_paths(edges, anchors))
