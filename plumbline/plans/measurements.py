"""Statistics of observations. Rows of ``lineitem`` stand for observations: the return flag is the type, order and line
the observation, supplier and part its ends, discount less 0.05 the residual, and sigma follows an additive distance law."""

from __future__ import annotations


from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.functions.numbers import edm_sigma
from plumbline.operators import adjustment, statistics
from plumbline.plans.registry import Registry
from plumbline.tables import table

measurements = Registry()

DOF = 1000

OBS_SQL = """obs AS (
  SELECT l_returnflag AS type, l_orderkey * 10 + l_linenumber AS obs_id, l_suppkey AS from_id, l_partkey AS to_id,
         l_discount - 0.05 AS residual, 0.01 + abs(l_quantity) * 0.001 AS sigma, l_tax * 10 AS redundancy,
         (l_discount - 0.05) / (0.01 + abs(l_quantity) * 0.001) AS std_res,
         l_quantity AS distance, l_extendedprice / 1000 AS value, l_linestatus AS set_id
  FROM lineitem)"""


def observations(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = table(spark, sf_dir, "lineitem")
    residual, sigma = F.col("l_discount") - 0.05, edm_sigma("l_quantity", 0.01, 1000.0)
    return li.select(
        F.col("l_returnflag").alias("type"),
        (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("obs_id"),
        F.col("l_suppkey").alias("from_id"),
        F.col("l_partkey").alias("to_id"),
        residual.alias("residual"),
        sigma.alias("sigma"),
        (F.col("l_tax") * 10).alias("redundancy"),
        (residual / sigma).alias("std_res"),
        F.col("l_quantity").alias("distance"),
        (F.col("l_extendedprice") / 1000).alias("value"),
        F.col("l_linestatus").alias("set_id"),
    )


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    """Doubles to a number of digits: sums over many tasks come in any order."""
    return df.select(*(F.round(c, digits).alias(c) if kind == "double" else F.col(c) for c, kind in df.dtypes))


@measurements.query(f"""
WITH {OBS_SQL}
SELECT type, count(*) AS n, round(sqrt(avg(residual * residual)), 6) AS rms, round(max(abs(residual)), 6) AS max_abs,
       round(max(abs(std_res)), 6) AS max_std_res, count(*) FILTER (abs(std_res) > 3) AS over3, count(*) FILTER (abs(std_res) > 4) AS over4
FROM obs GROUP BY type""")
def obs_type_summary(spark, sf_dir):
    return rounded(statistics.type_summary(observations(spark, sf_dir)))


@measurements.query(f"""
WITH {OBS_SQL}, g AS (SELECT type, count(*) AS n, sum(std_res * std_res) AS ss FROM obs GROUP BY type),
r AS (SELECT type, n, ss FROM g UNION ALL SELECT 'Total', sum(n), sum(ss) FROM g)
SELECT type, CAST(n AS BIGINT) AS n, round(ss, 4) AS ss, round(sqrt(ss / n) * sqrt((SELECT sum(n) FROM g) / {DOF}.0), 4) AS error_factor FROM r""")
def stat_summary_error_factor(spark, sf_dir):
    return rounded(statistics.error_factors(observations(spark, sf_dir), DOF), 4)


@measurements.query(f"""
WITH {OBS_SQL}
SELECT type, count(*) AS n, count(*) FILTER (abs(std_res) > 2) AS over2, count(*) FILTER (abs(std_res) > 3) AS over3,
       count(*) FILTER (abs(std_res) > 4) AS over4, count(*) FILTER (abs(std_res) > 3.29) AS local_fail,
       round(avg(redundancy), 6) AS mean_redundancy, round(min(redundancy), 6) AS min_redundancy,
       count(*) FILTER (redundancy < 0.2) AS below_02, count(*) FILTER (redundancy < 0.1) AS below_01,
       round(max(abs(std_res)), 6) AS max_std_res,
       first(obs_id ORDER BY abs(std_res) DESC, obs_id) AS worst
FROM obs GROUP BY type""")
def residual_diagnostics(spark, sf_dir):
    return rounded(statistics.residual_diagnostics(observations(spark, sf_dir)))


@measurements.query(f"""
WITH {OBS_SQL}, w AS (SELECT greatest(0.001, least(1.0, CASE WHEN abs(std_res) <= 1.5 THEN 1.0 ELSE 1.5 / abs(std_res) END)) AS w FROM obs)
SELECT count(*) AS n, count(*) FILTER (w < 1) AS downweighted, round(avg(w), 6) AS mean_weight, round(min(w), 6) AS min_weight FROM w""")
def huber_weights(spark, sf_dir):
    return rounded(statistics.robust_summary(observations(spark, sf_dir)))


@measurements.query(f"""
WITH {OBS_SQL}, u AS (SELECT DISTINCT obs_id, type, round(std_res, 6) AS std_res FROM obs)
SELECT obs_id, type, std_res FROM u ORDER BY abs(std_res) DESC, obs_id, type, std_res LIMIT 15""")
def robust_top15(spark, sf_dir):
    rows = rounded(observations(spark, sf_dir).select("obs_id", "type", "std_res")).distinct()
    return rows.orderBy(F.abs("std_res").desc(), "obs_id", "type", "std_res").limit(15)


_FIT = """fit AS (SELECT type AS net, 1.0 AS a0, distance AS a1, value AS y, 1 / ((1 + distance * 0.1) * (1 + distance * 0.1)) AS w FROM obs)"""


def _line_rows(spark, sf_dir) -> DataFrame:
    """Equation rows of value = a + b * distance for each type."""
    terms = F.array(F.struct(F.lit("a").alias("p"), F.lit(1.0).alias("a")), F.struct(F.lit("b").alias("p"), F.col("distance").alias("a")))
    return observations(spark, sf_dir).select(F.col("type").alias("net"), "obs_id", terms.alias("terms"), F.col("value").alias("misclosure"), (1 + F.col("distance") * 0.1).alias("sigma"))


@measurements.query(f"""
WITH {OBS_SQL}, {_FIT}, s AS (SELECT net, sum(w) AS s0, sum(w * a1) AS s1, sum(w * a1 * a1) AS s2, sum(w * y) AS t0, sum(w * a1 * y) AS t1 FROM fit GROUP BY net)
SELECT net, 'a' AS i, 'a' AS j, round(s0, 4) AS value FROM s UNION ALL SELECT net, 'a', 'b', round(s1, 4) FROM s
UNION ALL SELECT net, 'b', 'a', round(s1, 4) FROM s UNION ALL SELECT net, 'b', 'b', round(s2, 4) FROM s
UNION ALL SELECT net, 'a', NULL, round(t0, 4) FROM s UNION ALL SELECT net, 'b', NULL, round(t1, 4) FROM s""")
def wls_normal_equations(spark, sf_dir):
    return rounded(adjustment.normal_equations(_line_rows(spark, sf_dir)), 4)


@measurements.query(f"""
WITH {OBS_SQL}, {_FIT}, s AS (SELECT net, sum(w) AS s0, sum(w * a1) AS s1, sum(w * a1 * a1) AS s2, sum(w * y) AS t0, sum(w * a1 * y) AS t1 FROM fit GROUP BY net)
SELECT net, 'a' AS p, round((s2 * t0 - s1 * t1) / (s0 * s2 - s1 * s1), 6) AS dx FROM s
UNION ALL SELECT net, 'b', round((s0 * t1 - s1 * t0) / (s0 * s2 - s1 * s1), 6) FROM s""")
def wls_line_fit(spark, sf_dir):
    return rounded(adjustment.solve_networks(adjustment.normal_equations(_line_rows(spark, sf_dir))).select("net", "p", "dx"))


@measurements.query(f"""
WITH {OBS_SQL}, {_FIT}, s AS (SELECT net, sum(w) AS s0, sum(w * a1) AS s1, sum(w * a1 * a1) AS s2 FROM fit GROUP BY net),
q AS (SELECT net, s2 / (s0 * s2 - s1 * s1) AS q00, -s1 / (s0 * s2 - s1 * s1) AS q01, s0 / (s0 * s2 - s1 * s1) AS q11 FROM s)
SELECT net, count(*) AS n, round(sum(1 - w * (q00 + 2 * q01 * a1 + q11 * a1 * a1)), 6) AS redundancy_sum,
       round(max(sqrt(greatest(q00 + 2 * q01 * a1 + q11 * a1 * a1, 0))), 6) AS max_fit_sigma
FROM fit JOIN q USING (net) GROUP BY net""")
def wls_redundancy(spark, sf_dir):
    """Redundancy numbers of the line fit: they add up to observations less parameters."""
    rows = _line_rows(spark, sf_dir)
    q = adjustment.solve_networks(adjustment.normal_equations(rows), covariance=True)
    pick = lambda i, j: F.max(F.when((F.col("i") == i) & (F.col("j") == j), F.col("q")))
    wide = q.groupBy("net").agg(pick("a", "a").alias("q00"), pick("a", "b").alias("q01"), pick("b", "b").alias("q11"))
    x = F.col("terms")[1]["a"]
    fit = F.col("q00") + 2 * F.col("q01") * x + F.col("q11") * x * x
    out = rows.join(wide, "net").groupBy("net")
    return rounded(out.agg(F.count(F.lit(1)).alias("n"), F.sum(1 - fit / (F.col("sigma") * F.col("sigma"))).alias("redundancy_sum"), F.max(F.sqrt(F.greatest(fit, F.lit(0.0)))).alias("max_fit_sigma")))


@measurements.query("""
WITH m AS (SELECT median(s_acctbal) AS median FROM supplier WHERE s_acctbal > 0)
SELECT s_suppkey, round(s_acctbal / median, 6) AS ratio,
       CASE WHEN s_acctbal / median >= 2.5 THEN 'weak' WHEN s_acctbal / median >= 1.6 THEN 'watch' ELSE 'ok' END AS class
FROM supplier, m""")
def weak_geometry(spark, sf_dir):
    return rounded(statistics.median_ratio_classes(table(spark, sf_dir, "supplier"), "s_acctbal").select("s_suppkey", "ratio", "class"))


@measurements.query("""
WITH e AS (SELECT event_type, user_id, radians(value) AS a FROM events),
m AS (SELECT event_type, user_id, atan2(sum(sin(a)), sum(cos(a))) AS raw, count(*) AS w FROM e GROUP BY ALL),
k AS (SELECT event_type, user_id, raw - floor(raw / (2 * pi())) * 2 * pi() AS mean, w FROM m),
d AS (SELECT event_type, user_id, mean, w, (a - mean) - ceil(((a - mean) - pi()) / (2 * pi())) * 2 * pi() AS off FROM e JOIN k USING (event_type, user_id))
SELECT event_type, user_id, round(min(mean), 6) AS mean, count(*) AS n, round(sqrt(avg(off * off)), 6) AS rms, round(max(abs(off)), 6) AS max_off,
       round(sqrt(1.0 / min(w)), 6) AS pooled_sigma FROM d GROUP BY event_type, user_id""")
def circular_mean_by_set(spark, sf_dir):
    e = table(spark, sf_dir, "events").select("event_type", "user_id", F.radians("value").alias("a"))
    return rounded(statistics.circular_sets(e, ["event_type", "user_id"], "a"))


@measurements.query(f"""
WITH {OBS_SQL}, ends AS (SELECT 'F' || from_id AS s, 'T' || to_id AS o FROM obs UNION ALL SELECT 'T' || to_id, 'F' || from_id FROM obs)
SELECT s AS station, count(*) AS n_obs, count(DISTINCT o) AS neighbours FROM ends GROUP BY s""")
def station_degrees(spark, sf_dir):
    obs = observations(spark, sf_dir).select(F.concat(F.lit("F"), F.col("from_id")).alias("from_id"), F.concat(F.lit("T"), F.col("to_id")).alias("to_id"))
    return statistics.station_degrees(obs)


@measurements.query(f"""
WITH {OBS_SQL}, o AS (SELECT *, CASE type WHEN 'A' THEN 'dist' WHEN 'N' THEN 'angle' ELSE 'gps' END AS kind FROM obs)
SELECT from_id, count(*) FILTER (kind = 'dist') AS n_dist, count(*) FILTER (kind = 'angle') AS n_angle, count(*) FILTER (kind = 'gps') AS n_gps,
       count(DISTINCT set_id) AS sets, round(sum(CASE WHEN kind = 'dist' THEN distance ELSE 0 END), 6) AS total_distance,
       round(sqrt(avg(std_res * std_res)), 6) AS rms_std_res, round(max(abs(std_res)), 6) AS max_std_res,
       first(obs_id ORDER BY abs(std_res) DESC, obs_id) AS worst
FROM o GROUP BY from_id""")
def setup_diagnostics(spark, sf_dir):
    kind = F.when(F.col("type") == "A", "dist").when(F.col("type") == "N", "angle").otherwise("gps")
    return rounded(statistics.setup_diagnostics(observations(spark, sf_dir).withColumn("type", kind)))


@measurements.query(f"""
WITH {OBS_SQL} SELECT from_id, count(*) FILTER (type = 'A') AS "A", count(*) FILTER (type = 'N') AS "N", count(*) FILTER (type = 'R') AS "R"
FROM obs GROUP BY from_id""")
def reduction_usage(spark, sf_dir):
    return statistics.usage_table(observations(spark, sf_dir), "from_id", "type", ["A", "N", "R"])


@measurements.query("""SELECT s_suppkey, round(degrees(atan2(s_acctbal, s_nationkey * 100.0 + 1)) - floor(degrees(atan2(s_acctbal, s_nationkey * 100.0 + 1)) / 360) * 360, 6) AS azimuth,
round(sqrt(s_acctbal * s_acctbal + (s_nationkey * 100.0 + 1) * (s_nationkey * 100.0 + 1)), 6) AS distance FROM supplier""")
def inverse_azimuth_distance(spark, sf_dir):
    from plumbline.functions.angles import azimuth, distance

    s = table(spark, sf_dir, "supplier").select("s_suppkey", F.col("s_acctbal").alias("de"), (F.col("s_nationkey") * 100.0 + 1).alias("dn"))
    return rounded(s.select("s_suppkey", F.degrees(azimuth("de", "dn")).alias("azimuth"), distance("de", "dn").alias("distance")))


@measurements.query("SELECT c_custkey, round(45 + c_acctbal / 10000, 6) AS lat, round(CAST(-66.5 AS DOUBLE) + c_nationkey * 0.01, 6) AS lon FROM customer")
def projection_round_trip(spark, sf_dir):
    """Degrees to a transverse Mercator grid and back."""
    from plumbline.functions.geodesy import inverse_transverse_mercator, transverse_mercator

    c = table(spark, sf_dir, "customer").select("c_custkey", (45 + F.col("c_acctbal") / 10000).alias("lat"), (F.lit(-66.5) + F.col("c_nationkey") * 0.01).alias("lon"))
    e, n = transverse_mercator("lat", "lon", -66.5)
    c = c.select("c_custkey", e.alias("e"), n.alias("n"))
    lat, lon = inverse_transverse_mercator("e", "n", -66.5)
    return rounded(c.select("c_custkey", lat.alias("lat"), lon.alias("lon")))


