"""Units, prompts and settings over the driver's tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from plumbline.functions import geodesy
from plumbline.operators import review, study
from plumbline.plans.measurements import rounded
from plumbline.plans.registry import Registry
from plumbline.plans.reviews import SHOTS_SQL, shots
from plumbline.tables import table

studies = Registry()


@studies.query("""
WITH r AS (SELECT o_custkey, o_orderkey, o_orderpriority, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS n FROM orders)
SELECT c_custkey AS unit, coalesce(string_agg(o_orderpriority, ';' ORDER BY o_orderkey), '') AS parts FROM customer LEFT JOIN (SELECT * FROM r WHERE n <= 5) r ON c_custkey = o_custkey GROUP BY c_custkey""")
def nested_parts(spark, sf_dir):
    """Each unit with its first five parts."""
    units = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("unit"))
    parts = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("unit"), "o_orderkey", "o_orderpriority")
    return study.collected(units, parts, "unit", ["o_orderkey"], "o_orderpriority", "parts", 5).select("unit", F.array_join("parts", ";").alias("parts"))


_PROMPTS = """u AS (SELECT c_custkey AS unit_id FROM customer), g AS (SELECT c_custkey AS unit_id, CASE c_custkey % 4 WHEN 0 THEN 'guided-recall' WHEN 1 THEN 'application' WHEN 2 THEN 'maintenance' END AS phase FROM customer WHERE c_custkey % 5 <> 0),
p AS (SELECT o_custkey AS unit_id, o_orderkey AS prompt_id, CASE o_orderkey % 3 WHEN 0 THEN 'guided-recall' WHEN 1 THEN 'scenario' ELSE 'free-recall' END AS kind, o_orderdate AS created FROM orders)"""


@studies.query(f"""
WITH {_PROMPTS}, r AS (SELECT u.unit_id, coalesce(phase, 'unread') AS phase, prompt_id, kind, created FROM u LEFT JOIN g ON u.unit_id = g.unit_id JOIN p ON p.unit_id = u.unit_id)
SELECT unit_id, phase, prompt_id FROM r QUALIFY row_number() OVER (PARTITION BY unit_id ORDER BY CASE WHEN kind = phase THEN 0 WHEN phase = 'application' AND kind = 'scenario' THEN 1 WHEN phase = 'maintenance' THEN 2 ELSE 3 END, created, prompt_id) = 1""")
def best_prompts(spark, sf_dir):
    units = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("unit_id"))
    k = F.col("unit_id")
    progress = units.filter(k % 5 != 0).withColumn("phase", F.when(k % 4 == 0, "guided-recall").when(k % 4 == 1, "application").when(k % 4 == 2, "maintenance"))
    o = F.col("o_orderkey")
    prompts = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("unit_id"), o.alias("prompt_id"), F.when(o % 3 == 0, "guided-recall").when(o % 3 == 1, "scenario").otherwise("free-recall").alias("kind"), F.col("o_orderdate").alias("created"))
    return study.best_prompts(units, progress, prompts)


@studies.query("""
WITH t AS (SELECT p_partkey, lower(p_name) AS t FROM part), s AS (SELECT p_partkey, greatest((CASE WHEN list_contains(string_split(t, ' '), 'rd') THEN 1 ELSE 0 END + CASE WHEN list_contains(string_split(t, ' '), 'bolt') THEN 1 ELSE 0 END) / 2.0,
  CASE WHEN regexp_matches(t, 'r.*d.*b.*o.*l.*t') THEN 6.0 / length(t) ELSE 0 END) AS score FROM t)
SELECT p_partkey, round(CAST(score AS DOUBLE), 6) AS score FROM s WHERE score > 0 ORDER BY round(CAST(score AS DOUBLE), 9) DESC, p_partkey LIMIT 40""")
def library_search(spark, sf_dir):
    return rounded(study.library_scores(table(spark, sf_dir, "part"), "p_partkey", "p_name", "rd bolt", 40))


@studies.query("""
WITH l AS (SELECT user_id, event_type, value FROM events QUALIFY row_number() OVER (PARTITION BY user_id, event_type ORDER BY event_id DESC) = 1)
SELECT user_id, event_type, value FROM l""")
def key_values(spark, sf_dir):
    """Each user's last value of every kind, from a map."""
    maps = study.key_values(table(spark, sf_dir, "events"), "user_id", "event_type", "value", "event_id")
    return maps.select("user_id", F.explode("values").alias("event_type", "value"))


@studies.query("""
WITH l AS (SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) AS n FROM events)
SELECT user_id, '0,' || string_agg(CAST(event_id AS VARCHAR), ',' ORDER BY n) AS history FROM l WHERE n <= 4 GROUP BY user_id""")
def bounded_history(spark, sf_dir):
    """The last four entries of each user, and one more pushed on."""
    rows = study.last_entries(table(spark, sf_dir, "events"), "user_id", "event_id", "event_id", 7)
    more = study.pushed(F.col("history"), F.lit(0).cast("long"), 5)
    return rows.select("user_id", F.array_join(F.transform(more, lambda x: x.cast("string")), ",").alias("history"))


@studies.query(f"""
WITH {SHOTS_SQL}, i AS (SELECT s_suppkey AS inst, 0.002 + (s_suppkey % 3) * 0.001 AS c, 2.0 + s_suppkey % 4 AS ppm, CASE WHEN s_suppkey % 5 <> 0 THEN 1e-5 END AS hz FROM supplier),
j AS (SELECT obs_id, CASE WHEN obs_id % 3 = 0 THEN sigma END AS own, CASE type WHEN 'dist' THEN c + abs(value) * ppm * 1e-6 WHEN 'angle' THEN hz WHEN 'direction' THEN hz END AS d FROM shots LEFT JOIN i ON inst = from_id % 130)
SELECT obs_id, round(coalesce(own, d), 9) AS sigma, CASE WHEN own IS NOT NULL THEN 'explicit' WHEN d IS NOT NULL THEN 'default' END AS source FROM j""")
def default_sigmas(spark, sf_dir):
    k = F.col("s_suppkey")
    instruments = table(spark, sf_dir, "supplier").select(k.alias("inst"), (0.002 + (k % 3) * 0.001).alias("edm_const"), (2.0 + k % 4).alias("edm_ppm"), F.when(k % 5 != 0, 1e-5).alias("hz_sigma"))
    obs = shots(spark, sf_dir).withColumns({"inst": F.col("from_id") % 130, "sigma": F.when(F.col("obs_id") % 3 == 0, F.col("sigma"))})
    return review.default_sigmas(obs, instruments).select("obs_id", F.round("sigma", 9).alias("sigma"), "source")


@studies.query("""
WITH c AS (SELECT DISTINCT c_nationkey AS cluster FROM customer), d AS (SELECT s_nationkey AS cluster, first(CASE s_suppkey % 3 WHEN 0 THEN 'approve' WHEN 1 THEN 'reject' ELSE 'later' END ORDER BY s_suppkey DESC) AS decision FROM supplier WHERE s_nationkey < 20 GROUP BY 1)
SELECT count(*) AS candidates, count(*) FILTER (decision = 'approve') AS approved, count(*) FILTER (decision = 'reject') AS rejected, count(*) FILTER (decision IS NULL) AS pending FROM c LEFT JOIN d ON c.cluster = d.cluster""")
def decision_counts(spark, sf_dir):
    k = F.col("s_suppkey")
    d = table(spark, sf_dir, "supplier").filter("s_nationkey < 20").select(F.col("s_nationkey").alias("cluster"), F.when(k % 3 == 0, "approve").when(k % 3 == 1, "reject").otherwise("later").alias("decision"), k.alias("at"))
    return review.decision_counts(table(spark, sf_dir, "customer").select(F.col("c_nationkey").alias("cluster")), d)


@studies.query("""
WITH t AS (SELECT s_suppkey, s_suppkey % 3 AS a, 3 + s_suppkey % 6 AS b FROM supplier)
SELECT s_suppkey, CASE WHEN a = 0 AND b = 4 THEN 'default' WHEN a = 0 AND b = 3 THEN 'tight' WHEN a = 1 AND b = 5 THEN 'balanced' WHEN a = 2 AND b = 8 THEN 'relaxed' ELSE 'custom' END AS name FROM t""")
def tolerance_names(spark, sf_dir):
    k = F.col("s_suppkey")
    return table(spark, sf_dir, "supplier").select("s_suppkey", review.tolerance_name(k % 3, 3 + k % 6).alias("name"))


@studies.query("""
WITH d AS (SELECT user_id AS at_id, event_id % 5 AS to_id, event_type AS set_id, 1.0 + value / 1e6 AS r FROM events),
f AS (SELECT at_id, to_id, first(r ORDER BY set_id, r) AS f FROM d GROUP BY ALL), x AS (SELECT d.at_id, d.to_id, set_id, r - f AS d FROM d JOIN f ON d.at_id = f.at_id AND d.to_id = f.to_id)
SELECT at_id, to_id, count(DISTINCT set_id) AS sets, round(max(d) - min(d), 8) AS spread, round(stddev_pop(d), 8) AS rms, round((max(d) - min(d) + 2 * stddev_pop(d)) * 180 / pi() * 3600, 3) AS score FROM x GROUP BY ALL HAVING count(DISTINCT set_id) >= 2""")
def direction_repeatability(spark, sf_dir):
    d = table(spark, sf_dir, "events").select(F.col("user_id").alias("at_id"), (F.col("event_id") % 5).alias("to_id"), F.col("event_type").alias("set_id"), (1.0 + F.col("value") / 1e6).alias("r"))
    out = review.direction_repeatability(d, "r")
    return out.select("at_id", "to_id", "sets", F.round("spread", 8).alias("spread"), F.round("rms", 8).alias("rms"), F.round("score", 3).alias("score"))


@studies.query("""
WITH p AS (SELECT c_custkey, (c_custkey % 97) * 0.11 AS x, (c_custkey % 53) * 0.17 AS y FROM customer)
SELECT c_custkey, CASE WHEN floor(x / 0.5) < 20 AND floor(y / 0.5) < 16 THEN round(CAST(100 - (20 + 0.1 * (y / 0.5) + 0.2 * (x / 0.5)) AS DOUBLE), 6) END AS height FROM p""")
def geoid_heights(spark, sf_dir):
    """Heights above the geoid, from a grid of undulations that is a plane, so that cells must give it back."""
    k = F.col("c_custkey")
    points = table(spark, sf_dir, "customer").select("c_custkey", ((k % 97) * 0.11).alias("x"), ((k % 53) * 0.17).alias("y"))
    grid = spark.range(17 * 21).select(F.floor(F.col("id") / 21).alias("i"), (F.col("id") % 21).alias("j")).withColumn("value", 20 + 0.1 * F.col("i") + 0.2 * F.col("j"))
    out = geodesy.grid_values(points, "x", "y", grid, 0.5)
    return rounded(out.select("c_custkey", geodesy.orthometric(F.lit(100.0), "value").alias("height")))


@studies.query("""
WITH s AS (SELECT s_suppkey, radians(s_suppkey % 360) AS az, 45.0 + (s_suppkey % 50) * 0.05 AS lat, -66.5 + (s_suppkey % 21 - 10) * 0.1 AS lon, 100 + s_suppkey * 0.5 AS d FROM supplier), c AS (SELECT *, az - atan(tan(radians(lon + 66.5)) * sin(radians(lat))) AS g FROM s)
SELECT s_suppkey, round(g - floor(g / (2 * pi())) * 2 * pi(), 8) AS azimuth, round((d - 0.03) * (1 + 12 * 1e-6) * 0.9996, 6) AS distance FROM c""")
def grid_reductions(spark, sf_dir):
    """Azimuths from grid north, and distances with prism constant, ppm and scale."""
    k = F.col("s_suppkey")
    s = table(spark, sf_dir, "supplier").select("s_suppkey", F.radians((k % 360).cast("double")).alias("az"), (45.0 + (k % 50) * 0.05).alias("lat"), (-66.5 + (k % 21 - 10) * 0.1).alias("lon"), (100 + k * 0.5).alias("d"))
    return s.select("s_suppkey", F.round(geodesy.grid_azimuth("az", "lat", "lon", -66.5), 8).alias("azimuth"), F.round(geodesy.corrected_distance("d", -0.03, 12, 0.9996), 6).alias("distance"))


@studies.query("""
WITH p AS (SELECT c_nationkey AS area, 44.0 + (c_custkey % 90) * 0.05 AS lat, CASE WHEN c_custkey % 17 <> 0 THEN -69.5 + (c_custkey % 70) * 0.1 END AS lon FROM customer)
SELECT area, count(*) AS n, count(*) FILTER (coalesce(lat BETWEEN 44.5 AND 48.1 AND lon BETWEEN -69.1 AND -63.7, false)) AS inside FROM p GROUP BY area""")
def area_of_use(spark, sf_dir):
    k = F.col("c_custkey")
    p = table(spark, sf_dir, "customer").select(F.col("c_nationkey").alias("area"), (44.0 + (k % 90) * 0.05).alias("lat"), F.when(k % 17 != 0, -69.5 + (k % 70) * 0.1).alias("lon"))
    return p.groupBy("area").agg(F.count(F.lit(1)).alias("n"), F.count_if(geodesy.inside_box("lat", "lon", 44.5, -69.1, 48.1, -63.7)).alias("inside"))


@studies.query("""SELECT s_nationkey AS k, count(*) AS n, CAST(sum(CAST(s_suppkey AS HUGEINT)) AS VARCHAR) AS ids FROM supplier GROUP BY 1""")
def content_hashes(spark, sf_dir):
    """Rows and identifiers of each group beside its hash, which two orders of the rows agree on."""
    from plumbline.operators.corpus import content_hash

    s = table(spark, sf_dir, "supplier").withColumnRenamed("s_nationkey", "k")
    a, b = content_hash(s, "k", "s_suppkey", "s_name"), content_hash(s.orderBy(F.desc("s_suppkey")), "k", "s_suppkey", "s_name").withColumnsRenamed({"k": "k2", "n": "n2", "content_hash": "h2"})
    same = a.join(b, (F.col("k") == F.col("k2")) & (F.col("n") == F.col("n2")) & (F.col("content_hash") == F.col("h2"))).select("k", "n")
    ids = s.groupBy(F.col("k").alias("k3")).agg(F.sum("s_suppkey").cast("string").alias("ids"))
    return same.join(ids, F.col("k") == F.col("k3")).select("k", "n", "ids")
