"""Exports and windows over time."""

from __future__ import annotations

from pyspark.sql import functions as F

from plumbline.plans.measurements import OBS_SQL, observations, rounded
from plumbline.plans.registry import Registry
from plumbline.plans.reviews import SHOTS_SQL, shots
from plumbline.sources import exports, residuals
from plumbline.streaming.windows import windowed_counts
from plumbline.tables import table

outputs = Registry()


@outputs.query(f"""
WITH {OBS_SQL} SELECT least(from_id, to_id) || '|' || greatest(from_id, to_id) AS pair, string_agg(DISTINCT type, ',' ORDER BY type) AS types, count(*) AS n FROM obs GROUP BY 1""")
def network_connections(spark, sf_dir):
    return exports.connections(observations(spark, sf_dir))


@outputs.query("""
SELECT c_custkey, round(1000 + 1.0001 * (cos(radians(30)) * (c_acctbal - 1000) + sin(radians(30)) * (c_nationkey - 10)) + 5, 4) AS x,
       round(10 + 1.0001 * (-sin(radians(30)) * (c_acctbal - 1000) + cos(radians(30)) * (c_nationkey - 10)) - 7, 4) AS y FROM customer""")
def export_transform(spark, sf_dir):
    p = table(spark, sf_dir, "customer").select("c_custkey", F.col("c_acctbal").alias("x"), F.col("c_nationkey").cast("double").alias("y"))
    return rounded(exports.transform_points(p, "x", "y", (1000.0, 10.0), 1.0001, 0.5235987755982988, (5.0, -7.0)), 4)


@outputs.query("""
WITH p AS (SELECT *, CASE p_partkey % 4 WHEN 0 THEN p_name || ';x' WHEN 1 THEN p_name || ',x' WHEN 2 THEN '"' || p_name ELSE p_name END AS name FROM part)
SELECT p_partkey || ';' || CASE WHEN contains(name, ';') OR contains(name, '"') THEN '"' || replace(name, '"', '""') || '"' ELSE name END || ';' || p_size AS line FROM p""")
def points_csv(spark, sf_dir):
    """Rows by semicolons; names that hold one, or a quote, are quoted, those with a comma aren't."""
    k, name = F.col("p_partkey") % 4, F.col("p_name")
    marked = F.when(k == 0, F.concat(name, F.lit(";x"))).when(k == 1, F.concat(name, F.lit(",x"))).when(k == 2, F.concat(F.lit('"'), name)).otherwise(name)
    return exports.delimited(table(spark, sf_dir, "part").withColumn("name", marked), ["p_partkey", "name", "p_size"], ";")


@outputs.query("""SELECT s_suppkey, CAST(to_json({'type': 'Feature', 'geometry': {'type': 'Point', 'coordinates': [s_acctbal, CAST(s_nationkey AS DOUBLE)]}, 'properties': {'id': CAST(s_suppkey AS VARCHAR)}}) AS VARCHAR) AS feature FROM supplier""")
def network_geojson(spark, sf_dir):
    return exports.geojson_points(table(spark, sf_dir, "supplier").withColumn("y", F.col("s_nationkey").cast("double")), "s_suppkey", "s_acctbal", "y")


@outputs.query("""
WITH o AS (SELECT o_custkey % 40 + 1 AS f, o_orderkey % 37 + 1 AS t, o_orderstatus AS k FROM orders WHERE o_custkey % 40 <> o_orderkey % 37),
p AS (SELECT least(f, t) AS a, greatest(f, t) AS b, string_agg(DISTINCT k, ',' ORDER BY k) AS types, count(*) AS n FROM o GROUP BY 1, 2)
SELECT a || '|' || b AS pair, CAST(to_json({'type': 'Feature', 'geometry': {'type': 'LineString', 'coordinates': [[x.s_acctbal, CAST(x.s_nationkey AS DOUBLE)], [y.s_acctbal, CAST(y.s_nationkey AS DOUBLE)]]},
  'properties': {'pair': a || '|' || b, 'types': types, 'observations': n}}) AS VARCHAR) AS feature FROM p JOIN supplier x ON x.s_suppkey = a JOIN supplier y ON y.s_suppkey = b""")
def network_lines(spark, sf_dir):
    obs = table(spark, sf_dir, "orders").select((F.col("o_custkey") % 40 + 1).alias("from_id"), (F.col("o_orderkey") % 37 + 1).alias("to_id"), F.col("o_orderstatus").alias("type"))
    points = table(spark, sf_dir, "supplier").withColumn("y", F.col("s_nationkey").cast("double"))
    return exports.geojson_lines(obs, points, "s_suppkey", "s_acctbal", "y")


_ANGULAR = ", ".join(f"'{t}'" for t in residuals.ANGULAR)
_NUMBER = lambda v, digits: f"printf('%.{digits}f', CASE WHEN abs({v}) < 5e-13 THEN 0.0 ELSE {v} END)"
_SCALAR = lambda v, factor, digits: f"CASE WHEN g THEN '' WHEN a THEN {_NUMBER(f'{v} * (180 / pi()) * {factor}', digits)} ELSE {_NUMBER(v, 4)} END"


@outputs.query(f"""
WITH {SHOTS_SQL}, n AS (SELECT *, type = 'gps' AS g, type IN ({_ANGULAR}) AS a, (obs_id % 5000) / 7.0::DOUBLE AS v, (obs_id % 601 - 300) / 7000.0::DOUBLE AS r, (obs_id % 13 + 1) / 1100.0::DOUBLE AS s, obs_id % 9 = 0 AS planned, CASE WHEN obs_id % 9 = 0 AND obs_id % 2 = 0 THEN NULL ELSE 1 END AS k FROM named)
SELECT CAST(obs_id AS VARCHAR) AS "obsId", CASE WHEN obs_id % 13 = 0 THEN 'post-adjust-only' WHEN planned AND k IS NULL THEN 'planned' ELSE 'active' END AS status, type, label AS stations, CAST(planned AS VARCHAR) AS planned,
  CASE WHEN type = 'dist' THEN coalesce(mode, '') ELSE '' END AS mode, CASE WHEN type = 'direction' THEN '' ELSE CAST(from_id AS VARCHAR) END AS "fromStation", CASE type WHEN 'angle' THEN CAST(at_id AS VARCHAR) WHEN 'direction' THEN CAST(from_id AS VARCHAR) ELSE '' END AS "atStation",
  {_SCALAR('v', 1, 8)} AS "observedValue", CASE WHEN g THEN {_NUMBER('v', 4)} ELSE '' END AS "observedDeltaE", CASE WHEN k IS NULL THEN '' ELSE {_SCALAR('(v - r)', 1, 8)} END AS "calculatedValue", CASE WHEN k IS NULL THEN '' ELSE {_SCALAR('r', 3600, 3)} END AS "residualValue",
  CASE WHEN k IS NULL OR NOT g THEN '' ELSE {_NUMBER('r', 4)} END AS "residualDeltaE", {_SCALAR('s', 3600, 3)} AS "stdDev", CASE WHEN g THEN {_NUMBER('s', 4)} ELSE '' END AS "stdDevN", CAST(local_pass AS VARCHAR) AS "localTestPass",
  CASE WHEN g THEN 'm (m E/m N)' WHEN a THEN 'deg' ELSE 'm' END AS "observedUnit", CASE WHEN a THEN 'arcsec' ELSE 'm' END AS "sigmaUnit" FROM n""")
def residual_table(spark, sf_dir):
    """Columns of the table of residuals for observations of all types, some planned, some sideshots."""
    k = F.col("obs_id")
    left = F.when((k % 9 == 0) & (k % 2 == 0), None)
    value, residual = (k % 5000) / 7.0, left.otherwise((k % 601 - 300) / 7000.0)
    obs = shots(spark, sf_dir).withColumns({"value": value, "sigma": (k % 13 + 1) / 1100.0, "planned": k % 9 == 0, "sideshot": k % 13 == 0, "residual": residual, "residual_e": F.when(F.col("type") == "gps", residual)})
    names = ("obsId", "status", "type", "stations", "planned", "mode", "fromStation", "atStation", "observedValue", "observedDeltaE", "calculatedValue", "residualValue", "residualDeltaE", "stdDev", "stdDevN", "localTestPass", "observedUnit", "sigmaUnit")
    return residuals.residual_table(obs).select(*names)


@outputs.query("SELECT event_type, date_trunc('hour', ts) AS start, count(*) AS n, round(sum(value), 4) AS total FROM events WHERE ts IS NOT NULL GROUP BY 1, 2")
def event_windows(spark, sf_dir):
    return rounded(windowed_counts(table(spark, sf_dir, "events"), "ts", ["event_type"], "value"), 4)
