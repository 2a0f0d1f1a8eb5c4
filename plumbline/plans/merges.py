"""Merged stations of each supplier's network."""

from __future__ import annotations

from pyspark.sql import functions as F

from plumbline.operators import clusters
from plumbline.plans.registry import Registry
from plumbline.tables import spread, table

merges = Registry()

#: Measured stations: name, what east and north are off by (millimetres for each net), and the sigma in millimetres.
_SHOTS = (("2", 1, 2, 2), ("2b", -2, 1, 4), ("2c", 3, -3, 4), ("9", 0, 0, 2))


def _network(spark, sf_dir):
    """Vectors from a fixed station to four others, three of which are one point. One merge is chained, one was rejected, one names a station
    that isn't there, and one comes twice."""
    s = spread(table(spark, sf_dir, "supplier")).select(F.col("s_suppkey").alias("net"))
    shots = F.array(*(F.struct(F.lit(i).alias("i"), F.lit(n).alias("to_id"), F.lit(e).alias("e"), F.lit(u).alias("u"), F.lit(w).alias("w")) for i, (n, e, u, w) in enumerate(_SHOTS, 1)))
    each = s.select("net", F.explode(shots).alias("t"))
    off = lambda c: F.col(f"t.{c}") * (F.col("net") % 7) * 0.001
    obs = each.select(
        "net", F.col("t.i").alias("obs_id"), F.lit("gps").alias("type"), F.lit("1").alias("from_id"), "t.to_id", F.lit(None).cast("string").alias("at_id"),
        (30.0 + off("e")).alias("value"), (40.0 + off("u")).alias("value_n"), (F.col("t.w") * 0.001).alias("sigma"),
    )
    at = lambda n, x, y, f: F.struct(F.lit(n).alias("station"), F.lit(x).alias("x"), F.lit(y).alias("y"), F.lit(0.0).alias("h"), F.lit(f).alias("fixed"))
    places = F.array(at("1", 0.0, 0.0, True), *(at(n, 29.0, 41.0, False) for n, *_ in _SHOTS))
    stations = s.select("net", F.explode(places).alias("p")).select("net", "p.*")
    asked = [(" 2b", "2", True), ("2c", "2b", True), ("2c", "2b ", True), ("9", "2", False), ("77", "2", True), ("2", "2", True)]
    rows = F.array(*(F.struct(F.lit(a).alias("alias_id"), F.lit(c).alias("canonical_id"), F.lit(k).alias("approved")) for a, c, k in asked))
    return obs, stations, s.filter("net % 5 <> 4").select("net", F.explode(rows).alias("m")).select("net", "m.*")


@merges.query("""
WITH n AS (SELECT s_suppkey AS net, (s_suppkey % 7) * 0.001 AS k FROM supplier WHERE s_suppkey % 5 <> 4),
p AS (SELECT net, k, '2' AS name, 30 + k AS x, 40 + 2 * k AS y FROM n UNION ALL SELECT net, k, '2b', 30 - 2 * k, 40 + k FROM n UNION ALL SELECT net, k, '2c', 30 + 3 * k, 40 - 3 * k FROM n),
m AS (SELECT net, k, unnest([{'a': '2b', 'c': '2'}, {'a': '2c', 'c': '2b'}, {'a': '77', 'c': '2'}], recursive := true) FROM n)
SELECT m.net, m.a AS alias_id, m.c AS canonical_id, p.name IS NULL AS missing, round(CAST(p.x - q.x AS DOUBLE), 5) AS delta_x, round(CAST(p.y - q.y AS DOUBLE), 5) AS delta_y, round(CAST(sqrt((p.x - q.x) ** 2 + (p.y - q.y) ** 2) AS DOUBLE), 5) AS horizontal,
  round(CAST((0.25 * (30 + m.k) + 0.0625 * (30 - 2 * m.k) + 0.0625 * (30 + 3 * m.k)) / 0.375 AS DOUBLE), 5) AS x, round(CAST((0.25 * (40 + 2 * m.k) + 0.0625 * (40 + m.k) + 0.0625 * (40 - 3 * m.k)) / 0.375 AS DOUBLE), 5) AS y
FROM m JOIN (SELECT net, name, x, y FROM p) q ON q.net = m.net AND q.name = m.c LEFT JOIN p ON p.net = m.net AND p.name = m.a""")
def merge_outcomes(spark, sf_dir):
    """What each merge joins by the first pass, and where the merged station lies after the second."""
    done = clusters.dual_pass(*_network(spark, sf_dir))
    places = done.second.stations.select(F.col("net").alias("s_net"), "station", "x", "y")
    names = done.names.select(F.col("net").alias("n_net"), F.col("station").alias("n_s"), "name")
    rows = done.outcomes.join(names, (F.col("net") == F.col("n_net")) & (F.col("alias_id") == F.col("n_s"))).join(places, (F.col("net") == F.col("s_net")) & (F.col("name") == F.col("station")))
    return rows.select("net", "alias_id", "canonical_id", "missing", *(F.round(F.round(c, 5) + 0.0, 5).alias(c) for c in ("delta_x", "delta_y", "horizontal", "x", "y")))
