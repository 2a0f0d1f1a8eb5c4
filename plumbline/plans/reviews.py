"""Reviews of results. Rows of ``orders`` stand for observations: priority is the type, customer and key the ends, status the source."""

from __future__ import annotations

from pyspark.sql import functions as F

from plumbline.functions.numbers import rounded_half_away
from plumbline.operators import ordered, review
from plumbline.plans.measurements import rounded
from plumbline.plans.registry import Registry
from plumbline.tables import table

reviews = Registry()

_TYPE = {"1-URGENT": "dist", "2-HIGH": "angle", "3-MEDIUM": "gps", "4-NOT SPECIFIED": "lev"}

SHOTS_SQL = f"""shots AS (
  SELECT o_orderkey AS obs_id, CASE o_orderpriority {' '.join(f"WHEN '{k}' THEN '{v}'" for k, v in _TYPE.items())} ELSE 'direction' END AS type, o_custkey + 1 AS at_id, o_custkey AS from_id, o_orderkey % 1000 AS to_id,
         o_orderstatus AS set_id, o_orderstatus AS source, o_orderkey // 4 AS line, o_custkey % 20 AS net, (o_totalprice % 7 - 3) / 100 AS residual, 0.005 + (o_orderkey % 13) * 0.001 AS sigma,
         ((o_totalprice % 7 - 3) / 100) / (0.005 + (o_orderkey % 13) * 0.001) AS std_res, abs(((o_totalprice % 7 - 3) / 100) / (0.005 + (o_orderkey % 13) * 0.001)) <= 3.29 AS local_pass, (o_orderkey % 10) / 10.0 AS redundancy,
         CASE WHEN o_orderkey % 2 = 0 THEN 'slope' END AS mode, 100 + o_totalprice % 50 AS value
  FROM orders),
named AS (SELECT *, CASE type WHEN 'angle' THEN at_id || '-' || from_id || '-' || to_id ELSE from_id || '-' || to_id END AS label FROM shots)"""


def shots(spark, sf_dir):
    o, key, kind = table(spark, sf_dir, "orders"), F.col("o_orderkey"), F.lit("direction")
    for priority, t in _TYPE.items():
        kind = F.when(F.col("o_orderpriority") == priority, t).otherwise(kind)
    residual, sigma = (F.col("o_totalprice") % 7 - 3) / 100, F.lit(0.005) + (key % 13) * 0.001
    return o.select(
        key.alias("obs_id"), kind.alias("type"), (F.col("o_custkey") + 1).alias("at_id"), F.col("o_custkey").alias("from_id"), (key % 1000).alias("to_id"), F.col("o_orderstatus").alias("set_id"),
        F.col("o_orderstatus").alias("source"), F.floor(key / 4).alias("line"), (F.col("o_custkey") % 20).alias("net"), residual.alias("residual"), sigma.alias("sigma"), (residual / sigma).alias("std_res"),
        (F.abs(residual / sigma) <= 3.29).alias("local_pass"), ((key % 10) / 10.0).alias("redundancy"), F.when(key % 2 == 0, "slope").alias("mode"), (100 + F.col("o_totalprice") % 50).alias("value"),
    )


@reviews.query(f"""
WITH {SHOTS_SQL} SELECT obs_id, label AS stations FROM named WHERE type = 'dist' AND obs_id % 11 <> 0 AND source = 'O' AND (abs(std_res) >= 2 OR NOT local_pass) AND contains('dist ' || from_id || ' ' || to_id, '7')""")
def report_filter(spark, sf_dir):
    obs = shots(spark, sf_dir)
    rows = review.report_rows(obs, "dist", obs.filter("obs_id % 11 = 0"), "included", "O", True, True, "7")
    return rows.select("obs_id", review.station_label().alias("stations"))


@reviews.query(f"""WITH {SHOTS_SQL} SELECT redundancy >= 0.5 AND local_pass AS checked, count(*) AS n, min(obs_id) AS first_obs FROM shots GROUP BY 1""")
def complementary_split(spark, sf_dir):
    """Rows that hold and all others, each once."""
    yes, no = review.complementary(shots(spark, sf_dir), (F.col("redundancy") >= 0.5) & F.col("local_pass"))
    both = yes.withColumn("checked", F.lit(True)).unionByName(no.withColumn("checked", F.lit(False)))
    return both.groupBy("checked").agg(F.count(F.lit(1)).alias("n"), F.min("obs_id").alias("first_obs"))


@reviews.query(f"""WITH {SHOTS_SQL} SELECT 'obs-' || obs_id AS key, obs_id, type, from_id, to_id, least(from_id, to_id) || '|' || greatest(from_id, to_id) AS pair FROM shots WHERE type IN ('dist', 'gps')""")
def map_links(spark, sf_dir):
    return review.map_links(shots(spark, sf_dir))


@reviews.query(f"""WITH {SHOTS_SQL} SELECT obs_id, CASE type WHEN 'angle' THEN at_id || ' ' || from_id || ' ' || to_id WHEN 'direction' THEN from_id || ' ' || to_id || ' ' || set_id ELSE from_id || ' ' || to_id END AS text FROM shots""")
def search_labels(spark, sf_dir):
    return shots(spark, sf_dir).select("obs_id", review.search_label().alias("text"))


@reviews.query(f"""
WITH {SHOTS_SQL} SELECT net, obs_id, row_number() OVER (PARTITION BY net ORDER BY NOT local_pass DESC, abs(std_res) DESC, obs_id) AS rank FROM shots WHERE NOT local_pass OR abs(std_res) >= 2 QUALIFY rank <= 3""")
def suspect_candidates(spark, sf_dir):
    """Each network's three candidates for a closer look."""
    return review.suspects(shots(spark, sf_dir), ["net"], 3, 2.0).select("net", "obs_id", "rank")


@reviews.query(f"""
WITH {SHOTS_SQL} SELECT net, obs_id, CASE WHEN NOT local_pass THEN 'local-test' ELSE 'std-res' END AS reason FROM shots WHERE (NOT local_pass OR abs(std_res) >= 4) AND redundancy >= 0.05
QUALIFY row_number() OVER (PARTITION BY net ORDER BY NOT local_pass DESC, abs(std_res) DESC, redundancy DESC, obs_id) <= 2""")
def auto_removals(spark, sf_dir):
    return review.removals(shots(spark, sf_dir), ["net"], k=2).select("net", "obs_id", "reason")


@reviews.query(f"""
WITH {SHOTS_SQL}, d AS (SELECT obs_id, type, label AS stations, abs(residual) * CASE WHEN type IN ('angle', 'direction') THEN 180 / pi() * 3600 ELSE 1.0 END AS difference FROM named)
SELECT obs_id, type, stations, round(difference, 4) AS difference FROM d ORDER BY d.difference DESC, obs_id LIMIT 25""")
def data_check_top25(spark, sf_dir):
    return rounded(review.largest_differences(shots(spark, sf_dir)), 4)


@reviews.query(f"""WITH {SHOTS_SQL} SELECT obs_id, row_number() OVER (ORDER BY round(abs(std_res), 12) DESC, obs_id) AS rank FROM shots""")
def listing_order(spark, sf_dir):
    """The places of all rows in a listing by standardised residual."""
    rows = shots(spark, sf_dir).select("obs_id", "std_res")
    return ordered.numbered(rows, review.LISTING_ORDERS["stdResidual"]()).select("obs_id", "rank")


@reviews.query(f"""
WITH {SHOTS_SQL}, a AS (SELECT obs_id FROM shots ORDER BY abs(std_res) DESC, obs_id LIMIT 500), b AS (SELECT obs_id FROM shots ORDER BY abs(residual) DESC, obs_id LIMIT 500)
SELECT count(*) AS overlap FROM a WHERE obs_id IN (SELECT obs_id FROM b)""")
def overlap_count(spark, sf_dir):
    """How many of the 500 largest rows by one measure are among those by another."""
    obs = shots(spark, sf_dir)
    a, b = (obs.orderBy(F.abs(c).desc(), "obs_id").limit(500).select("obs_id") for c in ("std_res", "residual"))
    return a.join(b, "obs_id", "left_semi").agg(F.count(F.lit(1)).alias("overlap"))


_LOOPS = """loops AS (SELECT o_orderkey AS loop, (o_totalprice % 100 - 50) / 1000 AS de, (o_totalprice % 37 - 18) / 1000 AS dn, o_totalprice / 100 AS distance,
  CASE WHEN o_orderkey % 3 <> 0 THEN CAST(o_orderkey % 40 - 20 AS DOUBLE) END AS angle_arcsec, CASE WHEN o_orderkey % 5 <> 0 THEN (o_orderkey % 9 - 4) / 100.0 END AS vertical FROM orders),
m AS (SELECT *, sqrt(de * de + dn * dn) AS size FROM loops), r AS (SELECT *, distance / size AS ratio, size / distance * 1e6 AS ppm FROM m)"""


@reviews.query(f"""
WITH {_LOOPS}
SELECT loop, round(size, 6) AS misclosure, round(ratio, 2) AS closure_ratio, round(ppm, 4) AS linear_ppm,
  round(greatest(CASE WHEN ratio < 50000 THEN 50000 / greatest(ratio, 1) - 1 ELSE 0 END, 0) * 70 + greatest(ppm / 20 - 1, 0) * 70 + coalesce(greatest(abs(angle_arcsec) / 10 - 1, 0), 0) * 35
    + coalesce(greatest(abs(vertical) / 0.03 - 1, 0), 0) * 35 + least(size * 10, 25), 4) AS severity,
  ratio >= 50000 AND ppm <= 20 AND coalesce(abs(angle_arcsec) <= 10, true) AND coalesce(abs(vertical) <= 0.03, true) AS pass FROM r""")
def traverse_diagnostics(spark, sf_dir):
    key, price = F.col("o_orderkey"), F.col("o_totalprice")
    loops = table(spark, sf_dir, "orders").select(
        key.alias("loop"), ((price % 100 - 50) / 1000).alias("de"), ((price % 37 - 18) / 1000).alias("dn"), (price / 100).alias("distance"),
        F.when(key % 3 != 0, (key % 40 - 20).cast("double")).alias("angle_arcsec"), F.when(key % 5 != 0, (key % 9 - 4) / 100.0).alias("vertical"),
    )
    out = review.traverse_severity(loops, 50_000, 20, 10, 0.03)
    digits = {"misclosure": 6, "closure_ratio": 2, "linear_ppm": 4, "severity": 4}
    return out.select("loop", *(rounded_half_away(c, n).alias(c) for c, n in digits.items()), "pass")


@reviews.query("""
WITH s AS (SELECT o_custkey % 50 AS loop, o_orderkey % 200 AS segment, o_totalprice % 9 - 4 AS dh, CAST(o_custkey % 50 AS DOUBLE) * 0.5 AS severity, o_custkey % 3 = 0 AS pass FROM orders)
SELECT segment, count(*) AS loops, round(sum(severity), 4) AS score, round(max(abs(dh)), 6) AS max_dh, first(loop ORDER BY severity DESC, loop) AS worst_loop FROM s WHERE NOT pass GROUP BY segment""")
def level_segment_suspects(spark, sf_dir):
    loop = F.col("o_custkey") % 50
    s = table(spark, sf_dir, "orders").select(loop.alias("loop"), (F.col("o_orderkey") % 200).alias("segment"), (F.col("o_totalprice") % 9 - 4).alias("dh"), (loop.cast("double") * 0.5).alias("severity"), (F.col("o_custkey") % 3 == 0).alias("pass"))
    return rounded(review.segment_suspects(s))


@reviews.query("""
WITH m AS (SELECT s_nationkey AS cluster, s_suppkey AS k, s_acctbal AS x, CAST(s_suppkey % 17 AS DOUBLE) AS y, s_suppkey % 5 = 0 AS fixed FROM supplier),
p AS (SELECT a.cluster, sqrt((a.x - b.x) ** 2 + (a.y - b.y) ** 2) AS dist FROM m a JOIN m b ON a.cluster = b.cluster AND a.k < b.k),
g AS (SELECT cluster, max(dist) AS hi, avg(dist) AS mean FROM p GROUP BY cluster)
SELECT m.cluster, count(*) AS n, round(avg(x), 6) AS x, round(avg(y), 6) AS y, bool_or(fixed) AS fixed, bool_or(NOT fixed) AS free, round(coalesce(max(hi), 0), 6) AS max_separation, round(coalesce(max(mean), 0), 6) AS mean_separation
FROM m LEFT JOIN g ON m.cluster = g.cluster GROUP BY m.cluster""")
def cluster_diagnostics(spark, sf_dir):
    m = table(spark, sf_dir, "supplier").select(F.col("s_nationkey").alias("cluster"), F.col("s_suppkey").alias("k"), F.col("s_acctbal").alias("x"), (F.col("s_suppkey") % 17).cast("double").alias("y"), (F.col("s_suppkey") % 5 == 0).alias("fixed"))
    a, b = m.alias("a"), m.alias("b")
    pairs = a.join(b, (F.col("a.cluster") == F.col("b.cluster")) & (F.col("a.k") < F.col("b.k"))).select("a.cluster", F.hypot(F.col("a.x") - F.col("b.x"), F.col("a.y") - F.col("b.y")).alias("dist"))
    return rounded(review.cluster_summary(m, pairs))


@reviews.query(f"""
WITH {SHOTS_SQL}, e AS (SELECT obs_id, line, from_id AS station FROM shots UNION SELECT obs_id, line, to_id FROM shots)
SELECT station, count(DISTINCT obs_id) AS n, min(obs_id) AS first_obs, string_agg(DISTINCT CAST(line AS VARCHAR), ',' ORDER BY line) AS lines FROM (SELECT DISTINCT station, obs_id, line FROM e) GROUP BY station""".replace("string_agg(DISTINCT CAST(line AS VARCHAR), ',' ORDER BY line)", "array_to_string(list_sort(list(DISTINCT line)), ',')"))
def station_lines(spark, sf_dir):
    return review.station_lines(shots(spark, sf_dir), "line")


@reviews.query("""
WITH e AS (SELECT 'P' || c_custkey AS id, c_acctbal AS x, CAST(c_nationkey AS DOUBLE) AS y, 0.0 AS h FROM customer), i AS (SELECT 'P' || s_suppkey AS id, s_acctbal AS x, CAST(s_suppkey % 25 AS DOUBLE) AS y, CASE WHEN s_suppkey % 4 <> 0 THEN 0.0 END AS h FROM supplier),
b AS (SELECT i.id, coalesce(abs(i.x - e.x) > 5000, false) OR coalesce(abs(i.y - e.y) > 5000, false) OR coalesce(abs(i.h - e.h) > 5000, false) AS d FROM i JOIN e USING (id))
SELECT id, 'collision' AS kind FROM b UNION ALL SELECT id, 'coordinates' FROM b WHERE d""")
def import_conflicts(spark, sf_dir):
    existing = table(spark, sf_dir, "customer").select(F.concat(F.lit("P"), "c_custkey").alias("id"), F.col("c_acctbal").alias("x"), F.col("c_nationkey").cast("double").alias("y"), F.lit(0.0).alias("h"))
    k = F.col("s_suppkey")
    incoming = table(spark, sf_dir, "supplier").select(F.concat(F.lit(" p"), k).alias("id"), F.col("s_acctbal").alias("x"), (k % 25).cast("double").alias("y"), F.when(k % 4 != 0, 0.0).alias("h"))
    return review.import_conflicts(existing, incoming, 5000.0)


@reviews.query("""
WITH e AS (SELECT l_suppkey AS a, l_partkey AS b, count(*) AS existing FROM lineitem WHERE l_returnflag = 'A' GROUP BY ALL), i AS (SELECT DISTINCT l_suppkey AS a, l_partkey AS b FROM lineitem WHERE l_returnflag = 'R')
SELECT a, b, existing FROM i JOIN e USING (a, b)""")
def repeated_families(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("a"), F.col("l_partkey").alias("b"), "l_returnflag")
    return review.repeated_families(li.filter("l_returnflag = 'A'"), li.filter("l_returnflag = 'R'").select("a", "b").distinct(), ["a", "b"])


_SIDE = """side AS (SELECT o_orderkey AS k, o_custkey % 20 + 1 AS s, 100 + o_totalprice % 50 AS d, CAST(o_orderkey % 6 AS DOUBLE) AS az, 1.4 + (o_orderkey % 7) * 0.05 AS z, o_orderkey % 3 AS m FROM orders WHERE o_orderkey % 5 = 0),
f AS (SELECT *, CASE WHEN m = 0 THEN d * sin(z) ELSE d END AS flat, CASE m WHEN 0 THEN d * cos(z) WHEN 1 THEN 0.25 END AS dh,
  CASE WHEN m = 0 THEN sqrt((sin(z) * 0.01) ** 2 + (d * cos(z) * 1e-4) ** 2) ELSE 0.01 END AS sd, CASE m WHEN 0 THEN sqrt((cos(z) * 0.01) ** 2 + (d * sin(z) * 1e-4) ** 2) WHEN 1 THEN 0.002 END AS sh FROM side)"""


@reviews.query(f"""
WITH {_SIDE} SELECT k AS obs_id, k AS to_id, round(s_acctbal + flat * sin(az), 4) AS x, round(s_nationkey + flat * cos(az), 4) AS y, round(10 + dh, 4) AS h, round(sd, 6) AS sigma_dist, round(sh, 6) AS sigma_dh FROM f JOIN supplier ON s_suppkey = s""")
def sideshot_points(spark, sf_dir):
    """A third of the shots have a zenith angle, a third a height difference, a third nothing."""
    k = F.col("o_orderkey")
    o = table(spark, sf_dir, "orders").filter(k % 5 == 0)
    base = [F.lit(1).alias("net"), (F.col("o_custkey") % 20 + 1).alias("from_id"), k.alias("to_id"), k.alias("line"), (k % 6).cast("double").alias("azimuth")]
    none = F.lit(None).cast("string")
    dist = o.select(*base, k.alias("obs_id"), F.lit("dist").alias("type"), (100 + F.col("o_totalprice") % 50).alias("value"), F.lit(0.01).alias("sigma"), F.when(k % 3 == 0, "slope").otherwise("level").alias("mode"))
    zen = o.filter(k % 3 == 0).select(*base, (k + 1).alias("obs_id"), F.lit("zenith").alias("type"), (1.4 + (k % 7) * 0.05).alias("value"), F.lit(1e-4).alias("sigma"), none.alias("mode"))
    lev = o.filter(k % 3 == 1).select(*base, (k + 1).alias("obs_id"), F.lit("lev").alias("type"), F.lit(0.25).alias("value"), F.lit(0.002).alias("sigma"), none.alias("mode"))
    stations = table(spark, sf_dir, "supplier").select(F.lit(1).alias("net"), F.col("s_suppkey").alias("station"), F.col("s_acctbal").alias("x"), F.col("s_nationkey").cast("double").alias("y"), F.lit(10.0).alias("h"))
    out = review.sideshots(dist.unionByName(zen).unionByName(lev), stations)
    digits = {"x": 4, "y": 4, "h": 4, "sigma_dist": 6, "sigma_dh": 6}
    return out.select("obs_id", "to_id", *(F.round(c, n).alias(c) for c, n in digits.items()))


@reviews.query("""
WITH s AS (SELECT o_orderkey // 4 AS line, o_orderkey % 4 AS part, o_orderkey // 4 % 50 AS a, o_orderkey // 4 % (28 + o_orderkey % 4) AS t, (o_orderkey % 10) / 10.0 AS r, o_orderkey AS k FROM orders),
x AS (SELECT line, first(a ORDER BY k DESC) AS a, first(t ORDER BY k DESC) AS t, first(r ORDER BY k DESC) AS r FROM s WHERE part IN (0, 2) GROUP BY line), d AS (SELECT line, first(a ORDER BY k DESC) AS a, first(t ORDER BY k DESC) AS t, first(r ORDER BY k DESC) AS r FROM s WHERE part IN (1, 3) GROUP BY line)
SELECT x.line, x.a AS at_id, x.t AS to_id, least(x.r, d.r) AS min_redundancy FROM x JOIN d ON x.line = d.line AND x.a = d.a AND x.t = d.t WHERE least(x.r, d.r) < 0.5""")
def sideshot_candidates(spark, sf_dir):
    k = F.col("o_orderkey")
    line = F.floor(k / 4)
    obs = table(spark, sf_dir, "orders").select(
        k.alias("obs_id"), F.when(k % 2 == 0, "angle").otherwise("dist").alias("type"), line.alias("line"), (line % 50).alias("at_id"), (line % 50).alias("from_id"), (line % (28 + k % 4)).alias("to_id"), ((k % 10) / 10.0).alias("redundancy")
    )
    return review.sideshot_candidates(obs, 0.5)


@reviews.query(f"""
WITH {SHOTS_SQL}, z AS (SELECT *, CASE WHEN type = 'lev' THEN 'zenith' ELSE type END AS kind, from_id % 30 AS f, to_id % 30 AS t, line % 30 AS l FROM shots)
SELECT kind AS type, count(*) AS n, 0 AS made FROM z GROUP BY kind UNION ALL
SELECT 'zenith', count(*), 1 FROM z WHERE kind = 'dist' AND mode = 'slope' AND NOT EXISTS (SELECT 1 FROM z w WHERE w.kind = 'zenith' AND w.net = z.net AND w.f = z.f AND w.t = z.t AND w.l = z.l)""")
def missing_zeniths(spark, sf_dir):
    obs = shots(spark, sf_dir).withColumns({"type": F.when(F.col("type") == "lev", "zenith").otherwise(F.col("type")), "from_id": F.col("from_id") % 30, "to_id": F.col("to_id") % 30, "line": F.col("line") % 30})
    out = review.with_missing_zeniths(obs, 1e-4)
    given = out.filter("not made").groupBy("type", F.lit(0).alias("made")).agg(F.count(F.lit(1)).alias("n"))
    # There is a row of those made even if there are none.
    return given.unionByName(out.filter("made").agg(F.count(F.lit(1)).alias("n")).select(F.lit("zenith").alias("type"), F.lit(1).alias("made"), "n"))


@reviews.query("""
WITH RECURSIVE r AS (SELECT source, doc_id, coalesce(length(text), 0) AS n, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS k FROM documents WHERE doc_id IS NOT NULL),
b AS (SELECT source, doc_id, k, 0 AS batch, n AS filled FROM r WHERE k = 1
  UNION ALL SELECT r.source, r.doc_id, r.k, CASE WHEN b.filled > 0 AND b.filled + r.n > 20000 THEN b.batch + 1 ELSE b.batch END, CASE WHEN b.filled > 0 AND b.filled + r.n > 20000 THEN r.n ELSE b.filled + r.n END
  FROM b JOIN r ON r.source IS NOT DISTINCT FROM b.source AND r.k = b.k + 1)
SELECT source, doc_id, batch FROM b""")
def size_batches(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").filter("doc_id is not null").select("source", "doc_id", F.length("text").alias("n"))
    return review.size_batches(docs, ["source"], ["doc_id"], "n", 20_000)


@reviews.query("SELECT event_type, event_id FROM events QUALIFY row_number() OVER (PARTITION BY event_type ORDER BY md5(CAST(event_id AS VARCHAR)), event_id) <= 10")
def stratified_sample(spark, sf_dir):
    return review.stratified(table(spark, sf_dir, "events"), ["event_type"], "event_id", 10).select("event_type", "event_id")


NAMES, ALIASES = ["CLICK", "ERROR", "PURCHASE", "SIGNUP", "SIGNAL", "VIEW", "VIEWPORT"], {"BUY": "PURCHASE", "ERR": "ERROR"}


@reviews.query(f"""
WITH t AS (SELECT DISTINCT './ ' || CASE event_id % 5 WHEN 4 THEN 'buy' ELSE substr(event_type, 1, CAST(event_id % 9 + 1 AS INTEGER)) END AS token FROM events),
n AS (SELECT unnest({NAMES!r}) AS name), u AS (SELECT token, upper(trim(token[3:])) AS t FROM t),
h AS (SELECT t, list_sort(list(name)) AS names FROM (SELECT DISTINCT t FROM u) JOIN n ON starts_with(name, t) GROUP BY t),
s AS (SELECT token, CASE u.t WHEN 'BUY' THEN 'PURCHASE' WHEN 'ERR' THEN 'ERROR' END AS means, u.t AS t, coalesce(names, []) AS names FROM u LEFT JOIN h ON u.t = h.t)
SELECT token, CASE WHEN means IS NOT NULL THEN means WHEN list_contains(names, t) THEN t WHEN len(names) = 1 THEN names[1] END AS name,
  CASE WHEN means IS NOT NULL THEN 'alias' WHEN list_contains(names, t) THEN 'name' WHEN len(names) = 1 THEN 'prefix' WHEN len(names) > 1 THEN 'ambiguous' ELSE 'unknown' END AS state,
  CASE WHEN means IS NULL AND NOT list_contains(names, t) AND len(names) > 1 THEN array_to_string(names, ',') ELSE '' END AS candidates FROM s""")
def directive_names(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    short = F.when(F.col("event_id") % 5 == 4, "buy").otherwise(F.substring("event_type", F.lit(1), (F.col("event_id") % 9 + 1).cast("int")))
    return review.resolve_names(e.select(F.concat(F.lit("./ "), short).alias("token")).distinct(), NAMES, ALIASES)


@reviews.query("""
WITH b AS (SELECT s_nationkey AS net, avg(s_acctbal) AS s0, max(s_acctbal) AS hi, avg(s_acctbal) < 5000 AS ok FROM supplier GROUP BY 1)
SELECT c_nationkey AS net, c_custkey AS obs_id, round(c_acctbal - s0, 4) AS delta_s0, round(c_acctbal / 2 - hi, 4) AS delta_max, CAST(0.5 AS DOUBLE) AS shift,
  round(-40 * (c_acctbal - s0) - 20 * (c_acctbal / 2 - hi) - 7.5 + CASE WHEN NOT ok AND c_custkey % 2 = 0 THEN 20 WHEN ok AND c_custkey % 2 <> 0 THEN -20 ELSE 0 END, 3) AS score FROM customer JOIN b ON net = c_nationkey""")
def impact_scores(spark, sf_dir):
    b = table(spark, sf_dir, "supplier").groupBy(F.col("s_nationkey").alias("net")).agg(F.avg("s_acctbal").alias("s0"), F.max("s_acctbal").alias("max_std_res"), (F.avg("s_acctbal") < 5000).alias("chi_pass"))
    w = table(spark, sf_dir, "customer").select(F.col("c_nationkey").alias("net"), F.col("c_custkey").alias("obs_id"), F.col("c_acctbal").alias("s0"), (F.col("c_acctbal") / 2).alias("max_std_res"), (F.col("c_custkey") % 2 == 0).alias("chi_pass"), F.lit(0.5).alias("shift"))
    out = review.impact_scores(b, w)
    return out.select("net", "obs_id", F.round("delta_s0", 4).alias("delta_s0"), F.round("delta_max", 4).alias("delta_max"), "shift", F.round("score", 3).alias("score"))
