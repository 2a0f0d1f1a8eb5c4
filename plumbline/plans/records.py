"""Joins, comparisons, ordered analytics and graphs over the driver's tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from plumbline.operators import graph, ordered, relational, statistics
from plumbline.plans.measurements import OBS_SQL, observations, rounded
from plumbline.plans.registry import Registry
from plumbline.tables import table

records = Registry()


@records.query("""SELECT o_orderkey, o_custkey FROM orders o WHERE NOT EXISTS (SELECT 1 FROM customer c WHERE c.c_custkey = o.o_custkey AND c.c_acctbal < 0)""")
def active_filter_anti(spark, sf_dir):
    """Orders that aren't excluded: those of customers with a negative balance are."""
    obs = table(spark, sf_dir, "orders").select("o_orderkey", F.col("o_custkey").alias("k"))
    excluded = table(spark, sf_dir, "customer").filter("c_acctbal < 0").select(F.col("c_custkey").alias("k"))
    return relational.active_rows(obs, excluded, "k").select("o_orderkey", F.col("k").alias("o_custkey"))


@records.query("""
WITH ch AS (SELECT l_orderkey, max(l_extendedprice) AS p FROM lineitem WHERE l_returnflag = 'R' GROUP BY l_orderkey)
SELECT o_orderkey, round(coalesce(p, o_totalprice), 6) AS o_totalprice FROM orders LEFT JOIN ch ON l_orderkey = o_orderkey""")
def override_coalesce(spark, sf_dir):
    changes = table(spark, sf_dir, "lineitem").filter("l_returnflag = 'R'").select(F.col("l_orderkey").alias("k"), F.col("l_extendedprice").alias("o_totalprice"))
    base = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("k"), "o_totalprice")
    return rounded(relational.override(base, changes, "k", ["o_totalprice"])).withColumnRenamed("k", "o_orderkey")


@records.query("""
WITH a AS (SELECT o_orderkey AS k, o_orderstatus AS v FROM orders), b AS (SELECT l_orderkey AS k, max(l_linestatus) AS v FROM lineitem GROUP BY 1)
SELECT coalesce(a.k, b.k) AS k, CASE WHEN a.k IS NULL THEN 'new' WHEN b.k IS NULL THEN 'removed' WHEN a.v IS NOT DISTINCT FROM b.v THEN 'unchanged' ELSE 'changed' END AS state
FROM a FULL JOIN b ON a.k = b.k""")
def snapshot_diff_full_outer(spark, sf_dir):
    before = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("k"), F.col("o_orderstatus").alias("v"))
    after = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("k")).agg(F.max("l_linestatus").alias("v"))
    return relational.snapshot_diff(before, after, "k", "v")


@records.query("""
WITH l AS (SELECT l_orderkey, l_linenumber, max(l_discount) AS v FROM lineitem WHERE l_returnflag <> 'R' GROUP BY ALL),
r AS (SELECT l_orderkey, l_linenumber, max(l_tax) AS v FROM lineitem WHERE l_returnflag = 'R' GROUP BY ALL)
SELECT l.l_orderkey, l.l_linenumber, round(l.v, 6) AS v, round(abs(abs(l.v) - coalesce(abs(r.v), 0)), 6) AS change
FROM l LEFT JOIN r USING (l_orderkey, l_linenumber) WHERE abs(abs(l.v) - coalesce(abs(r.v), 0)) >= 0.025""")
def run_compare_residuals(spark, sf_dir):
    """Residuals of a run against a baseline run; rows without a baseline count from 0."""
    li, keys = table(spark, sf_dir, "lineitem"), ["l_orderkey", "l_linenumber"]
    current = li.filter("l_returnflag <> 'R'").groupBy(*keys).agg(F.max("l_discount").alias("v"))
    baseline = li.filter("l_returnflag = 'R'").select(*keys, F.col("l_tax").alias("v"))
    return rounded(relational.residual_changes(current, baseline, keys, "v", 0.025, [F.col("v").desc()]))


@records.query("""
SELECT s_suppkey AS k, round(sqrt((s_acctbal - c_acctbal) ** 2 + (s_nationkey - c_nationkey) ** 2), 6) AS shift
FROM supplier JOIN customer ON s_suppkey = c_custkey WHERE sqrt((s_acctbal - c_acctbal) ** 2 + (s_nationkey - c_nationkey) ** 2) >= 0.05""")
def moved_stations(spark, sf_dir):
    before = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("k"), F.col("c_acctbal").alias("x"), F.col("c_nationkey").cast("double").alias("y"))
    after = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("k"), F.col("s_acctbal").alias("x"), F.col("s_nationkey").cast("double").alias("y"))
    return rounded(relational.moved(before, after, "k", 0.05))


TYPES = ["click", "error", "purchase", "signup", "view"]


@records.query(f"""
WITH c AS (SELECT user_id, {', '.join(f"count(*) FILTER (event_type = '{t}') AS {t}" for t in TYPES)} FROM events GROUP BY user_id)
SELECT *, least({', '.join(TYPES)}) AS low, greatest({', '.join(TYPES)}) AS high, greatest({', '.join(TYPES)}) - least({', '.join(TYPES)}) AS spread FROM c""")
def source_count_spread(spark, sf_dir):
    return relational.source_spread(table(spark, sf_dir, "events"), "user_id", "event_type", TYPES)


@records.query("""
WITH m AS (SELECT user_id, event_type, sum(CASE WHEN event_type = 'signup' THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS mark_no FROM events)
SELECT user_id, CAST(mark_no AS BIGINT) AS mark_no, count(*) FILTER (event_type <> 'signup') AS n FROM m GROUP BY user_id, mark_no""")
def directive_range_counts(spark, sf_dir):
    """How many rows stand in the range of each directive (here a sign-up), up to the next one."""
    e = table(spark, sf_dir, "events")
    rows = relational.between_marks(e, F.col("event_type") == "signup", ["user_id"], [F.col("ts"), F.col("event_id")])
    return rows.groupBy("user_id", "mark_no").agg(F.count_if(F.col("event_type") != "signup").alias("n"))


@records.query("""
SELECT event_id, last_value(CASE WHEN event_type = 'purchase' THEN value END IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS context FROM events""")
def forward_fill_context(spark, sf_dir):
    e = table(spark, sf_dir, "events").withColumn("context", F.when(F.col("event_type") == "purchase", F.col("value")))
    return ordered.forward_fill(e, ["context"], ["user_id"], [F.col("ts"), F.col("event_id")]).select("event_id", "context")


@records.query("""
WITH s AS (SELECT user_id, value, sum(CASE WHEN event_type = 'error' THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS session FROM events)
SELECT user_id, CAST(session AS BIGINT) AS session, count(*) AS n, round(sum(value), 4) AS total FROM s GROUP BY user_id, session""")
def marker_sessions(spark, sf_dir):
    rows = ordered.sessions(table(spark, sf_dir, "events"), F.col("event_type") == "error", ["user_id"], [F.col("ts"), F.col("event_id")])
    return rounded(rows.groupBy("user_id", "session").agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total")), 4)


@records.query("""
WITH w AS (SELECT event_id, event_type, lag(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS b FROM events)
SELECT event_id, event_type FROM w WHERE b IS NULL OR b <> event_type""")
def mode_changes(spark, sf_dir):
    return ordered.changes(table(spark, sf_dir, "events"), "event_type", ["user_id"], [F.col("ts"), F.col("event_id")]).select("event_id", "event_type")


@records.query("SELECT event_id, coalesce(lead(event_id) OVER (PARTITION BY user_id ORDER BY event_id), -1) AS slice_end FROM events")
def slice_ends(spark, sf_dir):
    return ordered.slices(table(spark, sf_dir, "events"), "event_id", F.lit(-1).cast("long"), ["user_id"]).select("event_id", "slice_end")


@records.query("SELECT o_custkey, o_orderkey FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) = 1")
def top1_per_group(spark, sf_dir):
    return ordered.top_k(table(spark, sf_dir, "orders"), ["o_custkey"], [F.col("o_totalprice").desc(), F.col("o_orderkey")], 1).select("o_custkey", "o_orderkey")


@records.query("SELECT p_type, p_partkey, row_number() OVER (PARTITION BY p_type ORDER BY p_retailprice DESC, p_partkey) AS rank FROM part QUALIFY rank <= 5")
def topk_per_category(spark, sf_dir):
    return ordered.top_k(table(spark, sf_dir, "part"), ["p_type"], [F.col("p_retailprice").desc(), F.col("p_partkey")], 5).select("p_type", "p_partkey", "rank")


_POINTS = "p AS (SELECT c_custkey AS k, c_acctbal AS x, c_nationkey * 20.0 AS y FROM customer)"


def _points(spark, sf_dir):
    return table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("k"), F.col("c_acctbal").alias("x"), (F.col("c_nationkey") * 20.0).alias("y"))


@records.query(f"""
WITH {_POINTS} SELECT a.k AS a, b.k AS b, round(sqrt((a.x - b.x) ** 2 + (a.y - b.y) ** 2), 6) AS dist FROM p a JOIN p b ON a.k < b.k AND sqrt((a.x - b.x) ** 2 + (a.y - b.y) ** 2) <= 8""")
def pair_distance_join(spark, sf_dir):
    return rounded(relational.near_pairs(_points(spark, sf_dir), "k", "x", "y", 8.0))


@records.query(f"""
WITH RECURSIVE {_POINTS}, e AS (SELECT a.k AS a, b.k AS b FROM p a JOIN p b ON a.k <> b.k AND abs(a.x - b.x) <= 8 AND sqrt((a.x - b.x) ** 2 + (a.y - b.y) ** 2) <= 8),
r AS (SELECT DISTINCT a AS node, a AS root FROM e UNION SELECT e.b, r.root FROM r JOIN e ON r.node = e.a)
SELECT node, min(root) AS root FROM r GROUP BY node""")
def connected_components(spark, sf_dir):
    """Single-linkage clusters of points."""
    return graph.components(relational.near_links(_points(spark, sf_dir), "k", "x", "y", 8.0))


@records.query(f"""
WITH {_POINTS}, t AS (SELECT s_suppkey AS t, s_acctbal AS x, s_nationkey * 20.0 AS y FROM supplier),
d AS (SELECT p.k, t.t, sqrt((p.x - t.x) ** 2 + (p.y - t.y) ** 2) AS dist FROM p, t)
SELECT k, first(t ORDER BY dist, t) AS t, round(min(dist), 6) AS dist FROM d WHERE dist <= 50 GROUP BY k""")
def nearest_snap(spark, sf_dir):
    t = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("t"), F.col("s_acctbal").alias("x"), (F.col("s_nationkey") * 20.0).alias("y"))
    return rounded(relational.nearest(_points(spark, sf_dir), "k", t, "t", "x", "y", 50.0))


@records.query("""
WITH b AS (SELECT s_suppkey AS k, s_acctbal AS x0, s_nationkey * 10.0 AS y0, s_acctbal + 40 AS x1, s_nationkey * 10.0 + 25 AS y1 FROM supplier)
SELECT a.k AS a, b.k AS b FROM b a JOIN b ON a.k < b.k AND a.x0 < b.x1 AND b.x0 < a.x1 AND a.y0 < b.y1 AND b.y0 < a.y1""")
def parcel_overlaps(spark, sf_dir):
    y = F.col("s_nationkey") * 10.0
    boxes = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("k"), F.col("s_acctbal").alias("x0"), y.alias("y0"), (F.col("s_acctbal") + 40).alias("x1"), (y + 25).alias("y1"))
    return relational.boxes_overlap(boxes, "k")


_LEGS = """legs AS (SELECT o_custkey AS c, o_orderkey AS k, (o_totalprice % 100) - 50 AS de, (o_totalprice % 37) - 18 AS dn FROM orders)"""


def _legs(spark, sf_dir):
    return table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("c"), F.col("o_orderkey").alias("k"), (F.col("o_totalprice") % 100 - 50).alias("de"), (F.col("o_totalprice") % 37 - 18).alias("dn"))


@records.query(f"""
WITH {_LEGS}, s AS (SELECT *, sqrt(de * de + dn * dn) / sum(sqrt(de * de + dn * dn)) OVER (PARTITION BY c) AS share, sum(de) OVER (PARTITION BY c) AS ce, sum(dn) OVER (PARTITION BY c) AS cn FROM legs),
a AS (SELECT c, k, de - ce * share AS ae, dn - cn * share AS an FROM s)
SELECT c, k, round(sum(ae) OVER (PARTITION BY c ORDER BY k ROWS UNBOUNDED PRECEDING), 4) + 0.0 AS e, round(sum(an) OVER (PARTITION BY c ORDER BY k ROWS UNBOUNDED PRECEDING), 4) + 0.0 AS n FROM a""")
def traverse_bowditch(spark, sf_dir):
    out = ordered.balance_traverse(_legs(spark, sf_dir), "c", [F.col("k")])
    return out.select("c", "k", (F.round("e", 4) + 0.0).alias("e"), (F.round("n", 4) + 0.0).alias("n"))


@records.query(f"""
WITH {_LEGS}, r AS (SELECT c, k, sum(sqrt(de * de + dn * dn)) OVER (PARTITION BY c ORDER BY k ROWS UNBOUNDED PRECEDING) AS e, sqrt(de * de + dn * dn) AS len FROM legs),
p AS (SELECT c, k, unnest(generate_series(CAST(ceil((e - len) / 25) AS BIGINT), CAST(ceil(e / 25) AS BIGINT) - 1)) * 25.0 AS station FROM r)
SELECT c, k, CAST(station AS DOUBLE) AS station FROM p""")
def alignment_stations(spark, sf_dir):
    legs = _legs(spark, sf_dir).withColumn("len", F.sqrt(F.col("de") * F.col("de") + F.col("dn") * F.col("dn")))
    return ordered.station_points(ordered.stationing(legs, "c", [F.col("k")], "len"), 25.0).select("c", "k", "station")


@records.query(f"""
WITH {_LEGS}, v AS (SELECT c, k, sum(de) OVER w AS x, sum(dn) OVER w AS y FROM legs WINDOW w AS (PARTITION BY c ORDER BY k ROWS UNBOUNDED PRECEDING)),
n AS (SELECT c, x, y, coalesce(lead(x) OVER (PARTITION BY c ORDER BY k), first_value(x) OVER (PARTITION BY c ORDER BY k)) AS x2,
             coalesce(lead(y) OVER (PARTITION BY c ORDER BY k), first_value(y) OVER (PARTITION BY c ORDER BY k)) AS y2 FROM v)
SELECT c, count(*) AS vertices, round(abs(sum(x * y2 - x2 * y)) / 2, 3) AS area, round(sum(sqrt((x2 - x) ** 2 + (y2 - y) ** 2)), 3) AS perimeter FROM n GROUP BY c""")
def polygon_area_closure(spark, sf_dir):
    """Area and perimeter of the ring of each customer's running positions."""
    from pyspark.sql.window import Window

    w = Window.partitionBy("c").orderBy("k")
    run = w.rowsBetween(Window.unboundedPreceding, 0)
    v = _legs(spark, sf_dir).select("c", "k", F.sum("de").over(run).alias("x"), F.sum("dn").over(run).alias("y"))
    n = v.withColumns({f"{a}2": F.coalesce(F.lead(a).over(w), F.first(a).over(w)) for a in "xy"})
    area = F.abs(F.sum(F.col("x") * F.col("y2") - F.col("x2") * F.col("y"))) / 2
    return rounded(n.groupBy("c").agg(F.count(F.lit(1)).alias("vertices"), area.alias("area"), F.sum(F.hypot(F.col("x2") - F.col("x"), F.col("y2") - F.col("y"))).alias("perimeter")), 3)


_UNITS = """u AS (SELECT o_orderkey AS unit_id, CASE o_orderpriority WHEN '1-URGENT' THEN 0 WHEN '2-HIGH' THEN 1 WHEN '3-MEDIUM' THEN 2 WHEN '4-NOT SPECIFIED' THEN 3 ELSE 4 END AS "group",
  o_orderdate AS due, o_orderkey % 5 AS priority FROM orders)"""


@records.query(f"""
WITH {_UNITS}, d AS (SELECT * FROM u WHERE "group" IN (0, 3, 4) OR due <= TIMESTAMP '1997-06-01'),
f AS (SELECT * FROM d WHERE "group" <> 3 UNION ALL (SELECT * FROM d WHERE "group" = 3 ORDER BY due, priority, unit_id LIMIT 5))
SELECT unit_id, "group", row_number() OVER (ORDER BY "group", due, priority, unit_id) AS rank FROM f ORDER BY rank LIMIT 25""")
def queue_due_order(spark, sf_dir):
    group = F.when(F.col("o_orderpriority") == "1-URGENT", 0).when(F.col("o_orderpriority") == "2-HIGH", 1).when(F.col("o_orderpriority") == "3-MEDIUM", 2).when(F.col("o_orderpriority") == "4-NOT SPECIFIED", 3).otherwise(4)
    units = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("unit_id"), group.alias("group"), F.col("o_orderdate").alias("due"), (F.col("o_orderkey") % 5).alias("priority"))
    return ordered.due_queue(units, F.lit("1997-06-01").cast("timestamp")).select("unit_id", "group", "rank")


@records.query(f"""
WITH {OBS_SQL}, q AS (
  SELECT CASE WHEN abs(std_res) >= 4 THEN 'high' WHEN abs(std_res) >= 3 THEN 'medium' ELSE 'low' END AS severity, 'residual' AS source, CAST(obs_id AS VARCHAR) AS item FROM obs WHERE abs(std_res) >= 2
  UNION ALL SELECT CASE WHEN o_totalprice >= 450000 THEN 'high' ELSE 'medium' END, 'price', CAST(o_orderkey AS VARCHAR) FROM orders WHERE o_totalprice >= 400000)
SELECT severity, source, item, CASE severity WHEN 'high' THEN 0 WHEN 'medium' THEN 1 ELSE 2 END AS severity_rank,
  row_number() OVER (ORDER BY CASE severity WHEN 'high' THEN 0 WHEN 'medium' THEN 1 ELSE 2 END, source, item) AS rank FROM q""")
def severity_review_queue(spark, sf_dir):
    t = F.abs("std_res")
    obs = observations(spark, sf_dir).filter(t >= 2)
    a = obs.select(F.when(t >= 4, "high").when(t >= 3, "medium").otherwise("low").alias("severity"), F.lit("residual").alias("source"), F.lit(None).cast("long").alias("line"), F.col("obs_id").cast("string").alias("item"))
    o = table(spark, sf_dir, "orders").filter("o_totalprice >= 400000")
    b = o.select(F.when(F.col("o_totalprice") >= 450000, "high").otherwise("medium").alias("severity"), F.lit("price").alias("source"), F.col("o_orderkey").cast("string").alias("item"))
    queue, order = ordered.review_rows([a, b])
    return ordered.numbered(queue, order).drop("line")


@records.query("""
WITH p AS (SELECT p_name, p_partkey, row_number() OVER (PARTITION BY p_name ORDER BY p_partkey) AS n FROM part)
SELECT p_partkey, CASE WHEN n = 1 THEN p_name ELSE p_name || '#' || n END AS unique_key FROM p""")
def occurrence_keys(spark, sf_dir):
    return ordered.occurrence_keys(table(spark, sf_dir, "part"), "p_name", [F.col("p_partkey")]).select("p_partkey", "unique_key")


@records.query("SELECT p_name, p_type, count(*) AS n FROM part GROUP BY ALL HAVING count(*) > 1")
def duplicate_keys(spark, sf_dir):
    return statistics.duplicates(table(spark, sf_dir, "part"), "p_name", "p_type")


@records.query("SELECT d.doc_id FROM documents d WHERE d.doc_id IS NOT NULL AND NOT EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = d.doc_id)")
def fk_violations(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id")
    return relational.violations(docs, "doc_id", table(spark, sf_dir, "labels").withColumnRenamed("doc_id", "label_id"), "label_id")


@records.query("""
SELECT coalesce(a.k, b.k) AS k, CASE WHEN b.k IS NULL THEN 'added' ELSE 'removed' END AS side
FROM (SELECT DISTINCT l_suppkey AS k FROM lineitem) a FULL JOIN (SELECT c_custkey AS k FROM customer) b ON a.k = b.k WHERE a.k IS NULL OR b.k IS NULL""")
def difference_both_ways(spark, sf_dir):
    return relational.difference_both_ways(table(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("k")), table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("k")), "k")


@records.query("""
SELECT c_custkey AS k, c_name AS name FROM customer WHERE NOT EXISTS (SELECT 1 FROM supplier WHERE s_suppkey = c_custkey) UNION ALL SELECT s_suppkey, s_name FROM supplier""")
def upsert_by_key(spark, sf_dir):
    old = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("k"), F.col("c_name").alias("name"))
    return relational.upsert(old, table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("k"), F.col("s_name").alias("name")), "k")


@records.query("""
SELECT p_brand AS station, count(*) AS records, count(DISTINCT upper(trim(p_name))) AS descriptions, first(p_name ORDER BY p_partkey, p_name) AS first_spelling,
       count(DISTINCT upper(trim(p_name))) > 1 AS conflict FROM part GROUP BY p_brand""")
def description_scan(spark, sf_dir):
    from plumbline.functions.text import description_key

    return statistics.description_scan(table(spark, sf_dir, "part"), "p_brand", F.col("p_name"), description_key("p_name"), "p_partkey")


@records.query("""
SELECT p_type AS label, p_name AS signature, count(DISTINCT p_brand) AS documents FROM part GROUP BY ALL HAVING count(DISTINCT p_brand) >= 2""")
def template_collisions(spark, sf_dir):
    p = table(spark, sf_dir, "part").select(F.col("p_type").alias("label"), F.col("p_name").alias("signature"), "p_brand")
    return statistics.collisions(p, "label", "signature", "p_brand")


@records.query("""
WITH i AS (SELECT user_id, event_type FROM events WHERE event_type IN ('error', 'signup', 'view'))
SELECT user_id, count(*) AS issues, CAST(greatest(0, least(100, 100 - sum(CASE event_type WHEN 'error' THEN 2 WHEN 'signup' THEN 1 ELSE 5 END))) AS INTEGER) AS score FROM i GROUP BY user_id""")
def quality_score(spark, sf_dir):
    issues = table(spark, sf_dir, "events").filter(F.col("event_type").isin("error", "signup", "view"))
    return statistics.penalty_scores(issues, "user_id", "event_type", {"error": 2, "signup": 1})


@records.query("SELECT s_suppkey, s_name, row_number() OVER (ORDER BY s_suppkey) AS rank FROM supplier")
def natural_order(spark, sf_dir):
    """The places of names in natural order, which is that of the numbers in them."""
    from plumbline.functions.numbers import natural_key

    return ordered.numbered(table(spark, sf_dir, "supplier").select("s_suppkey", "s_name"), [natural_key("s_name")])


@records.query("""
WITH t AS (SELECT c_custkey AS id, least(c_custkey // 7 * 7 + 6, (SELECT max(c_custkey) FROM customer)) AS resolved FROM customer) SELECT id, resolved, CAST(resolved - id AS INTEGER) AS steps, false AS cycle FROM t""")
def alias_resolution(spark, sf_dir):
    """Chains of up to six rules, k to k + 1 within each seven, the last of which is not whole."""
    ids = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"))
    known = ids.select(F.col("id").alias("to_id"))
    rules = ids.filter("id % 7 <> 6").select(F.col("id").alias("from_id"), (F.col("id") + 1).alias("next"))
    rules = rules.join(known, F.col("next") == F.col("to_id")).select("from_id", "to_id")
    return relational.resolve_aliases(ids, rules)
