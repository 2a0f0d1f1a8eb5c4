"""Levelling lines in all their forms."""

from __future__ import annotations

from pyspark.sql import functions as F

from plumbline.operators import levelling
from plumbline.plans.registry import Registry
from plumbline.tables import table

levels = Registry()

#: Forms of a line by its number: what stands before the value. A and B are stations, known or not, I an instrument; a pair is one token.
_FORMS = ("I A B", "A B", "I A-B", "A-B", "A I B", "A 1.5", "1.25 B", "", "A-", "I A B")


@levels.query(f"""
WITH l AS (SELECT o_orderkey % 11 AS net, o_orderkey AS line, 'S' || o_custkey % 40 AS a, 'S' || (o_orderkey // 3) % 30 AS b, 'I' || o_orderkey % 5 AS i, [{", ".join(f"'{f}'" for f in _FORMS)}][(o_custkey + o_orderkey % 7 + 1) % 10 + 1] AS f, CAST(o_orderkey % 50 + 1 AS DOUBLE) AS q, o_orderkey % 7 + 1 AS n FROM orders),
t AS (SELECT *, list_filter(string_split(replace(replace(replace(f, 'I', i), 'A', a), 'B', b) || ' ' || CASE WHEN n = 7 THEN '?' ELSE CAST(q / 8 AS VARCHAR) END || ' ' || CAST(CAST(q AS INTEGER) * 10 AS VARCHAR) || CASE n WHEN 1 THEN ' 0.002' WHEN 2 THEN ' !' WHEN 3 THEN ' *' ELSE '' END, ' '), lambda x: x <> '') AS k, CASE WHEN n % 2 = 0 THEN 'I' || n END AS cur FROM l),
r AS (SELECT *, unnest([{{'form': 1, 'inst': coalesce(k[1], ''), 'x': k[2], 'y': k[3], 'e': true, 'v': 4}}, {{'form': 2, 'inst': coalesce(cur, ''), 'x': k[1], 'y': k[2], 'e': false, 'v': 3}},
  {{'form': 3, 'inst': coalesce(k[1], ''), 'x': CASE WHEN regexp_matches(k[2], '^[^-]+-.') THEN regexp_extract(k[2], '^([^-]+)-', 1) END, 'y': CASE WHEN regexp_matches(k[2], '^[^-]+-.') THEN regexp_extract(k[2], '^[^-]+-(.*)$', 1) END, 'e': true, 'v': 3}},
  {{'form': 4, 'inst': coalesce(cur, ''), 'x': CASE WHEN regexp_matches(k[1], '^[^-]+-.') THEN regexp_extract(k[1], '^([^-]+)-', 1) END, 'y': CASE WHEN regexp_matches(k[1], '^[^-]+-.') THEN regexp_extract(k[1], '^[^-]+-(.*)$', 1) END, 'e': false, 'v': 2}}], recursive := true) FROM t),
c AS (SELECT *, k[v] AS dh_t, k[v + 1] AS len_t, k[v + 2] AS s_t FROM r WHERE x IS NOT NULL AND y IS NOT NULL AND regexp_matches(coalesce(k[v], ''), '^([+-]?([0-9]+\\.?[0-9]*|\\.[0-9]+)([eE][+-]?[0-9]+)?|\\?)$')),
s AS (SELECT *, CASE WHEN x[1] = 'S' AND TRY_CAST(x[2:] AS INTEGER) < 25 THEN 2 ELSE 0 END + CASE WHEN y[1] = 'S' AND TRY_CAST(y[2:] AS INTEGER) < 25 THEN 2 ELSE 0 END + CASE WHEN e THEN 1 ELSE 0 END + CASE WHEN inst IN ('I0', 'I1', 'I2') THEN 2 ELSE 0 END
  + CASE WHEN e AND inst <> '' AND NOT (inst[1] = 'S' AND coalesce(TRY_CAST(inst[2:] AS INTEGER) < 25, false)) THEN 1 ELSE 0 END + CASE WHEN regexp_matches(x, '^[+-]?[0-9]+\\.[0-9]+$') OR regexp_matches(y, '^[+-]?[0-9]+\\.[0-9]+$') THEN -12 ELSE 0 END AS score FROM c),
w AS (SELECT *, row_number() OVER o AS place, lead(score) OVER o AS second, count(*) OVER (PARTITION BY line) AS n_candidates FROM s WINDOW o AS (PARTITION BY line ORDER BY score DESC, form)),
d AS (SELECT *, CASE WHEN second = score THEN 'ambiguous' WHEN regexp_matches(x, '^[+-]?[0-9]+\\.[0-9]+$') OR regexp_matches(y, '^[+-]?[0-9]+\\.[0-9]+$') THEN 'numeric' ELSE 'ok' END AS status, CASE WHEN TRY_CAST(len_t AS DOUBLE) > 0 THEN TRY_CAST(len_t AS DOUBLE) / 1000 ELSE 0 END AS km FROM w WHERE place = 1)
SELECT l.net, l.line, coalesce(d.status, 'invalid') AS status, CASE WHEN d.status = 'ok' THEN form END AS form, CASE WHEN d.status = 'ok' THEN inst END AS inst, CASE WHEN d.status = 'ok' THEN x END AS from_id, CASE WHEN d.status = 'ok' THEN y END AS to_id,
  CASE WHEN d.status = 'ok' THEN TRY_CAST(dh_t AS DOUBLE) END AS dh, CASE WHEN d.status = 'ok' THEN dh_t = '?' END AS planned, CASE WHEN d.status = 'ok' THEN CAST(km AS DOUBLE) END AS length_km,
  CASE WHEN d.status = 'ok' THEN round(CAST(CASE WHEN s_t = '!' THEN 1e-9 WHEN s_t = '*' THEN 1e9 WHEN s_t IS NOT NULL THEN CAST(s_t AS DOUBLE) WHEN inst IN ('I0', 'I1', 'I2') THEN sqrt(km) * (1 + CAST(inst[2:] AS INTEGER)) / 1000 ELSE 0 END AS DOUBLE), 9) END AS sigma,
  CASE WHEN d.status = 'ok' THEN CASE WHEN s_t = '!' THEN 'fixed' WHEN s_t = '*' THEN 'float' WHEN s_t IS NOT NULL THEN 'explicit' ELSE 'default' END END AS sigma_source, d.score, CAST(coalesce(d.n_candidates, 0) AS INTEGER) AS n_candidates
FROM l LEFT JOIN d ON l.line = d.line""")
def resolved_levels(spark, sf_dir):
    """Lines of all forms, some with names that nobody knows, some that may be read in two ways."""
    rows = table(spark, sf_dir, "orders")
    n, k = F.col("o_orderkey") % 7 + 1, F.col("o_orderkey")
    form = F.element_at(F.array(*map(F.lit, _FORMS)), ((F.col("o_custkey") + n) % 10 + 1).cast("int"))
    name = lambda c, to: F.replace(c, F.lit(to[0]), to[1])
    head = name(name(name(form, ("I", F.concat(F.lit("I"), k % 5))), ("A", F.concat(F.lit("S"), F.col("o_custkey") % 40))), ("B", F.concat(F.lit("S"), F.floor(k / 3) % 30)))
    quantity = k % 50 + 1
    value = F.when(n == 7, "?").otherwise((quantity / 8).cast("string"))
    sigma = F.when(n == 1, " 0.002").when(n == 2, " !").when(n == 3, " *").otherwise("")
    text = F.concat(head, F.lit(" "), value, F.lit(" "), (quantity * 10).cast("string"), sigma)
    lines = rows.select(
        (k % 11).alias("net"), k.alias("line"), F.filter(F.split(text, " "), lambda x: x != "").alias("tokens"),
        F.when(n % 2 == 0, F.concat(F.lit("I"), n.cast("string"))).alias("instrument"),
    )
    nets = lines.select("net").distinct()
    stations = nets.select("net", F.explode(F.sequence(F.lit(0), F.lit(24))).alias("s")).select("net", F.concat(F.lit("S"), "s").alias("station"))
    instruments = nets.select("net", F.explode(F.sequence(F.lit(0), F.lit(2))).alias("s")).select("net", F.concat(F.lit("I"), "s").alias("inst"), (F.col("s") + 1.0).alias("lev_mm"))
    out = levelling.resolve_levels(lines, stations, instruments, ["net", "line"])
    return out.withColumn("sigma", F.round("sigma", 9))
