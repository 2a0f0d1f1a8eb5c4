"""Planning of networks: what candidate sets of observations would do to their precision, and a plan that adds sets until a threshold is met.

A candidate set changes the covariance Q of a network by a low rank. With its weighted equation rows B, of which what new unknowns of the set (an
orientation, a new station) can absorb has been projected out, Q becomes Q - Z'Z, where Z = C⁻¹BQ and CC' = I + BQB'. So a set is scored from
products of its few rows with Q, one grouped sum for all sets of all networks, and a small system for each set; no network is
solved again. What precision is compared on are the stations' ellipses, the pairs that observations connect, and each station's way to the
nearest fixed station over the pairs, by its worst pair and then by the sum.

``obs`` and ``stations`` are those of ``adjustment``; ``candidates`` has the columns of ``obs``, ``scenario`` (the name of a set, unique in its network) and may
have ``kind``, ``occupy`` and ``label`` (of the set). Only places matter, so values may be null. A set's new stations have no precision of their own in
the scores, and their pairs none; once the set is taken they count. A set without an equation row is marked ``failed``. Networks that can't be solved
are left out, as are those without a free plane station.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from plumbline.functions.numbers import is_finite, natural_key, pair_key
from plumbline.operators.adjustment import equations, normal_equations, solve_networks
from plumbline.operators.graph import minimax_paths
from plumbline.operators.precision import relative_covariance
from plumbline.tables import by_groups, cut, group_starts

#: The order of kinds between sets that are otherwise equal, the weights of the score's parts and the ratio to the median from which geometry is weak.
KINDS = (
    "existing-set",
    "cross-tie",
    "brace-point",
    "promoted-setup",
    "synthetic-setup",
    "move-synthetic",
    "bypass-intermediate",
    "decommission-intermediate",
)
SCORE = {"d_worst_major": -100_000, "d_path_worst": 10_000, "d_path_total": 1_000, "d_median_major": 100, "d_worst_pair": 25, "d_weak_stations": 5, "d_weak_pairs": 4}
WEAK_RATIO = 1.6
RECOMMENDATIONS = 5
#: Differences in precision below this are none (metres, as decimals).
DECIMALS = 10
#: The base among the cases of a network.
BASE = ""


def _planned(rows: DataFrame) -> DataFrame:
    """Rows with some value, since coefficients don't depend on it."""
    return rows.withColumns({c: F.coalesce(F.col(c), F.lit(0.0)) for c in ("value", "value_n")})


def covariances(obs: DataFrame, stations: DataFrame) -> DataFrame:
    """(net, i, j, q) at the stations' places, for observations of unit variance; null values count as planned."""
    return solve_networks(normal_equations(equations(_planned(obs), stations)), covariance=True)


def set_effects(covariance: DataFrame, candidates: DataFrame, stations: DataFrame) -> DataFrame:
    """(net, scenario, k, p, z): the rows Z by which each candidate set changes its network's covariance, at parameters p; one row without
    p for a set that changes nothing."""
    places = stations.drop("sx", "sy", "sh")  # control is the base's
    rows = equations(_planned(candidates).withColumn("obs_id", F.struct("scenario", "obs_id")), places)
    k = F.concat_ws(":", F.col("obs_id.obs_id").cast("string"), "type", F.col("part").cast("string"))
    terms = rows.select("net", F.col("obs_id.scenario").alias("scenario"), k.alias("k"), "sigma", F.explode("terms").alias("t"))
    terms = terms.groupBy("net", "scenario", "k", F.col("t.p").alias("p")).agg(F.sum(F.col("t.a") / F.col("sigma")).alias("v"))
    terms = cut(terms, "scenario-terms")
    q = covariance.withColumnsRenamed({"net": "q_net"})
    known = q.filter("i = j").select("q_net", "i", F.lit(True).alias("known"))
    own = terms.join(known, (F.col("net") == F.col("q_net")) & (F.col("p") == F.col("i")), "left")
    own = own.select("net", "scenario", F.when(F.col("known"), "old").otherwise("new").alias("what"), "k", "p", "v")
    through = terms.join(q, (F.col("net") == F.col("q_net")) & (F.col("p") == F.col("i")))
    through = through.groupBy("net", "scenario", "k", F.col("j").alias("p")).agg(F.sum(F.col("v") * F.col("q")).alias("v"))
    cells = own.unionByName(through.select("net", "scenario", F.lit("bq").alias("what"), "k", "p", "v"))

    def one(rows):
        """(k, p, z) of one set's cells (what, k, p, v)."""
        ks = {k: i for i, k in enumerate(sorted({r[1] for r in rows}))}
        # Unknowns that the network knows stand in B and BQ alike.
        names = {what: {p: i for i, p in enumerate(sorted({r[2] for r in rows if r[0] == what}))} for what in ("new", "bq")}
        parts = {what: np.zeros((len(ks), len(names["new" if what == "new" else "bq"]))) for what in ("old", "new", "bq")}
        for what, k, p, v in rows:
            at = names["new" if what == "new" else "bq"].get(p)
            if at is not None:
                parts[what][ks[k], at] = v
        b, new, g = parts["old"], parts["new"], parts["bq"]
        u, s, _ = np.linalg.svd(new) if new.shape[1] else (np.eye(len(ks)), np.zeros(0), None)
        free = u[:, int((s > 1e-9 * s.max(initial=0.0)).sum()) :]
        factor = np.linalg.cholesky(np.eye(free.shape[1]) + free.T @ (g @ b.T) @ free)
        z = np.linalg.solve(factor, free.T @ g)
        at, p = np.nonzero(z)
        places = list(names["bq"])
        # A set that changes nothing is a case.
        return [(int(i), places[j], float(z[i, j])) for i, j in zip(at, p)] or [(0, None, 0.0)]

    def run(table: pa.Table):
        starts = group_starts(table, ["net", "scenario"])
        bounds = [*starts, table.num_rows]
        rows = list(zip(*(table[c].to_pylist() for c in ("what", "k", "p", "v"))))
        made = [one(rows[x:y]) for x, y in zip(bounds, bounds[1:])]
        of = pa.array(np.repeat(starts, list(map(len, made))))
        k, p, z = zip(*(r for rs in made for r in rs))
        yield pa.table({"net": table["net"].take(of), "scenario": table["scenario"].take(of), "k": pa.array(k, pa.int32()), "p": pa.array(p, pa.string()), "z": pa.array(z, pa.float64())})

    net = covariance.schema["net"].dataType.simpleString()
    return by_groups(cells.select("net", "scenario", "what", "k", "p", "v"), ["net", "scenario"], run, f"net {net}, scenario string, k int, p string, z double")


def _major(e: Column, n: Column, en: Column) -> Column:
    return F.sqrt(F.greatest((e + n) / 2 + F.sqrt(((n - e) / 2) ** 2 + en**2), F.lit(0.0)))


def _pairs(obs: DataFrame) -> DataFrame:
    """(net, a, b, key) of the pairs that rows connect: an angle or direction its own station and its target."""
    a = F.when(F.col("type") == "angle", F.col("at_id")).otherwise(F.col("from_id")).cast("string")
    rows = obs.select("net", a.alias("a"), F.col("to_id").cast("string").alias("b"), *(["scenario"] if "scenario" in obs.columns else []))
    return rows.filter("a is not null and b is not null and a <> b").withColumn("key", pair_key("a", "b"))


def case_metrics(obs: DataFrame, stations: DataFrame, candidates: DataFrame, covariance: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Precision of every case of a network, which is a candidate set (scenario) or the base (""): (net, scenario, station, major, worst, total)
    of every station, major null where it isn't free in plane, worst and total null without a way; and (net, scenario, pair, metric) of every pair."""
    covariance = cut(covariance, "scenario-q")
    effects = cut(set_effects(covariance, candidates, stations), "scenario-z")
    plane = effects.withColumns({"station": F.regexp_replace("p", ":[xyh]$", ""), "axis": F.right("p", F.lit(1))}).filter("p like '%:x' or p like '%:y'")
    moves = plane.groupBy("net", "scenario", "k", "station").agg(*(F.coalesce(F.sum(F.when(F.col("axis") == a, F.col("z"))), F.lit(0.0)).alias(f"z{a}") for a in "xy"))
    moves = cut(moves, "scenario-moves")

    split = covariance.withColumns({"station": F.regexp_replace("i", ":[xyh]$", ""), "s2": F.regexp_replace("j", ":[xyh]$", ""), "a": F.right("i", F.lit(1)), "b": F.right("j", F.lit(1))})
    own = split.filter("station = s2 and (i like '%:x' or i like '%:y') and (j like '%:x' or j like '%:y')")
    pick = lambda a, b: F.coalesce(F.sum(F.when((F.col("a") == a) & (F.col("b") == b), F.col("q"))), F.lit(0.0))
    blocks = own.groupBy("net", "station").agg(pick("x", "x").alias("e"), pick("y", "y").alias("n"), pick("x", "y").alias("en"))
    nets = blocks.select("net").distinct()
    sets = candidates.select("net", "scenario").distinct().join(effects.select("net", "scenario").distinct(), ["net", "scenario"], "left_semi")
    cases = cut(sets.join(nets, "net", "left_semi").unionByName(nets.withColumn("scenario", F.lit(BASE))), "scenario-cases")
    less = moves.groupBy("net", "scenario", "station").agg(F.sum(F.col("zx") ** 2).alias("le"), F.sum(F.col("zy") ** 2).alias("ln"), F.sum(F.col("zx") * F.col("zy")).alias("len"))
    majors = cases.join(blocks, "net").join(less, ["net", "scenario", "station"], "left")
    now = lambda c: F.col(c) - F.coalesce(f"l{c}", F.lit(0.0))
    majors = cut(majors.select("net", "scenario", "station", F.round(_major(now("e"), now("n"), now("en")), DECIMALS).alias("major")), "scenario-majors")

    base_pairs, set_pairs = _pairs(obs), _pairs(candidates)
    place = stations.select(F.col("net").alias("p_net"), F.col("station").cast("string").alias("p_s"), "x", "y", "fixed")
    ends = base_pairs.select("net", "a", "b").unionByName(set_pairs.select("net", "a", "b")).distinct()
    free = relative_covariance(covariance, ends.select("net", F.col("a").alias("from_id"), F.col("b").alias("to_id")))
    free = free.select(F.col("net").alias("r_net"), F.col("from_id").alias("r_a"), F.col("to_id").alias("r_b"), "c_ee", "c_nn", "c_en")
    one_each = lambda rows, by: rows.groupBy(*by, "key").agg(F.min(F.struct("a", "b")).alias("e")).select(*by, "key", "e.a", "e.b")
    known = one_each(base_pairs, ["net"])
    mine = one_each(set_pairs, ["net", "scenario"]).join(known, ["net", "key"], "left_anti")
    pairs = cases.join(known, "net").unionByName(mine.join(cases, ["net", "scenario"], "left_semi"), allowMissingColumns=True)
    for role in "ab":
        side = place.withColumnsRenamed({"x": f"{role}_x", "y": f"{role}_y", "fixed": f"{role}_fixed"})
        pairs = pairs.join(side, (F.col("net") == F.col("p_net")) & (F.col(role) == F.col("p_s"))).drop("p_net", "p_s")
    pairs = pairs.join(free, (F.col("net") == F.col("r_net")) & (F.col("a") == F.col("r_a")) & (F.col("b") == F.col("r_b"))).drop("r_net", "r_a", "r_b")
    # A free end that the base doesn't know has no precision yet.
    have = blocks.select(F.col("net").alias("h_net"), F.col("station").alias("h_s"))
    for role in "ab":
        there = have.withColumn(f"{role}_known", F.lit(True))
        pairs = pairs.join(there, (F.col("net") == F.col("h_net")) & (F.col(role) == F.col("h_s")), "left").drop("h_net", "h_s")
        pairs = pairs.filter(F.col(f"{role}_known") | F.col(f"{role}_fixed"))
    sides = pairs.select("net", "scenario", "key", F.explode(F.array(F.struct(F.col("a").alias("station"), F.lit(1.0).alias("w")), F.struct(F.col("b").alias("station"), F.lit(-1.0).alias("w")))).alias("s"))
    sides = sides.select("net", "scenario", "key", "s.station", "s.w").join(moves, ["net", "scenario", "station"])
    apart = sides.groupBy("net", "scenario", "key", "k").agg(F.sum(F.col("w") * F.col("zx")).alias("zx"), F.sum(F.col("w") * F.col("zy")).alias("zy"))
    less = apart.groupBy("net", "scenario", "key").agg(F.sum(F.col("zx") ** 2).alias("l_ee"), F.sum(F.col("zy") ** 2).alias("l_nn"), F.sum(F.col("zx") * F.col("zy")).alias("l_en"))
    pairs = pairs.join(less, ["net", "scenario", "key"], "left")
    ee, nn, en = (F.col(f"c_{c}") - F.coalesce(f"l_{c}", F.lit(0.0)) for c in ("ee", "nn", "en"))
    dx, dy = F.col("b_x") - F.col("a_x"), F.col("b_y") - F.col("a_y")
    along = F.sqrt(F.greatest((dx * dx * ee + dy * dy * nn + 2 * dx * dy * en) / (dx * dx + dy * dy), F.lit(0.0)))
    pairs = pairs.withColumn("metric", F.round(F.when((dx != 0) | (dy != 0), along).otherwise(_major(ee, nn, en)), DECIMALS))
    pairs = cut(pairs.select("net", "scenario", "key", "a", "b", "metric"), "scenario-pairs")

    # The ways, one graph for each case.
    name = F.concat_ws("\x1f", F.col("net").cast("string"), "scenario")
    held = [F.col("fixed")] + ([is_finite("sx") | is_finite("sy")] if {"sx", "sy"} <= set(stations.columns) else [])
    rank = F.when(held[0], 2).when(held[-1], 1).otherwise(0)
    anchors = stations.select("net", F.col("station").cast("string").alias("node"), rank.alias("rank")).filter("rank > 0")
    anchors = anchors.withColumn("best", F.max("rank").over(Window.partitionBy("net"))).filter("rank = best").select("net", "node")
    ways = minimax_paths(pairs.filter("metric > 0").select(name.alias("net"), "a", "b", F.col("metric").alias("weight")), cases.join(anchors, "net").select(name.alias("net"), "node"))
    ways = ways.select(F.col("net").alias("w_case"), F.col("node").alias("w_s"), F.round("worst", DECIMALS).alias("worst"), F.round("total", DECIMALS).alias("total"))
    named = stations.select("net", F.col("station").cast("string").alias("station")).distinct()
    out = cases.join(named, "net").join(majors, ["net", "scenario", "station"], "left").withColumn("case", name)
    out = out.join(ways, (F.col("case") == F.col("w_case")) & (F.col("station") == F.col("w_s")), "left").select("net", "scenario", "station", "major", "worst", "total")
    return cut(out, "scenario-stations"), pairs.select("net", "scenario", F.col("key").alias("pair"), "metric")


def _change(now: str, was: str) -> Column:
    """Now less was; without a value before, the value itself; lost, infinite; 0 if there is none."""
    n, w = F.col(now), F.col(was)
    both = F.round(n - w, DECIMALS)
    return F.when(n.isNotNull() & w.isNotNull(), both).when(n.isNotNull(), n).when(w.isNotNull(), float("inf")).otherwise(0.0)


def scored(obs: DataFrame, stations: DataFrame, candidates: DataFrame, target: float | None = None, covariance: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """(base, rows). Base: net and worst_major. Rows: each candidate set's rank in its network with what would change, best first: sets that reach
    ``target``, then by the changes of every station (its ellipse, its way's worst pair, its way's sum), the worst station of the
    base first; then by score, kind and names."""
    covariance = covariances(obs, stations) if covariance is None else covariance
    at, pairs = case_metrics(obs, stations, candidates, covariance)

    weak = lambda values, middle: F.size(F.filter(values, lambda v: v >= WEAK_RATIO * middle))
    whole = at.groupBy("net", "scenario").agg(F.max("major").alias("worst_major"), F.median("major").alias("median_major"), F.collect_list("major").alias("majors"))
    whole = whole.withColumn("weak_stations", weak("majors", F.col("median_major"))).drop("majors")
    links = pairs.filter("metric > 0").groupBy("net", "scenario").agg(F.max("metric").alias("worst_pair"), F.median("metric").alias("middle"), F.collect_list("metric").alias("metrics"))
    links = links.select("net", "scenario", "worst_pair", weak("metrics", F.col("middle")).alias("weak_pairs"))
    whole = whole.join(links, ["net", "scenario"], "left").withColumn("weak_pairs", F.coalesce("weak_pairs", F.lit(0)))
    figures = ["worst_major", "median_major", "worst_pair", "weak_stations", "weak_pairs"]

    base_at = at.filter(F.col("scenario") == BASE).select(F.col("net").alias("b_net"), F.col("station").alias("b_s"), *(F.col(c).alias(f"b_{c}") for c in ("major", "worst", "total")))
    sets = at.filter(F.col("scenario") != BASE)
    sets = sets.join(base_at, (F.col("net") == F.col("b_net")) & (F.col("station") == F.col("b_s")))
    last = lambda c: F.coalesce(-F.col(c), F.lit(float("inf")))
    order = F.struct(last("b_major").alias("m"), last("b_worst").alias("w"), last("b_total").alias("t"), natural_key("station").alias("n"), F.col("station").alias("s"))
    changes = F.struct(_change("major", "b_major").alias("major"), _change("worst", "b_worst").alias("worst"), _change("total", "b_total").alias("total"))
    each = F.transform(F.sort_array(F.collect_list(F.struct(order.alias("o"), changes.alias("c")))), lambda x: x["c"])
    vectors = sets.groupBy("net", "scenario").agg(each.alias("changes"))

    was = whole.filter(F.col("scenario") == BASE).select(F.col("net").alias("b_net"), *(F.col(c).alias(f"b_{c}") for c in figures))
    rows = whole.filter(F.col("scenario") != BASE).join(vectors, ["net", "scenario"]).join(was, F.col("net") == F.col("b_net")).drop("b_net")
    rows = rows.withColumns({f"d_{c}": F.round(F.coalesce(F.col(c) - F.col(f"b_{c}"), F.lit(0.0)), DECIMALS) for c in figures})
    first = lambda part: F.when(F.abs(F.col("changes")[0][part]) < float("inf"), F.col("changes")[0][part]).otherwise(0.0)
    rows = rows.withColumns({"d_path_worst": first("worst"), "d_path_total": first("total")})
    score = sum((weight * F.col(c) for c, weight in SCORE.items()), F.lit(0.0))
    reached = F.coalesce(F.col("worst_major") <= target, F.lit(False)) if target is not None else F.lit(False)
    rows = rows.withColumns({"score": score, "reached": reached})

    given = lambda c: F.min(F.col(c).cast("string")).alias(c) if c in candidates.columns else F.lit(None).cast("string").alias(c)
    about = candidates.groupBy("net", "scenario").agg(*(given(c) for c in ("kind", "occupy", "label")), F.count(F.lit(1)).alias("added"))
    about = about.join(was.select(F.col("b_net").alias("net")), "net", "left_semi")
    rows = about.join(rows, ["net", "scenario"], "left").withColumns({"status": F.when(F.col("score").isNull(), "failed").otherwise("ok"), "reached": F.coalesce("reached", F.lit(False))})
    kind = F.array_position(F.array(*map(F.lit, KINDS)), F.col("kind"))
    best = Window.partitionBy("net").orderBy(
        F.col("score").isNull(), F.col("reached").desc(), F.col("changes").asc_nulls_last(), F.round("score", 6).desc_nulls_last(), kind.asc_nulls_last(),
        natural_key("occupy").asc_nulls_last(), natural_key("label").asc_nulls_last(), natural_key("scenario"), "scenario",
    )
    rows = rows.withColumn("rank", F.row_number().over(best)).drop("median_major", "worst_pair", "weak_stations", "weak_pairs", *(f"b_{c}" for c in figures))
    return was.select(F.col("b_net").alias("net"), F.col("b_worst_major").alias("worst_major")), rows


def recommendations(obs: DataFrame, stations: DataFrame, candidates: DataFrame, target: float | None = None, most: int = RECOMMENDATIONS) -> DataFrame:
    """The ``most`` best candidate sets of each network; fewer or all by ``most``."""
    return scored(obs, stations, candidates, target)[1].filter(F.col("rank") <= most)


def threshold_plan(obs: DataFrame, stations: DataFrame, candidates: DataFrame, target: float, most: int) -> tuple[DataFrame, DataFrame]:
    """(plan, steps) of adding the best set to each network, again and again, until its largest ellipse is at most ``target``, no set is left that
    can be used, or ``most`` sets have been added. All networks take a step together; those that are done take no further part.

    Plan: net, reached, n_steps, worst_major (at the end), remaining (sets), reason (``limit`` or ``exhausted``, null if reached). Steps: net,
    step, scenario, worst_major, reached.
    """
    going = stations.select("net").distinct()
    steps = start = None
    left, taken_rows = candidates, obs
    for step in range(1, most + 1):
        here = taken_rows.join(going, "net", "left_semi")
        offered = left.join(going, "net", "left_semi")
        base, rows = scored(here, stations.join(going, "net", "left_semi"), offered, target)
        if start is None:
            start = cut(base, "plan-base")
            rows = rows.join(start.filter(F.col("worst_major") > target), "net", "left_semi")
        best = cut(rows.filter("rank = 1 and status = 'ok'").select("net", F.lit(step).alias("step"), "scenario", "worst_major", "reached"), "plan-best")
        if best.isEmpty():
            break
        steps = best if steps is None else steps.unionByName(best)
        chosen = best.select("net", "scenario")
        added = left.join(chosen, ["net", "scenario"], "left_semi").select(*obs.columns)
        taken_rows = cut(taken_rows.unionByName(added), "plan-rows")
        left = cut(left.join(chosen, ["net", "scenario"], "left_anti"), "plan-left")
        going = best.filter("not reached").select("net")
    if start is None:
        start = cut(scored(obs, stations, candidates, target)[0], "plan-base")
    if steps is None:
        kind = obs.schema["net"].dataType.simpleString()
        steps = obs.sparkSession.createDataFrame([], f"net {kind}, step int, scenario string, worst_major double, reached boolean")
    done = steps.groupBy("net").agg(F.count(F.lit(1)).alias("n_steps"), F.max_by("worst_major", "step").alias("last"), F.max("reached").alias("met"))
    remaining = left.groupBy("net").agg(F.count_distinct("scenario").alias("remaining"))
    plan = start.join(done, "net", "left").join(remaining, "net", "left")
    met = F.coalesce("met", F.col("worst_major") <= target)
    reason = F.when(~met, F.when(F.coalesce("n_steps", F.lit(0)) >= most, "limit").otherwise("exhausted"))
    n = lambda c: F.coalesce(c, F.lit(0)).cast("int").alias(c)
    plan = plan.select("net", met.alias("reached"), n("n_steps"), F.coalesce("last", "worst_major").alias("worst_major"), n("remaining"), reason.alias("reason"))
    return plan, steps
