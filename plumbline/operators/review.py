"""Review of results: labels, filters, suspects, levels of severity, conflicts of imports, sideshots. Column expressions, grouped
sums and joins by key; lists that a person looks at are bounded top-k."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from plumbline.functions.angles import ARCSEC
from plumbline.functions.numbers import is_finite, natural_key, pair_key, rounded_half_away
from plumbline.functions.text import clean_id
from plumbline.operators.ordered import ordered_scan

ANGULAR = ("angle", "direction", "bearing", "dir", "zenith")
LINKS = ("dist", "gps", "bearing", "dir")


def station_label(sep: str = "-") -> Column:
    """at, from and to of an angle, at and to of a direction, else from and to."""
    return F.when(F.col("type") == "angle", F.concat_ws(sep, "at_id", "from_id", "to_id")).otherwise(F.concat_ws(sep, "from_id", "to_id"))


def search_label() -> Column:
    """What a free-text filter looks at: the stations and, of a direction, its set."""
    return F.when(F.col("type") == "direction", F.concat_ws(" ", "from_id", "to_id", "set_id")).otherwise(station_label(" "))


def report_rows(obs: DataFrame, kind: str | None = None, excluded: DataFrame | None = None, show: str = "all", source: str | None = None, adjusted_only: bool = False, conflicts_only: bool = False, text: str = "") -> DataFrame:
    """Rows of a report: of one type, ``included`` or ``excluded`` by a table of obs_id, of one source (empty: without one), with a
    residual, with |std_res| of 2 or more or a failed local test, and with ``text`` in their labels. Each filter is optional."""
    rows = obs
    if kind is not None:
        rows = rows.filter(F.col("type") == kind)
    if excluded is not None and show != "all":
        rows = rows.join(excluded.select("obs_id").distinct(), "obs_id", "left_anti" if show == "included" else "left_semi")
    if source is not None:
        rows = rows.filter(F.coalesce("source", F.lit("")) == source)
    if adjusted_only:
        rows = rows.filter(F.col("residual").isNotNull())
    if conflicts_only:
        rows = rows.filter((F.coalesce(F.abs("std_res"), F.lit(0.0)) >= 2) | ~F.coalesce("local_pass", F.lit(True)))
    if text:
        rows = rows.filter(F.lower(F.concat_ws(" ", "type", search_label())).contains(text.lower()))
    return rows


def complementary(df: DataFrame, condition: Column) -> tuple[DataFrame, DataFrame]:
    """The rows for which a condition holds, and all others, those where it is null among them."""
    holds = F.coalesce(condition, F.lit(False))
    return df.filter(holds), df.filter(~holds)


def map_links(obs: DataFrame) -> DataFrame:
    """(key, obs_id, type, from_id, to_id, pair) of observations that are drawn as lines."""
    rows = obs.filter(F.col("type").isin(*LINKS))
    return rows.select(F.concat(F.lit("obs-"), "obs_id").alias("key"), "obs_id", "type", "from_id", "to_id", pair_key("from_id", "to_id").alias("pair"))


def suspects(obs: DataFrame, by: list[str], k: int, least: float | None = None) -> DataFrame:
    """The first k rows of each group: failed local tests first, then by |std_res|, then obs_id; with ``least`` only failed rows and
    those of that size."""
    t, fail = F.abs("std_res"), ~F.coalesce("local_pass", F.lit(True))
    rows = obs.filter(is_finite("std_res"))
    rows = rows if least is None else rows.filter(fail | (t >= least))
    w = Window.partitionBy(*by).orderBy(fail.desc(), t.desc(), "obs_id")
    return rows.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)


def removals(obs: DataFrame, by: list[str], threshold: float = 4.0, min_redundancy: float = 0.05, k: int = 1) -> DataFrame:
    """What an automatic adjustment drops next, k rows of each group: failed local tests or |std_res| over ``threshold``, with enough
    redundancy (null counts as infinite); failures first, then by size, redundancy, obs_id."""
    t, fail, r = F.abs("std_res"), ~F.coalesce("local_pass", F.lit(True)), F.coalesce("redundancy", F.lit(float("inf")))
    rows = obs.filter(is_finite("std_res") & (fail | (t >= threshold)) & (r >= min_redundancy))
    w = Window.partitionBy(*by).orderBy(fail.desc(), t.desc(), r.desc(), "obs_id")
    return rows.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k).withColumn("reason", F.when(fail, "local-test").otherwise("std-res"))


def largest_differences(obs: DataFrame, k: int = 25) -> DataFrame:
    """The k observations that differ most from approximate geometry: arc seconds for angles, else the residual's unit."""
    size = F.abs("residual") * F.when(F.col("type").isin(*ANGULAR), F.lit(ARCSEC)).otherwise(1.0)
    rows = obs.filter(is_finite("residual")).select("obs_id", "type", station_label().alias("stations"), size.alias("difference"))
    return rows.orderBy(F.col("difference").desc(), "obs_id").limit(k)


#: Sort keys of a listing by its mode. Values that differ by less than 1e-12 are equal.
LISTING_ORDERS = {
    "input": lambda: [F.col("obs_id")],
    "name": lambda: [natural_key(station_label()), F.col("obs_id")],
    "residual": lambda: [rounded_half_away(F.abs("residual"), 12).desc_nulls_last(), F.col("obs_id")],
    "stdError": lambda: [rounded_half_away("sigma", 12).desc_nulls_last(), F.col("obs_id")],
    "stdResidual": lambda: [rounded_half_away(F.abs("std_res"), 12).desc_nulls_last(), F.col("obs_id")],
}


def impact_scores(base: DataFrame, without: DataFrame) -> DataFrame:
    """(net, obs_id, delta_s0, delta_max, shift, score) of scenarios that leave one observation out. ``base``: net, s0, max_std_res, chi_pass;
    ``without``: net, obs_id, s0, max_std_res, chi_pass, shift. Less s0, smaller residuals and a global test that comes to pass are good,
    moved coordinates are bad."""
    b = base.select(F.col("net").alias("b_net"), F.col("s0").alias("b_s0"), F.col("max_std_res").alias("b_max"), F.col("chi_pass").alias("b_pass"))
    rows = without.join(b, F.col("net") == F.col("b_net"))
    ds, dm = F.col("s0") - F.col("b_s0"), F.col("max_std_res") - F.col("b_max")
    chi = F.when(~F.col("b_pass") & F.col("chi_pass"), 20).when(F.col("b_pass") & ~F.col("chi_pass"), -20).otherwise(0)
    return rows.select("net", "obs_id", ds.alias("delta_s0"), dm.alias("delta_max"), "shift", (-40 * ds - 20 * dm - 15 * F.col("shift") + chi).alias("score"))


def traverse_severity(loops: DataFrame, min_ratio: float, max_ppm: float, max_arcsec: float, max_vertical: float) -> DataFrame:
    """``loops`` (loop, de, dn, distance, angle_arcsec, vertical; the last two may be null) with misclosure, closure_ratio, linear_ppm,
    severity and pass. What goes over a limit counts by how many times it does, 70 for length and 35 for angle and height."""
    size, d = F.sqrt(F.col("de") * F.col("de") + F.col("dn") * F.col("dn")), F.col("distance")
    ratio, ppm = F.when(size > 1e-12, d / size), F.when(d > 1e-12, size / d * 1e6)
    ang, vert = F.abs("angle_arcsec"), F.abs("vertical")
    over = lambda weight, excess: F.when(excess > 0, excess * weight).otherwise(0.0)
    severity = (
        over(70, F.when(ratio < min_ratio, min_ratio / F.greatest(ratio, F.lit(1.0)) - 1))
        + over(70, ppm / max_ppm - 1)
        + over(35, ang / max_arcsec - 1)
        + over(35, vert / max_vertical - 1)
        + F.least(size * 10, F.lit(25.0))
    )
    good = F.coalesce(ratio >= min_ratio, F.lit(False)) & F.coalesce(ppm <= max_ppm, F.lit(False)) & F.coalesce(ang <= max_arcsec, F.lit(True)) & F.coalesce(vert <= max_vertical, F.lit(True))
    return loops.withColumns({"misclosure": size, "closure_ratio": ratio, "linear_ppm": ppm, "severity": severity, "pass": good})


def segment_suspects(segments: DataFrame) -> DataFrame:
    """(segment, loops, score, max_dh, worst_loop) of the segments of failing loops: the loops' severities add up. ``segments``: loop,
    segment, dh, severity, pass."""
    bad = segments.filter("not pass")
    return bad.groupBy("segment").agg(F.count(F.lit(1)).alias("loops"), F.sum("severity").alias("score"), F.max(F.abs("dh")).alias("max_dh"), F.min_by("loop", F.struct(-F.col("severity"), F.col("loop"))).alias("worst_loop"))


def cluster_summary(members: DataFrame, pairs: DataFrame) -> DataFrame:
    """(cluster, n, x, y, fixed, free, max_separation, mean_separation) of clusters of stations. ``members``: cluster, x, y, fixed;
    ``pairs``: cluster, dist."""
    m = members.groupBy("cluster").agg(F.count(F.lit(1)).alias("n"), F.avg("x").alias("x"), F.avg("y").alias("y"), F.bool_or("fixed").alias("fixed"), F.bool_or(~F.col("fixed")).alias("free"))
    p = pairs.groupBy(F.col("cluster").alias("__c")).agg(F.max("dist").alias("max_separation"), F.avg("dist").alias("mean_separation"))
    return m.join(p, F.col("cluster") == F.col("__c"), "left").drop("__c").na.fill(0.0, ["max_separation", "mean_separation"])


def station_lines(obs: DataFrame, lines: str) -> DataFrame:
    """(station, n, ids, lines) of every station: its observations' ids and different source lines, each sorted, as text."""
    ends = obs.select("obs_id", F.col(lines).alias("line"), F.explode(F.array_distinct(F.array("from_id", "to_id"))).alias("station"))
    return ends.groupBy("station").agg(F.count_distinct("obs_id").alias("n"), F.min("obs_id").alias("first_obs"), F.array_join(F.transform(F.sort_array(F.collect_set("line")), lambda x: x.cast("string")), ",").alias("lines"))


def import_conflicts(existing: DataFrame, incoming: DataFrame, tolerance: float) -> DataFrame:
    """(id, kind) of incoming stations that are there already, ``collision``, and whose coordinates differ by more than ``tolerance`` in
    any component, ``coordinates``. Identifiers are compared trimmed and in capitals."""
    e = existing.select(clean_id("id").alias("e_id"), *(F.col(c).alias(f"e_{c}") for c in "xyh")).dropDuplicates(["e_id"])
    both = incoming.select(clean_id("id").alias("id"), "x", "y", "h").join(e, F.col("id") == F.col("e_id"))
    differ = reduce(lambda a, b: a | b, (F.coalesce(F.abs(F.col(c) - F.col(f"e_{c}")) > tolerance, F.lit(False)) for c in "xyh"))
    kinds = F.array_compact(F.array(F.lit("collision"), F.when(differ, F.lit("coordinates"))))
    return both.select("id", F.explode(kinds).alias("kind"))


def repeated_families(existing: DataFrame, incoming: DataFrame, keys: list[str]) -> DataFrame:
    """Incoming rows whose keys are there already, with how often."""
    counts = existing.groupBy(*keys).agg(F.count(F.lit(1)).alias("existing"))
    return incoming.join(counts, keys)


def sideshots(obs: DataFrame, stations: DataFrame) -> DataFrame:
    """(net, obs_id, to_id, x, y, h, sigma_h_dist, sigma_dh) of distances shot aside: each with the zenith angle or height difference of
    the same ends and line, the last by obs_id if there are several. ``obs``: net, obs_id, type (dist, zenith, lev), from_id, to_id, line,
    value, sigma, azimuth, mode (``slope`` or not). A sloping distance without a zenith angle counts as level and has no height."""
    keys = ["net", "from_id", "to_id", "line"]
    up = obs.filter(F.col("type").isin("zenith", "lev")).groupBy(*keys).agg(F.max_by(F.struct("type", "value", "sigma"), "obs_id").alias("v"))
    rows = obs.filter("type = 'dist'").join(up, keys, "left")
    at = stations.select(F.col("net").alias("s_net"), F.col("station").alias("s"), F.col("x").alias("sx"), F.col("y").alias("sy"), F.col("h").alias("sh"))
    rows = rows.join(at, (F.col("net") == F.col("s_net")) & (F.col("from_id") == F.col("s")))
    slope = F.col("mode").eqNullSafe("slope")
    zen, lev = slope & F.col("v.type").eqNullSafe("zenith"), ~slope & F.col("v.type").eqNullSafe("lev")
    d, s, z, sz = F.col("value"), F.col("sigma"), F.col("v.value"), F.col("v.sigma")
    flat = F.when(zen, d * F.sin(z)).otherwise(d)
    dh = F.when(zen, d * F.cos(z)).when(lev, z)
    s_flat = F.when(zen, F.hypot(F.sin(z) * s, d * F.cos(z) * sz)).otherwise(s)
    s_dh = F.when(zen, F.hypot(F.cos(z) * s, d * F.sin(z) * sz)).when(lev, sz)
    az = F.col("azimuth")
    return rows.select(
        "net", "obs_id", "to_id", (F.col("sx") + flat * F.sin(az)).alias("x"), (F.col("sy") + flat * F.cos(az)).alias("y"), (F.col("sh") + dh).alias("h"), s_flat.alias("sigma_dist"), s_dh.alias("sigma_dh")
    )


def sideshot_candidates(obs: DataFrame, threshold: float) -> DataFrame:
    """(line, at_id, to_id, min_redundancy) of angles and distances on one line to one target that little else checks."""
    a = obs.filter("type = 'angle'").groupBy("line").agg(F.max_by(F.struct("at_id", "to_id", "redundancy"), "obs_id").alias("a"))
    d = obs.filter("type = 'dist'").groupBy(F.col("line").alias("d_line")).agg(F.max_by(F.struct("from_id", "to_id", "redundancy"), "obs_id").alias("d"))
    rows = a.join(d, F.col("line") == F.col("d_line")).filter("a.at_id = d.from_id and a.to_id = d.to_id")
    least = F.least(F.coalesce("a.redundancy", F.lit(0.0)), F.coalesce("d.redundancy", F.lit(0.0)))
    return rows.select("line", "a.at_id", "a.to_id", least.alias("min_redundancy")).filter(F.col("min_redundancy") < threshold)


def with_missing_zeniths(obs: DataFrame, sigma: float) -> DataFrame:
    """``obs`` and a made-up zenith row for every sloping distance of ends and line that have none."""
    keys = ["net", "from_id", "to_id", "line"]
    have = obs.filter("type = 'zenith'").select(*keys).distinct()
    lone = obs.filter((F.col("type") == "dist") & F.col("mode").eqNullSafe("slope")).join(have, keys, "left_anti")
    made = lone.withColumns({"type": F.lit("zenith"), "value": F.lit(None).cast("double"), "sigma": F.lit(sigma)})
    return obs.withColumn("made", F.lit(False)).unionByName(made.withColumn("made", F.lit(True)))


def size_batches(df: DataFrame, by: list[str], order: list[str], size: str, most: int) -> DataFrame:
    """``by``, ``order`` and the batch number of every row: rows in an order are put together as long as a batch stays within ``most``; a
    row that is larger alone is a batch of its own. A null size is 0."""

    def step(state, row):
        batch, filled = state
        n = row[-1] or 0
        if filled and filled + n > most:
            batch, filled = batch + 1, 0
        return (batch, filled + n), (*row[:-1], batch)

    schema = ", ".join([*(f"{c} {df.schema[c].dataType.simpleString()}" for c in (*by, *order)), "batch int"])
    return ordered_scan(df, by, [F.col(c) for c in order], [*order, size], lambda: (0, 0), step, schema)


def stratified(df: DataFrame, strata: list[str], key: str, k: int) -> DataFrame:
    """k rows of each stratum, the same at every run: those of least hash."""
    w = Window.partitionBy(*strata).orderBy(F.md5(F.col(key).cast("string")), key)
    return df.withColumn("__n", F.row_number().over(w)).filter(F.col("__n") <= k).drop("__n")


def resolve_names(tokens: DataFrame, names: list[str], aliases: dict[str, str]) -> DataFrame:
    """(token, name, state, candidates) of directive tokens: an alias, a name, a prefix of one name only, else ``ambiguous`` or ``unknown``.
    Leading dots and slashes, blanks and case don't matter."""
    spark = tokens.sparkSession
    t = tokens.select("token", F.trim(F.regexp_replace(F.upper(F.trim("token")), r"^[./]+", "")).alias("t"))
    table = spark.createDataFrame([(n,) for n in names], "name string")  # a fixed list
    other = spark.createDataFrame([(k, v) for k, v in aliases.items()] or [("", "")], "alias string, means string")
    hit = t.select("t").distinct().join(F.broadcast(table), (F.col("t") != "") & F.col("name").startswith(F.col("t")))
    found = hit.groupBy(F.col("t").alias("h")).agg(F.sort_array(F.collect_list("name")).alias("names"))
    rows = t.join(F.broadcast(other), (F.col("t") == F.col("alias")) & (F.col("t") != ""), "left").join(found, F.col("t") == F.col("h"), "left")
    whole = F.array_contains("names", F.col("t"))
    name = F.when(F.col("means").isNotNull(), F.col("means")).when(whole, F.col("t")).when(F.size("names") == 1, F.col("names")[0])
    state = F.when(F.col("means").isNotNull(), "alias").when(whole, "name").when(F.size("names") == 1, "prefix").when(F.size("names") > 1, "ambiguous").otherwise("unknown")
    return rows.select("token", name.alias("name"), state.alias("state"), F.when(state == "ambiguous", F.array_join("names", ",")).otherwise("").alias("candidates"))


#: Tolerances of levelling loops by name, in millimetres: constant, and to the root of the length in kilometres.
LEVEL_TOLERANCES = {"default": (0, 4), "tight": (0, 3), "balanced": (1, 5), "relaxed": (2, 8)}


def tolerance_name(base_mm, per_sqrt_km_mm) -> Column:
    """The name of a tolerance, ``custom`` for any other."""
    out = F.lit("custom")
    for name, (base, per) in LEVEL_TOLERANCES.items():
        out = F.when((F.abs(base_mm - base) <= 1e-9) & (F.abs(per_sqrt_km_mm - per) <= 1e-9), name).otherwise(out)
    return out


def direction_repeatability(obs: DataFrame, reduced: str) -> DataFrame:
    """(at_id, to_id, sets, spread, rms, score) of every target over the sets of its station: how far its reduced directions differ from their mean.
    Directions of a target lie close together, so plain means serve after turning them to the first."""
    from plumbline.functions.angles import wrap_pi

    first = obs.groupBy("at_id", "to_id").agg(F.min(F.struct("set_id", F.col(reduced).alias("r")))["r"].alias("first"))
    rows = obs.join(first, ["at_id", "to_id"]).withColumn("d", wrap_pi(F.col(reduced) - F.col("first")))
    out = rows.groupBy("at_id", "to_id").agg(F.count_distinct("set_id").alias("sets"), (F.max("d") - F.min("d")).alias("spread"), F.stddev_pop("d").alias("rms"))
    return out.filter("sets >= 2").withColumn("score", F.col("spread") * ARCSEC + 2 * F.col("rms") * ARCSEC)


def default_sigmas(obs: DataFrame, instruments: DataFrame) -> DataFrame:
    """``obs`` with sigma and its source: its own, else the default of its instrument by type (dist: constant and ppm part; angles: hz_sigma),
    else null. ``instruments``: inst, edm_const, edm_ppm, hz_sigma."""
    i = instruments.select(F.col("inst").alias("__inst"), "edm_const", "edm_ppm", "hz_sigma")
    rows = obs.join(i, F.col("inst") == F.col("__inst"), "left")
    own = F.when(F.col("type") == "dist", F.col("edm_const") + F.abs("value") * F.col("edm_ppm") * 1e-6).when(F.col("type").isin(*ANGULAR), F.col("hz_sigma"))
    source = F.when(F.col("sigma").isNotNull(), "explicit").when(own.isNotNull(), "default")
    return rows.withColumns({"source": source, "sigma": F.coalesce("sigma", own)}).drop("__inst", "edm_const", "edm_ppm", "hz_sigma")


def decision_counts(clusters: DataFrame, decisions: DataFrame) -> DataFrame:
    """One row (candidates, approved, rejected, pending) of clusters and the decisions on them; a later decision counts."""
    last = decisions.groupBy(F.col("cluster").alias("__c")).agg(F.max_by("decision", "at").alias("decision"))
    rows = clusters.select("cluster").distinct().join(last, F.col("cluster") == F.col("__c"), "left")
    return rows.agg(F.count(F.lit(1)).alias("candidates"), F.count_if(F.col("decision") == "approve").alias("approved"), F.count_if(F.col("decision") == "reject").alias("rejected"), F.count_if(F.col("decision").isNull()).alias("pending"))
