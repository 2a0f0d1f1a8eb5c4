"""Precision of adjusted networks: sigmas of observations, relative precision of pairs, datum and control.

A covariance is a table (net, i, j, q) of parameters named ``station:axis``, as ``adjustment.solve_networks`` gives it. Pairs of stations
come from a table of pairs (those observed, or those asked for), not from all stations against all.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.functions.angles import wrap_pi
from plumbline.functions.numbers import is_finite, pair_key

LEAST_SIGMA = 1e-12


def centred_sigma(kind, sigma, source, centre_inst, centre_tgt, centre_vert, d_to, d_from=None, angle=None, horizontal=None, rise=None, slope_mode=None, to_explicit: bool = False) -> Column:
    """Sigma of an observation with the centring of instrument and target added in quadrature.

    ``d_to`` and ``d_from`` are distances to the targets, ``angle`` the angle between them, ``horizontal`` and ``rise`` the parts of a
    sloping line. Explicit sigmas take no centring unless ``to_explicit``; fixed and floating ones and levels never do.
    """
    kind, sigma, source = (F.col(c) if isinstance(c, str) else c for c in (kind, sigma, source))
    flat2 = centre_inst * centre_inst + centre_tgt * centre_tgt
    up2 = centre_vert * centre_vert
    none = F.lit(0.0)
    to = F.coalesce(d_to, none)
    back = F.coalesce(none if d_from is None else d_from, none)
    pointing = F.when(to > 0, flat2 / (to * to)).otherwise(0.0)
    both = flat2 / F.greatest(to, F.lit(LEAST_SIGMA)) ** 2 + flat2 / F.greatest(back, F.lit(LEAST_SIGMA)) ** 2
    turned = F.greatest(both - 2 * flat2 * F.cos(none if angle is None else angle) / (F.greatest(to, F.lit(LEAST_SIGMA)) * F.greatest(back, F.lit(LEAST_SIGMA))), none)
    run, up = to if horizontal is None else horizontal, none if rise is None else rise
    slope2 = F.greatest(run * run + up * up, F.lit(LEAST_SIGMA**2))
    along = (run * run * flat2 + 2 * up * up * up2) / slope2
    across = (up * up * flat2 + 2 * run * run * up2) / slope2 / slope2
    added = (
        F.when(kind == "dist", F.when(F.lit(True) if slope_mode is None else slope_mode, along).otherwise(flat2))
        .when(kind.isin("direction", "bearing", "dir"), pointing)
        .when(kind == "angle", turned)
        .when(kind == "zenith", across)
        .otherwise(0.0)
    )
    free = source.isin("default", "explicit") if to_explicit else source == "default"
    own = F.when(is_finite(sigma), sigma).otherwise(0.0)
    return F.greatest(F.sqrt(own * own + F.when(free, added).otherwise(0.0)), F.lit(LEAST_SIGMA))


def relative_covariance(covariance: DataFrame, pairs: DataFrame) -> DataFrame:
    """(net, from_id, to_id, c_ee, c_nn, c_en) of each pair's difference in plane; a fixed end has no covariance. Pairs with two
    fixed ends are left out."""
    at = lambda p: F.regexp_replace(p, ":[xyh]$", "")
    cells = covariance.select(F.col("net").alias("c_net"), at("i").alias("s"), F.right("i", F.lit(1)).alias("a"), at("j").alias("t"), F.right("j", F.lit(1)).alias("b"), "q").filter("a in ('x', 'y') and b in ('x', 'y')")
    ends = pairs.select("net", "from_id", "to_id").distinct()
    asked = F.array(*(F.struct(F.col(u).cast("string").alias("s"), F.col(v).cast("string").alias("t"), F.lit(w).alias("w")) for u, v, w in (("from_id", "from_id", 1), ("to_id", "to_id", 1), ("from_id", "to_id", -1), ("to_id", "from_id", -1))))
    wanted = ends.select("net", "from_id", "to_id", F.explode(asked).alias("e")).select("net", "from_id", "to_id", F.col("e.s").alias("e_s"), F.col("e.t").alias("e_t"), "e.w")
    joined = wanted.join(cells, (F.col("net") == F.col("c_net")) & (F.col("e_s") == F.col("s")) & (F.col("e_t") == F.col("t")))
    pick = lambda a, b: F.sum(F.when((F.col("a") == a) & (F.col("b") == b), F.col("w") * F.col("q")).otherwise(0.0))
    return joined.groupBy("net", "from_id", "to_id").agg(pick("x", "x").alias("c_ee"), pick("y", "y").alias("c_nn"), pick("x", "y").alias("c_en"))


def relative_precision(covariance: DataFrame, pairs: DataFrame, stations: DataFrame) -> DataFrame:
    """(net, from_id, to_id, sigma_e, sigma_n, sigma_dist, sigma_az) of each pair at the stations' coordinates."""
    rel = relative_covariance(covariance, pairs)
    for role, key in (("f", "from_id"), ("t", "to_id")):
        side = stations.select(F.col("net").alias(f"{role}_net"), F.col("station").alias(f"{role}_s"), F.col("x").alias(f"{role}_x"), F.col("y").alias(f"{role}_y"))
        rel = rel.join(side, (F.col("net") == F.col(f"{role}_net")) & (F.col(key) == F.col(f"{role}_s")))
    de, dn = F.col("t_x") - F.col("f_x"), F.col("t_y") - F.col("f_y")
    d2 = de * de + dn * dn
    root = lambda v: F.sqrt(F.greatest(v, F.lit(0.0)))
    along = (de * de * F.col("c_ee") + dn * dn * F.col("c_nn") + 2 * de * dn * F.col("c_en")) / d2
    across = (dn * dn * F.col("c_ee") + de * de * F.col("c_nn") - 2 * de * dn * F.col("c_en")) / d2 / d2
    return rel.select(
        "net", "from_id", "to_id", root(F.col("c_ee")).alias("sigma_e"), root(F.col("c_nn")).alias("sigma_n"), F.when(d2 > 0, root(along)).alias("sigma_dist"), F.when(d2 > 0, root(across)).alias("sigma_az")
    )


def connected_and_requested(observed: DataFrame, requested: DataFrame) -> DataFrame:
    """(net, pair, connected, requested, types): pairs that observations connect with their kinds, and pairs that are asked for and not
    connected; a pair is the same in both directions."""
    a = observed.groupBy("net", pair_key("from_id", "to_id").alias("pair")).agg(F.array_join(F.sort_array(F.collect_set("type")), ",").alias("types"))
    b = requested.filter("from_id <> to_id").select(F.col("net").alias("r_net"), pair_key("from_id", "to_id").alias("r_pair")).distinct()
    both = a.join(b, (F.col("net") == F.col("r_net")) & (F.col("pair") == F.col("r_pair")), "full_outer")
    return both.select(F.coalesce("net", "r_net").alias("net"), F.coalesce("pair", "r_pair").alias("pair"), F.col("types").isNotNull().alias("connected"), F.col("r_pair").isNotNull().alias("requested"), F.coalesce("types", F.lit("")).alias("types"))


def both_directions(pairs: DataFrame, a: str, b: str) -> DataFrame:
    """Every row twice, with its ends as they are and exchanged, so that a pair is found by either order."""
    turned = F.array(F.struct(F.col(a).alias("u"), F.col(b).alias("v")), F.struct(F.col(b).alias("u"), F.col(a).alias("v")))
    return pairs.withColumn("__e", F.explode(turned)).withColumns({a: F.col("__e.u"), b: F.col("__e.v")}).drop("__e")


def scaled_precision(df: DataFrame, sigmas: list[str], s0: str, confidence: float = 1.0) -> DataFrame:
    """A priori sigmas times the a posteriori standard deviation and a confidence factor."""
    return df.withColumns({c: F.col(c) * F.col(s0) * confidence for c in sigmas})


def datum_sufficiency(obs: DataFrame, stations: DataFrame, is_2d: bool) -> DataFrame:
    """(net, xy_control, h_control, has_distance, has_angle, status): whether control and observations fix a network's place, turn and
    scale. Control is a fixed station, or one with finite sigmas sx, sy (sh). ``fail`` if something is undefined, ``warn`` with fewer than
    two plane controls, else ``ok``. Networks without an observation are those of ``stations`` too."""
    weighted = lambda *cs: F.lit(True) if not cs else is_finite(cs[0]) & weighted(*cs[1:])
    has = lambda c: c in stations.columns
    xy = F.col("fixed") | (weighted("sx", "sy") if has("sx") and has("sy") else F.lit(False))
    h = F.col("fixed") | (weighted("sh") if has("sh") else F.lit(False))
    control = stations.groupBy("net").agg(F.count_if(xy).alias("xy_control"), F.count_if(h).alias("h_control"))
    kinds = obs.groupBy(F.col("net").alias("o_net")).agg(F.bool_or(F.col("type").isin("dist", "gps")).alias("has_distance"), F.bool_or(F.col("type").isin("angle", "bearing", "dir", "direction")).alias("has_angle"))
    rows = control.join(kinds, F.col("net") == F.col("o_net"), "left").na.fill(False, ["has_distance", "has_angle"]).drop("o_net")
    few = F.col("xy_control") < 2
    if is_2d:
        scale = F.col("has_distance") | ~few | ((F.col("xy_control") >= 1) & ~F.col("has_angle"))
        status = F.when(~scale, "fail").when(few, "warn").otherwise("ok")
    else:
        status = F.when((F.col("xy_control") == 0) | (F.col("h_control") == 0), "fail").when(few, "warn").otherwise("ok")
    return rows.withColumn("status", status)


def touched_stations(obs: DataFrame) -> DataFrame:
    """(net, station, horizontal, vertical): whether any observation says something about a station's plane place and its height.
    Columns mode (``slope`` distances) and value_u (vectors with a height) may be absent."""
    slope = F.col("mode").eqNullSafe("slope") if "mode" in obs.columns else F.lit(False)
    up = is_finite("value_u") if "value_u" in obs.columns else F.lit(False)
    flat = ~F.col("type").isin("lev", "zenith")
    tall = F.col("type").isin("lev", "zenith") | ((F.col("type") == "dist") & slope) | ((F.col("type") == "gps") & up)
    ends = F.array_compact(F.array("from_id", "to_id", F.when(F.col("type") == "angle", F.col("at_id"))))
    rows = obs.select("net", flat.alias("flat"), tall.alias("tall"), F.explode(ends).alias("station"))
    return rows.groupBy("net", "station").agg(F.bool_or("flat").alias("horizontal"), F.bool_or("tall").alias("vertical"))


def automatic_holds(stations: DataFrame, obs: DataFrame, is_2d: bool) -> DataFrame:
    """(net, station, hold_xy, hold_h) of free stations that no observation determines in plane or in height."""
    seen = touched_stations(obs).withColumnsRenamed({"net": "__net", "station": "__s"})
    rows = stations.filter(~F.col("fixed")).select("net", "station").join(seen, (F.col("net") == F.col("__net")) & (F.col("station") == F.col("__s")), "left")
    xy, h = ~F.coalesce("horizontal", F.lit(False)), F.lit(False) if is_2d else ~F.coalesce("vertical", F.lit(False))
    return rows.select("net", "station", xy.alias("hold_xy"), h.alias("hold_h")).filter("hold_xy or hold_h")


def control_summary(control: DataFrame) -> DataFrame:
    """(net, n, x, y, h, correlated) of the rows that ``adjustment.control_equations`` gives: how many hold each coordinate, and how many
    stations have x and y correlated."""
    part = lambda k: F.count_if(F.col("part") == k)
    return control.groupBy("net").agg(F.count(F.lit(1)).alias("n"), part(0).alias("x"), part(1).alias("y"), part(2).alias("h"), F.count_if((F.col("part") == 1) & (F.size("terms") > 1)).alias("correlated"))


def correlated_sets(rows: DataFrame, group: str, sigma: str, rho: float) -> DataFrame:
    """(group, n, pairs, diagonal, mean_off_diagonal): weights of equally correlated observations of a set. The inverse of a matrix with
    ones and ``rho`` is closed, so only sums by group are needed: ``diagonal`` is the factor of 1 / sigma^2."""
    rho = min(0.95, max(0.0, rho))
    n, s1, s2 = F.count(F.lit(1)), F.sum(1 / F.col(sigma)), F.sum(1 / (F.col(sigma) * F.col(sigma)))
    out = rows.filter(is_finite(sigma) & (F.col(sigma) > 0)).groupBy(group).agg(n.alias("n"), s1.alias("s1"), s2.alias("s2"))
    b = F.when(F.col("n") > 1, rho / ((1 - rho) * (1 - rho + F.col("n") * rho))).otherwise(0.0)
    pairs = F.col("n") * (F.col("n") - 1) / 2
    # The sum of 1 / (s_i s_j) over pairs, from the sum and the sum of squares.
    off = b * (F.col("s1") * F.col("s1") - F.col("s2")) / 2
    diagonal = F.when(F.col("n") > 1, 1 / (1 - rho) - b).otherwise(1.0)
    return out.select(group, "n", pairs.cast("long").alias("pairs"), diagonal.alias("diagonal"), F.when(pairs > 0, off / pairs).alias("mean_off_diagonal"))


def gps_weights(c_ee, c_nn, c_en) -> dict[str, Column]:
    """Weights of a plane vector from its covariance; of a singular one each component's own."""
    c_ee, c_nn, c_en = (F.col(c) if isinstance(c, str) else c for c in (c_ee, c_nn, c_en))
    det = c_ee * c_nn - c_en * c_en
    good, least = det > 1e-24, F.lit(1e-24)
    own = lambda c: 1 / F.greatest(c, least)
    return {"w_ee": F.when(good, c_nn / det).otherwise(own(c_ee)), "w_nn": F.when(good, c_ee / det).otherwise(own(c_nn)), "w_en": F.when(good, -c_en / det).otherwise(0.0)}


def prefit_directions(obs: DataFrame, by: list[str], reading: str, azimuth: str) -> DataFrame:
    """(by, n, orientation, mean, rms, max_abs): the circular mean of reading less azimuth of each set, and what is left over."""
    turn = F.col(reading) - F.col(azimuth)
    mean = obs.groupBy(*by).agg(F.atan2(F.sum(F.sin(turn)), F.sum(F.cos(turn))).alias("orientation"))
    joined = obs.join(mean, by)
    off = wrap_pi(turn - F.col("orientation"))
    return joined.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), F.first("orientation").alias("orientation"), F.avg(off).alias("mean"), F.sqrt(F.avg(off * off)).alias("rms"), F.max(F.abs(off)).alias("max_abs"))
