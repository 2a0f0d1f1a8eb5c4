"""Least-squares adjustment of measurement networks, many at once.

Observations become equation rows by expressions over joined stations; normal equations are one grouped sum over
(net, i, j) with map-side partial sums; each network's small dense system is solved in the task that has it. The
Gauss-Newton loop runs on the driver and sees one number a round. Coordinates between rounds are written to the shared
folder. A network's matrix is square in its own unknowns only, so size grows with networks, not with all rows.

Observations: net, obs_id, type, from_id, to_id, at_id, value, value_n, sigma. Types: ``dist``, ``bearing``, ``angle`` (at_id, from
from_id to to_id), ``gps`` (value east, value_n north), ``lev``, ``direction`` (from_id to to_id, read on a circle whose
orientation is one more unknown for each set_id), ``dir`` (a bearing; with flip180 the other face counts where it is closer)
and ``zenith`` (with hi and ht). The columns set_id, flip180, hi and ht may be absent or null: then a station's directions are one
set, and the others are false or 0. A ``gps`` row may have value_u (up), sigma_n, sigma_u and the correlations corr_en, corr_eu and
corr_nu; where they are absent or null, north and up are as good as east, nothing is correlated, and without value_u the
row is a plane vector. Observations are made on the ground and stations lie in the plane of a grid; what lies between them may be given by line: ``scale``, grid over
ground distance, ``convergence``, by which grid azimuths are less than the bearings read, ``prism``, added to distances, ``mode``, where ``slope`` is a distance between
instrument and target, and ``refraction``, the coefficient with which zeniths are lowered by the earth's curvature less refraction. Absent or null they are 1, 0, 0, a plane
distance, and no curvature. Stations: net, station, x, y, h, fixed (both plane and height), and for weighted control sx, sy, sh with
the coordinates held as target_x, target_y, target_h (default: those given) and corr_xy. Rows with a missing end, value or positive
sigma are left out; a row of another type is an error.

Correlated components become independent rows: each is reduced by what those before it say about it (the Cholesky factor of
their covariance), which gives the same normal equations as the full weight matrix.

A network whose equations don't determine it, not even with something added to the diagonal, is left as it is and marked.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from plumbline.functions.angles import curvature_refraction, wrap_pi
from plumbline.functions.numbers import clip, huber_weight, is_finite
from plumbline.tables import by_groups, cut, group_starts, spread


def _at(stations: DataFrame, role: str) -> DataFrame:
    s = stations.select("net", "station", "x", "y", "h", "fixed")
    return s.select(F.col("net").alias(f"{role}_net"), F.col("station").alias(f"{role}_s"), *(F.col(c).alias(f"{role}_{c}") for c in ("x", "y", "h")), F.col("fixed").alias(f"{role}_fixed"))


def with_ends(obs: DataFrame, stations: DataFrame) -> DataFrame:
    """``obs`` with the coordinates of from, to and, for angles, at."""
    good = is_finite("value") & is_finite("sigma") & (F.col("sigma") > 0)
    out = obs.filter(good)
    for role, key, how in (("f", "from_id", "inner"), ("t", "to_id", "inner"), ("a", "at_id", "left")):
        side = _at(stations, role)
        out = out.join(side, (F.col("net") == F.col(f"{role}_net")) & (F.col(key) == F.col(f"{role}_s")), how)
    return out.filter(~F.col("type").eqNullSafe("angle") | F.col("a_x").isNotNull())


def _term(role: str, axis: str, value: Column, only: Column | None = None) -> Column:
    """A coefficient; null at a fixed station, so that it falls out."""
    name = F.concat_ws(":", F.col(f"{role}_s").cast("string"), F.lit(axis))
    free = ~F.col(f"{role}_fixed")
    return F.when(free if only is None else free & only, F.struct(name.alias("p"), value.alias("a")))


@dataclass
class Reduced:
    """Independent parts of up to three correlated components: of each its sigma and the shares of the components before it."""

    sigma: list[Column]
    shares: list[list[Column]]


def reduced(sigmas: list[Column], corr: dict[tuple[int, int], Column]) -> Reduced:
    """From sigmas and correlations (held within 0.999), by the Cholesky factor L of the covariance: component i less its shares
    of the components before has sigma L[i][i]."""
    n = len(sigmas)
    low: list[list[Column]] = [[F.lit(0.0)] * n for _ in range(n)]
    for i in range(n):
        for j in range(i + 1):
            c = sigmas[i] * sigmas[j] * (1.0 if i == j else clip(corr[j, i], -0.999, 0.999))
            rest = c - sum((low[i][k] * low[j][k] for k in range(j)), F.lit(0.0))
            low[i][j] = F.sqrt(F.greatest(rest, F.lit(1e-24))) if i == j else rest / low[j][j]
    shares = []
    for i in range(n):
        own = [F.lit(0.0)] * i  # solves share * L = row i of L, from the last component back
        for j in reversed(range(i)):
            own[j] = (low[i][j] - sum((own[k] * low[k][j] for k in range(j + 1, i)), F.lit(0.0))) / low[j][j]
        shares.append(own)
    return Reduced([low[i][i] for i in range(n)], shares)


KINDS = ("dist", "bearing", "angle", "gps", "lev", "direction", "dir", "zenith")


def _optional(df: DataFrame, name: str, kind: str, default) -> Column:
    return F.coalesce(F.col(name).cast(kind), default) if name in df.columns else default


def _set_name(rows: DataFrame) -> Column:
    """The name of a direction's set as an unknown."""
    own = F.concat(F.lit("at "), F.col("from_id").cast("string"))
    given = F.concat(F.lit("set "), F.col("set_id").cast("string")) if "set_id" in rows.columns else own
    return F.concat(F.coalesce(given, own), F.lit(":o"))


def orientations(obs: DataFrame, stations: DataFrame) -> DataFrame:
    """(o_net, o_p, o): each direction set's orientation, the mean direction of readings less azimuths."""
    rows = with_ends(obs.filter("type = 'direction'"), stations)
    turn, w = F.col("value") - F.atan2(F.col("t_x") - F.col("f_x"), F.col("t_y") - F.col("f_y")), 1 / (F.col("sigma") * F.col("sigma"))
    return rows.groupBy(F.col("net").alias("o_net"), _set_name(rows).alias("o_p")).agg(F.atan2(F.sum(w * F.sin(turn)), F.sum(w * F.cos(turn))).alias("o"))


def equations(obs: DataFrame, stations: DataFrame, turned: DataFrame | None = None) -> DataFrame:
    """(net, obs_id, part, type, terms, misclosure, sigma): linearised rows, observed less computed. Angles in radians. ``turned``
    has the orientations of direction sets; without it they are the mean ones."""
    rows = with_ends(obs, stations)
    rows = rows.withColumn("o_name", F.when(F.col("type") == "direction", _set_name(rows)))
    turned = orientations(obs, stations) if turned is None else turned
    rows = rows.join(turned, (F.col("net") == F.col("o_net")) & (F.col("o_name") == F.col("o_p")), "left")
    dx, dy = F.col("t_x") - F.col("f_x"), F.col("t_y") - F.col("f_y")
    d = F.greatest(F.hypot(dx, dy), F.lit(1e-9))
    scale, prism = _optional(rows, "scale", "double", F.lit(1.0)), _optional(rows, "prism", "double", F.lit(0.0))
    converged = _optional(rows, "convergence", "double", F.lit(0.0))
    slope = _optional(rows, "mode", "string", F.lit("")) == "slope"
    bend = F.coalesce(curvature_refraction(F.lit(1.0), _optional(rows, "refraction", "double", F.lit(None).cast("double"))), F.lit(0.0))
    fx, fy, tx, ty = (F.col(f"{r}_{c}") for r in "ft" for c in "xy")
    ax, ay = F.col("a_x"), F.col("a_y")
    df2, dt2 = F.greatest((fx - ax) ** 2 + (fy - ay) ** 2, F.lit(1e-18)), F.greatest((tx - ax) ** 2 + (ty - ay) ** 2, F.lit(1e-18))
    az = F.atan2(dx, dy) + converged
    angle = F.atan2(tx - ax, ty - ay) - F.atan2(fx - ax, fy - ay)
    gx_t, gy_t = (ty - ay) / dt2, -(tx - ax) / dt2
    gx_f, gy_f = -(fy - ay) / df2, (fx - ax) / df2

    half_turn = F.when(_optional(rows, "flip180", "boolean", F.lit(False)) & (F.abs(wrap_pi(F.col("value") + math.pi - az)) < F.abs(wrap_pi(F.col("value") - az))), math.pi).otherwise(0.0)
    turn = F.struct(F.col("o_name").alias("p"), F.lit(1.0).alias("a"))
    dh = F.col("t_h") + _optional(rows, "ht", "double", F.lit(0.0)) - F.col("f_h") - _optional(rows, "hi", "double", F.lit(0.0))
    # On the ground: the plane's distance over the scale, and how it changes with east and north.
    flat = F.hypot(dx, dy) / scale
    gx, gy = dx / (d * scale), dy / (d * scale)
    slope2 = F.greatest(flat**2 + dh**2, F.lit(1e-18))
    zx, zy, zh = (dh / slope2 + bend) * gx, (dh / slope2 + bend) * gy, -flat / slope2
    s3 = F.sqrt(slope2)
    sx, sy, sh = flat * gx / s3, flat * gy / s3, dh / s3

    def row(kind, part, misclosure, *terms, sigma=F.col("sigma"), only=F.lit(True)):
        return F.when((F.col("type") == kind) & only, F.struct(F.lit(part).alias("part"), misclosure.alias("misclosure"), sigma.alias("sigma"), F.array_compact(F.array(*terms)).alias("terms")))

    v = F.col("value")
    none = F.lit(0.0)
    up = _optional(rows, "value_u", "double", F.lit(None).cast("double"))
    gps = reduced(
        [F.col("sigma"), _optional(rows, "sigma_n", "double", F.col("sigma")), _optional(rows, "sigma_u", "double", F.col("sigma"))],
        {(0, 1): _optional(rows, "corr_en", "double", none), (0, 2): _optional(rows, "corr_eu", "double", none), (1, 2): _optional(rows, "corr_nu", "double", none)},
    )
    parts = [("x", v - dx), ("y", F.col("value_n") - dy), ("h", up - (F.col("t_h") - F.col("f_h")))]

    def vector(i):
        """Component i of a vector less its shares of those before."""
        shares = [*(-s for s in gps.shares[i]), F.lit(1.0)]
        terms = [_term(r, parts[k][0], w if r == "t" else -w, w != 0) for k, w in enumerate(shares) for r in "ft"]
        return row("gps", i, sum((w * parts[k][1] for k, w in enumerate(shares)), none), *terms, sigma=gps.sigma[i], only=up.isNotNull() if i == 2 else F.lit(True))

    made = F.array_compact(
        F.array(
            row("dist", 0, v + prism - flat, _term("f", "x", -gx), _term("f", "y", -gy), _term("t", "x", gx), _term("t", "y", gy), only=~slope),
            row("dist", 0, v + prism - s3, _term("f", "x", -sx), _term("f", "y", -sy), _term("f", "h", -sh), _term("t", "x", sx), _term("t", "y", sy), _term("t", "h", sh), only=slope),
            row("bearing", 0, wrap_pi(v - az), _term("f", "x", -dy / d**2), _term("f", "y", dx / d**2), _term("t", "x", dy / d**2), _term("t", "y", -dx / d**2)),
            row("angle", 0, wrap_pi(v - angle), _term("t", "x", gx_t), _term("t", "y", gy_t), _term("f", "x", gx_f), _term("f", "y", gy_f), _term("a", "x", -(gx_t + gx_f)), _term("a", "y", -(gy_t + gy_f))),
            *(vector(i) for i in range(3)),
            row("lev", 0, v - (F.col("t_h") - F.col("f_h")), _term("f", "h", F.lit(-1.0)), _term("t", "h", F.lit(1.0))),
            row("direction", 0, wrap_pi(v - az - F.col("o")), _term("f", "x", -dy / d**2), _term("f", "y", dx / d**2), _term("t", "x", dy / d**2), _term("t", "y", -dx / d**2), turn),
            row("dir", 0, wrap_pi(v + half_turn - az), _term("f", "x", -dy / d**2), _term("f", "y", dx / d**2), _term("t", "x", dy / d**2), _term("t", "y", -dx / d**2)),
            row("zenith", 0, v - F.atan2(flat, dh) - bend * flat, _term("f", "x", -zx), _term("f", "y", -zy), _term("f", "h", -zh), _term("t", "x", zx), _term("t", "y", zy), _term("t", "h", zh)),
        )
    )
    unknown = F.raise_error(F.concat(F.lit("unknown type of observation: "), F.coalesce("type", F.lit("null"))))
    made = F.when(F.coalesce(F.col("type").isin(*KINDS), F.lit(False)), made).otherwise(unknown)
    out = rows.select("net", "obs_id", "type", F.explode(made).alias("r")).select("net", "obs_id", "r.part", "type", "r.terms", "r.misclosure", "r.sigma")
    control = control_equations(stations, out.schema["obs_id"].dataType)
    return out if control is None else out.unionByName(control)


def control_equations(stations: DataFrame, id_type) -> DataFrame | None:
    """Equation rows of type ``control`` that hold free stations to their targets; None for stations without the column sx. A station
    may be held in any of x, y and h; x and y may be correlated."""
    if "sx" not in stations.columns:
        return None
    given = lambda c, other: F.coalesce(F.col(c), F.col(other)) if c in stations.columns else F.col(other)
    held = lambda s: is_finite(s) & (F.col(s) > 0)
    both = held("sx") & held("sy")
    corr = F.when(both, _optional(stations, "corr_xy", "double", F.lit(0.0))).otherwise(0.0)
    xy = reduced([F.coalesce("sx", F.lit(1.0)), F.coalesce("sy", F.lit(1.0))], {(0, 1): corr})
    off = {a: given(f"target_{a}", a) - F.col(a) for a in "xyh"}
    term = lambda a, w: F.when(w != 0, F.struct(F.concat_ws(":", F.col("station").cast("string"), F.lit(a)).alias("p"), w.alias("a")))

    def row(part, on, misclosure, sigma, *terms):
        return F.when(on, F.struct(F.lit(part).alias("part"), misclosure.alias("misclosure"), sigma.alias("sigma"), F.array_compact(F.array(*terms)).alias("terms")))

    share = F.when(both, xy.shares[1][0]).otherwise(0.0)
    made = F.array_compact(
        F.array(
            row(0, held("sx"), off["x"], F.col("sx"), term("x", F.lit(1.0))),
            row(1, held("sy"), off["y"] - share * off["x"], F.when(both, xy.sigma[1]).otherwise(F.col("sy")), term("y", F.lit(1.0)), term("x", -share)),
            row(2, held("sh"), off["h"], F.col("sh"), term("h", F.lit(1.0))),
        )
    )
    # An identifier below all others, so that it stands apart from those of observations; numbers count a network's held stations.
    number = -F.row_number().over(Window.partitionBy("net").orderBy("station"))
    name = F.concat(F.lit("control "), F.col("station").cast("string")) if id_type.simpleString() == "string" else number
    rows = stations.filter(~F.col("fixed")).withColumn("__made", made).filter(F.size("__made") > 0).withColumn("__name", name.cast(id_type))
    rows = rows.select("net", F.col("__name").alias("obs_id"), F.lit("control").alias("type"), F.explode("__made").alias("r"))
    return rows.select("net", "obs_id", "r.part", "type", "r.terms", "r.misclosure", "r.sigma")


def whitened_sets(rows: DataFrame, members: DataFrame, rho: float) -> DataFrame:
    """``rows`` whose ``members`` (net, obs_id, set) of one set are all correlated by ``rho`` as independent rows of sigma 1: they give the normal equations
    and the sum of squares of the full weight matrix. Other rows stay as they are.

    The inverse of an equal correlation has a root of the form a (I - b J), J all ones: a row is scaled, and b times its set's sum is taken off. So a set needs
    sums by unknown, not its matrix. Rows of a set then hold the unknowns of all of it.
    """
    if not 0 <= rho < 1:
        raise ValueError("a correlation is at least 0 and less than 1")
    of = members.filter("set is not null").select(F.col("net").alias("s_net"), F.col("obs_id").alias("s_id"), F.col("set").cast("string").alias("s_set"))
    # Read three times: as they are, and for the sums of misclosures and of coefficients.
    rows = cut(rows.join(of, (F.col("net") == F.col("s_net")) & (F.col("obs_id") == F.col("s_id")), "left").drop("s_net", "s_id"), "whitened-rows")
    own = rows.filter("s_set is not null")
    by = lambda df: df.groupBy(F.col("net").alias("g_net"), F.col("s_set").alias("g_set"))
    whole = by(own).agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("misclosure") / F.col("sigma")).alias("m_sum"))
    # The sum of the misclosures goes along with those of the coefficients; a set of rows without a term has none.
    parts = own.select("net", "s_set", "sigma", F.explode("terms").alias("t")).groupBy("net", "s_set", F.col("t.p").alias("p")).agg(F.sum(F.col("t.a") / F.col("sigma")).alias("a"))
    sums = parts.groupBy(F.col("net").alias("t_net"), F.col("s_set").alias("t_set")).agg(F.collect_list(F.struct("p", "a")).alias("a_sums"))
    whole = whole.join(sums, (F.col("g_net") == F.col("t_net")) & (F.col("g_set") == F.col("t_set")), "left").drop("t_net", "t_set")
    rows = rows.join(whole, (F.col("net") == F.col("g_net")) & (F.col("s_set") == F.col("g_set")), "left")
    a = 1 / math.sqrt(1 - rho)
    b = (1 - F.sqrt((1 - rho) / (1 - rho + F.col("n") * rho))) / F.col("n")
    term = lambda p, v: F.struct(p.alias("p"), v.alias("a"))
    scaled = F.transform("terms", lambda t: term(t["p"], t["a"] * a / F.col("sigma")))
    taken = F.transform(F.coalesce("a_sums", F.array().cast("array<struct<p:string,a:double>>")), lambda t: term(t["p"], -a * b * t["a"]))
    inside = F.col("n").isNotNull()
    return rows.select(
        "net", "obs_id", "part", "type", F.when(inside, F.concat(scaled, taken)).otherwise(F.col("terms")).alias("terms"),
        F.when(inside, a * (F.col("misclosure") / F.col("sigma") - b * F.col("m_sum"))).otherwise(F.col("misclosure")).alias("misclosure"), F.when(inside, 1.0).otherwise(F.col("sigma")).alias("sigma"),
    )


def normal_equations(rows: DataFrame, weight: Column | None = None) -> DataFrame:
    """(net, i, j, value) of A'PA, with j null for A'PL: one grouped sum over pairs of coefficients within a row. Only one triangle
    is summed up, then mirrored."""
    w = 1 / (F.col("sigma") * F.col("sigma")) if weight is None else weight
    pair = lambda s, t: F.struct(s["p"].alias("i"), t["p"].alias("j"), (s["a"] * t["a"]).alias("v"))
    pairs = F.flatten(F.transform("terms", lambda s: F.transform(F.filter("terms", lambda t: t["p"] >= s["p"]), lambda t: pair(s, t))))
    right = F.transform("terms", lambda s: F.struct(s["p"].alias("i"), F.lit(None).cast("string").alias("j"), (s["a"] * F.col("misclosure")).alias("v")))
    cells = rows.select("net", w.alias("w"), F.explode(F.concat(pairs, right)).alias("c"))
    half = cells.groupBy("net", F.col("c.i").alias("i"), F.col("c.j").alias("j")).agg(F.sum(F.col("w") * F.col("c.v")).alias("value"))
    own = F.struct(F.col("i"), F.col("j"), F.col("value"))
    mirror = F.struct(F.col("j").alias("i"), F.col("i").alias("j"), F.col("value"))
    both = F.when(F.col("j").isNull() | (F.col("i") == F.col("j")), F.array(own)).otherwise(F.array(own, mirror))
    return half.select("net", F.explode(both).alias("c")).select("net", "c.i", "c.j", "c.value")


def _systems(cells: pa.Table):
    """The systems of the networks in ``cells``, those with as many unknowns together: (names, nets, at, n, u), where ``nets`` are the rows of ``cells``
    at which networks begin and ``at`` [network, unknown] are places in ``names``."""
    starts = group_starts(cells, ["net"])
    g = np.repeat(np.arange(len(starts)), np.diff([*starts, cells.num_rows]))
    both = pc.dictionary_encode(pa.chunked_array([*cells["i"].chunks, *cells["j"].chunks])).combine_chunks()
    order = np.argsort(both.dictionary.to_numpy(zero_copy_only=False), kind="stable")
    names, rank = both.dictionary.take(pa.array(order)), np.empty(len(order) + 1, np.int64)
    rank[order], rank[-1] = np.arange(len(order)), -1
    i, j = rank[both.indices.fill_null(len(order)).to_numpy()].reshape(2, -1)
    width = len(order)
    unknowns = np.unique(g * width + i)
    first = np.searchsorted(unknowns, np.arange(len(starts) + 1) * width)
    local = lambda p: np.searchsorted(unknowns, g * width + p) - first[g]
    at_i, left, value = local(i), j >= 0, cells["value"].to_numpy()
    at_j = local(np.maximum(j, 0))
    sizes = np.diff(first)
    for size in np.unique(sizes):
        if size > MOST_UNKNOWNS:
            net = cells["net"][int(starts[np.argmax(sizes == size)])].as_py()
            raise ValueError(f"network {net} has {size} unknowns; one task solves {MOST_UNKNOWNS}")
        nets = np.flatnonzero(sizes == size)
        slot, mine = np.full(len(starts), -1), sizes[g] == size
        slot[nets] = np.arange(len(nets))
        n, u = np.zeros((len(nets), size, size)), np.zeros((len(nets), size))
        a, b = mine & left, mine & ~left
        n[slot[g[a]], at_i[a], at_j[a]] = value[a]
        u[slot[g[b]], at_i[b]] = value[b]
        yield names, starts[nets], unknowns[first[nets][:, None] + np.arange(size)] % width, n, u


def damped_factor(n: np.ndarray, attempts: int = 24):
    """(Cholesky factor of the scaled matrix, scale, damping): diagonal scaling first, then ever more on the diagonal if it fails."""
    scale = 1 / np.sqrt(np.where(np.diag(n) > 0, np.diag(n), 1.0))
    scaled, damping = n * scale[:, None] * scale[None, :], 0.0
    for _ in range(attempts):
        try:
            return np.linalg.cholesky(scaled + damping * np.eye(len(n))), scale, damping
        except np.linalg.LinAlgError:
            damping = max(1e-12, damping * 10)
    raise np.linalg.LinAlgError("not positive definite")


#: Unknowns of a network that one task solves: a dense matrix of so many squared doubles.
MOST_UNKNOWNS = 6000


def _factors(n: np.ndarray):
    """``damped_factor`` of each of a stack of matrices, and which have one."""
    diagonal = np.diagonal(n, axis1=1, axis2=2)
    scale = 1 / np.sqrt(np.where(diagonal > 0, diagonal, 1.0))
    try:
        return np.linalg.cholesky(n * scale[:, :, None] * scale[:, None, :]), scale, np.zeros(len(n)), np.ones(len(n), bool)
    except np.linalg.LinAlgError:
        pass
    factor, damping, solved = np.tile(np.eye(n.shape[1]), (len(n), 1, 1)), np.full(len(n), np.inf), np.zeros(len(n), bool)
    for k, own in enumerate(n):
        try:
            factor[k], _, damping[k] = damped_factor(own)
            solved[k] = True
        except np.linalg.LinAlgError:
            pass
    return factor, scale, damping, solved


def solve_networks(normals: DataFrame, covariance: bool = False) -> DataFrame:
    """(net, p, dx, damping) of each network, or (net, i, j, q) of its inverse with ``covariance``. One group is one network of at
    most MOST_UNKNOWNS unknowns; a larger one is an error. A network that can't be solved has null dx, and no inverse. Small networks with
    as many unknowns are solved together, as a stack."""
    net = normals.schema["net"].dataType.simpleString()

    def run(cells: pa.Table):
        for names, nets, at, n, u in _systems(cells):
            factor, scale, damping, solved = _factors(n)
            half = np.linalg.inv(factor) * scale[:, None, :]
            q = half.transpose(0, 2, 1) @ half
            size = n.shape[1]
            if covariance:
                nets, at, q = nets[solved], at[solved], q[solved]
                i, j = np.repeat(at, size, axis=1), np.tile(at, (1, size))
                yield pa.table({"net": cells["net"].take(pa.array(np.repeat(nets, size * size))), "i": names.take(pa.array(i.ravel())), "j": names.take(pa.array(j.ravel())), "q": q.ravel()})
            else:
                dx = pa.array((q @ u[:, :, None]).ravel(), mask=np.repeat(~solved, size))
                yield pa.table({"net": cells["net"].take(pa.array(np.repeat(nets, size))), "p": names.take(pa.array(at.ravel())), "dx": dx, "damping": np.repeat(damping, size)})

    return by_groups(normals.select("net", "i", "j", "value"), ["net"], run, f"net {net}, i string, j string, q double" if covariance else f"net {net}, p string, dx double, damping double")


def _moved(stations: DataFrame, dx: DataFrame) -> DataFrame:
    parts = dx.filter(~F.col("p").endswith(":o")).withColumn("station", F.regexp_replace("p", ":[xyh]$", "")).withColumn("axis", F.right("p", F.lit(1)))
    wide = parts.groupBy("net", "station").agg(*(F.sum(F.when(F.col("axis") == a, F.col("dx"))).alias(f"d{a}") for a in "xyh"))
    joined = stations.withColumn("__s", F.col("station").cast("string")).join(wide.withColumnsRenamed({"net": "__net", "station": "__w"}), (F.col("net") == F.col("__net")) & (F.col("__s") == F.col("__w")), "left")
    return joined.withColumns({a: F.col(a) + F.coalesce(f"d{a}", F.lit(0.0)) for a in "xyh"}).select(*stations.columns)


@dataclass
class Adjusted:
    stations: DataFrame
    rows: DataFrame  # equation rows at the solution, with weights
    iterations: int
    converged: bool  # all networks
    summary: DataFrame  # net, iterations, step (the last one's largest), damping (the largest), converged


def _turned(turned: DataFrame, dx: DataFrame) -> DataFrame:
    moves = dx.select("net", "p", "dx")
    joined = turned.join(moves, (F.col("o_net") == F.col("net")) & (F.col("o_p") == F.col("p")), "left")
    return joined.select("o_net", "o_p", (F.col("o") + F.coalesce("dx", F.lit(0.0))).alias("o"))


def adjust(obs: DataFrame, stations: DataFrame, tolerance: float = 1e-6, most: int = 15, robust_k: float | None = None, correlated: tuple[str, float] | None = None) -> Adjusted:
    """Gauss-Newton on all networks together until no coordinate of a network moves by more than ``tolerance``, at most ``most``
    times; with ``robust_k`` each round weights residuals by Huber's function of the last ones. A network that has come to
    rest takes no further part; which ones have not is in ``summary``. ``correlated`` is a column of ``obs`` that names sets of rows and the correlation
    between any two rows of a set; the rows of the result are then the independent ones of ``whitened_sets``."""
    rows_of = equations
    if correlated is not None:
        column, rho = correlated
        rows_of = lambda o, *more: whitened_sets(equations(o, *more), o.select("net", "obs_id", F.col(column).alias("set")), rho)
    weight = 1 / (F.col("sigma") * F.col("sigma"))
    if robust_k is not None:
        weight = weight * huber_weight("misclosure", "sigma", robust_k)
    # Each round reads the observations again; they are worked out once.
    obs = cut(spread(obs, "net"), "adjust-obs")
    stations, done, turn, going, log = cut(spread(stations, "net"), "adjust"), False, 0, obs, None
    turned = cut(orientations(obs, stations), "adjust-turned")
    has_sets = not turned.isEmpty()
    while turn < most and not done:
        turn += 1
        rows = rows_of(going, stations if turn == 1 else stations.join(left, "net", "left_semi"), turned)
        dx = cut(solve_networks(normal_equations(rows, weight if turn > 1 else None)), "adjust-dx")
        stations = cut(_moved(stations, dx), "adjust")
        turned = cut(_turned(turned, dx), "adjust-turned") if has_sets else turned
        step = dx.groupBy("net").agg(F.max(F.abs("dx")).alias("step"), F.max("damping").alias("damping"), F.lit(turn).alias("iterations"))
        log = step if log is None else log.unionByName(step)
        left = cut(step.filter(F.col("step") > tolerance).select("net"), "adjust-left")
        done = left.isEmpty()
        going = obs.join(left, "net", "left_semi")
    last = log.groupBy("net").agg(F.max("iterations").alias("iterations"), F.max_by("step", "iterations").alias("step"), F.max("damping").alias("damping"))
    summary = cut(last.withColumn("converged", F.coalesce(F.col("step") <= tolerance, F.lit(False))), "adjust-summary")
    return Adjusted(stations, rows_of(obs, stations, turned), turn, done and summary.filter("not converged").isEmpty(), summary)


def degrees_of_freedom(rows: DataFrame) -> DataFrame:
    """(net, n_eq, n_par, dof, ss, s0): sum of squared standardised residuals and a posteriori standard deviation."""
    eq = rows.groupBy("net").agg(F.count(F.lit(1)).alias("n_eq"), F.sum((F.col("misclosure") / F.col("sigma")) ** 2).alias("ss"))
    par = rows.select("net", F.explode("terms.p").alias("p")).groupBy("net").agg(F.count_distinct("p").alias("n_par")).withColumnRenamed("net", "__n")
    out = eq.join(par, F.col("net") == F.col("__n"), "left").drop("__n").withColumn("n_par", F.coalesce("n_par", F.lit(0)))
    out = out.withColumn("dof", F.col("n_eq") - F.col("n_par"))
    return out.withColumn("s0", F.when(F.col("dof") > 0, F.sqrt(F.col("ss") / F.col("dof"))).otherwise(0.0))


def residual_statistics(rows: DataFrame, covariance: DataFrame, summary: DataFrame, critical: float = 3.29, noncentral: float = 4.13) -> DataFrame:
    """Standardised residuals, redundancy numbers, minimal detectable errors and local tests of every equation row."""
    q = covariance.withColumnsRenamed({"net": "__net", "i": "__i", "j": "__j"})
    pairs = F.flatten(F.transform("terms", lambda s: F.transform("terms", lambda t: F.struct(s["p"].alias("i"), t["p"].alias("j"), (s["a"] * t["a"]).alias("v")))))
    cells = rows.select("net", "obs_id", "part", F.explode(pairs).alias("c"))
    joined = cells.join(q, (F.col("net") == F.col("__net")) & (F.col("c.i") == F.col("__i")) & (F.col("c.j") == F.col("__j")))
    qll = joined.groupBy(F.col("net").alias("k_net"), F.col("obs_id").alias("k_id"), F.col("part").alias("k_part")).agg(F.sum(F.col("c.v") * F.col("q")).alias("aqa"))
    out = rows.join(qll, (F.col("net") == F.col("k_net")) & (F.col("obs_id") == F.col("k_id")) & (F.col("part") == F.col("k_part")), "left").drop("k_net", "k_id", "k_part")
    out = out.join(summary.select(F.col("net").alias("__n"), "s0"), F.col("net") == F.col("__n"), "left").drop("__n")
    var = F.col("sigma") * F.col("sigma")
    qvv = F.greatest(var - F.coalesce("aqa", F.lit(0.0)), F.lit(0.0))
    red = qvv / var
    t = F.when((qvv > 1e-20) & (F.col("s0") > 0), F.col("misclosure") / (F.col("s0") * F.sqrt(qvv)))
    mdb = F.when(red > 1e-12, noncentral * F.col("sigma") / F.sqrt(red)).otherwise(float("inf"))
    return out.select("net", "obs_id", "part", "type", F.col("misclosure").alias("residual"), "sigma", red.alias("redundancy"), t.alias("std_res"), mdb.alias("mdb"), (F.coalesce(F.abs(t), F.lit(0.0)) <= critical).alias("local_pass"))


def ellipses(covariance: DataFrame, scale: float = 1.0) -> DataFrame:
    """(net, station, major, minor, azimuth) of each station's error ellipse."""
    c = covariance.withColumns({"s": F.regexp_replace("i", ":[xyh]$", ""), "s2": F.regexp_replace("j", ":[xyh]$", ""), "a": F.right("i", F.lit(1)), "b": F.right("j", F.lit(1))}).filter("s = s2")
    pick = lambda a, b: F.sum(F.when((F.col("a") == a) & (F.col("b") == b), F.col("q")))
    v = c.groupBy("net", F.col("s").alias("station")).agg(pick("x", "x").alias("e"), pick("y", "y").alias("n"), pick("x", "y").alias("en")).filter("e is not null and n is not null")
    mean, root = (F.col("e") + F.col("n")) / 2, F.sqrt(((F.col("n") - F.col("e")) / 2) ** 2 + F.col("en") ** 2)
    az = F.atan2(2 * F.col("en"), F.col("n") - F.col("e")) / 2
    return v.select("net", "station", (scale * F.sqrt(mean + root)).alias("major"), (scale * F.sqrt(F.greatest(mean - root, F.lit(0.0)))).alias("minor"), F.pmod(F.degrees(az), F.lit(180.0)).alias("azimuth"))


def drop_worst(obs: DataFrame, stations: DataFrame, threshold: float = 4.0, min_redundancy: float = 0.05, cycles: int = 3) -> tuple[Adjusted, DataFrame]:
    """Adjusts, drops each network's worst row over ``threshold`` and repeats, up to ``cycles`` times. Returns the last
    adjustment and the (net, obs_id) dropped."""
    gone = None
    for turn in range(cycles + 1):
        left = obs if gone is None else obs.join(gone, ["net", "obs_id"], "left_anti")
        result = adjust(left, stations)
        if turn == cycles:
            break
        stats = residual_statistics(result.rows, solve_networks(normal_equations(result.rows), covariance=True), degrees_of_freedom(result.rows))
        # Where all rows fit, standardised residuals are those of rounding errors.
        some = F.abs("residual") > 1e-6 * F.col("sigma")
        bad = stats.filter(some & (F.abs("std_res") >= threshold) & (F.col("redundancy") >= min_redundancy))
        worst = bad.groupBy("net").agg(F.max(F.struct(F.abs("std_res").alias("t"), F.col("redundancy"), F.col("obs_id")))["obs_id"].alias("obs_id"))
        worst = cut(worst, "drop-worst")
        if worst.isEmpty():
            break
        gone = worst if gone is None else gone.unionByName(worst)
    if gone is None:
        gone = obs.select("net", "obs_id").limit(0)
    return result, gone


def deweight_outliers(obs: DataFrame, stations: DataFrame, threshold: float = 3.0, factor: float = 4.0, cycles: int = 3) -> tuple[Adjusted, DataFrame]:
    """Adjusts, makes the sigma of each network's worst row over ``threshold`` so many times larger and repeats, up to ``cycles`` times. Returns
    the last adjustment and the (net, obs_id, times) that were made larger."""
    left, marked = obs, None
    for turn in range(cycles + 1):
        result = adjust(left, stations)
        if turn == cycles:
            break
        stats = residual_statistics(result.rows, solve_networks(normal_equations(result.rows), covariance=True), degrees_of_freedom(result.rows))
        bad = stats.filter((F.abs("residual") > 1e-6 * F.col("sigma")) & (F.abs("std_res") >= threshold) & (F.col("type") != "control"))
        worst = cut(bad.groupBy("net").agg(F.max(F.struct(F.abs("std_res").alias("t"), F.col("obs_id")))["obs_id"].alias("obs_id")), "deweight")
        if worst.isEmpty():
            break
        marked = worst if marked is None else marked.unionByName(worst)
        hit = worst.withColumn("__hit", F.lit(True))
        left = cut(left.join(hit, ["net", "obs_id"], "left").withColumn("sigma", F.when(F.col("__hit"), F.col("sigma") * factor).otherwise(F.col("sigma"))).select(*obs.columns), "deweight")
    marked = obs.select("net", "obs_id").limit(0) if marked is None else marked
    return result, marked.groupBy("net", "obs_id").agg(F.count(F.lit(1)).alias("times"))


def leave_one_out(obs: DataFrame, stations: DataFrame, candidates: DataFrame, rows: DataFrame | None = None) -> DataFrame:
    """(net, obs_id, s0, base_s0, delta_s0): what the a posteriori standard deviation becomes without each candidate. Every
    candidate is a scenario of its own, and all scenarios are adjusted together as networks. ``rows`` are those of the networks' adjustment, if it is at hand."""
    whole = adjust(obs, stations).rows if rows is None else rows
    base = degrees_of_freedom(whole).select(F.col("net").alias("b_net"), F.col("s0").alias("base_s0"))
    # Each round of the scenarios reads these again.
    picks = cut(candidates.select(F.col("net").alias("c_net"), F.col("obs_id").alias("c_id")).distinct(), "scenario-picks")
    name = F.concat_ws("/", F.col("net").cast("string"), F.col("c_id").cast("string"))
    others = obs.join(picks, (F.col("net") == F.col("c_net")) & (F.col("obs_id") != F.col("c_id"))).withColumn("net", name).select(*obs.columns)
    places = stations.join(picks, F.col("net") == F.col("c_net")).withColumn("net", name).select(*stations.columns)
    after = degrees_of_freedom(cut(adjust(cut(others, "scenario-obs"), places).rows, "scenario-rows")).select(F.col("net").alias("s_net"), "s0")
    keyed = picks.withColumn("s", F.concat_ws("/", F.col("c_net").cast("string"), F.col("c_id").cast("string")))
    out = keyed.join(after, F.col("s") == F.col("s_net")).join(base, F.col("c_net") == F.col("b_net"))
    return out.select(F.col("c_net").alias("net"), F.col("c_id").alias("obs_id"), "s0", "base_s0", (F.col("s0") - F.col("base_s0")).alias("delta_s0"))


def gamma_p(a: float, x: float) -> float:
    """Regularised lower incomplete gamma function, by series or continued fraction."""
    if x <= 0:
        return 0.0
    front = math.exp(-x + a * math.log(x) - math.lgamma(a))
    if x < a + 1:
        term = total = 1 / a
        k = a
        while abs(term) > 1e-16 * abs(total):
            k += 1
            term *= x / k
            total += term
        return total * front
    b, c = x + 1 - a, 1e300
    d = h = 1 / b
    for i in range(1, 10_000):
        an = -i * (i - a)
        b += 2
        d = 1 / (an * d + b)
        c = b + an / c
        h *= c * d
        if abs(c * d - 1) < 1e-15:
            break
    return 1 - front * h


def chi_square_quantile(p: float, dof: int) -> float:
    low, high = 0.0, max(10.0, 10.0 * dof)
    for _ in range(80):
        mid = (low + high) / 2
        low, high = (mid, high) if gamma_p(dof / 2, mid / 2) < p else (low, mid)
    return (low + high) / 2


def chi_square_test(ss: float, dof: int, alpha: float = 0.05) -> dict:
    """Two-sided global test of vTPv."""
    if dof <= 0:
        return {"pass": None, "low": None, "high": None, "p": None}
    low, high = chi_square_quantile(alpha / 2, dof), chi_square_quantile(1 - alpha / 2, dof)
    return {"pass": low <= ss <= high, "low": low, "high": high, "p": 1 - gamma_p(dof / 2, ss / 2)}


def chi_square_tests(summary: DataFrame, alpha: float = 0.05) -> DataFrame:
    """``summary`` (ss, dof) with low, high and pass of each network's global test; null without degrees of freedom. Limits are found once for each
    number of degrees of freedom."""
    dofs = [r["dof"] for r in summary.filter("dof > 0").select("dof").distinct().collect()]
    limits = [(int(d), chi_square_quantile(alpha / 2, d), chi_square_quantile(1 - alpha / 2, d)) for d in dofs]
    table = summary.sparkSession.createDataFrame(limits, "d int, low double, high double")
    out = summary.join(table, F.col("dof") == F.col("d"), "left").drop("d")
    return out.withColumn("pass", F.col("ss").between(F.col("low"), F.col("high")))
