"""Geodesy as column expressions, from published formulae: ECEF, local axes, map projections, scale factors."""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.functions.angles import wrap_two_pi
from plumbline.functions.numbers import col


@dataclass(frozen=True)
class Ellipsoid:
    a: float = 6378137.0
    inverse_f: float = 298.257222101

    @property
    def f(self):
        return 1 / self.inverse_f

    @property
    def e2(self):
        return self.f * (2 - self.f)

    @property
    def n(self):
        return self.f / (2 - self.f)


GRS80 = Ellipsoid()


def to_ecef(lat, lon, h, ell: Ellipsoid = GRS80) -> tuple[Column, Column, Column]:
    """Degrees and metres to earth-centred coordinates."""
    lat, lon, h = F.radians(col(lat)), F.radians(col(lon)), col(h)
    v = ell.a / F.sqrt(1 - ell.e2 * F.sin(lat) ** 2)
    return (v + h) * F.cos(lat) * F.cos(lon), (v + h) * F.cos(lat) * F.sin(lon), (v * (1 - ell.e2) + h) * F.sin(lat)


def ecef_to_local(dx, dy, dz, lat, lon) -> tuple[Column, Column, Column]:
    """An earth-centred vector as east, north, up at a place in degrees."""
    dx, dy, dz, lat, lon = col(dx), col(dy), col(dz), F.radians(col(lat)), F.radians(col(lon))
    e = -F.sin(lon) * dx + F.cos(lon) * dy
    n = -F.sin(lat) * F.cos(lon) * dx - F.sin(lat) * F.sin(lon) * dy + F.cos(lat) * dz
    u = F.cos(lat) * F.cos(lon) * dx + F.cos(lat) * F.sin(lon) * dy + F.sin(lat) * dz
    return e, n, u


def rotated_covariance(q: list[list[Column]], rows: list[list[Column]]) -> list[list[Column]]:
    """R Q R' of 3 x 3 columns."""
    half = [[sum((rows[i][k] * q[k][j] for k in range(1, 3)), rows[i][0] * q[0][j]) for j in range(3)] for i in range(3)]
    return [[sum((half[i][k] * rows[j][k] for k in range(1, 3)), half[i][0] * rows[j][0]) for j in range(3)] for i in range(3)]


def _series(n: float) -> tuple[float, list[float], list[float]]:
    """Rectifying radius over a, and the forward and inverse coefficients of the transverse Mercator series to n^4."""
    a = (1 + n**2 / 4 + n**4 / 64) / (1 + n)
    forward = [
        n / 2 - 2 * n**2 / 3 + 5 * n**3 / 16 + 41 * n**4 / 180,
        13 * n**2 / 48 - 3 * n**3 / 5 + 557 * n**4 / 1440,
        61 * n**3 / 240 - 103 * n**4 / 140,
        49561 * n**4 / 161280,
    ]
    inverse = [
        n / 2 - 2 * n**2 / 3 + 37 * n**3 / 96 - n**4 / 360,
        n**2 / 48 + n**3 / 15 - 437 * n**4 / 1440,
        17 * n**3 / 480 - 37 * n**4 / 840,
        4397 * n**4 / 161280,
    ]
    return a, forward, inverse


def _conformal(lat: Column, e: float) -> Column:
    """tan of the conformal latitude."""
    t = F.tan(lat)
    s = F.sinh(e * F.atanh(e * F.sin(lat)))
    return t * F.sqrt(1 + s * s) - s * F.sqrt(1 + t * t)


def _geodetic(tau: Column, e: float) -> Column:
    """Latitude from tan of the conformal latitude: fixed-point steps of the isometric latitude."""
    psi = F.asinh(tau)
    phi = F.atan(tau)
    for _ in range(7):
        phi = F.atan(F.sinh(psi + e * F.atanh(e * F.sin(phi))))
    return phi


def transverse_mercator(lat, lon, lon0: float, k0: float = 0.9996, fe: float = 500_000.0, fn: float = 0.0, ell: Ellipsoid = GRS80) -> tuple[Column, Column]:
    """(east, north) of degrees."""
    e = math.sqrt(ell.e2)
    a, alpha, _ = _series(ell.n)
    tau = _conformal(F.radians(col(lat)), e)
    lam = F.radians(col(lon) - lon0)
    xi, eta = F.atan2(tau, F.cos(lam)), F.asinh(F.sin(lam) / F.sqrt(tau * tau + F.cos(lam) ** 2))
    x, y = eta, xi
    for j, c in enumerate(alpha, 1):
        x = x + c * F.cos(2 * j * xi) * F.sinh(2 * j * eta)
        y = y + c * F.sin(2 * j * xi) * F.cosh(2 * j * eta)
    return fe + k0 * a * ell.a * x, fn + k0 * a * ell.a * y


def inverse_transverse_mercator(east, north, lon0: float, k0: float = 0.9996, fe: float = 500_000.0, fn: float = 0.0, ell: Ellipsoid = GRS80) -> tuple[Column, Column]:
    """(lat, lon) in degrees."""
    a, _, beta = _series(ell.n)
    xi, eta = (col(north) - fn) / (k0 * a * ell.a), (col(east) - fe) / (k0 * a * ell.a)
    x, y = eta, xi
    for j, c in enumerate(beta, 1):
        y = y - c * F.sin(2 * j * xi) * F.cosh(2 * j * eta)
        x = x - c * F.cos(2 * j * xi) * F.sinh(2 * j * eta)
    tau = F.sin(y) / F.sqrt(F.sinh(x) ** 2 + F.cos(y) ** 2)
    return F.degrees(_geodetic(tau, math.sqrt(ell.e2))), lon0 + F.degrees(F.atan2(F.sinh(x), F.cos(y)))


def _lcc(lat1: float, lat2: float, lat0: float, ell: Ellipsoid):
    e = math.sqrt(ell.e2)
    m = lambda p: math.cos(p) / math.sqrt(1 - ell.e2 * math.sin(p) ** 2)
    psi = lambda p: math.asinh(math.tan(p)) - e * math.atanh(e * math.sin(p))
    p1, p2, p0 = map(math.radians, (lat1, lat2, lat0))
    n = math.sin(p1) if abs(p1 - p2) < 1e-12 else (math.log(m(p1)) - math.log(m(p2))) / (psi(p2) - psi(p1))
    f = ell.a * m(p1) / n * math.exp(n * psi(p1))
    return e, n, f, f * math.exp(-n * psi(p0))


def lambert_conic(lat, lon, lat1: float, lat2: float, lat0: float, lon0: float, fe: float = 0.0, fn: float = 0.0, ell: Ellipsoid = GRS80) -> tuple[Column, Column]:
    e, n, f, rho0 = _lcc(lat1, lat2, lat0, ell)
    p = F.radians(col(lat))
    rho = f * F.exp(-n * (F.asinh(F.tan(p)) - e * F.atanh(e * F.sin(p))))
    theta = n * F.radians(col(lon) - lon0)
    return fe + rho * F.sin(theta), fn + rho0 - rho * F.cos(theta)


def inverse_lambert_conic(east, north, lat1: float, lat2: float, lat0: float, lon0: float, fe: float = 0.0, fn: float = 0.0, ell: Ellipsoid = GRS80) -> tuple[Column, Column]:
    e, n, f, rho0 = _lcc(lat1, lat2, lat0, ell)
    x, y = (col(east) - fe) * math.copysign(1, n), (rho0 - (col(north) - fn)) * math.copysign(1, n)
    rho = math.copysign(1, n) * F.hypot(x, y)
    return F.degrees(_geodetic(F.sinh(-F.log(rho / f) / n), e)), lon0 + F.degrees(F.atan2(x, y) / n)


def oblique_stereographic(lat, lon, lat0: float, lon0: float, k0: float = 1.0, fe: float = 0.0, fn: float = 0.0, ell: Ellipsoid = GRS80) -> tuple[Column, Column]:
    """Double stereographic: the ellipsoid on the conformal sphere, that on the plane."""
    e, p0 = math.sqrt(ell.e2), math.radians(lat0)
    w = 1 - ell.e2 * math.sin(p0) ** 2
    r = ell.a * math.sqrt(1 - ell.e2) / w
    n = math.sqrt(1 + ell.e2 * math.cos(p0) ** 4 / (1 - ell.e2))
    s1, s2 = (1 + math.sin(p0)) / (1 - math.sin(p0)), (1 - e * math.sin(p0)) / (1 + e * math.sin(p0))
    w1 = (s1 * s2**e) ** n
    sin_x0 = (w1 - 1) / (w1 + 1)
    c = (n + math.sin(p0)) * (1 - sin_x0) / ((n - math.sin(p0)) * (1 + sin_x0))
    x0 = math.asin((c * w1 - 1) / (c * w1 + 1))
    s = F.sin(F.radians(col(lat)))
    wp = c * F.pow((1 + s) / (1 - s) * F.pow((1 - e * s) / (1 + e * s), F.lit(e)), F.lit(n))
    chi, lam = F.asin((wp - 1) / (wp + 1)), n * F.radians(col(lon) - lon0)
    b = 1 + F.sin(chi) * math.sin(x0) + F.cos(chi) * math.cos(x0) * F.cos(lam)
    return fe + 2 * r * k0 * F.cos(chi) * F.sin(lam) / b, fn + 2 * r * k0 * (F.sin(chi) * math.cos(x0) - F.cos(chi) * math.sin(x0) * F.cos(lam)) / b


def elevation_factor(height, radius: float = 6_371_000.0) -> Column:
    return radius / (radius + col(height))


def utm_scale(east, k0: float = 0.9996, fe: float = 500_000.0, radius: float = 6_371_000.0) -> Column:
    """Point scale of a transverse Mercator grid from the distance to its axis."""
    q = (col(east) - fe) / (k0 * radius)
    return k0 * (1 + q * q / 2 + q**4 / 24)


def inside_box(lat, lon, south: float, west: float, north: float, east: float) -> Column:
    return F.coalesce(col(lat).between(south, north) & col(lon).between(west, east), F.lit(False))


def bilinear(row, column, q00, q01, q10, q11) -> Column:
    """Value at (row, column) within a grid cell from its four corners, by the fractions of row and column."""
    u, v = col(row) - F.floor(col(row)), col(column) - F.floor(col(column))
    return (1 - u) * (1 - v) * col(q00) + (1 - u) * v * col(q01) + u * (1 - v) * col(q10) + u * v * col(q11)


def convergence(lat, lon, lon0: float) -> Column:
    """Meridian convergence of a transverse Mercator grid, in radians: east of the axis grid north lies east of true north."""
    return F.atan(F.tan(F.radians(col(lon) - lon0)) * F.sin(F.radians(col(lat))))


def grid_azimuth(true_azimuth, lat, lon, lon0: float) -> Column:
    """A true azimuth as one from grid north."""
    return wrap_two_pi(col(true_azimuth) - convergence(lat, lon, lon0))


def corrected_distance(distance, prism: float = 0.0, ppm: float = 0.0, scale=1.0) -> Column:
    """A measured distance with its prism constant and scale corrections, at grid scale."""
    return (col(distance) + prism) * (1 + ppm * 1e-6) * (scale if isinstance(scale, Column) else F.lit(scale))


def orthometric(ellipsoidal, undulation) -> Column:
    return col(ellipsoidal) - col(undulation)


def grid_values(points: DataFrame, x: str, y: str, grid: DataFrame, step: float) -> DataFrame:
    """``points`` with the value of a grid (i, j, value at x = j step, y = i step), bilinear in its cell; null where a corner is missing. Corners come by
    one join on the cell."""
    rows = points.withColumns({"__r": F.col(y) / step, "__c": F.col(x) / step})
    rows = rows.withColumns({"__i": F.floor("__r"), "__j": F.floor("__c")})
    at = lambda di, dj: F.struct((F.col("i") - di).alias("i"), (F.col("j") - dj).alias("j"), F.lit(2 * di + dj).alias("k"))
    spread = grid.select("value", F.explode(F.array(*(at(a, b) for a in (0, 1) for b in (0, 1)))).alias("c"))
    corner = lambda k: F.max(F.when(F.col("c.k") == k, F.col("value"))).alias(f"__q{k}")
    cells = spread.groupBy(F.col("c.i").alias("__ci"), F.col("c.j").alias("__cj")).agg(*map(corner, range(4)))
    out = rows.join(cells, (F.col("__i") == F.col("__ci")) & (F.col("__j") == F.col("__cj")), "left")
    return out.withColumn("value", bilinear("__r", "__c", "__q0", "__q1", "__q2", "__q3")).drop("__r", "__c", "__i", "__j", "__ci", "__cj", "__q0", "__q1", "__q2", "__q3")
