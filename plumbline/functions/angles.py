"""Angles, azimuths and plane coordinates. Angles are radians unless the name says otherwise; azimuths run
clockwise from north."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

from plumbline.functions.numbers import col

TWO_PI = 2 * math.pi
ARCSEC = 180 / math.pi * 3600


def wrap_two_pi(a) -> Column:
    """Into [0, 2 pi), for either sign."""
    a = col(a)
    return a - F.floor(a / TWO_PI) * TWO_PI


def wrap_pi(a) -> Column:
    """Into (-pi, pi], for either sign."""
    a = col(a)
    return a - F.ceil((a - math.pi) / TWO_PI) * TWO_PI


def azimuth(de, dn) -> Column:
    return wrap_two_pi(F.atan2(col(de), col(dn)))


def distance(de, dn) -> Column:
    return F.hypot(col(de), col(dn))


def forward(e, n, az, dist) -> tuple[Column, Column]:
    return col(e) + col(dist) * F.sin(col(az)), col(n) + col(dist) * F.cos(col(az))


def turned_angle(at_from_az, at_to_az) -> Column:
    """Clockwise from the first azimuth to the second."""
    return wrap_two_pi(col(at_to_az) - col(at_from_az))


def dms_to_rad(text) -> Column:
    """``ddd-mm-ss.s`` or packed ``ddd.mmsss``; null for anything else. The sign holds for the whole."""
    t = F.trim(col(text).cast("string"))
    sign = F.when(t.startswith("-"), -1.0).otherwise(1.0)
    body = F.regexp_replace(t, "^[+-]", "")
    dashed = r"^(\d+)-(\d+)-(\d+(?:\.\d*)?)$"
    part = lambda i: F.regexp_extract(body, dashed, i).try_cast("double")
    from_dashes = part(1) + part(2) / 60 + part(3) / 3600
    # Packed digits are read as text, so that no rounding error turns 59.999 minutes into 60.
    whole = F.regexp_extract(body, r"^(\d+)(?:\.\d*)?$", 1).try_cast("double")
    rest = F.rpad(F.regexp_extract(body, r"^\d+\.(\d*)$", 1), 4, "0")
    seconds = F.concat(F.substring(rest, 3, 2), F.lit("."), F.substring(rest, 5, 30), F.lit("0")).try_cast("double")
    packed = whole + F.substring(rest, 1, 2).try_cast("double") / 60 + seconds / 3600
    degrees = F.when(body.rlike(dashed), from_dashes).when(body.rlike(r"^\d+(\.\d*)?$"), packed)
    return F.radians(sign * degrees)


def rad_to_dms(a, digits: int = 2) -> Column:
    """``ddd-mm-ss.ss`` of an angle in [0, 2 pi); seconds that round to 60 carry over."""
    total = F.round(wrap_two_pi(a) * ARCSEC, digits)
    total = F.when(total >= 1296000, total - 1296000).otherwise(total)
    d = F.floor(total / 3600)
    m = F.floor((total - d * 3600) / 60)
    return F.format_string(f"%03d-%02d-%0{digits + 3}.{digits}f", d, m, total - d * 3600 - m * 60)


def quadrant_bearing(text) -> Column:
    """``N12-30-00E`` and the like as an azimuth; null for anything else."""
    pattern = r"^\s*([NS])\s*([0-9.\-]+)\s*([EW])\s*$"
    t = F.upper(col(text).cast("string"))
    a = dms_to_rad(F.regexp_extract(t, pattern, 2))
    from_, to = F.regexp_extract(t, pattern, 1), F.regexp_extract(t, pattern, 3)
    az = F.when((from_ == "N") & (to == "E"), a).when((from_ == "S") & (to == "E"), math.pi - a).when((from_ == "S") & (to == "W"), math.pi + a).when((from_ == "N") & (to == "W"), TWO_PI - a)
    return F.when(F.degrees(a).between(0, 90), wrap_two_pi(az))


def circular_mean(values, weights=None) -> Column:
    """Aggregate: direction of the weighted sum of unit vectors; null where that sum is shorter than 1e-12."""
    w = F.lit(1.0) if weights is None else col(weights)
    s, c = F.sum(w * F.sin(col(values))), F.sum(w * F.cos(col(values)))
    return F.when(F.hypot(s, c) >= 1e-12, wrap_two_pi(F.atan2(s, c)))


def curve_metrics(radius, delta) -> dict[str, Column]:
    """Circular curve from radius and central angle."""
    r, d = col(radius), col(delta)
    return {"arc": r * d, "chord": 2 * r * F.sin(d / 2), "tangent": r * F.tan(d / 2), "external": r * (1 / F.cos(d / 2) - 1), "middle": r * (1 - F.cos(d / 2))}


def intersect_bearings(e1, n1, az1, e2, n2, az2) -> tuple[Column, Column]:
    """Where two lines by point and azimuth meet; null if they are parallel."""
    e1, n1, az1, e2, n2, az2 = map(col, (e1, n1, az1, e2, n2, az2))
    cross = F.sin(az1) * F.cos(az2) - F.cos(az1) * F.sin(az2)
    t = F.when(F.abs(cross) > 1e-12, ((e2 - e1) * F.cos(az2) - (n2 - n1) * F.sin(az2)) / cross)
    return e1 + t * F.sin(az1), n1 + t * F.cos(az1)


def intersect_circles(ax, ay, ra, bx, by, rb) -> Column:
    """Array of 0, 1 or 2 points (x, y) where two circles meet; the one left of a to b first."""
    ax, ay, ra, bx, by, rb = map(col, (ax, ay, ra, bx, by, rb))
    dx, dy = bx - ax, by - ay
    d = F.hypot(dx, dy)
    along = (ra * ra - rb * rb + d * d) / (2 * d)
    h2 = ra * ra - along * along
    h = F.sqrt(F.greatest(h2, F.lit(0.0)))
    mx, my = ax + along * dx / d, ay + along * dy / d
    one = lambda s: F.struct((mx - s * h * dy / d).alias("x"), (my + s * h * dx / d).alias("y"))
    empty = F.filter(F.array(one(1.0)), lambda _: F.lit(False))
    return F.when((d > 1e-12) & (h2 > 1e-12), F.array(one(1.0), one(-1.0))).when((d > 1e-12) & (h2 >= -1e-9), F.array(one(0.0))).otherwise(empty)


def curvature_refraction(horizontal, k: float = 0.13, radius: float = 6_371_000.0) -> Column:
    """Angle by which earth curvature less refraction lowers a target."""
    return (1 - k) * col(horizontal) / (2 * radius)
