"""Numbers with three kinds of nothing (null, NaN, infinite), sigma tokens and keys."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def is_finite(c) -> Column:
    """True for a number that is neither null, NaN nor infinite; never null."""
    c = col(c).cast("double")
    return F.coalesce(~F.isnan(c) & (F.abs(c) != float("inf")), F.lit(False))


def rounded_half_away(c, digits: int) -> Column:
    """``c`` to so many decimals by scaling it in doubles, halves away from zero, as databases do; Spark's own rounding goes by the decimals that a double
    is printed with, and may differ in the last place."""
    scale = 10.0**digits
    return F.round(col(c) * scale) / scale


def finite_or(c, default) -> Column:
    return F.when(is_finite(c), col(c)).otherwise(default)


def natural_key(c) -> Column:
    """A sort key under which 2 < 10, and P9 < P10, for numbers of any length: before each number stands how many digits it
    has; letters in lower case."""
    c = col(c).cast("string")
    parts = F.regexp_extract_all(c, F.lit(r"([0-9]+|[^0-9]+)"), 1)
    plain = lambda x: F.regexp_replace(x, "^0+(?=[0-9])", "")
    number = lambda x: F.concat(F.lpad(F.length(plain(x)).cast("string"), 10, "0"), plain(x))
    return F.array_join(F.transform(parts, lambda x: F.when(x.rlike("^[0-9]"), number(x)).otherwise(F.lower(x))), "")


def pair_key(a, b, sep: str = "|") -> Column:
    """One key for both directions of a pair, in natural order; names that it finds equal (P1, P01) go by their characters."""
    a, b = col(a).cast("string"), col(b).cast("string")
    first = F.struct(natural_key(a), a) <= F.struct(natural_key(b), b)
    return F.when(first, F.concat_ws(sep, a, b)).otherwise(F.concat_ws(sep, b, a))


def edm_sigma(distance, const_m: float, ppm: float, propagated: bool = False) -> Column:
    """Default sigma of a distance: constant + ppm part, added or propagated."""
    part = F.abs(col(distance)) * (ppm * 1e-6)
    return F.sqrt(F.lit(const_m**2) + part * part) if propagated else F.lit(const_m) + part


def level_sigma(length_km, mm_per_sqrt_km: float) -> Column:
    return F.sqrt(F.greatest(col(length_km), F.lit(0.0))) * (mm_per_sqrt_km / 1000)


def sigma_token(token, default, fixed: float = 1e-9, floating: float = 1e9) -> Column:
    """``&``, ``?`` or nothing: the default; ``!`` fixed; ``*`` floating; a number: itself; else null."""
    t = F.trim(col(token).cast("string"))
    return (
        F.when(t.isNull() | t.isin("", "&", "?"), col(default))
        .when(t == "!", F.lit(fixed))
        .when(t == "*", F.lit(floating))
        .otherwise(t.try_cast("double"))
    )


def clip(c, low, high) -> Column:
    return F.greatest(F.lit(low), F.least(F.lit(high), col(c)))


def huber_weight(residual, sigma, k: float = 1.5, floor: float = 0.001) -> Column:
    """1 within k standard deviations, then k / |v / sigma|, from ``floor`` to 1; k is held in 0.5 to 10."""
    k = min(10.0, max(0.5, k))
    t = F.abs(col(residual) / F.greatest(col(sigma), F.lit(1e-12)))
    return F.when(t <= k, 1.0).otherwise(clip(F.lit(k) / t, floor, 1.0))
