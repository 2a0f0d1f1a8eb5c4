"""Levelling lines whose form is not written down: each line may be read in several ways, and known names say which is meant.

A line's tokens are exploded into its possible readings (instrument given or carried forward; two station tokens, or one token of a pair). A reading
that has both stations and a number where the height difference should be is a candidate; joins to the known stations and instruments give it a
score. The best candidate of a line wins; where two share the best score the line is ``ambiguous``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from plumbline.functions.numbers import level_sigma

#: What speaks for a reading, and against one whose station looks like a measurement.
KNOWN_STATION, KNOWN_INSTRUMENT, EXPLICIT, INSTRUMENT_IS_NO_STATION, LOOKS_NUMERIC = 2, 2, 1, 1, -12
_MEASUREMENT = r"^[+-]?[0-9]+\.[0-9]+(?:[eE][+-]?[0-9]+)?$"
_NUMBER = r"^[+-]?(?:[0-9]+\.?[0-9]*|\.[0-9]+)(?:[eE][+-]?[0-9]+)?$"


def readings(lines: DataFrame, tokens: str = "tokens", current: str = "instrument", separator: str = "-") -> DataFrame:
    """Every row of ``lines`` once for each of its four possible readings that are candidates, with form, inst, from_id, to_id, explicit, dh_token,
    length_token and sigma_token. ``tokens`` are those of the line behind its code; ``current`` is the instrument carried forward. The value is a number, or
    ``?`` for a planned one."""
    at = lambda i: F.get(F.col(tokens), F.lit(i))
    place = lambda t: F.locate(separator, t)
    inside = lambda t: (place(t) > 1) & (place(t) < F.length(t) - len(separator) + 1)
    first = lambda t: F.when(inside(t), F.trim(F.substring(t, F.lit(1), place(t) - 1)))
    second = lambda t: F.when(inside(t), F.trim(F.substring(t, place(t) + len(separator), F.length(t))))
    given = F.coalesce(at(0), F.lit(""))
    carried = F.coalesce(F.col(current), F.lit(""))

    def reading(form, inst, from_id, to_id, explicit, value):
        return F.struct(
            F.lit(form).alias("form"), inst.alias("inst"), from_id.alias("from_id"), to_id.alias("to_id"), F.lit(explicit).alias("explicit"),
            at(value).alias("dh_token"), at(value + 1).alias("length_token"), at(value + 2).alias("sigma_token"),
        )

    forms = F.array(
        reading(1, given, at(1), at(2), True, 3),
        reading(2, carried, at(0), at(1), False, 2),
        reading(3, given, first(at(1)), second(at(1)), True, 2),
        reading(4, carried, first(at(0)), second(at(0)), False, 1),
    )
    ok = lambda r: (F.coalesce(r["from_id"], F.lit("")) != "") & (F.coalesce(r["to_id"], F.lit("")) != "") & (r["dh_token"].rlike(_NUMBER) | (r["dh_token"] == "?"))
    return lines.withColumn("__r", F.explode_outer(F.filter(forms, ok))).select("*", "__r.*").drop("__r")


def scored_readings(candidates: DataFrame, stations: DataFrame, instruments: DataFrame) -> DataFrame:
    """``candidates`` with a score each. ``stations``: net, station; ``instruments``: net, inst, and others."""
    rows = candidates
    for role, of, key in (("from", stations, "station"), ("to", stations, "station"), ("as_station", stations, "station"), ("inst", instruments, "inst")):
        column = {"from": "from_id", "to": "to_id"}.get(role, "inst")
        known = of.select(F.col("net").alias("k_net"), F.col(key).cast("string").alias("k")).filter("k is not null").distinct().withColumn(f"{role}_known", F.lit(True))
        rows = rows.join(known, (F.col("net") == F.col("k_net")) & (F.col(column) == F.col("k")), "left").drop("k_net", "k")
    have = lambda role, n: F.when(F.col(f"{role}_known"), n).otherwise(0)
    named = F.col("inst") != ""
    score = (
        have("from", KNOWN_STATION)
        + have("to", KNOWN_STATION)
        + F.when(F.col("explicit"), EXPLICIT).otherwise(0)
        + F.when(named, have("inst", KNOWN_INSTRUMENT)).otherwise(0)
        + F.when(F.col("explicit") & named & F.col("as_station_known").isNull(), INSTRUMENT_IS_NO_STATION).otherwise(0)
        + F.when(F.col("from_id").rlike(_MEASUREMENT) | F.col("to_id").rlike(_MEASUREMENT), LOOKS_NUMERIC).otherwise(0)
    )
    return rows.withColumn("score", F.when(F.col("form").isNotNull(), score)).drop(*(f"{r}_known" for r in ("from", "to", "as_station", "inst")))


def resolve_levels(
    lines: DataFrame, stations: DataFrame, instruments: DataFrame, key: list[str], strict: bool = True, mm_per_sqrt_km: float | None = None, metres: float = 1.0, **names
) -> DataFrame:
    """One row for each line: ``key``, status, form, inst, from_id, to_id, dh (null if planned), planned, length_km, sigma, sigma_source, score, n_candidates.

    Status: ``invalid`` without a candidate; ``ambiguous`` where the two best scores are equal (null values if ``strict``, else the first form is
    taken); ``numeric`` where a station of the winner looks like a measurement; else ``ok``. Sigma is the token's, else from the network's level weight
    ``mm_per_sqrt_km``, else from the instrument's lev_mm (columns of ``instruments``); ``!`` is fixed, ``*`` floating. ``metres``: of a unit of length.
    """
    candidates = scored_readings(readings(lines, **names), stations, instruments)
    order = Window.partitionBy(*key).orderBy(F.col("score").desc_nulls_last(), "form")
    every = Window.partitionBy(*key)
    best = candidates.withColumns({"n": F.row_number().over(order), "second": F.lead("score").over(order), "n_candidates": F.count("form").over(every)}).filter("n = 1")
    tie = F.coalesce(F.col("second") == F.col("score"), F.lit(False))
    numeric = F.col("from_id").rlike(_MEASUREMENT) | F.col("to_id").rlike(_MEASUREMENT)
    status = F.when(F.col("form").isNull(), "invalid").when(tie & F.lit(strict), "ambiguous").when(numeric, "numeric").when(tie, "ambiguous").otherwise("ok")
    best = best.withColumn("status", status)
    taken = (F.col("status") == "ok") | (F.col("status") == "ambiguous") & ~F.lit(strict)
    number = lambda c: F.col(c).try_cast("double")
    km = F.when(F.coalesce(number("length_token"), F.lit(0.0)) > 0, number("length_token") * metres / 1000).otherwise(0.0)
    own = instruments.select(F.col("net").alias("i_net"), F.col("inst").cast("string").alias("i_s"), *(["lev_mm"] if "lev_mm" in instruments.columns else [F.lit(None).cast("double").alias("lev_mm")]))
    best = best.join(own, (F.col("net") == F.col("i_net")) & (F.col("inst") == F.col("i_s")), "left").withColumn("km", km)
    base = level_sigma("km", mm_per_sqrt_km) if mm_per_sqrt_km and mm_per_sqrt_km > 0 else F.lit(0.0)
    default = F.when(base > 0, base).when(F.col("lev_mm") > 0, F.sqrt("km") * F.col("lev_mm") / 1000).otherwise(0.0)
    token = F.trim("sigma_token")
    sigma, source = _sigma(token, default, metres)
    value = lambda c: F.when(taken, c)
    return best.select(
        *key, "status", value(F.col("form")).alias("form"), value(F.col("inst")).alias("inst"), value(F.col("from_id")).alias("from_id"), value(F.col("to_id")).alias("to_id"),
        value(number("dh_token") * metres).alias("dh"), value(F.col("dh_token") == "?").alias("planned"), value(F.col("km")).alias("length_km"), value(sigma).alias("sigma"), value(source).alias("sigma_source"),
        "score", F.col("n_candidates").cast("int").alias("n_candidates"),
    )


def _sigma(token: Column, default: Column, metres: float) -> tuple[Column, Column]:
    """A sigma token's value and where it comes from; what is no token counts as none."""
    number = token.try_cast("double")
    given = F.coalesce(token.rlike(_NUMBER), F.lit(False))
    sigma = F.when(given, number * metres).when(token == "!", 1e-9).when(token == "*", 1e9).otherwise(default)
    return sigma, F.when(given, "explicit").when(token == "!", "fixed").when(token == "*", "float").otherwise("default")
