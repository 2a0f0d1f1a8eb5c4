"""The table of observations and residuals: one row for each observation, all of it text, angles in degrees and their residuals in seconds of arc."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.functions.numbers import is_finite
from plumbline.functions.text import csv_field

#: The columns in order, feet to a metre, and the types whose values are angles.
COLUMNS = (
    "obsId", "status", "type", "stations", "sourceLine", "sourceFile", "instCode", "setId", "planned", "sigmaSource", "mode", "fromStation", "atStation", "toStation",
    "observedValue", "observedDeltaE", "observedDeltaN", "calculatedValue", "calculatedDeltaE", "calculatedDeltaN", "residualValue", "residualDeltaE", "residualDeltaN",
    "stdDev", "stdDevE", "stdDevN", "corrEN", "stdRes", "stdResE", "stdResN", "redundancy", "redundancyE", "redundancyN",
    "localTestPass", "localTestCritical", "localTestPassE", "localTestPassN", "mdb", "mdbE", "mdbN", "effectiveDistance", "observedUnit", "residualUnit", "sigmaUnit",
)
FEET = 3.280839895
ANGULAR = ("angle", "direction", "bearing", "dir", "zenith")


def with_statistics(obs: DataFrame, statistics: DataFrame, critical: float = 3.29) -> DataFrame:
    """``obs`` (net, obs_id) with what ``adjustment.residual_statistics`` says of them: residual, redundancy, std_res, mdb and local_pass, for a vector by
    component with _e and _n; its std_res and local_pass are those of the worse one. Observations without a row of equations have none."""
    of = lambda c, part: F.max(F.when(F.col("part") == part, F.col(c)))
    names = ("residual", "redundancy", "std_res", "mdb", "local_pass")
    rows = statistics.filter("type <> 'control'").groupBy(F.col("net").alias("s_net"), F.col("obs_id").alias("s_id")).agg(*(of(c, k).alias(f"{c}{k}") for c in names for k in (0, 1)))
    out = obs.join(rows, (F.col("net") == F.col("s_net")) & (F.col("obs_id") == F.col("s_id")), "left")
    vector = F.col("type") == "gps"
    parts = {f"{c}_{axis}": F.when(vector, F.col(f"{c}{k}")) for c in names for k, axis in enumerate("en")}
    worse = F.when(F.abs("std_res1") > F.abs("std_res0"), F.col("std_res1")).otherwise(F.coalesce("std_res0", "std_res1"))
    both = F.when(vector, F.col("local_pass0") & F.coalesce("local_pass1", F.lit(True))).otherwise(F.col("local_pass0"))
    alone = {c: F.when(~vector, F.col(f"{c}0")) for c in ("residual", "redundancy", "mdb")}
    out = out.withColumns(parts | alone | {"std_res": F.when(vector, worse).otherwise(F.col("std_res0")), "local_pass": both})
    critical_at = F.when(F.col("local_pass").isNotNull(), critical)
    return out.withColumn("critical", critical_at).drop("s_net", "s_id", *(f"{c}{k}" for c in names for k in (0, 1)))


def residual_table(obs: DataFrame, feet: bool = False) -> DataFrame:
    """The table, all columns text and empty where there is nothing to say. Of the input obs_id, type and the ends are needed; value, value_n, sigma, sigma_n, corr_en,
    line, source_file, inst, set_id, planned, sigma_source, mode, gps_mode, sideshot, distance, calc, calc_n (default: value less residual) and
    the columns of ``with_statistics`` may be absent. A direction stands at its from_id. Numbers that aren't finite are empty."""
    has = lambda c, kind="double": F.col(c).cast(kind) if c in obs.columns else F.lit(None).cast(kind)
    words = lambda c: F.coalesce(has(c, "string"), F.lit(""))
    unit, scale = ("ft", FEET) if feet else ("m", 1.0)
    kind = F.col("type")
    vector, angular = kind == "gps", kind.isin(*ANGULAR)

    def number(v: Column, digits: int) -> Column:
        # This rounds the double itself; format_string rounds the decimals that it is printed with.
        shown = F.when(F.abs(v) < 5e-13, F.lit(0.0)).otherwise(v)
        return F.when(is_finite(v), F.call_function("format_number", shown, F.lit("0." + "0" * digits))).otherwise("")

    linear = lambda v: number(v * scale, 4)
    scalar = lambda v: F.when(vector, "").when(angular, number(v * (180 / math.pi), 8)).otherwise(linear(v))
    small = lambda v: F.when(vector, "").when(angular, number(v * (180 / math.pi) * 3600, 3)).otherwise(linear(v))
    part = lambda v: F.when(vector, linear(v)).otherwise("")
    flag = lambda c: F.coalesce(has(c, "boolean").cast("string"), F.lit(""))

    residual, residual_e, residual_n = has("residual"), has("residual_e"), has("residual_n")
    calc = F.coalesce(has("calc"), has("value") - F.when(vector, residual_e).otherwise(residual))
    calc_n = F.coalesce(has("calc_n"), has("value_n") - residual_n)
    planned = F.coalesce(has("planned", "boolean"), F.lit(False))
    some = F.coalesce(residual, residual_e).isNotNull()
    status = (
        F.when(F.coalesce(has("sideshot", "boolean"), F.lit(False)), "post-adjust-only")
        .when(planned & calc.isNotNull() & ~some, "preanalysis")
        .when(planned & ~some, "planned")
        .when(calc.isNotNull() | some, "active")
        .otherwise("inactive")
    )
    f, t, a = words("from_id"), words("to_id"), words("at_id")
    label = F.when(kind == "angle", F.concat_ws("-", a, f, t)).when(kind.isin("dist", "gps", "lev", "zenith", "bearing", "dir", "direction"), F.concat_ws("-", f, t)).otherwise("-")
    pair = f"{unit} ({unit} E/{unit} N)"
    values = (
        words("obs_id"), status, F.coalesce(kind, F.lit("")), label, words("line"), words("source_file"), words("inst"), words("set_id"), planned.cast("string"), words("sigma_source"),
        F.when(kind == "dist", words("mode")).when(vector, words("gps_mode")).otherwise(""),
        F.when(kind == "direction", "").otherwise(f), F.when(kind == "angle", a).when(kind == "direction", f).otherwise(""), t,
        scalar(has("value")), part(has("value")), part(has("value_n")), scalar(calc), part(calc), part(calc_n), small(residual), part(residual_e), part(residual_n),
        small(has("sigma")), part(has("sigma")), part(F.coalesce(has("sigma_n"), has("sigma"))), F.when(vector, number(has("corr_en"), 6)).otherwise(""),
        number(has("std_res"), 3), number(has("std_res_e"), 3), number(has("std_res_n"), 3), F.when(vector, "").otherwise(number(has("redundancy"), 3)), F.when(vector, number(has("redundancy_e"), 3)).otherwise(""),
        F.when(vector, number(has("redundancy_n"), 3)).otherwise(""), flag("local_pass"), number(has("critical"), 3), flag("local_pass_e"), flag("local_pass_n"),
        small(has("mdb")), linear(has("mdb_e")), linear(has("mdb_n")), linear(has("distance")),
        F.when(vector, pair).when(angular, "deg").otherwise(unit), F.when(vector, pair).when(angular, "arcsec").otherwise(unit), F.when(angular, "arcsec").otherwise(unit),
    )
    return obs.select(*(v.alias(c) for c, v in zip(COLUMNS, values, strict=True)))


def residual_lines(obs: DataFrame, feet: bool = False) -> DataFrame:
    """(obs_id, line): the table as lines for a CSV file, without its header of ``COLUMNS``; sorted by obs_id they are the file."""
    table = residual_table(obs, feet)
    return table.select(F.col("obsId").alias("obs_id"), F.concat_ws(",", *(csv_field(c) for c in COLUMNS)).alias("line"))
