"""Aggregations over residuals: summaries, diagnostics, robust weights, medians, circular means.

Every operator is one grouped aggregation with map-side partial sums, so its shuffle is as long as its
groups, not its rows. Totals over all rows that each row needs come as one-row frames.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from plumbline.functions.angles import circular_mean, wrap_pi
from plumbline.functions.numbers import col, huber_weight, is_finite


def with_total(df: DataFrame, *aggs: Column) -> DataFrame:
    """``df`` with the columns of a one-row aggregate of itself."""
    return df.crossJoin(F.broadcast(df.agg(*aggs)))


def type_summary(obs: DataFrame, by: str = "type", residual="residual", sigma="sigma") -> DataFrame:
    """Count, rms, largest residual and counts over 3 and 4 standard deviations of each type; only rows whose
    residual and sigma are finite and whose sigma is positive."""
    v, t = col(residual), F.abs(col(residual) / col(sigma))
    rows = obs.filter(is_finite(residual) & is_finite(sigma) & (col(sigma) > 0))
    return rows.groupBy(by).agg(
        F.count(F.lit(1)).alias("n"),
        F.sqrt(F.avg(v * v)).alias("rms"),
        F.max(F.abs(v)).alias("max_abs"),
        F.max(t).alias("max_std_res"),
        F.count_if(t > 3).alias("over3"),
        F.count_if(t > 4).alias("over4"),
    )


def error_factors(obs: DataFrame, dof: int, by: str = "type", residual="residual", sigma="sigma", equations=None) -> DataFrame:
    """Sum of squared standardised residuals and error factor sqrt(ss / n) * sqrt(N / dof) of each group, and of all
    as the group ``Total``; equations of a row count as often as ``equations`` says."""
    n = F.lit(1) if equations is None else col(equations)
    t = col(residual) / col(sigma)
    groups = obs.groupBy(by).agg(F.sum(n).alias("n"), F.sum(t * t).alias("ss"))
    rolled = groups.rollup(by).agg(F.sum("n").alias("n"), F.sum("ss").alias("ss"), F.grouping(by).alias("all"))
    rolled = rolled.withColumn(by, F.when(F.col("all") == 1, "Total").otherwise(F.col(by)))
    total = groups.agg(F.sum("n").alias("n_total"))
    factor = F.when((F.col("n") > 0) & (F.lit(dof) > 0), F.sqrt(F.greatest(F.col("ss"), F.lit(0.0)) / F.col("n")) * F.sqrt(F.col("n_total") / dof)).otherwise(0.0)
    return rolled.crossJoin(F.broadcast(total)).select(by, "n", "ss", factor.alias("error_factor"))


def residual_diagnostics(obs: DataFrame, by: str = "type", critical: float = 3.29) -> DataFrame:
    """Counts over 2, 3 and 4 sigma, local-test failures, redundancy statistics and the worst row of each type.
    Needs std_res, redundancy and obs_id; the worst row is the one of largest |std_res|, then least obs_id."""
    t, r = F.abs("std_res"), F.col("redundancy")
    return obs.filter(is_finite("std_res")).groupBy(by).agg(
        F.count(F.lit(1)).alias("n"),
        F.count_if(t > 2).alias("over2"),
        F.count_if(t > 3).alias("over3"),
        F.count_if(t > 4).alias("over4"),
        F.count_if(t > critical).alias("local_fail"),
        F.avg(r).alias("mean_redundancy"),
        F.min(r).alias("min_redundancy"),
        F.count_if(r < 0.2).alias("below_02"),
        F.count_if(r < 0.1).alias("below_01"),
        F.max(t).alias("max_std_res"),
        F.max(F.struct(t.alias("t"), (-F.col("obs_id")).alias("i")))["i"].alias("worst"),
    ).withColumn("worst", -F.col("worst"))


def robust_weights(obs: DataFrame, k: float = 1.5) -> DataFrame:
    return obs.withColumn("weight", huber_weight("residual", "sigma", k))


def robust_summary(obs: DataFrame, k: float = 1.5) -> DataFrame:
    w = F.col("weight")
    return robust_weights(obs, k).agg(F.count(F.lit(1)).alias("n"), F.count_if(w < 1).alias("downweighted"), F.avg(w).alias("mean_weight"), F.min(w).alias("min_weight"))


#: Values that a step of ``value_at_rank`` may bring to the driver, and the parts that it cuts a range into.
RANK_ROWS, RANK_PARTS = 20_000, 1024


def value_at_rank(df: DataFrame, value: str, rank: int) -> float:
    """The value at a place (from 0) in the order of a column without nulls or NaN: counts by parts of the range lead to the part
    that holds it, which is cut again until it is small or all one value. No task holds more than the counts."""
    rows = df.select(F.col(value).cast("double").alias("v"))
    while True:
        s = rows.agg(F.count(F.lit(1)).alias("n"), F.min("v").alias("low"), F.max("v").alias("high")).first()
        if s["low"] == s["high"]:
            return s["low"]
        if s["n"] <= RANK_ROWS:
            return sorted(r["v"] for r in rows.collect())[rank]
        # Halves: the range itself may be beyond the largest number.
        part = F.least(F.floor((F.col("v") / 2 - s["low"] / 2) / (s["high"] / 2 - s["low"] / 2) * RANK_PARTS), F.lit(RANK_PARTS - 1))
        counts = sorted(map(tuple, rows.groupBy(part.alias("p")).agg(F.count(F.lit(1)).alias("n")).collect()))
        for p, n in counts:
            if rank < n:
                break
            rank -= n
        rows = rows.filter(part == p)


def exact_median(df: DataFrame, value: str) -> float | None:
    n = df.count()
    if not n:
        return None
    low = value_at_rank(df, value, (n - 1) // 2)
    return low if n % 2 else (low + value_at_rank(df, value, n // 2)) / 2


def median_ratio_classes(df: DataFrame, value: str, watch: float = 1.6, weak: float = 2.5) -> DataFrame:
    """Ratio of each value to the exact median of the positive finite ones, and its class."""
    median = exact_median(df.filter(is_finite(value) & (F.col(value) > 0)), value)
    rows = df.withColumn("ratio", F.lit(None).cast("double") if median is None else F.col(value) / median)
    return rows.withColumn("class", F.when(F.col("ratio") >= weak, "weak").when(F.col("ratio") >= watch, "watch").otherwise("ok"))


def circular_sets(df: DataFrame, by: list[str], angle: str, weight: str | None = None) -> DataFrame:
    """Weighted circular mean of each set, then count, rms and largest deviation of its members from it."""
    means = df.groupBy(*by).agg(circular_mean(angle, weight).alias("mean"), F.sum(F.lit(1.0) if weight is None else F.col(weight)).alias("weight_sum"))
    off = wrap_pi(F.col(angle) - F.col("mean"))
    joined = df.join(means, by)
    return joined.groupBy(*by).agg(
        F.first("mean").alias("mean"),
        F.count(F.lit(1)).alias("n"),
        F.sqrt(F.avg(off * off)).alias("rms"),
        F.max(F.abs(off)).alias("max_off"),
        F.sqrt(1 / F.first("weight_sum")).alias("pooled_sigma"),
    )


def usage_table(df: DataFrame, by: str, mode: str, values: list[str]) -> DataFrame:
    """Counts of each mode in a column, with zeros."""
    return df.groupBy(by).pivot(mode, values).count().na.fill(0)


def multiset_counts(df: DataFrame, *keys: str) -> DataFrame:
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"))


def duplicates(df: DataFrame, *keys: str) -> DataFrame:
    return multiset_counts(df, *keys).filter("n > 1")


def description_scan(df: DataFrame, station: str, description: Column, key: Column, line: str) -> DataFrame:
    """For each station: records, distinct normalised descriptions, the first spelling, whether they conflict."""
    rows = df.select(F.col(station).alias("station"), description.alias("text"), key.alias("key"), F.col(line).alias("line"))
    return rows.groupBy("station").agg(
        F.count(F.lit(1)).alias("records"),
        F.count_distinct("key").alias("descriptions"),
        F.min(F.struct("line", "text"))["text"].alias("first_spelling"),
        (F.count_distinct("key") > 1).alias("conflict"),
    )


def setup_diagnostics(obs: DataFrame) -> DataFrame:
    """For each setup (from_id): counts by type, distinct sets, distance, rms and the row of largest |std_res|."""
    t = F.abs("std_res")
    kinds = [F.count_if(F.col("type") == k).alias(f"n_{k}") for k in ("dist", "angle", "gps")]
    return obs.groupBy("from_id").agg(
        *kinds,
        F.count_distinct("set_id").alias("sets"),
        F.sum(F.when(F.col("type") == "dist", F.col("distance")).otherwise(0.0)).alias("total_distance"),
        F.sqrt(F.avg(t * t)).alias("rms_std_res"),
        F.max(t).alias("max_std_res"),
        F.max(F.struct(t.alias("t"), (-F.col("obs_id")).alias("i")))["i"].alias("worst"),
    ).withColumn("worst", -F.col("worst"))


def station_degrees(obs: DataFrame) -> DataFrame:
    """Observations and distinct neighbours of each station."""
    ends = obs.select(F.explode(F.array(F.struct(F.col("from_id").alias("s"), F.col("to_id").alias("o")), F.struct(F.col("to_id").alias("s"), F.col("from_id").alias("o")))).alias("e"))
    return ends.groupBy(F.col("e.s").alias("station")).agg(F.count(F.lit(1)).alias("n_obs"), F.count_distinct("e.o").alias("neighbours"))


def penalty_scores(issues: DataFrame, by: str, code: str, penalties: dict[str, int], default: int = 5) -> DataFrame:
    """100 less the penalties of the issues, from 0 to 100."""
    table = F.create_map(*(F.lit(x) for kv in penalties.items() for x in kv))
    p = F.coalesce(table[F.col(code)], F.lit(default))
    return issues.groupBy(by).agg(F.count(F.lit(1)).alias("issues"), F.greatest(F.lit(0), F.least(F.lit(100), 100 - F.sum(p))).cast("int").alias("score"))


def collisions(df: DataFrame, label: str, signature: str, document: str, least: int = 2) -> DataFrame:
    """(label, signature) pairs that come from ``least`` documents or more."""
    return df.groupBy(label, signature).agg(F.count_distinct(document).alias("documents")).filter(F.col("documents") >= least)


def worst_rows(df: DataFrame, by: list[str], order: list[Column], k: int = 1) -> DataFrame:
    """The first k rows of each group in an order."""
    return df.withColumn("rank", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).filter(F.col("rank") <= k)
