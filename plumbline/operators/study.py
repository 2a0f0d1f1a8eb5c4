"""Units, prompts and documents put together for reading and practice; small nested results and bounded histories."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from plumbline.functions.text import fold, search_tokens


def collected(units: DataFrame, parts: DataFrame, unit: str, order: list[str], text: str, name: str, most: int | None = None) -> DataFrame:
    """``units`` with an array ``name`` of their parts' texts in an order, empty without any; with ``most`` the first so many, so that a unit with
    very many parts is not gathered."""
    if most is not None:
        w = Window.partitionBy(unit).orderBy(*order)
        parts = parts.withColumn("__n", F.row_number().over(w)).filter(F.col("__n") <= most)
    found = parts.groupBy(F.col(unit).alias("__u")).agg(F.sort_array(F.collect_list(F.struct(*order, F.col(text).alias("__t")))).alias("__a"))
    rows = units.join(found, F.col(unit) == F.col("__u"), "left")
    return rows.withColumn(name, F.coalesce(F.transform("__a", lambda x: x["__t"]), F.array().cast("array<string>"))).drop("__u", "__a")


def best_prompts(units: DataFrame, progress: DataFrame, prompts: DataFrame) -> DataFrame:
    """(unit_id, phase, prompt_id) of every unit with a prompt: one of the unit's phase before a scenario for an application, before any other; the
    oldest of equals, then by identifier. ``progress``: unit_id, phase (none: unread); ``prompts``: unit_id, prompt_id, kind, created."""
    p = progress.select(F.col("unit_id").alias("p_unit"), "phase")
    rows = units.select("unit_id").join(p, F.col("unit_id") == F.col("p_unit"), "left").withColumn("phase", F.coalesce("phase", F.lit("unread"))).drop("p_unit")
    q = prompts.select(F.col("unit_id").alias("q_unit"), "prompt_id", "kind", "created")
    rank = F.when(F.col("kind") == F.col("phase"), 0).when((F.col("phase") == "application") & (F.col("kind") == "scenario"), 1).when(F.col("phase") == "maintenance", 2).otherwise(3)
    best = rows.join(q, F.col("unit_id") == F.col("q_unit")).groupBy("unit_id", "phase").agg(F.min(F.struct(rank.alias("rank"), "created", "prompt_id")).alias("b"))
    return best.select("unit_id", "phase", F.col("b.prompt_id").alias("prompt_id"))


def library_scores(docs: DataFrame, key: str, title: str, query: str, k: int) -> DataFrame:
    """(key, score): the k titles that match best, by the greater of two: the share of the query's words in the title, and how much of the title the
    query's letters fill if they stand there in this order."""
    words = sorted(set(query.lower().split()))
    letters = [c for c in query.lower() if c.isalnum()]
    t = fold(title)
    share = sum((F.array_contains(search_tokens(title), w).cast("double") for w in words), F.lit(0.0)) / max(1, len(words))
    fills = F.when(t.rlike(".*".join(letters)), F.lit(float(len(letters))) / F.length(t)).otherwise(0.0)
    out = docs.select(key, F.coalesce(F.greatest(share, fills), F.lit(0.0)).alias("score"))
    return out.filter("score > 0").orderBy(F.round("score", 9).desc(), key).limit(k)


def key_values(df: DataFrame, by: str, name: str, value: str, order: str) -> DataFrame:
    """(by, values): a map of each name to its last value in an order."""
    last = df.groupBy(by, name).agg(F.max_by(value, order).alias("__v"))
    return last.groupBy(by).agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct(name, "__v")))).alias("values"))


def pushed(history: Column, new: Column, most: int) -> Column:
    """A list with a new first entry, cut to its first ``most``."""
    return F.slice(F.concat(F.array(new), history), 1, most)


def last_entries(df: DataFrame, by: str, order: str, value: str, most: int) -> DataFrame:
    """(by, history): the last ``most`` values of each key, the newest first."""
    w = Window.partitionBy(by).orderBy(F.col(order).desc())
    rows = df.withColumn("__n", F.row_number().over(w)).filter(F.col("__n") <= most)
    return rows.groupBy(by).agg(F.transform(F.sort_array(F.collect_list(F.struct("__n", value))), lambda x: x[value]).alias("history"))
