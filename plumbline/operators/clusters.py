"""Merges of stations that are one point under several names: an adjustment of the network as it is, and another of its quotient.

Approved merges (net, alias_id, canonical_id) tie names together; each component of them becomes one station, chained merges included. Its name
is that of a canonical station that is itself no alias, the first in natural order, or the first of all where merges run in a circle. All tables
are rewritten by one join with the names; stations and rows that no merge touches pass through unchanged.

Defined cases: names are compared trimmed; a merge with an empty name or with itself is none, and repeated merges are one. Where ``approved`` is a column of
the merges, only rows where it is true count. A merged station keeps the row of the station whose name it has, or, where there is no such row, that
of the first member in natural order. Observations both of whose ends become one station say nothing and fall out, as does an
angle two of whose three stations become one. A merge one of whose stations the first pass doesn't know has an outcome marked ``missing``, and still renames
the other. Without merges the second pass is the first.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from plumbline.functions.numbers import natural_key
from plumbline.operators.adjustment import Adjusted, adjust
from plumbline.operators.graph import network_components
from plumbline.tables import cut


def _name(c) -> Column:
    return F.trim(F.col(c).cast("string"))


def approved_merges(merges: DataFrame) -> DataFrame:
    """(net, alias_id, canonical_id): the merges that count, each once."""
    rows = merges.filter(F.coalesce(F.col("approved"), F.lit(False))) if "approved" in merges.columns else merges
    rows = rows.select("net", _name("alias_id").alias("alias_id"), _name("canonical_id").alias("canonical_id"))
    return rows.filter("net is not null and alias_id <> '' and canonical_id <> '' and alias_id <> canonical_id").distinct()


def merged_names(merges: DataFrame) -> DataFrame:
    """(net, station, name) of every station that a merge names: what it is called afterwards."""
    pairs = cut(approved_merges(merges), "merges")
    roots = network_components(pairs.select("net", F.col("alias_id").alias("a"), F.col("canonical_id").alias("b")))
    alias = pairs.select(F.col("net").alias("a_net"), F.col("alias_id").alias("a_s")).distinct()
    rows = roots.withColumnRenamed("node", "station").join(alias, (F.col("net") == F.col("a_net")) & (F.col("station") == F.col("a_s")), "left")
    key = F.struct(F.col("a_s").isNotNull().alias("is_alias"), natural_key("station").alias("k"), F.col("station").alias("s"))
    heads = rows.groupBy(F.col("net").alias("h_net"), F.col("root").alias("h_root")).agg(F.min(key)["s"].alias("name"))
    return rows.join(heads, (F.col("net") == F.col("h_net")) & (F.col("root") == F.col("h_root"))).select("net", "station", "name")


def _renamed(df: DataFrame, names: DataFrame, column: str) -> DataFrame:
    of = names.select(F.col("net").alias("__net"), F.col("station").alias("__s"), F.col("name").alias("__name"))
    found = df.join(of, (F.col("net") == F.col("__net")) & (_name(column) == F.col("__s")), "left")
    return found.withColumn(column, F.coalesce("__name", F.col(column).cast("string"))).drop("__net", "__s", "__name")


def quotient(obs: DataFrame, stations: DataFrame, names: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``obs`` and ``stations`` under the merged ``names``; identifiers of stations become texts."""
    rows = obs
    for column in ("from_id", "to_id", "at_id"):
        rows = _renamed(rows, names, column)
    different = lambda a, b: ~F.col(a).eqNullSafe(F.col(b))
    apart = different("from_id", "to_id") & ((F.col("type") != "angle") | different("at_id", "from_id") & different("at_id", "to_id"))
    old = "__was"
    places = _renamed(stations.withColumn(old, F.col("station").cast("string")), names, "station")
    first = Window.partitionBy("net", "station").orderBy((_name(old) == F.col("station")).desc(), natural_key(old), old)
    # Only merged stations meet in a window; they are few.
    touched = names.select(F.col("net").alias("t_net"), F.col("name").alias("t_s")).distinct()
    same = (F.col("net") == F.col("t_net")) & (F.col("station") == F.col("t_s"))
    one = places.join(touched, same, "left_semi").withColumn("__n", F.row_number().over(first)).filter("__n = 1").select(*stations.columns)
    return rows.filter(apart).select(*obs.columns), places.join(touched, same, "left_anti").select(*stations.columns).unionByName(one)


def merge_outcomes(first: DataFrame, merges: DataFrame, is_2d: bool = False) -> DataFrame:
    """What each approved merge joins, by the ``first`` pass's stations: net, alias_id, canonical_id, missing, alias and canonical coordinates,
    their differences and distances, in plane and in space; in order of net and names. Heights are null with ``is_2d``."""
    out = approved_merges(merges)
    for role in ("alias", "canonical"):
        at = first.select(F.col("net").alias("s_net"), _name("station").alias("s"), *(F.col(c).alias(f"{role}_{c}") for c in "xyh"))
        out = out.join(at, (F.col("net") == F.col("s_net")) & (F.col(f"{role}_id") == F.col("s")), "left").drop("s_net", "s")
    none = F.lit(None).cast("double")
    out = out.withColumns({f"{r}_h": none for r in ("alias", "canonical")}) if is_2d else out
    out = out.withColumns({f"delta_{c}": F.col(f"alias_{c}") - F.col(f"canonical_{c}") for c in "xyh"})
    flat = F.hypot("delta_x", "delta_y")
    out = out.withColumns({"horizontal": flat, "spatial": F.when(F.col("delta_h").isNull(), flat).otherwise(F.hypot(flat, F.col("delta_h")))})
    out = out.withColumn("missing", F.col("alias_x").isNull() | F.col("canonical_x").isNull())
    return out.orderBy("net", natural_key("canonical_id"), natural_key("alias_id"), "canonical_id", "alias_id")


@dataclass
class DualPass:
    first: Adjusted
    second: Adjusted
    names: DataFrame  # net, station, name
    outcomes: DataFrame


def dual_pass(obs: DataFrame, stations: DataFrame, merges: DataFrame, is_2d: bool = False, **options) -> DualPass:
    """Adjusts all networks, then those that have approved merges again with merged stations; the others keep their first pass. ``options`` are
    those of ``adjust``. The second pass has its stations as texts."""
    first = adjust(obs, stations, **options)
    names = cut(merged_names(merges), "merged-names")
    outcomes = merge_outcomes(first.stations, merges, is_2d)
    if names.isEmpty():
        return DualPass(first, first, names, outcomes)
    rows, places = quotient(obs, stations, names)
    return DualPass(first, adjust(cut(rows, "merged-rows"), places, **options), names, outcomes)
