"""What leaves the engine: connections of a network, GeoJSON features, delimited points. All are columns, written by Spark's
own writers, a file for each task; null coordinates give a null geometry."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.functions.numbers import pair_key
from plumbline.functions.text import csv_field


def connections(obs: DataFrame, a: str = "from_id", b: str = "to_id", kind: str = "type") -> DataFrame:
    """(pair, types, n): each connected pair once, whichever way it was observed, with its kinds of observations."""
    rows = obs.filter(F.col(a).isNotNull() & F.col(b).isNotNull()).groupBy(pair_key(a, b).alias("pair"))
    return rows.agg(F.array_join(F.sort_array(F.collect_set(kind)), ",").alias("types"), F.count(F.lit(1)).alias("n"))


def geojson_points(points: DataFrame, key: str, x: str, y: str) -> DataFrame:
    """(key, feature): one GeoJSON feature for each point."""
    geometry = F.when(F.col(x).isNotNull() & F.col(y).isNotNull(), F.struct(F.lit("Point").alias("type"), F.array(x, y).alias("coordinates")))
    feature = F.struct(F.lit("Feature").alias("type"), geometry.alias("geometry"), F.struct(F.col(key).cast("string").alias("id")).alias("properties"))
    return points.select(key, F.to_json(feature, {"ignoreNullFields": "false"}).alias("feature"))


def geojson_lines(obs: DataFrame, points: DataFrame, key: str, x: str, y: str) -> DataFrame:
    """(pair, feature): one GeoJSON line for each pair that observations (from_id, to_id, type) connect, whichever way, with their kinds.
    Pairs with an unknown end are left out."""
    pairs = connections(obs.filter("from_id <> to_id")).withColumnRenamed("n", "observations")
    ends = obs.select(pair_key("from_id", "to_id").alias("p"), F.least("from_id", "to_id").alias("a"), F.greatest("from_id", "to_id").alias("b")).dropDuplicates(["p"])
    rows = pairs.join(ends, F.col("pair") == F.col("p"))
    for end in "ab":
        rows = rows.join(points.select(F.col(key).alias(f"{end}_k"), F.array(x, y).alias(f"{end}_xy")), F.col(end) == F.col(f"{end}_k"))
    geometry = F.struct(F.lit("LineString").alias("type"), F.array("a_xy", "b_xy").alias("coordinates"))
    feature = F.struct(F.lit("Feature").alias("type"), geometry.alias("geometry"), F.struct("pair", "types", "observations").alias("properties"))
    return rows.select("pair", F.to_json(feature).alias("feature"))


def delimited(points: DataFrame, columns: list[str], delimiter: str = ",") -> DataFrame:
    """(line): the columns as text, quoted where needed."""
    return points.select(F.concat_ws(delimiter, *(csv_field(c, delimiter) for c in columns)).alias("line"))


def transform_points(points: DataFrame, x: str, y: str, about: tuple[float, float], scale: float = 1.0, rotation: float = 0.0, shift: tuple[float, float] = (0.0, 0.0), within: Column | None = None) -> DataFrame:
    """Points scaled and turned (radians, clockwise) about a place, then shifted; with ``within`` only those it holds for."""
    dx, dy, s, c = F.col(x) - about[0], F.col(y) - about[1], math.sin(rotation) * scale, math.cos(rotation) * scale
    new = {x: about[0] + c * dx + s * dy + shift[0], y: about[1] - s * dx + c * dy + shift[1]}
    return points.withColumns({k: v if within is None else F.when(within, v).otherwise(F.col(k)) for k, v in new.items()})
