"""Before and beside an adjustment: approximate places, planned observations, connectivity, groups of near stations."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.functions.angles import azimuth, wrap_two_pi
from plumbline.functions.numbers import natural_key
from plumbline.operators.ordered import ordered_scan
from plumbline.tables import cut


def bootstrap(known: DataFrame, legs: DataFrame, most_rounds: int = 1000) -> DataFrame:
    """(net, station, x, y): known places and those that legs (from_id, to_id, azimuth, distance) lead to from them, either way, a leg
    further in each round; of several ways in one round the mean. Stations that no way leads to are left out. Only stations found in
    the last round are joined, so a round costs what is new."""
    back = legs.select("net", F.col("to_id").alias("from_id"), F.col("from_id").alias("to_id"), wrap_two_pi(F.col("azimuth") + 3.141592653589793).alias("azimuth"), "distance")
    both = cut(legs.select("net", "from_id", "to_id", "azimuth", "distance").unionByName(back), "legs")
    done = cut(known.select("net", "station", "x", "y"), "places")
    new = done
    for _ in range(most_rounds):
        at = new.select(F.col("net").alias("k_net"), F.col("station").alias("k"), F.col("x").alias("kx"), F.col("y").alias("ky"))
        step = both.join(at, (F.col("net") == F.col("k_net")) & (F.col("from_id") == F.col("k")))
        step = step.select("net", F.col("to_id").alias("station"), (F.col("kx") + F.col("distance") * F.sin("azimuth")).alias("x"), (F.col("ky") + F.col("distance") * F.cos("azimuth")).alias("y"))
        new = cut(step.join(done, ["net", "station"], "left_anti").groupBy("net", "station").agg(F.avg("x").alias("x"), F.avg("y").alias("y")), "places")
        if new.isEmpty():
            return done
        done = cut(done.unionByName(new), "places")
    raise RuntimeError(f"a way is longer than {most_rounds} legs")


def populate(obs: DataFrame, stations: DataFrame) -> DataFrame:
    """``obs`` with the values that planned rows (without a value) would have by the stations' places. Types dist, bearing, dir, angle, lev and
    zenith; rows with a value stay, rows with an unknown end have none."""
    rows = obs
    for role, key in (("f", "from_id"), ("t", "to_id"), ("a", "at_id")):
        side = stations.select(F.col("net").alias(f"{role}_net"), F.col("station").alias(f"{role}_s"), *(F.col(c).alias(f"{role}_{c}") for c in "xyh"))
        rows = rows.join(side, (F.col("net") == F.col(f"{role}_net")) & (F.col(key) == F.col(f"{role}_s")), "left")
    de, dn, dh = (F.col(f"t_{c}") - F.col(f"f_{c}") for c in "xyh")
    kind = F.col("type")
    turned = azimuth(F.col("t_x") - F.col("a_x"), F.col("t_y") - F.col("a_y")) - azimuth(F.col("f_x") - F.col("a_x"), F.col("f_y") - F.col("a_y"))
    value = F.when(kind == "dist", F.hypot(de, dn)).when(kind.isin("bearing", "dir"), azimuth(de, dn)).when(kind == "angle", wrap_two_pi(turned)).when(kind == "lev", dh).when(kind == "zenith", F.atan2(F.hypot(de, dn), dh))
    return rows.withColumn("value", F.coalesce("value", value)).select(*obs.columns)


def pieces_without(edges: DataFrame, station, bypass: tuple | None = None) -> DataFrame:
    """(net, stations, pieces) of every network (edges net, a, b) when a station is taken out, with one more edge ``bypass`` if given: how many
    stations are left that any edge reaches, and into how many pieces they fall."""
    from plumbline.operators.graph import network_components

    rows = edges.filter((F.col("a") != station) & (F.col("b") != station) & (F.col("a") != F.col("b"))).select("net", "a", "b")
    if bypass is not None:
        rows = rows.unionByName(edges.select("net", F.lit(bypass[0]).cast(edges.schema["a"].dataType).alias("a"), F.lit(bypass[1]).cast(edges.schema["b"].dataType).alias("b")).distinct())
    roots = network_components(rows)
    return roots.groupBy("net").agg(F.count(F.lit(1)).alias("stations"), F.count_distinct("root").alias("pieces"))


def complete_linkage(points: DataFrame, by: str, key: str, tolerance: float) -> DataFrame:
    """(by, key, group): points (x, y) of each ``by`` taken in natural order, each put in the first group to all of whose members it is within
    ``tolerance``, else in one of its own. The groups of one ``by`` are held in the task that has it, a box and the points of each."""

    def step(groups, row):
        name, x, y = row
        for i, (box, members) in enumerate(groups):
            near = box[0] - tolerance <= x <= box[1] + tolerance and box[2] - tolerance <= y <= box[3] + tolerance
            if near and all((x - u) ** 2 + (y - v) ** 2 <= tolerance * tolerance for u, v in members):
                members.append((x, y))
                box[:] = [min(box[0], x), max(box[1], x), min(box[2], y), max(box[3], y)]
                return groups, (name, i)
        groups.append(([x, x, y, y], [(x, y)]))
        return groups, (name, len(groups) - 1)

    kinds = {c: points.schema[c].dataType.simpleString() for c in (by, key)}
    rows = points.filter("x is not null and y is not null").withColumns({"x": F.col("x").cast("double"), "y": F.col("y").cast("double")})
    return ordered_scan(rows, [by], [natural_key(key), F.col(key)], [key, "x", "y"], list, step, f"{by} {kinds[by]}, {key} {kinds[key]}, group int")
