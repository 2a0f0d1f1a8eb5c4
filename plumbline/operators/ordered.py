"""Ordered analytics: forward fills, sessions, running sums, slices, ranks, queues. All are windows by an own
key, so they scale with the number of keys; a rank over everything is a bounded top-k instead."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.window import Window

from plumbline.tables import cut


def forward_fill(df: DataFrame, columns: list[str], by: list[str], order: list[Column]) -> DataFrame:
    w = Window.partitionBy(*by).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return df.withColumns({c: F.last(c, ignorenulls=True).over(w) for c in columns})


def sessions(df: DataFrame, marker: Column, by: list[str], order: list[Column], name: str = "session") -> DataFrame:
    """Running number of markers: rows of a session follow its marker; 0 before the first."""
    w = Window.partitionBy(*by).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return df.withColumn(name, F.sum(marker.cast("int")).over(w))


def slices(df: DataFrame, start: str, end: Column, by: list[str]) -> DataFrame:
    """Each row's slice ends where the next one starts, the last at ``end``."""
    w = Window.partitionBy(*by).orderBy(start)
    return df.withColumn("slice_end", F.coalesce(F.lead(start).over(w), end))


def changes(df: DataFrame, column: str, by: list[str], order: list[Column]) -> DataFrame:
    """Rows whose value differs from the one before; the first row of a key too."""
    before = F.lag(column).over(Window.partitionBy(*by).orderBy(*order))
    return df.withColumn("__before", before).filter(~F.col(column).eqNullSafe(F.col("__before")) | F.col("__before").isNull()).drop("__before")


def occurrence_keys(df: DataFrame, key: str, order: list[Column], name: str = "unique_key") -> DataFrame:
    """``key`` for its first row, then ``key#2``, ``key#3``..."""
    n = F.row_number().over(Window.partitionBy(key).orderBy(*order))
    return df.withColumn("__n", n).withColumn(name, F.when(F.col("__n") == 1, F.col(key)).otherwise(F.concat_ws("#", key, F.col("__n")))).drop("__n")


def balance_traverse(legs: DataFrame, by: str, order: list[Column], de: str = "de", dn: str = "dn", method: str = "bowditch") -> DataFrame:
    """Traverse legs with corrected components and running coordinates: misclosure shared by length (``bowditch``)
    or by each component's size (``transit``); e, n are coordinates after the leg from 0, 0."""
    whole = Window.partitionBy(by)
    running = Window.partitionBy(by).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    length = F.hypot(F.col(de), F.col(dn))
    share = lambda part: F.when(F.sum(part).over(whole) > 0, part / F.sum(part).over(whole)).otherwise(0.0)
    se, sn = (share(length), share(length)) if method == "bowditch" else (share(F.abs(de)), share(F.abs(dn)))
    out = legs.withColumns({"close_e": F.sum(de).over(whole), "close_n": F.sum(dn).over(whole), "share_e": se, "share_n": sn})
    out = out.withColumns({"adj_de": F.col(de) - F.col("close_e") * F.col("share_e"), "adj_dn": F.col(dn) - F.col("close_n") * F.col("share_n")})
    return out.withColumns({"e": F.sum("adj_de").over(running), "n": F.sum("adj_dn").over(running)})


def stationing(segments: DataFrame, by: str, order: list[Column], length: str) -> DataFrame:
    """Start and end station of each segment along its alignment."""
    w = Window.partitionBy(by).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return segments.withColumn("end_station", F.sum(length).over(w)).withColumn("start_station", F.col("end_station") - F.col(length))


def station_points(segments: DataFrame, interval: float) -> DataFrame:
    """A row for each multiple of ``interval`` in [start_station, end_station)."""
    first = F.ceil(F.col("start_station") / interval).cast("long")
    last = (F.ceil(F.col("end_station") / interval) - 1).cast("long")
    rows = segments.filter(first <= last).withColumn("__k", F.explode(F.sequence(first, last)))
    return rows.withColumn("station", F.col("__k") * interval).drop("__k")


def top_k(df: DataFrame, by: list[str], order: list[Column], k: int) -> DataFrame:
    return df.withColumn("rank", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).filter(F.col("rank") <= k)


def ranked(df: DataFrame, order: list[Column], k: int) -> DataFrame:
    """The first k rows in an order, numbered. Spark takes k rows from each task, so the numbering window sees k rows."""
    return df.orderBy(*order).limit(k).withColumn("rank", F.row_number().over(Window.orderBy(*order)))


def due_queue(units: DataFrame, now: Column, new_cap: int = 5, limit: int = 25) -> DataFrame:
    """Review queue: by group (source review 0, learning 1, review 2, new 3, practice 4), due, priority, id; only due
    rows of groups 1 and 2, at most ``new_cap`` new ones, ``limit`` in all. Needs group, due, priority, unit_id."""
    due = units.filter(F.col("group").isin(0, 3, 4) | (F.col("due") <= now))
    order = [F.col("group"), F.col("due").asc_nulls_first(), F.col("priority"), F.col("unit_id")]
    fresh = due.filter("group = 3").orderBy(*order).limit(new_cap)
    return ranked(due.filter("group <> 3").unionByName(fresh), order, limit)


def review_rows(sources: list[DataFrame]) -> tuple[DataFrame, list[Column]]:
    """Rows of several sources (severity, source, line, item) as one queue, and its order: by severity, source, line, item."""
    severity = F.when(F.col("severity") == "high", 0).when(F.col("severity") == "medium", 1).otherwise(2)
    rows = sources[0]
    for more in sources[1:]:
        rows = rows.unionByName(more, allowMissingColumns=True)
    return rows.withColumn("severity_rank", severity), [F.col("severity_rank"), F.col("source"), F.col("line").asc_nulls_last(), F.col("item")]


def numbered(df: DataFrame, order: list[Column], name: str = "rank") -> DataFrame:
    """``df`` with every row's place in an order, from 1 on. Rows are sorted by ranges, a range in a task; only each range's
    number of rows is added up in one place."""
    rows = df.orderBy(*order).withColumns({"__range": F.spark_partition_id(), "__at": F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))})
    rows = cut(rows, "numbered")
    before = Window.orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)
    ends = rows.groupBy("__range").agg(F.count(F.lit(1)).alias("__n"))  # a row for each task
    starts = ends.select(F.col("__range").alias("__of"), F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__start"))
    out = rows.join(starts, F.col("__range") == F.col("__of"))
    return out.withColumn(name, F.col("__start") + F.col("__at") + 1).drop("__range", "__at", "__of", "__start")


def _by_key(df: DataFrame, keys: list[str], order: list[Column], columns: list[str], start, step, finish, schema: str) -> DataFrame:
    names = [f"__o{i}" for i in range(len(order))]
    rows = df.select(*keys, *columns, *(o.alias(n) for n, o in zip(names, order)))
    rows = rows.repartition(*keys).sortWithinPartitions(*keys, *names).select(*keys, *columns)
    out_schema = T.StructType.fromDDL(schema)
    k = len(keys)

    def run(batches):
        arrow, done, own, state = to_arrow_schema(out_schema), [], None, None

        def full():
            out = pa.RecordBatch.from_pylist([dict(zip(arrow.names, r)) for r in done], arrow)
            done.clear()
            return out

        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns)):
                if own is None or row[:k] != own:
                    if own is not None and finish:
                        done.append((*own, *finish(state)))
                    own, state = row[:k], start()
                if finish:
                    state = step(state, row[k:])
                else:
                    state, out = step(state, row[k:])
                    done.append((*own, *out))
                if len(done) >= 1000:
                    yield full()
        if own is not None and finish:
            done.append((*own, *finish(state)))
        yield full()

    return rows.mapInArrow(run, out_schema)


def ordered_fold(df: DataFrame, keys: list[str], order: list[Column], columns: list[str], start, step, finish, schema: str) -> DataFrame:
    """A row for each key from its rows in an order: ``step(state, row)`` from ``start()`` on, then ``finish(state)``, whose tuple
    follows the keys in ``schema``. Rows are dealt out by key and sorted; a task holds one state and one batch, so a key may have any
    number of rows."""
    return _by_key(df, keys, order, columns, start, step, finish, schema)


def ordered_scan(df: DataFrame, keys: list[str], order: list[Column], columns: list[str], start, step, schema: str) -> DataFrame:
    """As ``ordered_fold``, with a row for each row: ``step(state, row)`` gives (state, tuple)."""
    return _by_key(df, keys, order, columns, start, step, None, schema)
