"""Sharding of documents into shards of near equal bytes.

Method: longest-processing-time scheduling. Documents of equal text form a group that stays together;
groups, the largest first, go to the least-loaded shard, which a heap gives.

Only the heap runs on the driver, and it sees no groups: groups are counted by size class (their bytes to
``SIZE_BITS`` significant bits, so at most 2 ** (SIZE_BITS - 1) classes for each power of two, however many
rows there are; sizes below 2 ** SIZE_BITS are exact). A class of m groups is dealt out in runs: the shard
on top takes groups until it is no longer the least loaded, and once every shard is within one group of
the others whole rounds are dealt at once. The result is a number of groups for each class and shard. Which groups these
are follows from each group's rank within its class by text hash. Ranks and slots are running counts, made
in two levels (buckets of about ``BUCKET_ROWS`` rows, then within a bucket), so neither one class, one group
nor one shard is ever gathered in a task. Texts are hashed where they are read and never shuffled.

Law: ``bytes``. Copies of one text are one group; where that group alone exceeds an even share, its shard is
as large as the group and the other shards share the rest evenly.

Defined cases: the size of a null text is 1, of the empty text too; they are two groups (null texts are equal to
each other). Repeated rows get a slot each, however many they are. Null identifiers are allowed. Other columns are not read. Empty
shards just have no rows.
"""

from __future__ import annotations

import heapq

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from plumbline.llm.common import cut, table

SHARDS = 8
SIZE_BITS = 12
BUCKET_ROWS = 20_000
#: Repeats of one row that are written out at once.
COPIES_AT_ONCE = 1 << 16


def size_class(size: Column) -> Column:
    """``size`` to SIZE_BITS significant bits."""
    drop = F.greatest(F.lit(0), F.length(F.bin(size)) - SIZE_BITS)
    return F.call_function("shiftleft", F.call_function("shiftright", size, drop), drop)


def deal(runs: list[tuple[float, int]], shards: int) -> list[list[int]]:
    """For each run of (size, groups), largest size first, how many groups each shard takes: longest
    processing time with a heap, ties to the first shard."""
    heap = [(0.0, j) for j in range(shards)]
    out = []
    for size, groups in runs:
        taken = [0] * shards
        while groups:
            if groups >= shards and max(heap)[0] - heap[0][0] < size:
                rounds = groups // shards  # each round gives every shard one group, in the same order
                heap = [(load + rounds * size, j) for load, j in heap]
                heapq.heapify(heap)
                taken = [n + rounds for n in taken]
                groups -= rounds * shards
                continue
            load, j = heap[0]
            n = 1
            if shards > 1:
                next_load, next_j = min(heap[1:3])
                n = max(1, int((next_load - load) // size))
                while n > 1 and (load + (n - 1) * size, j) > (next_load, next_j):
                    n -= 1
            else:
                n = groups
            n = min(n, groups)
            heapq.heapreplace(heap, (load + n * size, j))
            taken[j] += n
            groups -= n
        out.append(taken)
    return out


def _running(rows: DataFrame, keys: list[str], bucket: str, order: list[str], weight: Column, name: str) -> DataFrame:
    """``rows`` with the sum of ``weight`` over the rows before in the order (keys; bucket, order): first over
    whole buckets, whose sums are few, then within a bucket."""
    sums = rows.groupBy(*keys, bucket).agg(F.sum(weight).alias("__sum"))
    before = Window.partitionBy(*keys).orderBy(bucket).rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.select(*(F.col(k).alias(f"__{k}") for k in (*keys, bucket)), F.coalesce(F.sum("__sum").over(before), F.lit(0)).alias("__base"))
    within = Window.partitionBy(*keys, bucket).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("__in", F.coalesce(F.sum(weight).over(within), F.lit(0)))
    on = [F.col(k).eqNullSafe(F.col(f"__{k}")) for k in (*keys, bucket)]
    return rows.join(sums, on).withColumn(name, F.col("__base") + F.col("__in")).drop("__base", "__in", *(f"__{k}" for k in (*keys, bucket)))


def written_out(rows: DataFrame, at_once: int) -> DataFrame:
    """One row for each of ``copies`` slots from ``slot`` on. A row repeated more than ``at_once`` times is first cut
    into parts of so many, which are dealt out to all tasks."""
    first, n = F.col("slot"), F.col("copies")
    few = rows.filter(n <= at_once)
    many = rows.filter(n > at_once).withColumn("__part", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((n - 1) / at_once))))
    start = F.col("__part") * at_once
    many = many.withColumns({"slot": first + start, "copies": F.least(F.lit(at_once), n - start)}).repartition("slot").drop("__part")
    return few.unionByName(many).withColumn("slot", F.explode(F.sequence(first, first + n - 1)))


def assign(docs: DataFrame, id_col="doc_id", text_col="text", shards=SHARDS) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard for every row of ``docs``."""
    text = docs[text_col].cast("string")
    rows = docs.select(
        docs[id_col].alias("doc_id"),
        (F.coalesce(F.octet_length(text), F.lit(0)) + 1).cast("long").alias("size"),
        F.crc32(F.coalesce(text, F.lit("")).cast("binary")).alias("text_crc32"),
        F.coalesce(F.unhex(F.md5(text)), F.lit(b"")).alias("group"),
    )
    # Exact repeats of a row collapse here, on the map side; they come back as slots at the end.
    rows = cut(rows.groupBy("doc_id", "size", "text_crc32", "group").agg(F.count(F.lit(1)).alias("copies")), "shard-rows")
    groups = rows.groupBy("group").agg(F.sum("copies").alias("n"), F.sum(F.col("copies") * F.col("size")).alias("bytes"))
    groups = cut(groups.withColumn("class", size_class(F.col("bytes"))), "shard-groups")

    classes = groups.groupBy("class").agg(F.count(F.lit(1)).alias("groups"), F.sum("bytes").alias("bytes"), F.sum("n").alias("rows")).orderBy(F.desc("class")).collect()
    dealt = deal([(r["bytes"] / r["groups"], r["groups"]) for r in classes], shards)
    spark = docs.sparkSession
    plan = []
    for r, taken in zip(classes, dealt, strict=True):
        ends = [sum(taken[: j + 1]) for j in range(shards)]
        plan.append((r["class"], max(1, r["groups"] // BUCKET_ROWS), ends))
    plan = spark.createDataFrame(plan, "class long, buckets long, ends array<long>")

    # Rank of each group within its class, then its shard. The plan is bounded by the number of classes.
    ranked = groups.join(F.broadcast(plan), "class").withColumn("bucket", F.pmod(F.xxhash64("group"), F.col("buckets")))
    ranked = _running(ranked, ["class"], "bucket", ["group"], F.lit(1).cast("long"), "rank")
    shard_of = ranked.select(F.col("group").alias("__group"), F.size(F.filter("ends", lambda e: e <= F.col("rank"))).alias("shard"))

    total = sum(r["rows"] for r in classes)
    rows = rows.join(shard_of, rows["group"] == shard_of["__group"]).drop("__group")
    rows = cut(rows.withColumn("bucket", F.pmod(F.xxhash64("doc_id", "group"), F.lit(max(1, total // BUCKET_ROWS)))), "shard-placed")
    rows = _running(rows, ["shard"], "bucket", ["doc_id", "group"], F.col("copies"), "slot")
    return written_out(rows, COPIES_AT_ONCE).select(
        "doc_id",
        "size",
        "text_crc32",
        F.lit("bytes").alias("law"),
        "shard",
        "slot",
        F.lit(None).cast("int").alias("grown_shard"),
    )


def op6_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return assign(table(spark, sf_dir, "documents").select("doc_id", "text"))
