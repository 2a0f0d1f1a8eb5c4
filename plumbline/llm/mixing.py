"""Mixing of sources to target weights.

Method: systematic sampling. A document's expected copies are its source's target over its source's size; a prefix sum of them
runs through the source, one random offset is added, and a document is emitted once for each whole number that its
stretch of the sum crosses. So each document gets the whole numbers next to its expected copies, and a source's copies differ from
their expectation by less than one. Documents stand in order of size: then the words taken differ from the target by
about one document's at most, since whatever is taken too much is made good among documents of the same size.

The order is one range sort over all documents by (source, size, identifier), of rows without texts; a prefix sum is a
document's place in it, less the place of its source's first, times the expected copies. A hot source spreads over as many partitions
as its rows fill. Targets come from a table of one row a source, by rounds of one sum each. Nothing is gathered, and nothing runs in Python.

Targets: sources in order of code points, null last, have the weights ``WEIGHTS`` in turn and share ``share`` of all sizes by
them; a target stops at ``MOST_COPIES`` times its source's size, and what is above goes to the others by weight, until none is above.

Defined cases: a null text has size 0, as has an empty one; documents of size 0 get copies like others, which take no words. A source
without words has target 0 and no copies. Null identifiers stand first in their size. Repeated rows are rows of their own; which of
them is copied makes no difference. An empty table gives an empty result. Offsets depend on the seed and the source's place
alone, and so do reruns on the rows' values alone. Other columns are not read, but for those in ``keep``.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.llm.common import cut, numbered, table

WEIGHTS = (5, 2, 1)
MOST_COPIES = 3
SEED = 11
WORD = r"[^\x20\x09-\x0D]+"


def _levelled(sources: DataFrame, total: float, most: int) -> float | None:
    """The words for each unit of weight, once no target is above ``most`` times its source's size; None if all stop there."""
    level, stopped = None, -1
    above = F.lit(False)
    while True:
        held = sources.agg(
            F.count_if(above).alias("stopped"),
            F.coalesce(F.sum(F.when(above, most * F.col("source_size"))), F.lit(0)).alias("words"),
            F.coalesce(F.sum(F.when(~above, F.col("weight"))), F.lit(0)).alias("weight"),
        ).first()
        if not held["weight"]:
            return None
        if held["stopped"] == stopped:
            return level
        stopped = held["stopped"]
        level = (total - held["words"]) / held["weight"]
        above = most * F.col("source_size") < F.lit(level) * F.col("weight")


def copies(
    docs: DataFrame,
    id_col="doc_id",
    text_col="text",
    source_col="source",
    weights: Sequence[int] = WEIGHTS,
    share: float = 1.0,
    most: int = MOST_COPIES,
    seed: int = SEED,
    keep: Sequence[str] = (),
) -> DataFrame:
    """doc_id, source, size, source_size, target, copies and taken of every row, and the columns ``keep`` as a struct ``kept``."""
    size = F.coalesce(F.regexp_count(docs[text_col].cast("string"), F.lit(WORD)), F.lit(0)).cast("long")
    kept = [F.struct(*(docs[k] for k in keep)).alias("kept")] if keep else []
    base = docs.select(docs[id_col].alias("doc_id"), docs[source_col].cast("string").alias("source"), size.alias("size"), *kept)
    # The row's number only tells repeated rows apart, so that a range can end between them.
    base = cut(base.withColumn("row", F.monotonically_increasing_id()), "mix-sizes")
    keys = [F.col("source").asc_nulls_last(), F.col("size").asc(), F.col("doc_id").asc_nulls_first(), F.col("row").asc()]
    placed = numbered(base, keys, "place", "mix-order")

    sources = cut(placed.groupBy("source").agg(F.sum("size").alias("source_size"), F.min("place").alias("first")), "mix-sources")
    sources = numbered(sources, [F.col("source").asc_nulls_last()], "nth", "mix-weights")
    sources = sources.withColumn("weight", F.element_at(F.array(*map(F.lit, weights)), (F.col("nth") % len(weights) + 1).cast("int")))
    total = share * (sources.agg(F.sum("source_size")).first()[0] or 0)
    level = _levelled(sources, total, most)
    full = (most * F.col("source_size")).cast("double")
    target = full if level is None else F.least(full, F.lit(level) * F.col("weight"))
    # Sixteen bits: the offset stays exact when it is added to large sums.
    digits = F.substring(F.md5(F.concat(F.lit(f"{seed}:"), F.col("nth").cast("string")).cast("binary")), 1, 4)
    offset = (F.conv(digits, 16, 10).cast("long") + 0.5) / 65536
    sources = sources.select(
        F.col("source").alias("of_source"), "source_size", "first", target.alias("target"), offset.alias("offset"),
        F.when(F.col("source_size") > 0, target / F.col("source_size")).otherwise(0.0).alias("expected"),
    )

    before = F.col("place") - F.col("first")
    crossed = lambda n: F.floor(F.col("expected") * n + F.col("offset"))
    rows = placed.join(sources, F.col("source").eqNullSafe(F.col("of_source")))
    rows = rows.withColumn("copies", F.least(F.lit(most).cast("long"), crossed(before + 1) - crossed(before)))
    return rows.select("doc_id", "source", "size", "source_size", "target", "copies", (F.col("copies") * F.col("size")).alias("taken"), *(["kept"] if keep else []))


def mixed(docs: DataFrame, keep: Sequence[str], **options) -> DataFrame:
    """The mix itself: the columns ``keep`` of every document, as often as it is taken, with the number of the ``copy``."""
    rows = copies(docs, keep=keep, **options).filter("copies > 0")
    return rows.select("kept.*", F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies"))).alias("copy"))


def op11_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return copies(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


OP11_SQL = r"""
WITH docs AS (
  SELECT doc_id, source, CASE WHEN text IS NULL THEN 0 ELSE len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')) END AS size FROM documents
), placed AS (
  SELECT *, row_number() OVER (PARTITION BY source ORDER BY size, doc_id NULLS FIRST) - 1 AS place FROM docs
), sources AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS source_size, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS nth FROM docs GROUP BY source
), weighted AS (
  SELECT *, CASE nth % 3 WHEN 0 THEN 5 WHEN 1 THEN 2 ELSE 1 END AS weight FROM sources
), levels AS (
  SELECT *, CAST((SELECT sum(size) FROM docs) - coalesce(sum(3 * source_size) OVER (ORDER BY 3.0 * source_size / weight, nth ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS DOUBLE)
    / sum(weight) OVER (ORDER BY 3.0 * source_size / weight, nth ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level
  FROM weighted
), targets AS (
  SELECT source, source_size, nth,
    least(CAST(3 * source_size AS DOUBLE), (SELECT level FROM levels WHERE 3 * source_size >= level * weight ORDER BY 3.0 * source_size / weight, nth LIMIT 1) * weight) AS target
  FROM weighted
), expected AS (
  SELECT *, CASE WHEN source_size > 0 THEN target / source_size ELSE 0.0 END AS r,
    (CAST('0x' || substr(md5('11:' || nth), 1, 4) AS BIGINT) + 0.5) / 65536 AS u
  FROM targets
)
SELECT doc_id, CAST(size AS BIGINT) AS size, source_size, target,
  CAST(least(3, floor(r * (place + 1) + u) - floor(r * place + u)) AS BIGINT) * size AS taken
FROM placed JOIN expected ON placed.source IS NOT DISTINCT FROM expected.source
"""
