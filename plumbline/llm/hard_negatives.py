"""Hard-negative mining: for each anchor its nearest positives, and for each of these the nearest negatives that score close to it.

Method: dual-tree search by inner product. Candidates are dealt out once by a routing tree, so that a block of them lies close together, and
each block is stored with its own ball tree; anchors, a stated set, come in batches of ``BATCH_BYTES``, each with a tree that is broadcast. Two passes run
over the blocks for a batch: one for the positives, one for the negatives between the bounds that the positives set. A pair of nodes is dropped
with all its anchors when the interval of its inner products lies outside what any of them can use; leaf pairs are scored exactly. What an anchor
must reach starts from a bounded sample of rows and rises as blocks are seen. Tasks hand on a few hits for each anchor.

The routing tree is fitted on about ``SAMPLE_ROWS`` rows or ``SAMPLE_BYTES`` (those with the least hash of the identifier); it decides only where rows lie, and
every row is searched. A place that holds many rows, such as copies of one vector, is dealt over as many parts as it fills.

Vectors become floor(scale x) by component, as doubles; scores are their exact inner products, or the end of a long's range beyond it.

Defined cases: rows with a null label or vector, or a component that is null or not finite, take no part. A shorter vector counts as one with zeros
behind it, an empty one as zeros. Rows with a null identifier take part as candidates, after all others of their score. Repeated rows are rows of
their own: an anchor's copies are positives of it, and each copy of an anchor gives its results again. An anchor without positives, and a positive
without negatives in its range, give no rows. An empty table gives an empty result. Other columns are not read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from plumbline.llm.common import arrow_rows, cut, emit_rows, pack, table, unpack
from plumbline.llm.dual_tree import HIGHEST, LOWEST, TYPES, Negatives, Positives, Tree, build

SCALE = 256
POSITIVES = 5
NEGATIVES = 5
#: A negative's score is at least so many hundredths of the positive's.
LEAST_PERCENT = 80
#: Rows of a part that rows are dealt to, of a block at most, and of a leaf.
PART_ROWS, BLOCK_ROWS, LEAF_ROWS, ANCHOR_LEAF = 2048, 4096, 256, 64
SAMPLE_ROWS, SAMPLE_BYTES, BATCH_BYTES = 20_000, 16 << 20, 16 << 20
#: Sample rows that anchors are scored against first.
SEED_ROWS = 2048
#: Stored blocks that a task takes at once.
BLOCKS_AT_ONCE = 8

_KINDS = (np.int16, np.int32, np.float64)
_HITS = [("group", "long"), ("score", "long"), ("id", "long"), ("own", "boolean")]


def prepared(ids: pa.Array, labels: pa.Array, vectors: pa.Array, dim: int, scale: float) -> tuple[np.ndarray, ...]:
    """(places, identifiers, which have none, labels, vectors of whole numbers) of the rows that take part."""
    vectors = vectors.combine_chunks() if isinstance(vectors, pa.ChunkedArray) else vectors
    parent = pc.list_parent_indices(vectors).to_numpy(zero_copy_only=False)
    values = pc.list_flatten(vectors).to_numpy(zero_copy_only=False).astype(np.float64)
    rows = np.zeros((len(vectors), dim))
    at = np.arange(len(parent)) - np.searchsorted(parent, parent)
    rows[parent, at] = np.floor(scale * values)
    good = np.isfinite(rows).all(1) & pc.is_valid(vectors).to_numpy(zero_copy_only=False) & pc.is_valid(labels).to_numpy(zero_copy_only=False)
    places = np.flatnonzero(good)
    no_id = pc.is_null(ids).to_numpy(zero_copy_only=False)[places]
    whole = lambda column: pc.fill_null(column.cast(pa.int64()), 0).to_numpy(zero_copy_only=False)[places]
    return places, np.where(no_id, HIGHEST, whole(ids)), no_id, whole(labels), rows[places]


class Router:
    """A complete binary tree of planes, fitted on a sample; its leaves are numbered so that neighbours lie close."""

    def __init__(self, sample: np.ndarray, depth: int):
        self.depth = depth
        self.planes, self.cuts = np.zeros(((1 << depth) - 1, sample.shape[1])), np.zeros((1 << depth) - 1)
        inside = {0: sample}
        for node in range(len(self.cuts)):
            x = inside.pop(node)
            if len(x) > 1:
                far = x[((x - x.mean(0)) ** 2).sum(1).argmax()]
                self.planes[node] = x[((x - far) ** 2).sum(1).argmax()] - far
                on = x @ self.planes[node]
                self.cuts[node] = np.median(on)
                # Where half of the sample is alike, it goes to one side.
            right = x @ self.planes[node] >= self.cuts[node]
            inside[2 * node + 1], inside[2 * node + 2] = x[~right], x[right]

    def cells(self, rows: np.ndarray) -> np.ndarray:
        node = np.zeros(len(rows), np.int64)
        for _ in range(self.depth):
            right = (rows * self.planes[node]).sum(1) >= self.cuts[node]
            node = 2 * node + 1 + right
        return node - ((1 << self.depth) - 1)


def _kind(rows: np.ndarray) -> int:
    """The smallest type that holds all components."""
    largest = np.abs(rows).max(initial=0)
    return 0 if largest < 1 << 15 else 1 if largest < 1 << 31 else 2


def _dealt(rows: DataFrame, dim: int, scale: float, router: Router, widths: np.ndarray) -> DataFrame:
    """(part, id, label, kind, vector) of the rows that take part; a cell's rows go to its ``widths`` parts in turn."""
    first = np.concatenate([[0], np.cumsum(widths)[:-1]])

    def make():
        seen = 0

        def fn(batch):
            nonlocal seen
            _, ids, no_id, labels, rows = prepared(*batch.columns, dim, scale)
            cells = router.cells(rows)
            parts = first[cells] + np.arange(seen, seen + len(rows)) % widths[cells]
            seen += len(rows)
            kind = _kind(rows)
            size = dim * np.dtype(_KINDS[kind]).itemsize
            ends = pa.py_buffer(np.arange(0, size * len(rows) + 1, max(size, 1), np.int32)[: len(rows) + 1] if size else np.zeros(len(rows) + 1, np.int32))
            vectors = pa.Array.from_buffers(pa.binary(), len(rows), [None, ends, pa.py_buffer(rows.astype(_KINDS[kind]).tobytes())])
            yield parts, pa.array(ids, mask=no_id), labels, np.full(len(rows), kind), vectors

        return fn

    return emit_rows(rows, make, [("part", "long"), ("id", "long"), ("label", "long"), ("kind", "long"), ("vector", "binary")], rows=PART_ROWS)


def _blocks(dealt: DataFrame, dim: int) -> DataFrame:
    """(kind, tree, rows): one block of close rows each, the tree apart from what its leaves hold."""

    def block(ids, labels, kinds, vectors):
        rows = np.empty((len(vectors), dim))
        kinds = np.array(kinds)
        for k in np.unique(kinds):
            own = np.flatnonzero(kinds == k)
            rows[own] = np.frombuffer(b"".join(vectors[i] for i in own), _KINDS[k]).reshape(len(own), dim)
        no_id = np.array([i is None for i in ids])
        tree = build(rows, np.array(labels, np.int64), np.array([HIGHEST if i is None else i for i in ids], np.int64), no_id, LEAF_ROWS)
        kind = _kind(rows)
        return [kind], [pack(*(column.ravel() for column in tree.nodes))], [pack(tree.rows.astype(_KINDS[kind]).ravel(), tree.labels, tree.ids, tree.no_id)]

    def make():
        waiting = [], [], [], []
        part_of = None

        def flush():
            if waiting[0]:
                yield block(*waiting)
                for column in waiting:
                    column.clear()

        def fn(batch):
            nonlocal part_of
            if batch is None:
                yield from flush()
                return
            parts, *columns = (c.to_pylist() for c in batch.columns)
            start = 0
            for end in range(1, len(parts) + 1):
                if end == len(parts) or parts[end] != parts[start] or end - start == BLOCK_ROWS:
                    if parts[start] != part_of or len(waiting[0]) + end - start > BLOCK_ROWS:
                        yield from flush()
                    part_of = parts[start]
                    for column, values in zip(waiting, columns, strict=True):
                        column.extend(values[start:end])
                    start = end

        return fn

    return emit_rows(dealt, make, [("kind", "long"), ("tree", "binary"), ("rows", "binary")], finish=True, rows=PART_ROWS)


def stored_tree(kind: int, nodes: bytes, held: bytes, dim: int) -> Tree:
    starts, ends, kids, centers, *rest = unpack(nodes, *TYPES)

    def load():
        rows, *others = unpack(held, _KINDS[kind], np.int64, np.int64, np.bool_)
        return rows.reshape(-1, dim), *others

    return Tree((starts, ends, kids.reshape(-1, 2), centers.reshape(-1, dim), *rest), load)


def index(rows: DataFrame, scale: float = SCALE) -> tuple[DataFrame, Tree | None, int]:
    """The stored blocks of all ``rows`` (id, label, vector), a tree over some of the sample, and the vectors' dimension."""
    seen = rows.agg(F.count(F.lit(1)).alias("n"), F.max(F.size("vector")).alias("dim")).first()
    n, dim = seen["n"], max(1, seen["dim"] or 0)
    most = max(1, min(SAMPLE_ROWS, SAMPLE_BYTES // (8 * dim)))
    some = rows.filter(F.pmod(F.xxhash64("id"), F.lit(max(n, 1))) < most).limit(2 * most).toArrow()
    _, ids, no_id, labels, vectors = prepared(*some.columns, dim, scale)
    depth = max(0, min(n // PART_ROWS, len(vectors) // 16) - 1).bit_length()
    router = Router(vectors, depth)
    share = np.bincount(router.cells(vectors), minlength=1 << depth) / max(1, len(vectors))
    widths = np.maximum(1, np.ceil(share * n / PART_ROWS)).astype(np.int64)
    dealt = _dealt(rows, dim, scale, router, widths).repartition("part").sortWithinPartitions("part")
    sample = build(vectors[:SEED_ROWS], labels[:SEED_ROWS], ids[:SEED_ROWS], no_id[:SEED_ROWS], LEAF_ROWS) if len(vectors) else None
    return cut(_blocks(dealt, dim), "negatives-blocks"), sample, dim


def _first_hits(blocks: DataFrame, dim: int, looking: Positives | Negatives) -> DataFrame:
    """(group, score, id, own, rank) of the first hits of each group over all blocks."""
    shared = blocks.sparkSession.sparkContext.broadcast((looking.a.nodes, looking.a.held, looking.best.least, getattr(looking, "most", None)))
    k = looking.best.k

    def make():
        nodes, held, least, most = shared.value
        a = Tree(nodes, lambda: held)
        if most is None:
            found = Positives(a, k)
            found.best.least = least.copy()
        else:
            found = Negatives(a, least.copy(), most, k)

        def fn(batch):
            if batch is None:
                group, score, ids, no_id, own = found.best.settle()
                yield group, score, pa.array(ids, mask=no_id), own
                return
            for block in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                found.visit(stored_tree(*block, dim))

        return fn

    hits = emit_rows(blocks, make, _HITS, finish=True, rows=BLOCKS_AT_ONCE)
    order = Window.partitionBy("group").orderBy(F.col("score").desc(), F.col("id").asc_nulls_last())
    return hits.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


def _batch(blocks: DataFrame, sample: Tree, dim: int, anchors: pa.Table, scale: float, positives: int, negatives: int, least_percent: int) -> DataFrame | None:
    """The negatives of a batch of anchors (id, label, vector, copies)."""
    places, ids, no_id, labels, vectors = prepared(*anchors.select(["id", "label", "vector"]).columns, dim, scale)
    if not len(places):
        return None
    spark = blocks.sparkSession
    a = build(vectors, labels, places, np.zeros(len(places), bool), ANCHOR_LEAF)  # the places, in the tree's order
    at = np.searchsorted(places, a.ids)
    copies = anchors.column("copies").to_numpy()[a.ids]
    a = Tree(a.nodes, lambda held=(a.rows, a.labels, ids[at], no_id[at]): held)

    looking = Positives(a, positives + 1)
    looking.visit(sample)
    looking.best.settle()
    # One hit more than positives for each anchor: a batch bounds them.
    found = _first_hits(blocks, dim, looking).orderBy("group", "rank").toArrow()
    group, own = found.column("group").to_numpy(), found.column("own").to_numpy().astype(bool)
    own_before = np.cumsum(own) - own
    own &= own_before == own_before[np.searchsorted(group, group)]  # an anchor's first copy is the anchor itself
    group, found = group[~own], found.filter(pa.array(~own))
    nth = np.arange(len(group)) - np.searchsorted(group, group)
    group, nth, found = group[nth < positives], nth[nth < positives], found.filter(pa.array(nth < positives))
    if not len(group):
        return None
    score = found.column("score").to_numpy()
    most = np.full((len(places), positives), LOWEST)
    most[group, nth] = score
    least = np.full(most.shape, HIGHEST)
    least[group, nth] = [-(-least_percent * s // 100) for s in score.tolist()]

    looking = Negatives(a, least, most, negatives)
    looking.visit(sample)
    looking.best.settle()
    hits = _first_hits(blocks, dim, looking)
    names = pa.table({
        "of": group * positives + nth, "anchor_id": pa.array(a.ids[group], mask=a.no_id[group]), "positive_id": found.column("id"), "positive_score": score, "copies": copies[group],
    })
    hits = hits.join(F.broadcast(spark.createDataFrame(names)), F.col("group") == F.col("of"))
    hits = hits.withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies"))))
    hits = hits.select("anchor_id", "positive_id", F.col("rank").cast("int").alias("rank"), F.col("id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score"))
    return cut(hits, "negatives-found")


def mine(
    rows: DataFrame,
    anchors: DataFrame,
    scale: float = SCALE,
    positives: int = POSITIVES,
    negatives: int = NEGATIVES,
    least_percent: int = LEAST_PERCENT,
) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score and negative_score. ``rows`` and ``anchors``, which are
    some of them, have the columns id, label and vector."""
    spark = rows.sparkSession
    columns = [F.col("id").cast("long").alias("id"), F.col("label").cast("long").alias("label"), "vector"]
    rows, anchors = rows.select(*columns), anchors.select(*columns)
    with arrow_rows(spark, PART_ROWS):
        blocks, sample, dim = index(rows, scale)
        known = anchors.filter("label is not null and vector is not null").groupBy("id", "label", "vector").agg(F.count(F.lit(1)).alias("copies"))
        known = cut(known, "negatives-anchors")
        batches = -(-known.count() * 8 * dim // BATCH_BYTES)
        known = known.withColumn("batch", F.pmod(F.xxhash64("id", "label", "vector"), F.lit(max(1, batches))))
        out = spark.createDataFrame([], "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long")
        if sample is not None:
            for b in range(batches):
                batch = known.filter(F.col("batch") == b).drop("batch").toArrow()
                if (found := _batch(blocks, sample, dim, batch, scale, positives, negatives, least_percent)) is not None:
                    out = out.unionByName(found)
    return out


def op13_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    rows = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), label.alias("label"), F.col("embedding").alias("vector"))
    return mine(rows, rows.filter(F.col("id") % 100 == 0))


OP13_SQL = """
WITH r AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS q
  FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL AND list_count(embedding) = len(embedding) AND len(list_filter(embedding, lambda x: NOT isfinite(x))) = 0
), s AS (
  SELECT a.vec_id AS anchor_id, b.vec_id AS id, a.label = b.label AS same, CAST(list_inner_product(a.q, b.q) AS BIGINT) AS score
  FROM r a JOIN r b ON a.vec_id % 100 = 0 AND a.vec_id <> b.vec_id
), p AS (
  SELECT anchor_id, id AS positive_id, score AS positive_score FROM s WHERE same QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, id) <= 5
)
SELECT p.anchor_id, positive_id, CAST(row_number() OVER (PARTITION BY p.anchor_id, positive_id ORDER BY score DESC, id) AS INTEGER) AS rank,
  id AS negative_id, positive_score, score AS negative_score
FROM p JOIN s ON s.anchor_id = p.anchor_id AND NOT same AND 80 * positive_score <= 100 * score AND score <= positive_score
QUALIFY rank <= 5
"""
