import math

import duckdb
import numpy as np
from plumbline.llm import hard_negatives as h
from plumbline.llm.dual_tree import HIGHEST, Negatives, Positives, build
from tests.llm.fixtures import SF

SCHEMA = "id long, label int, vector array<float>"


def brute(rows, anchor_at, positives=5, negatives=5, percent=80):
    """Sorted results of (id, label, vector) rows, of which those at ``anchor_at`` are anchors."""
    def quantised(v):
        if v is None or any(x is None or not math.isfinite(x) for x in v):
            return None
        return [math.floor(256 * float(np.float32(x))) for x in v]

    rows = [(i, label, quantised(v)) for i, label, v in rows]
    dot = lambda a, b: sum(x * y for x, y in zip(a, b))
    key = lambda r: (-r[0], r[1] is None, r[1] or 0)
    out = []
    for at in anchor_at:
        anchor, label, q = rows[at]
        if label is None or q is None:
            continue
        all_ = [(dot(q, v), i, other == label) for j, (i, other, v) in enumerate(rows) if j != at and other is not None and v is not None]
        for p, pid, _ in sorted((r for r in all_ if r[2]), key=key)[:positives]:
            near = sorted((r for r in all_ if not r[2] and percent * p <= 100 * r[0] <= 100 * p), key=key)[:negatives]
            out += [(anchor, pid, k + 1, nid, p, n) for k, (n, nid, _) in enumerate(near)]
    return sorted(out, key=repr)


def mined(spark, rows, anchor_at, **options):
    df = spark.createDataFrame(rows, SCHEMA)
    return sorted(map(tuple, h.mine(df.repartition(4), spark.createDataFrame([rows[i] for i in anchor_at], SCHEMA), **options).collect()), key=repr)


def test_sql(spark):
    got = h.op13_hard_negatives(spark, SF)
    con = duckdb.connect()
    con.execute(f"CREATE VIEW embeddings AS SELECT * FROM '{SF}/embeddings.parquet'")
    ref = con.sql(h.OP13_SQL)
    assert got.columns == ref.columns
    assert sorted(map(tuple, got.collect())) == sorted(ref.fetchall()) != []


def test_clusters_copies_ties_and_nulls(spark, monkeypatch):
    for name, n in (("PART_ROWS", 40), ("BLOCK_ROWS", 30), ("LEAF_ROWS", 8), ("ANCHOR_LEAF", 4), ("SEED_ROWS", 50), ("BATCH_BYTES", 16 * 8 * 20)):
        monkeypatch.setattr(h, name, n)
    r = np.random.default_rng(3)
    centers = r.normal(size=(6, 16))
    rows = [(i, int(r.integers(4)), (centers[i % 6] + 0.2 * r.normal(size=16)).tolist()) for i in range(400)]
    rows += [(1000 + i, i % 3, rows[5][2]) for i in range(120)]  # copies of one vector
    rows += [rows[0], rows[0], rows[7], (7, 1, rows[9][2])]  # repeated rows, and one identifier twice
    rows += [(2000, 1, None), (2001, None, rows[1][2]), (2002, 2, [None] * 16), (2003, 2, [math.nan] * 16), (2004, 2, [math.inf] + [0.0] * 15), (None, 1, rows[3][2]), (None, 2, rows[3][2])]
    rows += [(2005, 3, []), (2006, 1, [1.5]), (2007, 1, [-3.0] * 16)]
    anchor_at = [*range(0, 400, 9), 400, 401, 520, 521, 522, 523, 524, 525, 526, 531, 532, 533]
    assert mined(spark, rows, anchor_at) == brute(rows, anchor_at)
    assert mined(spark, rows, anchor_at, positives=2, negatives=9, least_percent=40) == brute(rows, anchor_at, 2, 9, 40)


def test_large_components_are_exact(spark):
    r = np.random.default_rng(5)
    rows = [(i, i % 2, [float(np.float32(x)) for x in r.normal(size=3) * 10.0 ** r.integers(0, 5)]) for i in range(60)]
    assert mined(spark, rows, [0, 1, 2]) == brute(rows, [0, 1, 2])
    huge = [(i, i % 2, [2.0**40 + i * 2.0**20, 1.0]) for i in range(20)]
    got = mined(spark, huge, [0])
    assert got and {r[4] for r in got} == {HIGHEST}  # beyond a long they stand at its end


def test_empty(spark):
    assert mined(spark, [], []) == []
    assert mined(spark, [(1, None, [1.0])], [0]) == []
    assert mined(spark, [(1, 2, [1.0])], [0]) == []


def test_pairs_of_nodes_are_pruned():
    r = np.random.default_rng(8)
    centers = r.normal(size=(20, 32)) * 100
    rows = np.floor(np.repeat(centers, 200, 0) + r.normal(size=(4000, 32)))
    labels, ids = np.repeat(np.arange(20) // 2, 200), np.arange(4000)
    none = np.zeros(4000, bool)
    tree = build(rows, labels, ids, none, 64)
    a = build(rows[::20], labels[::20], ids[::20], none[::20], 16)
    sample = build(rows[::7], labels[::7], ids[::7], none[::7], 64)
    first = Positives(a, 6)
    first.visit(sample)
    first.best.settle()
    looking = Positives(a, 6)
    looking.best.least = first.best.least
    done, pairs = looking.visit(tree)
    assert done < 0.15 * pairs
    s = a.rows @ rows.T
    for g in range(0, 200, 7):
        own = sorted((-s[g, j], j) for j in np.flatnonzero(labels == a.labels[g]))[:6]
        group, score, found, _, _ = looking.best.settle()
        assert [(-x, y) for x, y in zip(score[group == g], found[group == g])] == own
    top = np.array([[s[g].max() * 0.9] for g in range(200)]).astype(np.int64)
    away = Negatives(a, top * 8 // 10, top, 5)
    done, pairs = away.visit(tree)
    assert done < 0.5 * pairs
