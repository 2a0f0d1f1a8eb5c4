import hashlib
import math
import re

import duckdb
import pytest
from plumbline.llm import mixing
from tests.llm.fixtures import SF, awkward

WORD = re.compile(r"[^\x20\x09-\x0D]+")
SCHEMA = "doc_id long, text string, source string"


def targets(sizes, weights=(5, 2, 1), share=1.0, most=3):
    """Targets by resharing what is above, round after round."""
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: weights[i % len(weights)] for i, s in enumerate(order)}
    total = share * sum(sizes.values())
    target = {s: total * weight[s] / sum(weight.values()) for s in order}
    while True:
        above = [s for s in order if target[s] > most * sizes[s]]
        if not above:
            return target
        excess = sum(target[s] - most * sizes[s] for s in above)
        for s in above:
            target[s] = most * sizes[s]
        open_ = [s for s in order if target[s] < most * sizes[s]]
        for s in open_:
            target[s] += excess * weight[s] / sum(weight[x] for x in open_)
        if not open_:
            return target


def brute(rows, seed=11):
    """Sorted (doc_id, size, source_size, target, taken) of (doc_id, text, source)."""
    sizes, members = {}, {}
    for i, text, source in rows:
        n = len(WORD.findall(text or ""))
        sizes[source] = sizes.get(source, 0) + n
        members.setdefault(source, []).append((n, i is not None, i or 0, i))
    goal, out = targets(sizes), []
    for nth, source in enumerate(sorted(sizes, key=lambda s: (s is None, s or ""))):
        r = goal[source] / sizes[source] if sizes[source] else 0.0
        u = (int(hashlib.md5(f"{seed}:{nth}".encode()).hexdigest()[:4], 16) + 0.5) / 65536
        for place, (n, _, _, i) in enumerate(sorted(members[source], key=lambda m: m[:3])):
            times = math.floor(r * (place + 1) + u) - math.floor(r * place + u)
            out.append((i, n, sizes[source], goal[source], min(times, 3) * n))
    return out


def same(got, want):
    key = lambda r: (r[0] is None, r[0] or 0, *r[1:3], r[4])
    got, want = sorted(map(tuple, got), key=key), sorted(want, key=key)
    assert [r[:3] + r[4:] for r in got] == [r[:3] + r[4:] for r in want]
    assert all(math.isclose(a[3], b[3], rel_tol=1e-9) for a, b in zip(got, want))


def result(spark, rows, **options):
    return mixing.copies(spark.createDataFrame(rows, SCHEMA).repartition(3), **options).select("doc_id", "size", "source_size", "target", "taken").collect()


def test_sql(spark):
    got = mixing.op11_mixing(spark, SF)
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{SF}/documents.parquet'")
    ref = con.sql(mixing.OP11_SQL)
    assert got.columns == ref.columns
    same(got.collect(), ref.fetchall())


def test_words_taken_come_near_the_target(spark):
    rows = mixing.op11_mixing(spark, SF).join(spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "source"), "doc_id").collect()
    total = sum(r["size"] for r in rows)
    assert math.isclose(sum({r["source"]: r["target"] for r in rows}.values()), total, rel_tol=1e-9)
    for source in {r["source"] for r in rows}:
        own = [r for r in rows if r["source"] == source]
        # Sizes rise along the order, so the error is at most the largest size.
        assert abs(sum(r["taken"] for r in own) - own[0]["target"]) <= max(r["size"] for r in own) + 1e-6
        assert all(r["taken"] <= 3 * r["size"] for r in own)


@pytest.mark.parametrize("n", [1, 2, 7])
def test_many_small_sources(spark, n):
    rows = [(i, "w " * ((i * 7919) % 23), None if i % (n + 1) == n else f"s{i % (n + 1)}") for i in range(300)]
    same(result(spark, rows), brute(rows))


def test_awkward_rows(spark):
    rows = [(1, "a b c", "x"), (1, "a b c", "x"), (1, "a b c", "x"), (2, None, "x"), (3, "", "y"), (None, "a b c\x1cd", "y"), (None, "p q", None), (4, "w " * 200_000, "\U0001f600"), (5, "e", "￿")]
    same(result(spark, rows), brute(rows))
    same(result(spark, rows[4:5]), brute(rows[4:5]))  # a source without a word
    assert result(spark, []) == []
    docs = awkward(spark, ["a b", "c", ""]).withColumnRenamed("fp", "source").withColumnRenamed("shard", "place")
    assert mixing.copies(docs).count() == 6


def test_one_hot_source_and_copies(spark):
    rows = [(i % 40, "one two three", "hot") for i in range(900)] + [(i, f"{i} x", f"s{i % 5}") for i in range(300)]
    got = result(spark, rows)
    same(got, brute(rows))
    assert sorted(map(tuple, got)) == sorted(map(tuple, result(spark, rows[::-1])))  # reruns agree, whatever the rows' order


def test_every_source_at_its_most(spark):
    rows = [(1, "a b", "x"), (2, "c", "y")]
    got = mixing.copies(spark.createDataFrame(rows, SCHEMA), share=5.0).collect()
    assert [(r["target"], r["taken"]) for r in sorted(got)] == [(6.0, 6), (3.0, 3)]


def test_mixed_rows(spark):
    rows = [(1, "a b", "x"), (2, "c d", "x"), (3, "e f", "y")]
    docs = spark.createDataFrame(rows, SCHEMA)
    out = mixing.mixed(docs, keep=["text", "source"]).collect()
    plan = {r["doc_id"]: r["copies"] for r in mixing.copies(docs).collect()}
    text = {i: t for i, t, _ in rows}
    assert sorted((r["text"], r["copy"]) for r in out) == sorted((text[i], c) for i, n in plan.items() for c in range(1, n + 1))
