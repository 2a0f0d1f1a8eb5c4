import heapq
import random
import zlib

from plumbline.llm import sharding
from tests.llm.fixtures import awkward, documents


def lpt(sizes, shards):
    heap = [(0, j) for j in range(shards)]
    for s in sorted(sizes, reverse=True):
        load, j = heap[0]
        heapq.heapreplace(heap, (load + s, j))
    return sorted(load for load, _ in heap)


def test_deal_is_the_heap():
    r = random.Random(2)
    for _ in range(200):
        sizes = [r.choice([1, 2, 5, 7, 30, 1000]) for _ in range(r.randint(0, 60))]
        runs = [(s, sizes.count(s)) for s in sorted(set(sizes), reverse=True)]
        k = r.randint(1, 9)
        loads = [0] * k
        for (s, n), taken in zip(runs, sharding.deal(runs, k)):
            assert sum(taken) == n
            loads = [x + s * t for x, t in zip(loads, taken)]
        assert sorted(loads) == lpt(sizes, k)


def test_documents(spark, monkeypatch):
    monkeypatch.setattr(sharding, "BUCKET_ROWS", 50)  # several buckets
    docs = documents(None)
    rows = sharding.assign(spark.createDataFrame(docs, "doc_id long, text string")).collect()
    text = dict(docs)
    assert sorted(r["doc_id"] for r in rows) == sorted(text)
    groups, loads, slots = {}, [0] * 8, [[] for _ in range(8)]
    for r in rows:
        raw = text[r["doc_id"]].encode()
        assert (r["size"], r["text_crc32"], r["law"], r["grown_shard"]) == (len(raw) + 1, zlib.crc32(raw), "bytes", None)
        assert groups.setdefault(raw, r["shard"]) == r["shard"]
        loads[r["shard"]] += r["size"]
        slots[r["shard"]].append(r["slot"])
    assert all(sorted(s) == list(range(len(s))) for s in slots)
    by_group: dict = {}
    for t in text.values():
        by_group[t] = by_group.get(t, 0) + len(t.encode()) + 1
    best = lpt(by_group.values(), 8)
    assert max(loads) <= best[-1] * 1.002 + 10 and max(loads) - min(loads) <= 0.01 * max(loads)


def test_awkward(spark):
    rows = sharding.assign(awkward(spark, ["a", "a", "", "b" * 100000])).collect()
    assert len(rows) == 7
    assert len({r["shard"] for r in rows if r["size"] == 2}) == 1
    for shard in {r["shard"] for r in rows}:
        slots = sorted(r["slot"] for r in rows if r["shard"] == shard)
        assert slots == list(range(len(slots)))
    assert sharding.assign(awkward(spark, ["a"]).filter("doc_id < 0")).collect() == []


def test_rows_repeated_very_often_are_written_out_in_parts(spark, monkeypatch):
    monkeypatch.setattr(sharding, "COPIES_AT_ONCE", 7)
    docs = spark.createDataFrame([(1, "a")] * 50 + [(2, "b")] * 7 + [(3, "c")], "doc_id long, text string")
    rows = sharding.assign(docs, shards=1).collect()
    assert sorted(r["slot"] for r in rows) == list(range(58))
    assert sorted(r["doc_id"] for r in rows) == [1] * 50 + [2] * 7 + [3]
