import random

import numpy as np
import pytest
from plumbline.llm import near_copies as n
from plumbline.llm import pipeline
from tests.llm.fixtures import documents


def brute(text):
    w = (text or "").lower().split()
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} or {tuple(w)}


def brute_roots(texts):
    sets, root = [brute(t) for t in texts], list(range(len(texts)))

    def top(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(texts)):
        for j in range(i):
            if (both := len(sets[i] & sets[j])) and both * 5 >= 4 * (len(sets[i]) + len(sets[j]) - both):
                root[max(top(i), top(j))] = min(top(i), top(j))
    return [top(i) for i in range(len(texts))]


def stays(spark, texts):
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    return sorted(r["doc_id"] for r in pipeline.near_duplicates(spark, docs, "").collect())


def test_documents(spark):
    texts = [t.encode().decode("ascii", "replace") for _, t in documents(None) if t]
    assert stays(spark, texts) == sorted(set(brute_roots(texts)))


def test_groups_and_chains(spark, monkeypatch):
    """Near copies, a chain whose ends aren't similar, a line that all share, and texts at the limit."""
    r = random.Random(3)
    word = lambda: "".join(r.choice("abcdefgh") for _ in range(5))
    line = [word() for _ in range(30)]
    texts = [" ".join(line + [word() for _ in range(40)]) for _ in range(60)]
    base = [word() for _ in range(80)]
    for _ in range(40):
        copy = list(base)
        copy[r.randrange(80)] = word()
        texts.append(" ".join(copy))
    chain = [word() for _ in range(90)]
    for k in range(0, 90, 5):
        chain[k] = word()
        texts.append(" ".join(chain))
    texts += [" ".join(base[:k]) for k in (3, 4, 5, 20, 21, 25, 26, 40, 49, 50, 51)] + ["", " ", "a b", "A  b"]
    r.shuffle(texts)
    want = sorted(set(brute_roots(texts)))
    assert len(want) < len(texts) - 50
    monkeypatch.setattr(n, "PAIRS_AT_ONCE", 7)
    monkeypatch.setattr(n, "PART_POSTINGS", 300)
    monkeypatch.setattr(n, "FLUSH_POSTINGS", 200)
    assert stays(spark, texts) == want
    monkeypatch.setattr(n, "TILE", 4)
    assert stays(spark, texts) == want
    # Without fingerprints, and with no sifting by parities, the same stay.
    monkeypatch.setattr(n, "_by_fingerprint", lambda sets: sets.select("h", "h").toDF("a", "b").limit(0))
    assert stays(spark, texts) == want


@pytest.mark.parametrize("size", [3, 64, 65, 500, 3000])
def test_parities_never_rule_out_a_similar_pair(size):
    r = np.random.default_rng(size)
    base = np.unique(r.integers(0, 1 << 63, size).astype(np.uint64))
    for share in (0, 0.05, 0.1, 0.15, 0.19, 0.2):
        gone = int(share * len(base))
        other = np.unique(np.concatenate((base[gone:], r.integers(0, 1 << 63, int(gone * r.random())).astype(np.uint64))))
        sets = [base, other]
        m = n.Members(np.array([1, 2]), np.array([len(x) for x in sets]), np.zeros(2, np.int64), np.array([1, 2]), np.zeros(2, np.int64), [n.parities(x).tobytes() for x in sets])
        if n.similar(*sets):
            assert m.candidates(0, np.array([1])).tolist() == [1] and m.candidates(1, np.array([0])).tolist() == [0]
        both = len(np.intersect1d(*sets))
        assert n.similar(*sets) == (both * 5 >= 4 * (len(base) + len(other) - both))
    far = np.unique(r.integers(0, 1 << 63, size).astype(np.uint64))
    m = n.Members(np.array([1, 2]), np.array([len(base), len(far)]), np.zeros(2, np.int64), np.array([1, 2]), np.zeros(2, np.int64), [n.parities(x).tobytes() for x in (base, far)])
    assert size < 64 or not len(m.candidates(0, np.array([1])))


@pytest.mark.parametrize("size", [600, 2000, 9000])
def test_a_list_of_unrelated_long_texts_gives_no_pairs(size):
    r = np.random.default_rng(size)
    k = 500 if size < 9000 else 60
    sets = [np.unique(r.integers(0, 1 << 63, size - r.integers(0, size // 10)).astype(np.uint64)) for _ in range(k)]
    near = sets[0].copy()
    near[: size // 12] = r.integers(0, 1 << 63, size // 12)
    sets.append(np.unique(near))
    every = np.arange(len(sets))
    m = n.Members(every, np.array([len(x) for x in sets]), np.zeros(len(sets), np.int64), every, np.zeros(len(sets), np.int64), [n.parities(x).tobytes() for x in sets])
    pairs = [(a, b) for a, found in m.all() for b in found.tolist()]
    assert (0, k) in pairs and len(pairs) <= 3


def test_tiles_compare_each_pair_once(spark, monkeypatch):
    monkeypatch.setattr(n, "TILE", 7)
    rows = [(5, h, 100, 0) for h in range(50)] + [(6, h, 100, 0) for h in range(3)]
    lists = spark.createDataFrame(rows, "list long, h long, n int, i int")
    bits = n.parities(np.arange(100, dtype=np.uint64)).tobytes()
    sets = spark.createDataFrame([(h, bits) for h in range(50)], "h long, bits binary")
    roots = spark.createDataFrame([(1, 0)], "node long, root long")
    named = n._named(n._open(lists, roots), sets)
    assert named.groupBy("list", "tiles").count().agg({"count": "max"}).first()[0] < 40
    got = n._other_pairs(named)
    assert got.count() == got.distinct().count()
    assert {tuple(sorted(x)) for x in got.collect()} == {(a, b) for a in range(50) for b in range(a + 1, 50)} - {(0, 1)}


def test_shingles_are_told_apart_as_tuples_are():
    for _, text in documents(None, 200):
        assert len(n.shingles(text)) == len(brute(text.encode().decode("ascii", "replace"))) or not text.isascii()
