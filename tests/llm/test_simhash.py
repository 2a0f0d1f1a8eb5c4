import random
import re

import numpy as np
import pytest
import xxhash
from plumbline.llm import simhash_dedup as s
from tests.llm.fixtures import awkward, documents, sample_texts

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute_print(text):
    w = WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if not w:
        return 0
    grams = [" ".join(w[i : i + 3]) for i in range(len(w) - 2)] or [" ".join(w)]
    h = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def brute_components(rows):
    """{index: least id} by union of all pairs."""
    root = list(range(len(rows)))

    def top(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if (rows[i][1] ^ rows[j][1]).bit_count() <= 2:
                root[top(i)] = top(j)
    least: dict = {}
    for i, (doc, _) in enumerate(rows):
        if doc is not None:
            least[top(i)] = min(doc, least.get(top(i), doc))
    return [least.get(top(i)) for i in range(len(rows))]


def test_fingerprints():
    for text in [t for _, t in documents(None, 200)] + sample_texts(200, alphabet="abZ \n\x1c\x85é") + ["", "A b", "one two three"]:
        assert s.fingerprint(text) == brute_print(text), text


def test_components_of_documents(spark):
    docs = documents(None, 600)
    rows = s.classes(spark.createDataFrame(docs, "doc_id long, text string")).collect()
    prints = [(i, brute_print(t)) for i, t in docs]
    expected = dict(zip([i for i, _ in docs], brute_components(prints)))
    assert {r["doc_id"]: r["component_id"] for r in rows} == expected
    assert {r["doc_id"]: r["fingerprint"] for r in rows} == {i: f"{p:016x}" for i, p in prints}
    assert len(set(expected.values())) < len(expected)


@pytest.mark.parametrize("most", [1024, 3])
def test_dense_and_chained_fingerprints(spark, monkeypatch, most):
    """Lists of more than ``most`` are posted again."""
    monkeypatch.setattr(s, "LIST_MOST", most)
    r = random.Random(4)
    prints = set()
    for _ in range(6):  # clouds: many fingerprints that differ in two bytes
        p, (a, b) = r.getrandbits(64), r.sample(range(8), 2)
        prints |= {p ^ (r.getrandbits(8) << 8 * a) ^ (r.getrandbits(8) << 8 * b) for _ in range(60)}
    p = r.getrandbits(64)
    for _ in range(40):  # a long chain
        p ^= 1 << r.randrange(64)
        p ^= 1 << r.randrange(64)
        prints.add(p)
    prints |= {0, 1, 3, 7, (1 << 64) - 1, (1 << 63)}
    rows = [(i, p) for i, p in enumerate(sorted(prints, key=lambda x: x * 0x9E3779B97F4A7C15 % 2**64))]
    df = spark.createDataFrame([(i, s._signed(p)) for i, p in rows], "doc_id long, fp long")
    got = {x["fp"]: x["component_id"] for x in s.name_components(df, "doc_id", "fp").collect()}
    assert [got[s._signed(p)] for _, p in rows] == brute_components(rows)


def test_awkward(spark):
    rows = s.classes(awkward(spark, ["same text here", "same text here", "", "other words entirely different"])).collect()
    assert len(rows) == 7
    zero = [r for r in rows if r["fingerprint"] == "0" * 16]
    assert len(zero) == 3 and {r["component_id"] for r in zero} == {2}
    assert {r["component_id"] for r in rows if r["doc_id"] in (0, 1)} == {0}
    assert s.classes(awkward(spark, ["a"]).filter("doc_id < 0")).collect() == []


def test_shared_bytes():
    r = random.Random(8)
    pairs = [(r.getrandbits(64), r.getrandbits(64)) for _ in range(200)]
    pairs += [(p, p ^ (1 << r.randrange(64)) ^ (1 << r.randrange(64))) for p, _ in pairs]
    got = s.shared_bytes(np.array([a ^ b for a, b in pairs], np.uint64)).tolist()
    assert got == [sum(x == y for x, y in zip(a.to_bytes(8, "little"), b.to_bytes(8, "little"))) for a, b in pairs]
