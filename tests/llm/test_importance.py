import hashlib
import math
import random
import re
import zlib
from collections import Counter

import pyarrow.parquet as pq
from plumbline.llm import importance
from tests.llm.fixtures import SF, awkward, documents

WORD = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")


def features(text, run=1):
    words = WORD.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
    return len(words), [" ".join(words[i : i + n]) for n in range(1, run + 1) for i in range(len(words) - n + 1)]


def brute(rows, target, run=1, buckets=10_000, percent=10, least=20, seed=2024):
    """{place of row: (doc_id, n_features, weight, score)} and the drawn ones in order, of (doc_id, text) rows."""
    bucket = lambda f: zlib.crc32(f.encode()) % buckets
    s, t = Counter(), Counter()
    for _, text in rows:
        s.update(map(bucket, features(text, run)[1]))
    for text in target:
        t.update(map(bucket, features(text, run)[1]))
    all_s, all_t = sum(s.values()), sum(t.values())
    gain = lambda b: math.floor(1000 * math.log((t[b] + 1) * (all_s + buckets) / ((s[b] + 1) * (all_t + buckets))))
    out, fit = [], []
    for i, text in rows:
        n, found = features(text, run)
        weight = sum(gain(bucket(f)) for f in found) // len(found) if found else 0
        h = int(hashlib.sha256(f"{seed}:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        score = weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))
        out.append((i, len(found), weight, score))
        if n >= least:
            fit.append(out[-1])
    order = sorted(fit, key=lambda r: (-r[3], r[0] is None, r[0] or 0))
    return out, order[: len(fit) * percent // 100]


def same(got, rows, drawn):
    assert sorted((r["doc_id"] is None, r["doc_id"] or 0, r["n_features"], r["weight"], r["score"]) for r in got) == sorted((i is None, i or 0, *rest) for i, *rest in rows)
    ranked = sorted((r for r in got if r["rank"] is not None), key=lambda r: r["rank"])
    assert [r["rank"] for r in ranked] == list(range(1, len(drawn) + 1))
    assert [(r["doc_id"], r["score"]) for r in ranked] == [(r[0], r[3]) for r in drawn]


def test_documents(spark):
    target = [r["text"] for r in pq.read_table(f"{SF}/benchmark.parquet").to_pylist()]
    got = importance.op12_importance(spark, SF)
    assert got.dtypes == [(c, "bigint") for c in ("doc_id", "n_features", "weight", "score", "rank")]
    same(got.collect(), *brute(documents(None), target))


def test_ties_repeats_nulls_and_runs(spark):
    r = random.Random(4)
    rows = [(i % 90, " ".join(r.choice("ab C é 9".split()) for _ in range(r.randint(15, 30)))) for i in range(300)]
    rows += [rows[0]] * 200 + [(None, "x " * 40), (None, "x " * 40), (None, None), (3, ""), (4, "w " * 100_000), (-(1 << 63), "y " * 30), ((1 << 63) - 1, "y " * 30)]
    target = ["a b a b 9", None, "é c"]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    bench = spark.createDataFrame([(t,) for t in target], "text string")
    for run, percent in ((1, 10), (1, 100), (2, 37)):
        got = importance.resampled(docs, bench, run=run, percent=percent).collect()
        same(got, *brute(rows, target, run=run, percent=percent))


def test_last_key(spark, monkeypatch):
    monkeypatch.setattr(importance, "DIGIT_BITS", 3)
    r = random.Random(1)
    rows = [(r.choice([-5, 0, 7, (1 << 63) - 1, -(1 << 63)]), r.randint(-3, 3), i) for i in range(60)]
    df = spark.createDataFrame(rows, "a long, b long, c long").cache()
    keys = ["a", "b", "c"]
    for k in (1, 2, 13, 30, 59, 60):
        bound = importance.last_key(df, keys, k)
        assert sorted(map(tuple, df.filter(importance.up_to(keys, bound)).collect())) == sorted(rows)[:k]


def test_empty_and_clashing(spark):
    bench = spark.createDataFrame([], "text string")
    assert importance.resampled(spark.createDataFrame([], "doc_id long, text string"), bench).collect() == []
    out = importance.resampled(awkward(spark, ["a " * 30, "b"]), bench, percent=100, keep=["text", "score", "doc_id"]).collect()
    assert len(out) == 5 and [(r["doc_id"], r["kept"]["text"], r["kept"]["score"]) for r in out if r["rank"] == 1] in ([(0, "a " * 30, 0.5)], [(0, "a " * 30, 1.0)])
