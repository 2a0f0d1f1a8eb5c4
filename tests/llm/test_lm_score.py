import math
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from plumbline.llm import lm_score as lm
from tests.llm.fixtures import SF, awkward, documents

WORD = re.compile(r"[^\x20\x09-\x0D]+")
WEIGHTS = np.tile([0.5, 0.3, 0.2], (64, 1))
WEIGHTS[:, 0] += np.arange(64) / 1000
WEIGHTS[:, 1] -= np.arange(64) / 1000
WEIGHTS[0] = [0, 0.7, 0.3]


def split(text):
    return WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def part(doc):
    return zlib.crc32(("" if doc is None else str(doc)).encode()) % 7


def brute(rows, weights):
    """Counts in dictionaries; [(n_tokens, n_known, N, base, score)] and the deleted tokens' estimates."""
    uni, pair, del_uni, del_pair = Counter(), Counter(), Counter(), Counter()
    for doc, text in rows:
        if part(doc) != 2:
            w = ["^", *split(text), "$"]
            for c, d, x in ((uni, del_uni, w), (pair, del_pair, list(zip(w, w[1:])))):
                c.update(x)
                if part(doc) == 3:
                    d.update(x)
    n, kinds = sum(uni.values()) - uni["^"], len(set(uni) - {"^"})
    out = []
    for _, text in rows:
        w = [*split(text), "$"]
        base = sum(math.log10((uni[x] + 1) / (n + kinds + 1)) for x in w)
        total = 0.0
        for v, x in zip(["^", *w], w):
            lam = weights[uni[v].bit_length()]
            total += math.log10(lam[0] * (pair[v, x] / uni[v] if uni[v] else 0) + lam[1] * uni[x] / max(n, 1) + lam[2] / (kinds + 1))
        out.append((len(w), sum(uni[x] > 0 for x in w), n, base, total))
    estimates = []
    for (v, x), times in del_pair.items():
        c = uni[v] - del_uni[v]
        f2 = (pair[v, x] - times) / c if c else 0.0
        f1 = (uni[x] - del_uni[x]) / max(1, n - sum(del_uni.values()) + del_uni["^"])
        estimates.append((c.bit_length(), f2, f1, times))
    return out, estimates, kinds


def check(got, docs, expected):
    assert sorted(map(str, (r["doc_id"] for r in got))) == sorted(str(d) for d, _ in docs)
    by_id: dict = {}
    for (doc, _), e in zip(docs, expected):
        by_id.setdefault(doc, []).append(e)
    for r in got:
        assert r["held_out"] == (part(r["doc_id"]) == 2)
        assert any(
            (r["n_tokens"], r["n_known"], r["train_tokens"]) == e[:3] and r["base_score"] == pytest.approx(e[3], abs=1e-6) and r["score"] == pytest.approx(e[4], abs=1e-6)
            for e in by_id[r["doc_id"]]
        ), (r, by_id[r["doc_id"]])


@pytest.mark.parametrize("head,hot,fan", [(1 << 20, 1024, 4096), (300, 16, 4096), (300, 16, 5), (3, 4, 4096)])
def test_scores_equal_brute_force(spark, monkeypatch, head, hot, fan):
    """With few head words both words of many events are rare; with a small fan-out parts are dealt out in two steps."""
    monkeypatch.setattr(lm, "FAN_OUT", fan)
    monkeypatch.setattr(lm, "HEAD_WORDS", head)
    monkeypatch.setattr(lm, "HOT_WORDS", hot)
    monkeypatch.setattr(lm, "PART_EVENTS", 5000)
    monkeypatch.setattr(lm, "FLUSH_EVENTS", 9000)
    seen = {}
    monkeypatch.setattr(lm, "mixture", lambda rows, u: seen.update(rows=rows, u=u) or WEIGHTS)
    docs = documents(None, 150)
    docs += [(10_000 + i, docs[7][1]) for i in range(20)]  # copies in all parts of the split
    expected, estimates, kinds = brute(docs, WEIGHTS)
    check(lm.score(spark.createDataFrame(docs, "doc_id long, text string")).collect(), docs, expected)
    rows = seen["rows"]
    assert seen["u"] == 1 / (kinds + 1)
    assert rows["w"].sum() == sum(e[3] for e in estimates)
    for b in set(rows["bucket"].tolist()):
        at = rows["bucket"] == b
        mine = [e for e in estimates if e[0] == b]
        assert rows["w"][at].sum() == sum(e[3] for e in mine)
        assert rows["s2"][at].sum() == pytest.approx(sum(e[1] * e[3] for e in mine))
        assert rows["s1"][at].sum() == pytest.approx(sum(e[2] * e[3] for e in mine))


def test_mixture_is_the_maximum():
    r = np.random.default_rng(1)
    n = 4000
    f2, f1 = r.choice([0, 0.3, 0.05], n), r.choice([0, 0.01, 0.001], n)
    rows = {"bucket": np.full(n, 3), "w": np.ones(n), "s2": f2, "s1": f1}
    u = 1e-4
    lam = lm.mixture(rows, u)[3]
    like = lambda x: np.log(x[0] * f2 + x[1] * f1 + x[2] * u).sum()
    assert lam.sum() == pytest.approx(1) and (lam > 0).all()
    for _ in range(200):
        other = np.abs(lam + r.normal(0, 0.02, 3))
        assert like(lam) >= like(other / other.sum()) - 1.0  # the ten pooled tokens move it a little


def test_pack():
    a, b = np.array([1, 2, 1 << 60], np.uint64), np.array([], np.uint32)
    x, y = lm.unpack(lm.pack(a, b), np.uint64, np.uint32)
    assert (x == a).all() and len(y) == 0


def test_better_than_base_on_held_out(spark):
    rows = [r for r in lm.op9_lm_score(spark, SF).collect() if r["held_out"]]
    assert sum(r["score"] for r in rows) > sum(r["base_score"] for r in rows)


def test_awkward(spark):
    docs = awkward(spark, ["a b a b a b", "A B", "", "é" * 50_000, "zz"]).drop("score")
    pairs = [(r["doc_id"], r["text"]) for r in docs.select("doc_id", "text").collect()]
    rows = lm.score(docs).collect()
    assert len(rows) == 8 and all(math.isfinite(r["score"]) for r in rows)
    for r, e in ((r, e) for r in rows for (d, t), e in zip(pairs, brute(pairs, WEIGHTS)[0]) if d == r["doc_id"] and d not in (None, 0)):
        assert (r["n_tokens"], r["n_known"]) == e[:2] and r["base_score"] == pytest.approx(e[3], abs=1e-9)
    assert lm.score(docs.filter("doc_id < -1")).collect() == []
    held = docs.filter("doc_id is not null").filter("pmod(crc32(cast(cast(doc_id as string) as binary)), 7) = 2")
    assert all(r["score"] == pytest.approx(0) and r["train_tokens"] == 0 for r in lm.score(held).collect())
