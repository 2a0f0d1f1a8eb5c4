import re
from collections import Counter

import numpy as np
import pyarrow.parquet as pq
from plumbline.llm import quality_rules as q
from tests.llm.fixtures import SF, awkward, documents, sample_texts

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def base(text):
    text = text or ""
    w = WORD.findall(text)
    grams = Counter(zip(w, w[1:], w[2:]))
    repeated = set()
    for i, g in enumerate(zip(w, w[1:], w[2:])):
        if grams[g] > 1:
            repeated |= {i, i + 1, i + 2}
    seen, dup = set(), 0
    for line in text.split("\n"):
        if WORD.search(line):
            dup += line in seen
            seen.add(line)
    n = len(w)
    return n, sum(map(len, w)), sum(c in "#*$%&|<>" for c in text), dup, len(repeated), n < 50 or 100 * len(repeated) > 50 * n


def test_base_rules():
    for text in [t for _, t in documents(None)] + sample_texts(300, alphabet="ab \n\x1c\x85\xa0é#") + ["", "a b c", "a b c a b c", "x\r\nx\r\n\n\n"]:
        h = q.word_hashes(text.encode())
        n, chars, symbols, dup, repeated, failed = base(text)
        assert (len(h), q.n_repeat_words(h), q.n_dup_lines(text)) == (n, repeated, dup), text
        assert len(text) - sum(map(text.count, " \t\n\r\x0b\x0c")) == chars
        assert sum(map(text.count, q.SYMBOLS)) == symbols


def brute_ratios(rows, trusted):
    raw, target = np.zeros(1 << q.BUCKET_BITS), np.zeros(1 << q.BUCKET_BITS)
    for i, text in rows:
        for f in q.features(q.word_hashes((text or "").encode()), q.BUCKET_BITS).tolist():
            raw[f] += 1
            target[f] += i in trusted
    return np.log((target + q.SMOOTHING) / (target.sum() * raw / raw.sum() + q.SMOOTHING))


def brute_kept(rows, labels):
    """Which (doc_id, text) rows stay, by labels of (doc_id, quality, toxic)."""
    against = {i for i, good, toxic in labels if good != 1 or toxic}
    trusted = {i for i, good, toxic in labels if good == 1 and not toxic and i is not None} - against
    ratios = brute_ratios(rows, trusted)
    out = []
    for _, text in rows:
        f = q.features(q.word_hashes((text or "").encode()), q.BUCKET_BITS).astype(int)
        out.append(not base(text)[5] and ratios[f].mean() >= q.MIN_SCORE)
    return out


def test_documents(spark):
    docs, labels = documents(None), pq.read_table(f"{SF}/labels.parquet").to_pylist()
    trusted = {r["doc_id"] for r in labels if r["quality"] == 1 and r["toxic"] == 0}
    ratios = brute_ratios(docs, trusted)
    rows = q.op8_quality_rules(spark, SF).collect()
    text, kept = dict(docs), {}
    assert len(rows) == len(docs)
    for r in rows:
        assert tuple(r)[1:7] == base(text[r["doc_id"]])
        h = q.word_hashes(text[r["doc_id"]].encode())
        score = ratios[q.features(h, q.BUCKET_BITS).astype(int)].mean() if len(h) else 0.0
        assert abs(r["score"] - score) < 1e-9
        assert r["kept"] == (not r["base_failed"] and r["score"] >= q.MIN_SCORE)
        kept[r["doc_id"]] = r["kept"] or r["base_failed"]
    good = [kept[r["doc_id"]] for r in labels if r["quality"] == 1]
    junk = [kept[r["doc_id"]] for r in labels if r["quality"] == 0 and not base(text[r["doc_id"]])[5]]
    assert all(good) and sum(junk) <= 0.1 * len(junk)


def test_awkward(spark):
    docs = awkward(spark, ["a b " * 100, "x", "\n\n"]).drop("score", "kept")
    labels = spark.createDataFrame([(0, 1, 0), (0, 0, 0), (None, 1, 0), (1, 1, None)], "doc_id long, quality int, toxic int")
    assert [r["trusted_id"] for r in q.trusted_ids(labels).collect()] == [1]
    for lab in (labels, labels.filter("doc_id < 0")):
        ratios = q.log_ratios(docs, lab)
        rows = q.judge(docs, ratios).collect()
        assert len(rows) == 6 and not any(r["kept"] for r in rows)
    assert q.judge(docs.filter("doc_id < 0"), ratios).collect() == []
    assert not q.log_ratios(docs.filter("doc_id < 0"), labels).any()
