"""Quality rules.

Method: two multinomials over hashed word uni- and bigrams, one of a trusted target and one of the raw
corpus, give each feature a log-likelihood ratio; a document's score is their mean over its features
(length-normalised), and every document is kept or not by one fixed threshold on it, after fixed base rules.

The raw counts cover all documents. The target is the set of documents that ``labels`` trusts (quality 1,
not toxic), of which at most ``TRUSTED_DOCS`` with the least hash of the identifier are used: that many
identifiers are broadcast. Counts are summed within a task and then by bucket, so each task hands on at
most 2 ** ``BUCKET_BITS`` rows, and the table that scoring broadcasts is that long at any corpus size.

Defined cases: a null or wordless text has no words, score 0 and fails the base rules. Without trusted
documents every ratio is 0 and the base rules decide. Repeated rows stay separate rows and count as often
as they come; an identifier labelled twice is trusted if no label speaks against it. Null identifiers are
never trusted. Other columns are not read.
"""

from __future__ import annotations

import numpy as np
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.llm.common import append_columns, emit_rows, id_and_text, sift_rows, table

BUCKET_BITS = 16
TRUSTED_DOCS = 20_000
#: Counts added to a bucket's target count and to what the raw corpus makes expect there, so that buckets with
#: little evidence have a ratio near 0.
SMOOTHING = 20.0
#: Mean log-likelihood ratio from which a document is kept.
MIN_SCORE = -0.06
MIN_WORDS = 50
MAX_REPEATED_PERCENT = 50
SYMBOLS = "#*$%&|<>"

_MEMO_SIZE = 60_000
_MIX = np.uint64(0x9E3779B97F4A7C15)


class WordHash(dict):
    """64-bit hash of a word, remembered; emptied when full."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= _MEMO_SIZE:
            self.clear()
        out = self[word] = xxhash.xxh64_intdigest(word)
        return out


_hashes = WordHash()


def word_hashes(raw: bytes) -> np.ndarray:
    """Hashes of the words of a text: ``split`` cuts at space and the control characters 9 to 13, as the rules do."""
    found = raw.split()
    return np.fromiter(map(_hashes.__getitem__, found), np.uint64, len(found))


def features(h: np.ndarray, bits: int) -> np.ndarray:
    """Buckets of the words and of the pairs of neighbours."""
    pairs = (h[:-1] * _MIX ^ (h[1:] >> np.uint64(3))) * _MIX
    return np.concatenate((h, pairs)) >> np.uint64(64 - bits)


def n_repeat_words(h: np.ndarray) -> int:
    """Words in 3-word windows that occur twice or more."""
    if len(h) < 4:
        return 0
    w = ((h[:-2] * _MIX + h[1:-1]) * _MIX + h[2:]) * _MIX
    order = np.sort(w)
    twice = order[1:][order[1:] == order[:-1]]
    if not len(twice):
        return 0
    hit = np.flatnonzero(np.isin(w, twice))
    marked = np.zeros(len(h), bool)
    for k in range(3):
        marked[hit + k] = True
    return int(marked.sum())


def n_dup_lines(text: str) -> int:
    seen, out = set(), 0
    for line in text.split("\n"):
        if line.strip(" \t\n\r\x0b\x0c"):
            out += line in seen
            seen.add(line)
    return out


def trusted_ids(labels: DataFrame, most: int = TRUSTED_DOCS) -> DataFrame:
    good = labels.filter("doc_id is not null").groupBy("doc_id").agg(F.min("quality").alias("q"), F.max(F.coalesce("toxic", F.lit(0))).alias("t"))
    return good.filter("q = 1 and t = 0").select(F.col("doc_id").alias("trusted_id")).orderBy(F.xxhash64("trusted_id"), "trusted_id").limit(most)


def log_ratios(docs: DataFrame, labels: DataFrame, id_col="doc_id", text_col="text", bits=BUCKET_BITS) -> np.ndarray:
    """The log-likelihood ratio of each bucket: log P(bucket | trusted) - log P(bucket | raw)."""
    rows = id_and_text(docs, id_col, text_col)
    ids = trusted_ids(labels)
    rows = rows.join(F.broadcast(ids), rows["doc_id"] == ids["trusted_id"], "left")
    rows = rows.select("text", F.col("trusted_id").isNotNull().alias("trusted"))

    def make():
        counts = np.zeros((2, 1 << bits), np.int64)

        def fn(part):
            if part is not None:
                for text, trusted in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), strict=True):
                    if text:
                        f = np.bincount(features(word_hashes(text.encode("utf-8", "surrogatepass")), bits).astype(np.int64), minlength=1 << bits)
                        counts[0] += f
                        if trusted:
                            counts[1] += f
                return
            at = np.flatnonzero(counts[0])
            yield at, counts[0][at], counts[1][at]

        return fn

    parts = emit_rows(rows, make, [("bucket", "long"), ("raw", "long"), ("target", "long")], finish=True)
    sums = parts.groupBy("bucket").agg(F.sum("raw").alias("raw"), F.sum("target").alias("target")).collect()
    raw, target = np.zeros(1 << bits), np.zeros(1 << bits)
    for r in sums:
        raw[r["bucket"]], target[r["bucket"]] = r["raw"], r["target"]
    if not target.sum():
        return np.zeros(1 << bits)
    expected = target.sum() * raw / raw.sum()
    return np.log((target + SMOOTHING) / (expected + SMOOTHING))


def verdict(text: str | None, ratios: np.ndarray, min_score=MIN_SCORE) -> tuple:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, score and kept of a text."""
    text = text or ""
    h = word_hashes(text.encode("utf-8", "surrogatepass"))
    n, repeated = len(h), n_repeat_words(h)
    failed = n < MIN_WORDS or 100 * repeated > MAX_REPEATED_PERCENT * n
    score = float(ratios[features(h, len(ratios).bit_length() - 1)].mean()) if n else 0.0
    chars = len(text) - sum(map(text.count, " \t\n\r\x0b\x0c"))
    return n, chars, sum(map(text.count, SYMBOLS)), n_dup_lines(text), repeated, failed, score, not failed and score >= min_score


def judge(docs: DataFrame, ratios: np.ndarray, text_col="text", min_score=MIN_SCORE, drop=(), prefix="") -> DataFrame:
    """``docs`` with n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, score and kept."""
    shared = docs.sparkSession.sparkContext.broadcast(ratios)

    def make():
        table = shared.value
        return lambda texts: list(zip(*(verdict(t, table, min_score) for t in texts), strict=True)) if texts else [[]] * 8

    names = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
    fields = [*((n, "long") for n in names), ("base_failed", "boolean"), ("score", "double"), ("kept", "boolean")]
    return append_columns(docs, text_col, make, [(prefix + n, k) for n, k in fields], drop)


def keep_good(docs: DataFrame, ratios: np.ndarray, text_col="text", min_score=MIN_SCORE) -> DataFrame:
    """The rows of ``docs`` that ``judge`` keeps."""
    shared = docs.sparkSession.sparkContext.broadcast(ratios)

    def make():
        table = shared.value
        return lambda texts: ([verdict(t, table, min_score)[-1] for t in texts], None)

    return sift_rows(docs, make, text_col)


def op8_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    ratios = log_ratios(docs, table(spark, sf_dir, "labels"))
    return judge(id_and_text(docs, "doc_id", "text"), ratios, drop=["text"])
