"""Importance resampling towards a target distribution.

Method: hashed word runs are counted in buckets over all documents and over the target texts; a bucket's gain is the scaled logarithm
of its ratio. A document's weight is the mean gain of its features, read from the array of gains; its score adds Gumbel noise of its
identifier's hash, so that the highest scores are a draw without replacement in proportion to the weights. The draw is exact:
a radix selection over the digits of the composite key (score, identifier, row) finds the k-th key. Each round counts the rows that
share the digits found so far by their next digit, at most 2 ** ``DIGIT_BITS`` counts, so nothing is sorted to find it. Only rows up to that
key are range-sorted and ranked.

Counts are summed within a task before they are shuffled: a task hands on one row for each of ``BUCKETS`` buckets at most, and the array
that scoring broadcasts is that long at any corpus size. Texts are read twice and never shuffled.

Defined cases: a null or wordless text has no features and weight 0; with fewer than ``MIN_WORDS`` words it isn't drawn. A null identifier
hashes as the empty text and counts as larger than others. Repeated rows are rows of their own: they have one score, and as many
of them are drawn as there is room for. An empty table gives an empty result; without target texts all gains come from the corpus alone.
Other columns are not read, but for those in ``keep``.
"""

from __future__ import annotations

import hashlib
import math
import re
import zlib

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.llm.common import append_columns, cut, emit_rows, numbered, table

BUCKETS = 10_000
RUN = 1
PERCENT = 10
MIN_WORDS = 20
SEED = 2024
DIGIT_BITS = 12
#: Features whose buckets a task remembers.
_MEMO_SIZE = 200_000
_WORD = re.compile(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
_SIGN = 1 << 63
_LARGEST = (1 << 63) - 1


class Buckets(dict):
    """The bucket of a feature, remembered; emptied when full."""

    def __init__(self, buckets: int):
        super().__init__()
        self.buckets = buckets

    def __missing__(self, feature: bytes) -> int:
        if len(self) >= _MEMO_SIZE:
            self.clear()
        out = self[feature] = zlib.crc32(feature) % self.buckets
        return out


def feature_buckets(text: str | None, run: int, buckets: Buckets) -> tuple[int, np.ndarray]:
    """The number of words of a text, and the buckets of its runs of 1 to ``run`` words."""
    words = _WORD.findall(text.encode("utf-8", "surrogatepass").lower()) if text else []
    features = words if run == 1 else [b" ".join(words[i : i + n]) for n in range(1, run + 1) for i in range(len(words) - n + 1)]
    return len(words), np.fromiter(map(buckets.__getitem__, features), np.int64, len(features))


def bucket_counts(docs: DataFrame, text_col="text", run=RUN, buckets=BUCKETS) -> np.ndarray:
    """How many features of all texts fall into each bucket."""

    def make():
        known, found = Buckets(buckets), np.zeros(buckets, np.int64)

        def fn(part):
            if part is None:
                some = np.flatnonzero(found)
                yield some, found[some]
                return
            for text in part.column(0).to_pylist():
                at = feature_buckets(text, run, known)[1]
                if len(at):
                    found[:] += np.bincount(at, minlength=buckets)

        return fn

    rows = emit_rows(docs.select(docs[text_col].cast("string")), make, [("bucket", "long"), ("n", "long")], finish=True)
    out = np.zeros(buckets, np.int64)
    for r in rows.groupBy("bucket").agg(F.sum("n").alias("n")).collect():  # at most one row for each bucket
        out[r["bucket"]] = r["n"]
    return out


def gains(corpus: np.ndarray, target: np.ndarray) -> np.ndarray:
    """floor(1000 ln of the smoothed ratio) of each bucket."""
    k, all_s, all_t = len(corpus), int(corpus.sum()), int(target.sum())
    ratio = lambda s, t: float(t + 1) * float(all_s + k) / (float(s + 1) * float(all_t + k))
    return np.array([math.floor(1000 * math.log(ratio(s, t))) for s, t in zip(corpus.tolist(), target.tolist(), strict=True)], np.int64)


def noise(doc_id, seed: int) -> int:
    h = int(hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()[:8], 16)
    return math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))


def scored(docs: DataFrame, gain: np.ndarray, id_col="doc_id", text_col="text", run=RUN, seed=SEED, keep=()) -> DataFrame:
    """doc_id, n_features, n_words, weight, score and a number ``row`` of every document, written to the shared folder."""
    shared = docs.sparkSession.sparkContext.broadcast(gain)
    kept = [F.struct(*(docs[k] for k in keep)).alias("kept")] if keep else []
    rows = docs.select(docs[id_col].alias("doc_id"), docs[text_col].cast("string").alias("text"), *kept)

    def make():
        known, gain = Buckets(len(shared.value)), shared.value

        def fn(ids, texts):
            out = [], [], [], []
            for doc_id, text in zip(ids, texts, strict=True):
                n_words, at = feature_buckets(text, run, known)
                weight = int(gain[at].sum()) // len(at) if len(at) else 0
                for column, value in zip(out, (len(at), n_words, weight, weight + noise(doc_id, seed)), strict=True):
                    column.append(value)
            return out

        return fn

    fields = [("n_features", "long"), ("n_words", "long"), ("weight", "long"), ("score", "long")]
    rows = append_columns(rows, ["doc_id", "text"], make, fields, drop=["text"])
    return cut(rows.withColumn("row", F.monotonically_increasing_id()), "resample-scores")


def last_key(rows: DataFrame, keys: list[str], k: int) -> list[int]:
    """The ``k``-th least row by the long columns ``keys``: a value for each key, or for the first of them where whole
    ranges end with the k-th row. k is at least 1 and at most the number of rows."""
    bound: list[int] = []
    for key in keys:
        ends = rows.agg(F.min(key), F.max(key)).first()
        low, high = (v + _SIGN for v in ends)  # as unsigned numbers
        open_bits = (low ^ high).bit_length()
        prefix, whole = high >> open_bits, False
        while open_bits and not whole:
            shift = max(0, open_bits - DIGIT_BITS)
            digit = F.shiftrightunsigned(F.col(key).bitwiseXOR(F.lit(-_SIGN)), shift).bitwiseAND(F.lit((1 << open_bits - shift) - 1))
            at_digit = rows.groupBy(digit.alias("digit")).agg(F.count(F.lit(1)).alias("n"))
            for r in sorted(at_digit.collect()):  # at most 2 ** DIGIT_BITS
                if r["n"] >= k:
                    break
                k -= r["n"]
            prefix, open_bits, whole = prefix << open_bits - shift | r["digit"], shift, r["n"] == k
            rows = rows.filter(F.col(key).between((prefix << open_bits) - _SIGN, (prefix + 1 << open_bits) - 1 - _SIGN))
        bound.append((prefix + 1 << open_bits) - 1 - _SIGN)
        if whole:
            break
    return bound


def up_to(keys: list[str], bound: list[int]) -> Column:
    """Whether a row stands at ``bound`` or before it."""
    out = F.lit(True)
    for key, value in reversed(list(zip(keys, bound, strict=False))):
        out = (F.col(key) < value) | ((F.col(key) == value) & out)
    return out


def drawn(rows: DataFrame, percent=PERCENT, min_words=MIN_WORDS) -> DataFrame:
    """``rows`` of ``scored`` with their ``rank``, null where they aren't drawn."""
    fit = F.col("n_words") >= min_words
    keys = ["__score", "__id", "row"]
    rows = rows.withColumns({"__score": F.bitwise_not("score"), "__id": F.coalesce(F.col("doc_id").cast("long"), F.lit(_LARGEST))})
    k = rows.filter(fit).count() * percent // 100
    if not k:
        return rows.withColumn("rank", F.lit(None).cast("long")).drop("__score", "__id")
    taken = fit & up_to(keys, last_key(rows.filter(fit).select(*keys), keys, k))
    ranked = numbered(rows.filter(taken), [F.col(c).asc() for c in keys], "rank", "resample-drawn")
    ranked = ranked.withColumn("rank", (F.col("rank") + 1).cast("long"))
    return ranked.unionByName(rows.filter(~taken).withColumn("rank", F.lit(None).cast("long"))).drop("__score", "__id")


def resampled(docs: DataFrame, target: DataFrame, id_col="doc_id", text_col="text", run=RUN, buckets=BUCKETS, percent=PERCENT, min_words=MIN_WORDS, seed=SEED, keep=()) -> DataFrame:
    """doc_id, n_features, n_words, weight, score, row and rank of every document, and the columns ``keep`` as a struct ``kept``:
    with keep=["text"] the rows with a rank are the drawn texts. ``target`` has a column ``text``."""
    gain = gains(bucket_counts(docs, text_col, run, buckets), bucket_counts(target, "text", run, buckets))
    return drawn(scored(docs, gain, id_col, text_col, run, seed, keep), percent, min_words)


def op12_importance(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = resampled(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return out.select("doc_id", "n_features", "weight", "score", "rank")
