"""Benchmark decontamination.

Method: the normalised n-grams of the benchmark become a broadcast hash set; every training text's
token windows are hashed with a rolling polynomial and looked up; a hit is verified word by word;
then spans or whole documents are removed.

The benchmark is measured before it is broadcast. Up to ``BLOCK_BYTES`` of normalised text go in one set (about 25 bytes
a window and 150 a different word); beyond, repeated pieces go once and the benchmark is cut into blocks of about that size, items longer than a piece into
pieces that overlap by a window. Then the documents are written once with a row number and read once for each block, which gives only
the rows that it hits, and hits are joined by row number. The result is the same for any number of blocks.

Defined cases: a null or wordless text has no words and no hits; a benchmark item without words
has no window. An item shorter than a window is itself one window. Items with a null item_id count
for hits but are in no list; rows with equal item_id are one item. Repeated document rows stay separate
rows. Other columns are not read and may have any name. An empty benchmark hits nothing.
"""

from __future__ import annotations

import math
import uuid

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.llm.common import append_columns, cut, emit_rows, id_and_text, sift_rows, table

WINDOW = 13
#: Normalised text in one broadcast set, and in a piece of an item: so much, or one window where its words are longer.
BLOCK_BYTES = 8 << 20
PIECE_BYTES = 1 << 20
#: A document is contaminated from one hit word in so many on.
WORDS_PER_HIT = 20

#: Bytes that separate words become spaces: ASCII but digits and small letters.
_SEPARATORS = bytes(b if b >= 0x80 or 48 <= b <= 57 or 97 <= b <= 122 else 32 for b in range(256))
_FACTOR = 0x9E3779B97F4A7C15


def words(text: str | None) -> list[bytes]:
    return text.encode("utf-8", "surrogatepass").lower().translate(_SEPARATORS).split() if text else []


def rolling(ids: np.ndarray, k: int) -> np.ndarray:
    """A 64-bit hash of every window of k numbers."""
    n = len(ids) - k + 1
    out, ids = np.zeros(n, np.uint64), ids.astype(np.uint64)
    for j in range(k):
        out = out * np.uint64(_FACTOR) + (ids[j : j + n] ^ np.uint64(0x5851F42D4C957F2D))
    return out


class NgramSet:
    """The windows of some pieces of benchmark items as arrays: all words by number, one after the other; and for each window
    length the sorted hashes with the place of each window among the words, for verifying, and its item."""

    def __init__(self, pieces: list[tuple[str | None, list[bytes]]], window: int = WINDOW):
        self.vocab: dict[bytes, int] = {}
        self.items = sorted({item for item, _ in pieces if item is not None})
        number = {item: i for i, item in enumerate(self.items)}
        parts, found, at = [], {}, 0
        for item, tokens in pieces:
            if not tokens:
                continue
            ids = np.fromiter((self.vocab.setdefault(w, len(self.vocab) + 1) for w in tokens), np.int32, len(tokens))
            k = min(window, len(ids))
            hashes = rolling(ids, k)
            found.setdefault(k, []).append((hashes, at + np.arange(len(hashes)), np.full(len(hashes), number.get(item, -1), np.int32)))
            parts.append(ids)
            at += len(ids)
        self.words = np.concatenate(parts) if parts else np.zeros(0, np.int32)
        self.sets = []
        for k in sorted(found):
            hashes, places, items = map(np.concatenate, zip(*found[k], strict=True))
            order = np.argsort(hashes, kind="stable")
            self.sets.append((k, hashes[order], places[order], items[order]))

    def scan(self, tokens: list[bytes]) -> tuple[np.ndarray | None, set]:
        """(which words are hit, or None if none is; the items with a window here)."""
        if not self.sets or not tokens:
            return None, set()
        ids = np.fromiter((self.vocab.get(w, 0) for w in tokens), np.int32, len(tokens))
        unknown = np.concatenate(([0], np.cumsum(ids == 0)))
        hit, found = None, set()
        for k, hashes, places, items in self.sets:
            n = len(ids) - k + 1
            if n <= 0:
                continue
            at = np.flatnonzero(unknown[k:] == unknown[:n])  # windows of benchmark words alone
            if not len(at):
                continue
            h = rolling(ids, k)[at]
            first, last = np.searchsorted(hashes, h), np.searchsorted(hashes, h, "right")
            maybe, done = last > first, set()
            for i, lo, hi in zip(at[maybe].tolist(), first[maybe].tolist(), last[maybe].tolist()):
                if lo in done:  # this window was met before in the text
                    hit[i : i + k] = True
                    continue
                seen = ids[i : i + k]
                same = (self.words[places[lo:hi, None] + np.arange(k)] == seen).all(axis=1)  # equal hashes of other words are passed over
                if same.any():
                    hit = np.zeros(len(ids), bool) if hit is None else hit
                    hit[i : i + k] = True
                    found.update(items[lo:hi][same].tolist())
                    if same.all():
                        done.add(lo)
        found.discard(-1)
        return hit, {self.items[i] for i in found}


def _own(*names: str) -> list[str]:
    """Column names that no table has."""
    tag = uuid.uuid4().hex
    return [f"{n}_{tag}" for n in names]


def cut_pieces(found: list[bytes], window: int, most: int) -> list[bytes]:
    """The words of an item as pieces of about ``most`` bytes that overlap, so that each window is in one."""
    if not found:
        return []
    ends = np.cumsum([len(w) + 1 for w in found])
    out, start, last = [], 0, max(1, len(found) - window + 1)  # windows start before ``last``
    while start < last:
        before = ends[start - 1] if start else 0
        stop = min(last, max(start + 1, int(np.searchsorted(ends, before + most, "right")) - window + 1))
        out.append(b" ".join(found[start : stop + window - 1]))
        start = stop
    return out


def benchmark_pieces(benchmark: DataFrame, item_col: str, text_col: str, window: int) -> DataFrame:
    """(item, words) of the benchmark: items' words joined by spaces, cut into pieces."""
    rows = benchmark.select(benchmark[item_col].cast("string").alias("item"), benchmark[text_col].cast("string").alias("text"))

    def make():
        def fn(part):
            for item, text in zip(part.column("item").to_pylist(), part.column("text").to_pylist(), strict=True):
                pieces = cut_pieces(words(text), window, PIECE_BYTES)
                if pieces:
                    yield [item] * len(pieces), pieces

        return fn

    return emit_rows(rows, make, [("item", "string"), ("words", "binary")])


def benchmark_blocks(benchmark: DataFrame, item_col: str, text_col: str, window: int, most: int) -> tuple[int, object]:
    """(number of blocks, a function that collects one of them): the benchmark's pieces in blocks of about ``most`` bytes. Different
    pieces are dealt out by their hash, so a block exceeds that by little."""
    rows = benchmark_pieces(benchmark, item_col, text_col, window)
    size = lambda: rows.agg(F.sum(F.octet_length("words")).alias("n")).first()["n"] or 0
    total = size()
    if total > most:
        rows = cut(rows.distinct(), "decontaminate-benchmark")
        total = size()
    blocks = max(1, math.ceil(total / most))

    def block(b: int):
        part = rows if blocks == 1 else rows.filter(F.pmod(F.xxhash64("item", "words"), F.lit(blocks)) == b)
        return [(r["item"], bytes(r["words"]).split()) for r in part.collect()]

    return blocks, block


def find_hits(
    docs: DataFrame, benchmark: DataFrame, text_col="text", item_col="item_id", item_text_col="text", window=WINDOW, block_bytes=BLOCK_BYTES, drop=(), prefix=""
) -> DataFrame:
    """``docs`` with hit_words (words in the text), hit_spans (word numbers of the runs of hit words: start, end,
    start, end, ...) and hit_items (sorted as strings). Columns in ``drop`` are left out; ``prefix`` goes before the new names."""
    spark = docs.sparkSession
    fields = [(prefix + n, k) for n, k in (("hit_words", "long"), ("hit_spans", "ints"), ("hit_items", "strings"))]
    blocks, block = benchmark_blocks(benchmark, item_col, item_text_col, window, block_bytes)

    def scanner(b):
        shared = spark.sparkContext.broadcast(NgramSet(block(b), window))

        def make():
            grams = shared.value

            def fn(texts):
                out = []
                for text in texts:
                    tokens = words(text)
                    hit, items = grams.scan(tokens)
                    out.append((len(tokens), [] if hit is None else runs(hit), sorted(items)))
                return list(zip(*out, strict=True)) if out else [[]] * 3

            return fn

        return make

    if blocks == 1:
        return append_columns(docs, text_col, scanner(0), fields, drop)

    row, n_words, spans, items, every, hit = _own("row", "words", "spans", "items", "all", "hit")
    rows = cut(docs.withColumn(row, F.monotonically_increasing_id()), "decontaminate-rows")
    found = None
    for b in range(blocks):
        hits = append_columns(rows.select(row, text_col), text_col, scanner(b), [(n_words, "long"), (spans, "ints"), (items, "strings")], [text_col])
        hits = cut(hits.filter(F.size(spans) > 0).select(row, spans, items), "decontaminate-hits")
        found = hits if found is None else found.unionByName(hits)
    # A row has hits from so many blocks at most.
    merged = found.groupBy(F.col(row).alias(hit)).agg(F.flatten(F.collect_list(spans)).alias(every), F.array_sort(F.array_distinct(F.flatten(F.collect_list(items)))).alias(items))
    merged = append_columns(merged, every, lambda: lambda found: [[joined(s) for s in found]], [(spans, "ints")], [every])
    counted = append_columns(rows, text_col, lambda: lambda texts: [[len(words(t)) for t in texts]], [(n_words, "long")], drop)
    out = counted.join(merged, F.col(row) == F.col(hit), "left")
    new = F.col(n_words), F.coalesce(spans, F.array().cast("array<int>")), F.coalesce(items, F.array().cast("array<string>"))
    return out.select(*(n for n in docs.columns if n not in drop), *(c.alias(n) for c, (n, _) in zip(new, fields)))


def cleaned(docs: DataFrame, benchmark: DataFrame, text_col="text", item_col="item_id", item_text_col="text", window=WINDOW, block_bytes=BLOCK_BYTES) -> DataFrame:
    """``docs`` without contaminated rows; in those with fewer hits the runs of hit words are cut out of the text."""
    blocks, block = benchmark_blocks(benchmark, item_col, item_text_col, window, block_bytes)
    if blocks > 1:
        (prefix,) = _own("hits")
        found = find_hits(docs, benchmark, text_col, item_col, item_text_col, window, block_bytes, prefix=prefix)
        clean = found.filter(~contaminated(F.col(f"{prefix}hit_words"), n_hit(f"{prefix}hit_spans")))
        return cut_out(clean, text_col, f"{prefix}hit_spans").select(*docs.columns)
    shared = docs.sparkSession.sparkContext.broadcast(NgramSet(block(0), window))

    def make():
        grams = shared.value

        def one(text):
            tokens = words(text)
            hit, _ = grams.scan(tokens)
            if hit is None:
                return True, text
            return int(hit.sum()) * WORDS_PER_HIT < len(tokens), remove_spans(text, runs(hit))

        return lambda texts: tuple(zip(*map(one, texts), strict=True)) if texts else ([], [])

    return sift_rows(docs, make, text_col)


def joined(spans: list[int]) -> list[int]:
    """Runs (start, end, start, end, ...) of several blocks as the runs of their union."""
    out: list[int] = []
    for a, b in sorted(zip(spans[::2], spans[1::2])):
        if out and a <= out[-1]:
            out[-1] = max(out[-1], b)
        else:
            out += [a, b]
    return out


def runs(hit: np.ndarray) -> list[int]:
    """Starts and ends of the runs of True, in turn."""
    return np.flatnonzero(np.diff(np.concatenate(([False], hit, [False])).astype(np.int8))).tolist()


def remove_spans(text: str | None, spans: list[int]) -> str | None:
    """``text`` without the characters of the runs of hit words, from the first byte of a run's first word to
    the last of its last."""
    if not text or not spans:
        return text
    raw = text.encode("utf-8", "surrogatepass")
    flat, bounds, at = raw.lower().translate(_SEPARATORS), [], 0
    for w in flat.split():
        at = flat.index(w, at)
        bounds.append((at, at + len(w)))
        at += len(w)
    out, done = [], 0
    for a, b in zip(spans[::2], spans[1::2]):
        out.append(raw[done : bounds[a][0]])
        done = bounds[b - 1][1]
    return b"".join([*out, raw[done:]]).decode("utf-8", "surrogatepass")


def cut_out(docs: DataFrame, text_col="text", spans_col="hit_spans") -> DataFrame:
    """``docs`` with the runs of hit words removed from the text."""
    hit, left = _own("cut", "left")
    rows = docs.withColumn(hit, F.when(F.size(spans_col) > 0, F.col(text_col)))
    rows = append_columns(rows, [hit, spans_col], lambda: lambda t, s: [[remove_spans(x, y) for x, y in zip(t, s, strict=True)]], [(left, "string")], [hit])
    return rows.withColumn(text_col, F.when(F.size(spans_col) > 0, F.col(left)).otherwise(F.col(text_col))).drop(left)


def contaminated(n_words, n_hit):
    return (n_hit > 0) & (n_hit * WORDS_PER_HIT >= n_words)


def n_hit(spans="hit_spans"):
    """Hit words from the ends and starts of their runs."""
    return F.aggregate(F.transform(spans, lambda x, i: F.when(i % 2 == 1, x).otherwise(-x).cast("long")), F.lit(0).cast("long"), lambda a, x: a + x)


def report(docs: DataFrame, benchmark: DataFrame, id_col="doc_id", text_col="text", **kw) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items_sha256 and contaminated for every row of ``docs``."""
    found = find_hits(id_and_text(docs, id_col, text_col), benchmark, drop=["text"], **kw)
    return found.select(
        "doc_id",
        F.col("hit_words").alias("n_words"),
        n_hit().alias("n_hit"),
        F.size("hit_items").cast("long").alias("n_items"),
        F.sha2(F.concat_ws(",", "hit_items"), 256).alias("items_sha256"),
        contaminated(F.col("hit_words"), n_hit()).alias("contaminated"),
    )


def op4_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return report(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
