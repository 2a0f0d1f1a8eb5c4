"""SimHash near-dedup.

Fingerprint: 64 bits over the 3-word shingles of the lower-cased text (repeats included), a bit set where
over half of the shingles' XXH64 values (seed 42) have it. Two fingerprints link at 2 or fewer differing bits;
a component is what links reach.

Method: byte-position inverted index with count filtering. Fingerprints at 2 or fewer bits differ in at most 2 of
their 8 bytes, so they share at least 6 positional bytes and, of the four pairs of neighbouring bytes, at least two. The index
posts each fingerprint under each of the 6 choices of two of these pairs with the bytes there. For all that meet in a posting list the
shared positional bytes are tallied; those that reach the guaranteed minimum of 6 are verified bit by bit. (Lists by
single bytes would hold 1/256 of all fingerprints each, which grows with the square of the corpus.) A list of more than
``LIST_MOST`` fingerprints is not compared in pairs: two that link share at least 2 of the 4 bytes that are open in it, so it
is posted again under the 6 choices of those. In such a list only 16 bits are free, so it has at most 65,536
different fingerprints at any corpus size, and each looks up the values at 1 and 2 bits' distance. A list hands on a
spanning forest of its links, not its pairs, which leaves every component as it is.

Only different fingerprints are indexed, so copies cost nothing. Components come from alternating
large-star and small-star steps on the forest's edges, each step written to the shared folder.

Defined cases: a null or wordless text has fingerprint zero and is linked like any other. Repeated rows stay
separate rows. Null identifiers are never a component's name unless it has no other. Other columns are
not read.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.llm.common import append_columns, cut, id_and_text, table
from plumbline.operators.graph import components

SHINGLE = 3
SEED = 42
MAX_BITS = 2
LEAST_BYTES = 8 - MAX_BITS
#: The 6 choices of two of four.
CHOICES = tuple(combinations(range(4), 2))
#: Fingerprints of a list that are compared in pairs.
LIST_MOST = 1024


def set_bits(h: np.ndarray) -> int:
    """The fingerprint of some 64-bit hashes: the bits that over half of them have."""
    bits = np.unpackbits(h.astype("<u8").view(np.uint8).reshape(len(h), 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(bits * 2 > len(h), bitorder="little").view("<u8")[0])


def fingerprint(text: str | None) -> int:
    """The fingerprint as an unsigned number."""
    tokens = text.encode("utf-8", "surrogatepass").lower().split() if text else []
    if not tokens:
        return 0
    flat = b" ".join(tokens)
    n = len(tokens) - SHINGLE + 1
    if n <= 1:
        return xxhash.xxh64_intdigest(flat, SEED)
    ends = np.cumsum(np.fromiter(map(len, tokens), np.int64, len(tokens)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))[:n].tolist()
    digest = xxhash.xxh64_intdigest
    h = np.fromiter((digest(flat[a:b], SEED) for a, b in zip(starts, ends[SHINGLE - 1 :].tolist(), strict=True)), np.uint64, n)
    return set_bits(h)


def fingerprints(docs: DataFrame, text_col="text", out_col="fp", drop=()) -> DataFrame:
    """``docs`` with the fingerprint as a signed long."""

    def make():
        return lambda texts: [[f - (1 << 64) if (f := fingerprint(t)) >> 63 else f for t in texts]]

    return append_columns(docs, text_col, make, [(out_col, "long")], drop)


def _masks() -> np.ndarray:
    """All changes of 1 or 2 of 16 bits."""
    one = [1 << i for i in range(16)]
    return np.array(one + [a | b for a, b in combinations(one, 2)], np.int64)


def forest(values: np.ndarray) -> list[tuple[int, int]]:
    """A spanning forest of the links between different 16-bit values, as pairs of their places."""
    place = np.full(1 << 16, -1, np.int32)
    place[values] = np.arange(len(values))
    root = list(range(len(values)))

    def top(i):
        while root[i] != i:
            root[i] = root[root[i]]
            i = root[i]
        return i

    out = []
    masks = _masks()
    for i, v in enumerate(values.tolist()):
        near = place[v ^ masks]
        for j in near[near > i].tolist():
            a, b = top(i), top(j)
            if a != b:
                root[b] = a
                out.append((i, j))
    return out


def shared_bytes(x: np.ndarray) -> np.ndarray:
    """How many of their 8 bytes two fingerprints share, from their exclusive or."""
    x = x | x >> np.uint64(4)
    x = x | x >> np.uint64(2)
    x = (x | x >> np.uint64(1)) & np.uint64(0x0101010101010101)
    return 8 - np.bitwise_count(x)


def tallied(prints: np.ndarray) -> list[tuple[int, int]]:
    """A spanning forest, as pairs of places, of the links in one list: pairs that share enough bytes, verified."""
    root, out = np.arange(len(prints)), []
    for i in range(len(prints) - 1):
        x = prints[i + 1 :] ^ prints[i]
        x[shared_bytes(x) < LEAST_BYTES] = np.uint64(0xFFFFFFFFFFFFFFFF)
        for j in (i + 1 + np.flatnonzero(np.bitwise_count(x) <= MAX_BITS)).tolist():
            if root[i] != root[j]:
                root[root == root[j]] = root[i]
                out.append((i, j))
    return out


def links(prints: DataFrame) -> DataFrame:
    """Edges (a, b) between the different fingerprints of ``prints`` (column fp) that keep all components."""
    part = lambda k, bits: F.shiftrightunsigned("fp", bits * k).bitwiseAND(F.lit((1 << bits) - 1))
    posted = F.array(*(F.struct(F.lit(c).cast("int").alias("choice"), (part(a, 16) * 65536 + part(b, 16)).alias("key")) for c, (a, b) in enumerate(CHOICES)))
    index = prints.select("fp").repartition("fp").select("fp", F.explode(posted).alias("p")).select("p.choice", "p.key", "fp")
    sizes = cut(index.groupBy("choice", "key").agg(F.count(F.lit(1)).alias("n")).filter("n > 1"), "simhash-lists")
    members = index.join(sizes, ["choice", "key"])
    small = members.filter(F.col("n") <= LIST_MOST).groupBy("choice", "key").agg(F.collect_list("fp").alias("m")).select("m")

    def compared(batches):
        for batch in batches:
            a, b = [], []
            for m in batch["m"]:
                prints = np.array(m, np.int64).view(np.uint64)
                for i, j in tallied(prints):
                    a.append(m[i])
                    b.append(m[j])
            yield pd.DataFrame({"a": pd.Series(a, dtype="int64"), "b": pd.Series(b, dtype="int64")})

    out = small.mapInPandas(compared, "a long, b long")
    if sizes.filter(F.col("n") > LIST_MOST).isEmpty():
        return out.distinct()

    # The four open bytes of each choice, and for each two of them the two that stay free.
    again = []
    for c, at in enumerate(CHOICES):
        open_bytes = [byte for pair in range(4) if pair not in at for byte in (2 * pair, 2 * pair + 1)]
        for k, fixed in enumerate(CHOICES):
            a, b = (open_bytes[i] for i in fixed)
            low, high = (open_bytes[i] for i in range(4) if i not in fixed)
            again.append(F.when(F.col("choice") == c, F.struct(F.lit(k).cast("int").alias("sub"), (part(a, 8) * 256 + part(b, 8)).alias("bytes"), (part(high, 8) * 256 + part(low, 8)).cast("int").alias("v"))))
    large = members.filter(F.col("n") > LIST_MOST).select("choice", "key", "fp", F.explode(F.filter(F.array(*again), lambda s: s.isNotNull())).alias("s"))
    # Bounded: a list has as many members as two free bytes have values.
    lists = large.groupBy("choice", "key", "s.sub", "s.bytes").agg(F.collect_list(F.struct("s.v", "fp")).alias("m")).filter(F.size("m") > 1)

    def looked_up(batches):
        for batch in batches:
            a, b = [], []
            for members in batch["m"]:
                members = sorted(members, key=lambda m: m["v"])
                for i, j in forest(np.array([m["v"] for m in members], np.int64)):
                    a.append(members[i]["fp"])
                    b.append(members[j]["fp"])
            yield pd.DataFrame({"a": pd.Series(a, dtype="int64"), "b": pd.Series(b, dtype="int64")})

    return out.unionByName(lists.select("m").mapInPandas(looked_up, "a long, b long")).distinct()


def _signed(x: int) -> int:
    x &= (1 << 64) - 1
    return x - (1 << 64) if x >> 63 else x


def classes(docs: DataFrame, id_col="doc_id", text_col="text") -> DataFrame:
    """doc_id, fingerprint (16 hex digits) and component_id (the least doc_id reachable) of every row."""
    rows = cut(fingerprints(id_and_text(docs, id_col, text_col), drop=["text"]), "fingerprints")
    named = name_components(rows, "doc_id", "fp")
    out = rows.join(named.withColumnRenamed("fp", "__fp"), F.col("fp") == F.col("__fp"))
    return out.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def name_components(rows: DataFrame, id_col: str, fp_col: str, root: bool = False) -> DataFrame:
    """(fp, component_id) for every different fingerprint; with ``root`` (fp, root), the least fingerprint reachable."""
    prints = cut(rows.groupBy(F.col(fp_col).alias("fp")).agg(F.min(id_col).alias("first_id")), "prints")
    comp = components(links(prints))
    tied = prints.join(comp, prints["fp"] == comp["node"], "left").select("fp", "first_id", F.coalesce("root", "fp").alias("root"))
    if root:
        return tied.select("fp", "root")
    names = tied.groupBy("root").agg(F.min("first_id").alias("component_id")).withColumnRenamed("root", "__root")
    return tied.join(names, F.col("root") == F.col("__root")).select("fp", "component_id")


def op10_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classes(table(spark, sf_dir, "documents"))
