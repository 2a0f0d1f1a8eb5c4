"""Near copies by similarity: texts whose sets of 5-word shingles have a Jaccard similarity of 0.8 or more.

SimHash finds most of them: 64-bit fingerprints of the shingles, linked by the byte-position index of ``simhash_dedup``.
But distances of fingerprints guarantee nothing about this similarity, so a prefix index adds what they miss, and misses no pair: in
any one order of all shingles, two sets of similarity t share a shingle among the first n - ceil(t n) + 1 of each. The order
puts common shingles last, which keeps lists short: a pass over all texts counts shingles by the slots of a table of fixed
size, which is summed up by ranges of slots and broadcast. Results don't depend on it.

Candidates are sifted before any text is fetched, by rules that never rule out a similar pair: sizes, places in the list,
and parities. A text's parity bits say for each of m slots whether an odd number of its shingles falls there; each shingle that only
one of two texts has can change one bit, so more differing bits than dissimilar shingles allowed rule a pair out.
What is left is verified on whole texts, in three rounds: first one pair for each text, with the least of those that it met as, or together
with, the least member of a list; then one or two for each text that shares a list with texts of another component. These tie large groups of copies
together with few pairs. Last come all candidates that are still in different components, none left out.

Texts are read and never shuffled, but for those of candidates. Postings are packed as arrays, a row for each block of texts and
part of the shingles; parts are of about ``PART_POSTINGS`` postings and grow in number.

Defined cases: words as in SimHash. A text of fewer than five words is one shingle; wordless and null texts are alike. Texts are known by a 64-bit hash:
of ten billion different texts some two share one, and count as equal.
"""

from __future__ import annotations

import math
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.llm.common import append_columns, arrow_rows, cut, emit_rows, pack, unpack
from plumbline.llm.quality_rules import word_hashes
from plumbline.llm.simhash_dedup import _signed, links, set_bits
from plumbline.operators.graph import components

SHINGLE = 5
#: Similarity as a fraction, so that bounds are whole numbers.
NUM, DEN = 4, 5
#: Slots of the table of counts, those of one range, and shingles that a task counts at once.
SLOTS, RANGE_SLOTS = 1 << 20, 1 << 14
COUNT_AT_ONCE = 500_000
PART_POSTINGS = 1_000_000
FLUSH_POSTINGS = 400_000
#: Bytes of text to a posting, to tell the number of parts.
BYTES_A_POSTING = 30
#: Candidate pairs that are handed on at once, parity bits to a shingle, and most of a text.
PAIRS_AT_ONCE = 100_000
BITS_A_SHINGLE, LEAST_BITS, PARITY_BITS = 1, 256, 1 << 22
#: Members of a list that one task compares; a longer list is cut into tiles, each two of which are a group of their own.
TILE = 8192
_MIX = np.uint64(0x9E3779B97F4A7C15)


def shingles(text: str | None) -> np.ndarray:
    """The different shingles of a text as sorted hashes."""
    h = word_hashes(text.encode("utf-8", "surrogatepass").lower()) if text else np.zeros(0, np.uint64)
    size = min(SHINGLE, len(h))
    if not size:
        return np.zeros(1, np.uint64)
    out = np.zeros(len(h) - size + 1, np.uint64)
    for k in range(size):
        out = (out * _MIX) ^ h[k : k + len(out)]
    return np.unique(out ^ out >> np.uint64(31))


def similar(a: np.ndarray, b: np.ndarray) -> bool:
    if min(len(a), len(b)) * DEN < NUM * max(len(a), len(b)):
        return False
    both = len(np.intersect1d(a, b, assume_unique=True))
    return both * DEN >= NUM * (len(a) + len(b) - both)


def slot_of(found: np.ndarray, slots: int) -> np.ndarray:
    return ((found * _MIX) >> np.uint64(64 - (slots - 1).bit_length())).astype(np.int64)


def prefix(found: np.ndarray, rank: np.ndarray) -> np.ndarray:
    """The first n - ceil(t n) + 1 shingles: by the rank of their slot, then by hash."""
    n = len(found)
    k = n - -(-NUM * n // DEN) + 1
    return found[np.argsort(rank[slot_of(found, len(rank))], kind="stable")[:k]]


def possible(n, i, m, j):
    """Whether sets of sizes n and m whose first common shingle has places i and j (from 0) can be similar."""
    rest = np.minimum(n - i, m - j)
    return (np.minimum(n, m) * DEN >= NUM * np.maximum(n, m)) & (rest * (NUM + DEN) >= NUM * (n + m))


def parities(found: np.ndarray) -> np.ndarray:
    """The parity bits of a set as 64-bit words, their number a power of two: with fewer bits than shingles, sets that have nothing in common would not
    differ in enough of them to tell."""
    size = min(PARITY_BITS, max(LEAST_BITS, 1 << (BITS_A_SHINGLE * len(found) - 1).bit_length()))
    slots = np.bincount((found & np.uint64(size - 1)).astype(np.int64), minlength=size) & 1
    return np.packbits(slots.astype(np.uint8), bitorder="little").view(np.uint64)


def folded(bits: np.ndarray, words: int) -> np.ndarray:
    """The last axis of parity bits, folded to so many words: as if there had been fewer slots."""
    while bits.shape[-1] > words:
        half = bits.shape[-1] // 2
        bits = bits[..., :half] ^ bits[..., half:]
    return bits


class Members:
    """The members of a list: sizes, places, and parity bits in one table for each width."""

    def __init__(self, h, n, i, root, side, bits: list[bytes]):
        self.h, self.n, self.i, self.root, self.side = h, n, i, root, side
        raw = [np.frombuffer(b, np.uint64) for b in bits]
        self.width = np.array([len(b) for b in raw])
        self.row = np.zeros(len(raw), np.int64)
        self.tables = {}
        for w in set(self.width.tolist()):
            at = np.flatnonzero(self.width == w)
            self.row[at] = np.arange(len(at))
            self.tables[w] = np.stack([raw[k] for k in at.tolist()])

    def candidates(self, k: int, others: np.ndarray) -> np.ndarray:
        """Those of ``others`` that may be similar to member k and are in another component."""
        others = others[(self.root[others] != self.root[k]) & possible(self.n[k], self.i[k], self.n[others], self.i[others])]
        if not len(others):
            return others
        mine, keep = self.tables[self.width[k]][self.row[k]], np.zeros(len(others), bool)
        for w in set(self.width[others].tolist()):
            at = np.flatnonzero(self.width[others] == w)
            words = min(w, len(mine))
            x = folded(self.tables[w][self.row[others[at]]], words) ^ folded(mine, words)
            differ = np.bitwise_count(x).sum(axis=1, dtype=np.int64)
            # |A xor B| is at most (1 - t) / (1 + t) of |A| + |B| for a similar pair.
            keep[at] = differ * (NUM + DEN) <= (DEN - NUM) * (self.n[k] + self.n[others[at]])
        return others[keep]

    def all(self):
        """Each member with its candidates: those behind it, or, in a group of two tiles (sides 1 and 2), those of the other."""
        every = np.arange(len(self.h))
        for k in range(len(self.h)):
            others = every[k + 1 :] if not self.side[k] else every[self.side == 2] if self.side[k] == 1 else every[:0]
            found = self.candidates(k, others)
            if len(found):
                yield k, found


def _ranks(texts: DataFrame, slots: int) -> np.ndarray:
    """For each slot how common its shingles are, in steps that grow with the count: a byte."""
    size = min(RANGE_SLOTS, slots)

    def make():
        counts, held, seen = np.zeros(slots, np.uint32), [], set()

        def add():
            counts[:] += np.bincount(slot_of(np.concatenate(held), slots), minlength=slots).astype(np.uint32)
            held.clear()

        def fn(part):
            if part is not None:
                for h, text in zip(part.column("h").to_pylist(), part.column("text").to_pylist(), strict=True):
                    if h not in seen:
                        seen.add(h)
                        held.append(shingles(text))
                if sum(map(len, held)) >= COUNT_AT_ONCE:
                    add()
                return
            if held:
                add()
            for r in range(0, slots, size):
                if counts[r : r + size].any():
                    yield [r // size], [pack(counts[r : r + size])]

        return fn

    def added(group: pa.Table) -> pa.Table:
        total = np.zeros(size, np.uint64)
        for data in group["packed"]:
            total += unpack(data.as_py(), np.uint32)[0]
        return pa.table([group["range"].slice(0, 1), pa.array([pack(np.minimum(255, 8 * np.log2(1 + total)).astype(np.uint8))])], ["range", "packed"])

    parts = emit_rows(texts.select("h", "text"), make, [("range", "int"), ("packed", "binary")], finish=True)
    out = np.zeros(slots, np.uint8)
    for r in parts.groupBy("range").applyInArrow(added, "range int, packed binary").collect():
        out[r["range"] * size : (r["range"] + 1) * size] = unpack(bytes(r["packed"]), np.uint8)[0]
    return out


#: Packed postings: steps of the shingles' hashes, whose text, place in the prefix; then the texts and their sizes.
_POSTINGS = (np.uint64, np.uint32, np.uint32, np.int64, np.uint32)
_KEY_BITS = np.uint64(16)  # low bits of a hash that a list does without; a list too many is only more candidates


def _sets(texts: DataFrame, rank: np.ndarray, parts: int) -> DataFrame:
    """One pass over the texts: a row (h, n, fp, bits) for each different text of a task, and packed postings by part."""
    shared = texts.sparkSession.sparkContext.broadcast(rank)

    def make():
        rank = shared.value
        seen, held, table = set(), [], []

        def flush():
            size = [len(p) for p in held]
            key, text = np.concatenate(held) >> _KEY_BITS, np.repeat(np.arange(len(held)), size)
            place = np.concatenate([np.arange(n) for n in size])
            h, n = (np.array(c, np.int64) for c in zip(*table))
            held.clear()
            table.clear()
            at = ((key * _MIX) >> np.uint64(33)) % np.uint64(parts)
            order = np.lexsort((key, at))
            cuts = np.searchsorted(at[order], np.arange(parts + 1))
            for p in np.flatnonzero(np.diff(cuts)).tolist():
                i = order[cuts[p] : cuts[p + 1]]
                own, of = np.unique(text[i], return_inverse=True)
                packed = pack(np.diff(key[i], prepend=np.uint64(0)), of.astype(np.uint32), place[i].astype(np.uint32), h[own], n[own].astype(np.uint32))
                yield [p], [packed], *([None] for _ in range(4))

        def fn(part):
            if part is not None:
                rows = []
                for h, text in zip(part.column("h").to_pylist(), part.column("text").to_pylist(), strict=True):
                    if h in seen:
                        continue
                    seen.add(h)
                    found = shingles(text)
                    held.append(prefix(found, rank))
                    table.append((h, len(found)))
                    bits = parities(found)
                    rows.append((None, None, h, len(found), _signed(set_bits(found)), bits.tobytes()))
                if rows:
                    yield list(zip(*rows))
            if held and (part is None or sum(map(len, held)) >= FLUSH_POSTINGS):
                yield from flush()

        return fn

    fields = [("part", "int"), ("packed", "binary"), ("h", "long"), ("n", "int"), ("fp", "long"), ("bits", "binary")]
    return emit_rows(texts.select("h", "text"), make, fields, finish=True)


def _lists(packed: DataFrame, parts: int) -> DataFrame:
    """(list, h, n, i, h0, n0, i0) of every member of the index's lists of two texts or more; h0, n0, i0 are of the least member."""

    def run(batches):
        held, part = [], None

        def lists():
            found = [unpack(x, *_POSTINGS) for x in held]
            key = np.concatenate([np.cumsum(f[0], dtype=np.uint64) for f in found])
            h, n = (np.concatenate([f[c][f[1]] for f in found]) for c in (3, 4))
            place = np.concatenate([f[2] for f in found])
            order = np.lexsort((h, key))
            key, h, n, place = (x[order] for x in (key, h, n, place))
            new = np.concatenate(([True], (key[1:] != key[:-1]) | (h[1:] != h[:-1])))
            key, h, n, place = (x[new] for x in (key, h, n, place))
            same = key[1:] == key[:-1]
            more = np.concatenate((same, [False])) | np.concatenate(([False], same))
            first = np.maximum.accumulate(np.where(np.concatenate(([True], ~same)), np.arange(len(key)), 0))[more]
            columns = ((key[more], np.int64), (h[more], np.int64), (n[more], np.int32), (place[more], np.int32), (h[first], np.int64), (n[first], np.int32), (place[first], np.int32))
            out = pa.RecordBatch.from_arrays([pa.array(x.astype(t)) for x, t in columns], ["list", "h", "n", "i", "h0", "n0", "i0"])
            for start in range(0, out.num_rows, 1 << 14):
                yield out.slice(start, 1 << 14)

        for batch in batches:
            for p, data in zip(batch.column("part").to_pylist(), batch.column("packed")):
                if p != part and held:
                    yield from lists()
                    held = []
                part = p
                held.append(data.as_py())
        if held:
            yield from lists()

    return packed.repartition(parts, "part").sortWithinPartitions("part").mapInArrow(run, "list long, h long, n int, i int, h0 long, n0 int, i0 int")


def _first_pairs(lists: DataFrame) -> DataFrame:
    """(a, b) of each list's least member and the others."""
    n, m, i, j = (F.col(c) for c in ("n0", "n", "i0", "i"))
    can = (F.least(n, m) * DEN >= NUM * F.greatest(n, m)) & (F.least(n - i, m - j) * (NUM + DEN) >= NUM * (n + m))
    return lists.filter((F.col("h") != F.col("h0")) & can).select(F.col("h0").alias("a"), F.col("h").alias("b")).distinct()


def _sifted(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """Those of ``pairs`` that parities don't rule out."""
    side = lambda c: sets.select(F.col("h").alias(f"h_{c}"), F.col("n").alias(f"n_{c}"), F.col("bits").alias(f"bits_{c}"))
    both = pairs.join(side("a"), F.col("a") == F.col("h_a")).join(side("b"), F.col("b") == F.col("h_b")).select("a", "b", "n_a", "n_b", "bits_a", "bits_b")

    def make():
        def one(n, m, x, y):
            x, y = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
            words = min(len(x), len(y))
            differ = int(np.bitwise_count(folded(x, words) ^ folded(y, words)).sum())
            return differ * (NUM + DEN) <= (DEN - NUM) * (n + m)

        return lambda *columns: [[one(*row) for row in zip(*columns, strict=True)]]

    inputs = ["n_a", "n_b", "bits_a", "bits_b"]
    return append_columns(both, inputs, make, [("maybe", "boolean")], inputs).filter("maybe").select("a", "b")


def _other_pairs(members: DataFrame, first: bool = False) -> DataFrame:
    """(a, b) of all candidates of a list that are in different components, or only the ``first`` one of each member."""

    def run(batches):
        held: list = []
        made: list = [[], []]

        def flush():
            out = pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in made], ["a", "b"])
            made[0].clear()
            made[1].clear()
            return out

        def one_list():
            h, n, i, root, side = (np.concatenate([b.column(c).to_numpy().astype(np.int64) for b in held]) for c in ("h", "n", "i", "root", "side"))
            held_bits = [x for b in held for x in b.column("bits").to_pylist()]
            held.clear()
            order = np.argsort(h)
            m = Members(*(x[order] for x in (h, n, i, root, side)), [held_bits[k] for k in order.tolist()])
            for k, found in m.all():
                found = found[:1] if first else found
                made[0].append(np.full(len(found), m.h[k]))
                made[1].append(m.h[found])
                if sum(map(len, made[0])) >= PAIRS_AT_ONCE:
                    yield flush()

        name = None
        for batch in batches:
            at, tiles = batch.column("list").to_numpy(), batch.column("tiles").to_numpy()
            cuts = [0, *(np.flatnonzero(np.diff(at).astype(bool) | np.diff(tiles).astype(bool)) + 1).tolist(), len(at)]
            for lo, hi in zip(cuts[:-1], cuts[1:]):
                if lo == hi:
                    continue
                if (at[lo], tiles[lo]) != name and held:
                    yield from one_list()
                name = at[lo], tiles[lo]
                held.append(batch.slice(lo, hi - lo))
        if held:
            yield from one_list()
        if made[0]:
            yield flush()

    return members.repartition("list", "tiles").sortWithinPartitions("list", "tiles").mapInArrow(run, "a long, b long").distinct()


def _open(lists: DataFrame, roots: DataFrame) -> DataFrame:
    """(list, h, n, i, root, cuts) of the members of all lists that hold texts of two components or more, with the number of tiles of the list."""
    rows = lists.join(roots.withColumnRenamed("node", "__h"), F.col("h") == F.col("__h"), "left").withColumn("root", F.coalesce("root", "h")).drop("__h")
    open_lists = rows.groupBy("list").agg(F.min("root").alias("low"), F.max("root").alias("high"), F.count(F.lit(1)).alias("n")).filter("low < high")
    return rows.join(open_lists.select("list", F.ceil(F.col("n") / TILE).alias("cuts")), "list")


def _named(rows: DataFrame, sets: DataFrame) -> DataFrame:
    """Members of open lists with their parity bits; tiles and side tell the groups of a list that is longer than ``TILE``."""
    # Tile t of T meets every other one: the group (low, high) is numbered low * T + high.
    own, every = F.pmod(F.xxhash64("h"), F.col("cuts")), F.sequence(F.lit(0).cast("long"), F.col("cuts") - 1)
    group = lambda t: F.struct((F.least(own, t) * F.col("cuts") + F.greatest(own, t)).alias("tiles"), F.when(own == t, 0).when(own < t, 1).otherwise(2).alias("side"))
    rows = rows.withColumn("g", F.explode(F.transform(every, group))).select("list", "h", "n", "i", "root", "g.tiles", "g.side")
    return rows.join(sets.select(F.col("h").alias("__h"), "bits"), F.col("h") == F.col("__h")).drop("__h")


def _first_met(rows: DataFrame, sets: DataFrame) -> DataFrame:
    """(a, b): for each text of open lists a candidate in another component, by its least open list and by its greatest one. Near copies mostly
    agree on these, so groups of them grow together by as many pairs as they have texts, where all candidates would be pairs of all with all."""
    whole = F.struct("list", "n", "i", "root", "cuts")
    picked = rows.groupBy("h").agg(F.min(whole).alias("low"), F.max(whole).alias("high"))
    picked = cut(picked.select("h", F.explode(F.array_distinct(F.array("low", "high"))).alias("l")).select("l.list", "h", "l.n", "l.i", "l.root", "l.cuts"), "near-picked")
    return _other_pairs(_named(picked, sets), first=True)


def _apart(pairs: DataFrame, roots: DataFrame) -> DataFrame:
    """Those of ``pairs`` whose ends are in different components."""
    for c in ("a", "b"):
        side = roots.select(F.col("node").alias(f"__{c}"), F.col("root").alias(f"root_{c}"))
        pairs = pairs.join(side, F.col(c) == F.col(f"__{c}"), "left").withColumn(f"root_{c}", F.coalesce(f"root_{c}", c)).drop(f"__{c}")
    return pairs.filter("root_a <> root_b").select("a", "b")


def _verified(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """Those of ``pairs`` whose texts are similar. Texts are sifted by a table of bits, of a fixed size that is broadcast, before they
    are dealt out: one bit for each of 2 ** 24 values of the hash."""
    pairs = cut(pairs, "near-pairs")
    need = pairs.select(F.col("a").alias("h")).unionByName(pairs.select(F.col("b").alias("h"))).distinct()
    word, bit = F.col("h").bitwiseAND(F.lit((1 << 18) - 1)), F.shiftright("h", 18).bitwiseAND(F.lit(63)).cast("int")
    sieve = need.groupBy(word.alias("word")).agg(F.bit_or(F.expr("shiftleft(1L, cast(shiftright(h, 18) & 63 as int))")).alias("mask"))
    sieve = cut(sieve, "near-sieve")
    maybe = texts.select("h", "text").join(F.broadcast(sieve), word == F.col("word")).filter(F.getbit(F.col("mask"), bit) == 1).select("h", "text")
    found = cut(maybe.join(need, "h", "left_semi").groupBy("h").agg(F.first("text").alias("text")), "near-texts")
    side = lambda c: found.select(F.col("h").alias(f"h_{c}"), F.col("text").alias(f"text_{c}"))
    both = pairs.join(side("a"), F.col("a") == F.col("h_a")).join(side("b"), F.col("b") == F.col("h_b")).select("a", "b", "text_a", "text_b")

    def make():
        of = lru_cache(64)(shingles)
        return lambda x, y: [[similar(of(s), of(t)) for s, t in zip(x, y, strict=True)]]

    return cut(append_columns(both, ["text_a", "text_b"], make, [("similar", "boolean")], ["text_a", "text_b"]).filter("similar").select("a", "b"), "near-links")


def _by_fingerprint(sets: DataFrame) -> DataFrame:
    """(a, b) of texts with one fingerprint, each with the least of them, and of the least with linked fingerprints."""
    prints = cut(sets.groupBy("fp").agg(F.min("h").alias("first")), "near-prints")
    named = prints.select(F.col("fp").alias("__fp"), "first")
    equal = sets.join(named, F.col("fp") == F.col("__fp")).filter("h <> first").select(F.col("first").alias("a"), F.col("h").alias("b"))
    edges = links(prints.select("fp"))
    for c in ("a", "b"):
        edges = edges.join(named.withColumnRenamed("first", f"h_{c}"), F.col(c) == F.col("__fp")).drop("__fp")
    return equal.unionByName(edges.select(F.least("h_a", "h_b").alias("a"), F.greatest("h_a", "h_b").alias("b")))


def near_copies(texts: DataFrame) -> DataFrame:
    """(node, root) for every text hash with a near copy: the least hash of its component. ``texts`` has h, a hash
    of the text, and text; rows may repeat."""
    with arrow_rows(texts.sparkSession):
        size = texts.agg(F.count(F.lit(1)).alias("rows"), F.sum(F.octet_length("text")).alias("bytes")).first()
        parts = max(8, math.ceil(((size["bytes"] or 0) / BYTES_A_POSTING + size["rows"]) / PART_POSTINGS))
        made = cut(_sets(texts, _ranks(texts, SLOTS), parts), "near-sets")
        sets = made.filter("h is not null").select("h", "n", "fp", "bits").dropDuplicates(["h"])
        lists = cut(_lists(made.filter("packed is not null").select("part", "packed"), parts), "near-lists")
        maybe = cut(_sifted(_by_fingerprint(sets).unionByName(_first_pairs(lists)).distinct(), sets), "near-maybe")
        least = maybe.groupBy(F.greatest("a", "b").alias("b")).agg(F.min(F.least("a", "b")).alias("a")).select("a", "b")
        edges = _verified(least, texts)
        roots = components(edges)
        lists = lists.select("list", "h", "n", "i")
        tied = _verified(_first_met(_open(lists, roots), sets), texts)
        if not tied.isEmpty():
            edges = edges.unionByName(tied)
            roots = components(edges)
        met = _other_pairs(_named(_open(lists, roots), sets))
        others = _apart(maybe, roots).unionByName(_sifted(met, sets)).distinct()
        more = _verified(others, texts)
        return roots if more.isEmpty() else components(edges.unionByName(more))
