"""Language-model scoring.

Method: deleted interpolation. A text's tokens are its lower-cased words and one end; a token's probability
after the word before it (or the text's start) mixes three estimates: the bigram maximum-likelihood
estimate c(v w) / c(v), the unigram one c(w) / N and the uniform one 1 / (V + 1), which leaves room for one unknown
word. The three weights depend on the bucket of the context's frequency (powers of two) and are learned by
expectation-maximisation on held-out counts: a seventh of the training documents is deleted from
the counts, and the weights make its tokens most probable. Scoring then uses all training counts.

How it is laid out, with N tokens in all:

1. Word counts: counted within a task, summed by word hash. The ``HEAD_WORDS`` most frequent words with their
   counts are broadcast (a fixed bound); the counts of rarer words travel to where they are used.
2. Events: one pass turns texts into bigram events. Texts that repeat within a block of events are taken once,
   with the number of times they stand in the training part. Bigrams of the ``HOT_WORDS`` most frequent words are
   counted as a table of fixed size, so that the most frequent bigrams never meet in one task. All others are packed
   as compressed arrays, one row for each block and model part, and dealt out by part. Events with a rare word go
   to that word's part, where its count goes too; where both words are rare, they go on to the second one's part.
   Parts are of about ``PART_EVENTS`` events and grow in number, not in size. Beyond ``FAN_OUT`` parts, events are dealt out in
   two steps, so that packed rows stay of a useful size.
3. A model part counts its bigrams. It gives its evidence for the weights, and for each event its text and which of
   the part's different (bigram, context, word) counts it has: all that scoring needs once the weights are known, so texts'
   events are dealt out by part once. Then every part's share of a text's score is packed by block of texts and added up.
   Every bigram of the corpus counts and what is gathered grows with it; nothing is cut off.

Defined cases: a null text is the empty text: one end token. Equal texts have equal scores. Without training
documents every probability is 1 and the scores are 0. Words are known by 64-bit hash. Repeated rows stay separate
rows. Other columns are not read.
"""

from __future__ import annotations

import math
from collections import Counter
from itertools import groupby, repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from plumbline.llm.common import ARROW, arrow_rows, crc_mod, cut, emit_rows, pack, slices, table, unpack

HEAD_WORDS = 1 << 18
HOT_WORDS = 1024
PART_EVENTS = 1_000_000
#: Events of a block of texts, which are packed together. A block has at most 2 ** TEXT_BITS different texts.
FLUSH_EVENTS = 300_000
TEXT_BITS, BLOCK_BITS = 20, 20
#: Parts that one pass deals out to at once, and most tasks of a step; a task may hold many parts.
FAN_OUT, MAX_TASKS = 4096, 20_000
#: Of 7 parts by identifier: never trained on, and deleted from the counts while weights are learned.
HELD_OUT, DELETED, PARTS = 2, 3, 7
_MEMO = 100_000
#: Different words that a task counts before it hands their counts on.
FLUSH_WORDS = 300_000
_UNSEEN = -(1 << 63)
_MIX = np.uint64(0x9E3779B97F4A7C15)

#: The end of a text as a token, the start as a context; no word has a space.
END, START = b" end", b" start"


def tokens(text: str | None) -> list[bytes]:
    return text.encode("utf-8", "surrogatepass").lower().split() if text else []


def code(word: bytes) -> int:
    """A negative number for a word, from its hash."""
    return -(xxhash.xxh64_intdigest(word) >> 1) - 1


def word_counts(docs: DataFrame) -> DataFrame:
    """(code, c, deleted): how often a word occurs in training texts, and in those among them to be deleted."""

    def make():
        counts = [Counter(), Counter()]

        def flush():
            words = list(counts[0].keys() | counts[1].keys())
            kept, gone = ([c[w] for w in words] for c in counts)
            counts[0].clear()
            counts[1].clear()
            yield list(map(code, words)), [a + b for a, b in zip(kept, gone)], gone

        def fn(part):
            if part is not None:
                for text, flag in zip(part.column("text").to_pylist(), part.column("flag").to_pylist(), strict=True):
                    c = counts[flag - 1]
                    c.update(tokens(text))
                    c[END] += 1
            if part is None or len(counts[0]) + len(counts[1]) > FLUSH_WORDS:
                yield from flush()

        return fn

    parts = emit_rows(docs.filter("flag > 0").select("text", "flag"), make, [("code", "long"), ("c", "long"), ("deleted", "long")], finish=True)
    return parts.groupBy("code").agg(F.sum("c").alias("c"), F.sum("deleted").alias("deleted"))


class Head:
    """The most frequent words: number by hash, and counts by number. Number 0 is the end, 1 the start."""

    def __init__(self, codes, c, deleted, start, total, kinds):
        order = np.argsort(codes, kind="stable")
        self.codes, self.place = codes[order], order
        self.c, self.deleted = c, deleted
        self.start = start  # (training texts, deleted texts): the counts of the start as a context
        self.n, self.n_deleted = total
        self.kinds = kinds
        # Each token of a rare word is in two events.
        n_events = self.n - int(c.sum())
        self.parts = max(8, math.ceil(self.n / PART_EVENTS)), max(8, math.ceil(2 * n_events / PART_EVENTS))

    def find(self, codes: np.ndarray) -> np.ndarray:
        """The number of each word, -1 for rare ones."""
        i = np.minimum(np.searchsorted(self.codes, codes), len(self.codes) - 1)
        return np.where(self.codes[i] == codes, self.place[i], -1)

    def counts(self, a: np.ndarray, b: np.ndarray):
        """(context, word) counts of head words, each (in training, deleted). ``a`` may be the start."""
        start = a == 1
        context = tuple(np.where(start, s, x[a]) for x, s in zip((self.c, self.deleted), self.start))
        return context, (self.c[b], self.deleted[b])

    def rare_part(self, codes: np.ndarray) -> np.ndarray:
        """The part of a rare word, after those of head words."""
        return self.parts[0] + part_of(codes.astype(np.uint64), self.parts[1]).astype(np.int64)


class Numbers(dict):
    """Word to its number in the head, or to its negative code; filled for many words at once."""

    def __init__(self, head: Head):
        super().__init__()
        self.head = head

    def of(self, found: list[bytes]) -> np.ndarray:
        ids = np.fromiter(map(self.get, found, repeat(_UNSEEN)), np.int64, len(found))
        at = np.flatnonzero(ids == _UNSEEN)
        if len(at):
            unseen = [found[i] for i in at.tolist()]
            new = list(set(unseen))
            codes = np.fromiter(map(code, new), np.int64, len(new))
            places = self.head.find(codes)
            own = dict(zip(new, np.where(places < 0, codes, places).tolist()))
            ids[at] = np.fromiter(map(own.__getitem__, unseen), np.int64, len(at))
            if len(self) + len(own) > _MEMO:
                self.clear()
            self.update(own)
        return ids


def bigrams(texts: list, numbers: Numbers) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text, context, word) of every token of some texts, by number: the start before the first word, the end last."""
    found, sizes = [], []
    for t in texts:
        n = len(found)
        found += tokens(t)
        sizes.append(len(found) - n)
    sizes = np.array(sizes, np.int64)
    text = np.repeat(np.arange(len(texts)), sizes + 1)
    ends = np.cumsum(sizes + 1) - 1
    word = np.zeros(len(text), np.int64)
    mask = np.ones(len(text), bool)
    mask[ends] = False
    word[mask] = numbers.of(found)
    context = np.empty(len(text), np.int64)
    context[1:] = word[:-1]
    context[ends - sizes] = 1
    return text, context, word


def learn_head(counts: DataFrame, docs: DataFrame) -> Head:
    """The head's words and the totals, collected: at most HEAD_WORDS rows. ``counts`` holds the end like a word."""
    total = counts.agg(F.sum("c").alias("n"), F.sum("deleted").alias("d"), F.count(F.lit(1)).alias("v")).first()
    texts = docs.agg(F.sum((F.col("flag") > 0).cast("long")).alias("n"), F.sum((F.col("flag") == 2).cast("long")).alias("d")).first()
    # Counts below the one that leaves at most HEAD_WORDS words stay out, all alike.
    by_count = counts.groupBy("c").agg(F.count(F.lit(1)).alias("words")).orderBy(F.desc("c")).limit(HEAD_WORDS).toArrow()
    cs, words = by_count["c"].to_numpy(), by_count["words"].to_numpy()
    fits = np.cumsum(words) <= HEAD_WORDS - 1
    least = int(cs[fits][-1]) if fits.any() else (1 << 62)
    end = code(END)
    rows = counts.filter((F.col("c") >= least) & (F.col("code") != end)).toArrow()  # at most HEAD_WORDS rows
    codes, c, d = (rows[k].to_numpy() for k in ("code", "c", "deleted"))
    order = np.lexsort((codes, -c))
    codes, c, d = codes[order], c[order], d[order]
    n, gone = texts["n"] or 0, texts["d"] or 0
    codes = np.concatenate(([end, code(START)], codes)).astype(np.int64)
    return Head(codes, np.concatenate(([n, 0], c)).astype(np.int64), np.concatenate(([gone, 0], d)).astype(np.int64), (n, gone), (total["n"] or 0, total["d"] or 0), total["v"] or 0)


def part_of(keys: np.ndarray, parts: int) -> np.ndarray:
    return ((keys * _MIX) >> np.uint64(33)) % np.uint64(parts)


#: Kinds of rows, and what is packed in them. Events: steps from key to key (of the word, where it is rare), text, how
#: often that text is in the training part and in its deleted part. Rare events: the other word, and whether it stands first.
HEAD_EVENTS, RARE_EVENTS, WORDS, SECOND_EVENTS, HOT_COUNTS, TEXTS, DOCUMENT, EVIDENCE, SCORED = range(9)
PACKED = {
    HEAD_EVENTS: (np.uint64, np.uint64, np.uint32, np.uint32),
    RARE_EVENTS: (np.uint64, np.uint64, np.uint32, np.uint32, np.int64, np.bool_),
    WORDS: (np.int64,) * 3,
    # Of each bigram: second word, context counts, own counts. Of each event: text, bigram.
    SECOND_EVENTS: (*(np.int64,) * 5, np.uint64, np.uint32),
    HOT_COUNTS: (np.int64,) * 3,
    # Of each text: number, tokens, known tokens, base score, hot bigrams; then the cells of all hot bigrams.
    TEXTS: (np.uint64, np.uint32, np.uint32, np.float64, np.uint32, np.uint32),
    EVIDENCE: (np.int64, np.int64, np.int64, np.float64, np.float64, np.float64),
    # Of each event, by text: steps from text to text, and which counts. The different counts: bigram, context, word, rare word.
    SCORED: (np.uint64, np.uint32, np.int64, np.int64, np.int64, np.bool_),
}
_ROW = [("kind", "int"), ("part", "long"), ("packed", "binary"), ("text_no", "long"), ("held_out", "boolean")]


def by_part(at: np.ndarray, keys, *columns):
    """(part, packed) rows of events, sorted by key: steps of the keys, then the columns."""
    order = np.lexsort((keys, at))
    at = at[order]
    cuts = np.concatenate(([0], np.flatnonzero(np.diff(at)) + 1, [len(at)]))
    for lo, hi in zip(cuts[:-1].tolist(), cuts[1:].tolist()):
        i = order[lo:hi]
        yield int(at[lo]), pack(np.diff(keys[i], prepend=np.uint64(0)), *(c[i] for c in columns))


class Block:
    """Texts of a task until they are flushed as events: every different text once, with its events' words by number."""

    def __init__(self, first: int):
        self.first, self.place, self.times, self.events = first, {}, [[], []], []
        self.n_events = 0

    def add(self, keys: list[int], flags: list[int]) -> tuple[list[int], list[int]]:
        """(place of each text in the block, rows whose text is new)."""
        at, new = [], []
        train, deleted = self.times
        for row, (key, flag) in enumerate(zip(keys, flags)):
            place = self.place.setdefault(key, len(train))
            if place == len(train):
                train.append(0)
                deleted.append(0)
                new.append(row)
            train[place] += flag > 0
            deleted[place] += flag == 2
            at.append(place)
        return at, new

    def full(self) -> bool:
        return self.n_events >= FLUSH_EVENTS or len(self.times[0]) >= 1 << TEXT_BITS - 1

    def take(self):
        """(text, context, word) of all events, and (times in training, times deleted) by text."""
        text, a, b = map(np.concatenate, zip(*self.events, strict=True))
        return text, a, b, *(np.array(t, np.uint32) for t in self.times)


class Rows:
    """Makes batches of one schema from the columns that a kind of row has."""

    def __init__(self, id_type):
        self.kinds = {n: ARROW[k][1] for n, k in _ROW} | {"doc_id": id_type}

    def __call__(self, size: int, **columns) -> pa.RecordBatch:
        arrays = [pa.nulls(size, t) if (c := columns.get(n)) is None else c if isinstance(c, pa.Array) else pa.array(c, t) for n, t in self.kinds.items()]
        return pa.RecordBatch.from_arrays(arrays, list(self.kinds))

    def packed(self, kind: int, rows):
        for p, data in rows:
            yield self(1, kind=[kind], part=[p], packed=[data])


def row_schema(docs: DataFrame) -> T.StructType:
    return T.StructType([*(T.StructField(n, ARROW[k][0]) for n, k in _ROW), T.StructField("doc_id", docs.schema["doc_id"].dataType)])


def events(docs: DataFrame, shared) -> DataFrame:
    """All that is taken from the texts, in one pass: events by model part, the counts of hot bigrams, rows of texts with
    their tokens, their head words' share of n_known and base_score and their hot bigrams as cells of the hot table, and a
    row for each document with its text."""

    def run(batches):
        head, task = shared.value, TaskContext.get().partitionId()
        numbers = Numbers(head)
        word_logs, word_known = base_log(head.c, head.n, head.kinds), (head.c > 0).astype(np.float64)
        hot = np.zeros((2, HOT_WORDS * HOT_WORDS), np.int64)
        block = Block(task << TEXT_BITS + BLOCK_BITS)
        make = None
        no_part = -1 - task % 1024  # what isn't of a model part, spread over the tasks that follow

        def flush():
            if not block.events:
                return
            text, a, b, train, deleted = block.take()
            is_hot = (a >= 0) & (a < HOT_WORDS) & (b >= 0) & (b < HOT_WORDS)
            cells, of = (a * HOT_WORDS + b)[is_hot], text[is_hot]
            np.add.at(hot[0], cells, train[of])
            np.add.at(hot[1], cells, deleted[of])
            rare = (a < 0) | (b < 0)
            number = text.astype(np.uint64) + np.uint64(block.first)
            if rare.any():
                x, y, second = np.where(a < 0, a, b)[rare], np.where(a < 0, b, a)[rare], (a >= 0)[rare]
                of = text[rare]
                yield from make.packed(RARE_EVENTS, by_part(first_hop(head.rare_part(x)), x.view(np.uint64), number[rare], train[of], deleted[of], y, second))
            cold = ~(is_hot | rare)
            text, key = text[cold], (a[cold].astype(np.uint64) << np.uint64(32)) | b[cold].astype(np.uint64)
            if len(text):
                yield from make.packed(HEAD_EVENTS, by_part(first_hop(part_of(key, head.parts[0]).astype(np.int64)), key, number[cold], train[text], deleted[text]))

        for part in slices(batches):
            make = make or Rows(part.column("doc_id").type)
            flags, texts = part.column("flag").to_pylist(), part.column("text")
            at, new = block.add(part.column("text_key").to_pylist(), flags)
            size = len(flags)
            yield make(size, kind=np.full(size, DOCUMENT), part=np.full(size, no_part), doc_id=part.column("doc_id"), text_no=block.first + np.array(at), held_out=[f == 0 for f in flags])
            if new:
                size, places = len(new), np.array([at[i] for i in new])
                doc, a, b = bigrams(texts.take(pa.array(new)).to_pylist(), numbers)
                block.events.append((places[doc].astype(np.uint32), a, b))
                block.n_events += len(doc)
                own, is_hot = b >= 0, (a >= 0) & (a < HOT_WORDS) & (b >= 0) & (b < HOT_WORDS)
                known, base = (np.bincount(doc[own], x[b[own]], minlength=size) for x in (word_known, word_logs))
                cells = (a * HOT_WORDS + b)[is_hot].astype(np.uint32)
                own_texts = (block.first + places).astype(np.uint64), np.bincount(doc, minlength=size), np.rint(known), base, np.bincount(doc[is_hot], minlength=size), cells
                yield from make.packed(TEXTS, [(no_part, pack(*(x.astype(t) for x, t in zip(own_texts, PACKED[TEXTS]))))])
            if block.full():
                yield from flush()
                block = Block(block.first + (1 << TEXT_BITS))
        yield from flush()
        if len(at := np.flatnonzero(hot[0])):
            yield from make.packed(HOT_COUNTS, [(no_part, pack(at, hot[0][at], hot[1][at]))])

    return docs.select("doc_id", "text", "text_key", "flag").mapInArrow(run, row_schema(docs))


def first_hop(parts: np.ndarray) -> np.ndarray:
    """Where events go first: to their part or, with more parts than FAN_OUT, to their group of parts."""
    return parts % FAN_OUT


def rare_words(counts: DataFrame, shared, docs: DataFrame) -> DataFrame:
    """The counts of rare words as packed rows by their part."""

    def run(batches):
        head, held = shared.value, []
        make = Rows(id_type)

        def flush():
            codes, c, d = map(np.concatenate, zip(*held, strict=True))
            held.clear()
            rare = head.find(codes) < 0
            codes, c, d = codes[rare], c[rare], d[rare]
            at = head.rare_part(codes)
            order = np.argsort(at, kind="stable")
            cuts = np.concatenate(([0], np.flatnonzero(np.diff(at[order])) + 1, [len(at)]))
            for lo, hi in zip(cuts[:-1].tolist(), cuts[1:].tolist()):
                if hi > lo:
                    i = order[lo:hi]
                    yield from make.packed(WORDS, [(int(at[i[0]]), pack(codes[i], c[i], d[i]))])

        for batch in batches:
            held.append([batch.column(k).to_numpy() for k in ("code", "c", "deleted")])
            if sum(len(x[0]) for x in held) >= FLUSH_EVENTS:
                yield from flush()
        if held:
            yield from flush()

    schema = row_schema(docs)
    id_type = to_arrow_type(schema["doc_id"].dataType)
    return counts.select("code", "c", "deleted").mapInArrow(run, schema)


def grouped(batches):
    """Runs of equal parts from a partition sorted by part: (part, batches) for model parts, (None, batch) for other rows."""

    def runs():
        for batch in batches:
            at = batch.column("part").to_numpy()
            cuts = [0, *(np.flatnonzero(np.diff(at)) + 1).tolist(), len(at)]
            for lo, hi in zip(cuts[:-1], cuts[1:]):
                if hi > lo:
                    yield int(at[lo]), batch.slice(lo, hi - lo)

    for part, found in groupby(runs(), lambda r: r[0]):
        if part < 0:
            yield from ((None, r) for _, r in found)
        else:
            yield part, [r for _, r in found]


def unpacked(found: list[pa.RecordBatch], kind: int):
    """The arrays of all rows of a kind, joined; None without any. Keys that are held as steps are summed up."""
    out = []
    for batch in found:
        for k, data in zip(batch.column("kind").to_pylist(), batch.column("packed")):
            if k == kind:
                arrays = unpack(data.as_py(), *PACKED[kind])
                if kind in (HEAD_EVENTS, RARE_EVENTS):
                    arrays[0] = np.cumsum(arrays[0], dtype=np.uint64)
                elif kind == SECOND_EVENTS:
                    arrays[6] = arrays[6] + sum(len(o[0]) for o in out)
                out.append(arrays)
    return [np.concatenate(c) for c in zip(*out, strict=True)] if out else None


def redealt(made: DataFrame, shared, docs: DataFrame) -> DataFrame:
    """The second step of dealing out, for more than FAN_OUT parts: events of a group of parts go to their own part."""
    schema = row_schema(docs)
    id_type = to_arrow_type(schema["doc_id"].dataType)

    def run(batches):
        head, make = shared.value, Rows(id_type)

        def flush(held):
            for kind in (HEAD_EVENTS, RARE_EVENTS):
                if (got := unpacked(held, kind)) is not None:
                    key = got[0]
                    at = part_of(key, head.parts[0]).astype(np.int64) if kind == HEAD_EVENTS else head.rare_part(key.view(np.int64))
                    yield from make.packed(kind, by_part(at, *got))

        held: list = []
        for batch in batches:
            moved = np.isin(batch.column("kind").to_numpy(), (HEAD_EVENTS, RARE_EVENTS))
            if not moved.all():
                yield batch.filter(pa.array(~moved))
            held.append(batch.filter(pa.array(moved)))
            if sum(b.nbytes for b in held) >= 8 * FLUSH_EVENTS:
                yield from flush(held)
                held = []
        yield from flush(held)

    return made.repartition(FAN_OUT, "part").sortWithinPartitions("part").mapInArrow(run, schema)


def model_parts(rows: DataFrame, shared) -> DataFrame:
    """EVIDENCE and SCORED rows of every model part of ``rows``, SECOND_EVENTS to be dealt out again, and all other rows as they are."""
    schema = rows.schema
    id_type = to_arrow_type(schema["doc_id"].dataType)

    def run(batches):
        head, make = shared.value, Rows(id_type)
        n_kept = head.n - head.n_deleted
        no_part = -1 - TaskContext.get().partitionId() % 1024

        def scored(pair, context, word, rare, texts, of):
            """The evidence and the events' counts of some bigrams; ``of`` gives each event's bigram."""
            yield from make.packed(EVIDENCE, [(no_part, pack(*(x.astype(t) for x, t in zip(evidence(pair, context, word, n_kept), PACKED[EVIDENCE]))))])
            counts = (pair[0], context[0], word[0], rare)
            mixed = np.zeros(len(rare), np.uint64)
            for x in counts:
                mixed = (mixed ^ x.astype(np.uint64)) * _MIX
                mixed ^= mixed >> np.uint64(29)
            _, first, which = np.unique(mixed, return_index=True, return_inverse=True)
            order = np.argsort(texts, kind="stable")
            texts = texts[order]
            yield from make.packed(SCORED, [(no_part, pack(np.diff(texts, prepend=np.uint64(0)), which[of[order]].astype(np.uint32), *(x[first].astype(t) for x, t in zip(counts, PACKED[SCORED][2:]))))])

        def sums(of, size, *times):
            return tuple(np.rint(np.bincount(of, t, minlength=size)).astype(np.int64) for t in times)

        def head_events(found):
            if (got := unpacked(found, HEAD_EVENTS)) is None:
                return
            key, texts, train, deleted = got
            kinds, of = np.unique(key, return_inverse=True)
            pair = sums(of, len(kinds), train, deleted)
            context, word = head.counts((kinds >> np.uint64(32)).astype(np.int64), (kinds & np.uint64(0xFFFFFFFF)).astype(np.int64))
            yield from scored(pair, context, word, np.zeros(len(kinds), bool), texts, of)

        def lookup(words, codes):
            """The counts of rare words; those never seen in training have none."""
            if words is None or not len(words[0]):
                return np.zeros(len(codes), np.int64), np.zeros(len(codes), np.int64)
            order = np.argsort(words[0])
            i = np.minimum(np.searchsorted(words[0], codes, sorter=order), len(order) - 1)
            hit = words[0][order[i]] == codes
            return tuple(np.where(hit, x[order[i]], 0) for x in words[1:])

        def rare_events(found):
            words = unpacked(found, WORDS)
            if (got := unpacked(found, RARE_EVENTS)) is not None:
                key, texts, train, deleted, other, second = got
                own = key.view(np.int64)
                mixed = ((key * _MIX) ^ (other.view(np.uint64) + (other.view(np.uint64) << np.uint64(21)) + second)) * _MIX
                _, first, of = np.unique(mixed, return_index=True, return_inverse=True)
                own, other, second = own[first], other[first], second[first]
                pair, mine = sums(of, len(first), train, deleted), lookup(words, own)
                theirs = np.maximum(other, 0)
                (ac, ad), (bc, bd) = head.counts(theirs, theirs)
                context = np.where(second, ac, mine[0]), np.where(second, ad, mine[1])
                word = np.where(second, mine[0], bc), np.where(second, mine[1], bd)
                on = other < 0  # both words are rare: the second one's count is elsewhere
                if not on.all():
                    place, here = np.cumsum(~on) - 1, ~on[of]
                    yield from scored(*(tuple(x[~on] for x in c) for c in (pair, context, word)), second[~on], texts[here], place[of[here]])
                if on.any():
                    at = head.rare_part(other)
                    events_on = np.flatnonzero(on[of])
                    events_on = events_on[np.argsort(at[of[events_on]], kind="stable")]
                    targets = at[of[events_on]]
                    cuts = np.concatenate(([0], np.flatnonzero(np.diff(targets)) + 1, [len(targets)]))
                    for lo, hi in zip(cuts[:-1].tolist(), cuts[1:].tolist()):
                        i = events_on[lo:hi]
                        pairs, mine_of = np.unique(of[i], return_inverse=True)
                        yield from make.packed(SECOND_EVENTS, [(int(targets[lo]), pack(other[pairs], context[0][pairs], context[1][pairs], pair[0][pairs], pair[1][pairs], texts[i], mine_of.astype(np.uint32)))])
            if (got := unpacked(found, SECOND_EVENTS)) is not None:
                codes, ac, ad, pc, pd, texts, of = got
                yield from scored((pc, pd), (ac, ad), lookup(words, codes), np.ones(len(codes), bool), texts, of)

        for part, found in grouped(batches):
            if part is None:
                yield found
            elif part < head.parts[0]:
                yield from head_events(found)
            else:
                yield from rare_events(found)

    tasks = min(sum(shared.value.parts), MAX_TASKS)
    return rows.repartition(tasks, "part").sortWithinPartitions("part").mapInArrow(run, schema)


def bucket(c: np.ndarray) -> np.ndarray:
    """0 for a context never seen, else 1 + the power of two."""
    return np.where(c > 0, np.frexp(np.maximum(c, 1).astype(np.float64))[1], 0)


def ratio(a, b):
    return np.divide(a, b, out=np.zeros(len(a)), where=b > 0)


#: Estimates are binned by eighths of powers of two for the weights; within a bin their mean is used.
BINS = 8


def evidence(pair, context, word, n_kept):
    """(bucket, bin of bigram estimate, bin of unigram estimate, tokens, and the sums of the estimates) of deleted tokens."""
    w = pair[1]
    at = np.flatnonzero(w)
    if not len(at):
        return [np.zeros(0)] * 6
    kept = [(x[0] - x[1])[at] for x in (pair, context, word)]
    w = w[at].astype(np.float64)
    f2, f1 = ratio(kept[0], kept[1]), kept[2] / max(n_kept, 1)
    bins = [np.where(f > 0, np.floor(BINS * np.log2(np.maximum(f, 1e-300))), -10_000).astype(np.int64) for f in (f2, f1)]
    keys, of = np.unique(np.stack((bucket(kept[1]).astype(np.int64), *bins)), axis=1, return_inverse=True)
    of = of.reshape(-1)
    return [*keys, *(np.bincount(of, x) for x in (w, w * f2, w * f1))]


EVIDENCE_FIELDS = [("bucket", "long"), ("bin2", "long"), ("bin1", "long"), ("w", "double"), ("s2", "double"), ("s1", "double")]


def mixture(rows, uniform: float, rounds: int = 200) -> np.ndarray:
    """Weights (bigram, unigram, uniform) for each bucket by expectation-maximisation. Buckets lean on
    the weights of all together by ten tokens, and the uniform part keeps a little everywhere."""
    out = np.tile([0.4, 0.4, 0.2], (64, 1))
    if len(rows["w"]):
        b, w = rows["bucket"].astype(int), rows["w"]
        f = np.stack((rows["s2"] / w, rows["s1"] / w, np.full(len(w), uniform)))
        pooled = np.array([0.4, 0.4, 0.2])
        for _ in range(rounds):
            joint = f * pooled[:, None]
            pooled = (joint / joint.sum(0) * w).sum(1) / w.sum()
            pooled = np.maximum(pooled, 1e-6) / np.maximum(pooled, 1e-6).sum()
        out[:] = pooled
        for _ in range(rounds):
            joint = f * out[b].T
            post = joint / joint.sum(0) * w
            sums = np.stack([np.bincount(b, p, minlength=64) for p in post], axis=1) + 10 * pooled
            out = sums / sums.sum(1, keepdims=True)
    out[0] = [0, *(out[0, 1:] / out[0, 1:].sum())]  # without a context count there is no bigram estimate
    out = np.maximum(out, [0, 1e-6, 1e-6])
    return out / out.sum(1, keepdims=True)


def log_prob(pair, context, word, weights, n, uniform):
    lam = weights[bucket(context)]
    return np.log10(lam[:, 0] * ratio(pair, context) + lam[:, 1] * (word / max(n, 1)) + lam[:, 2] * uniform)


def base_log(c, n, kinds):
    return np.log10((c + 1) / (n + kinds + 1))


#: A block's share of its texts' sums: text in the block, tokens, known tokens, base score, score.
_SHARE = (np.uint32, np.uint32, np.uint32, np.float64, np.float64)
_LOCAL = np.uint64((1 << TEXT_BITS) - 1)


def by_block(texts: np.ndarray, *columns):
    """(block, packed share) rows of sums by text, in order of the texts."""
    block = (texts >> np.uint64(TEXT_BITS)).astype(np.int64)
    cuts = np.concatenate(([0], np.flatnonzero(np.diff(block)) + 1, [len(block)]))
    for lo, hi in zip(cuts[:-1].tolist(), cuts[1:].tolist()):
        if hi > lo:
            yield int(block[lo]), pack(*(c[lo:hi].astype(t) for c, t in zip((texts & _LOCAL, *columns), _SHARE)))


def shares(made: DataFrame, weights: np.ndarray, n: int, kinds: int, hot_logs) -> DataFrame:
    """(block, packed) of the sums of events and of texts' own rows."""
    uniform = 1 / (kinds + 1)

    def make():
        def scored(data):
            steps, which, pair, context, word, rare = unpack(data, *PACKED[SCORED])
            logs = log_prob(pair, context, word, weights, n, uniform)[which]
            base = np.where(rare, base_log(word, n, kinds), 0.0)[which]
            known = (rare & (word > 0))[which].astype(np.int64)
            first = np.flatnonzero(np.concatenate(([True], steps[1:] > 0)))
            texts = np.cumsum(steps, dtype=np.uint64)[first]
            known, base, logs = (np.add.reduceat(x, first) for x in (known, base, logs))
            yield from by_block(texts, np.zeros(len(texts), np.int64), known, base, logs)

        def own(data):
            texts, tokens, known, base, n_hot, cells = unpack(data, *PACKED[TEXTS])
            of = np.repeat(np.arange(len(texts)), n_hot)
            yield from by_block(texts, tokens, known, base, np.bincount(of, hot_logs.value[cells], minlength=len(texts)))

        def fn(part):
            blocks, out = [], []
            for kind, data in zip(part.column("kind").to_pylist(), part.column("packed")):
                for block, packed in (scored if kind == SCORED else own)(data.as_py()):
                    blocks.append(block)
                    out.append(packed)
            yield blocks, out

        return fn

    return emit_rows(made.filter(F.col("kind").isin(SCORED, TEXTS)).select("kind", "packed"), make, [("block", "long"), ("packed", "binary")], rows=16)


def text_sums(rows: DataFrame) -> DataFrame:
    """(key, n_tokens, n_known, base_score, score) of every text, from its block's shares. A block's texts are of a bounded
    number of events, and so are its shares."""

    def run(group: pa.Table) -> pa.Table:
        first = group["block"][0].as_py() << TEXT_BITS
        local, *columns = (np.concatenate(c) for c in zip(*(unpack(x.as_py(), *_SHARE) for x in group["packed"]), strict=True))
        size = int(local.max()) + 1
        tokens, known, base, score = (np.bincount(local, c, minlength=size) for c in columns)
        return pa.table([pa.array(first + np.arange(size)), *(pa.array(np.rint(c).astype(np.int64)) for c in (tokens, known)), pa.array(base), pa.array(score)], ["key", "n_tokens", "n_known", "base_score", "score"])

    return rows.groupBy("block").applyInArrow(run, "key long, n_tokens long, n_known long, base_score double, score double")


def hot_counts(made: DataFrame) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(cells, counts, deleted counts) of the hot bigrams: a table of HOT_WORDS squared at most."""

    def expand():
        def fn(batch):
            for data in batch.column("packed").to_pylist():
                yield unpack(data, *PACKED[HOT_COUNTS])

        return fn

    hot = emit_rows(made.filter(F.col("kind") == HOT_COUNTS).select("packed"), expand, [("key", "long"), ("c", "long"), ("deleted", "long")])
    hot = hot.groupBy("key").agg(F.sum("c").alias("c"), F.sum("deleted").alias("deleted")).toArrow()
    return tuple(hot[k].to_numpy() for k in ("key", "c", "deleted"))


def all_evidence(made: list[DataFrame]):
    """The evidence of all model parts, summed by bins: a bounded table."""

    def expand():
        def fn(batch):
            for data in batch.column("packed").to_pylist():
                yield unpack(data, *PACKED[EVIDENCE])

        return fn

    rows = [emit_rows(m.filter(F.col("kind") == EVIDENCE).select("packed"), expand, EVIDENCE_FIELDS) for m in made]
    return rows[0].unionByName(rows[1]).groupBy("bucket", "bin2", "bin1").agg(*(F.sum(x).alias(x) for x in ("w", "s2", "s1"))).toArrow()


def score(docs: DataFrame, id_col="doc_id", text_col="text") -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score and score of every row of ``docs``."""
    spark = docs.sparkSession
    text = docs[text_col].cast("string")
    part = crc_mod(docs[id_col], PARTS)
    flag = F.when(part == HELD_OUT, 0).when(part == DELETED, 2).otherwise(1).cast("int")
    rows = docs.select(docs[id_col].alias("doc_id"), text.alias("text"), F.xxhash64(F.coalesce(text, F.lit(""))).alias("text_key"), flag.alias("flag"))

    with arrow_rows(spark):
        counts = cut(word_counts(rows), "lm-words")
        head = learn_head(counts, rows.select("flag"))
        shared = spark.sparkContext.broadcast(head)
        n, kinds = head.n, head.kinds
        found = events(rows, shared)
        if sum(head.parts) > FAN_OUT:
            found = redealt(found, shared, rows)
        made = cut(model_parts(found.unionByName(rare_words(counts, shared, rows)), shared), "lm-parts")
        second = made.filter(F.col("kind") == SECOND_EVENTS)
        more = cut(model_parts(second.unionByName(rare_words(counts, shared, rows)), shared), "lm-second")

        at, c, d = hot_counts(made)
        a, b = at // HOT_WORDS, at % HOT_WORDS
        seen = evidence((c, d), *head.counts(a, b), head.n - head.n_deleted)
        learned = all_evidence([made, more])
    weights = mixture({k: np.concatenate((x, learned[k].to_numpy())) for (k, _), x in zip(EVIDENCE_FIELDS, seen)}, 1 / (kinds + 1))
    if not n:
        weights = np.tile([0.0, 0.0, 1.0], (64, 1))

    # The score of every hot bigram, seen or not.
    logs = np.zeros(HOT_WORDS * HOT_WORDS)
    size = min(HOT_WORDS, len(head.c))
    a, b = np.repeat(np.arange(size), size), np.tile(np.arange(size), size)
    pair = np.zeros(HOT_WORDS * HOT_WORDS, np.int64)
    pair[at] = c
    context, word = head.counts(a, b)
    logs[a * HOT_WORDS + b] = log_prob(pair[a * HOT_WORDS + b], context[0], word[0], weights, n, 1 / (kinds + 1))
    hot_logs = spark.sparkContext.broadcast(logs)

    with arrow_rows(spark):
        found = [shares(m, weights, n, kinds, hot_logs) for m in (made, more)]
        own = cut(text_sums(found[0].unionByName(found[1])), "lm-texts")
    documents = made.filter(F.col("kind") == DOCUMENT).select("doc_id", "text_no", "held_out")
    out = documents.join(own, F.col("text_no") == F.col("key"))
    return out.select("doc_id", "held_out", "n_tokens", "n_known", F.lit(n).cast("long").alias("train_tokens"), "base_score", "score")


def op9_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score(table(spark, sf_dir, "documents").select("doc_id", "text"))
