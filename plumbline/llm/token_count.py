"""Token counts by a compiled finite-state tokenizer.

Method: the tokenizer is a deterministic transducer whose transitions carry the number of
tokens that they emit. A text is cut into chunks; each chunk becomes a state map, and the
maps compose associatively, so chunks of one text can be worked on anywhere and joined by a
prefix scan. Every state meets the same state at a position where a non-space is followed by
white space (a piece always ends there), so a map is constant from the first such position on
and is held as (head, tokens, tail): the text before that position, the tokens between the
first and the last such position, and the text after. Composing two maps reads only tail +
head of the seam.

``count_tokens`` works on whole texts, each in the task that reads it, without an exchange.
``count_chunk_rows`` takes texts stored as rows of chunks and shuffles only (head, tokens, tail).

Defined cases: a null text is the empty text: 0 bytes, 0 tokens. Repeated rows stay separate rows.
Other columns are not read. An empty table gives an empty result.
"""

from __future__ import annotations

from functools import lru_cache, reduce

import public_tokenizers
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.llm.bpe_fst import _SPACE, PieceMemo, Transducer, compile_pattern, load_merges, quiet_gc
from plumbline.llm.common import append_columns, id_and_text, table

TOKENIZER = public_tokenizers.path("byte_bpe_50k.json")
CHUNK_CHARS = 1 << 16
TOKEN_LIMIT = 512


class Counter:
    """Counts and state maps for one tokenizer file; one for each Python worker."""

    def __init__(self, path: str, pattern: str):
        vocab, merges, special = load_merges(path)
        self.memo = PieceMemo(Transducer(vocab, merges, counting=True))
        self.pieces = compile_pattern(pattern).findall
        # Special strings inside a text are one token each, leftmost and longest first.
        self.special = regex.compile("|".join(map(regex.escape, sorted(special, key=len, reverse=True)))) if special else None
        self.marks = tuple(special)
        self.sync = regex.compile(f"(?<=[^{_SPACE}])[{_SPACE}]")
        self.sync_last = regex.compile(f"(?r)(?<=[^{_SPACE}])[{_SPACE}]")

    def count(self, text: str) -> int:
        if any(m in text for m in self.marks):
            parts = self.special.split(text)
            return len(parts) - 1 + sum(sum(map(self.memo.__getitem__, self.pieces(p))) for p in parts)
        return sum(map(self.memo.__getitem__, self.pieces(text)))

    def state_map(self, chunk: str) -> tuple[str, int | None, str]:
        """(head, tokens, tail); tokens is None where the chunk has no synchronising position."""
        first = self.sync.search(chunk)
        if first is None:
            return chunk, None, ""
        last = self.sync_last.search(chunk)
        return chunk[: first.start()], self.count(chunk[first.start() : last.start()]), chunk[last.start() :]

    def compose(self, a, b):
        """The map of a followed by b. A seam may itself hold a synchronising position."""
        seam = (a[0] if a[1] is None else a[2]) + b[0]
        middle = self.state_map(seam)
        if a[1] is None and b[1] is None:
            return middle
        if a[1] is None:
            return (middle[0], b[1], b[2]) if middle[1] is None else (middle[0], middle[1] + self.count(middle[2]) + b[1], b[2])
        if b[1] is None:
            return (a[0], a[1], middle[0]) if middle[1] is None else (a[0], a[1] + self.count(middle[0]) + middle[1], middle[2])
        return a[0], a[1] + self.count(seam) + b[1], b[2]

    def total(self, whole) -> int:
        return self.count(whole[0]) + (0 if whole[1] is None else whole[1] + self.count(whole[2]))


def scan(maps: list, compose):
    """All maps composed pairwise, level by level (the up-sweep of a prefix scan)."""
    while len(maps) > 1:
        maps = [reduce(compose, maps[i : i + 2]) for i in range(0, len(maps), 2)]
    return maps[0]


@lru_cache(2)
def counter(path: str, pattern: str) -> Counter:
    out = Counter(path, pattern)
    quiet_gc()
    return out


def count_tokens(
    docs: DataFrame, id_col="doc_id", text_col="text", path=TOKENIZER, pattern=public_tokenizers.PATTERN, limit=TOKEN_LIMIT, chunk_chars=CHUNK_CHARS
) -> DataFrame:
    """One row for each row of ``docs``: doc_id, n_bytes, n_tokens, over_limit. No exchange."""

    def make():
        c = counter(path, pattern)

        def fn(texts):
            size, tokens = [], []
            for text in texts:
                text = text or ""
                size.append(len(text.encode("utf-8", "surrogatepass")))
                if len(text) <= chunk_chars:
                    tokens.append(c.count(text))
                else:
                    chunks = (text[i : i + chunk_chars] for i in range(0, len(text), chunk_chars))
                    tokens.append(c.total(scan([c.state_map(x) for x in chunks], c.compose)))
            return size, tokens, [n > limit for n in tokens]

        return fn

    fields = [("n_bytes", "long"), ("n_tokens", "long"), ("over_limit", "boolean")]
    return append_columns(id_and_text(docs, id_col, text_col), "text", make, fields, drop=["text"])


def count_chunk_rows(chunks: DataFrame, id_col="doc_id", no_col="chunk_no", text_col="text", path=TOKENIZER, pattern=public_tokenizers.PATTERN) -> DataFrame:
    """(doc_id, n_tokens) of texts that are stored as rows of chunks, numbered in order from any start.

    For texts too long for one task: every row becomes its map where it lies, and only maps are
    shuffled. Neighbouring maps compose in rounds of 64. A map holds the text before its first and after its last
    synchronising position, so it is small for any text with white space; a stretch without any (one piece of the
    tokenizer or a run of them) stays in the maps as it is, and the task that composes them holds that stretch.
    Null chunks are empty. Rows with a null or repeated number are composed in no defined order.
    """

    def make_maps():
        c = counter(path, pattern)

        def fn(rows):
            maps = [c.state_map(x or "") for x in rows]
            return [m[0] for m in maps], [m[1] for m in maps], [m[2] for m in maps]

        return fn

    def make_scan():
        c = counter(path, pattern)

        def fn(rows):
            maps = [scan([(m["head"], m["tokens"], m["tail"]) for m in r], c.compose) for r in rows]
            return [m[0] for m in maps], [m[1] for m in maps], [m[2] for m in maps]

        return fn

    def make_total():
        c = counter(path, pattern)
        return lambda rows: [[c.total((m["head"], m["tokens"], m["tail"])) for m in rows]]

    fields = [("head", "string"), ("tokens", "long"), ("tail", "string")]
    one = F.struct("no", "head", "tokens", "tail")
    base = chunks.select(chunks[id_col].alias("doc_id"), chunks[no_col].cast("long").alias("no"), chunks[text_col].cast("string").alias("text"))
    rows = append_columns(base, "text", make_maps, fields).drop("text")
    for width in (6, 12, 62):  # 64 neighbours, then 64 of those, then the rest
        gathered = rows.groupBy("doc_id", F.shiftright("no", width).alias("up")).agg(F.min("no").alias("no"), F.sort_array(F.collect_list(one)).alias("maps"))
        rows = append_columns(gathered.select("doc_id", "no", "maps"), "maps", make_scan, fields).drop("maps")
    return append_columns(rows.select("doc_id", one.alias("whole")), "whole", make_total, [("n_tokens", "long")]).drop("whole")


def op5_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return count_tokens(table(spark, sf_dir, "documents"))
