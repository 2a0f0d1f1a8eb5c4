"""Byte-level BPE encoding and decoding.

Method: the merges are compiled into a lazily determinised finite-state transducer
(``bpe_fst``) that emits tokens after bounded lookahead; decoding streams the bytes of
the ids through an incremental UTF-8 state machine. Both work row by row on whole texts:
no exchange, memory bounded by the transducer's table and one slice of rows.

Defined cases: a null text is the empty text (no ids). Repeated rows and equal ids stay
separate rows. Other columns are not read. An empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator
from functools import lru_cache
from itertools import chain

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from plumbline.llm.bpe_fst import PieceMemo, Transducer, compile_pattern, load_ranks, quiet_gc
from plumbline.llm.common import append_columns, id_and_text, table

RANKS = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
#: Most states of the transducer and most pieces remembered in a worker: about 300 MB, and 100 MB for workers that
#: hold other tables too. Only speed depends on it.
ROOMY, SMALL = (500_000, 250_000), (60_000, 60_000)


class Codec:
    """Encoder and decoder for one rank file; one for each Python worker."""

    def __init__(self, path: str, pattern: str, room: tuple[int, int] = ROOMY):
        ranks = load_ranks(path)
        self.split = compile_pattern(pattern).findall
        # A piece that is itself a token gets that token, even where merges would not reach it.
        self.memo = PieceMemo(Transducer(ranks, max_states=room[0]), {t: (i,) for t, i in ranks.items()}, size=room[1])
        self.bytes = {i: t for t, i in ranks.items()}
        self.digits = {i: str(i) for i in ranks.values()}

    def encode(self, text: str | None) -> list[int]:
        return list(chain.from_iterable(map(self.memo.__getitem__, self.split(text)))) if text else []

    def decode_bytes(self, ids: Iterable[int]) -> bytes:
        return b"".join(map(self.bytes.__getitem__, ids))

    def decode(self, ids: Iterable[int]) -> str:
        return "".join(self.stream(ids))

    def stream(self, ids: Iterable[int], at_once: int = 4096) -> Iterator[str]:
        """The text in parts, as ids arrive: a character is given out once its last byte is there."""
        machine = Utf8Stream()
        for data in self.byte_parts(ids, at_once):
            yield machine.feed(data)
        yield machine.close()

    def byte_parts(self, ids: Iterable[int], at_once: int = 4096) -> Iterator[bytes]:
        ids = iter(ids)
        while part := list(_take(ids, at_once)):
            yield self.decode_bytes(part)

    def check(self, ids: list[int], text: str | None) -> tuple[str, bool]:
        """The digest of the decoded bytes, and whether they stream back to ``text``."""
        sha, machine, at, same, text = hashlib.sha256(), Utf8Stream(), 0, True, text or ""
        for data in self.byte_parts(ids):
            sha.update(data)
            part = machine.feed(data)
            same = same and text.startswith(part, at)
            at += len(part)
        rest = machine.close()
        return sha.hexdigest(), same and not rest and at == len(text)


def _take(ids: Iterator[int], n: int) -> Iterator[int]:
    for _, i in zip(range(n), ids, strict=False):
        yield i


class Utf8Stream:
    """Incremental UTF-8 state machine. Its state is the open character at the end of what was fed:
    at most three bytes, with the number still to come. Bad bytes become U+FFFD."""

    def __init__(self):
        self.open = b""

    def feed(self, data: bytes) -> str:
        data = self.open + data
        cut = len(data)
        for back in range(1, min(3, cut) + 1):
            byte = data[cut - back]
            if byte >= 0xC0:  # a leading byte: how long is its character?
                need = 2 if byte < 0xE0 else 3 if byte < 0xF0 else 4
                if need > back:
                    cut -= back
                break
            if byte < 0x80:
                break
        self.open = data[cut:]
        return data[:cut].decode("utf-8", "replace")

    def close(self) -> str:
        out, self.open = self.open.decode("utf-8", "replace"), b""
        return out


@lru_cache(2)
def codec(path: str, pattern: str, room: tuple[int, int] = ROOMY) -> Codec:
    out = Codec(path, pattern, room)
    quiet_gc()
    return out


def encode(docs: DataFrame, text_col="text", out_col="token_ids", path=RANKS, pattern=public_tokenizers.PATTERN) -> DataFrame:
    """``docs`` with the ids of each text as an array of ints in ``out_col``."""

    def make():
        c = codec(path, pattern)
        return lambda texts: [[c.encode(t) for t in texts]]

    return append_columns(docs, text_col, make, [(out_col, "ints")])


def decode(docs: DataFrame, ids_col="token_ids", out_col="decoded", path=RANKS, pattern=public_tokenizers.PATTERN) -> DataFrame:
    """``docs`` with the text of each array of ids in ``out_col``; null for null."""

    def make():
        c = codec(path, pattern)
        return lambda rows: [[None if r is None else c.decode(r) for r in rows]]

    return append_columns(docs, ids_col, make, [(out_col, "string")])


def digest(docs: DataFrame, text_col="text", drop=(), path=RANKS, pattern=public_tokenizers.PATTERN) -> DataFrame:
    """``docs`` with n_tokens, ids_sha256, decoded_sha256 (of the decoded bytes) and round_trip (whether they are the text)."""

    def make():
        c = codec(path, pattern)

        def fn(texts):
            out = []
            for text in texts:
                ids = c.encode(text)
                out.append((len(ids), hashlib.sha256(",".join(map(c.digits.__getitem__, ids)).encode()).hexdigest(), *c.check(ids, text)))
            return list(zip(*out, strict=True)) if out else [[]] * 4

        return fn

    fields = [("n_tokens", "long"), ("ids_sha256", "string"), ("decoded_sha256", "string"), ("round_trip", "boolean")]
    return append_columns(docs, text_col, make, fields, drop)


def encode_and_check(docs: DataFrame, text_col="text", drop=(), path=RANKS, pattern=public_tokenizers.PATTERN, room=ROOMY) -> DataFrame:
    """``docs`` with n_tokens, token_ids and decoded_sha256, the digest of the decoded bytes."""

    def make():
        c = codec(path, pattern, room)

        def fn(texts):
            ids = [c.encode(t) for t in texts]
            return [len(i) for i in ids], ids, [c.check(i, t)[0] for i, t in zip(ids, texts, strict=True)]

        return fn

    return append_columns(docs, text_col, make, [("n_tokens", "long"), ("token_ids", "ints"), ("decoded_sha256", "string")], drop)


def op3_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digest(id_and_text(table(spark, sf_dir, "documents"), "doc_id", "text"), drop=["text"])
