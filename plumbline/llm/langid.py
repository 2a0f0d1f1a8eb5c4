"""Language identification by compression.

Method: for each language a zstandard raw-content dictionary is made of training text; a text is
compressed with each dictionary, and the language of the smallest result wins. Texts are first
reduced to lower-case words (runs of letters with their marks), so that case, digits and signs say nothing. A
long text is compressed whole, in blocks of ``BLOCK`` bytes, each with the dictionary in reach. Equal
sizes go to the language with more training documents, then to the first by name. Where the
second best is within ``MIN_MARGIN`` of the best, ``rejected`` is true; the language stays.

The dictionaries are the only thing learned. All labelled texts are cut, whole, into pieces of ``PIECE`` bytes,
and a language's dictionary is made of its different pieces with the least hash, which is an even sample of its text.
All dictionaries together have at most ``ALL_BYTES``, each at most ``DICT_BYTES``, so the model is bounded for any
number of languages and none is left out. The pieces' hashes are held against a limit that lets about four
times as many pass as are needed, so what is collected is bounded too.

Defined cases: a null text, and one without letters, is ``und`` with score 0. Rows with a null
language are not trained on; a language whose texts have no letters can't be predicted. With no training text at all
every text is ``und``. Repeated rows stay separate rows, and repeated pieces count once. Other columns are not read.
"""

from __future__ import annotations

from functools import lru_cache

import regex
import xxhash
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.llm.common import append_columns, crc_mod, emit_rows, table

DICT_BYTES = 64 << 10
ALL_BYTES = 8 << 20
PIECE = 128
BLOCK = 4096
LEVEL = 6
MIN_MARGIN = 0.01

_WORDS = regex.compile(r"\p{L}[\p{L}\p{M}]*")


def normal(text: str | None) -> bytes:
    return " ".join(_WORDS.findall(text.lower())).encode("utf-8", "ignore") if text else b""


def pieces(raw: bytes) -> list[bytes]:
    return [raw[i : i + PIECE] for i in range(0, len(raw), PIECE)]


def training_pieces(docs: DataFrame, text_col: str, lang_col: str) -> list[tuple[str, list[bytes]]]:
    """[(language, its pieces of least hash)], the language with most documents first."""
    rows = docs.select(docs[lang_col].cast("string").alias("lang"), docs[text_col].cast("string").alias("text")).filter("lang is not null and text is not null")
    totals = rows.groupBy("lang").agg(F.count(F.lit(1)).alias("docs"), F.sum(F.octet_length("text")).alias("bytes")).orderBy(F.desc("docs"), "lang").collect()
    if not totals:
        return []
    wanted = max(1, min(DICT_BYTES, ALL_BYTES // len(totals)) // PIECE)
    limits = {r["lang"]: min(1 << 64, (4 * wanted * PIECE << 64) // max(1, r["bytes"])) for r in totals}

    def make():
        hashed = xxhash.xxh64_intdigest

        def fn(part):
            found = set()
            for lang, text in zip(part.column("lang").to_pylist(), part.column("text").to_pylist(), strict=True):
                limit = limits[lang]
                found.update((lang, p) for p in pieces(normal(text)) if hashed(p) < limit)
            if found:
                yield [lang for lang, _ in found], [p for _, p in found]

        return fn

    sample = emit_rows(rows, make, [("lang", "string"), ("piece", "binary")]).distinct().collect()
    by_lang: dict[str, list] = {r["lang"]: [] for r in totals}
    for r in sample:
        by_lang[r["lang"]].append(bytes(r["piece"]))
    return [(lang, sorted(found, key=lambda p: (xxhash.xxh64_intdigest(p), p))[:wanted]) for lang, found in by_lang.items()]


def dictionaries(sample: list[tuple[str, list[bytes]]]) -> list[tuple[str, bytes]]:
    """(language, dictionary bytes), in the order that breaks ties. A longer dictionary would compress any text
    better, so those of languages with much text are as long as the shortest that has a quarter of the longest."""
    raw = [(lang, b" ".join(found)) for lang, found in sample]
    raw = [(lang, d) for lang, d in raw if len(d) >= 8]
    most = max((len(d) for _, d in raw), default=0)
    enough = min((len(d) for _, d in raw if 4 * len(d) >= most), default=0)
    return [(lang, d[:enough]) for lang, d in raw]


@lru_cache(2)
def compressors(model: tuple[tuple[str, bytes], ...], level: int):
    out = []
    for lang, content in model:
        d = zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
        d.precompute_compress(level)
        out.append((lang, zstandard.ZstdCompressor(level=level, dict_data=d, write_content_size=False, write_dict_id=False)))
    return out


def sizes(text: bytes, model) -> list[int]:
    blocks = [text[i : i + BLOCK] for i in range(0, len(text), BLOCK)]
    return [sum(len(c.compress(b)) for b in blocks) for _, c in model]


def identify(docs: DataFrame, model: list[tuple[str, bytes]], text_col="text", level=LEVEL, min_margin=MIN_MARGIN, drop=()) -> DataFrame:
    """``docs`` with lang_best, lang_score (0 to 1, the margin of the best over the second) and lang_rejected."""
    model = tuple(model)

    def make():
        tools = compressors(model, level)

        def fn(texts):
            best, score, rejected = [], [], []
            for text in texts:
                raw = normal(text)
                if not raw or not tools:
                    best.append("und")
                    score.append(0.0)
                    rejected.append(True)
                    continue
                n = sizes(raw, tools)
                i = min(range(len(n)), key=lambda k: (n[k], k))
                rest = min((x for k, x in enumerate(n) if k != i), default=None)
                margin = 1.0 if rest is None else (rest - n[i]) / rest
                best.append(tools[i][0])
                score.append(margin)
                rejected.append(margin < min_margin)
            return best, score, rejected

        return fn

    return append_columns(docs, text_col, make, [("lang_best", "string"), ("lang_score", "double"), ("lang_rejected", "boolean")], drop)


def op2_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    held_out = crc_mod(F.col("doc_id"), 3) == 1
    model = dictionaries(training_pieces(docs.filter(~held_out), "text", "lang"))
    out = identify(docs.select("doc_id", held_out.alias("held_out"), "text"), model, drop=["text"])
    return out.select("doc_id", "held_out", F.col("lang_best").alias("lang_pred"), F.col("lang_score").alias("score"), F.col("lang_rejected").alias("rejected"))
