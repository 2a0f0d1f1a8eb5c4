"""The text pipeline: quality rules, near-duplicates, decontamination, personal data, byte-level BPE.

Each stage takes (spark, docs, sf_dir) and returns a table; ``docs`` has the columns of ``documents``, of
which doc_id and text are used. A stage's table is written and read again as the next one's ``docs``. Rows keep all
their columns until the last stage, which returns doc_id, lang, source, n_tokens, token_ids and decoded_sha256.

Every stage but the near-duplicates is one pass in which a text goes to Python once. To bound the buffers on both sides, a
stage sets the session to small Arrow batches (``BATCH_BYTES``); results don't depend on that.

Defined cases, besides those of each operator: a null text fails the quality rules. Where rows of one component
share the least doc_id, the one with the least text hash stays, and of equal rows one. A component whose
rows all have a null doc_id keeps one of them likewise. Repeated rows are copies. An empty table stays empty. Other
columns may have any name but ``text`` and ``doc_id`` and come along unread.
"""

from __future__ import annotations

import uuid

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.llm import bpe_codec, decontaminate, near_copies, pii, quality_rules
from plumbline.llm.common import cut, table

BATCH_BYTES = "4m"


def _small_batches(spark: SparkSession) -> None:
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES)


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules keep. The raw counts are of ``docs``, the trusted ones from ``labels``."""
    _small_batches(spark)
    return quality_rules.keep_good(docs, quality_rules.log_ratios(docs, table(spark, sf_dir, "labels")))


def _numbered(docs: DataFrame, file: str, row: str) -> tuple[DataFrame, DataFrame]:
    """``docs``, and the same with a file and a row number that tell every row: from its files, or else of a written copy."""

    def number(df):
        meta = df.metadataColumn("_metadata")
        return df.select("*", F.xxhash64(meta["file_path"]).alias(file), meta["row_index"].alias(row))

    try:
        return docs, number(docs)
    except AnalysisException:
        docs = cut(docs, "pipeline-rows")
        return docs, number(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each component of near copies (5-word similarity of 0.8 or more): the one with the least doc_id.

    Texts are compared by text hash. Which rows stay is written as 64-bit masks by file and row number, so that texts need
    not be dealt out to pick them: the masks are a small part of a byte for each row, and where Spark finds even that too large to
    broadcast it joins by shuffling.
    """
    _small_batches(spark)
    file, row, word, mask = (f"{n}_{uuid.uuid4().hex}" for n in ("file", "row", "word", "mask"))  # no column is called so
    docs, rows = _numbered(docs, file, row)
    roots = near_copies.near_copies(docs.select(F.xxhash64("text").alias("h"), "text"))
    key = F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", F.xxhash64("text").alias("h"), F.col(file).alias("file"), F.col(row).alias("row"))
    # The least key of each text, then of each component: the first makes the second small.
    least = rows.select(key.alias("key")).groupBy(F.col("key.h").alias("h")).agg(F.min("key").alias("key"))
    least = least.join(roots, F.col("h") == F.col("node"), "left")
    stay = least.groupBy(F.coalesce("root", "h")).agg(F.min("key").alias("key")).select(F.col("key.file").alias("file"), F.col("key.row").alias("row"))
    bit = F.expr("shiftleft(1L, cast(row & 63 as int))")
    masks = cut(stay.groupBy("file", F.shiftright("row", 6).alias(word)).agg(F.bit_or(bit).alias(mask)).withColumnRenamed("file", f"of_{file}"), "pipeline-masks")
    found = rows.join(masks, (F.col(file) == F.col(f"of_{file}")) & (F.shiftright(row, 6) == F.col(word)))
    return found.filter(F.getbit(mask, F.col(row).bitwiseAND(F.lit(63)).cast("int")) == 1).select(*docs.columns)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that aren't contaminated; in those with fewer hits the hit passages are cut out."""
    _small_batches(spark)
    return decontaminate.cleaned(docs, table(spark, sf_dir, "benchmark"))


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with every span of personal data replaced by its kind."""
    _small_batches(spark)
    return pii.redacted(docs)


def byte_bpe(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every text, and the digest of what they decode to."""
    _small_batches(spark)
    # The workers hold the tables of earlier stages too.
    rows = bpe_codec.encode_and_check(docs.select("doc_id", "lang", "source", "text"), drop=["text"], room=bpe_codec.SMALL)
    return rows.select("doc_id", "lang", "source", "n_tokens", "token_ids", "decoded_sha256")


STAGES = [
    ("quality rules", quality),
    ("simhash near-dedup", near_duplicates),
    ("benchmark decontamination", decontamination),
    ("personal data", personal_data),
    ("byte-level bpe", byte_bpe),
]

#: SQL has neither the models nor the shingle index of these stages; tests hold them against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each result written and read again."""
    docs = table(spark, sf_dir, "documents")
    for i, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = cut(docs, f"pipeline-{name.replace(' ', '-')}")
    return docs
