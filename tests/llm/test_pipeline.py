"""The pipeline against a chain of plain versions of its stages."""

import hashlib

import public_tokenizers
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
import tiktoken
from plumbline.llm import bpe_codec, pii, pipeline
from plumbline.llm.bpe_fst import load_ranks
from tests.llm import test_decontaminate as plain_hits
from tests.llm import test_near_copies as plain_copies
from tests.llm import test_quality_rules as plain_rules
from tests.llm.fixtures import SF


def without_hits(text, items):
    """``text`` without the runs of words that windows of ``items`` cover; None if it is contaminated."""
    spans = [m.span() for m in plain_hits.WORD.finditer(plain_hits.low(text))]
    words = [plain_hits.low(text)[a:b] for a, b in spans]
    hit = [False] * len(words)
    grams: dict = {}
    for _, t in items:
        w = plain_hits.WORD.findall(plain_hits.low(t))
        k = min(13, len(w))
        grams.setdefault(k, set()).update(tuple(w[i : i + k]) for i in range(len(w) - k + 1 if k else 0))
    for k, found in grams.items():
        for i in range(len(words) - k + 1):
            if tuple(words[i : i + k]) in found:
                hit[i : i + k] = [True] * k
    if any(hit) and 20 * sum(hit) >= len(words):
        return None
    out, done, i = "", 0, 0
    while i < len(words):
        if hit[i]:
            j = i
            while j < len(words) and hit[j]:
                j += 1
            out, done = out + text[done : spans[i][0]], spans[j - 1][1]
            i = j
        else:
            i += 1
    return out + text[done:]


def table_dir(tmp_path, docs, **more):
    tables = {"documents": docs, "labels": pq.read_table(f"{SF}/labels.parquet"), "benchmark": pq.read_table(f"{SF}/benchmark.parquet")} | more
    for name, t in tables.items():
        pq.write_table(t, tmp_path / f"{name}.parquet")
    return str(tmp_path)


def awkward_documents():
    """Real documents with clashing columns, nulls, repeated rows, copies and lightly edited copies."""
    docs = pq.read_table(f"{SF}/documents.parquet").slice(0, 420)
    rows = docs.to_pylist()
    good = [r for r in rows if r["text"] and len(r["text"].split()) > 120][:6]
    rows += [dict(good[0]), dict(good[0]), good[1] | {"doc_id": 9001}, good[2] | {"doc_id": None}, good[2] | {"doc_id": None}]
    rows += [good[3] | {"doc_id": 9002, "text": good[3]["text"] + " one more"}, good[4] | {"doc_id": -5, "text": "x " + good[4]["text"]}]
    rows += [good[5] | {"doc_id": 9003, "text": None}, good[5] | {"doc_id": None, "text": ""}, good[5] | {"doc_id": 9004, "lang": None, "source": None}]
    return rows, pa.Table.from_pylist([r | {"kept": i, "h": str(i), "__row": i, "mask": None, "token_ids": "x"} for i, r in enumerate(rows)], docs.schema.append(pa.field("kept", pa.int64())).append(pa.field("h", pa.string())).append(pa.field("__file", pa.int32())).append(pa.field("mask", pa.float64())).append(pa.field("token_ids", pa.string())))


def test_against_plain_stages(spark, tmp_path):
    rows, docs = awkward_documents()
    sf_dir = table_dir(tmp_path, docs)
    labels = [(r["doc_id"], r["quality"], r["toxic"]) for r in pq.read_table(f"{SF}/labels.parquet").to_pylist()]
    items = [(r["item_id"], r["text"]) for r in pq.read_table(f"{SF}/benchmark.parquet").to_pylist()]

    kept = plain_rules.brute_kept([(r["doc_id"], r["text"]) for r in rows], labels)
    left = [r for r, good in zip(rows, kept) if good]
    assert 100 < len(left) < len(rows) and all(r["text"] for r in left)

    order = lambda r: (r["doc_id"] is None, r["doc_id"] or 0)
    left.sort(key=order)
    roots = plain_copies.brute_roots([r["text"].encode().decode("latin-1") for r in left])
    left = [r for i, r in enumerate(left) if roots[i] == i]
    assert {None, -5} & {r["doc_id"] for r in left}

    library = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=load_ranks(bpe_codec.RANKS), special_tokens={})
    expected = []
    for r in left:
        text = without_hits(r["text"], items)
        if text is not None:
            text = pii.redact(text)
            expected.append((str(r["doc_id"]), r["lang"], r["source"], library.encode_ordinary(text), hashlib.sha256(text.encode()).hexdigest()))
    got = [(str(r["doc_id"]), r["lang"], r["source"], r["token_ids"], r["decoded_sha256"]) for r in pipeline.run(spark, sf_dir).collect()]
    key = lambda x: (x[0], x[4])
    assert sorted(got, key=key) == sorted(expected, key=key)
    assert len(expected) < len(left)


def test_stages_keep_the_columns(spark, tmp_path):
    rows, docs = awkward_documents()
    sf_dir = table_dir(tmp_path, docs)
    given = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in pipeline.STAGES[:-1]:
        out = stage(spark, given, sf_dir)
        assert out.dtypes == given.dtypes
        assert out.count() <= len(rows)


def test_empty_table(spark, tmp_path):
    _, docs = awkward_documents()
    sf_dir = table_dir(tmp_path, docs.slice(0, 0))
    assert pipeline.run(spark, sf_dir).collect() == []


def test_stages_are_the_ones_named():
    import corpus_pipeline

    assert corpus_pipeline.STAGES is pipeline.STAGES and corpus_pipeline.run is pipeline.run and corpus_pipeline.ORACLE_SQL is None
    assert len(pipeline.STAGES) == 5
