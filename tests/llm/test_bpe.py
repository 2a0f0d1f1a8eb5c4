import hashlib
import random

import public_tokenizers
import pytest
import tiktoken
import tokenizers
from hypothesis import given, settings
from hypothesis import strategies as st
from plumbline.llm import bpe_codec, token_count
from plumbline.llm.bpe_fst import LOOKAHEAD, Transducer, load_merges, load_ranks
from tests.llm.fixtures import awkward, documents, sample_texts

LONG = ["a" * 5000, "-" * 4097, "ab" * 3000, " " * 3000, "é" * 3000, "0" * 5000, "\U0001f600" * 500, "\n" * 1000, "#$" * 1500, ". " * 500, "xyz" * 1000, "1234567890" * 300, "ÿ" * 600, "the" * 900 + "a" * 700]
WORDS = st.text(alphabet="abcdeéßthein  \n\t'sTREll ve12٣９\U0001f600中文字\u0085\u00a0\u3000\x1c.,-_#$<|>endoftext", max_size=80)


@pytest.fixture(scope="module")
def library():
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=load_ranks(bpe_codec.RANKS), special_tokens={})


@pytest.fixture(scope="module")
def counts():
    return tokenizers.Tokenizer.from_file(token_count.TOKENIZER)


@settings(max_examples=800, deadline=None)
@given(WORDS)
def test_ids_equal_the_library(library, text):
    c = bpe_codec.codec(bpe_codec.RANKS, public_tokenizers.PATTERN)
    ids = c.encode(text)
    assert ids == library.encode_ordinary(text)
    assert c.decode(ids) == text


def test_ids_of_documents_and_long_runs(library):
    c = bpe_codec.codec(bpe_codec.RANKS, public_tokenizers.PATTERN)
    for text in [t for _, t in documents(None, 300)] + LONG:
        assert c.encode(text) == library.encode_ordinary(text)


def test_stream_decoding_is_incremental(library):
    text = "aé\U0001f600中ß" * 50
    c = bpe_codec.codec(bpe_codec.RANKS, public_tokenizers.PATTERN)
    ids = [i for b in text.encode() for i in c.encode_bytes(bytes([b]))] if hasattr(c, "encode_bytes") else library.encode_ordinary(text)
    for step in (1, 2, 3, 7):
        parts = list(c.stream(ids, step))
        assert "".join(parts) == text and "�" not in "".join(parts)
    machine = bpe_codec.Utf8Stream()
    raw = text.encode()
    assert "".join(machine.feed(raw[i : i + 1]) for i in range(len(raw))) + machine.close() == text
    for bad in (b"\xe4\xb8", b"\xff\xfea", b"\xf0\x9f\x98", b"a\xc3", b"\x80\x80\x80\x80"):
        machine = bpe_codec.Utf8Stream()
        assert "".join(machine.feed(bad[i : i + 1]) for i in range(len(bad))) + machine.close() == bad.decode("utf-8", "replace")


@settings(max_examples=800, deadline=None)
@given(WORDS, st.integers(1, 20))
def test_counts_equal_the_library_and_maps_compose(counts, text, size):
    c = token_count.counter(token_count.TOKENIZER, public_tokenizers.PATTERN)
    n = len(counts.encode(text, add_special_tokens=False).ids)
    assert c.count(text) == n
    maps = [c.state_map(text[i : i + size]) for i in range(0, len(text), size)]
    if maps:
        assert c.total(token_count.scan(maps, c.compose)) == n


def test_counts_of_documents(counts):
    c = token_count.counter(token_count.TOKENIZER, public_tokenizers.PATTERN)
    for text in [t for _, t in documents(None, 300)] + LONG + ["a<|endoftext|>b <|endoftext|><|endoftext|>"]:
        assert c.count(text) == len(counts.encode(text, add_special_tokens=False).ids)


def test_tables(spark, library, counts):
    texts = sample_texts(20) + LONG + ["x <|endoftext|>", ""]
    docs = awkward(spark, texts)
    rows = token_count.count_tokens(docs, chunk_chars=50).collect()
    assert len(rows) == len(texts) + 3
    for r in rows:
        text = "" if r["doc_id"] is None else texts[r["doc_id"]]
        n = len(counts.encode(text, add_special_tokens=False).ids)
        assert (r["n_bytes"], r["n_tokens"], r["over_limit"]) == (len(text.encode()), n, n > 512)
    for r in bpe_codec.digest(docs.drop("n_tokens")).collect():
        ids = library.encode_ordinary(r["text"] or "")
        assert r["n_tokens"] == len(ids) and r["ids_sha256"] == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
        assert r["decoded_sha256"] == hashlib.sha256((r["text"] or "").encode()).hexdigest() and r["round_trip"]
    back = bpe_codec.decode(bpe_codec.encode(docs)).collect()
    assert all(r["decoded"] == (r["text"] or "") for r in back)
    assert token_count.count_tokens(docs.filter("doc_id < 0")).collect() == []


def test_chunk_rows(spark, counts):
    r = random.Random(1)
    texts = {i: "".join(r.choice("ab é \n.") for _ in range(r.randint(0, 4000))) for i in range(8)} | {8: "a" * 3000, 9: ""}
    rows = [(i, k // 10, t[k : k + 10]) for i, t in texts.items() for k in range(0, max(1, len(t)), 10)]
    r.shuffle(rows)
    found = token_count.count_chunk_rows(spark.createDataFrame(rows, "doc_id long, chunk_no int, text string")).collect()
    assert {x["doc_id"]: x["n_tokens"] for x in found} == {i: len(counts.encode(t, add_special_tokens=False).ids) for i, t in texts.items()}


def test_tables_of_states_stay_bounded_within_a_piece(library, counts):
    r = random.Random(9)
    pieces = ["".join(r.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(40_000)), "中文字符" * 4000, "xyz" * 9000]
    most = 2000
    vocab, merges, _ = load_merges(token_count.TOKENIZER)
    ranks = load_ranks(bpe_codec.RANKS)
    encoder, counter = Transducer(ranks, max_states=most), Transducer(vocab, merges, counting=True, max_states=most)
    for piece in pieces:
        assert list(encoder.encode(piece.encode())) == library.encode_ordinary(piece)
        assert counter.encode(piece.encode()) == len(counts.encode(piece, add_special_tokens=False).ids)
        for t in (encoder, counter):
            assert len(t.states) <= most + LOOKAHEAD + 1 and len(t.next) <= 4 * most + LOOKAHEAD


def test_check_tells_other_texts_apart(library):
    c = bpe_codec.codec(bpe_codec.RANKS, public_tokenizers.PATTERN)
    ids = library.encode_ordinary("aé\U0001f600")
    assert c.check(ids, "aé\U0001f600") == (hashlib.sha256("aé\U0001f600".encode()).hexdigest(), True)
    assert not c.check(ids, "aé")[1] and not c.check(ids, "aé\U0001f600b")[1] and c.check([], None)[1]
