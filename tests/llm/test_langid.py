import unicodedata
import zlib

import pyarrow.parquet as pq
import xxhash
import zstandard
from plumbline.llm import langid
from tests.llm.fixtures import SF, awkward


def test_held_out_accuracy(spark):
    rows = langid.op2_language(spark, SF).collect()
    lang = {r["doc_id"]: r["lang"] for r in pq.read_table(f"{SF}/documents.parquet", columns=["doc_id", "lang"]).to_pylist()}
    assert len(rows) == len(lang)
    held = [r for r in rows if r["held_out"]]
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 3 == 1) for r in rows)
    known = [r for r in held if lang[r["doc_id"]]]
    assert sum(r["lang_pred"] == lang[r["doc_id"]] for r in known) >= 0.97 * len(known)
    assert all(0 <= r["score"] <= 1 for r in rows)


def test_awkward(spark):
    docs = awkward(spark, ["the cat and the dog", "12 !!", "x" * 20000])
    model = langid.dictionaries(langid.training_pieces(docs, "text", "lang"))
    rows = langid.identify(docs, model).collect()
    assert len(rows) == 6
    for r in rows:
        if not r["text"] or r["text"] == "12 !!":
            assert (r["lang_best"], r["lang_score"], r["lang_rejected"]) == ("und", 0.0, True)
        else:
            assert r["lang_best"] in ("en", "de")
    none = langid.dictionaries(langid.training_pieces(docs.filter("lang = 'xx'"), "text", "lang"))
    assert {r["lang_best"] for r in langid.identify(docs, none).collect()} == {"und"}


def plain_words(text):
    """Lower-case runs of letters with their marks, a character at a time."""
    out, open_ = [], False
    for c in (text or "").lower():
        kind = unicodedata.category(c)[0]
        if kind == "L" and not open_:
            out.append("")
            open_ = True
        if kind == "L" or kind == "M" and open_:
            out[-1] += c
        else:
            open_ = False
    return " ".join(out).encode("utf-8", "ignore")


def test_every_prediction_equals_plain_compression(spark):
    """Dictionaries and sizes made again from the whole table, without Spark and with plain zstandard calls."""
    rows = pq.read_table(f"{SF}/documents.parquet", columns=["doc_id", "text", "lang"]).to_pylist()
    train = [r for r in rows if zlib.crc32(str(r["doc_id"]).encode()) % 3 != 1 and r["lang"] is not None and r["text"] is not None]
    count = {lang: sum(r["lang"] == lang for r in train) for lang in {r["lang"] for r in train}}
    order = sorted(count, key=lambda lang: (-count[lang], lang))
    found = {lang: set() for lang in order}
    for r in train:
        raw = plain_words(r["text"])
        found[r["lang"]].update(raw[i : i + 128] for i in range(0, len(raw), 128))
    dicts = [b" ".join(sorted(found[lang], key=lambda p: (xxhash.xxh64_intdigest(p), p))[:512]) for lang in order]
    least = min(len(d) for d in dicts if 4 * len(d) >= max(map(len, dicts)))
    tools = [zstandard.ZstdCompressor(level=6, dict_data=zstandard.ZstdCompressionDict(d[:least], dict_type=zstandard.DICT_TYPE_RAWCONTENT), write_content_size=False, write_dict_id=False) for d in dicts]
    got = {r["doc_id"]: r for r in langid.op2_language(spark, SF).collect()}
    for r in rows[::7]:
        raw = plain_words(r["text"])
        mine = got[r["doc_id"]]
        if not raw:
            assert (mine["lang_pred"], mine["score"], mine["rejected"]) == ("und", 0.0, True)
            continue
        sizes = [sum(len(t.compress(raw[i : i + 4096])) for i in range(0, len(raw), 4096)) for t in tools]
        best = min(sizes)
        second = sorted(sizes)[1]
        assert mine["lang_pred"] == order[sizes.index(best)] and abs(mine["score"] - (second - best) / second) < 1e-12
        assert mine["rejected"] == ((second - best) / second < 0.01)


def test_letters_alone_count(spark):
    docs = spark.createDataFrame([(0, "the cat", "en"), (1, "der Hund", "de"), (2, "½ ² Ⅷ 12", "en"), (3, "½ é", "fr")], "doc_id long, text string, lang string")
    model = langid.dictionaries(langid.training_pieces(docs, "text", "lang"))
    assert [r["lang_best"] == "und" for r in langid.identify(docs, model).orderBy("doc_id").collect()] == [False, False, True, False]


def test_many_languages_stay_bounded(spark, monkeypatch):
    monkeypatch.setattr(langid, "ALL_BYTES", 4096)
    rows = [(i, " ".join(chr(97 + (i * 7 + k * k) % 26) * 3 for k in range(400)), f"l{i % 8}") for i in range(64)]
    model = langid.dictionaries(langid.training_pieces(spark.createDataFrame(rows, "doc_id long, text string, lang string"), "text", "lang"))
    assert len(model) == 8 and sum(len(d) for _, d in model) <= 4096 + 8 * 4
