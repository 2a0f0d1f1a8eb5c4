import hashlib
import random
import re

from plumbline.llm import decontaminate as d
from tests.llm.fixtures import awkward

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def low(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


def brute(text, items, window=13):
    words = WORD.findall(low(text))
    hit, found = set(), set()
    for item, t in items:
        w = WORD.findall(low(t))
        k = min(window, len(w))
        for i in range(len(w) - k + 1 if k else 0):
            for j in range(len(words) - k + 1):
                if words[j : j + k] == w[i : i + k]:
                    hit |= set(range(j, j + k))
                    if item is not None:
                        found.add(str(item))
    n, names = len(words), ",".join(sorted(found))
    return n, len(hit), len(found), hashlib.sha256(names.encode()).hexdigest(), bool(hit) and 20 * len(hit) >= n


def tables(spark):
    r = random.Random(7)
    vocab = ["a", "B", "é9", "x", "ß"]
    text = lambda n: r.choice([" ", "-", "\n"]).join(r.choice(vocab) for _ in range(n))
    items = [(i, text(r.choice([1, 3, 12, 13, 14, 20]))) for i in range(12)] + [(3, text(15)), (None, text(14)), (50, ""), (51, None), (52, " .!"), (53, "A")]
    texts = [text(r.randint(0, 60)) for _ in range(30)] + [text(9) + " " + items[k][1] + "," + text(200) for k in range(12)] + ["", "!!"]
    texts += [items[k][1] + " q" * n for k in range(12) for n in (180, 300, 400)]
    return items, texts, awkward(spark, texts), spark.createDataFrame(items, "item_id long, text string")


def test_against_brute_force(spark, monkeypatch):
    items, texts, docs, bench = tables(spark)
    expected = {i: brute(t, items) for i, t in enumerate(texts)}
    for most, piece in ((1_000_000, 100_000), (60, 100_000), (100, 1), (1_000_000, 30)):  # one set, then blocks, then pieces
        monkeypatch.setattr(d, "PIECE_BYTES", piece)
        rows = d.report(docs, bench, block_bytes=most).collect()
        assert len(rows) == len(texts) + 3
        for r in rows:
            assert tuple(r)[1:] == (brute("", items) if r["doc_id"] is None else expected[r["doc_id"]])
    assert any(e[1] and not e[4] for e in expected.values()) and any(e[4] for e in expected.values())


def test_cleaned(spark):
    """What stays, and with which text, is the same for one block and for many; only hit words go."""
    items, texts, docs, bench = tables(spark)
    got = []
    for most in (1_000_000, 60):
        rows = d.cleaned(docs, bench, block_bytes=most).collect()
        assert set(rows[0].asDict()) == set(docs.columns)
        got.append(sorted((str(r["doc_id"]), r["text"] or "") for r in rows))
    assert got[0] == got[1]
    stay = {i for i, t in enumerate(texts) if not brute(t, items)[4]}
    assert {i for i, _ in got[0] if i != "None"} == {str(i) for i in stay}
    for i, left in got[0]:
        if i != "None":
            n, hit, *_ = brute(texts[int(i)], items)
            assert len(WORD.findall(low(left))) == n - hit and (hit or left == texts[int(i)])


def test_any_column_name_and_repeated_items(spark):
    """Blocks take no column of the table for their own, and repeated benchmark rows don't fill them."""
    items, texts, _, _ = tables(spark)
    names = ["__row", "__words", "__spans", "__items", "__all", "__hit", "__hit_words", "__cut", "__left", "hit_spans", "__hit_spans"]
    rows = [(i, t, *(f"{n}{i}" for n in names)) for i, t in enumerate(texts)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, " + ", ".join(f"{n} string" for n in names)).repartition(3)
    bench = spark.createDataFrame(items * 40, "item_id long, text string")
    out = d.cleaned(docs, bench, block_bytes=60)
    assert out.columns == docs.columns
    stay = {i for i, t in enumerate(texts) if not brute(t, items)[4]}
    got = out.collect()
    assert {r["doc_id"] for r in got} == stay and all(r[n] == f"{n}{r['doc_id']}" for r in got for n in names)
    blocks, block = d.benchmark_blocks(bench, "item_id", "text", 13, 60)
    sizes = [len(block(b)) for b in range(blocks)]
    assert sum(sizes) == len({(str(i), tuple(d.words(t))) for i, t in items if d.words(t)}) and max(sizes) < 8


def test_pieces_are_bounded_in_bytes():
    r = random.Random(1)
    for _ in range(200):
        found = [b"w" * r.choice([1, 2, 30]) + str(i).encode() for i in range(r.randint(0, 60))]
        k, most = r.randint(1, 5), r.choice([1, 40, 200])
        pieces = [p.split() for p in d.cut_pieces(found, k, most)]
        windows = [tuple(p[i : i + k]) for p in pieces for i in range(len(p) - k + 1)]
        assert windows == [tuple(found[i : i + k]) for i in range(len(found) - k + 1)]
        assert all(len(p) == min(k, len(found)) or len(b" ".join(p)) <= most for p in pieces)
        assert bool(pieces) == bool(found)


def test_joined():
    assert d.joined([5, 9, 1, 3, 3, 4, 8, 12]) == [1, 4, 5, 12] and d.joined([]) == []


def test_empty_tables(spark):
    _, texts, docs, bench = tables(spark)
    rows = d.report(docs, bench.filter("item_id < 0")).collect()
    assert len(rows) == len(texts) + 3 and not any(r["n_hit"] or r["contaminated"] for r in rows)
    assert d.report(docs.filter("doc_id < 0"), bench).collect() == []


def test_remove_spans():
    assert d.remove_spans("One, two; THREE four", [1, 3]) == "One,  four"
    assert d.remove_spans("a b", []) == "a b"
    assert d.remove_spans("é b c", [0, 1]) == " b c"
