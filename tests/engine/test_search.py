"""The search index: misspelt words against edit distances to all terms, and what a query reads."""

import random

from plumbline.operators import search


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def mutated(r, word, n):
    out = list(word)
    for _ in range(n):
        i = r.randrange(len(out) + 1)
        what = r.randrange(3)
        if what == 0:
            out.insert(i, r.choice("abc"))
        elif out and what == 1:
            del out[min(i, len(out) - 1)]
        elif out:
            out[min(i, len(out) - 1)] = r.choice("abc")
    return "".join(out)


def test_near_terms_are_those_of_edit_distance(spark):
    r = random.Random(6)
    terms = {"".join(r.choice("abc") for _ in range(n)) for n in range(1, 45) for _ in range(4)} | {"internationalization", "responsibilities"}
    terms |= {mutated(r, t, r.randint(1, 4)) for t in list(terms) for _ in range(2)} - {""}
    index = search.build(spark.createDataFrame([(1, "x", " ".join(sorted(terms)))], "id int, kind string, body string"), "id", "kind", ["body"])
    words = sorted({mutated(r, t, r.randint(0, 5)) for t in sorted(terms) for _ in range(1)} - {""} | {"internationalizetiom", "rezponzibilitiez", "a", "abc"})
    got = {(x["word"], x["term"], x["off"]) for x in search.near(index, words).collect()}
    want = {(w, t, distance(w, t)) for w in words for t in terms if 0 < search.far(len(w)) >= distance(w, t)}
    assert got == want
    assert len({w for w, _, _ in want}) > 50 and ("internationalizetiom", "internationalization", 2) in want and ("rezponzibilitiez", "responsibilities", 3) in want
    assert {x["term"] for x in search.beginning(index, "int").collect()} == {t for t in terms if t.startswith("int")}
    assert {x["term"] for x in search.beginning(index, "ab").collect()} <= {"ab"}


def test_a_query_reads_the_folders_of_its_terms(spark, monkeypatch):
    monkeypatch.setattr(search, "FOLDER_ROWS", 20)
    docs = [(i, "k", f"word{i} common term{i % 7}") for i in range(300)]
    index = search.build(spark.createDataFrame(docs, "id int, kind string, body string"), "id", "kind", ["body"])
    assert index.folders["postings"] == 45 and index.folders["terms"] > 5
    rows = search.wanted_postings(index, ["common"])
    plan = rows._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(folder" in plan or "PartitionFilters: [folder" in plan, plan
    assert rows.count() == 300
    got = {r["key"] for r in search.search(index, "wrod17 word17", {}, "body", "body", 999).collect()}
    assert 17 in got and got == {i for i in range(300) if f"word{i}".startswith("word17") or distance(f"word{i}", "word17") <= 1 or distance(f"word{i}", "wrod17") <= 1}
    assert "PushedFilters: [IsNotNull(term), GreaterThanOrEqual(term,word" in search.beginning(index, "word1")._jdf.queryExecution().executedPlan().toString()


def test_citations_and_sections(spark):
    docs = [(1, "a", "Act", "rsc 12", "section-7"), (2, "a", "Rsc 12 of old", "x", "section-8"), (3, "a", "7 zoning", "rsc 13", "x")]
    index = search.build(spark.createDataFrame(docs, "id int, kind string, title string, citation string, source_key string"), "id", "kind", ["title", "citation"], ["source_key"])
    got = search.search(index, "RSC 12", {"citation": 10.0}, "title", "title", 9, citation="citation").orderBy("rank").collect()
    assert [r["key"] for r in got] == [1, 2, 3] and [int(r["score"] // 100 * 100) for r in got][:2] == [5000, 1500]
    assert search.search(index, "", {}, "title", "title", 9).collect() == []
    assert [r["key"] for r in search.search(index, "7", {}, "title", "title", 9, source_key="source_key").collect()] == [3]
