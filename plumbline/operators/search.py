"""Ranked search over a stored index.

``build`` writes an index once; a query reads a small part of it. Postings and document frequencies lie in folders by a hash of the term, so that
a query reads the folders of its terms alone. The dictionary is sorted, so that the terms that begin with a word are a range. For misspelt words
there is a table of pieces: a term within k letters of a word has at least one of its k + 1 pieces unchanged, at most k places away, so the
pieces that a word may share are looked up by an equi-join, and only terms found there are compared letter by letter. That is exact, and a
term has a few pieces where it would have thousands of neighbours by deletion. ``search`` scores postings by BM25 with
field boosts, puts documents with all words before those with some, and adds the ladder of exact matches.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from plumbline.functions.text import search_text
from plumbline.tables import cut, spread

#: Shortest words with prefix matches and with fuzzy ones, the share of letters that may differ and their largest number, what such
#: matches count, and the constants of BM25 with its lower bound.
PREFIX_FROM, FUZZY_FROM, FUZZY_SHARE, FUZZY_MOST = 3, 5, 0.16, 6
PREFIX_WEIGHT, FUZZY_WEIGHT = 0.375, 0.45
K1, B, DELTA = 1.2, 0.7, 0.5
#: Rows of a folder of the index; folders at most; files that one term's postings may fill.
FOLDER_ROWS, MOST_FOLDERS, SPREAD = 500_000, 4096, 4
#: Terms a query may mean for which folders are picked; a query that means more reads all of them.
MOST_PICKED = 20_000
#: Words and terms are made of letters before this one.
_AFTER = "\x7f"


@dataclass
class Index:
    postings: DataFrame  # folder, term, key, field, tf, length
    terms: DataFrame  # folder, term, field, df
    dictionary: DataFrame  # term, sorted
    pieces: DataFrame  # folder, piece, term
    fields: DataFrame  # field, n, mean
    documents: DataFrame  # key, category and the folded fields
    folders: dict[str, int]  # of postings, terms and pieces


def far(size: int) -> int:
    """How many letters a term may differ in from a word of ``size`` letters."""
    return min(FUZZY_MOST, int(FUZZY_SHARE * size + 0.5)) if size >= FUZZY_FROM else 0


def _cuts(size: int, k: int) -> list[tuple[int, int]]:
    """(start, length) of the k + 1 pieces of a term of ``size`` letters, the longer ones last."""
    short, longer = size // (k + 1), size % (k + 1)
    return [(i * short + max(0, i - (k + 1 - longer)), short + (i >= k + 1 - longer)) for i in range(k + 1)]


def _pieces(term: str) -> Column:
    """All pieces of a term, each with the number of letters it serves, the term's length and its own place."""
    size = F.length(term)
    reach: dict[int, list[int]] = {}
    for n in range(FUZZY_FROM, 64):
        reach.setdefault(far(n), []).append(n)
    out = []
    for k, sizes in reach.items():
        served = size >= sizes[0] - k if k == FUZZY_MOST else size.between(sizes[0] - k, sizes[-1] + k)
        short, longer = F.floor(size / (k + 1)).cast("int"), size % (k + 1)
        more = lambda i: F.greatest(F.lit(0), i - (k + 1 - longer))
        name = lambda i: F.concat_ws(":", F.lit(str(k)), size.cast("string"), i.cast("string"), F.substring(F.col(term), i * short + more(i) + 1, short + F.when(i >= k + 1 - longer, 1).otherwise(0)))
        out.append(F.when(served, F.transform(F.sequence(F.lit(0), F.lit(k)), name)).otherwise(F.array().cast("array<string>")))
    return F.flatten(F.array(*out))


def probes(word: str) -> set[str]:
    """The pieces by which a term within ``far`` letters of ``word`` is found."""
    k = far(len(word))
    return {
        f"{k}:{size}:{i}:{word[at : at + n]}"
        for size in range(len(word) - k, len(word) + k + 1)
        for i, (start, n) in enumerate(_cuts(size, k))
        for at in range(max(0, start - k), min(len(word) - n, start + k) + 1)
    } if k else set()


def _folder(c: str, folders: int) -> Column:
    return F.pmod(F.xxhash64(c), F.lit(folders)).cast("int").alias("folder")


def _folders(rows: int) -> int:
    return max(1, min(MOST_FOLDERS, rows // FOLDER_ROWS))


def build(docs: DataFrame, key: str, category: str, fields: list[str], more: list[str] = ()) -> Index:
    """An index of ``fields`` of ``docs``, written to the shared folder. Null fields are empty. The columns ``more`` are kept with documents, folded."""
    folded = [F.coalesce(search_text(f), F.lit("")).alias(f) for f in dict.fromkeys([*fields, *more])]
    texts = cut(docs.select(F.col(key).alias("key"), F.col(category).alias("category"), *folded), "search-documents")
    tokens = lambda f: F.filter(F.split(f, " "), lambda t: t != "")
    sizes = texts.select(F.explode(F.array(*(F.struct(F.lit(f).alias("field"), F.size(tokens(f)).alias("length")) for f in fields))).alias("e"))
    totals = sizes.groupBy("e.field").agg(F.count_if(F.col("e.length") > 0).alias("n"), F.avg(F.when(F.col("e.length") > 0, F.col("e.length"))).alias("mean"), F.sum("e.length").alias("all"))
    totals = cut(totals, "search-fields")
    n = {"postings": _folders(totals.agg(F.sum("all")).first()[0] or 0)}
    each = F.array(*(F.struct(F.lit(f).alias("field"), tokens(f).alias("t")) for f in fields))
    # Texts are dealt out by key, so that their words are counted where they are: what moves is texts, and then postings.
    rows = spread(texts.select("key", *fields), "key").select("key", F.explode(each).alias("e")).select("key", "e.field", F.size("e.t").alias("length"), F.explode("e.t").alias("term"))
    found = rows.groupBy("term", "key", "field").agg(F.count(F.lit(1)).alias("tf"), F.first("length").alias("length"))
    found = found.select(_folder("term", n["postings"]), "term", "key", "field", "tf", "length")
    # A frequent term's postings go to several files.
    postings = cut(found.repartition(F.col("folder"), F.pmod(F.xxhash64("key"), F.lit(SPREAD))).sortWithinPartitions("folder", "term"), "search-postings", ["folder"])
    frequency = cut(postings.groupBy("term", "field").agg(F.count(F.lit(1)).alias("df")), "search-frequencies")
    n["terms"] = _folders(frequency.count())
    terms = cut(frequency.select(_folder("term", n["terms"]), "term", "field", "df").repartition("folder").sortWithinPartitions("folder", "term"), "search-terms", ["folder"])
    dictionary = cut(frequency.select("term").distinct().repartitionByRange("term").sortWithinPartitions("term"), "search-dictionary")
    cuts = dictionary.select(F.explode(_pieces("term")).alias("piece"), "term")
    n["pieces"] = _folders(8 * dictionary.count())
    pieces = cut(cuts.select(_folder("piece", n["pieces"]), "piece", "term").repartition("folder").sortWithinPartitions("folder", "piece"), "search-pieces", ["folder"])
    return Index(postings, terms, dictionary, pieces, totals, texts, n)


def _picked(rows: DataFrame, wanted: DataFrame, column: str, folders: int) -> DataFrame:
    """``rows`` in the folders that ``wanted`` lie in; few rows are asked for."""
    at = sorted(r["folder"] for r in wanted.select(_folder(column, folders)).distinct().collect())
    return rows.filter(F.col("folder").isin(at))


def beginning(index: Index, word: str) -> DataFrame:
    """The terms that begin with a word, or are the word if it is short: a range of the sorted dictionary."""
    term = F.col("term")
    return index.dictionary.filter((term >= word) & (term < word + _AFTER) if len(word) >= PREFIX_FROM else term == word)


def near(index: Index, words: list[str]) -> DataFrame:
    """(word, term, off) of the terms within ``far`` letters of each word, by pieces."""
    spark = index.dictionary.sparkSession
    asked = spark.createDataFrame([(w, far(len(w)), p) for w in words for p in sorted(probes(w))], "word string, far int, asked string")
    # A word has some hundreds of pieces.
    found = _picked(index.pieces, asked, "asked", index.folders["pieces"]).join(F.broadcast(asked), F.col("piece") == F.col("asked"))
    found = found.select("word", "far", "term").distinct().withColumn("off", F.levenshtein("term", "word"))
    return found.filter(F.col("off") <= F.col("far")).select("word", "term", "off")


def meant(index: Index, words: list[str]) -> DataFrame:
    """(word, term, weight) of the terms that the words of a query may mean: the best reason of each counts."""
    spark = index.dictionary.sparkSession
    rows = [spark.createDataFrame([], "word string, term string, weight double")]
    for w in words:
        longer, size = F.length("term") - len(w), F.length("term")
        weight = F.when(F.col("term") == w, 1.0).otherwise(PREFIX_WEIGHT * size / (size + 0.3 * longer))
        rows.append(beginning(index, w).select(F.lit(w).alias("word"), "term", weight.alias("weight")))
    by_letters = F.when(F.col("off") == 0, 1.0).otherwise(FUZZY_WEIGHT * F.length("term") / (F.length("term") + F.col("off")))
    rows.append(near(index, words).select("word", "term", by_letters.alias("weight")))
    return reduce(DataFrame.unionByName, rows).groupBy("word", "term").agg(F.max("weight").alias("weight"))


def ladder(query: str, title: str, body: str, citation: str | None = None, source_key: str | None = None) -> Column:
    """What an exact match adds: the whole title or citation 5000, the query in the title or the citation 1500, in the body 1300, all words of several in
    the body 500, a section asked for by its number, by the source's key or the start of the title, 2500."""
    words = query.split(" ")
    section = F.lit(query).rlike("^(s\\.|section *)?[0-9]+[a-z]?$")
    number = F.regexp_extract(F.lit(query), "([0-9]+[a-z]?)$", 1)
    every = F.lit(len(words) > 1)
    for w in words:
        every = every & F.col(body).contains(w)
    names = [F.col(c) for c in (title, citation) if c]
    own = F.col(title).startswith(number)
    if source_key:
        own = own | (F.col(source_key) == F.concat(F.lit("section-"), number))
    return (
        F.when(reduce(Column.__or__, (c == query for c in names)), 5000)
        .when(reduce(Column.__or__, (c.contains(query) for c in names)), 1500)
        .when(F.col(body).contains(query), 1300)
        .when(every, 500)
        .when(section & own, 2500)
        .otherwise(0)
    )


def folded_query(spark, query: str) -> str:
    return spark.range(1).select(search_text(F.lit(query)).alias("q")).first()["q"]


def wanted_postings(index: Index, words: list[str]) -> DataFrame:
    """The postings of all terms that the words may mean, with word, weight and document frequency."""
    terms = cut(meant(index, words), "search-meant")
    postings, counts = index.postings, index.terms
    if terms.count() <= MOST_PICKED:
        postings = _picked(postings, terms, "term", index.folders["postings"])
        counts = _picked(counts, terms, "term", index.folders["terms"])
    return postings.drop("folder").join(terms, "term").join(counts.drop("folder"), ["term", "field"])


def search(index: Index, query: str, boosts: dict[str, float], title: str, body: str, per_category: int, citation: str | None = None, source_key: str | None = None) -> DataFrame:
    """(key, category, all_words, score, rank): the first ``per_category`` documents of each category with any word of the query. Scores
    are BM25 by field times boost and match weight, the best term of each word and field, plus the ladder; ranks go by category."""
    asked = folded_query(index.postings.sparkSession, query)
    words = sorted({w for w in asked.split(" ") if w})
    rows = wanted_postings(index, words).join(F.broadcast(index.fields), "field")
    idf = F.log(1 + (F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5))
    tf = DELTA + F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("length") / F.col("mean")))
    boost = F.lit(1.0)
    for field, times in boosts.items():
        boost = F.when(F.col("field") == field, times).otherwise(boost)
    best = rows.groupBy("key", "word", "field").agg(F.max(F.col("weight") * boost * idf * tf).alias("s"))
    scored = best.groupBy("key").agg(F.count_distinct("word").alias("words"), F.sum("s").alias("s"))
    docs = index.documents.withColumnRenamed("key", "__key")
    out = scored.join(docs, F.col("key") == F.col("__key")).withColumn("score", F.col("s") + ladder(asked, title, body, citation, source_key))
    out = out.withColumn("all_words", F.col("words") == len(words))
    w = Window.partitionBy("category").orderBy(F.col("all_words").desc(), F.round("score", 6).desc(), "key")
    return out.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= per_category).select("key", "category", "all_words", "score", "rank")


def highlights(text, words: list[str]) -> Column:
    """The places (from 1) of all words in a text, ignoring case, in order: an array of (start, length)."""
    low = F.lower(F.col(text) if isinstance(text, str) else text)

    def places(word):
        parts, size = F.split(low, "\\Q" + word + "\\E", -1), len(word)
        before = lambda i: F.aggregate(F.slice(parts, 1, i), F.lit(0), lambda a, x: a + F.length(x)) + (i - 1) * size + 1
        found = F.transform(F.sequence(F.lit(1), F.size(parts) - 1), lambda i: F.struct(before(i).alias("start"), F.lit(size).alias("length")))
        return F.when(F.size(parts) > 1, found).otherwise(F.array().cast("array<struct<start:int,length:int>>"))

    return F.array_sort(F.array_distinct(F.flatten(F.array(*map(places, words)))))
