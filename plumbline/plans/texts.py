"""Pages, documents and the review log."""

from __future__ import annotations

from pyspark.sql import functions as F

from plumbline.functions import law
from plumbline.functions.text import ENTITIES, snippet
from plumbline.operators import corpus, scheduling, search
from plumbline.plans.measurements import rounded
from plumbline.plans.registry import Registry
from plumbline.tables import spread, table

texts = Registry()


def _steps(start: str, steps: list[tuple[str, str]], flags: str = "g") -> str:
    out = start
    for pattern, by in steps:
        out = f"regexp_replace({out}, '{pattern}', '{by}', '{flags}')"
    return out


def _decoded(start: str) -> str:
    """One pass over references and what stands between them."""
    names = " ".join(f"WHEN '&{n};' THEN '{v.replace(chr(39), chr(39) * 2)}'" for n, v in ENTITIES.items())
    one = f"""CASE WHEN regexp_matches(x, '^&#[0-9]+;$') THEN chr(CAST(x[3:-2] AS INTEGER)) ELSE CASE lower(x) {names} ELSE x END END"""
    return f"array_to_string(list_transform(regexp_extract_all({start}, '(?i)(&(?:#x[0-9a-f]+|#[0-9]+|[a-z]+);|[^&]+|&)'), lambda x: {one}), '')"


def text_of(html: str) -> str:
    """SQL of ``functions.text.html_to_text``."""
    visible = _steps(html, [(rf"(?is)<{t}\b.*?</{t}>", "") for t in ("script", "style", "form", "nav")])
    broken = _steps(visible, [(r"(?i)<br\s*/?>", "\n"), (r"(?i)</(div|p|li|tr|h[1-6])>", "\n"), (r"(?i)<td[^>]*>", " | "), ("<[^>]+>", "")])
    return _steps(_decoded(broken), [("\r\n?", "\n"), ("\u00a0", " "), ("[ \t\f\x0b]+", " "), (" *\n *", "\n"), ("\n{3,}", "\n\n"), (r"^[ \n]+|[ \n]+$", "")])


HTML_TITLE = "trim(" + _decoded("coalesce(regexp_extract(html, '(?is)<title[^>]*>(.*?)</title>', 1), '')") + ", ' ')"


@texts.query(f"SELECT page_id, {HTML_TITLE} AS title, {text_of('html')} AS text FROM pages")
def html_to_text(spark, sf_dir):
    return corpus.pages_as_text(table(spark, sf_dir, "pages"))


#: What goes around a page's HTML: an element of either name, nested ones, one that isn't closed, and none.
_AROUND = (
    ("<div id='main'><DIV class=a>x</DIV><div>", "</div>y</div>behind<div>z</div>"),
    ("<p>before</p><Div class=\"b\" id=\"other\" >", "<div><div>deep</div></div>end</div></div>tail"),
    ("<div id=\"main\"><div><div>", "</div>open"),
    ("<div idx='main'>", "</div>"),
)


def _wrapped_sql(part: int) -> str:
    return "CASE page_id % 4 " + " ".join(f"WHEN {n} THEN '{w[part].replace(chr(39), chr(39) * 2)}'" for n, w in enumerate(_AROUND)) + " END"


@texts.query(f"""
WITH h AS (SELECT page_id, {_wrapped_sql(0)} || html || {_wrapped_sql(1)} AS h FROM pages),
m AS (SELECT *, regexp_extract(h, '<div\\b[^>]*\\bid=["'']main["''][^>]*>', 0, 'i') AS a, regexp_extract(h, '<div\\b[^>]*\\bid=["'']other["''][^>]*>', 0, 'i') AS b FROM h),
r AS (SELECT page_id, CASE WHEN a <> '' THEN 'main' WHEN b <> '' THEN 'other' END AS container, CASE WHEN a <> '' THEN substring(h, instr(h, a) + length(a)) WHEN b <> '' THEN substring(h, instr(h, b) + length(b)) ELSE h END AS rest FROM m),
e AS (SELECT page_id, unnest(regexp_extract_all(rest, '</?div\\b[^>]*>', 0, 'i')) AS t, unnest((string_split_regex(rest, '(?i)</?div\\b[^>]*>'))[:-2]) AS x, unnest(range(len(regexp_extract_all(rest, '</?div\\b[^>]*>', 0, 'i')))) AS i FROM r WHERE container IS NOT NULL),
d AS (SELECT *, 1 + sum(CASE WHEN t[2] = '/' THEN -1 ELSE 1 END) OVER w AS depth, sum(length(x) + length(t)) OVER w - length(t) AS place FROM e WINDOW w AS (PARTITION BY page_id ORDER BY i)),
c AS (SELECT page_id, CAST(min_by(place, i) AS BIGINT) AS place FROM d WHERE depth = 0 GROUP BY page_id)
SELECT r.page_id, container, string_split_regex(CASE WHEN place IS NULL THEN rest ELSE substring(rest, 1, place) END, '<footer|<!-- ad 3')[1] AS content FROM r LEFT JOIN c ON c.page_id = r.page_id""")
def page_elements(spark, sf_dir):
    """The content of a page's main element, with what is nested in it."""
    around = lambda part: F.element_at(F.array(*(F.lit(w[part]) for w in _AROUND)), (F.col("page_id") % 4 + 1).cast("int"))
    pages = table(spark, sf_dir, "pages").select("page_id", F.concat(around(0), "html", around(1)).alias("html"))
    return corpus.elements(pages, "page_id", "html", ["main", "other"], ends=["<footer", "<!-- ad 3"])


START = r"<(?:h1|p|footer)\b[^>]*>"
_SECTIONS = f"""parts AS (SELECT page_id, unnest(string_split(regexp_replace(html, '({START})', chr(1) || '\\1', 'g'), chr(1))) AS part, unnest(range(len(string_split(regexp_replace(html, '({START})', chr(1) || '\\1', 'g'), chr(1))))) AS position FROM pages),
named AS (SELECT page_id, CAST(position AS INTEGER) AS position, lower(trim({text_of("regexp_extract(part, '^<([a-z0-9]+)', 1)")}, ' ')) AS label, {text_of('part')} AS text FROM parts WHERE position > 0),
sections AS (SELECT *, row_number() OVER (PARTITION BY page_id, label ORDER BY position) AS n FROM named WHERE text <> '')"""


def _sections(spark, sf_dir):
    return corpus.sections(table(spark, sf_dir, "pages"), "page_id", "html", START, "^<([a-z0-9]+)")


#: Lines and their classes: text, blank, note of consolidation, history and heading.
_LAW_LINES = (
    ("1 A person shall file a plan.", "t"), ("", "b"), ("N.B. This Act is consolidated to June 1, 2020.", "n"), ("R.S. 1973, c. A-1", "h"), ("GENERAL", "g"),
    ("(a) text, and   ", "t"), ("84-12; 86-3", "h"), ("2001, c.5, s.3", "h"),
)
_LAW_PICKS = ("o_orderkey % 8", "o_orderkey // 8 % 8", "o_orderkey // 64 % 8", "o_custkey % 8", "o_custkey // 8 % 8")


@texts.query(f"""
WITH l AS (SELECT o_orderkey, [{", ".join(f"CAST({p} + 1 AS INTEGER)" for p in _LAW_PICKS)}] AS k FROM orders),
c AS (SELECT *, list_transform(k, lambda x: [{", ".join(f"'{c}'" for _, c in _LAW_LINES)}][x]) AS c, list_transform(k, lambda x: [{", ".join(f"'{t}'" for t, _ in _LAW_LINES)}][x]) AS t FROM l),
b AS (SELECT *, coalesce(list_min(list_filter(range(1, 6), lambda i: c[i] NOT IN ('b', 'n'))), 6) AS f, coalesce(list_max(list_filter(range(1, 6), lambda i: c[i] NOT IN ('b', 'h', 'g'))), 0) AS e FROM c),
d AS (SELECT *, greatest(e, CASE WHEN c[f] = 'g' THEN f ELSE 0 END) AS z FROM b)
SELECT o_orderkey, trim(regexp_replace(regexp_replace(array_to_string(list_transform(list_filter(range(1, 6), lambda i: i BETWEEN f AND z AND c[i] NOT IN ('n', 'h')), lambda i: t[i]), chr(10)), ' +\n', chr(10), 'g'), '\n{{3,}}', chr(10) || chr(10), 'g'), chr(10) || ' ') AS operative,
  nullif(array_to_string(list_transform(list_concat(list_filter(range(1, 6), lambda i: i > z AND c[i] = 'h'), list_filter(range(1, 6), lambda i: i BETWEEN f AND z AND c[i] = 'h')), lambda i: t[i]), chr(10)), '') AS history,
  nullif(array_to_string(list_transform(list_filter(range(1, 6), lambda i: c[i] = 'n'), lambda i: t[i]), chr(10)), '') AS consolidation,
  nullif(array_to_string(list_transform(list_filter(range(1, 6), lambda i: i > z AND c[i] = 'g'), lambda i: t[i]), chr(10)), '') AS headings FROM d""")
def law_parts(spark, sf_dir):
    """What is in force of a text for each order, made of five lines of all classes."""
    lines = F.array(*(F.lit(t) for t, _ in _LAW_LINES))
    k, c = F.col("o_orderkey"), F.col("o_custkey")
    picks = (k % 8, F.floor(k / 8) % 8, F.floor(k / 64) % 8, c % 8, F.floor(c / 8) % 8)
    text = F.concat_ws("\n", *(F.element_at(lines, (p + 1).cast("int")) for p in picks))
    return table(spark, sf_dir, "orders").select("o_orderkey", law.prepared(text).alias("p")).select("o_orderkey", "p.*")


@texts.query(f"WITH {_SECTIONS} SELECT page_id, position, label, CASE WHEN n = 1 THEN label ELSE label || '#' || n END AS source_key, text, sha256(text) AS content_hash FROM sections")
def page_sections(spark, sf_dir):
    return _sections(spark, sf_dir)


@texts.query(f"WITH {_SECTIONS} SELECT page_id, count(*) AS parts, count(*) FILTER (label = '') AS empty, count(*) FILTER (n > 1) AS repeated, count(*) FILTER (contains(lower(text), 'copyright') OR contains(lower(text), '&copy;')) AS contaminated FROM sections GROUP BY page_id")
def section_integrity(spark, sf_dir):
    return corpus.integrity(_sections(spark, sf_dir), "page_id", ["copyright", "&copy;"])


@texts.query("""
SELECT source, count(*) AS n, count(*) FILTER (NOT (coalesce(length(text) < 200, false) OR coalesce(lang = 'de', false) OR text IS NULL)) AS ready, count(*) FILTER (coalesce(length(text) < 200, false)) AS short, count(*) FILTER (coalesce(lang = 'de', false)) AS german,
  count(*) FILTER (text IS NULL) AS empty FROM documents GROUP BY source""")
def corpus_inventory(spark, sf_dir):
    return corpus.inventory(table(spark, sf_dir, "documents"), ["source"], {"short": F.length("text") < 200, "german": F.col("lang") == "de", "empty": F.col("text").isNull()})


@texts.query("""
WITH c AS (SELECT 'k' || c_custkey AS k, c_mktsegment AS h FROM customer), r AS (SELECT o_orderkey % 300 AS unit_id, 'k' || (o_custkey + o_orderkey % 40) AS k, c_mktsegment AS h FROM orders JOIN customer ON c_custkey = o_custkey)
SELECT unit_id, bool_or(coalesce(c.h <> r.h, false)) AS changed, bool_or(c.k IS NULL) AS missing FROM r LEFT JOIN c ON c.k = r.k GROUP BY unit_id""")
def reference_review(spark, sf_dir):
    c = table(spark, sf_dir, "customer")
    o = table(spark, sf_dir, "orders").join(c, F.col("c_custkey") == F.col("o_custkey"))
    units = o.select((F.col("o_orderkey") % 300).alias("unit_id"), F.concat(F.lit("k"), F.col("o_custkey") + F.col("o_orderkey") % 40).alias("source_key"), F.col("c_mktsegment").alias("hash_at_link"))
    return corpus.references_to_review(units, c.select(F.concat(F.lit("k"), "c_custkey").alias("source_key"), F.col("c_mktsegment").alias("content_hash")))


@texts.query("""
WITH p AS (SELECT DISTINCT o_orderkey AS proposal, o_custkey AS k FROM orders WHERE o_orderkey % 5 = 0), u AS (SELECT o_custkey AS k, count(DISTINCT o_orderkey % 100) AS e FROM orders WHERE o_orderkey % 5 = 1 GROUP BY 1), c AS (SELECT k, count(*) - 1 AS o FROM p GROUP BY k)
SELECT proposal, p.k AS key, c.o AS others, coalesce(e, 0) AS existing FROM p JOIN c ON p.k = c.k LEFT JOIN u ON p.k = u.k WHERE c.o > 0 OR coalesce(e, 0) > 0""")
def proposal_overlaps(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("k"), F.col("o_custkey").alias("key"))
    return corpus.overlapping_proposals(o.filter("k % 5 = 0").withColumnRenamed("k", "proposal"), o.filter("k % 5 = 1").select((F.col("k") % 100).alias("unit_id"), "key"))


@texts.query("""
WITH b AS (SELECT l_orderkey AS k, count(*) AS s, list(DISTINCT l_returnflag) AS w FROM lineitem WHERE l_linenumber <= 3 GROUP BY 1), a AS (SELECT l_orderkey AS k, count(*) AS s, list(DISTINCT l_returnflag) AS w FROM lineitem WHERE l_linenumber > 3 GROUP BY 1),
d AS (SELECT a.k, a.s - b.s AS score_change, array_to_string(list_sort(list_filter(a.w, lambda x: NOT list_contains(b.w, x))), ',') AS added, array_to_string(list_sort(list_filter(b.w, lambda x: NOT list_contains(a.w, x))), ',') AS removed FROM a JOIN b ON a.k = b.k)
SELECT * FROM d WHERE score_change <> 0 OR added <> '' OR removed <> ''""")
def audit_changes(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem")
    audit = lambda rows: rows.groupBy(F.col("l_orderkey").alias("k")).agg(F.count(F.lit(1)).alias("score"), F.collect_set("l_returnflag").alias("warnings"))
    return corpus.audit_changes(audit(li.filter("l_linenumber <= 3")), audit(li.filter("l_linenumber > 3")), "k")


@texts.query("""
WITH p AS (SELECT p_partkey, CASE WHEN p_partkey % 2 = 0 THEN 'form' ELSE 'section' END AS kind, p_name AS label, CASE WHEN p_partkey % 3 = 0 THEN '  ' || upper(p_name) || ' ' ELSE p_name || ' and more' END AS text FROM part)
SELECT CASE WHEN kind = 'form' AND lower(trim(text)) = lower(label) THEN 'reference-only' ELSE 'complete' END AS status, count(*) AS n FROM p GROUP BY 1""")
def extraction_status(spark, sf_dir):
    k = F.col("p_partkey")
    p = table(spark, sf_dir, "part").select(F.when(k % 2 == 0, "form").otherwise("section").alias("kind"), F.col("p_name").alias("label"), F.when(k % 3 == 0, F.concat(F.lit("  "), F.upper("p_name"), F.lit(" "))).otherwise(F.concat("p_name", F.lit(" and more"))).alias("text"))
    return p.groupBy(corpus.only_label("kind", "label", "text").alias("status")).agg(F.count(F.lit(1)).alias("n"))


MARKERS = ["license", "cookie", "copyright", "subscribe", "<script", "nav"]


@texts.query(f"""
SELECT page_id, concat_ws(',', {', '.join(f"CASE WHEN contains(lower(html), '{m}') THEN '{m}' END" for m in MARKERS)}) AS markers,
       CAST({' + '.join(f"CASE WHEN contains(lower(html), '{m}') THEN 1 ELSE 0 END" for m in MARKERS)} AS INTEGER) AS n_markers FROM pages""")
def boilerplate_flags(spark, sf_dir):
    return corpus.markers_found(table(spark, sf_dir, "pages"), "page_id", "html", MARKERS)


#: A query with a mark and three misspelt words, of 7, 16 and 20 letters, that stand in texts in their right form.
QUERY, EACH = "L\u00efzense rezponzibilitiez internationalizetiom", 3
BOOSTS = {"citation": 10.0, "title": 8.0, "heading": 6.0, "metadata": 4.0, "body": 1.0}
_WORDS = {"lizense": 1, "rezponzibilitiez": 3, "internationalizetiom": 3}
_LONG = ("internationalization", "responsibilities", "misunderstanding")


def _folded(c: str) -> str:
    return f"trim(regexp_replace(lower(strip_accents(regexp_replace({c}, '[\\^`\u00a8\u00af\u00b4\u00b7\u00b8\u02b0-\u02ff]', '', 'g'))), '[^a-z0-9.\\-]+', ' ', 'g'), ' ')"


_ASKED = " ".join(_WORDS)
_FIELDS = ("title", "citation", "heading", "metadata", "body")
_LINE = lambda n: _folded(f"coalesce(split_part(text, chr(10), {n}), '')")


@texts.query(f"""
WITH docs AS (SELECT doc_id AS key, source AS category, {_LINE(1)} AS title, {_LINE(2)} AS heading, 'c-' || doc_id % 50 || coalesce(' ' || lang, '') AS citation, {_folded("coalesce(source, '')")} || ' ' || ['{"', '".join(_LONG)}'][doc_id % 3 + 1] || CASE WHEN doc_id % 4 = 0 THEN ' {_LONG[1]}' ELSE '' END AS metadata, {_folded("coalesce(text, '')")} AS body FROM documents),
f AS ({" UNION ALL ".join(f"SELECT key, '{c}' AS field, list_filter(string_split({c}, ' '), lambda x: x <> '') AS t FROM docs" for c in _FIELDS)}),
s AS (SELECT field, count(*) FILTER (len(t) > 0) AS n, avg(len(t)) FILTER (len(t) > 0) AS mean FROM f GROUP BY field),
p AS (SELECT key, field, term, count(*) AS tf, any_value(len) AS len FROM (SELECT key, field, unnest(t) AS term, len(t) AS len FROM f) GROUP BY key, field, term),
d AS (SELECT term, field, count(*) AS df FROM p GROUP BY ALL), w AS (SELECT unnest([{", ".join(f"{{'word': '{w}', 'far': {n}}}" for w, n in _WORDS.items())}], recursive := true)),
m AS (SELECT word, term, CASE WHEN term = word THEN 1.0 ELSE greatest(CASE WHEN starts_with(term, word) THEN 0.375 * length(term) / (length(term) + 0.3 * (length(term) - length(word))) END,
    CASE WHEN levenshtein(term, word) <= far THEN 0.45 * length(term) / (length(term) + levenshtein(term, word)) END) END AS weight
  FROM (SELECT DISTINCT term FROM d), w WHERE starts_with(term, word) OR levenshtein(term, word) <= far),
b AS (SELECT key, word, field, max(weight * CASE field {" ".join(f"WHEN '{f}' THEN {v}" for f, v in BOOSTS.items())} END * ln(1 + (n - df + 0.5) / (df + 0.5)) * (0.5 + tf * 2.2 / (tf + 1.2 * (0.3 + 0.7 * len / mean)))) AS s
  FROM p JOIN m USING (term) JOIN d USING (term, field) JOIN s USING (field) GROUP BY ALL),
r AS (SELECT key, count(DISTINCT word) AS words, sum(s) AS s FROM b GROUP BY key),
x AS (SELECT r.key, category, words = 3 AS all_words, s + CASE WHEN '{_ASKED}' IN (title, citation) THEN 5000 WHEN contains(title, '{_ASKED}') OR contains(citation, '{_ASKED}') THEN 1500 WHEN contains(body, '{_ASKED}') THEN 1300
    WHEN {" AND ".join(f"contains(body, '{w}')" for w in _WORDS)} THEN 500 ELSE 0 END AS score
  FROM r JOIN docs ON docs.key = r.key)
SELECT key, category, all_words, round(score, 5) AS score, row_number() OVER (PARTITION BY category ORDER BY all_words DESC, round(score, 6) DESC, key) AS rank FROM x QUALIFY rank <= {EACH}""")
def search_ranked(spark, sf_dir):
    """The best documents of each source for a query of misspelt words, from an index of five fields."""
    k = F.col("doc_id")
    line = lambda n: F.coalesce(F.get(F.split("text", "\n"), F.lit(n)), F.lit(""))
    long = F.element_at(F.array(*map(F.lit, _LONG)), (k % 3 + 1).cast("int"))
    docs = spread(table(spark, sf_dir, "documents")).select(
        "doc_id", "source", line(0).alias("title"), line(1).alias("heading"), F.concat(F.lit("c-"), k % 50, F.coalesce(F.concat(F.lit(" "), "lang"), F.lit(""))).alias("citation"),
        F.concat_ws(" ", F.coalesce("source", F.lit("")), long, F.when(k % 4 == 0, _LONG[1])).alias("metadata"), F.col("text").alias("body"),
    )
    index = search.build(docs, "doc_id", "source", list(_FIELDS))
    return rounded(search.search(index, QUERY, BOOSTS, "title", "body", EACH, citation="citation"), 5)


@texts.query("""
WITH t AS (SELECT item_id, lower(text) AS t FROM benchmark), w AS (SELECT unnest(['the', 'ou']) AS w),
o AS (SELECT item_id, w, unnest(range(1, len(string_split(t, w)))) AS i, string_split(t, w) AS p FROM t, w)
SELECT item_id, CAST(list_sum(list_transform(p[1:i], lambda x: length(x))) + (i - 1) * length(w) + 1 AS INTEGER) AS start, CAST(length(w) AS INTEGER) AS length FROM o""")
def highlight_spans(spark, sf_dir):
    spans = search.highlights("text", ["the", "ou"])
    return table(spark, sf_dir, "benchmark").select("item_id", F.explode(spans).alias("s")).select("item_id", "s.start", "s.length")


@texts.query(f"""
WITH n AS (SELECT doc_id, text, {_folded('text')} AS folded FROM documents WHERE text IS NOT NULL),
p AS (SELECT *, CASE WHEN instr(folded, 'license terms') > 0 THEN instr(folded, 'license terms') ELSE least(nullif(instr(folded, 'license'), 0), nullif(instr(folded, 'terms'), 0)) END AS pos FROM n),
s AS (SELECT *, greatest(0, CAST(floor((pos - 1) * (length(text) / greatest(length(folded), 1))) AS BIGINT) - 90) AS st FROM p)
SELECT doc_id, CASE WHEN trim(text, chr(32) || chr(9) || chr(10) || chr(13)) = '' THEN '' WHEN pos IS NULL THEN substring(text, 1, 260) ELSE CASE WHEN st > 0 THEN '...' ELSE '' END || substring(text, st + 1, 260) || CASE WHEN st + 260 < length(text) THEN '...' ELSE '' END END AS snippet FROM s""")
def snippet_window(spark, sf_dir):
    docs = spread(table(spark, sf_dir, "documents").filter("text is not null").select("doc_id", "text"))
    return docs.select("doc_id", snippet("text", F.lit("L\u00efcense, Terms!")).alias("snippet"))


_RATED = """a AS (SELECT user_id, ts, event_id, CASE event_type WHEN 'error' THEN 'again' WHEN 'signup' THEN 'hard' WHEN 'click' THEN 'good' WHEN 'purchase' THEN 'easy' END AS rating FROM events WHERE ts IS NOT NULL)"""


def _log(spark, sf_dir):
    """The events as a log of attempts; a view is a reading, without a rating."""
    rating = F.create_map(*(F.lit(x) for kv in (("error", "again"), ("signup", "hard"), ("click", "good"), ("purchase", "easy")) for x in kv))[F.col("event_type")]
    return table(spark, sf_dir, "events").filter("ts is not null").select("user_id", "ts", "event_id", rating.alias("rating"))


@texts.query(f"""
WITH {_RATED}, r0 AS (SELECT user_id, min({{'t': ts, 'e': event_id}}) AS t0 FROM a WHERE rating IS NULL GROUP BY 1),
s AS (SELECT a.user_id, {{'t': ts, 'e': event_id}} AS w FROM a JOIN r0 ON a.user_id = r0.user_id WHERE rating IN ('good', 'easy') AND {{'t': ts, 'e': event_id}} > t0),
d1 AS (SELECT user_id, CAST(w.t AS DATE) AS d, min(w) AS f FROM s GROUP BY 1, 2), t1 AS (SELECT user_id, f AS t1 FROM d1 QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY d) = 2),
d2 AS (SELECT s.user_id, CAST(w.t AS DATE) AS d, min(w) AS f FROM s JOIN t1 ON s.user_id = t1.user_id WHERE w > t1 GROUP BY 1, 2), t2 AS (SELECT user_id, f AS t2 FROM d2 QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY d) = 2),
t3 AS (SELECT s.user_id, min(w) AS t3 FROM s JOIN t2 ON s.user_id = t2.user_id WHERE w > t2 GROUP BY 1),
l AS (SELECT user_id, count(rating) AS attempts, first(rating ORDER BY ts DESC, event_id DESC) AS last, max(ts) AS last_at FROM (SELECT user_id, ts, event_id, coalesce(rating, '-') AS r2, rating FROM a) GROUP BY user_id),
k AS (SELECT user_id, first(coalesce(rating, '-') ORDER BY ts DESC, event_id DESC) AS last FROM a GROUP BY user_id)
SELECT l.user_id, CASE WHEN t3 IS NOT NULL THEN 'maintenance' WHEN t2 IS NOT NULL THEN 'application' WHEN t1 IS NOT NULL THEN 'free-recall' WHEN t0 IS NOT NULL THEN 'guided-recall' ELSE 'unread' END AS phase, attempts,
  last_at + to_days(CASE k.last WHEN 'hard' THEN 1 WHEN 'good' THEN 3 WHEN 'easy' THEN 7 ELSE 0 END) AS due_at
FROM l JOIN k ON l.user_id = k.user_id LEFT JOIN r0 ON l.user_id = r0.user_id LEFT JOIN t1 ON l.user_id = t1.user_id LEFT JOIN t2 ON l.user_id = t2.user_id LEFT JOIN t3 ON l.user_id = t3.user_id""")
def phase_fold(spark, sf_dir):
    """The phase machine over each user's log."""
    return scheduling.unit_phases(_log(spark, sf_dir), "user_id", "ts", "rating", "event_id")


_W = scheduling.FSRS


@texts.query(f"""
WITH {_RATED}, u AS (SELECT *, least(event_id, (SELECT max(event_id) FROM events) - event_id) AS unit FROM a WHERE rating IS NOT NULL), g AS (SELECT unit, ts, CASE rating WHEN 'again' THEN 1 WHEN 'hard' THEN 2 WHEN 'good' THEN 3 ELSE 4 END AS g, row_number() OVER (PARTITION BY unit ORDER BY ts, event_id) AS n FROM u),
f AS (SELECT unit, ts, g, [{_W[0]}, {_W[1]}, {_W[2]}, {_W[3]}][g] AS s, least(10, greatest(1, {_W[4]} - exp({_W[5]} * (g - 1)) + 1)) AS d FROM g WHERE n = 1),
p AS (SELECT f.unit, f.s, f.d, t.g, t.ts, date_diff('day', CAST(f.ts AS DATE), CAST(t.ts AS DATE)) AS days FROM f JOIN g t ON t.unit = f.unit AND t.n = 2),
r AS (SELECT *, (1 + 19.0 / 81 * days / s) ** -0.5 AS r FROM p),
q AS (SELECT unit, ts, g, least(10, greatest(1, {_W[7]} * ({_W[4]} - exp({_W[5]} * 3) + 1) + (1 - {_W[7]}) * (d - {_W[6]} * (g - 3) * (10 - d) / 9))) AS d, greatest(0.01, CASE WHEN days < 1 THEN s * exp({_W[17]} * (g - 3 + {_W[18]}))
  WHEN g = 1 THEN least(s, {_W[11]} * d ** -{_W[12]} * ((s + 1) ** {_W[13]} - 1) * exp({_W[14]} * (1 - r))) ELSE s * (1 + exp({_W[8]}) * (11 - d) * s ** -{_W[9]} * (exp({_W[10]} * (1 - r)) - 1) * CASE g WHEN 2 THEN {_W[15]} WHEN 4 THEN {_W[16]} ELSE 1 END) END) AS s FROM r)
SELECT f.unit, CAST(CASE WHEN q.unit IS NULL THEN 1 ELSE 2 END AS BIGINT) AS reps, CAST(CASE WHEN q.g = 1 THEN 1 ELSE 0 END AS BIGINT) AS lapses, round(CAST(coalesce(q.s, f.s) AS DOUBLE), 5) AS stability, round(CAST(coalesce(q.d, f.d) AS DOUBLE), 5) AS difficulty,
  coalesce(q.ts, f.ts) + to_days(CAST(greatest(1, round(coalesce(q.s, f.s))) AS INTEGER)) AS due_at FROM f LEFT JOIN q ON q.unit = f.unit""")
def memory_states(spark, sf_dir):
    """Spaced repetition over logs of one or two reviews, from the same day to the whole time apart: the first event with the last, and so on."""
    k = F.col("event_id")
    top = table(spark, sf_dir, "events").agg(F.max("event_id")).first()[0]
    log = _log(spark, sf_dir).withColumn("unit", F.least(k, top - k))
    return rounded(scheduling.memory_states(log, "unit", "ts", "rating", "event_id"), 5)


@texts.query()
def memory_of_users(spark, sf_dir):
    """Spaced repetition over each user's whole log."""
    return rounded(scheduling.memory_states(_log(spark, sf_dir), "user_id", "ts", "rating", "event_id"))


@texts.query(f"WITH {_RATED} SELECT user_id, event_id, rating FROM a QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) = 1")
def latest_attempt(spark, sf_dir):
    return scheduling.latest_attempts(_log(spark, sf_dir), "user_id", "ts", "event_id").select("user_id", "event_id", "rating")


@texts.query(f"WITH {_RATED} SELECT user_id, count(*) AS left_over, max(event_id) AS last_event FROM (SELECT * FROM a QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id % 5 DESC) > 1) GROUP BY user_id")
def undo_last(spark, sf_dir):
    """Each user's last attempt taken back; ties are shared by many users."""
    left = scheduling.without_last(_log(spark, sf_dir).withColumn("tie", F.col("event_id") % 5), "user_id", "ts", "tie")
    return left.groupBy("user_id").agg(F.count(F.lit(1)).alias("left_over"), F.max("event_id").alias("last_event"))


_UNITS = """units AS (SELECT o_orderkey AS unit_id, o_orderpriority AS title, o_orderkey % 13 = 0 AS needs_review, CASE WHEN o_orderkey % 7 = 0 THEN 'unread' ELSE 'free-recall' END AS phase, o_orderdate AS due_at FROM orders)"""
NOW = "1997-06-01"
SURPRISES = 1450


def _units(spark, sf_dir):
    k = F.col("o_orderkey")
    return table(spark, sf_dir, "orders").select(k.alias("unit_id"), F.col("o_orderpriority").alias("title"), (k % 13 == 0).alias("needs_review"), F.when(k % 7 == 0, "unread").otherwise("free-recall").alias("phase"), F.col("o_orderdate").alias("due_at"))


@texts.query(f"""
WITH {_UNITS} SELECT CASE WHEN needs_review THEN 'source-review' WHEN phase = 'unread' THEN 'new' WHEN due_at < TIMESTAMP '{NOW}' - INTERVAL 1 DAY THEN 'overdue' WHEN due_at <= TIMESTAMP '{NOW}' THEN 'due' WHEN due_at <= TIMESTAMP '{NOW}' + INTERVAL 7 DAY THEN 'soon' ELSE 'later' END AS class,
  count(*) AS n FROM units GROUP BY 1""")
def due_classes(spark, sf_dir):
    return scheduling.due_classes(_units(spark, sf_dir), F.lit(NOW).cast("timestamp_ntz")).groupBy("class").agg(F.count(F.lit(1)).alias("n"))


@texts.query(f"WITH {_UNITS} SELECT unit_id, title, due_at FROM units WHERE due_at > TIMESTAMP '{NOW}' AND phase <> 'unread' AND NOT needs_review ORDER BY due_at, title, unit_id LIMIT 1")
def next_review(spark, sf_dir):
    return scheduling.next_review(_units(spark, sf_dir), F.lit(NOW).cast("timestamp_ntz")).select("unit_id", "title", F.col("due_at").cast("timestamp_ntz").alias("due_at"))


@texts.query(f"WITH {_RATED} SELECT c_custkey AS user_id FROM customer LEFT JOIN (SELECT user_id, max(ts) AS last_at FROM a GROUP BY 1) l ON c_custkey = l.user_id ORDER BY last_at NULLS FIRST, md5(CAST(c_custkey AS VARCHAR)), c_custkey LIMIT {SURPRISES}")
def surprise_units(spark, sf_dir):
    """Units for a surprise: those that nobody attempted, then those whose last attempt is longest ago."""
    units = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("user_id"))
    return scheduling.least_recent(units, _log(spark, sf_dir), "user_id", "ts", SURPRISES).select("user_id")


@texts.query(f"WITH {_RATED} SELECT CAST(ts AS DATE) AS day, count(*) AS reviewed, count(*) FILTER (rating = 'again') AS again, count(*) FILTER (rating = 'hard') AS hard, count(*) FILTER (rating = 'good') AS good, count(*) FILTER (rating = 'easy') AS easy FROM a WHERE rating IS NOT NULL GROUP BY 1")
def session_summary(spark, sf_dir):
    rows = _log(spark, sf_dir).filter("rating is not null").withColumn("day", F.to_date("ts"))
    return scheduling.session_summary(rows, "day", "rating")
