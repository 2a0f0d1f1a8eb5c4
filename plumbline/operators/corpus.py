"""The text corpus: pages to text and sections, integrity, inventories, references and audits. Search is in ``search``."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from plumbline.functions.numbers import natural_key
from plumbline.functions.text import html_title, html_to_text


def pages_as_text(pages: DataFrame, key: str = "page_id", html: str = "html") -> DataFrame:
    return pages.select(key, html_title(html).alias("title"), html_to_text(html).alias("text"))


def markers_found(df: DataFrame, key: str, text: str, markers: list[str]) -> DataFrame:
    """Markers of boilerplate that a text contains, in the order given, ignoring case."""
    low = F.lower(F.coalesce(F.col(text), F.lit("")))
    found = F.array_compact(F.array(*(F.when(low.contains(m.lower()), F.lit(m)) for m in markers)))
    return df.select(key, F.array_join(found, ",").alias("markers"), F.size(found).alias("n_markers"))


def sections(pages: DataFrame, key: str, html: str, start: str, label: str) -> DataFrame:
    """(key, position, label, source_key, text, content_hash) of the parts of each page that begin where ``start`` matches, up to the next
    one. The label is what the first group of ``label`` finds in a part; the source key counts labels that come again (``a``, ``a#2``).
    What stands before the first start, and parts without text, are left out."""
    mark = "\u0001"
    parts = F.split(F.regexp_replace(F.regexp_replace(html, mark, ""), f"({start})", mark + "$1"), mark, -1)
    rows = pages.select(key, F.posexplode(parts).alias("position", "part")).filter("position > 0")
    rows = rows.select(key, "position", F.lower(F.trim(html_to_text(F.regexp_extract("part", label, 1)))).alias("label"), html_to_text("part").alias("text")).filter("text <> ''")
    n = F.row_number().over(Window.partitionBy(key, "label").orderBy("position"))
    name = F.when(F.col("__n") == 1, F.col("label")).otherwise(F.concat_ws("#", "label", "__n"))
    return rows.withColumn("__n", n).select(key, "position", "label", name.alias("source_key"), "text", F.sha2("text", 256).alias("content_hash"))


def elements(pages: DataFrame, key: str, html: str, ids: list[str], tag: str = "div", ends: list[str] = ()) -> DataFrame:
    """(key, container, content) of the element ``tag`` with the first of ``ids`` that a page has, with all that is nested in it; where no end closes it,
    up to the end of the page; without any of the ids, the whole page, with a null container. What follows the first match of a pattern in ``ends``
    is left out. ``key`` is unique. Null pages have null content.

    Tags of the kind become events, one row each, with what they add to the depth; running sums over a page's events give depth and place,
    and the first event at depth 0 ends the element. Only events are shuffled, not pages.
    """
    begin = lambda name: F.regexp_extract(html, f"(?i)<{tag}\\b[^>]*\\bid=[\"\']{re.escape(name)}[\"\'][^>]*>", 0)
    start, container = F.lit(""), F.lit(None).cast("string")
    for name in reversed(ids):
        start = F.when(begin(name) != "", begin(name)).otherwise(start)
        container = F.when(begin(name) != "", F.lit(name)).otherwise(container)
    rows = pages.select(F.col(key).alias("__k"), F.col(html).alias("__html"), container.alias("container"), start.alias("__start"))
    at = F.instr(F.col("__html"), F.col("__start")) + F.length("__start")
    rest = F.when(F.col("container").isNull(), F.col("__html")).otherwise(F.substring(F.col("__html"), at, F.length("__html")))
    rows = rows.select("__k", "container", rest.alias("__rest"))

    mark = f"(?i)</?{tag}\\b[^>]*>"
    tags, texts = F.regexp_extract_all("__rest", F.lit(f"({mark})"), 1), F.split("__rest", mark, -1)
    events = F.arrays_zip(F.transform(tags, lambda t: F.when(t.startswith("</"), -1).otherwise(1)).alias("step"), F.transform(tags, F.length).alias("size"), F.transform(F.slice(texts, F.lit(1), F.size(tags)), F.length).alias("before"))
    found = rows.filter("container is not null").select("__k", F.posexplode(events).alias("i", "e"))
    so_far = Window.partitionBy("__k").orderBy("i").rowsBetween(Window.unboundedPreceding, 0)
    depth, place = 1 + F.sum("e.step").over(so_far), F.sum(F.col("e.before") + F.col("e.size")).over(so_far) - F.col("e.size")
    closed = found.select("__k", "i", depth.alias("depth"), place.alias("place")).filter("depth = 0").groupBy("__k").agg(F.min_by("place", "i").alias("place"))
    out = rows.join(closed.withColumnRenamed("__k", "__c"), F.col("__k") == F.col("__c"), "left")
    content = F.when(F.col("place").isNotNull(), F.substring(F.col("__rest"), F.lit(1), F.col("place").cast("int"))).otherwise(F.col("__rest"))
    if ends:
        content = F.split(content, "|".join(f"(?:{e})" for e in ends), 2)[0]
    return out.select(F.col("__k").alias(key), "container", content.alias("content"))


def integrity(parts: DataFrame, key: str, markers: list[str]) -> DataFrame:
    """(key, parts, empty, repeated, contaminated) of each page's sections: how many, how many labels are empty or come again, and how
    many hold a marker of boilerplate."""
    low = F.lower("text")
    dirty = F.lit(False)
    for m in markers:
        dirty = dirty | low.contains(m.lower())
    return parts.groupBy(key).agg(F.count(F.lit(1)).alias("parts"), F.count_if(F.col("label") == "").alias("empty"), F.count_if(F.col("source_key") != F.col("label")).alias("repeated"), F.count_if(dirty).alias("contaminated"))


def only_label(kind, label, text) -> Column:
    """``reference-only`` for a form whose text is just its own label, else ``complete``."""
    plain = lambda c: F.lower(F.trim(F.regexp_replace(F.col(c), r"\s+", " ")))
    return F.when((F.col(kind) == "form") & (plain(text) == plain(label)), "reference-only").otherwise("complete")


def label_order(kind_rank: Column, label: str, tie: str) -> list[Column]:
    """Order of parts of a law: by kind, by label with numbers by value, then by key."""
    return [kind_rank, natural_key(label), F.col(tie)]


def inventory(docs: DataFrame, by: list[str], reasons: dict[str, Column]) -> DataFrame:
    """(by, n, ready, a count for each reason) of a corpus: documents that a reason blocks, and those that none does."""
    blocked = F.lit(False)
    for c in reasons.values():
        blocked = blocked | F.coalesce(c, F.lit(False))
    return docs.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), F.count_if(~blocked).alias("ready"), *(F.count_if(F.coalesce(c, F.lit(False))).alias(r) for r, c in reasons.items()))


def references_to_review(units: DataFrame, components: DataFrame) -> DataFrame:
    """(unit_id, changed, missing): whether any of a unit's references (source_key, hash_at_link) has other content by now, or none."""
    now = components.groupBy(F.col("source_key").alias("k")).agg(F.max("content_hash").alias("now"))
    refs = units.join(now, F.col("source_key") == F.col("k"), "left")
    return refs.groupBy("unit_id").agg(F.bool_or(F.coalesce(F.col("now") != F.col("hash_at_link"), F.lit(False))).alias("changed"), F.bool_or(F.col("k").isNull()).alias("missing"))


def overlapping_proposals(proposals: DataFrame, units: DataFrame) -> DataFrame:
    """(proposal, key, others, existing): proposals that share a source key with other proposals or with a unit."""
    p = proposals.select("proposal", "key").distinct()
    counts = p.groupBy(F.col("key").alias("k")).agg((F.count(F.lit(1)) - 1).alias("others"))
    have = units.groupBy(F.col("key").alias("u")).agg(F.count_distinct("unit_id").alias("existing"))
    out = p.join(counts, F.col("key") == F.col("k")).join(have, F.col("key") == F.col("u"), "left").na.fill(0, ["existing"])
    return out.select("proposal", "key", "others", "existing").filter("others > 0 or existing > 0")


def audit_changes(before: DataFrame, after: DataFrame, key: str) -> DataFrame:
    """(key, score_change, added, removed) of documents whose score or warnings changed between two audits (key, score, warnings)."""
    b = before.select(F.col(key).alias("__k"), F.col("score").alias("__s"), F.col("warnings").alias("__w"))
    rows = after.join(b, F.col(key) == F.col("__k"))
    text = lambda a: F.array_join(F.array_sort(a), ",")
    out = rows.select(key, (F.col("score") - F.col("__s")).alias("score_change"), text(F.array_except("warnings", "__w")).alias("added"), text(F.array_except("__w", "warnings")).alias("removed"))
    return out.filter("score_change <> 0 or added <> '' or removed <> ''")


def content_hash(df: DataFrame, by: str, order: str, text: str) -> DataFrame:
    """A hash of each group's rows that doesn't need them together: the sum of the rows' own hashes, with their number.
    Rows in another order give the same hash; a repeated row counts twice."""
    h = F.xxhash64(F.col(order).cast("string"), F.col(text)).cast("decimal(38,0)")
    return df.groupBy(by).agg(F.count(F.lit(1)).alias("n"), F.sum(h).cast("string").alias("content_hash"))
