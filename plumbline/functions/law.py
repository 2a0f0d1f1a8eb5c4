"""Parts of a legal text as column expressions: what is in force, the history of amendments, notes of consolidation and headings left at the end.

Each line gets a class; the first and the last line that say something bound the operative part, and what is no text within it moves to its own part.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from plumbline.functions.numbers import col

#: How a note of consolidation reads, how references to amending acts begin or stand alone, and headings that may be left at the end.
CONSOLIDATION = r"(?i)^N\.B\.\s*This (?:Regulation|Act|Rule|document)\b.*\bconsolidated to\b.*\.?$"
HISTORY = (
    r"(?i)^(?:R\.S\.|S\.N\.B\.|O\.C\.)",
    r"(?i)^(?:19|20)[0-9]{2},\s*c\.",
    r"(?i)^(?:19|20)[0-9]{2}\s+\([^)]+\),\s*c\.",
    r"(?i)^[0-9]{2,4}-[0-9]{1,3}(?:\s*;\s*[0-9]{2,4}-[0-9]{1,3})*;?\.?$",
    r"(?i)^[0-9]{2,4}-[0-9]{1,3}\s*;.*\b(?:19|20)[0-9]{2},\s*c\.",
)
HEADINGS = (
    "APPLICATION",
    "APPLICATIONS",
    "APPLICATION TO CONFIRM A BOUNDARY",
    "APPLICATION TO COURT",
    "DEFINITIONS",
    "GENERAL",
    "ADMINISTRATION",
    "REGULATIONS",
    "OFFENCES",
    "APPEALS",
    "TRANSITIONAL PROVISIONS",
    "COMING INTO FORCE",
    "COMMENCEMENT",
    "REPEAL",
    "REFERENCES IN OTHER ENACTMENTS",
)
INLINE_HISTORY = r"(?i)^(.*\S)\s*?((?=.*(?:\bc\.|s\.|O\.C\.|R\.S\.|;\s*(?:19|20)[0-9]{2}))(?:R\.S\.|S\.N\.B\.|O\.C\.|(?:19|20)[0-9]{2},\s*c\.|(?:19|20)[0-9]{2}\s+\([^)]+\),\s*c\.|[0-9]{2,4}-[0-9]{1,3}).*)$"
REPEALED = r"(?i)(?:[0-9]+(?:\.[0-9]+)?)?Repealed:\s*(?:(?:19|20)[0-9]{2},\s*c\.|O\.C\.|R\.S\.)[^\n]*"


def line_class(line: Column) -> Column:
    """blank, consolidation, history, heading or text."""
    t = F.trim(F.regexp_replace(line, r"^\s+|\s+$", ""))
    history = t.rlike(HISTORY[0])
    for pattern in HISTORY[1:]:
        history = history | t.rlike(pattern)
    return F.when(t == "", "blank").when(t.rlike(CONSOLIDATION), "consolidation").when(history, "history").when(t.isin(*HEADINGS), "heading").otherwise("text")


def prepared(text) -> Column:
    """A struct of operative, history, consolidation and headings of a text; parts but the first are null if there are none. A note of consolidation counts
    wherever it stands; a heading only behind the last line of text, and not as the only line; history in lines of its own, or at the end of the
    last line of text. Null for null."""
    text = col(text)
    lines = F.transform(F.split(F.regexp_replace(text, "\r\n?", "\n"), "\n", -1), lambda x: F.struct(F.regexp_replace(x, r"^\s+|\s+$", "").alias("t"), x.alias("line"), line_class(x).alias("c")))

    def parts(lines):
        numbered = F.transform(lines, lambda x, i: F.struct(i.alias("i"), x["t"].alias("t"), x["line"].alias("line"), x["c"].alias("c")))
        place = lambda classes, pick: pick(F.transform(F.filter(numbered, lambda x: ~x["c"].isin(*classes)), lambda x: x["i"]))
        first = F.coalesce(place(("blank", "consolidation"), F.array_min), F.size(lines))
        # A heading that nothing stands before is the text itself.
        last = F.coalesce(place(("blank", "history", "heading"), F.array_max), F.lit(-1))
        only = F.get(numbered, first)["c"] == "heading"
        last = F.greatest(last, F.when(only, first).otherwise(-1))
        return F.transform(F.array(F.struct(first.alias("first"), last.alias("last"), numbered.alias("n"))), cut_parts)[0]

    def cut_parts(s):
        inside = F.filter(s["n"], lambda x: (x["i"] >= s["first"]) & (x["i"] <= s["last"]))
        kept = F.filter(inside, lambda x: ~x["c"].isin("consolidation", "history"))
        final = F.coalesce(F.get(kept, F.size(kept) - 1)["line"], F.lit(""))
        tail = F.regexp_extract(final, INLINE_HISTORY, 2)
        shorter = F.when(tail == "", final).otherwise(F.regexp_extract(final, INLINE_HISTORY, 1))
        body = F.concat(F.transform(F.slice(kept, F.lit(1), F.greatest(F.size(kept) - 1, F.lit(0))), lambda x: x["line"]), F.when(F.size(kept) > 0, F.array(shorter)).otherwise(F.array().cast("array<string>")))
        operative = F.regexp_replace(F.array_join(body, "\n"), REPEALED, "Repealed.")
        operative = F.regexp_replace(F.regexp_replace(operative, "[ \t]+\n", "\n"), "\n{3,}", "\n\n")
        of = lambda c, where: F.transform(F.filter(s["n"], lambda x: (x["c"] == c) & where(x["i"])), lambda x: x["t"])
        anywhere, behind, within = (lambda i: F.lit(True)), (lambda i: i > s["last"]), (lambda i: (i >= s["first"]) & (i <= s["last"]))
        history = F.concat(F.when(tail == "", F.array().cast("array<string>")).otherwise(F.array(tail)), of("history", behind), of("history", within))
        some = lambda lines: F.when(F.size(lines) > 0, F.array_join(lines, "\n"))
        return F.struct(
            F.regexp_replace(operative, r"^\s+|\s+$", "").alias("operative"), some(history).alias("history"), some(of("consolidation", anywhere)).alias("consolidation"), some(of("heading", behind)).alias("headings")
        )

    return F.when(text.isNotNull(), F.transform(F.array(lines), parts)[0])
