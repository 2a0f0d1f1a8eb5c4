"""Text keys, tokens, snippets, HTML."""

from __future__ import annotations

import unicodedata

from pyspark.sql import Column
from pyspark.sql import functions as F

from plumbline.functions.numbers import col

def _marked_letters() -> tuple[str, str]:
    """All letters whose canonical decomposition is an ASCII letter with marks, and those ASCII letters."""
    found = []
    for c in map(chr, range(0xC0, 0x2200)):
        plain = unicodedata.normalize("NFD", c)
        if plain[0].isascii() and plain[0].isalpha() and len(plain) > 1 or c == "\u212a":
            found.append((c, plain[0].lower()))
    return "".join(c for c, _ in found), "".join(p for _, p in found)


MARKED, PLAIN = _marked_letters()
#: Marks that stand alone: combining ones, and the spacing ones that count as diacritics.
LONE_MARKS = r"[\p{M}^`\x{A8}\x{AF}\x{B4}\x{B7}\x{B8}\x{2B0}-\x{2FF}]"


#: What stands between words of lower-case ASCII text.
_BETWEEN = "".join(c for c in map(chr, range(128)) if not (c.islower() or c.isdigit() or c in ".-"))


def fold(c) -> Column:
    """Lower case without marks."""
    t = col(c).cast("string")
    # Most texts have plain letters alone, and of the marks only these two.
    plain = F.replace(F.replace(t, F.lit("^"), F.lit("")), F.lit("`"), F.lit(""))
    marked = F.translate(F.regexp_replace(t, LONE_MARKS, ""), MARKED, PLAIN)
    return F.lower(F.when(F.octet_length(t) == F.length(t), plain).otherwise(marked))


def search_text(c) -> Column:
    """For searching: folded, only letters, digits, dots and hyphens, single spaces."""

    def kept(t):
        words = F.filter(F.split(F.translate(t, _BETWEEN, " " * len(_BETWEEN)), " "), lambda w: w != "")
        return F.when(F.octet_length(t) == F.length(t), F.array_join(words, " ")).otherwise(F.trim(F.regexp_replace(t, r"[^a-z0-9.\-]+", " ")))

    return F.transform(F.array(fold(c)), kept)[0]


def search_tokens(c) -> Column:
    return F.filter(F.split(search_text(c), " "), lambda t: t != "")


def compact_key(c) -> Column:
    """For comparing titles: lower-case letters and digits alone."""
    return F.regexp_replace(F.lower(col(c).cast("string")), "[^a-z0-9]+", "")


def description_key(c) -> Column:
    """For comparing descriptions: trimmed, single spaces, upper case."""
    return F.upper(F.trim(F.regexp_replace(col(c).cast("string"), r"\s+", " ")))


def clean_id(c) -> Column:
    return F.upper(F.trim(col(c).cast("string")))


def file_name(c, fallback: str = "export") -> Column:
    """A safe file name: other characters than letters, digits, dot, hyphen and underscore become hyphens."""
    out = F.regexp_replace(F.regexp_replace(F.trim(col(c).cast("string")), r"[^A-Za-z0-9._-]+", "-"), r"^-+|-+$", "")
    return F.when(F.coalesce(out, F.lit("")) == "", F.lit(fallback)).otherwise(out)


def is_number(c) -> Column:
    return F.coalesce(F.trim(col(c).cast("string")).rlike(r"^[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?$"), F.lit(False))


def words(line) -> Column:
    """White-space tokens of a line."""
    return F.filter(F.split(F.trim(col(line)), r"\s+"), lambda t: t != "")


def without_comment(line, mark: str = "#") -> Column:
    return F.rtrim(F.substring_index(col(line), mark, 1))


def csv_field(c, delimiter: str = ",") -> Column:
    """A field for CSV: quoted where it holds the delimiter, a quote or a line break; null is empty."""
    t = F.coalesce(col(c).cast("string"), F.lit(""))
    return F.when(t.contains(delimiter) | t.rlike('["\n\r]'), F.concat(F.lit('"'), F.replace(t, F.lit('"'), F.lit('""')), F.lit('"'))).otherwise(t)


def snippet(text, query, before: int = 90, length: int = 260) -> Column:
    """A window of ``text`` around the first place of ``query``, with dots where it is cut. Both are folded as search folds them; where the query isn't
    found as a whole, the first of its words counts, and without any of them the window is the start, without dots. A place in the folded text is
    one in the text by the ratio of their lengths. A blank text has none."""
    text, asked = col(text), search_text(query)
    let = lambda value, then: F.transform(F.array(value), then)[0]

    def place(folded):
        """Where the window's middle is in the text, from 0, or null; ``folded`` is worked out once."""
        whole = F.instr(folded, asked)
        words = F.transform(F.filter(F.split(asked, " "), lambda w: w != ""), lambda w: F.instr(folded, w))
        at = F.when(asked != "", F.when(whole > 0, whole).otherwise(F.array_min(F.filter(words, lambda p: p > 0)))) - 1
        return F.floor(at * (F.length(text) / F.greatest(F.length(folded), F.lit(1)))).cast("int")

    def window(at):
        start = F.greatest(F.lit(0), at - before)
        body = F.concat(F.when(start > 0, "...").otherwise(""), F.substring(text, start + 1, F.lit(length)), F.when(start + length < F.length(text), "...").otherwise(""))
        return F.when(at.isNull(), F.substring(text, 1, length)).otherwise(body)

    return F.when(text.rlike(r"^\s*$"), "").otherwise(let(let(search_text(text), place), window))


#: Named character references that pages use.
ENTITIES = {"amp": "&", "lt": "<", "gt": ">", "quot": '"', "apos": "'", "nbsp": " "}


def decode_entities(c) -> Column:
    """Character references decoded in one pass, so that nothing is decoded twice: numbers in decimal or hexadecimal, and the names
    above in any case; others stay as they are."""
    parts = F.regexp_extract_all(col(c), F.lit("(?i)(&(?:#x[0-9a-f]{1,6}|#[0-9]{1,7}|[a-z]+);|[^&]+|&)"), 1)
    names = F.create_map(*(F.lit(x) for kv in ENTITIES.items() for x in kv))

    def one(p):
        low = F.lower(p)
        code = F.when(low.startswith("&#x"), F.conv(F.regexp_extract(low, "^&#x([0-9a-f]+);$", 1), 16, 10)).otherwise(F.regexp_extract(low, "^&#([0-9]+);$", 1)).try_cast("int")
        good = code.isNotNull() & (code > 0) & (code <= 0x10FFFF) & ~code.between(0xD800, 0xDFFF)
        char = F.decode(F.unhex(F.lpad(F.hex(code), 8, "0")), "UTF-32")
        return F.when(low.startswith("&#") & good, char).when(low.rlike("^&[a-z]+;$"), F.coalesce(names[F.substring(low, F.lit(2), F.length(low) - 2)], p)).otherwise(p)

    return F.array_join(F.transform(parts, one), "")


def strip_hidden(html) -> Column:
    """HTML without scripts, styles, forms and navigation."""
    out = col(html)
    for tag in ("script", "style", "form", "nav"):
        out = F.regexp_replace(out, f"(?is)<{tag}\\b.*?</{tag}>", "")
    return out


def html_to_text(html) -> Column:
    """Visible text: line breaks at <br> and block ends, `` | `` before table cells, tags out, entities decoded, blanks collapsed within
    lines and more than one empty line to one."""
    out = F.regexp_replace(strip_hidden(html), r"(?i)<br\s*/?>", "\n")
    out = F.regexp_replace(out, r"(?i)</(div|p|li|tr|h[1-6])>", "\n")
    out = F.regexp_replace(out, r"(?i)<td[^>]*>", " | ")
    out = decode_entities(F.regexp_replace(out, r"<[^>]+>", ""))
    out = F.regexp_replace(F.regexp_replace(out, "\r\n?", "\n"), "\u00a0", " ")
    out = F.regexp_replace(F.regexp_replace(out, "[ \t\f\x0b]+", " "), " *\n *", "\n")
    return F.regexp_replace(F.regexp_replace(out, "\n{3,}", "\n\n"), r"^[ \n]+|[ \n]+$", "")


def html_title(html) -> Column:
    return F.trim(decode_entities(F.regexp_extract(col(html), r"(?is)<title[^>]*>(.*?)</title>", 1)))


def concept_key(c) -> Column:
    """A key under which forms of a word agree: folded, without a plural's ending."""
    t = F.regexp_replace(search_text(c), r"[.\-]", " ")
    t = F.regexp_replace(t, r"([a-z]{2,})ies\b", "$1y")
    t = F.regexp_replace(t, r"([a-z]{2,}(?:s|x|z|ch|sh))es\b", "$1")
    return F.trim(F.regexp_replace(F.regexp_replace(t, r"([a-z]{2,}[^s ])s\b", "$1"), " +", " "))


def pair_token(c, sep: str = "-") -> tuple[Column, Column]:
    """The two ends of ``A-B``; null unless there are just two, neither empty."""
    parts = F.split(F.trim(col(c)), f"\\Q{sep}\\E", -1)
    good = (F.size(parts) == 2) & (F.trim(F.get(parts, F.lit(0))) != "") & (F.trim(F.get(parts, F.lit(1))) != "")
    return F.when(good, F.trim(F.get(parts, F.lit(0)))), F.when(good, F.trim(F.get(parts, F.lit(1))))


def rewritten_id(c, prefix: tuple[str, str] | None = None, suffix: tuple[str, str] | None = None, add: int = 0) -> Column:
    """An identifier with a prefix and a suffix exchanged where it has them, and a number added to it if it is a whole number."""
    out = col(c).cast("string")
    if prefix:
        out = F.when(out.startswith(prefix[0]), F.concat(F.lit(prefix[1]), F.substring(out, F.lit(len(prefix[0]) + 1), F.length(out)))).otherwise(out)
    if suffix:
        out = F.when(out.endswith(suffix[0]), F.concat(F.substring(out, F.lit(1), F.length(out) - len(suffix[0])), F.lit(suffix[1]))).otherwise(out)
    return F.when(out.rlike("^[0-9]+$"), (out.cast("decimal(38,0)") + add).cast("string")).otherwise(out) if add else out
