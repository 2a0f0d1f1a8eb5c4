"""Personal data in texts.

Method: anchor expansion. One Aho-Corasick pass finds anchors (at-signs, plus signs, digits,
``://`` and identifier cues such as ``token``); from each anchor a deterministic local parser
expands to the boundaries of the candidate and validates it. Every parser reads only the
neighbourhood of its anchor, so a text costs one pass whatever its length.

Base kinds, leftmost and non-overlapping within a kind, where a candidate that fails its check is
dropped without another try inside it:

* email: local part, at-sign, a name of two labels or more;
* ip: four dotted numbers of at most 255;
* card: digits with single spaces or hyphens between them, 16 to 19 of them, passing Luhn;
* phone: a plus sign, then digits with spaces, brackets, dots and hyphens, 8 to 15 digits.

Kinds that the method adds, which never remove a base span:

* url: a scheme from ``SCHEMES`` at ``://`` with a host, up to white space, quotes or brackets;
* account: a cue from ``CUES``, then ``=`` or ``:``, then a value of at least 8 letters, digits,
  ``_`` or ``-`` with a digit among them; the span is the value. Or an IBAN with right check digits.

Defined cases: a null text is the empty text and has no spans. Positions count code points, ends
are exclusive. Repeated rows stay separate rows. Other columns are not read.
"""

from __future__ import annotations

import hashlib
from functools import lru_cache

import ahocorasick
from pyspark.sql import DataFrame, SparkSession

from plumbline.llm.common import append_columns, id_and_text, sift_rows, table

BASE_KINDS = ("email", "ip", "card", "phone")
KINDS = (*BASE_KINDS, "url", "account")
SCHEMES = ("https", "http", "ftp", "ftps", "sftp", "ws", "wss", "ssh", "git", "file")
CUES = ("token", "password", "passwd", "secret", "api_key", "api-key", "apikey", "access_key", "account", "iban")

_DIGITS = frozenset("0123456789")
_LETTERS = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz")
_ALNUM = _DIGITS | _LETTERS
_LOCAL = _ALNUM | frozenset("._%+-")
_LABEL = _ALNUM | frozenset("-")
_PHONE = _DIGITS | frozenset(" ().-")
_VALUE = _ALNUM | frozenset("_-")
_URL_END = frozenset(" \t\n\r\x0b\x0c<>\"'`|{}[]()")


#: Letters of the longest scheme, and characters of the longest IBAN.
_LONGEST_SCHEME = max(map(len, SCHEMES))
_LONGEST_IBAN = 34


def _run(text: str, i: int, chars: frozenset, most: int | None = None) -> int:
    """End of the run of ``chars`` from i, after ``most`` of them at the latest."""
    n = len(text) if most is None else min(len(text), i + most)
    while i < n and text[i] in chars:
        i += 1
    return i


def luhn(digits: str) -> bool:
    total = 0
    for k, d in enumerate(reversed(digits)):
        v = ord(d) - 48
        if k % 2:
            v = v * 2 - 9 if v > 4 else v * 2
        total += v
    return total % 10 == 0


def parse_email(text: str, at: int, floor: int):
    """(end of what is used up, span or None) for the at-sign at ``at``; nothing before ``floor`` is free."""
    start = at
    while start > floor and text[start - 1] in _LOCAL:
        start -= 1
    end = _run(text, at + 1, _LABEL)
    if start == at or end == at + 1:
        return floor, None
    dots = 0
    while end < len(text) and text[end] == "." and (more := _run(text, end + 1, _LABEL)) > end + 1:
        end, dots = more, dots + 1
    return (end, (start, end)) if dots else (floor, None)


def parse_ip(text: str, start: int, _floor: int):
    end, parts = _run(text, start, _DIGITS), 1
    parts_at = [(start, end)]
    while parts < 4 and end < len(text) and text[end] == "." and (more := _run(text, end + 1, _DIGITS)) > end + 1:
        parts_at.append((end + 1, more))
        end, parts = more, parts + 1
    if parts < 4:
        return parts_at[0][1], None  # a later number may start one
    small = all(len(p := text[a:b].lstrip("0")) <= 3 and int(p or "0") <= 255 for a, b in parts_at)
    return end, (start, end) if small else None


def parse_card(text: str, start: int, _floor: int):
    end, n = start + 1, len(text)
    digits = [text[start]]
    while end < n:
        if text[end] in _DIGITS:
            digits.append(text[end])
            end += 1
        elif text[end] in " -" and end + 1 < n and text[end + 1] in _DIGITS:
            digits.append(text[end + 1])
            end += 2
        else:
            break
    good = 16 <= len(digits) <= 19 and luhn("".join(digits))
    return end, (start, end) if good else None


def parse_phone(text: str, plus: int, _floor: int):
    if plus + 1 >= len(text) or text[plus + 1] not in _DIGITS:
        return plus + 1, None
    end = _run(text, plus + 2, _PHONE)
    while end > plus + 3 and text[end - 1] not in _DIGITS:
        end -= 1
    if end <= plus + 3:
        return plus + 1, None
    n = sum(c in _DIGITS for c in text[plus:end])
    return end, (plus, end) if 8 <= n <= 15 else None


def parse_url(text: str, colon: int, floor: int):
    start = colon
    while start > floor and colon - start <= _LONGEST_SCHEME and text[start - 1] in _LETTERS:
        start -= 1
    # What is no scheme before a host is not read on: texts may hold very many of them.
    if text[start:colon].lower() not in SCHEMES or text[colon + 3 : colon + 4] not in _ALNUM:
        return floor, None
    end = colon + 4
    while end < len(text) and text[end] not in _URL_END:
        end += 1
    while text[end - 1] in ".,;:!?":
        end -= 1
    return end, (start, end)


def iban_ok(value: str) -> bool:
    if not 15 <= len(value) <= 34 or not value[:2].isupper() or not value[2:4].isdigit():
        return False
    rest = 0
    for c in value[4:] + value[:4]:
        v = int(c, 36)
        rest = (rest * (100 if v > 9 else 10) + v) % 97
    return rest == 1


def parse_account(text: str, after_cue: int, floor: int):
    i = _run(text, after_cue, frozenset(" \t"))
    if i >= len(text) or text[i] not in "=:":
        return floor, None
    i = _run(text, _run(text, i + 1, frozenset(" \t")), frozenset("\"'"))
    end = _run(text, i, _VALUE)
    if i < floor or end - i < 8 or not any(c in _DIGITS for c in text[i:end]):
        return floor, None
    return end, (i, end)


def parse_iban(text: str, digit: int, floor: int):
    """From the first digit of a word: two capitals stand before it, the groups of four may be spaced."""
    start = digit - 2
    if start < floor or not (text[start:digit].isascii() and text[start:digit].isupper()) or (start and text[start - 1] in _ALNUM):
        return floor, None
    # Groups are read on until they are too long for an IBAN, so there are few ends to try.
    end = _run(text, digit, _ALNUM, _LONGEST_IBAN)
    ends, size = [end], end - start
    while size <= _LONGEST_IBAN and end + 1 < len(text) and text[end] == " " and 1 <= (more := _run(text, end + 1, _ALNUM, 5)) - end - 1 <= 4 and text[end + 1 : more].upper() == text[end + 1 : more]:
        size += more - end - 1
        end = more
        ends.append(end)
    for end in reversed(ends):
        value = text[start:end].replace(" ", "")
        if value.isascii() and iban_ok(value):
            return end, (start, end)
    return floor, None


@lru_cache(1)
def anchors() -> ahocorasick.Automaton:
    out = ahocorasick.Automaton()
    for c in "0123456789":
        out.add_word(c, ("digit", 1))
    out.add_word("@", ("at", 1))
    out.add_word("+", ("plus", 1))
    out.add_word("://", ("scheme", 3))
    for cue in CUES:
        for form in {cue, cue.upper(), cue.capitalize()}:
            out.add_word(form, ("cue", len(form)))
    out.make_automaton()
    return out


def find_spans(text: str | None) -> list[tuple[str, int, int]]:
    """(kind, start, end) of all spans, by kind in the order of ``KINDS``, then by start."""
    if not text:
        return []
    found: dict[str, list[tuple[int, int]]] = {k: [] for k in KINDS}
    used = dict.fromkeys(KINDS, 0)

    def expand(kind, parse, at):
        used[kind], span = parse(text, at, used[kind])
        if span:
            found[kind].append(span)

    for last, (anchor, size) in anchors().iter(text):
        if anchor == "digit":
            if last >= used["card"]:
                expand("card", parse_card, last)
            if last >= used["ip"]:
                expand("ip", parse_ip, last)
            if last and text[last - 1] in _LETTERS:
                expand("account", parse_iban, last)
        elif anchor == "at":
            expand("email", parse_email, last)
        elif anchor == "plus":
            if last >= used["phone"]:
                expand("phone", parse_phone, last)
        elif anchor == "scheme":
            expand("url", parse_url, last - size + 1)
        else:
            expand("account", parse_account, last + 1)
    return [(kind, a, b) for kind in KINDS for a, b in sorted(found[kind])]


def redact(text: str | None, spans=None) -> str | None:
    """``text`` with each span replaced by its kind in angle brackets; overlapping spans become one."""
    if not text:
        return text
    out, at = [], 0
    for kind, start, end in sorted(find_spans(text) if spans is None else spans, key=lambda s: (s[1], -s[2])):
        if start >= at:
            out += [text[at:start], f"<{kind}>"]
        at = max(at, end)
    return "".join([*out, text[at:]])


def joined(spans) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b in spans)


def detect(docs: DataFrame, id_col="doc_id", text_col="text") -> DataFrame:
    """doc_id, the count of each kind (n_email, ..., n_account), base_sha256, spans and has_pii (any span) of every row."""

    def make():
        def fn(texts):
            cols: list[list] = [[] for _ in range(len(KINDS) + 3)]
            for text in texts:
                spans = find_spans(text)
                for col, kind in zip(cols, KINDS):
                    col.append(sum(s[0] == kind for s in spans))
                base = joined(s for s in spans if s[0] in BASE_KINDS)
                cols[-3].append(hashlib.sha256(base.encode()).hexdigest())
                cols[-2].append(joined(spans))
                cols[-1].append(bool(spans))
            return cols

        return fn

    fields = [*((f"n_{k}", "long") for k in KINDS), ("base_sha256", "string"), ("spans", "string"), ("has_pii", "boolean")]
    return append_columns(id_and_text(docs, id_col, text_col), "text", make, fields, drop=["text"])


def redact_documents(docs: DataFrame, text_col="text", out_col="redacted_text", drop=()) -> DataFrame:
    """``docs`` with the redacted text in ``out_col``; null stays null."""
    return append_columns(docs, text_col, lambda: lambda texts: [[redact(t) for t in texts]], [(out_col, "string")], drop)


def redacted(docs: DataFrame, text_col="text") -> DataFrame:
    """``docs`` with the redacted text in place of the text."""
    return sift_rows(docs, lambda: lambda texts: (None, [redact(t) for t in texts]), text_col)


def op1_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return detect(table(spark, sf_dir, "documents"))
