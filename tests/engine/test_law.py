"""Parts of legal texts against a walk over lines."""

import random
import re

from plumbline.functions import law


def kind(line):
    t = line.strip()
    plain = lambda p: p.removeprefix("(?i)")
    if not t:
        return "blank"
    if re.search(plain(law.CONSOLIDATION), t, re.I):
        return "consolidation"
    if any(re.search(plain(p), t, re.I) for p in law.HISTORY):
        return "history"
    return "heading" if t in law.HEADINGS else "text"


def walk(text):
    lines = text.replace("\r\n", "\n").replace("\r", "\n").split("\n")
    notes, history, headings, start, end = [], [], [], 0, len(lines)
    while start < end and kind(lines[start]) in ("blank", "consolidation"):
        notes += [lines[start].strip()] if lines[start].strip() else []
        start += 1
    while end > start:
        c = kind(lines[end - 1])
        if c == "blank":
            pass
        elif c == "heading" and end - 1 > start:
            headings.insert(0, lines[end - 1].strip())
        elif c == "history":
            history.insert(0, lines[end - 1].strip())
        else:
            break
        end -= 1
    body, later = [], []
    for line in lines[start:end]:
        c = kind(line)
        if c == "consolidation":
            notes.append(line.strip())
        elif c == "history":
            later.append(line.strip())
        else:
            body.append(line)
    notes += [x.strip() for x in lines[end:] if kind(x) == "consolidation"]
    return body, history + later, notes, headings


def test_parts(spark):
    r = random.Random(7)
    pool = ["1 A person shall not.", "(a) text, and", "", "  ", "N.B. This Act is consolidated to June 1, 2020.", "R.S. 1973, c. A-1", "2001, c.5, s.3", "1999, c.28; 2000, c.1", "84-12; 86-3", "GENERAL", "DEFINITIONS", "REPEAL", "It is text.", "2019 (Supp.), c. 4"]
    texts = ["\n".join(r.choice(pool) for _ in range(r.randint(1, 9))) for _ in range(400)] + ["GENERAL", "GENERAL\nREPEAL", "R.S. 1973, c.1", "", "a\r\nb\r\r\nGENERAL"]
    df = spark.createDataFrame(list(enumerate(texts)), "k int, t string").select("k", law.prepared("t").alias("p")).select("k", "p.*")
    none = lambda x: "\n".join(x) or None
    for row in df.collect():
        body, history, notes, headings = walk(texts[row["k"]])
        assert (row["history"], row["consolidation"], row["headings"]) == (none(history), none(notes), none(headings)), texts[row["k"]]
        want = re.sub(r"[ \t]+\n", "\n", "\n".join(body))
        assert row["operative"] == re.sub(r"\n{3,}", "\n\n", want).strip(), texts[row["k"]]


def test_history_behind_the_last_line(spark):
    texts = [(1, "5 The owner shall keep it. 2001, c.5, s.3; 2004, c.12"), (2, "6 In 1999 nothing."), (3, "7 It is so. O.C. 73-1"), (4, None), (5, "Repeal it 5Repealed: 2004, c.12\n6 The next one")]
    got = {r["k"]: r["p"] for r in spark.createDataFrame(texts, "k int, t string").select("k", law.prepared("t").alias("p")).collect()}
    assert (got[1]["operative"], got[1]["history"]) == ("5 The owner shall keep it. 2001, c.5, s.3;", "2004, c.12")
    assert (got[2]["operative"], got[2]["history"]) == ("6 In 1999 nothing.", None) and got[4] is None
    assert got[3]["operative"] == "7 It is so." and got[3]["history"] == "O.C. 73-1" and got[5]["operative"] == "Repeal it Repealed.\n6 The next one"
