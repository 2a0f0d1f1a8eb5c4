"""Balanced elements against a walk over tags, and snapping against all pairs."""

import math
import random
import re

from plumbline.operators import corpus, snaps


def walk(html, name):
    m = re.search(rf"<div\b[^>]*\bid=[\"']{name}[\"'][^>]*>", html, re.I)
    if not m:
        return None
    depth = 1
    for t in re.compile(r"</?div\b[^>]*>", re.I).finditer(html, m.end()):
        depth += -1 if t[0].startswith("</") else 1
        if not depth:
            return html[m.end() : t.start()]
    return html[m.end() :]


def test_elements(spark):
    r = random.Random(4)
    parts = ["<div>", "</div>", "<DIV class='a'>", "</Div >", "text", "<p>", "<divx>", "\U0001f600", "<div id='m'>", '<div class=x id="m">', "\n"]
    pages = [(i, "".join(r.choice(parts) for _ in range(r.randint(0, 25)))) for i in range(300)] + [(900, None), (901, "")]
    got = {x["k"]: x for x in corpus.elements(spark.createDataFrame(pages, "k int, h string"), "k", "h", ["n", "m"]).collect()}
    assert len(got) == len(pages)
    for k, html in pages:
        want = walk(html, "m") if html else None
        assert (got[k]["container"], got[k]["content"]) == (("m", want) if want is not None else (None, html)), (html, want)


def test_snapping(spark):
    r = random.Random(9)
    segments = [(i, *(float(r.randint(0, 60)) for _ in range(4))) for i in range(60)] + [(60, 3.0, 3.0, 3.0, 3.0), (61, 0.0, 0.0, 60.0, 60.0), (62, 10.0, 10.0, 30.0, 30.0), (63, None, 1.0, 1.0, 1.0)]
    cursors = [(i, r.uniform(0, 60), r.uniform(0, 60)) for i in range(80)] + [(80, None, 1.0)]
    tol = 2.5
    places = set()
    for i, ax, ay, bx, by in segments[:63]:
        places |= {("endpoint", i, ax, ay), ("endpoint", i, bx, by), ("midpoint", i, (ax + bx) / 2, (ay + by) / 2)}
        for j, cx, cy, dx, dy in segments[:63]:
            turn = (bx - ax) * (dy - cy) - (by - ay) * (dx - cx)
            if i < j and turn:
                t = ((cx - ax) * (dy - cy) - (cy - ay) * (dx - cx)) / turn
                u = ((cx - ax) * (by - ay) - (cy - ay) * (bx - ax)) / turn
                if 0 <= t <= 1 and 0 <= u <= 1 and not (t in (0, 1) and u in (0, 1)):
                    places.add(("intersection", i, ax + t * (bx - ax), ay + t * (by - ay)))
    want = {}
    for c, x, y in cursors[:80]:
        near = [p for p in places if math.hypot(p[2] - x, p[3] - y) <= tol]
        for i, ax, ay, bx, by in segments[:63]:
            d2 = (bx - ax) ** 2 + (by - ay) ** 2
            t = max(0.0, min(1.0, ((x - ax) * (bx - ax) + (y - ay) * (by - ay)) / d2)) if d2 else 0.0
            px, py = ax + t * (bx - ax), ay + t * (by - ay)
            if math.hypot(px - x, py - y) <= tol:
                near.append(("nearest", i, px, py))
        for kind, i, px, py in near:
            key = c, kind, round(px, 9) + 0.0, round(py, 9) + 0.0
            want[key] = min(want.get(key, i), i)
    df = snaps.snap_candidates(spark.createDataFrame(cursors, "cursor_id int, x double, y double"), spark.createDataFrame(segments, "seg_id int, ax double, ay double, bx double, by double"), tol)
    rows = df.collect()
    got = {(x["cursor_id"], x["kind"], round(x["x"], 9) + 0.0, round(x["y"], 9) + 0.0): x["seg_id"] for x in rows}
    assert got == want and len(rows) == len(want)
    by_cursor = {}
    for x in sorted(rows, key=lambda x: (x["cursor_id"], x["rank"])):
        by_cursor.setdefault(x["cursor_id"], []).append(round(x["dist"], 9))
    assert all(d == sorted(d) for d in by_cursor.values())
