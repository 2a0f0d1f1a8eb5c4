"""Folds over logs against plain loops."""

import datetime as dt
import random

from plumbline.operators import ordered, scheduling

START = dt.datetime(2024, 1, 1)


def log(spark, seed=1):
    r = random.Random(seed)
    rows = []
    for unit in range(12):
        t = START
        for k in range(r.randint(0, 25)):
            t += dt.timedelta(hours=r.choice([0, 1, 20, 30, 100]))
            rows.append((unit, t, len(rows), r.choice(["again", "hard", "good", "easy", "good", None])))
    rows.append((0, None, 9999, "good"))
    return rows, spark.createDataFrame(rows, "unit int, at timestamp_ntz, n int, rating string")


def test_phases(spark):
    rows, df = log(spark)
    want = {}
    for unit in {r[0] for r in rows}:
        phase, days, count, tries, due = "unread", set(), 0, 0, None
        for _, at, _, rating in sorted((r for r in rows if r[0] == unit and r[1] is not None), key=lambda r: (r[1], r[2])):
            due = at + dt.timedelta(days=scheduling.INTERVALS.get(rating, 0))
            tries += rating is not None
            if rating is None:
                phase = "guided-recall" if phase == "unread" else phase
            elif rating in ("good", "easy"):
                if phase in ("guided-recall", "free-recall"):
                    days.add(at.date())
                    if len(days) >= 2:
                        phase, days = ("free-recall" if phase == "guided-recall" else "application"), set()
                elif phase == "application":
                    phase = "maintenance"
        if due:
            want[unit] = (phase, tries, due)
    got = {r["unit"]: (r["phase"], r["attempts"], r["due_at"]) for r in scheduling.unit_phases(df, "unit", "at", "rating", "n").collect()}
    assert got == want and len({v[0] for v in want.values()}) >= 3
    assert scheduling.unit_phases(df.limit(0), "unit", "at", "rating", "n").collect() == []


def test_memory(spark):
    rows, df = log(spark, 2)
    got = {r["unit"]: r for r in scheduling.memory_states(df, "unit", "at", "rating", "n").collect()}
    for unit, g in got.items():
        s = d = last = None
        reps = lapses = 0
        for _, at, _, rating in sorted((r for r in rows if r[0] == unit and r[1] is not None and r[3]), key=lambda r: (r[1], r[2])):
            days = 0 if last is None else (at.date() - last.date()).days
            s, d = scheduling.memory_after(s, d, days, scheduling.GRADES[rating])
            lapses += rating == "again" and reps > 0
            last, reps = at, reps + 1
        assert (g["reps"], g["lapses"], g["stability"], g["difficulty"]) == (reps, lapses, s, d)
        assert g["due_at"] == last + dt.timedelta(days=scheduling.interval_of(s))


def test_memory_laws():
    """What the published model says: 90 % after one stability, better grades last longer, forgetting shortens."""
    assert abs(scheduling.retrievability(5.0, 5.0) - 0.9) < 1e-12 and scheduling.interval_of(5.2) == 5
    first = [scheduling.memory_after(None, None, 0, g) for g in (1, 2, 3, 4)]
    assert [s for s, _ in first] == list(scheduling.FSRS[:4]) and all(a[1] > b[1] for a, b in zip(first, first[1:]))
    s, d = first[2]
    later = [scheduling.memory_after(s, d, 3.0, g)[0] for g in (1, 2, 3, 4)]
    assert later[0] < s < later[1] < later[2] < later[3]
    assert scheduling.memory_after(s, d, 30.0, 3)[0] > scheduling.memory_after(s, d, 3.0, 3)[0]


def test_scan_and_numbers(spark):
    df = spark.createDataFrame([(k % 3, k, 10 - k) for k in range(11)], "g int, k int, v int").repartition(4)
    rows = ordered.ordered_scan(df, ["g"], [df["k"]], ["k", "v"], lambda: 0, lambda s, r: (s + r[1], (r[0], s + r[1])), "g int, k int, total int").collect()
    for r in rows:
        assert r["total"] == sum(10 - k for k in range(11) if k % 3 == r["g"] and k <= r["k"])
    assert [r["rank"] for r in ordered.numbered(df, [df["k"].desc()]).orderBy("k").collect()] == list(range(11, 0, -1))
    assert ordered.numbered(df.limit(0), [df["k"]]).collect() == []


def test_undo_takes_one_attempt_of_each_unit(spark):
    at = lambda h: START + dt.timedelta(hours=h)
    rows = [("A", at(1), 1), ("A", at(2), 2), ("B", at(1), 2), ("B", at(3), 1), ("C", at(1), 2), ("C", at(1), 2), ("D", None, 1), ("D", at(0), 0)]
    df = spark.createDataFrame(rows, "unit string, at timestamp_ntz, tie int")
    left = sorted(map(tuple, scheduling.without_last(df, "unit", "at", "tie").collect()), key=repr)
    assert left == sorted([("A", at(1), 1), ("B", at(1), 2), ("C", at(1), 2), ("D", None, 1)], key=repr)
