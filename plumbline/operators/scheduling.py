"""Review scheduling over an event log: phases, due dates, memory states, queues.

A unit's log is an ordered fold: rows are dealt out by unit, sorted by time, and a task holds one unit's state at a time, so a log
may be of any length.
"""

from __future__ import annotations

import math
from datetime import timedelta

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from plumbline.operators.ordered import ordered_fold

#: Days until the next review after each rating.
INTERVALS = {"again": 0, "hard": 1, "good": 3, "easy": 7}
GOOD = ("good", "easy")
#: Different days with a success that a phase takes, and successes of the last but one.
GUIDED_DAYS, FREE_DAYS, APPLICATIONS = 2, 2, 1


def interval_days(rating: Column) -> Column:
    return F.create_map(*(F.lit(x) for kv in INTERVALS.items() for x in kv))[rating]


def next_phase(state: tuple, day, rating: str | None) -> tuple:
    """(phase, successes counted in it, the last day counted) after a reading (no rating) or an attempt. A success counts in
    the recall phases once a day, and in ``application`` each time; with enough of them the next phase begins."""
    phase, n, last = state
    if rating is None:
        return ("guided-recall", 0, None) if phase == "unread" else state
    if rating not in GOOD or phase in ("unread", "maintenance"):
        return state
    if phase == "application":
        return ("maintenance", 0, None) if n + 1 >= APPLICATIONS else (phase, n + 1, day)
    if day == last:
        return state
    need, after = (GUIDED_DAYS, "free-recall") if phase == "guided-recall" else (FREE_DAYS, "application")
    return (after, 0, None) if n + 1 >= need else (phase, n + 1, day)


def unit_phases(log: DataFrame, unit: str, at: str, rating: str, tie: str) -> DataFrame:
    """(unit, phase, attempts, due_at) of every unit from its log in order of time: ``unread`` until a reading (a row without a rating),
    then guided recall, free recall, application and maintenance. An attempt is due again after its rating's days, a reading at
    once. Rows without a time don't count."""

    def step(state, row):
        when, kind = row
        phase, attempts, _ = state
        due = when + timedelta(days=INTERVALS.get(kind, 0)) if kind is not None else when
        return next_phase(phase, when.date(), kind), attempts + (kind is not None), due

    kind = log.schema[unit].dataType.simpleString()
    rows = log.filter(F.col(at).isNotNull()).withColumn(at, F.col(at).cast("timestamp_ntz"))
    return ordered_fold(
        rows, [unit], [F.col(at), F.col(tie)], [at, rating], lambda: (("unread", 0, None), 0, None), step, lambda s: (s[0][0], s[1], s[2]), f"{unit} {kind}, phase string, attempts long, due_at timestamp_ntz"
    )


#: Default weights of the free spaced repetition scheduler, version 5, its decay, and the bounds of its results.
FSRS = (0.40255, 1.18385, 3.173, 15.69105, 7.1949, 0.5345, 1.4604, 0.0046, 1.54575, 0.1192, 1.01925, 1.9395, 0.11, 0.29605, 2.2698, 0.2315, 2.9898, 0.51655, 0.6621)
DECAY, RETENTION = -0.5, 0.9
FACTOR = RETENTION ** (1 / DECAY) - 1
GRADES = {"again": 1, "hard": 2, "good": 3, "easy": 4}
LEAST_STABILITY, MOST_DAYS = 0.01, 36_500


def retrievability(days: float, stability: float) -> float:
    """How likely it is to be known ``days`` after the last review: 0.9 after ``stability`` days."""
    return (1 + FACTOR * days / stability) ** DECAY


def _first_difficulty(grade: int) -> float:
    return FSRS[4] - math.exp(FSRS[5] * (grade - 1)) + 1


def memory_after(stability: float | None, difficulty: float | None, days: float, grade: int) -> tuple[float, float]:
    """(stability, difficulty) after a review of a grade, ``days`` after the one before (None: the first)."""
    w = FSRS
    if stability is None:
        return max(w[grade - 1], LEAST_STABILITY), min(10.0, max(1.0, _first_difficulty(grade)))
    harder = difficulty - w[6] * (grade - 3) * (10 - difficulty) / 9
    d = min(10.0, max(1.0, w[7] * _first_difficulty(4) + (1 - w[7]) * harder))
    if days < 1:
        s = stability * math.exp(w[17] * (grade - 3 + w[18]))
    elif grade == 1:
        r = retrievability(days, stability)
        s = min(stability, w[11] * difficulty ** -w[12] * ((stability + 1) ** w[13] - 1) * math.exp(w[14] * (1 - r)))
    else:
        r = retrievability(days, stability)
        gain = math.exp(w[8]) * (11 - difficulty) * stability ** -w[9] * (math.exp(w[10] * (1 - r)) - 1)
        s = stability * (1 + gain * (w[15] if grade == 2 else w[16] if grade == 4 else 1))
    return max(s, LEAST_STABILITY), d


def interval_of(stability: float) -> int:
    """Days after which the retention wanted is reached."""
    return min(MOST_DAYS, max(1, round(stability / FACTOR * (RETENTION ** (1 / DECAY) - 1))))


def memory_states(log: DataFrame, unit: str, at: str, rating: str, tie: str) -> DataFrame:
    """(unit, reps, lapses, stability, difficulty, due_at) of every unit by the free spaced repetition scheduler without learning steps.
    Days between reviews are those of the calendar. Rows without a time or with another rating don't count."""

    def step(state, row):
        when, kind = row
        s, d, last, reps, lapses = state
        days = 0 if last is None else (when.date() - last.date()).days
        grade = GRADES[kind]
        s, d = memory_after(s, d, days, grade)
        return s, d, when, reps + 1, lapses + (grade == 1 and reps > 0)

    def finish(state):
        s, d, last, reps, lapses = state
        return reps, lapses, s, d, last + timedelta(days=interval_of(s))

    kind = log.schema[unit].dataType.simpleString()
    rows = log.filter(F.col(at).isNotNull() & F.col(rating).isin(*GRADES)).withColumn(at, F.col(at).cast("timestamp_ntz"))
    return ordered_fold(
        rows, [unit], [F.col(at), F.col(tie)], [at, rating], lambda: (None, None, None, 0, 0), step, finish, f"{unit} {kind}, reps long, lapses long, stability double, difficulty double, due_at timestamp_ntz"
    )


def latest_attempts(attempts: DataFrame, unit: str, at: str, tie: str) -> DataFrame:
    """The last attempt of each unit, the one that an undo takes back."""
    w = Window.partitionBy(unit).orderBy(F.col(at).desc_nulls_last(), F.col(tie).desc())
    return attempts.withColumn("__n", F.row_number().over(w)).filter("__n = 1").drop("__n")


def without_last(attempts: DataFrame, unit: str, at: str, tie: str) -> DataFrame:
    """What is left of a log when each unit's last attempt is taken back. Ties need only tell the attempts of one unit apart."""
    w = Window.partitionBy(unit).orderBy(F.col(at).desc_nulls_last(), F.col(tie).desc())
    return attempts.withColumn("__n", F.row_number().over(w)).filter("__n > 1").drop("__n")


def due_classes(units: DataFrame, now: Column, soon_days: int = 7) -> DataFrame:
    """``units`` (needs_review, phase, due_at) with a class: source-review, new, overdue (by more than a day), due, soon or later."""
    due = F.col("due_at")
    kind = (
        F.when(F.coalesce("needs_review", F.lit(False)), "source-review")
        .when((F.col("phase") == "unread") | due.isNull(), "new")
        .when(due < now - F.expr("INTERVAL 1 DAY"), "overdue")
        .when(due <= now, "due")
        .when(due <= now + F.make_dt_interval(F.lit(soon_days)), "soon")
        .otherwise("later")
    )
    return units.withColumn("class", kind)


def next_review(units: DataFrame, now: Column) -> DataFrame:
    """The unit that comes due first after ``now``: by time, title, unit_id. Unread units and those under review don't count."""
    rows = units.filter((F.col("due_at") > now) & (F.col("phase") != "unread") & ~F.coalesce("needs_review", F.lit(False)))
    return rows.orderBy("due_at", "title", "unit_id").limit(1)


def least_recent(units: DataFrame, attempts: DataFrame, unit: str, at: str, k: int) -> DataFrame:
    """k units for a surprise: never attempted ones first, then those whose last attempt is longest ago; ties by hash (MD5) of the unit."""
    last = attempts.groupBy(F.col(unit).alias("__u")).agg(F.max(at).alias("last_at"))
    rows = units.select(unit).join(last, F.col(unit) == F.col("__u"), "left").drop("__u")
    return rows.orderBy(F.col("last_at").asc_nulls_first(), F.md5(F.col(unit).cast("string").cast("binary")), unit).limit(k)


def session_summary(attempts: DataFrame, by: str, rating: str) -> DataFrame:
    """(by, reviewed, and the count of each rating)."""
    return attempts.groupBy(by).agg(F.count(F.lit(1)).alias("reviewed"), *(F.count_if(F.col(rating) == r).alias(r) for r in INTERVALS))
