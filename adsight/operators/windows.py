"""Detection windows for one as-of date or for every as-of date in a single pass.

Both forms return the same columns: the keys, ``as_of``, and per measure ``cur_`` (last 7 days),
``base_`` (28 days before) and ``w1_`` to ``w4_`` (the weeks of that baseline, oldest first).
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from adsight.functions import catalogue as C
from adsight.operators import metrics as M

REACH = C.WINDOW_DAYS + C.BASELINE_DAYS
# Window -> (first, last) day relative to the as-of date.
FRAMES = {
    "cur": (-6, 0), "w4": (-13, -7), "w3": (-20, -14), "w2": (-27, -21), "w1": (-34, -28),
}
WEEKS = ("w1", "w2", "w3", "w4")


def _baseline(measure: str) -> str:
    """Sum of the four weeks, null when none of them has the measure (SQL text)."""
    weeks = [f"{w}_{measure}" for w in WEEKS]
    total = " + ".join(f"coalesce({w}, 0)" for w in weeks)
    return f"if(coalesce({', '.join(weeks)}) is null, null, {total}) as base_{measure}"


def windows_at(
    daily: DataFrame, keys: list[str], measures: tuple[str, ...], as_of: dt.date
) -> DataFrame:
    """Windows of one as-of date: one aggregation over a date-pruned scan."""
    start = as_of - dt.timedelta(days=REACH - 1)
    day = f"datediff(date, date'{as_of}')"
    sums = [
        F.expr(f"sum(if({day} between {a} and {b}, {m}, null)) as {w}_{m}")
        for w, (a, b) in FRAMES.items() for m in measures
    ]
    return M.in_period(daily, start, as_of).groupBy(*keys).agg(*sums).selectExpr(
        "*", f"date'{as_of}' as as_of", *[_baseline(m) for m in measures])


def rolling_windows(
    daily: DataFrame, keys: list[str], measures: tuple[str, ...], start: dt.date, end: dt.date
) -> DataFrame:
    """Windows of every as-of date in a range.

    ``daily`` has one row per key and day. Each row also stands for the empty days up to the next
    one (34 at most, after which every window is empty), so the calendar is filled without a join
    and the whole operator needs a single shuffle by key.
    """
    inside = M.in_period(daily, start - dt.timedelta(days=REACH - 1), end)
    by_key = f"partition by {', '.join(keys)}"
    limit = f"least(date_add(date, {REACH - 1}), date'{end}')"
    until = (f"least({limit}, coalesce("
             f"date_sub(lead(date) over ({by_key} order by date), 1), {limit})) as until")
    filled = inside.selectExpr("*", until).selectExpr(
        *keys, "date", "explode(sequence(date, until)) as as_of", *measures
    ).selectExpr(*keys, "as_of", *[f"if(as_of = date, {m}, null) as {m}" for m in measures])
    frame = "sum({m}) over ({by} order by unix_date(as_of) range between {a} and {b}) as {w}_{m}"
    edge = lambda d: "current row" if d == 0 else f"{-d} preceding"
    summed = filled.selectExpr(*keys, "as_of", *[
        frame.format(m=m, by=by_key, a=edge(a), b=edge(b), w=w)
        for w, (a, b) in FRAMES.items() for m in measures])
    return summed.filter(f"as_of >= date'{start}'").selectExpr(
        "*", *[_baseline(m) for m in measures])


def detection_windows(
    daily: DataFrame, keys: list[str], measures: tuple[str, ...], start: dt.date, end: dt.date
) -> DataFrame:
    """The single-date form when the range is one day, else the rolling form."""
    if start == end:
        return windows_at(daily, keys, measures, end)
    return rolling_windows(daily, keys, measures, start, end)


def islands(frame: DataFrame, keys: list[str], day: str, max_gap: int) -> DataFrame:
    """Numbers the runs of days per key that are at most ``max_gap`` days apart (``island``)."""
    by_day = Window.partitionBy(*keys).orderBy(day)
    gap = F.datediff(F.col(day), F.lag(day).over(by_day))
    opens = F.when(gap <= max_gap, 0).otherwise(1)
    return frame.withColumn("opens", opens).withColumn(
        "island", F.sum("opens").over(by_day.rowsBetween(Window.unboundedPreceding, 0))
    ).drop("opens")
