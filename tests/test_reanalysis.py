"""Late facts: only the dates they reach run again, and the stored replay equals a full one."""

import datetime as dt

import pytest

from adsight.plans import sweep
from test_sweep import AD, STEADY, STORE, TIRED, WEB, ad

END = dt.date(2026, 10, 30)
DAYS = [END - dt.timedelta(days=i) for i in range(75)]


def frames(spark, changes=(), creatives=("42",)):
    """Facts of 75 steady days; a change is (first day, days, measures)."""
    def of(day):
        for first, n, measures in changes:
            if 0 <= (day - first).days < n:
                return measures
        return STEADY

    rows = [(*ad(d, of(d), part=1 / len(creatives))[:4], c, *ad(d, of(d), part=1 / len(creatives))[5:])
            for d in DAYS for c in creatives]
    return (spark.createDataFrame(rows, AD),
            spark.createDataFrame([(d, "google / cpc", "mobile", 900, 300, 90, 40, 30) for d in DAYS], WEB),
            spark.createDataFrame([(d, 60, 150000.0) for d in DAYS], STORE))


def shown(found):
    return sorted((r["as_of"], r["opportunity"], r["kind"], round(r["impact"], 6),
                   tuple(s["id"] for s in r["signals"])) for r in found.collect())


@pytest.fixture
def context(spark):
    return sweep.Context(spark.createDataFrame([], "channel_id string, budget double"))


def swept(monkeypatch):
    spans, analyse = [], sweep.analyse
    monkeypatch.setattr(sweep, "analyse", lambda *a: spans.append(a[4:6]) or analyse(*a))
    return spans


def test_late_facts(spark, context, monkeypatch, tmp_path):
    path, spans = str(tmp_path), swept(monkeypatch)
    day = lambda n: END - dt.timedelta(days=n)
    none = spark.createDataFrame([], "date date")
    sweep.refresh(spark, path, *frames(spark), context, none)
    assert spans == [(day(39), END)] and not sweep.stored_replay(spark, path).count()
    # A week turns out bad: the dates that saw it run again.
    bad = frames(spark, [(day(30), 7, TIRED)])
    changed = spark.createDataFrame([(day(30 - i),) for i in range(7)], "date date")
    sweep.refresh(spark, path, *bad, context, changed)
    assert spans[1] == (day(30), END)
    full = shown(sweep.replay(*bad, context))
    assert full and shown(sweep.stored_replay(spark, path)) == full
    # It is corrected, the last of its dates too: old findings go.
    sweep.refresh(spark, path, *frames(spark), context, changed)
    assert not sweep.stored_replay(spark, path).count()
    # Nothing changed: nothing runs.
    before = len(spans)
    sweep.refresh(spark, path, *frames(spark), context, none)
    assert len(spans) == before


def test_a_new_entity_runs_all_dates_again(spark, context, monkeypatch, tmp_path):
    path, spans = str(tmp_path), swept(monkeypatch)
    none = spark.createDataFrame([], "date date")
    sweep.refresh(spark, path, *frames(spark), context, none)
    more = frames(spark, [(END - dt.timedelta(days=6), 7, TIRED)], ("42", "43"))
    sweep.refresh(spark, path, *more, context, none)
    assert spans[0] == spans[1]
    assert shown(sweep.stored_replay(spark, path)) == shown(sweep.replay(*more, context))
