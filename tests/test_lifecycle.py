"""The fold of decisions against a plain loop, and status over all dates against repeated saves."""

import datetime as dt
import random

import pytest

from adsight.operators import experiments as E
from adsight.operators import report as R
from conftest import day

EVENTS = "id bigint, opportunity_id bigint, created_on date, kind string, reason string"
START = day("2024-01-01")


def plain(events, days):
    """One event after the other, per opportunity."""
    out, state = [], {}
    for number, owner, made, kind, reason in sorted(events, key=lambda e: (e[1], e[2], e[0])):
        status, live, started = state.get(owner, ("none", None, None))
        if status == "running" and started + dt.timedelta(days) <= made:
            status, live, started = "none", None, None
        fits = {"draft": status == "none", "dismiss": True}.get(kind, status == "draft")
        told = status
        if fits and kind == "draft":
            status, live, started, told = "draft", number, None, "draft"
        elif fits and kind == "approve":
            status, started, told = "running", made, "running"
        elif fits and kind == "reject":
            status, told = "none", "rejected"
        met = kind != "dismiss" and told != "none"
        running = met and told == "running"
        out.append((number, owner, made, kind, reason, fits, live if met else None,
                    told if met else None, started if running else None,
                    started + dt.timedelta(days) if running else None))
        state[owner] = (status, live, started)
    return out


def rows(frame):
    return sorted(map(tuple, frame.collect()), key=lambda r: (r[1], r[2], r[0]))


@pytest.mark.parametrize("days,span,owners", [(7, 60, 12), (1, 12, 5), (3, 4, 3), (30, 400, 2)])
def test_fold_equals_one_step_at_a_time(spark, days, span, owners):
    pick = random.Random(days)
    numbers = random.Random(1).sample(range(10_000), 700)
    events = [(n, pick.randrange(owners), START + dt.timedelta(pick.randrange(span)),
               pick.choice(("draft", "approve", "reject", "dismiss", "draft", "approve")),
               pick.choice((None, "why"))) for n in numbers]
    steps = E.fold_decisions(spark.createDataFrame(events, EVENTS), days)
    assert rows(steps) == plain(events, days)


def test_one_experiment_through_its_life(spark):
    log = [("draft", 0), ("draft", 0), ("approve", 1), ("approve", 1), ("reject", 3), ("draft", 5),
           ("dismiss", 6), ("draft", 8), ("reject", 8), ("reject", 9)]
    events = [(i, 5, START + dt.timedelta(d), kind, f"r{i}") for i, (kind, d) in enumerate(log)]
    steps = E.fold_decisions(spark.createDataFrame(events, EVENTS)).cache()
    assert [r["accepted"] for r in sorted(steps.collect(), key=lambda r: r["id"])] == [
        True, False, True, False, False, False, True, True, True, False]
    made = {r["id"]: r for r in E.experiments_after(steps, day("2024-01-08")).collect()}
    assert set(made) == {0, 7}
    assert (made[0]["status"], made[0]["started_on"], made[0]["ends_on"], made[0]["reason"]) == (
        "running", day("2024-01-02"), day("2024-01-09"), "r2")
    assert (made[7]["status"], made[7]["reason"]) == ("rejected", "r8")
    later = {r["id"]: r["status"] for r in E.experiments_after(steps, day("2024-01-09")).collect()}
    assert later == {0: "completed", 7: "rejected"}
    log_rows = E.decision_log(steps, spark.createDataFrame([(5, 9.5)], "id bigint, impact double"))
    assert sorted((r["id"], r["kind"], r["experiment_id"], r["impact"]) for r in log_rows.collect()) == [
        (2, "approve", 0, 9.5), (6, "dismiss", None, 9.5), (8, "reject", 7, 9.5)]
    # Set aside while the change ran, then measured when it was complete.
    state = lambda at: E.opportunity_states(steps, day(at)).first()
    assert tuple(state("2024-01-08")) == (5, "dismissed", "r6")
    assert tuple(state("2024-01-09")) == (5, "measured", None)


def test_no_events(spark):
    steps = E.fold_decisions(spark.createDataFrame([], EVENTS))
    assert steps.count() == 0 and E.opportunity_states(steps, START).count() == 0


def test_status_of_every_date_equals_repeated_saves(spark):
    pick = random.Random(5)
    runs = sorted(START + dt.timedelta(d) for d in pick.sample(range(120), 40))
    seen = "key string, as_of date, window_start date, last_seen_date date, score double"
    found = [(f"k{k}", d, d - dt.timedelta(6), d, pick.random()) for k in range(6) for d in runs
             if pick.random() < (0.1, 0.3, 0.5, 0.7, 0.9, 1.0)[k]]
    carried = R.carry_status(spark.createDataFrame(found, seen),
                             spark.createDataFrame([(d,) for d in runs], "as_of date")).cache()
    stored = {}
    for date in runs:
        now = {f[0]: f for f in found if f[1] == date}
        for key, (_, _, start, last, score) in now.items():
            old = stored.get(key)
            first = start if old is None or (start - old[2]).days > 7 else min(old[1], start)
            stored[key] = ("open", first, last, score)
        for key in set(stored) - set(now):
            stored[key] = ("resolved", *stored[key][1:])
        got = {r["key"]: tuple(r)[1:] for r in R.stored_at(carried, date).collect()}
        assert got == stored
    # One step of the stored table is the same.
    half = spark.createDataFrame([f for f in found if f[1] == runs[20]], seen)
    before = R.stored_at(carried, runs[19])
    after = {r["key"]: tuple(r)[1:] for r in R.save_opportunities(before, half.drop("as_of")).collect()}
    assert after == {r["key"]: tuple(r)[1:] for r in R.stored_at(carried, runs[20]).collect()}
    again = {(r["key"], r["as_of"]): r["reopened"] for r in carried.collect()}
    for key, date, *_ in found:
        earlier = [f[1] for f in found if f[0] == key and f[1] < date]
        assert again[key, date] == bool(earlier and max(earlier) < runs[runs.index(date) - 1])
