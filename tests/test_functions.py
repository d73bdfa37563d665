"""Hand-worked values of the Column functions."""

import datetime as dt
import math

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from adsight.functions import kpi as K
from adsight.functions import wording as WD
from adsight.operators import experiments as E
from adsight.operators import pacing as PC
from adsight.operators import recommend as R
from adsight.operators import report as RP
from adsight.operators import textcheck as TX
from adsight.sources import templates as TP


def one(spark, **columns):
    return spark.range(1).select(*[c.alias(n) for n, c in columns.items()]).first()


def test_kpis_of_sums(spark):
    frame = spark.createDataFrame(
        [(20000.0, 8000.0, 400.0, 12000.0, 20.0, 48000.0, 60000.0, 25.0)],
        "impressions double, reach double, clicks double, spend double, platform_conversions double,"
        "platform_revenue double, store_revenue double, store_orders double")
    row = frame.select(*[c.alias(n) for n, c in K.kpi_columns(frame.columns).items()]).first()
    expected = dict(ctr=.02, cpc=30, cpm=600, cvr=.05, cpa=600, roas=4, aov=2400, frequency=2.5,
                    mer=5, store_aov=2400)
    assert {k: row[k] for k in expected} == pytest.approx(expected)


def test_ratio_needs_both_sides(spark):
    row = one(spark, zero=K.ratio(F.lit(1), F.lit(0)), missing=K.ratio(F.lit(None), F.lit(1)))
    assert row["zero"] is None and row["missing"] is None


@pytest.mark.parametrize("before, after, change", [
    (100, 106, 6), (500, 428, -14.4), (0, 5, None), (None, 5, None), (-10, -5, 50)])
def test_change_pct(spark, before, after, change):
    as_double = lambda v: F.lit(v).cast("double")
    found = one(spark, c=K.change_pct(as_double(before), as_double(after)))["c"]
    assert found == (change if change is None else pytest.approx(change))


@pytest.mark.parametrize("actual, target, higher, status", [
    (105, 100, True, "ahead"), (95, 100, True, "on_track"), (94, 100, True, "behind"),
    (100, 94, False, "behind"), (0, 10, False, "ahead"), (None, 10, True, None)])
def test_goal_status(spark, actual, target, higher, status):
    found = one(spark, s=K.goal_status(F.lit(actual).cast("double"), F.lit(float(target)), higher))
    assert found["s"] == status


@pytest.mark.parametrize("budget, spent, day, status, projected, suggested", [
    (310000, 100000, "2026-10-10", "on_track", 310000, 10000),
    (800000, 442606, "2026-10-14", "over", None, None),
    (300000, 50000, "2026-09-15", "under", None, None),
    (100, 110, "2026-10-31", "on_track", 110, None),
    (100, 110.01, "2026-10-31", "over", None, None),
    (100, 90, "2026-10-31", "on_track", None, None),
    (100, 89.99, "2026-10-31", "under", None, None)])
def test_pacing(spark, budget, spent, day, status, projected, suggested):
    row = one(spark, **PC.pace(
        F.lit(float(budget)), F.lit(float(spent)), dt.date.fromisoformat(day)))
    assert row["status"] == status
    if projected is not None:
        assert row["projected"] == pytest.approx(projected)
    if suggested is not None:
        assert row["suggested_daily"] == pytest.approx(suggested)
    if day.endswith("31"):
        assert row["suggested_daily"] is None


def shares(spark, metric, before, after):
    names = sorted(before)
    frame = spark.createDataFrame(
        [tuple(float(v) for v in [*map(before.get, names), *map(after.get, names)])],
        ", ".join(f"{p}{n} double" for p in ("b_", "a_") for n in names))
    found = frame.select(K.driver_shares(
        metric, lambda m: F.col("b_" + m), lambda m: F.col("a_" + m)).alias("d")).first()["d"]
    return found and {d["driver"]: d["share_pct"] for d in found}


def measures(cpa, cpc, cvr=None):
    clicks = 10000.0
    conversions = clicks * (cvr if cvr is not None else cpc / cpa)
    return dict(impressions=1e6, clicks=clicks, spend=cpc * clicks,
                platform_conversions=conversions, platform_revenue=conversions * 1000)


def test_decompose_blames_the_driver(spark):
    found = shares(spark, "cpa", measures(420, 21), measures(610, 21.84))
    assert found["cvr"] > 85 and sum(found.values()) == pytest.approx(100)
    assert shares(spark, "cpa", measures(400, 20), measures(480, 16))["cpc"] < 0
    assert shares(spark, "cpa", measures(400, 20), measures(400, 20)) is None


@settings(max_examples=15, deadline=None)
@given(st.floats(1, 1e4), st.floats(1, 1e4), st.floats(0.5, 50), st.floats(0.5, 50))
def test_shares_sum_to_hundred(spark, before, after, cpc_before, cpc_after):
    found = shares(spark, "cpa", measures(before, cpc_before), measures(after, cpc_after))
    if found is not None and abs(math.log(after / before)) > 1e-3:
        assert sum(found.values()) == pytest.approx(100, abs=1e-6)


@pytest.mark.parametrize("first, last, start, expected", [
    ("2026-10-10", "2026-10-25", "2026-10-20", "2026-10-10"),
    ("2026-08-01", "2026-09-01", "2026-10-20", "2026-10-20")])
def test_first_seen(spark, first, last, start, expected):
    date = lambda t: F.lit(dt.date.fromisoformat(t))
    assert str(one(spark, d=RP.first_seen(date(start), date(first), date(last)))["d"]) == expected


def test_experiment_rules(spark):
    verdict = lambda b, a, d: one(spark, v=E.verdict(
        F.lit("cpa"), F.lit(b), F.lit(a), F.lit(d)))["v"]
    assert verdict(610.0, 420.0, 7) == "worked"
    assert verdict(420.0, 610.0, 7) == "did_not_work"
    assert verdict(610.0, 420.0, 4) == "inconclusive"
    assert verdict(600.0, 580.0, 7) == "inconclusive"
    window = one(spark, **E.measured_window(F.lit(dt.date(2026, 10, 1)), F.lit(7)))
    assert [str(v) for v in window] == ["2026-10-02", "2026-10-08", "2026-09-25", "2026-10-01"]


def test_confidence_is_bounded_and_monotone(spark):
    level = lambda change, n, share, trust: one(spark, c=R.confidence(
        F.lit(change), F.lit(n), F.lit(share), F.lit(trust)))["c"]
    assert level(500.0, 9, 100.0, "ok") == 1.0
    assert level(0.0, 1, 0.0, "broken") >= 0.1
    assert level(20.0, 1, 60.0, "ok") < level(40.0, 1, 60.0, "ok")
    assert level(20.0, 1, 60.0, "warning") < level(20.0, 1, 60.0, "ok")


def test_wording(spark):
    row = one(spark, cr=WD.rupees(F.lit(23_400_000.0)), lakh=WD.rupees(F.lit(164_000.0)),
              plain=WD.rupees(F.lit(612.4)), rate=WD.value_text(F.lit("ctr"), F.lit(0.0724)),
              times=WD.value_text(F.lit("roas"), F.lit(3.456)), fell=WD.moved(F.lit(-45.2)),
              title=WD.title(F.lit("Ad 1"), F.lit("cpa"), F.lit("issue")))
    assert list(row) == ["₹2.34 Cr", "₹1.64 L", "₹612", "7.24%", "3.46x", "fell 45%",
                         "Ad 1 costs more per sale"]


@pytest.mark.parametrize("kind, text, parsed", [
    ("iso_date", "2026-2-3", dt.date(2026, 2, 3)), ("iso_date", "2026-02-30", None),
    ("compact_date", "20261014", dt.date(2026, 10, 14)), ("compact_date", "2026101", None),
    ("count", "1,234", 1234), ("count", "1.5", None), ("count", "-1", None),
    ("count", "2147483648", None), ("amount", "-3", None), ("identifier", "1.2E+17", None),
    ("identifier", "120208412345678901", "120208412345678901"), ("text", "x" * 256, None)])
def test_cell_parsers(spark, kind, text, parsed):
    found = one(spark, v=TP.parse(kind, F.lit(text)))["v"]
    assert found == parsed


def test_numbers_in_text(spark):
    frame = spark.createDataFrame(
        [(1, "Spend ₹3.4 lakh rose 48% to 1,200 on v2.5 and chg|x|99, see chg|x|99 at 2x.")],
        "id int, text string")
    found = TX.numbers_in_text(frame, "id", "text", F.array(F.lit("chg|x|99")))
    assert sorted(r["value"] for r in found.collect()) == [2.0, 3.4, 48.0, 1200.0, 340000.0]


def test_ungrounded_matches_all_pairs(spark):
    import random

    rng = random.Random(7)
    numbers = [(i % 5, rng.uniform(0, 1000)) for i in range(300)]
    known = [(i % 5, rng.uniform(0, 1000)) for i in range(60)]
    close = lambda a, b: math.isclose(a, b, rel_tol=0.02, abs_tol=0.5)
    expected = sorted(
        (k, v) for k, v in numbers if not any(k == o and close(v, p) for o, p in known))
    frame = lambda rows: spark.createDataFrame(rows, "id int, value double")
    found = TX.ungrounded_numbers(frame(numbers), frame(known), "id")
    assert sorted((r["id"], r["value"]) for r in found.collect()) == expected
