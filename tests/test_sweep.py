"""Detection scenarios on 35 steady days with one change each."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from adsight.operators import group as G
from adsight.operators import metrics as M
from adsight.operators import trust as TR
from adsight.plans import sweep
from adsight.plans.stages import staged

END = dt.date(2026, 10, 30)
STEADY = dict(impressions=50000, clicks=1000, spend=20000.0, conversions=40.0, revenue=120000.0)
TIRED = dict(STEADY, clicks=500, conversions=20.0, revenue=60000.0)
AD = ("date date, channel_id string, campaign_id string, ad_set_id string, creative_id string,"
      "age_group string, impressions bigint, reach bigint, clicks bigint, spend double,"
      "platform_conversions double, platform_revenue double")
WEB = ("date date, source string, device string, sessions bigint, bounces bigint,"
       "add_to_cart bigint, checkout bigint, purchases bigint")
STORE = "date date, orders bigint, revenue double"
TRACK = "as_of date, channel_id string, status string, ratio_change double"


def ad(day, m, age="25-34", part=1.0):
    return (day, "meta_ads", "7", "31", "42", age, int(m["impressions"] * part), None,
            int(m["clicks"] * part), m["spend"] * part, m["conversions"] * part,
            m["revenue"] * part)


def days(n=35):
    return [END - dt.timedelta(days=i) for i in range(n)]


def last_week(day):
    return (END - day).days < 7


class Case:
    def __init__(self, spark, ads, web=(), store=(), tracking=()):
        self.spark = spark
        self.ads = spark.createDataFrame(ads, AD)
        self.web = spark.createDataFrame(list(web), WEB)
        self.store = spark.createDataFrame(list(store), STORE)
        self.tracking = spark.createDataFrame(list(tracking), TRACK)

    def analyse(self, budgets=(), settings=None, festive=(), start=END):
        from adsight.operators import detect as D

        budget = self.spark.createDataFrame(list(budgets), "channel_id string, budget double")
        raw = D.detect(self.ads, self.web, self.store, self.tracking, budget, settings, start, END)
        ranked = staged(G.rank_signals(raw, self.tracking, list(festive)), "signals")
        return G.group_opportunities(G.most_specific(ranked, G.child_counts(self.ads)))


def tired(spark, **kw):
    return Case(spark, [ad(d, TIRED if last_week(d) else STEADY) for d in days()], **kw)


def steady(spark, **kw):
    return Case(spark, [ad(d, STEADY) for d in days()], **kw)


def test_fatigue_is_one_creative(spark):
    found = tired(spark).analyse().collect()
    assert [r["opportunity"] for r in found] == ["creative:meta_ads/7/31/42"]
    row = found[0]
    assert row["primary"]["metric"] == "roas"
    assert {s["metric"] for s in row["signals"]} == {"roas", "cpa", "cpc", "ctr"}
    assert row["impact"] == pytest.approx(420000)
    assert row["kind"] == "issue"


def test_steady_is_silent(spark):
    assert steady(spark).analyse().count() == 0


def test_segment_divergence(spark):
    bad = dict(STEADY, conversions=20.0, revenue=60000.0)
    rows = [ad(d, m, age, 1 / 3) for d in days()
            for age, m in (("18-24", STEADY), ("25-34", STEADY), ("45-54", bad))]
    found = {r["opportunity"]: r["primary"]["detector"]
             for r in Case(spark, rows).analyse().collect()}
    assert found["age_group:meta_ads/7/31|45-54"] == "segment_divergence"


def test_overspend(spark):
    found = steady(spark).analyse([("meta_ads", 20000.0 * 31 / 2)]).collect()
    assert [(r["opportunity"], r["primary"]["metric"], r["primary"]["detector"])
            for r in found] == [("channel:meta_ads", "spend", "goal_breach")]
    assert steady(spark).analyse([("meta_ads", 20000.0 * 31)]).count() == 0


def test_broken_channel_holds_back_tracked_metrics(spark):
    case = tired(spark, tracking=[(END, "meta_ads", "broken", 0.2)])
    found = {r["opportunity"]: r for r in case.analyse().collect()}
    assert found["channel:meta_ads"]["primary"]["detector"] == "tracking_break"
    assert {s["metric"] for s in found["creative:meta_ads/7/31/42"]["signals"]} == {"cpc", "ctr"}


def test_same_ids_on_two_platforms_stay_apart(spark):
    """External ids are unique under their parent only."""
    rows = [ad(d, TIRED if last_week(d) else STEADY) for d in days()]
    twin = [(r[0], "google_ads", *r[2:]) for r in (ad(d, STEADY) for d in days())]
    case = Case(spark, rows + twin)
    found = case.analyse().collect()
    assert {r["channel_id"] for r in found if r["level"] == "creative"} == {"meta_ads"}
    assert "creative:meta_ads/7/31/42" in {r["opportunity"] for r in found}
    kids = dict(G.child_counts(case.ads).collect())
    assert kids["channel:google_ads"] == kids["campaign:meta_ads/7"] == 1
    assert kids["account:all"] == 2 and len(kids) == 7
    assert G.lineage(case.ads).count() == 8


def test_sale_window_is_quiet(spark):
    sale = [("sale", END - dt.timedelta(days=2), END)]
    assert tired(spark).analyse(festive=sale).count() == 0


def test_account_goal(spark):
    store = [(d, 100, 200000.0) for d in days()]
    found = steady(spark, store=store).analyse(settings=M.Settings(4.0)).collect()
    assert [(r["opportunity"], r["primary"]["metric"]) for r in found] == [("account:all", "mer")]


def test_funnel_drop(spark):
    web = [(d, s, "mobile", 1000, 400, 50 if s.startswith("face") and last_week(d) else 100, 40, 20)
           for d in days() for s in ("facebook / paid_social", "(direct) / (none)")]
    found = {r["opportunity"]: r for r in steady(spark, web=web).analyse().collect()}
    signals = {s["metric"]: s["detector"] for s in found["channel:meta_ads"]["signals"]}
    assert signals["atc_rate"] == "funnel_drop"


def test_replay_equals_single_date(spark):
    rows = [ad(d, TIRED if last_week(d) else STEADY) for d in days(50)]
    case = Case(spark, rows)
    many = case.analyse(start=END - dt.timedelta(days=5)).filter(F.col("as_of") == F.lit(END))
    pick = lambda f: sorted((r["opportunity"], r["score"]) for r in f.collect())
    assert pick(many) == pick(case.analyse())


def signal(spark, rows):
    """(entity id, ancestors, metric, adverse, score) as ranked signals."""
    data = [(END, f"{e}|{m}", "baseline_change", m, adverse, e, a, score)
            for e, a, m, adverse, score in rows]
    return spark.createDataFrame(
        data, "as_of date, id string, detector string, metric string, adverse boolean,"
              "entity_id string, ancestors array<string>, score double")


A, CH = "account:all", "channel:meta_ads"


def kept(spark, rows, children):
    frame = signal(spark, rows)
    counts = spark.createDataFrame(children, "entity_id string, children bigint")
    return sorted(r["id"] for r in G.most_specific(frame, counts).collect())


def test_parent_drops_out(spark):
    rows = [(CH, [A], "cpa", True, 9.0), ("campaign:1", [A, CH], "cpa", True, 8.0),
            (CH, [A], "cpm", True, 7.0), ("campaign:1", [A, CH], "cpc", True, 7.0),
            (CH, [A], "roas", True, 6.0), ("campaign:1", [A, CH], "roas", False, 6.0)]
    assert kept(spark, rows, [(CH, 5)]) == [
        "campaign:1|cpa", "campaign:1|cpc", "campaign:1|roas",
        "channel:meta_ads|cpm", "channel:meta_ads|roas"]


def test_broad_move_belongs_to_the_channel(spark):
    rows = [(CH, [A], "cpa", True, 9.0), ("campaign:1", [A, CH], "cpa", True, 8.0),
            ("campaign:2", [A, CH], "cpa", True, 8.0)]
    assert kept(spark, rows, [(CH, 2)]) == ["channel:meta_ads|cpa"]
    # Two of five campaigns are not half of the channel.
    assert kept(spark, rows, [(CH, 5)]) == ["campaign:1|cpa", "campaign:2|cpa"]
    # Without the channel's own signal there is nobody to hand the move to.
    assert kept(spark, rows[1:], [(CH, 2)]) == ["campaign:1|cpa", "campaign:2|cpa"]


def test_broad_move_passes_levels_that_do_not_check(spark):
    up = [A, CH, "campaign:1"]
    rows = [("campaign:1", [A, CH], "cpc", True, 9.0)] + [
        (f"creative:{c}", [*up, f"ad_set:{s}"], "cpc", True, 5.0)
        for c, s in ((1, 1), (2, 1), (3, 2), (4, 2))]
    children = [("campaign:1", 2), ("ad_set:1", 2), ("ad_set:2", 2), (CH, 1), (A, 1)]
    assert kept(spark, rows, children) == ["campaign:1|cpc"]


def series(spark, broken=lambda d: 1.0, orders=lambda d: 1.0, n=60):
    import math

    rows = [END - dt.timedelta(days=i) for i in range(n)]
    base = {d: 200 + 20 * math.sin(i) for i, d in enumerate(rows)}
    conv = {d: 0.4 * base[d] * (1 + 0.05 * math.sin(1.7 * i)) for i, d in enumerate(rows)}
    ads = spark.createDataFrame(
        [(d, "meta_ads", conv[d] * broken(d)) for d in rows],
        "date date, channel_id string, platform_conversions double")
    store = spark.createDataFrame(
        [(d, int(base[d] * orders(d))) for d in rows], "date date, orders bigint")
    return ads, store


def since(day, factor):
    return lambda d: factor if d >= day else 1.0


def test_tracking_verdicts(spark):
    start = dt.date(2026, 10, 28)
    row = TR.tracking_check(*series(spark, since(start, 0.15)), END).first()
    assert (row["status"], row["since"]) == ("broken", start)
    assert TR.tracking_check(*series(spark, since(start, 0.55)), END).first()["status"] == "warning"
    both = series(spark, since(start, 0.5), since(start, 0.5))
    assert TR.tracking_check(*both, END).first()["status"] == "ok"
    assert TR.tracking_check(*series(spark, n=10), END).count() == 0
    assert TR.tracking_check(*series(spark, orders=lambda d: 0.02), END).count() == 0


def test_diagnosis_and_action(spark):
    case = tired(spark)
    found = case.analyse()
    names = spark.createDataFrame([("creative:meta_ads/7/31/42", "Summer ad")], "entity_id string, name string")
    tracking = case.tracking
    row = sweep.investigate(found, tracking, names, []).first()
    assert row["hypotheses"][0]["cause"] == "creative_fatigue"
    assert row["recommendation"]["action"] == "rotate_creative"
    assert set(row["hypotheses"][0]["signal_ids"]) == {
        "chg|creative:meta_ads/7/31/42|ctr|20261030", "chg|creative:meta_ads/7/31/42|cpc|20261030"}
    assert row["observation"].startswith("Summer ad: ROAS fell 50%")
    guarded = sweep.investigate(found, tracking, names, ["7"]).first()
    assert guarded["protected"] and "pause_creative" not in guarded["allowed"]
