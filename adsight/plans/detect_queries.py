"""Queries of trust, pacing, detection, scoring and grouping."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import functions as F

from adsight.functions import catalogue as C
from adsight.functions import kpi as K
from adsight.functions import periods as P
from adsight.operators import detect as D
from adsight.operators import group as G
from adsight.operators import metrics as M
from adsight.operators import pacing as PC
from adsight.operators import report as R
from adsight.operators import trust as TR
from adsight.operators import windows as W
from adsight.plans import sweep
from adsight.plans.queries import query
from adsight.plans.session import scratch
from adsight.plans.stages import staged
from adsight.sources import testtables as T

JULY = (dt.date(2001, 7, 1), T.AS_OF)


def facts(spark, sf):
    return T.ad_facts(spark, sf), T.web_facts(spark, sf), T.store_facts(spark, sf)


def asked(spark, sf):
    """First and last as-of date of the whole tables."""
    return sweep.as_of_span(*facts(spark, sf))


def grain_of(ads, start, end):
    return M.entity_daily(M.in_period(ads, start - dt.timedelta(days=W.REACH - 1), end))


def top(spark, sf):
    ads, web, store = facts(spark, sf)
    dates = asked(spark, sf)
    return D.top_windows(grain_of(ads, *dates), web, store, *dates)


def shown(signals):
    """The comparable columns of a signals frame."""
    return signals.select(
        "as_of", "id", "detector", "metric", "entity_id", "channel_id", "ancestors", "current",
        "baseline", "change_pct", "adverse", F.col("measures.spend").alias("spend"))


# --- trust ------------------------------------------------------------------------------
def days_of(spark, sf):
    return TR.source_days(*facts(spark, sf))


@query("coverage")
def _(spark, sf):
    return TR.coverage(days_of(spark, sf))


@query("dates_by_source")
def _(spark, sf):
    return TR.dates_by_source(days_of(spark, sf), *JULY)


@query("as_of_date")
def _(spark, sf):
    return TR.as_of_date(TR.coverage(days_of(spark, sf)))


@query("ingestion_status")
def _(spark, sf):
    return TR.ingestion_status(TR.coverage(days_of(spark, sf)))


@query("freshness")
def _(spark, sf):
    return TR.freshness(days_of(spark, sf))


@query("conversions_vs_orders")
def _(spark, sf):
    ads, _, store = facts(spark, sf)
    return TR.conversions_vs_orders(ads, store)


def whole_tracking(spark, sf):
    ads, _, store = facts(spark, sf)
    return TR.tracking_checks(ads, store, *asked(spark, sf), min_orders=T.thresholds().min_orders)


@query("tracking_check_all_dates")
def _(spark, sf):
    return whole_tracking(spark, sf)


@query("tracking_check")
def _(spark, sf):
    ads, _, store = facts(spark, sf)
    return TR.tracking_check(ads, store, T.AS_OF, T.thresholds().min_orders)


@query("low_run_since")
def _(spark, sf):
    return whole_tracking(spark, sf).filter(F.col("status") != "ok").select(
        "as_of", "channel_id", "since")


@query("source_trust")
def _(spark, sf):
    ads, web, store = facts(spark, sf)
    tracking = TR.tracking_check(ads, store, T.AS_OF, T.thresholds().min_orders)
    return TR.source_trust(TR.freshness(TR.source_days(ads, web, store)), tracking)


@query("unreliable_metrics")
def _(spark, sf):
    return TR.unreliable_metrics(whole_tracking(spark, sf))


# --- pacing -----------------------------------------------------------------------------
@query("mtd_spend")
def _(spark, sf):
    return PC.mtd_spend(T.ad_facts(spark, sf), T.PACING_DAY)


@query("budget_pacing")
def _(spark, sf):
    budgets = PC.budgets_frame(spark, T.BUDGETS)
    return PC.budget_pacing(T.ad_facts(spark, sf), budgets, T.PACING_DAY)


def plans_of(spark):
    return spark.sql("""SELECT * FROM VALUES
        ('google_ads', 'search', 'default', 600000.0D), ('google_ads', 'search', '2001-07', 650000.0D),
        ('google_ads', 'shopping', 'default', 250000.0D), ('meta_ads', 'facebook', 'default', 400000.0D),
        ('meta_ads', 'instagram', 'default', 300000.0D), ('meta_ads', 'instagram', '2001-06', 350000.0D)
        AS t(channel_id, plan, month, amount)""")


@query("budget_plan")
def _(spark, sf):
    ads = T.ad_facts(spark, sf)
    spent = ads.groupBy("channel_id", F.date_format("date", "yyyy-MM").alias("month")).agg(
        F.sum("spend").alias("spend"))
    return PC.budget_plan(plans_of(spark), spent.select("channel_id", "month")).join(
        spent, ["channel_id", "month"])


# --- windows ----------------------------------------------------------------------------
@query("trailing_window")
def _(spark, sf):
    start, end = P.trailing("date", C.WINDOW_DAYS)
    before_start, before_end = P.previous(start, end)
    month_start, month_end = P.month_to_date("date")
    return M.store_daily(T.store_facts(spark, sf)).select(
        "date", start.alias("window_start"), end.alias("window_end"),
        before_start.alias("previous_start"), before_end.alias("previous_end"),
        month_start.alias("month_start"), month_end.alias("month_end"))


@query("densify_calendar")
def _(spark, sf):
    start, end = asked(spark, sf)
    daily = M.web_daily(M.in_period(T.web_facts(spark, sf), start, end)).select(
        "source", "date", "sessions")
    return M.densify_calendar(daily, ["source"], start - dt.timedelta(days=6), end)


def campaign_daily(spark, sf):
    ads = T.ad_facts(spark, sf)
    return ads.groupBy("campaign_id", "date").agg(
        F.sum("spend").alias("spend"), F.sum("clicks").alias("clicks"))


@query("baseline_weeks")
def _(spark, sf):
    found = W.windows_at(campaign_daily(spark, sf), ["campaign_id"], ("spend", "clicks"), T.AS_OF)
    return found.select("campaign_id", "as_of", *[
        f"{w}_{m}" for w in W.WEEKS for m in ("spend", "clicks")])


@query("rolling_windows")
def _(spark, sf):
    found = W.rolling_windows(
        campaign_daily(spark, sf), ["campaign_id"], ("spend", "clicks"), *asked(spark, sf))
    return found.select("campaign_id", "as_of", *[
        f"{w}_{m}" for w in ("cur", "base", *W.WEEKS) for m in ("spend", "clicks")])


@query("now_vs_baseline")
def _(spark, sf):
    ads = T.ad_facts(spark, sf)
    deep = D.deep_windows(grain_of(ads, T.AS_OF, T.AS_OF), T.AS_OF, T.AS_OF)
    both = deep.filter(F.col("cur_impressions").isNotNull() & F.col("base_impressions").isNotNull())
    return both.select("level", "key", *[
        F.col(f"{w}_{m}").alias(f"{w}_{m}") for w in ("cur", "base") for m in C.AD_MEASURES])


@query("segment_vs_peers")
def _(spark, sf):
    ads = T.ad_facts(spark, sf)
    found = D.segment_vs_peers(
        D.segment_windows(grain_of(ads, T.AS_OF, T.AS_OF), T.AS_OF, T.AS_OF))
    return found.filter("cur_impressions is not null").select(
        "key", *[f"{w}_{m}" for w in ("cur", "peer") for m in C.AD_MEASURES])


# --- detectors --------------------------------------------------------------------------
@query("detect_baseline_change")
def _(spark, sf):
    ads, web, store = facts(spark, sf)
    dates = asked(spark, sf)
    grain = grain_of(ads, *dates)
    return shown(D.baseline_change(
        D.top_windows(grain, web, store, *dates), D.deep_windows(grain, *dates), T.thresholds()))


@query("detect_account_change")
def _(spark, sf):
    return shown(D.account_change(top(spark, sf), T.thresholds()))


@query("detect_goal_breach")
def _(spark, sf):
    return shown(D.goal_breach(top(spark, sf), T.SETTINGS, T.thresholds()))


@query("detect_overspend")
def _(spark, sf):
    budgets = PC.budgets_frame(spark, T.BUDGETS)
    return shown(D.overspend(top(spark, sf), budgets, T.thresholds()))


@query("detect_funnel_drop")
def _(spark, sf):
    return shown(D.funnel_drop(top(spark, sf), T.thresholds()))


@query("detect_segment_divergence")
def _(spark, sf):
    dates = asked(spark, sf)
    return shown(D.segment_divergence(
        D.segment_windows(grain_of(T.ad_facts(spark, sf), *dates), *dates), T.thresholds()))


@query("detect_tracking_break")
def _(spark, sf):
    return shown(D.tracking_break(whole_tracking(spark, sf), top(spark, sf)))


def raw_signals(spark, sf):
    ads, web, store = facts(spark, sf)
    tracking = whole_tracking(spark, sf)
    return D.detect(ads, web, store, tracking, PC.budgets_frame(spark, T.BUDGETS), T.SETTINGS,
                    *asked(spark, sf), T.thresholds())


@query("detect")
def _(spark, sf):
    return shown(raw_signals(spark, sf))


@query("signal_id")
def _(spark, sf):
    return raw_signals(spark, sf).select("id", "as_of", "entity_id", "detector", "metric")


@query("enough_sample")
def _(spark, sf):
    frame = top(spark, sf)
    now = D.of("cur", frame.columns)
    floors = T.thresholds().min_sample
    return frame.selectExpr("as_of", "level", "key", *[
        f"{D.enough_sample(m, now, floors)} as {m}" for m in ("cpa", "roas", "ctr", "mer", "atc_rate")])


@query("noise_floor")
def _(spark, sf):
    frame = top(spark, sf)
    now = D.of("cur", frame.columns)
    return frame.selectExpr("as_of", "level", "key", *[
        f"round({D.noise_floor(m, now, 15.0)}, 6) as {m}" for m in ("cpa", "roas", "cpm", "atc_rate")])


@query("stands_out")
def _(spark, sf):
    frame = top(spark, sf).filter(F.col("level") == "channel")
    values = frame.selectExpr("as_of", "key", *[
        f"{D.value('cpa', D.of(w, frame.columns), 7)} as {w}" for w in ("cur", *W.WEEKS)])
    return values.selectExpr("as_of", "key", "cur as cpa",
                             f"{D.stands_out('cur', list(W.WEEKS))} as stands_out")


# --- scoring and grouping ---------------------------------------------------------------
def ranked_signals(spark, sf):
    ads, web, store = facts(spark, sf)
    context = sweep.Context(PC.budgets_frame(spark, T.BUDGETS), T.SETTINGS, T.FESTIVE,
                            T.thresholds())
    return sweep.signals_for(ads, web, store, context, *asked(spark, sf))[0]


@query("needs_tracking")
def _(spark, sf):
    return raw_signals(spark, sf).groupBy(
        "metric", G.needs_tracking().alias("needs_tracking")).agg(F.count(F.lit(1)).alias("signals"))


@query("rupee_impact")
def _(spark, sf):
    return raw_signals(spark, sf).select("as_of", "id", G.rupee_impact().alias("impact"))


@query("score")
def _(spark, sf):
    return raw_signals(spark, sf).select(
        "as_of", "id", G.score("change_pct", G.rupee_impact()).alias("score"))


@query("festive_overlap")
def _(spark, sf):
    start, end = P.trailing("date", C.WINDOW_DAYS)
    return M.store_daily(T.store_facts(spark, sf)).select(
        "date", G.festive_overlap(T.FESTIVE, start, end).alias("festive"))


JULY_SALE = [("Mid-season sale", dt.date(2001, 7, 1), dt.date(2001, 7, 4))]


@query("suppress")
def _(spark, sf):
    tracking = staged(whole_tracking(spark, sf), "tracking")
    return shown(G.suppress(raw_signals(spark, sf), tracking, JULY_SALE))


@query("rank_signals")
def _(spark, sf):
    tracking = staged(whole_tracking(spark, sf), "tracking")
    ranked = G.rank_signals(raw_signals(spark, sf), tracking, JULY_SALE, 5000.0)
    return ranked.select("as_of", "id", "impact", "score")


@query("lineage")
def _(spark, sf):
    return G.lineage(T.ad_facts(spark, sf))


@query("child_counts")
def _(spark, sf):
    return G.child_counts(T.ad_facts(spark, sf))


@query("broad_moves")
def _(spark, sf):
    return G.broad_moves(ranked_signals(spark, sf), G.child_counts(T.ad_facts(spark, sf)))


@query("most_specific")
def _(spark, sf):
    kept = G.most_specific(ranked_signals(spark, sf), G.child_counts(T.ad_facts(spark, sf)))
    return kept.select("as_of", "id", "impact", "score")


def grouped(spark, sf):
    kept = G.most_specific(ranked_signals(spark, sf), G.child_counts(T.ad_facts(spark, sf)))
    return G.group_opportunities(kept)


@query("group_opportunities")
def _(spark, sf):
    return grouped(spark, sf).select(
        "as_of", "opportunity", "kind", F.col("primary.id").alias("primary_id"),
        F.transform("signals", lambda s: s["id"]).alias("signal_ids"), "impact", "score")


@query("rank_opportunities")
def _(spark, sf):
    return G.rank_opportunities(grouped(spark, sf), 3).select(
        "as_of", "kind", "place", "opportunity", "score")


@query("analyse")
def _(spark, sf):
    ads, web, store = facts(spark, sf)
    context = sweep.Context(PC.budgets_frame(spark, T.BUDGETS), T.SETTINGS, T.FESTIVE,
                            T.thresholds())
    return sweep.analyse(ads, web, store, context, T.AS_OF, T.AS_OF).select(
        "as_of", "opportunity", "kind", F.transform("signals", lambda s: s["id"]).alias("signal_ids"),
        "impact", "score")


def replayed(spark, sf):
    """The stored opportunities of every as-of date."""
    ads, web, store = facts(spark, sf)
    context = sweep.Context(PC.budgets_frame(spark, T.BUDGETS), T.SETTINGS, T.FESTIVE,
                            T.thresholds())
    return sweep.replay(ads, web, store, context)


@query("replay")
def _(spark, sf):
    return replayed(spark, sf).select(
        "as_of", "opportunity", "kind", F.transform("signals", lambda s: s["id"]).alias("signal_ids"),
        "impact", "score")


@query("refresh_replay")
def _(spark, sf):
    """The stored replay after eleven days of ad facts came late and the dates they reach ran again."""
    ads, web, store = facts(spark, sf)
    context = sweep.Context(PC.budgets_frame(spark, T.BUDGETS), T.SETTINGS, T.FESTIVE,
                            T.thresholds())
    late = F.col("date").between("2001-06-10", "2001-06-20")
    path = scratch(spark, "analysis")
    sweep.refresh(spark, path, ads.filter(~late), web, store, context, ads.select("date").distinct())
    sweep.refresh(spark, path, ads, web, store, context, ads.filter(late).select("date").distinct())
    return sweep.stored_replay(spark, path).select(
        "as_of", "opportunity", "kind", F.transform("signals", lambda s: s["id"]).alias("signal_ids"),
        "impact", "score")


@query("replay_status")
def _(spark, sf):
    """First seen, reopened and resolved at every as-of date, as repeated runs would store it."""
    found = replayed(spark, sf).select(
        F.col("opportunity").alias("key"), "as_of", "window_start",
        F.col("window_end").alias("last_seen_date"), "score")
    start, end = asked(spark, sf)
    runs = spark.range(1).select(F.explode(F.sequence(F.lit(start), F.lit(end))).alias("as_of"))
    return R.carry_status(found, runs)


@query("analysis_run_log")
def _(spark, sf):
    return grouped(spark, sf).groupBy("as_of").agg(
        F.sum(F.size("signals")).alias("signal_count"), F.count(F.lit(1)).alias("opportunity_count"),
        F.lit("success").alias("status"))
