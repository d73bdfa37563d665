"""Queries of explanation, recommendation, experiments and decisions."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import functions as F

from adsight.functions import catalogue as C
from adsight.functions import kpi as K
from adsight.operators import detect as D
from adsight.operators import experiments as E
from adsight.operators import explain as X
from adsight.operators import group as G
from adsight.operators import pacing as PC
from adsight.operators import recommend as R
from adsight.plans import sweep
from adsight.plans.detect_queries import asked, facts, grain_of
from adsight.plans.queries import query
from adsight.plans.stages import staged
from adsight.sources import testtables as T


def campaign_windows(spark, sf):
    """Windows of every campaign at every as-of date, rows present on both sides."""
    dates = asked(spark, sf)
    deep = D.deep_windows(grain_of(T.ad_facts(spark, sf), *dates), *dates).filter(
        "level = 'campaign'")
    return deep.filter("cur_impressions is not null and base_impressions is not null")


def share_of(column):
    """A share as shown: those beyond 1000 % come from totals near zero and have no decimals."""
    return F.when(F.abs(column) < 1000, F.round(column, 6)).otherwise(F.round(column, 0)).alias(
        "share_pct")


@query("decompose")
def _(spark, sf):
    split = X.decompose(campaign_windows(spark, sf), "roas", "base_", "cur_")
    rows = split.select("as_of", "key", F.inline("drivers"))
    return rows.select("as_of", "key", "driver", "before", "after",
                       F.round("change_pct", 6).alias("change_pct"),
                       share_of("share_pct"))


def campaign_roots(spark, sf):
    """Each campaign window as an opportunity with one ROAS signal."""
    frame = campaign_windows(spark, sf)
    signal = (
        "named_struct('metric', 'roas', 'score', 1D, 'measures', "
        f"{D.measure_struct(D.of('cur', frame.columns))}, 'baseline_measures', "
        f"{D.measure_struct(D.of('base', frame.columns))})")
    return X.with_evidence(frame.selectExpr("as_of", "key", f"array({signal}) as signals"))


@query("evidence_tree")
def _(spark, sf):
    rows = X.evidence_tree(campaign_roots(spark, sf), ["as_of", "key"])
    return rows.withColumns({
        "change_pct": F.round("change_pct", 6), "share_pct": share_of("share_pct")})


@query("dominant_chain")
def _(spark, sf):
    return campaign_roots(spark, sf).select(
        "as_of", "key", F.posexplode_outer("chain").alias("place", "node")).select(
        "as_of", "key", "place", "node.metric", share_of("node.share_pct")
    ).filter("place is not null")


@query("is_protected")
def _(spark, sf):
    return G.lineage(T.ad_facts(spark, sf)).select(
        "entity_id", X.is_protected(T.PROTECTED).alias("protected"))


def explained(spark, sf):
    ads, web, store = facts(spark, sf)
    context = sweep.Context(PC.budgets_frame(spark, T.BUDGETS), T.SETTINGS, T.FESTIVE,
                            T.thresholds())
    signals, tracking = sweep.signals_for(ads, web, store, context, *asked(spark, sf))
    found = G.group_opportunities(G.most_specific(signals, G.child_counts(ads)))
    names = G.lineage(ads).select("entity_id", F.concat_ws(
        "-", F.replace("level", F.lit("_"), F.lit("")), "key").alias("name"))
    return sweep.investigate(found, tracking, names, T.PROTECTED)


@query("observation_text")
def _(spark, sf):
    return explained(spark, sf).select("as_of", "opportunity", "observation", "alternatives")


@query("diagnose_findings")
def _(spark, sf):
    return explained(spark, sf).select(
        "as_of", "opportunity", F.posexplode_outer("hypotheses").alias("place", "h")).select(
        "as_of", "opportunity", "place", "h.cause", (-F.col("h.rank")).alias("weight"),
        "h.statement", "h.signal_ids")


@query("recommend_findings")
def _(spark, sf):
    return explained(spark, sf).select(
        "as_of", "opportunity", "priority", "band", "confidence", "recommendation.action",
        "recommendation.rationale", "recommendation.impact_low", "recommendation.impact_high",
        "recommendation.risk", "recommendation.watch", "recommendation.stop_condition",
        "recommendation.params")


def campaign_cases(spark, sf):
    """Each campaign window as an opportunity raised on its ROAS, investigated."""
    frame = campaign_windows(spark, sf)
    now, before = D.of("cur", frame.columns), D.of("base", frame.columns)
    valued = frame.selectExpr(
        "as_of", "level", "key", "channel_id", "campaign_id", "ad_set_id",
        f"{D.value('roas', now, 7)} as current", f"{D.value('roas', before, 28)} as baseline",
        f"{D.measure_struct(now)} as measures", f"{D.measure_struct(before)} as baseline_measures")
    signal = (
        "named_struct('id', concat('chg|campaign:', key, '|roas'), 'detector', 'baseline_change', "
        "'metric', 'roas', 'score', 1D, 'current', current, 'baseline', baseline, 'change_pct', "
        "try_divide(current - baseline, abs(baseline)) * 100, 'measures', measures, "
        "'baseline_measures', baseline_measures)")
    found = valued.filter("current is not null and baseline is not null").selectExpr(
        "as_of", "level", "key", "channel_id", "campaign_id", "ad_set_id",
        "date_sub(as_of, 6) as window_start", "as_of as window_end",
        "concat('campaign-', key) as name", "'ok' as trust", "false as protected",
        "if(current < baseline, 'issue', 'win') as kind",
        "abs(current - baseline) * measures.spend as impact",
        f"{signal} as primary", f"array({signal}) as signals")
    return R.recommend(X.diagnose(X.with_evidence(found)))


@query("diagnose")
def _(spark, sf):
    return campaign_cases(spark, sf).select(
        "as_of", "key", "kind", F.posexplode_outer("hypotheses").alias("place", "h")).select(
        "as_of", "key", "kind", "place", "h.cause", (-F.col("h.rank")).alias("weight"))


@query("recommend")
def _(spark, sf):
    return campaign_cases(spark, sf).select(
        "as_of", "key", "action", "confidence", F.round("priority", 4).alias("priority"), "band",
        F.round("recommendation.impact_low", 4).alias("impact_low"),
        F.round("recommendation.impact_high", 4).alias("impact_high"),
        "recommendation.risk", "recommendation.watch")


def stored(spark, sf):
    """Stored opportunities with the entity columns the catalogue rules read."""
    rows = T.opportunities(spark, sf).withColumns({
        "level": F.col("entity_level"), "key": F.col("entity_key"),
        "protected": F.col("campaign_id").isin(*T.PROTECTED)
        | ((F.col("entity_level") == "campaign") & F.col("entity_key").isin(*T.PROTECTED))})
    return rows.withColumn("protected", F.coalesce("protected", F.lit(False))).withColumn(
        "allowed", R.allowed_actions())


@query("allowed_actions")
def _(spark, sf):
    return stored(spark, sf).select("id", "allowed")


@query("params_for")
def _(spark, sf):
    chosen = stored(spark, sf).withColumn("action", R.choose_action(F.array("cause"), "allowed"))
    return chosen.select("id", *[c.alias(n) for n, c in R.params_for("action").items()])


@query("action_catalogue")
def _(spark, sf):
    """Each action's terms with the number of stored opportunities that allow it."""
    possible = stored(spark, sf).select(F.explode("allowed").alias("action")).groupBy(
        "action").agg(F.count(F.lit(1)).alias("possible"))
    return R.action_catalogue(spark).join(possible, "action", "left").withColumn(
        "possible", F.coalesce("possible", F.lit(0)))


def with_action(spark, sf):
    return stored(spark, sf).withColumn("action", R.choose_action(F.array("cause"), "allowed"))


@query("choose_action")
def _(spark, sf):
    return with_action(spark, sf).select("id", "cause", "action")


@query("confidence")
def _(spark, sf):
    return T.opportunities(spark, sf).select("id", R.confidence(
        "change_pct", F.col("signal_count"), F.lit(None).cast("double"), "trust").alias(
        "confidence"))


@query("priority")
def _(spark, sf):
    value = F.col("impact") * F.col("confidence")
    return T.opportunities(spark, sf).select(
        "id", value.alias("priority"), R.band(value).alias("band"))


@query("experiment_plan")
def _(spark, sf):
    watched = with_action(spark, sf).withColumn("watch", K.lookup(
        {n: a.watch for n, a in C.ACTIONS.items() if a.watch}, "action"))
    return E.experiment_plan(watched).drop("hypothesis")


@query("experiment_window")
def _(spark, sf):
    started = T.experiments(spark, sf).filter("started_on is not null")
    return started.select("id", *[
        c.alias(n) for n, c in E.measured_window("started_on", "duration_days").items()])


@query("verdict")
def _(spark, sf):
    done = T.experiments(spark, sf).filter("status = 'completed'")
    return done.select("id", F.round(K.improvement_pct(
        "metric", "before_value", "after_value"), 6).alias("improvement_pct"),
        E.verdict("metric", "before_value", "after_value", "sample_days").alias("verdict"))


@query("experiment_progress")
def _(spark, sf):
    running = T.experiments(spark, sf).filter("status = 'running'")
    return running.select("id", *[c.alias(n) for n, c in E.progress(
        "started_on", "ends_on", F.lit(T.AS_OF)).items()])


@query("experiments_today")
def _(spark, sf):
    return E.experiments_today(T.experiments(spark, sf), T.AS_OF)


@query("experiments_with_opportunity")
def _(spark, sf):
    rows = E.joined(T.experiments(spark, sf), T.opportunities(spark, sf))
    return rows.select(
        "id", "opportunity_id", "status", "metric", "entity_level", "entity_key",
        "opportunity_status",
        ((F.col("status") == "running") & (F.col("ends_on") <= F.lit(T.AS_OF))).alias("due"),
        F.col("status").isin("draft", "running").alias("live"))


@query("evaluate_experiments")
def _(spark, sf):
    opportunities = T.opportunities(spark, sf)
    again = opportunities.filter("status = 'experimenting'").select(
        F.col("id").alias("opportunity_id"))
    return E.evaluate(T.experiments(spark, sf), opportunities, *facts(spark, sf), T.AS_OF, again)


@query("apply_decisions")
def _(spark, sf):
    batch = T.decisions(spark, sf).withColumn(
        "kind", F.when(F.col("id") % 3 == 0, "approve").otherwise("reject")).withColumn(
        "experiment_id", F.col("id"))
    moved = E.apply_decisions(T.experiments(spark, sf), batch, dt.date(2001, 7, 20))
    return moved.select("id", "status", "started_on", "ends_on", "reason", "opportunity_status")


def lifecycle(spark, sf):
    return staged(E.fold_decisions(T.decision_requests(spark, sf)), "steps")


@query("experiment_lifecycle")
def _(spark, sf):
    return lifecycle(spark, sf)


@query("lifecycle_experiments")
def _(spark, sf):
    return E.experiments_after(lifecycle(spark, sf), T.AS_OF)


@query("lifecycle_decisions")
def _(spark, sf):
    return E.decision_log(lifecycle(spark, sf), T.opportunities(spark, sf))


@query("lifecycle_opportunities")
def _(spark, sf):
    return E.opportunity_states(lifecycle(spark, sf), T.AS_OF)


@query("decision_chain")
def _(spark, sf):
    return E.decision_chain(
        T.decisions(spark, sf), T.opportunities(spark, sf), T.experiments(spark, sf)).select(
        "id", "kind", "opportunity_id", "experiment_id", "reason", "created_on", "entity_name",
        "primary_metric", "action", "verdict")


@query("decisions_by_month")
def _(spark, sf):
    return E.decisions_by_month(T.decisions(spark, sf), T.experiments(spark, sf))


@query("settings_view")
def _(spark, sf):
    campaigns = T.ad_facts(spark, sf).select("campaign_id").distinct()
    return E.settings_view(T.settings_rows(spark, sf), campaigns)
