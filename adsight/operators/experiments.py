"""Experiments: plan, lifecycle, measurement and verdict."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from adsight.functions import catalogue as C
from adsight.functions import kpi as K
from adsight.functions import wording as WD
from adsight.operators import metrics as M


def plan_target(metric: K.ColumnLike, current: K.ColumnLike, reference: K.ColumnLike) -> Column:
    """The better of where a metric is and where it was; the reference when it has no direction."""
    now, ref, better = K.col(current), K.col(reference), K.higher_is_better(metric)
    best = F.when(better.isNull(), ref).when(better, F.greatest(now, ref)).otherwise(
        F.least(now, ref))
    return F.when(now.isNull(), ref).when(ref.isNotNull(), best)


def hypothesis(
    action: Column, metric: Column, name: Column, baseline: Column, goal: Column, days: int
) -> Column:
    """The sentence an experiment is judged against."""
    doing = K.lookup({a: s.gerund for a, s in C.ACTIONS.items()}, action)
    says = lambda kind, *values: WD.filled(
        C.HYPOTHESIS[kind], doing, name, WD.label(metric), *values, F.lit(str(days)))
    vague = says("vague")
    repair = says("repair", WD.plain(baseline * 100, 0))
    move = says("move", WD.value_text(metric, baseline), WD.value_text(metric, goal))
    return (
        F.when(baseline.isNull() | goal.isNull(), vague)
        .when(action == "fix_tracking", repair).otherwise(move))


def experiment_plan(opportunities: DataFrame, days: int = C.DEFAULT_DURATION_DAYS) -> DataFrame:
    """A draft for every opportunity with a recommended action.

    Needs action, watch, primary_metric, current, baseline, entity_name.
    """
    metric = F.coalesce("watch", "primary_metric")
    same = metric == F.col("primary_metric")
    now, ref = F.when(same, F.col("current")), F.when(same, F.col("baseline"))
    goal = plan_target(metric, now, ref)
    return opportunities.filter(F.col("action").isNotNull()).select(
        F.col("id").alias("opportunity_id"), "action",
        hypothesis(F.col("action"), metric, F.col("entity_name"), now, goal, days)
        .alias("hypothesis"),
        metric.alias("metric"), now.alias("baseline"), goal.alias("target"),
        F.lit(days).alias("duration_days"), F.lit("draft").alias("status"))


def measured_window(started: K.ColumnLike, days: K.ColumnLike) -> dict[str, Column]:
    """The days a change is judged over (from the day after approval) and those before."""
    start = F.date_add(K.col(started), 1)
    return {
        "after_start": start,
        "after_end": F.date_add(start, K.col(days) - 1),
        "before_start": F.date_sub(start, K.col(days)),
        "before_end": F.date_sub(start, 1),
    }


def verdict(
    metric: K.ColumnLike, before: K.ColumnLike, after: K.ColumnLike, sample_days: K.ColumnLike
) -> Column:
    gain = K.improvement_pct(metric, before, after)
    unclear = (
        (K.col(sample_days) < C.MIN_SAMPLE_DAYS) | gain.isNull()
        | (F.abs(gain) < C.MIN_EFFECT_PCT))
    return F.when(unclear, "inconclusive").when(gain > 0, "worked").otherwise("did_not_work")


def progress(started: K.ColumnLike, ends: K.ColumnLike, as_of: K.ColumnLike) -> dict[str, Column]:
    total = F.datediff(K.col(ends), K.col(started))
    gone = F.datediff(K.col(as_of), K.col(started))
    return {
        "day": F.greatest(F.lit(0), F.least(total, gone)), "total": total,
        "due": K.col(as_of) >= K.col(ends)}


def joined(experiments: DataFrame, opportunities: DataFrame) -> DataFrame:
    """Experiments with the opportunity each came from."""
    found = opportunities.select(
        F.col("id").alias("opportunity_id"), "entity_level", "entity_key", "entity_name",
        F.col("kind").alias("opportunity_kind"), F.col("status").alias("opportunity_status"),
        "primary_metric")
    return experiments.join(found, "opportunity_id")


LEVELS = ("account", "channel", "campaign", "ad_set", "creative")


def due(experiments: DataFrame, as_of: dt.date) -> DataFrame:
    return experiments.filter((F.col("status") == "running") & (F.col("ends_on") <= F.lit(as_of)))


def evaluate(
    experiments: DataFrame, opportunities: DataFrame, ads: DataFrame, web: DataFrame,
    store: DataFrame, as_of: dt.date, still_detected: DataFrame | None = None,
) -> DataFrame:
    """Before, after and verdict of every due experiment in one pass over the facts.

    ``still_detected``: ids (``opportunity_id``) this run found again; a change that did not work
    reopens only those.
    """
    judged = joined(due(experiments, as_of), opportunities).withColumns(
        measured_window("started_on", "duration_days"))
    side = lambda name, flag: F.struct(
        F.lit(flag).alias("side"), F.col(f"{name}_start").alias("start"),
        F.col(f"{name}_end").alias("end"))
    requests = judged.select(
        "id", F.col("entity_level").alias("level"), F.col("entity_key").alias("key"),
        F.inline(F.array(side("before", "before"), side("after", "after"))))
    # Only the days that a window covers are read (two dates reach the driver).
    span = requests.agg(F.min("start"), F.max("end")).first()
    first, last = (day or as_of for day in span)
    days = M.entity_days(*(M.in_period(f, first, last) for f in (ads, web, store)), LEVELS)
    totals = M.entity_window_totals(requests, days, ["id", "side"])
    # Both sides of an experiment meet in one aggregation on its id.
    wide = totals.groupBy("id").agg(*[
        F.max(F.when(F.col("side") == s, F.col(m))).alias(f"{s}_{m}")
        for s in ("before", "after") for m in (*C.ALL_MEASURES, "days")])
    values = judged.join(wide, "id")
    value = lambda s: K.metric_by_name(
        "metric", lambda m: F.col(f"{s}_{m}"), "duration_days")
    measured = values.select(
        "id", "opportunity_id", "metric", value("before").alias("before_value"),
        value("after").alias("after_value"), F.col("after_days").alias("sample_days"),
        F.col("ends_on").alias("evaluated_on"))
    found = measured.withColumn(
        "verdict", verdict("metric", "before_value", "after_value", "sample_days"))
    if still_detected is None:
        return found
    again = still_detected.select("opportunity_id").distinct().withColumn("again", F.lit(True))
    return found.join(again, "opportunity_id", "left").withColumn(
        "opportunity_status", F.when(
            (F.col("verdict") != "worked") & F.coalesce("again", F.lit(False)), "open"
        ).otherwise("resolved")).drop("again")


def experiments_today(experiments: DataFrame, as_of: dt.date, limit: int = 2) -> DataFrame:
    """The newest few running and completed ones, and how many drafts wait."""
    newest = Window.partitionBy("status").orderBy(F.desc("id"))
    shown = experiments.filter(F.col("status").isin("running", "completed")).withColumn(
        "place", F.row_number().over(newest)).filter(F.col("place") <= limit)
    waiting = experiments.agg(F.count_if(F.col("status") == "draft").alias("count"))
    return shown.select(
        "status", "place", "id", *[c.alias(n) for n, c in progress(
            "started_on", "ends_on", F.lit(as_of)).items()], F.lit(None).cast("bigint").alias(
            "count")).unionByName(
        waiting.select(F.lit("awaiting").alias("status"), "count"), allowMissingColumns=True)


def apply_decisions(
    experiments: DataFrame, decisions: DataFrame, as_of: dt.date
) -> DataFrame:
    """Drafts moved on by a batch of decisions: approved ones start, rejected ones end.

    ``decisions``: (id, kind, experiment_id, reason). The first decision on a draft counts; the
    later ones no longer find a draft.
    """
    first = Window.partitionBy("experiment_id").orderBy("id")
    valid = decisions.filter(F.col("kind").isin("approve", "reject")).withColumn(
        "place", F.row_number().over(first)).filter("place = 1").select(
        F.col("experiment_id").alias("id"), F.col("kind").alias("decision"),
        F.col("reason").alias("decision_reason"))
    moved = experiments.join(valid, "id", "left")
    draft = F.col("status") == "draft"
    approve = F.coalesce(draft & (F.col("decision") == "approve"), F.lit(False))
    reject = F.coalesce(draft & (F.col("decision") == "reject"), F.lit(False))
    ends = measured_window(F.lit(as_of), F.col("duration_days"))["after_end"]
    return moved.withColumns({
        "started_on": F.when(approve, F.lit(as_of)).otherwise(F.col("started_on")),
        "ends_on": F.when(approve, ends).otherwise(F.col("ends_on")),
        "reason": F.when(approve | reject, F.col("decision_reason")),
        "opportunity_status": F.when(approve, "experimenting"),
        "status": F.when(approve, "running").when(reject, "rejected").otherwise(F.col("status")),
    }).drop("decision", "decision_reason")


def fold_decisions(events: DataFrame, days: int = C.DEFAULT_DURATION_DAYS) -> DataFrame:
    """Every step of an ordered log of decisions, with the experiment it met and what came of it.

    ``events``: (id, opportunity_id, created_on, kind, reason), kind one of draft, approve, reject,
    dismiss; ordered by day and id, both unique together for an opportunity. An opportunity has at
    most one live experiment. A draft is made when none is live; only a draft is approved or
    rejected; an approved one runs and is complete on the first day of its end or later, before
    that day's decisions; dismissing always counts. Adds accepted, experiment_id (the id of the
    event that drafted it; also where a draft asked again meets the live one, or a decision comes
    too late), status (of the experiment after the step), started_on and ends_on.

    Inside a day, whether a draft is open follows from the last draft or rejection, so a day needs
    only three facts for each state it can begin in: the approval that would count, and how it
    ends. The fold runs over these day rows, of which an opportunity has no more than the log has
    days; the events themselves are only sorted by (opportunity, day).
    """
    key, day = "opportunity_id", "created_on"
    inside = Window.partitionBy(key, day).orderBy("id")
    sets = F.when(F.col("kind") == "draft", True).when(F.col("kind") == "reject", False)
    before = F.last(sets, ignorenulls=True).over(inside.rowsBetween(
        Window.unboundedPreceding, -1))
    told = events.withColumn("open_before", before)
    asks = F.col("kind") == "approve"
    daily = told.groupBy(key, day).agg(
        F.min(F.when(asks & F.coalesce("open_before", F.lit(False)), F.col("id"))).alias(
            "if_none"),
        F.min(F.when(asks & F.coalesce("open_before", F.lit(True)), F.col("id"))).alias(
            "if_draft"),
        F.max_by(sets, F.when(sets.isNotNull(), F.col("id"))).alias("leaves"))
    id_kind = events.schema["id"].dataType.simpleString()
    fold = f"""aggregate(array_sort(collect_list(struct({day} as day, if_none, if_draft, leaves))),
        named_struct('open', false, 'ends', cast(null as date),
            'runs', cast(array() as array<struct<day:date,approval:{id_kind}>>)),
        (a, d) -> if(coalesce(a.ends > d.day, false), a, named_struct(
            'open', if(if(a.open, d.if_draft, d.if_none) is null, coalesce(d.leaves, a.open), false),
            'ends', if(if(a.open, d.if_draft, d.if_none) is null, a.ends, date_add(d.day, {days})),
            'runs', if(if(a.open, d.if_draft, d.if_none) is null, a.runs, concat(a.runs, array(
                struct(d.day as day, if(a.open, d.if_draft, d.if_none) as approval)))))))"""
    runs = daily.groupBy(key).agg(F.expr(fold).alias("fold")).select(
        key, F.inline("fold.runs")).select(key, F.col("day").alias(day), "approval")
    # What a day begins with: the run that goes on, or else a draft left by the days since it ended.
    over = Window.partitionBy(key).orderBy(day)
    earlier = over.rowsBetween(Window.unboundedPreceding, -1)
    begun = daily.join(runs, [key, day], "left").withColumn(
        "run", F.when(F.col("approval").isNotNull(), F.struct(F.col(day).alias("day"), "approval")))
    begun = begun.withColumn("last_run", F.last("run", ignorenulls=True).over(earlier)).withColumn(
        "free_from", F.date_add("last_run.day", days))
    busy = F.coalesce(F.col("free_from") > F.col(day), F.lit(False))
    left = F.when(~busy & F.col("approval").isNull() & F.col("leaves").isNotNull(), F.struct(
        F.col(day).alias("day"), F.col("leaves").alias("open")))
    begun = begun.withColumns({"busy": busy, "left": left}).withColumn(
        "last_left", F.last("left", ignorenulls=True).over(earlier))
    stale = F.col("free_from").isNotNull() & (F.col("last_left.day") < F.col("free_from"))
    begun = begun.select(
        key, day, "busy", "last_run", "approval",
        F.coalesce(F.col("last_left.open") & ~stale, F.lit(False)).alias("begins_open"))
    steps = told.join(begun, [key, day])
    done = F.coalesce(F.col("id") > F.col("approval"), F.lit(False))
    free = ~F.col("busy") & ~done
    open_ = F.coalesce("open_before", "begins_open")
    kind = F.col("kind")
    steps = steps.withColumns({
        "running": F.col("busy") | done,
        "accepted": (kind == "dismiss") | (free & F.when(kind == "draft", ~open_).otherwise(open_))})
    # The draft a step meets: of its day, or the last one of the days before.
    drafted = F.when(F.col("accepted") & (kind == "draft"), F.col("id"))
    steps = steps.withColumn("of_day", F.last(drafted, ignorenulls=True).over(
        inside.rowsBetween(Window.unboundedPreceding, 0)))
    carried = steps.groupBy(key, day).agg(F.max("of_day").alias("last_of_day")).withColumn(
        "carried", F.last("last_of_day", ignorenulls=True).over(earlier)).drop("last_of_day")
    steps = steps.join(carried, [key, day])
    live = F.col("running") | (free & (open_ | (kind == "draft")))
    started = F.when(F.col("busy"), F.col("last_run.day")).when(
        done | (F.col("approval") == F.col("id")), F.col(day))
    met = (kind != "dismiss") & live
    return steps.select(
        "id", key, day, "kind", "reason", "accepted",
        F.when(met, F.coalesce("of_day", "carried")).alias("experiment_id"),
        F.when(met, F.when(started.isNotNull(), "running").when(
            F.col("accepted") & (kind == "reject"), "rejected").otherwise("draft")).alias("status"),
        F.when(met, started).alias("started_on"),
        F.when(met, F.date_add(started, days)).alias("ends_on"))


def experiments_after(steps: DataFrame, as_of: dt.date) -> DataFrame:
    """The experiments that a folded log leaves on a day; due ones are complete."""
    made = steps.filter("accepted and kind <> 'dismiss'").groupBy(
        F.col("experiment_id").alias("id"), "opportunity_id").agg(
        *(F.max_by(c, F.struct("created_on", "id")).alias(c) for c in ("status", "reason")),
        F.min("created_on").alias("drafted_on"), F.max("started_on").alias("started_on"),
        F.max("ends_on").alias("ends_on"))
    over = (F.col("status") == "running") & (F.col("ends_on") <= F.lit(as_of))
    return made.withColumn("status", F.when(over, "completed").otherwise(F.col("status")))


def decision_log(steps: DataFrame, opportunities: DataFrame) -> DataFrame:
    """A row for every decision that counted, with the impact at stake; drafts are no decisions."""
    stakes = opportunities.select(F.col("id").alias("opportunity_id"), "impact")
    return steps.filter("accepted and kind <> 'draft'").join(stakes, "opportunity_id").select(
        "id", "kind", "opportunity_id", F.when(F.col("kind") != "dismiss", F.col(
            "experiment_id")).alias("experiment_id"), "reason", "impact", "created_on")


def opportunity_states(steps: DataFrame, as_of: dt.date) -> DataFrame:
    """What the log makes of each opportunity: its last approval, completion or dismissal decides.

    ``measured``: a change is complete and its verdict (:func:`evaluate`) closes or reopens it.
    """
    counted = steps.filter("accepted and kind in ('approve', 'dismiss')")
    last = counted.groupBy("opportunity_id").agg(F.max_by(
        F.struct("kind", "reason", "ends_on", "created_on"), F.struct("created_on", "id")).alias("d"),
        F.max("ends_on").alias("ends_on"))
    # A change that was running when the opportunity was set aside still completes after it.
    ended = F.coalesce(F.col("ends_on") <= F.lit(as_of), F.lit(False))
    later = ended & F.coalesce(F.col("ends_on") > F.col("d.created_on"), F.lit(False))
    dismissed = (F.col("d.kind") == "dismiss") & ~later
    return last.select(
        "opportunity_id", F.when(dismissed, "dismissed").when(ended, "measured").otherwise(
            "experimenting").alias("status"),
        F.when(dismissed, F.col("d.reason")).alias("dismissed_reason"))


def draft_all(plans: DataFrame, experiments: DataFrame) -> DataFrame:
    """New drafts only for opportunities without a draft or running experiment."""
    live = experiments.filter(F.col("status").isin("draft", "running")).select("opportunity_id")
    return plans.join(live, "opportunity_id", "left_anti")


def decision_chain(
    decisions: DataFrame, opportunities: DataFrame, experiments: DataFrame, limit: int = 200
) -> DataFrame:
    """The newest decisions with their opportunity and, when there is one, their experiment."""
    about = opportunities.select(
        F.col("id").alias("opportunity_id"), "entity_name", "primary_metric",
        F.col("kind").alias("opportunity_kind"))
    made = experiments.select(
        F.col("id").alias("experiment_id"), "action", F.col("status").alias("experiment_status"),
        "verdict")
    chain = decisions.join(about, "opportunity_id").join(made, "experiment_id", "left")
    return chain.orderBy(F.desc("created_on"), F.desc("id")).limit(limit)


def decisions_by_month(decisions: DataFrame, experiments: DataFrame) -> DataFrame:
    """Decisions per calendar month and how many of them worked."""
    made = experiments.select(F.col("id").alias("experiment_id"), "verdict")
    return decisions.join(made, "experiment_id", "left").groupBy(
        F.trunc("created_on", "MM").alias("month")).agg(
        F.count(F.lit(1)).alias("decisions"),
        F.count_if(F.col("verdict") == "worked").alias("worked"))


def settings_view(settings: DataFrame, campaigns: DataFrame) -> DataFrame:
    """Settings rows with derived break-even, profitability and unknown protected campaigns.

    ``settings``: (business_id, gross_margin_pct, target_roas, protected array). ``campaigns``:
    (campaign_id).
    """
    wanted = settings.select(
        "business_id", F.explode_outer("protected").alias("campaign_id"))
    unknown = wanted.filter("campaign_id is not null").join(
        campaigns, "campaign_id", "left_anti").groupBy("business_id").agg(
        F.count(F.lit(1)).alias("unknown_campaigns"))
    return settings.join(unknown, "business_id", "left").select(
        "business_id", "gross_margin_pct", "target_roas",
        K.break_even_roas("gross_margin_pct").alias("break_even_roas"),
        K.is_profitable_roas("target_roas", "gross_margin_pct").alias("target_profitable"),
        F.coalesce("unknown_campaigns", F.lit(0)).alias("unknown_campaigns"))
