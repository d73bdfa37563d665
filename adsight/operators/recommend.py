"""One action from the fixed catalogue, with every number computed."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from adsight.functions import catalogue as C
from adsight.functions import kpi as K
from adsight.functions import wording as WD


def action_catalogue(spark) -> DataFrame:
    rows = F.array(*[
        F.struct(
            F.lit(name).alias("action"), F.lit(a.risk).alias("risk"),
            F.lit(",".join(a.levels)).alias("levels"), F.lit(",".join(a.params)).alias("params"),
            F.lit(a.low).alias("low"), F.lit(a.high).alias("high"),
            F.lit(a.watch).cast("string").alias("watch"))
        for name, a in C.ACTIONS.items()])
    return spark.range(1).select(F.inline(rows))


def params_for(action: K.ColumnLike | None = None) -> dict[str, Column]:
    """The parameters of a change, read off the entity's place in the hierarchy."""
    level, key = F.col("level"), F.col("key")
    own = lambda name, column: F.when(level == name, key).otherwise(F.col(column))
    found = {
        "target_level": level,
        "target_key": key,
        "channel": F.col("channel_id"),
        "creative_id": F.when(level == "creative", key),
        "ad_set_id": own("ad_set", "ad_set_id"),
        "campaign_id": own("campaign", "campaign_id"),
    }
    if action is not None:
        way = F.when(F.col("kind") == "win", "into").otherwise("out_of")
        found["direction"] = F.when(K.col(action) == "shift_budget", way)
    return found


def allowed_actions() -> Column:
    """Catalogue actions possible on the row's entity, in catalogue order.

    Needs level, key, channel_id, campaign_id, ad_set_id and ``protected``.
    """
    params = params_for()

    def allowed(name: str) -> Column:
        spec = C.ACTIONS[name]
        ok = F.col("level").isin(*spec.levels)
        for param in spec.params:
            if param != "direction":  # always derivable
                ok = ok & F.coalesce(params[param] != "", F.lit(False))
        return ok & ~F.col("protected") if name in C.HALTING_ACTIONS else ok

    return F.array_compact(F.array(*[F.when(allowed(n), F.lit(n)) for n in C.ACTIONS]))


def choose_action(causes: Column, allowed: K.ColumnLike) -> Column:
    """First allowed action over causes in rank order, then the cause's own action order."""
    answers = F.create_map(*[
        x for cause, actions in C.CAUSE_ACTIONS.items()
        for x in (F.lit(cause), F.array(*[F.lit(a) for a in actions]).cast("array<string>"))])
    wanted = F.flatten(F.transform(causes, lambda c: answers[c]))
    return F.try_element_at(
        F.filter(wanted, lambda a: F.array_contains(K.col(allowed), a)), F.lit(1))


def _clamp(value: Column) -> Column:
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), value))


def confidence(
    change_pct: K.ColumnLike, signals: Column, share_pct: K.ColumnLike, trust: K.ColumnLike
) -> Column:
    """0.10 to 1: strength of the move, agreeing signals, dominant share and trust."""
    w = C.CONFIDENCE_WEIGHTS
    strength = F.abs(F.coalesce(K.col(change_pct), F.lit(0.0))) / C.STRONG_CHANGE_PCT
    agreement = (signals - 1) / C.AGREEING_SIGNALS
    share = F.coalesce(F.abs(K.col(share_pct)) / 100, F.lit(C.NEUTRAL_SHARE))
    blended = (
        _clamp(strength) * w["strength"] + _clamp(agreement) * w["agreement"]
        + _clamp(share) * w["share"] + _clamp(K.lookup(C.TRUST_TERM, trust)) * w["trust"])
    return F.bround(C.MIN_CONFIDENCE + (1 - C.MIN_CONFIDENCE) * blended, 4)


def band(priority: K.ColumnLike) -> Column:
    p = K.col(priority)
    return (
        F.when(p >= C.HIGH_PRIORITY, "high").when(p >= C.MEDIUM_PRIORITY, "medium")
        .otherwise("low"))


def stop_condition(watch: Column, metric: Column, baseline: Column, days: Column) -> Column:
    """When to call the change off, in terms of the watched metric."""
    length = days.cast("string")
    gone = WD.filled(C.STOP_CONDITION["gone"], WD.label(watch), length)
    held = WD.filled(
        C.STOP_CONDITION["held"], WD.label(watch), WD.value_text(watch, baseline), length)
    return F.when((watch == metric) & baseline.isNotNull(), held).otherwise(gone)


def recommend(diagnosed: DataFrame) -> DataFrame:
    """Adds confidence, priority, band and the recommendation (null when no action applies)."""
    p = F.col("primary")
    causes = F.transform("hypotheses", lambda h: h["cause"])
    last = F.try_element_at("chain", F.lit(-1))
    base = diagnosed.withColumn("allowed", allowed_actions()).withColumns({
        "action": choose_action(causes, "allowed"),
        "confidence": confidence(
            p["change_pct"], F.size("signals"), last["share_pct"], "trust"),
    })
    by_action = lambda pick: K.lookup(
        {n: pick(a) for n, a in C.ACTIONS.items() if pick(a) is not None}, "action")
    watch = F.coalesce(by_action(lambda a: a.watch), p["metric"])
    days = F.datediff("window_end", "window_start") + 1
    params = F.struct(*[c.alias(n) for n, c in params_for("action").items()])
    statement = F.element_at("hypotheses", 1)["statement"]
    recommendation = F.when(F.col("action").isNotNull(), F.struct(
        F.col("action").alias("action"),
        F.concat_ws(" ", statement, by_action(lambda a: a.answer)).alias("rationale"),
        (F.col("impact") * by_action(lambda a: a.low)).alias("impact_low"),
        (F.col("impact") * by_action(lambda a: a.high)).alias("impact_high"),
        F.col("confidence").alias("confidence"),
        by_action(lambda a: a.risk).alias("risk"), watch.alias("watch"),
        stop_condition(watch, p["metric"], p["baseline"], days).alias("stop_condition"),
        params.alias("params")))
    priority = F.col("impact") * F.col("confidence")
    return base.withColumns({
        "recommendation": recommendation, "priority": priority, "band": band(priority)})
