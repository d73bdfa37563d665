"""The detectors: windows of summed measures in, signals out."""

from __future__ import annotations

import datetime as dt
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from adsight.functions import catalogue as C
from adsight.functions import kpi as K
from adsight.operators import metrics as M
from adsight.operators import windows as W

PATH_KEYS = ["level", "key", "channel_id", "campaign_id", "ad_set_id", "creative_id"]
SIGNAL_COLUMNS = [
    "as_of", "id", "detector", "metric", "level", "key", "entity_id", "channel_id", "campaign_id",
    "ad_set_id", "ancestors", "window_start", "window_end", "current", "baseline", "change_pct",
    "adverse", "measures", "baseline_measures",
]


@dataclass(frozen=True)
class Thresholds:
    """What a movement has to clear; the defaults are the engine's own."""

    min_sample: dict[str, float] = field(default_factory=lambda: dict(C.MIN_SAMPLE))
    min_change_pct: float = C.MIN_CHANGE_PCT
    min_divergence_pct: float = C.MIN_DIVERGENCE_PCT
    min_funnel_pct: float = C.MIN_FUNNEL_PCT
    min_score: float = C.MIN_SCORE
    min_orders: float = C.MIN_WINDOW_ORDERS


# --- window frames ------------------------------------------------------------------------
def top_windows(
    grain: DataFrame, web: DataFrame, store: DataFrame, start: dt.date, end: dt.date
) -> DataFrame:
    """Account and channel windows over ad, web and store measures side by side.

    Unioned day rows meet in one aggregation; only these two levels can carry web and store
    measures, so the wide frame stays at one row per channel and day.
    """
    sites = M.web_sources_of(web).filter(F.col("level").isin("account", "channel"))
    shop = M.store_daily(store).withColumns({"level": F.lit("account"), "key": F.lit("all")})
    rows = (
        M.level_daily(grain, ("account", "channel"))
        .select("level", "key", "date", *C.AD_MEASURES)
        .unionByName(sites.select("level", "key", "date", *C.WEB_MEASURES),
                     allowMissingColumns=True)
        .unionByName(shop, allowMissingColumns=True)
    )
    daily = rows.groupBy("level", "key", "date").agg(*[F.sum(m).alias(m) for m in C.ALL_MEASURES])
    found = W.detection_windows(daily, ["level", "key"], C.ALL_MEASURES, start, end)
    channel = F.when(F.col("level") == "channel", F.col("key"))
    return found.withColumn("channel_id", channel).withColumns(
        {c: F.lit(None).cast("string") for c in PATH_KEYS[3:]})


def deep_windows(grain: DataFrame, start: dt.date, end: dt.date) -> DataFrame:
    """Campaign, ad set and creative windows over the ad measures."""
    daily = M.level_daily(grain, ("campaign", "ad_set", "creative"))
    return W.detection_windows(daily, PATH_KEYS, C.AD_MEASURES, start, end)


def segment_windows(grain: DataFrame, start: dt.date, end: dt.date) -> DataFrame:
    """Age-group windows; only the current one is read downstream."""
    daily = M.level_daily(grain, ("age_group",))
    return W.detection_windows(daily, PATH_KEYS, C.AD_MEASURES, start, end)


# --- building blocks ------------------------------------------------------------------------
# Candidate expressions are SQL text: dozens of metrics times windows are parsed in one call
# instead of being assembled from thousands of small Column objects.
def of(prefix: str, available: list[str]) -> Callable[[str], str]:
    """Measure look-up by window prefix (SQL text); a measure the frame lacks is null."""
    return lambda m: (
        f"cast({prefix}_{m} as double)" if f"{prefix}_{m}" in available else "cast(null as double)")


def value(metric: str, measures: Callable[[str], str], days: int) -> str:
    """A metric over a window as SQL text: a ratio of sums, or a measure per day."""
    if metric not in C.KPIS:
        return f"{measures(metric)} / {days}"
    kpi = C.KPIS[metric]
    ratio = f"try_divide({measures(kpi.numerator)}, {measures(kpi.denominator)})"
    return ratio if kpi.scale == 1.0 else f"{ratio} * {kpi.scale}D"


def enough_sample(metric: str, measures: Callable[[str], str], floors: dict[str, float]) -> str:
    """Both sides of the metric reach their own floor in the current window (SQL text)."""
    needed = {C.backing(side): floors.get(C.backing(side), 0.0) for side in C.sides(metric)}
    tests = [f"coalesce({measures(m)}, 0D) >= {low}D" for m, low in needed.items() if low > 0]
    return " and ".join(tests) or "true"


def noise_floor(metric: str, measures: Callable[[str], str], floor: float) -> str:
    """How big a move has to be before this much data can tell it from luck (SQL text)."""
    counted = [C.backing(s) for s in C.sides(metric)]
    counts = [
        f"if({measures(m)} > 0, {measures(m)}, null)"
        for m in counted if m in C.MIN_SAMPLE and m != "spend"
    ]
    if not counts:
        return f"{floor}D"
    scarcest = counts[0] if len(counts) == 1 else f"least({', '.join(counts)})"
    noise = f"{C.NOISE_SIGMAS * 100}D / sqrt({scarcest})"
    return f"coalesce(greatest({floor}D, {noise}), {floor}D)"


def stands_out(current: str, weeks: list[str], margin_pct: float = C.MIN_MARGIN_PCT) -> str:
    """Outside every known week of history; under three weeks give the benefit of doubt."""
    known = " + ".join(f"cast({w} is not null as int)" for w in weeks)
    margin, listed = 1 + margin_pct / 100, ", ".join(weeks)
    return (f"({known} < {C.MIN_WEEKS} or {current} > greatest({listed}) * {margin}D "
            f"or {current} < least({listed}) / {margin}D)")


def measure_struct(measures: Callable[[str], str]) -> str:
    return "named_struct(" + ", ".join(f"'{m}', {measures(m)}" for m in C.ALL_MEASURES) + ")"


def boolean(flag: bool | None) -> str:
    return "cast(null as boolean)" if flag is None else str(flag).lower()


def entity_id(level: str = "level", key: str = "key") -> Column:
    """Level and path of an entity: external ids are unique under their parent only."""
    own = F.col(level)
    above = lambda column, *levels: F.when(own.isin(*levels), F.col(column))
    path = F.concat_ws(
        "/", above("channel_id", "campaign", "ad_set", "creative", "age_group"),
        above("campaign_id", "ad_set", "creative", "age_group"),
        above("ad_set_id", "creative"), F.col(key))
    return F.concat_ws(":", own, path)


def ancestors() -> Column:
    """Entity ids above the row's entity, top down."""
    level = F.col("level")
    above = lambda name, *path: F.concat(F.lit(name + ":"), F.concat_ws("/", *path))
    deep = level.isin("creative", "age_group")
    return F.array_compact(F.array(
        F.when(level != "account", "account:all"),
        F.when(~level.isin("account", "channel"), above("channel", "channel_id")),
        F.when(deep | (level == "ad_set"), above(
            "campaign", "channel_id", "campaign_id")),
        F.when(deep, above("ad_set", "channel_id", "campaign_id", "ad_set_id")),
    ))


def signal_id() -> Column:
    tag = K.lookup(C.DETECTOR_TAGS, "detector")
    return F.concat_ws("|", tag, entity_id(), "metric", F.date_format("window_end", "yyyyMMdd"))


def as_signals(found: DataFrame) -> DataFrame:
    """Adds the window, the entity's place in the hierarchy and the signal id."""
    placed = found.withColumns({
        "window_start": F.date_sub("as_of", C.WINDOW_DAYS - 1),
        "window_end": F.col("as_of"),
        "entity_id": entity_id(),
        "ancestors": ancestors(),
    })
    return placed.withColumn("id", signal_id()).select(*SIGNAL_COLUMNS)


@dataclass(frozen=True)
class Rule:
    """One comparison to try: which detector, on which metric, where, and how big a move counts."""

    detector: str
    metric: str
    applies: str
    min_change: float
    adverse_only: bool = False


def candidate(
    detector: str, metric: str, ready: str, current: str, baseline: str, *, floor: str = "0D",
    better_up: bool | None = None, adverse_only: bool = False, forced: bool = False,
    weeks: list[str] | None = None,
) -> str:
    """One possible signal of a row as a struct, null unless ``ready`` (SQL text).

    ``forced`` findings are adverse by definition and carry no baseline measures.
    """
    history = weeks or ["cast(null as double)"] * len(W.WEEKS)
    weekly = ", ".join(f"'{w}', {v}" for w, v in zip(W.WEEKS, history, strict=True))
    return (
        f"if({ready}, named_struct('detector', '{detector}', 'metric', '{metric}', "
        f"'current', {current}, 'baseline', cast({baseline} as double), 'floor', {floor}, "
        f"'better_up', {boolean(better_up)}, 'adverse_only', {boolean(adverse_only)}, "
        f"'forced', {boolean(forced)}, {weekly}), null)")


def fire(frame: DataFrame, candidates: list[str], against: str = "base") -> DataFrame:
    """Signals of all candidates in one pass over a frame of windows.

    Candidates become rows carrying plain columns, so the tests run as one generated filter.
    """
    columns = frame.columns
    now, before = measure_struct(of("cur", columns)), measure_struct(of(against, columns))
    rows = frame.selectExpr(
        "as_of", *PATH_KEYS, f"{now} as measures", f"{before} as before_measures",
        # The outer form keeps Spark from inferring a filter that evaluates candidates twice.
        f"inline_outer(array_compact(array({', '.join(candidates)})))")
    change = rows.selectExpr(
        "*", "try_divide(current - baseline, abs(baseline)) * 100 as change_pct")
    kept = change.filter(
        f"current is not null and abs(change_pct) >= floor and "
        f"{stands_out('current', list(W.WEEKS))}")
    return as_signals(kept.selectExpr(
        "*", "forced or coalesce((change_pct < 0) = better_up, false) as adverse",
        "if(forced, null, before_measures) as baseline_measures",
    ).filter("adverse or not adverse_only"))


def rule_candidates(
    columns: list[str], rules: list[Rule], floors: dict[str, float], against: str = "base",
    weeks: bool = True,
) -> list[str]:
    """Comparisons of the current window with another one."""
    now, before = of("cur", columns), of(against, columns)
    before_days = C.BASELINE_DAYS if against == "base" else C.WINDOW_DAYS
    return [
        candidate(
            r.detector, r.metric, f"{r.applies} and {enough_sample(r.metric, now, floors)}",
            value(r.metric, now, C.WINDOW_DAYS), value(r.metric, before, before_days),
            floor=noise_floor(r.metric, now, r.min_change), better_up=C.direction(r.metric),
            adverse_only=r.adverse_only,
            weeks=[value(r.metric, of(w, columns), C.WINDOW_DAYS) for w in W.WEEKS]
            if weeks else None)
        for r in rules]


def compare(
    frame: DataFrame, rules: list[Rule], floors: dict[str, float], against: str = "base",
    weeks: bool = True,
) -> DataFrame:
    return fire(frame, rule_candidates(frame.columns, rules, floors, against, weeks), against)


def breach_candidate(
    columns: list[str], metric: str, applies: str, target: str, higher: bool,
    floors: dict[str, float],
) -> str:
    """A metric behind its target column; a cost of zero or less is never behind."""
    now = of("cur", columns)
    current = value(metric, now, C.WINDOW_DAYS)
    share = f"try_divide({current}, {target})" if higher else (
        f"if({current} > 0, try_divide({target}, {current}), null)")
    behind = f"coalesce({share} < {1 - C.GOAL_TOLERANCE}D, false)"
    ready = f"{applies} and {target} > 0 and {enough_sample(metric, now, floors)} and {behind}"
    return candidate("goal_breach", metric, ready, current, target, forced=True)


# --- the detectors --------------------------------------------------------------------------
def channel_rules(t: Thresholds) -> list[Rule]:
    on = "level = 'channel'"
    return [Rule("baseline_change", m, on, t.min_change_pct) for m in C.LEVEL_METRICS["channel"]]


def deep_rules(t: Thresholds) -> list[Rule]:
    lower = ("campaign", "ad_set", "creative")
    levels: dict[str, list[str]] = {}
    for level in lower:
        for metric in C.LEVEL_METRICS[level]:
            levels.setdefault(metric, []).append(level)
    return [
        Rule("baseline_change", metric, f"level in {tuple(where) + ('',)}", t.min_change_pct)
        for metric, where in levels.items()]


def account_rules(t: Thresholds) -> list[Rule]:
    on = "level = 'account'"
    return [Rule("baseline_change", m, on, t.min_change_pct) for m in C.ACCOUNT_METRICS]


def funnel_rules(t: Thresholds) -> list[Rule]:
    return [Rule("funnel_drop", m, "true", t.min_funnel_pct, True) for m in C.FUNNEL_METRICS]


def baseline_change(top: DataFrame, deep: DataFrame, t: Thresholds = Thresholds()) -> DataFrame:
    """The recent week against its 28-day baseline, at every level below the account."""
    return compare(top, channel_rules(t), t.min_sample).unionByName(
        compare(deep, deep_rules(t), t.min_sample))


def account_change(top: DataFrame, t: Thresholds = Thresholds()) -> DataFrame:
    """The blended account metrics against their baseline."""
    return compare(top, account_rules(t), t.min_sample)


def with_targets(top: DataFrame, settings: M.Settings | None) -> DataFrame:
    """Adds the account's goals of the window's month as ``target_`` columns."""
    targets = M.account_targets(settings, F.col("as_of"))
    return top.withColumns({
        f"target_{m}": M.target_of(targets, m) / (1 if m in C.KPIS else C.WINDOW_DAYS)
        for m in C.ACCOUNT_METRICS})


def goal_candidates(columns: list[str], t: Thresholds) -> list[str]:
    return [
        breach_candidate(columns, m, "level = 'account'", f"target_{m}", C.direction(m),
                         t.min_sample) for m in C.ACCOUNT_METRICS]


def goal_breach(
    top: DataFrame, settings: M.Settings | None, t: Thresholds = Thresholds()
) -> DataFrame:
    """Account metrics behind their target."""
    named = with_targets(top, settings)
    return fire(named, goal_candidates(named.columns, t))


def with_budget(top: DataFrame, budgets: DataFrame) -> DataFrame:
    """Adds the channel's budget. ``budgets``: (channel_id, budget), optionally by ``month``."""
    keys = ["channel_id"]
    if "month" in budgets.columns:
        top = top.withColumn("month", F.date_format("as_of", "yyyy-MM"))
        keys.append("month")
    return top.join(budgets, keys, "left")


def spend_candidate(columns: list[str], t: Thresholds) -> str:
    allowed = "(budget / day(last_day(as_of)))"
    return breach_candidate(columns, "spend", "level = 'channel'", allowed, False, t.min_sample)


def overspend(top: DataFrame, budgets: DataFrame, t: Thresholds = Thresholds()) -> DataFrame:
    """Channels spending more a day than the month's budget allows."""
    known = with_budget(top.filter("level = 'channel'"), budgets)
    return fire(known, [spend_candidate(known.columns, t)])


def funnel_drop(top: DataFrame, t: Thresholds = Thresholds()) -> DataFrame:
    """Site funnel steps that got worse, for the account and each channel's paid sessions."""
    return compare(top, funnel_rules(t), t.min_sample)


def segment_vs_peers(segments: DataFrame) -> DataFrame:
    """Adds ``peer_`` measures: the pooled rest of the segment's ad set, without a join."""
    by_ad_set = "partition by as_of, channel_id, campaign_id, ad_set_id"
    return segments.selectExpr("*", *[
        f"if(cur_{m} is null, null, sum(cur_{m}) over ({by_ad_set}) - cur_{m}) as peer_{m}"
        for m in C.AD_MEASURES])


def segment_divergence(segments: DataFrame, t: Thresholds = Thresholds()) -> DataFrame:
    """Age groups doing worse than the rest of their ad set."""
    rules = [Rule("segment_divergence", m, "true", t.min_divergence_pct, True)
             for m in C.SEGMENT_METRICS]
    return compare(segment_vs_peers(segments), rules, t.min_sample, against="peer", weeks=False)


def with_verdicts(top: DataFrame, tracking: DataFrame) -> DataFrame:
    """Adds the channel's tracking verdict of the day."""
    verdicts = tracking.select("as_of", "channel_id", "status", "ratio_change")
    return top.join(verdicts, ["as_of", "channel_id"], "left")


TRACKING_CANDIDATE = candidate(
    "tracking_break", "platform_conversions", "level = 'channel' and status <> 'ok'",
    "ratio_change", "1D", forced=True)


def tracking_break(tracking: DataFrame, top: DataFrame) -> DataFrame:
    """Tracking verdicts that are not ok, as signals."""
    return fire(with_verdicts(top.filter("level = 'channel'"), tracking), [TRACKING_CANDIDATE])


def detect(
    ads: DataFrame, web: DataFrame, store: DataFrame, tracking: DataFrame,
    budgets: DataFrame, settings: M.Settings | None, start: dt.date, end: dt.date,
    t: Thresholds = Thresholds(),
) -> DataFrame:
    """Every raw signal for every as-of date of a range (one day: start = end).

    Three readers (top levels, deep levels, segments) share one grain aggregation, whose shuffle
    Spark reuses; each of them is passed over once for all of its detectors.
    """
    first = start - dt.timedelta(days=W.REACH - 1)
    grain = M.entity_daily(M.in_period(ads, first, end))
    top = with_verdicts(with_budget(with_targets(
        top_windows(grain, web, store, start, end), settings), budgets), tracking)
    rules = account_rules(t) + channel_rules(t) + funnel_rules(t)
    known = top.columns
    found = fire(top, [
        *rule_candidates(known, rules, t.min_sample), *goal_candidates(known, t),
        spend_candidate(known, t), TRACKING_CANDIDATE])
    deep = compare(deep_windows(grain, start, end), deep_rules(t), t.min_sample)
    segments = segment_divergence(segment_windows(grain, start, end), t)
    return found.unionByName(deep).unionByName(segments)
