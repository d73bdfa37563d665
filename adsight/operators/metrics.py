"""Sums, blended days, KPI summaries and series over the daily facts.

Shared shape rules: money and conversions are summed as decimals (exact in any order) and only
the sums become doubles; ratios are always ratios of sums.
"""

from __future__ import annotations

import datetime as dt
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from adsight.functions import catalogue as C
from adsight.functions import kpi as K
from adsight.functions import periods as P

PATH = ("channel_id", "campaign_id", "ad_set_id", "creative_id", "age_group")
KEY_COLUMN = {
    "channel": "channel_id",
    "campaign": "campaign_id",
    "ad_set": "ad_set_id",
    "creative": "creative_id",
    "age_group": "age_group",
}


@dataclass(frozen=True)
class Settings:
    """Account goals; absent ones have no target."""

    gross_margin_pct: float
    target_roas: float | None = None
    target_cpa: float | None = None
    monthly_revenue_goal: float | None = None


# --- filters and keys -------------------------------------------------------------------
def in_period(facts: DataFrame, start: dt.date, end: dt.date) -> DataFrame:
    """Rows of an inclusive date range (literal bounds reach the Parquet scan)."""
    return facts.filter(F.col("date").between(F.lit(start), F.lit(end)))


def segment_key() -> Column:
    """Age-group key, unique per ad set."""
    return F.concat_ws("|", "ad_set_id", "age_group")


def entity_filter(ads: DataFrame, level: str, key: str) -> DataFrame:
    """Ad rows of one entity; the account keeps everything."""
    if level == "age_group":
        ad_set, _, age_group = key.partition("|")
        return ads.filter((F.col("ad_set_id") == ad_set) & (F.col("age_group") == age_group))
    return ads if level == "account" else ads.filter(F.col(KEY_COLUMN[level]) == key)


def web_channel(source: K.ColumnLike = "source") -> Column:
    """The channel that pays for a session source; null for organic ones."""
    return K.lookup(C.PAID_WEB_SOURCES, source)


def web_sources_of(web: DataFrame) -> DataFrame:
    """Web rows once per entity they belong to: the account, their source, their channel."""
    entities = F.array_compact(F.array(
        F.struct(F.lit("account").alias("level"), F.lit("all").alias("key")),
        F.struct(F.lit("source").alias("level"), F.col("source").alias("key")),
        F.when(web_channel().isNotNull(),
               F.struct(F.lit("channel").alias("level"), web_channel().alias("key"))),
    ))
    return web.select("*", F.inline(entities))


# --- aggregations -----------------------------------------------------------------------
def reach_sum() -> Column:
    """Reach only when every row reports it: a partial sum would inflate frequency."""
    return F.when(F.count("reach") == F.count(F.lit(1)), F.sum("reach"))


def ad_sums() -> list[Column]:
    return [
        (reach_sum() if m == "reach" else F.sum(m)).alias(m) for m in C.AD_MEASURES
    ]


def ad_daily(ads: DataFrame, dimension: str | None = None) -> DataFrame:
    """Ad measures per day, or per day and value of a dimension (column ``key``)."""
    keys = ["date"]
    if dimension is not None:
        ads = ads.withColumn("key", F.col(KEY_COLUMN[dimension]))
        keys.append("key")
    return ads.groupBy(*keys).agg(*ad_sums())


def entity_daily(ads: DataFrame) -> DataFrame:
    """The detectors' grain: day x channel x campaign x ad set x creative x age group.

    Names are left to the dimensions, so this stays a hash aggregation on ids.
    """
    return ads.groupBy("date", *PATH).agg(
        *ad_sums(), F.count(F.lit(1)).alias("rows"), F.count("reach").alias("reach_rows"))


def web_daily(web: DataFrame) -> DataFrame:
    return web.groupBy("date", "source").agg(*[F.sum(m).alias(m) for m in C.WEB_MEASURES])


def store_daily(store: DataFrame) -> DataFrame:
    return store.select(
        "date", F.col("orders").alias("store_orders"), F.col("revenue").alias("store_revenue"))


def level_daily(grain: DataFrame, levels: tuple[str, ...] | None = None) -> DataFrame:
    """Measures per day for every entity of every level, in one GROUPING SETS aggregation.

    Reads the detectors' grain, so the sixfold expansion works on pre-aggregated rows. The
    path columns above an entity are filled, those below are null; ``level`` and ``key`` name it.
    """
    # Grouping bit masks over (date, channel, campaign, ad set, creative, age group).
    sets = {
        "account": (["date"], 31),
        "channel": (["date", "channel_id"], 15),
        "campaign": (["date", "channel_id", "campaign_id"], 7),
        "ad_set": (["date", "channel_id", "campaign_id", "ad_set_id"], 3),
        "creative": (["date", "channel_id", "campaign_id", "ad_set_id", "creative_id"], 1),
        "age_group": (["date", "channel_id", "campaign_id", "ad_set_id", "age_group"], 2),
    }
    wanted = levels or tuple(sets)
    gid = F.grouping_id()
    level = F.lit(None).cast("string")
    for name in wanted:
        level = F.when(gid == sets[name][1], name).otherwise(level)
    columns = ["date", *PATH]
    rolled = grain.groupingSets(
        [[F.col(c) for c in sets[name][0]] for name in wanted], *[F.col(c) for c in columns]
    ).agg(
        level.alias("level"),
        *[F.sum(m).alias(m) for m in C.AD_MEASURES],
        F.sum("rows").alias("rows"),
        F.sum("reach_rows").alias("reach_rows"),
    )
    key = (
        F.when(F.col("level") == "account", "all")
        .when(F.col("level") == "age_group", segment_key())
        .otherwise(F.coalesce("creative_id", "ad_set_id", "campaign_id", "channel_id"))
    )
    return rolled.withColumn("key", key)


def sums_between(
    measures: tuple[str, ...], start: P.Day, end: P.Day, prefix: str = ""
) -> list[Column]:
    """Conditional sums over a period; a measure with no rows stays null."""
    if isinstance(start, dt.date) and isinstance(end, dt.date):
        return [
            F.expr(f"sum(if(date between date'{start}' and date'{end}', {m}, null)) as {prefix}{m}")
            for m in measures]
    inside = P.between("date", start, end)
    return [F.sum(F.when(inside, F.col(m))).alias(prefix + m) for m in measures]


def period_totals(
    daily: DataFrame, measures: tuple[str, ...], start: P.Day, end: P.Day
) -> DataFrame:
    return daily.agg(*sums_between(measures, start, end))


def grouped_totals(
    daily: DataFrame, keys: list[str], measures: tuple[str, ...], start: dt.date, end: dt.date
) -> DataFrame:
    return in_period(daily, start, end).groupBy(*keys).agg(*[F.sum(m).alias(m) for m in measures])


def entity_days(
    ads: DataFrame, web: DataFrame, store: DataFrame, levels: tuple[str, ...] | None = None
) -> DataFrame:
    """One row per (level, key, date, table) with every measure that table has for the entity."""
    from_ads = level_daily(entity_daily(ads), levels).select(
        "level", "key", "date", *C.AD_MEASURES, "rows", "reach_rows", F.lit(1).alias("ad_day"))
    from_web = web_sources_of(web).groupBy("level", "key", "date").agg(
        *[F.sum(m).alias(m) for m in C.WEB_MEASURES], F.lit(1).alias("web_day"))
    from_store = store_daily(store).select(
        F.lit("account").alias("level"), F.lit("all").alias("key"), "date",
        *C.STORE_MEASURES, F.lit(1).alias("store_day"))
    return from_ads.unionByName(from_web, allowMissingColumns=True).unionByName(
        from_store, allowMissingColumns=True)


def totals_of_days() -> list[Column]:
    """Window totals over ``entity_days`` rows, with strict reach and the days covered."""
    reach = F.when(F.sum("rows") == F.sum("reach_rows"), F.sum("reach")).alias("reach")
    return [
        *[reach if m == "reach" else F.sum(m).alias(m) for m in C.ALL_MEASURES],
        F.coalesce(
            F.greatest(F.sum("ad_day"), F.sum("web_day"), F.sum("store_day")), F.lit(0)
        ).alias("days"),
    ]


def entity_totals(
    ads: DataFrame, web: DataFrame, store: DataFrame, start: dt.date, end: dt.date
) -> DataFrame:
    """Every entity's measures over a period and the days with rows behind them."""
    days = entity_days(
        in_period(ads, start, end), in_period(web, start, end), in_period(store, start, end))
    return days.groupBy("level", "key").agg(*totals_of_days())


def entity_window_totals(requests: DataFrame, days: DataFrame, keys: list[str]) -> DataFrame:
    """Totals for many (level, key, start, end) requests at once.

    Equal windows are totalled once, however many requests share them. A window is spread over its
    days and meets the facts in an equi-join on entity and day, so neither side is broadcast and
    no range join is planned; requests then meet their window's one row.
    """
    window = ["level", "key", "start", "end"]
    spread = requests.select(*window).distinct().select(
        *window, F.explode(F.sequence("start", "end")).alias("date"))
    totals = spread.join(days, ["level", "key", "date"], "left").groupBy(*window).agg(
        *totals_of_days())
    return requests.select(*keys, *window).join(totals, window)


# --- calendars and blended days -----------------------------------------------------------
def calendar(spark, start: dt.date, end: dt.date) -> DataFrame:
    """Every day of a span."""
    one = spark.range(1)
    return one.select(F.explode(F.sequence(F.lit(start), F.lit(end))).alias("date"))


def densify_calendar(frame: DataFrame, keys: list[str], start: dt.date, end: dt.date) -> DataFrame:
    """Give every key a row for every day of a span; missing days carry nulls."""
    spine = frame.select(*keys).distinct().select(
        *keys, F.explode(F.sequence(F.lit(start), F.lit(end))).alias("date"))
    return spine.join(frame, [*keys, "date"], "left")


def blend_daily(ads: DataFrame, store: DataFrame, start: dt.date, end: dt.date) -> DataFrame:
    """Ad and store measures side by side per day, with every day of the span present.

    A union under one aggregation does the outer join and the calendar fill in one shuffle of
    at most three rows per day.
    """
    parts = (
        ad_daily(in_period(ads, start, end))
        .unionByName(store_daily(in_period(store, start, end)), allowMissingColumns=True)
        .unionByName(calendar(ads.sparkSession, start, end), allowMissingColumns=True)
    )
    return parts.groupBy("date").agg(
        *[F.sum(m).alias(m) for m in (*C.AD_MEASURES, *C.STORE_MEASURES)])


def kpi_series(daily: DataFrame) -> DataFrame:
    """KPI columns beside the measures of each row."""
    return daily.withColumns(K.kpi_columns(daily.columns))


def account_targets(settings: Settings | None, as_of: P.Day) -> Column:
    """Array of (metric, target) for a seven-day window; goals that are unset are absent."""
    goals = settings or Settings(gross_margin_pct=0.0)
    optional = lambda v: F.lit(v).cast("double")
    pairs = {
        "mer": K.break_even_roas(optional(settings and goals.gross_margin_pct)),
        "roas": optional(goals.target_roas),
        "cpa": optional(goals.target_cpa),
        "store_revenue": K.prorated_target(
            optional(goals.monthly_revenue_goal), C.WINDOW_DAYS, P.day(as_of)),
    }
    return F.array_compact(F.array(*[
        F.when(value.isNotNull(), F.struct(F.lit(m).alias("metric"), value.alias("target")))
        for m, value in pairs.items()
    ]))


def target_of(targets: Column, metric: str) -> Column:
    return F.try_element_at(
        F.transform(F.filter(targets, lambda t: t["metric"] == metric), lambda t: t["target"]),
        F.lit(1))


def today_kpis(
    ads: DataFrame, store: DataFrame, as_of: dt.date, settings: Settings | None = None,
    broken: DataFrame | None = None,
) -> DataFrame:
    """The five headline metrics for the last 7 days against the 7 before, judged by goal.

    ``broken`` is the list of channels whose tracking is broken (column ``channel_id``).
    """
    start, end = P.trailing_dates(as_of, C.WINDOW_DAYS)
    before_start, before_end = P.trailing_dates(start - dt.timedelta(days=1), C.WINDOW_DAYS)
    daily = blend_daily(ads, store, before_start, end)
    measures = (*C.AD_MEASURES, *C.STORE_MEASURES)
    sums = daily.agg(
        *sums_between(measures, start, end, "now_"),
        *sums_between(measures, before_start, before_end, "before_"))
    if broken is None:
        sums = sums.withColumn("is_broken", F.lit(False))
    else:
        # A global count is one row by construction.
        flag = broken.agg((F.count(F.lit(1)) > 0).alias("is_broken"))
        sums = sums.join(F.broadcast(flag))
    targets = account_targets(settings, as_of)

    def line(metric: str) -> Column:
        now = K.metric_value(metric, lambda m: F.col("now_" + m))
        before = K.metric_value(metric, lambda m: F.col("before_" + m))
        better = C.direction(metric)
        target = target_of(targets, metric)
        return F.struct(
            F.lit(metric).alias("metric"),
            now.alias("value"),
            before.alias("previous"),
            K.change_pct(before, now).alias("change_pct"),
            F.lit(better).cast("boolean").alias("higher_is_better"),
            F.when(now.isNotNull(), target).alias("target"),
            K.goal_status(now, target, better is not False).alias("goal_status"),
            (~(F.lit(metric in C.PLATFORM_METRICS) & F.col("is_broken"))).alias("reliable"),
        )

    return sums.select(F.inline(F.array(*[line(m) for m in C.TODAY_METRICS])))


def trend(ads: DataFrame, store: DataFrame, as_of: dt.date, days: int = 30) -> DataFrame:
    """The headline metrics per day; days without data are null."""
    daily = kpi_series(blend_daily(ads, store, *P.trailing_dates(as_of, days)))
    return daily.select(
        "date", *[F.col(m).cast("double").alias(m) for m in C.TODAY_METRICS])


def metric_series(
    ads: DataFrame, store: DataFrame, metric: str, as_of: dt.date, days: int = 30,
    dimension: str | None = None,
) -> DataFrame:
    """A metric per day (and dimension value), with period total against the period before."""
    start, end = P.trailing_dates(as_of, days)
    before_start, before_end = P.trailing_dates(start - dt.timedelta(days=1), days)
    if dimension is None:
        daily = blend_daily(ads, store, before_start, end).withColumn("key", F.lit("total"))
        measures = (*C.AD_MEASURES, *C.STORE_MEASURES)
    else:
        daily = ad_daily(in_period(ads, before_start, end), dimension)
        # The store cannot be sliced by ad, so blended metrics stay null here.
        daily = daily.withColumns({m: F.lit(None).cast("double") for m in C.STORE_MEASURES})
        measures = C.AD_MEASURES
    by_name = lambda prefix: (
        lambda m: F.col(prefix + m) if m in measures else F.lit(None).cast("double"))
    totals = daily.groupBy("key").agg(
        *sums_between(measures, start, end, "now_"),
        *sums_between(measures, before_start, before_end, "before_"),
    ).select(
        "key",
        K.metric_value(metric, by_name("now_")).alias("period_value"),
        K.metric_value(metric, by_name("before_")).alias("previous_value"),
        F.explode(F.sequence(F.lit(start), F.lit(end))).alias("date"),
    )
    points = in_period(daily, start, end).select(
        "key", "date", K.metric_value(metric, by_name("")).alias("value"))
    return totals.join(points, ["key", "date"], "left").select(
        "key", "date", "value", "period_value", "previous_value",
        K.change_pct("previous_value", "period_value").alias("change_pct"))
