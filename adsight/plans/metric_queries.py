"""Queries of the metric operators."""

from __future__ import annotations

import datetime as dt
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from adsight.functions import catalogue as C
from adsight.functions import kpi as K
from adsight.operators import metrics as M
from adsight.plans.queries import day, query
from adsight.sources import testtables as T

WEEK = (dt.date(2001, 7, 25), T.AS_OF)
PREVIOUS = (dt.date(2001, 7, 18), dt.date(2001, 7, 24))
JULY = (dt.date(2001, 7, 1), T.AS_OF)


def union(frames: list[DataFrame]) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b), frames)


@query("in_period")
def _(spark, sf):
    return M.in_period(T.ad_facts(spark, sf), *WEEK)


@query("entity_filter")
def _(spark, sf):
    ads = T.ad_facts(spark, sf)
    entities = [("account", "all"), ("channel", "meta_ads"), ("campaign", "3"), ("ad_set", "13"),
                ("creative", "23"), ("age_group", "13|45+")]
    return union([
        M.entity_filter(ads, level, key).agg(*M.ad_sums(), F.count(F.lit(1)).alias("rows"))
        .select(F.lit(level).alias("level"), F.lit(key).alias("key"), *C.AD_MEASURES, "rows")
        for level, key in entities
    ]).withColumns({m: F.col(m).cast("double") for m in C.AD_MEASURES})


def doubles(frame: DataFrame, measures=C.AD_MEASURES) -> DataFrame:
    return frame.withColumns({m: F.col(m).cast("double") for m in measures})


@query("web_sources_of")
def _(spark, sf):
    web = M.web_sources_of(T.web_facts(spark, sf))
    return doubles(web.groupBy("level", "key").agg(
        *[F.sum(m).alias(m) for m in C.WEB_MEASURES], F.count(F.lit(1)).alias("rows")),
        C.WEB_MEASURES)


@query("segment_key")
def _(spark, sf):
    return doubles(T.ad_facts(spark, sf).groupBy(M.segment_key().alias("segment"))
                   .agg(*M.ad_sums()))


@query("blend_daily")
def _(spark, sf):
    return doubles(M.blend_daily(T.ad_facts(spark, sf), T.store_facts(spark, sf),
                                 day("2001-06-01"), T.AS_OF),
                   (*C.AD_MEASURES, *C.STORE_MEASURES))


@query("ad_daily")
def _(spark, sf):
    """Every dimension in one pass over the grain."""
    grain = M.entity_daily(T.ad_facts(spark, sf))
    days = M.level_daily(grain)
    label = F.when(F.col("level") == "age_group", F.col("age_group")).otherwise(F.col("key"))
    reach = F.when(F.sum("rows") == F.sum("reach_rows"), F.sum("reach")).alias("reach")
    return doubles(days.groupBy(F.col("level").alias("dimension"), label.alias("key"), "date").agg(
        *[reach if m == "reach" else F.sum(m).alias(m) for m in C.AD_MEASURES]))


@query("reach_sum")
def _(spark, sf):
    ads = T.ad_facts(spark, sf)
    return doubles(ads.rollup("channel_id", "campaign_id").agg(
        *M.ad_sums(), F.count(F.lit(1)).alias("rows")))


@query("entity_daily")
def _(spark, sf):
    return doubles(M.entity_daily(T.ad_facts(spark, sf)).drop("rows", "reach_rows"))


@query("level_daily")
def _(spark, sf):
    days = M.level_daily(M.entity_daily(T.ad_facts(spark, sf)))
    kept = [m for m in C.AD_MEASURES if m != "reach"]
    return doubles(days.select("level", "key", "date", *kept, "rows"), kept)


@query("web_daily")
def _(spark, sf):
    return doubles(M.web_daily(T.web_facts(spark, sf)), C.WEB_MEASURES)


@query("store_daily")
def _(spark, sf):
    return M.store_daily(T.store_facts(spark, sf))


@query("period_totals")
def _(spark, sf):
    return doubles(M.period_totals(T.ad_facts(spark, sf), C.AD_MEASURES, *WEEK))


@query("grouped_totals")
def _(spark, sf):
    return doubles(M.grouped_totals(T.ad_facts(spark, sf), ["campaign_id"], C.AD_MEASURES, *WEEK))


def july_totals(spark, sf):
    return doubles(
        M.entity_totals(T.ad_facts(spark, sf), T.web_facts(spark, sf), T.store_facts(spark, sf),
                        *JULY), C.ALL_MEASURES)


@query("entity_totals")
def _(spark, sf):
    return july_totals(spark, sf)


@query("kpis")
def _(spark, sf):
    totals = july_totals(spark, sf)
    return totals.select("level", "key", *[
        c.alias(n) for n, c in K.kpi_columns(totals.columns).items()])


@query("kpi_series")
def _(spark, sf):
    daily = M.ad_daily(T.ad_facts(spark, sf), "channel").withColumnRenamed("key", "channel_id")
    return M.kpi_series(daily).drop(*C.AD_MEASURES)


@query("change_pct")
def _(spark, sf):
    sums = T.ad_facts(spark, sf).groupBy("campaign_id").agg(
        *M.sums_between(("spend",), *PREVIOUS, "p_"), *M.sums_between(("spend",), *WEEK, "c_"))
    both = sums.select("campaign_id", F.col("p_spend").cast("double").alias("previous"),
                       F.col("c_spend").cast("double").alias("current"))
    return both.withColumn("change_pct", K.change_pct("previous", "current"))


@query("kpi_catalogue")
def _(spark, sf):
    """Each metric's definition with the number of days the facts can supply it."""
    days = (
        M.ad_daily(T.ad_facts(spark, sf))
        .unionByName(M.store_daily(T.store_facts(spark, sf)), allowMissingColumns=True)
        .unionByName(M.web_daily(T.web_facts(spark, sf)).drop("source"), allowMissingColumns=True)
        .groupBy("date").agg(*[F.sum(m).alias(m) for m in C.ALL_MEASURES])
    )
    known = days.agg(*[
        F.count(K.metric_value(m, F.col)).alias(m) for m in C.METRICS])

    def row(metric):
        kpi = C.KPIS.get(metric)
        return F.struct(
            F.lit(metric).alias("metric"),
            F.lit(kpi and kpi.numerator).cast("string").alias("numerator"),
            F.lit(kpi and kpi.denominator).cast("string").alias("denominator"),
            F.lit(kpi and kpi.scale).cast("double").alias("scale"),
            F.lit(C.direction(metric)).cast("boolean").alias("higher_is_better"),
            F.lit(C.label(metric)).alias("label"),
            F.lit(C.needs_tracking(metric)).alias("needs_tracking"),
            F.col(metric).alias("days_known"))

    return known.select(F.inline(F.array(*[row(m) for m in C.METRICS])))


def channel_days(spark, sf):
    return M.ad_daily(T.ad_facts(spark, sf), "channel").withColumnRenamed("key", "channel_id")


@query("break_even_roas")
def _(spark, sf):
    roas = channel_days(spark, sf).select(
        "date", "channel_id", K.ratio("platform_revenue", "spend").alias("roas"))
    margin = F.lit(T.SETTINGS.gross_margin_pct)
    return roas.withColumns({
        "break_even": K.break_even_roas(margin),
        "profitable": K.is_profitable_roas("roas", margin)})


@query("goal_status")
def _(spark, sf):
    days = channel_days(spark, sf)
    cpa, roas = K.ratio("spend", "platform_conversions"), K.ratio("platform_revenue", "spend")
    return days.select(
        "date", "channel_id", cpa.alias("cpa"),
        K.goal_status(cpa, F.lit(T.SETTINGS.target_cpa), False).alias("cpa_status"),
        roas.alias("roas"), K.goal_status(roas, F.lit(T.SETTINGS.target_roas)).alias("roas_status"))


@query("prorated_target")
def _(spark, sf):
    return T.store_facts(spark, sf).select(
        "date", "revenue",
        K.prorated_target(F.lit(T.SETTINGS.monthly_revenue_goal), F.dayofmonth("date"), "date")
        .alias("due"))


@query("account_targets")
def _(spark, sf):
    return T.store_facts(spark, sf).select(
        "date", F.inline(M.account_targets(T.SETTINGS, F.col("date"))))


@query("today_kpis")
def today(spark, sf):
    return M.today_kpis(T.ad_facts(spark, sf), T.store_facts(spark, sf), T.AS_OF, T.SETTINGS)


@query("trend_30d")
def _(spark, sf):
    return M.trend(T.ad_facts(spark, sf), T.store_facts(spark, sf), T.AS_OF)


@query("metric_series")
def _(spark, sf):
    ads, store = T.ad_facts(spark, sf), T.store_facts(spark, sf)
    return union([
        M.metric_series(ads, store, "cpa", T.AS_OF, 30, dimension)
        .withColumn("dimension", F.lit(dimension)) for dimension in ("channel", "campaign")])
