"""Maps the driver's star schema onto the engine's canonical daily facts and stored tables.

Everything grows with the given tables: ad facts come from lineitem, store facts from orders,
web facts from events; stored opportunities come from customer, experiments and decisions from
orders, labelled events from supplier.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from adsight.operators.metrics import Settings

AS_OF = dt.date(2001, 7, 31)
PACING_DAY = dt.date(2001, 7, 20)
SETTINGS = Settings(
    gross_margin_pct=55.0, target_roas=18.0, target_cpa=700.0, monthly_revenue_goal=60_000_000.0)
BUDGETS = {"google_ads": 900_000.0, "meta_ads": 700_000.0}
FESTIVE = [("Spring sale", dt.date(2001, 5, 1), dt.date(2001, 5, 10))]
PROTECTED = ["3"]
AGE_GROUPS = ("18-24", "25-34", "35-44", "45+")


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def pick(values: tuple[str, ...], index: Column) -> Column:
    """The ``index``-th (from 0) of some literal values."""
    return F.element_at(F.array(*[F.lit(v) for v in values]), (index + 1).cast("int"))


def money(column: str) -> Column:
    return F.col(column).cast("decimal(14,2)")


def _text(column: Column) -> Column:
    return column.cast("string")


def ad_facts(spark: SparkSession, sf: str) -> DataFrame:
    """Daily ad facts by creative, age group, device and region."""
    price, discount = "cast(l_extendedprice as decimal(14,2))", "cast(l_discount as decimal(4,2))"
    rows = table(spark, sf, "lineitem").selectExpr(
        "cast(l_shipdate as date) as date",
        "if(l_suppkey % 2 = 0, 'google_ads', 'meta_ads') as channel_id",
        "cast(l_suppkey % 10 as string) as campaign_id",
        "cast(l_suppkey % 40 as string) as ad_set_id",
        "cast(l_suppkey % 80 as string) as creative_id",
        "case l_partkey % 4 when 0 then '18-24' when 1 then '25-34' when 2 then '35-44' "
        "else '45+' end as age_group",
        "if(l_linestatus = 'O', 'mobile', 'desktop') as device",
        "l_returnflag as region",
        "cast(l_quantity as bigint) * 400 as impressions",
        "if(l_suppkey % 2 = 1, cast(l_quantity as bigint) * 300, null) as reach",
        "cast(l_linenumber * 20 + l_partkey % 50 as bigint) as clicks",
        f"cast({price} * {discount} as decimal(18,4)) as spend",
        "cast(cast(l_tax as decimal(4,2)) * 100 as decimal(12,4)) as platform_conversions",
        f"cast({price} * (1 - {discount}) as decimal(18,4)) as platform_revenue",
    )
    keys = ["date", "channel_id", "campaign_id", "ad_set_id", "creative_id", "age_group",
            "device", "region"]
    measures = ["impressions", "reach", "clicks", "spend", "platform_conversions",
                "platform_revenue"]
    return rows.groupBy(*keys).agg(*[F.expr(f"sum({m}) as {m}") for m in measures])


def named_ad_facts(spark: SparkSession, sf: str) -> DataFrame:
    """Ad facts with their display names inline, as a parsed export row carries them."""
    return ad_facts(spark, sf).withColumns({
        level + "_name": F.concat(F.lit(prefix), F.col(level + "_id"))
        for level, prefix in (
            ("campaign", "campaign-"), ("ad_set", "adset-"), ("creative", "creative-"))
    })


def store_facts(spark: SparkSession, sf: str) -> DataFrame:
    orders = table(spark, sf, "orders").select(
        F.col("o_orderdate").cast("date").alias("date"), "o_custkey", "o_orderstatus",
        money("o_totalprice").alias("amount"))
    daily = orders.groupBy("date").agg(
        F.count(F.lit(1)).alias("orders"),
        F.sum("amount").alias("revenue"),
        F.sum(F.when(F.col("o_orderstatus") == "P", F.col("amount"))).alias("refunds"))
    firsts = orders.groupBy("o_custkey").agg(F.min("date").alias("date")).groupBy("date").agg(
        F.count(F.lit(1)).alias("new_customers"))
    return daily.join(firsts, "date", "left").select(
        "date", "orders", "revenue", F.lit(0).cast("decimal(14,2)").alias("discounts"),
        F.coalesce("refunds", F.lit(0).cast("decimal(14,2)")).alias("refunds"),
        F.coalesce("new_customers", F.lit(0).cast("bigint")).alias("new_customers"))


def web_facts(spark: SparkSession, sf: str) -> DataFrame:
    """Thirty days of events stretched over the span of the ad facts, a day per 18 minutes."""
    seconds = F.expr(
        "timestampdiff(SECOND, timestamp_ntz'2024-01-01 00:00:00', cast(ts as timestamp_ntz))")
    kind = F.col("event_type")
    rows = table(spark, sf, "events").select(
        F.date_add(F.lit(dt.date(1995, 1, 5)), F.floor(seconds / 1080).cast("int")).alias("date"),
        pick(("google / cpc", "facebook / paid_social", "instagram / paid_social",
              "(direct) / (none)"), F.col("user_id") % 4).alias("source"),
        F.when(F.col("event_id") % 2 == 0, "mobile").otherwise("desktop").alias("device"),
        kind.alias("kind"), money("value").alias("amount"))
    count = lambda *kinds: F.count(F.when(F.col("kind").isin(*kinds), 1))
    return rows.groupBy("date", "source", "device").agg(
        F.count(F.lit(1)).alias("sessions"),
        count("error").alias("bounces"),
        count("click", "signup", "purchase").alias("add_to_cart"),
        count("signup", "purchase").alias("checkout"),
        count("purchase").alias("purchases"),
        F.coalesce(F.sum(F.when(F.col("kind") == "purchase", F.col("amount"))),
                   F.lit(0).cast("decimal(14,2)")).alias("revenue"))


# --- stored tables ------------------------------------------------------------------------
def opportunities(spark: SparkSession, sf: str) -> DataFrame:
    """A stored opportunity list, one row per customer."""
    k = F.col("c_custkey")
    n = F.floor(k / 4).cast("bigint")
    level = pick(("channel", "campaign", "ad_set", "creative"), k % 4)
    key = (
        F.when(k % 4 == 0, pick(("google_ads", "meta_ads"), n % 2))
        .when(k % 4 == 1, _text(n % 10)).when(k % 4 == 2, _text(n % 40)).otherwise(_text(n % 80))
    )
    channel = F.when(k % 4 == 0, key).otherwise(pick(("google_ads", "meta_ads"), n % 2))
    impact = F.abs(money("c_acctbal")).cast("double") * 20
    confidence = ((k % 90 + 10) / 100.0).cast("double")
    end = F.date_sub(F.lit(AS_OF), (k % 60).cast("int"))
    baseline = (100 + k % 50).cast("double")
    change = money("c_acctbal").cast("double") / 100
    return table(spark, sf, "customer").select(
        k.alias("id"),
        F.concat_ws("", level, F.lit(":"), key, F.lit("#"), _text(k)).alias("key"),
        F.when(F.col("c_mktsegment").isin("BUILDING", "MACHINERY", "HOUSEHOLD"), "issue")
        .otherwise("win").alias("kind"),
        pick(("open", "experimenting", "resolved", "dismissed"), F.col("c_nationkey") % 4)
        .alias("status"),
        level.alias("entity_level"), key.alias("entity_key"), F.col("c_name").alias("entity_name"),
        channel.alias("channel_id"),
        F.when(k % 4 >= 2, _text(n % 10)).alias("campaign_id"),
        F.when(k % 4 == 3, _text(n % 40)).alias("ad_set_id"),
        pick(("cpa", "roas", "ctr", "cpc", "spend", "frequency"), k % 6).alias("primary_metric"),
        impact.alias("impact"), (impact / 2).alias("score"),
        confidence.alias("confidence"),
        F.when(k % 11 != 0, impact * confidence).alias("priority"),
        F.date_sub(end, 6).alias("window_start"), end.alias("window_end"),
        F.date_sub(F.date_sub(end, 6), (k % 15).cast("int")).alias("first_seen_date"),
        end.alias("last_seen_date"),
        baseline.alias("baseline"), (baseline * (1 + change / 100)).alias("current"),
        change.alias("change_pct"),
        pick(("creative_fatigue", "landing_page_break", "cpc_spike", "audience_mismatch",
              "tracking_break", "budget_overpace", "channel_opportunity", "conversion_drop",
              "unknown"), k % 9).alias("cause"),
        pick(("ok", "ok", "warning", "broken"), k % 4).alias("trust"),
        (k % 3 + 1).cast("bigint").alias("signal_count"),
    )


def experiments(spark: SparkSession, sf: str) -> DataFrame:
    """Experiments, one per order, on the opportunity of the ordering customer."""
    k, state = F.col("o_orderkey"), F.col("o_orderstatus")
    started = F.when(state != "P", F.col("o_orderdate").cast("date"))
    done = state == "F"
    baseline = (money("o_totalprice").cast("double") / 1000)
    return table(spark, sf, "orders").select(
        k.alias("id"), F.col("o_custkey").alias("opportunity_id"),
        F.when(state == "O", "running").when(done, "completed")
        .otherwise(pick(("draft", "rejected"), k % 2)).alias("status"),
        pick(("pause_creative", "rotate_creative", "refine_audience", "investigate_landing_page",
              "fix_tracking", "shift_budget", "adjust_pacing"), k % 7).alias("action"),
        pick(("cpa", "roas", "ctr", "cpc", "spend"), k % 5).alias("metric"),
        baseline.alias("baseline"), (baseline * 0.9).alias("target"),
        F.lit(7).alias("duration_days"),
        started.alias("started_on"), F.date_add(started, 7).alias("ends_on"),
        F.when(done, pick(("worked", "did_not_work", "inconclusive"), k % 3)).alias("verdict"),
        F.when(done, baseline).alias("before_value"),
        F.when(done, baseline * (0.8 + (k % 40) / 100.0)).alias("after_value"),
        F.when(done, (k % 8).cast("int")).alias("sample_days"),
        F.when(done, F.date_add(started, 7)).alias("evaluated_on"),
    )


def decisions(spark: SparkSession, sf: str) -> DataFrame:
    """The decision log, one row per order."""
    k, state = F.col("o_orderkey"), F.col("o_orderstatus")
    kind = F.when(state != "P", "approve").when(k % 2 == 1, "reject").otherwise("dismiss")
    return table(spark, sf, "orders").select(
        k.alias("id"), kind.alias("kind"), F.col("o_custkey").alias("opportunity_id"),
        F.when(kind != "dismiss", k).alias("experiment_id"),
        F.when(k % 3 != 0, F.col("o_orderpriority")).alias("reason"),
        money("o_totalprice").cast("double").alias("impact"),
        F.col("o_orderdate").cast("date").alias("created_on"),
    )


def decision_requests(spark: SparkSession, sf: str) -> DataFrame:
    """A log of drafts and decisions asked for, one per order line, on the supplier's opportunity.

    Many come too early, too late or twice, also on one day; ids do not follow the days.
    """
    k = (F.col("l_orderkey") * 8 + F.col("l_linenumber")) * 1_000_000 + F.col("l_partkey")
    return table(spark, sf, "lineitem").select(
        k.alias("id"), F.col("l_suppkey").alias("opportunity_id"),
        F.col("l_shipdate").cast("date").alias("created_on"),
        pick(("draft", "approve", "draft", "reject", "approve", "draft", "dismiss"),
             (F.col("l_orderkey") + F.col("l_linenumber") * 3) % 7).alias("kind"),
        F.when(F.col("l_orderkey") % 3 != 0, F.concat(F.lit("noted "), "l_returnflag")).alias("reason"))


def settings_rows(spark: SparkSession, sf: str) -> DataFrame:
    """One settings row per nation; some margins are out of range, some campaigns unknown."""
    k = F.col("n_nationkey")
    return table(spark, sf, "nation").select(
        k.cast("bigint").alias("business_id"),
        (20 + k * 4).cast("double").alias("gross_margin_pct"),
        (1 + k % 5).cast("double").alias("target_roas"),
        F.array(_text(k), _text(k % 10)).alias("protected"))


EVENT_KINDS = (
    "creative_fatigue", "audience_mismatch", "landing_page_break", "cpc_spike",
    "channel_opportunity", "tracking_break", "budget_overpace", "no_issue")


def labelled_events(spark: SparkSession, sf: str) -> DataFrame:
    """Raw labelled events, one per supplier, in the labelled-events document layout."""
    k = F.col("s_suppkey")
    kind = pick(EVENT_KINDS, k % 8)
    start = F.date_add(F.lit(dt.date(1995, 1, 25)), (k * 97 % 2400).cast("int"))
    level = (
        F.when((kind == "budget_overpace") & (k % 16 == 6), "account")
        .when(kind == "creative_fatigue", "creative")
        .when(kind == "audience_mismatch", "ad_set")
        .when(kind.isin("cpc_spike", "landing_page_break"), "campaign")
        .otherwise("channel"))
    key = (
        F.when(level == "creative", _text(k % 80)).when(level == "ad_set", _text(k % 40))
        .when(level == "campaign", _text(k % 10)))
    return table(spark, sf, "supplier").select(
        F.concat(F.lit("ev-"), _text(k)).alias("id"), kind.alias("type"),
        start.alias("start"), F.date_add(start, (k % 9 + 3).cast("int")).alias("end"),
        F.when(k % 2 == 0, "sudden").otherwise("gradual").alias("onset"),
        F.struct(
            level.alias("level"), key.alias("platform_id"),
            F.when(k % 2 == 0, "google_ads").otherwise("meta_ads").alias("source"),
            F.when(level == "ad_set", pick(AGE_GROUPS, k % 4)).alias("age_group"),
        ).alias("target"),
        F.array(
            F.struct(pick(("cpa", "ctr", "cpc", "roas", "spend"), k % 5).alias("metric")),
            F.struct(F.lit("platform_conversions").alias("metric")),
        ).alias("affected_metrics"),
        pick(("baseline_change", "goal_breach"), k % 2).alias("expected_signal_type"),
        F.when(kind != "no_issue", pick(
            ("rotate_creative", "retarget_audience", "investigate_landing_page", "budget_shift",
             "budget_shift", "fix_tracking", "adjust_pacing", "none"), k % 8))
        .alias("expected_action"),
    )


def alert_sightings(spark: SparkSession, sf: str) -> DataFrame:
    """One row per campaign-day (and channel-day) whose daily CPA left a band: a day's alert list.

    A light-weight stand-in for stored daily opportunity lists, so that the evaluation operators
    can be checked with plain SQL.
    """
    ads = ad_facts(spark, sf)
    daily = (
        ads.select("date", F.explode(F.array(
            F.concat(F.lit("campaign:"), F.concat_ws("/", "channel_id", "campaign_id")),
            F.concat(F.lit("channel:"), "channel_id"),
            F.concat(F.lit("creative:"), F.concat_ws(
                "/", "channel_id", "campaign_id", "ad_set_id", "creative_id")))).alias("entity"), "channel_id", "spend",
            "platform_conversions", "clicks")
        .groupBy("entity", "channel_id", "date")
        .agg(F.sum("spend").cast("double").alias("spend"),
             F.sum("platform_conversions").cast("double").alias("conversions"),
             F.sum("clicks").alias("clicks"))
    )
    cpa = F.try_divide(F.col("spend"), F.col("conversions"))
    return daily.filter((cpa > 800) | (cpa < 350)).select(
        F.col("date").alias("as_of"), F.col("entity").alias("key"), "entity", "channel_id",
        F.when(cpa > 800, "issue").otherwise("win").alias("kind"),
        F.date_sub("date", 6).alias("window_start"), F.col("date").alias("window_end"),
        F.array(F.lit("cpa"), pick(("roas", "ctr", "cpc"), F.col("clicks") % 3)).alias("metrics"),
        F.array(pick(("baseline_change", "goal_breach", "tracking_break"), F.col("clicks") % 3))
        .alias("detectors"),
        F.col("spend").alias("score"),
    )


# Minimum samples a tenth of the engine's own, because the test tables are small.
def thresholds():
    from adsight.functions import catalogue as C
    from adsight.operators.detect import Thresholds

    return Thresholds(
        min_sample={m: floor / 10 for m, floor in C.MIN_SAMPLE.items()}, min_score=0.0,
        min_orders=3.0)
