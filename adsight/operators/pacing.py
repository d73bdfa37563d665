"""Budget pacing: is month-to-date spend on course for the month's budget?"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from adsight.functions import catalogue as C
from adsight.functions import kpi as K
from adsight.functions import periods as P


def budgets_frame(spark, budgets: dict[str, float]) -> DataFrame:
    """The settings' budgets (a handful of literals) as a table."""
    rows = F.array(*[
        F.struct(F.lit(c).alias("channel_id"), F.lit(float(b)).alias("budget"))
        for c, b in budgets.items()])
    return spark.range(1).select(F.inline(rows))


def mtd_spend(ads: DataFrame, as_of: dt.date) -> DataFrame:
    """Spend per channel from the first of the month to ``as_of``."""
    month = ads.filter(F.col("date").between(F.lit(as_of.replace(day=1)), F.lit(as_of)))
    return month.groupBy("channel_id").agg(F.sum("spend").alias("spent"))


def pace(budget: K.ColumnLike, spent: K.ColumnLike, day: P.Day) -> dict[str, Column]:
    """Every pacing figure of a (budget, spend) pair on a day; null for an invalid pair."""
    b, s, d = K.col(budget), K.col(spent).cast("double"), P.day(day)
    usable = (b > 0) & (s >= 0)
    budget_, spent_ = F.when(usable, b), F.when(usable, s)
    elapsed, total = F.dayofmonth(d), K.days_in_month(d)
    rate = spent_ / elapsed
    projected = rate * total
    left = total - elapsed
    remaining = budget_ - spent_
    share = F.try_divide(projected, budget_)
    status = (
        F.when(share > 1 + C.PACE_TOLERANCE, "over")
        .when(share < 1 - C.PACE_TOLERANCE, "under").when(share.isNotNull(), "on_track"))
    return {
        "budget": budget_,
        "spent": spent_,
        "spent_pct": F.try_divide(spent_, budget_) * 100,
        "remaining_budget": remaining,
        "month_elapsed_pct": elapsed / total * 100,
        "projected": projected,
        "status": status,
        "daily_run_rate": rate,
        "suggested_daily": F.try_divide(F.greatest(remaining, F.lit(0.0)), left),
    }


def budget_pacing(ads: DataFrame, budgets: DataFrame, as_of: dt.date) -> DataFrame:
    """Pacing per budgeted channel and for all of them together (channel ``all``)."""
    spent = budgets.filter("budget > 0").join(mtd_spend(ads, as_of), "channel_id", "left").select(
        "channel_id", "budget", F.coalesce("spent", F.lit(0)).alias("spent"))
    lines = spent.rollup("channel_id").agg(
        F.sum("budget").alias("budget"), F.sum("spent").alias("spent"))
    named = lines.select(
        F.coalesce("channel_id", F.lit("all")).alias("channel_id"), "budget", "spent")
    return named.select("channel_id", *[c.alias(n) for n, c in pace(
        "budget", "spent", as_of).items()])


def budget_plan(plans: DataFrame, months: DataFrame) -> DataFrame:
    """Budget per channel and month: a plan's month, else its default; plans of a channel add up.

    ``plans``: (channel_id, plan, month, amount) with month ``default`` for the fall-back.
    ``months``: (channel_id, month).
    """
    dated = plans.filter(F.col("month") != "default").withColumnRenamed("amount", "dated")
    default = plans.filter(F.col("month") == "default").select(
        "channel_id", "plan", F.col("amount").alias("fallback"))
    wanted = months.join(plans.select("channel_id", "plan").distinct(), "channel_id")
    return (
        wanted.join(dated, ["channel_id", "plan", "month"], "left")
        .join(default, ["channel_id", "plan"], "left")
        .groupBy("channel_id", "month")
        .agg(F.sum(F.coalesce("dated", "fallback")).alias("budget"))
    )


def long_sales(windows: DataFrame, min_days: int = 7) -> DataFrame:
    """Sale windows long enough to expect big swings."""
    return windows.filter(F.datediff("end", "start") >= min_days)
