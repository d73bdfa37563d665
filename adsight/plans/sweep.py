"""The whole sweep: facts to grouped opportunities, for one as-of date or for all of them."""

from __future__ import annotations

import datetime as dt
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from adsight.operators import detect as D
from adsight.operators import explain as X
from adsight.operators import group as G
from adsight.operators import metrics as M
from adsight.operators import recommend as R
from adsight.operators import trust as TR
from adsight.plans.stages import staged
from adsight.sources import warehouse as WH


@dataclass(frozen=True)
class Context:
    """Everything besides the facts that the sweep needs."""

    budgets: DataFrame
    settings: M.Settings | None = None
    festive: list[tuple] = field(default_factory=list)
    thresholds: D.Thresholds = field(default_factory=D.Thresholds)


def signals_for(
    ads: DataFrame, web: DataFrame, store: DataFrame, context: Context,
    start: dt.date, end: dt.date,
) -> tuple[DataFrame, DataFrame]:
    """Ranked signals and tracking verdicts of a date range, both staged."""
    t = context.thresholds
    tracking = staged(TR.tracking_checks(ads, store, start, end, t.min_orders), "tracking")
    raw = D.detect(ads, web, store, tracking, context.budgets, context.settings, start, end, t)
    ranked = G.rank_signals(raw, tracking, context.festive, t.min_score)
    return staged(ranked, "signals"), tracking


def analyse(
    ads: DataFrame, web: DataFrame, store: DataFrame, context: Context,
    start: dt.date, end: dt.date, children: DataFrame | None = None,
) -> DataFrame:
    """Detect, suppress, score, roll up and group; one row per as-of date and entity.

    ``children``: a stored :func:`group.child_counts`; with it only the days that the dates reach
    are read, without it the hierarchy comes from all facts.
    """
    ranked, _ = signals_for(ads, web, store, context, start, end)
    return G.group_opportunities(G.most_specific(
        ranked, G.child_counts(ads) if children is None else children))


def investigate(
    opportunities: DataFrame, tracking: DataFrame, names: DataFrame, protected: list[str]
) -> DataFrame:
    """Evidence, diagnosis and recommendation beside every opportunity (no further shuffles)."""
    known = X.with_trust(G.with_names(opportunities, names), tracking)
    explained = X.with_evidence(known.withColumn("protected", X.is_protected(protected)))
    return R.recommend(X.diagnose(explained))


def span(ads: DataFrame, web: DataFrame, store: DataFrame) -> tuple[dt.date, dt.date]:
    """First and last day all three fact tables cover (three pairs of dates reach the driver)."""
    ends = [
        f.agg(F.min("date").alias("first"), F.max("date").alias("last"))
        for f in (ads, web, store)]
    row = ends[0].unionByName(ends[1]).unionByName(ends[2]).agg(
        F.max("first").alias("first"), F.min("last").alias("last")).first()
    return row["first"], row["last"]


def as_of_span(ads: DataFrame, web: DataFrame, store: DataFrame) -> tuple[dt.date, dt.date]:
    """First and last as-of date: every day the facts cover that has its 35 warm-up days."""
    first, last = span(ads, web, store)
    return first + dt.timedelta(days=D.W.REACH), last


def refresh(
    spark: SparkSession, path: str, ads: DataFrame, web: DataFrame, store: DataFrame,
    context: Context, changed: DataFrame,
) -> None:
    """Keeps the stored replay under ``path`` up to date after facts of some days changed.

    ``changed``: (date). A fact counts for the 35 as-of dates from its day on, so only these are
    swept again, with dates not stored yet; all of them if the hierarchy of entities changed, which
    decides what a broad move is. Every date is a partition that is swapped in whole, with a row
    without an opportunity where nothing was found, so that old findings go. Running it again after
    a failure completes it.
    """
    start, end = as_of_span(ads, web, store)
    if end < start:
        return
    children = staged(G.child_counts(ads), "children")
    known = WH.stored(spark, f"{path}/hierarchy", children)
    dates = spark.range(1).select(F.explode(F.sequence(F.lit(start), F.lit(end))).alias("as_of"))
    done = WH.stored(spark, f"{path}/replay", dates)
    moved = known is None or bool(
        known.exceptAll(children).unionByName(children.exceptAll(known)).head(1))
    if not moved and done is not None:
        reached = changed.select(F.explode(F.sequence(
            F.col("date"), F.date_add("date", D.W.REACH - 1))).alias("as_of")).distinct()
        missing = dates.join(done.distinct(), "as_of", "left_anti")
        dates = dates.join(reached, "as_of", "left_semi").unionByName(missing).distinct()
    # One row per day, in numbers too: the dates and the two ends of their range.
    dates = staged(dates, "dates")
    first, last = dates.agg(F.min("as_of"), F.max("as_of")).first()
    if first is not None:
        found = analyse(ads, web, store, context, first, last, children)
        rows = staged(dates.join(found, "as_of", "left"), "found")
        spread = rows.count() // WH.FILE_ROWS + 1
        rows.repartition("as_of", F.pmod(F.xxhash64("opportunity"), F.lit(spread))).write.mode(
            "overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(
            "as_of").parquet(f"{path}/replay")
    children.write.mode("overwrite").parquet(f"{path}/hierarchy")


def stored_replay(spark: SparkSession, path: str) -> DataFrame:
    """The opportunities of all dates as :func:`refresh` keeps them."""
    return spark.read.parquet(f"{path}/replay").filter("opportunity is not null")


def replay(ads: DataFrame, web: DataFrame, store: DataFrame, context: Context) -> DataFrame:
    """The sweep for every as-of date that has its 35 warm-up days, as one job."""
    return analyse(ads, web, store, context, *as_of_span(ads, web, store))
