"""Data trust: coverage, freshness, conversion tracking, and what may be relied on."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from adsight.functions import catalogue as C
from adsight.functions import kpi as K
from adsight.operators import metrics as M

STATUSES = ("ok", "warning", "broken")


def source_days(ads: DataFrame, web: DataFrame, store: DataFrame) -> DataFrame:
    """Row counts per source and day: the small frame every coverage question reads."""
    parts = (
        ads.select(F.col("channel_id").alias("source"), "date"),
        web.select(F.lit("web_analytics").alias("source"), "date"),
        store.select(F.lit("store_orders").alias("source"), "date"),
    )
    counted = [p.groupBy("source", "date").agg(F.count(F.lit(1)).alias("rows")) for p in parts]
    return counted[0].unionByName(counted[1]).unionByName(counted[2])


def coverage(days: DataFrame) -> DataFrame:
    """First and last date, rows and days of every source that has data."""
    return days.groupBy("source").agg(
        F.min("date").alias("first_date"), F.max("date").alias("last_date"),
        F.sum("rows").alias("rows"), F.count(F.lit(1)).alias("days"))


def dates_by_source(days: DataFrame, start: dt.date, end: dt.date) -> DataFrame:
    return M.in_period(days, start, end).select("source", "date")


def expected_sources(spark) -> DataFrame:
    return spark.range(1).select(
        F.explode(F.array(*[F.lit(s) for s in C.SOURCES])).alias("source"))


def as_of_date(covered: DataFrame) -> DataFrame:
    """The newest day every source has reached, and the sources still missing."""
    known = covered.filter(F.col("source").isin(*C.SOURCES))
    every = F.array(*[F.lit(s) for s in C.SOURCES])
    return known.agg(
        F.when(F.count("last_date") == len(C.SOURCES), F.min("last_date")).alias("as_of"),
        F.array_except(every, F.collect_set("source")).alias("missing_sources"))


def ingestion_status(covered: DataFrame) -> DataFrame:
    """Every expected source, zeros when absent, with the common as-of date."""
    spark = covered.sparkSession
    everything = Window.partitionBy(F.lit(1))  # four rows: one per expected source
    joined = expected_sources(spark).join(covered, "source", "left")
    reached = F.count("last_date").over(everything) == len(C.SOURCES)
    return joined.select(
        "source", K.lookup(C.SOURCE_LABELS, "source").alias("label"), "first_date", "last_date",
        F.coalesce("rows", F.lit(0)).alias("rows"), F.coalesce("days", F.lit(0)).alias("days"),
        F.col("last_date").isNull().alias("missing"),
        F.when(reached, F.min("last_date").over(everything)).alias("as_of"))


def freshness(days: DataFrame, window_days: int = C.FRESHNESS_DAYS) -> DataFrame:
    """Days a source trails the newest data, and the gaps inside its recent window."""
    spark = days.sparkSession
    everything = Window.partitionBy(F.lit(1))  # four rows: one per expected source
    spans = (
        expected_sources(spark).join(coverage(days), "source", "left")
        .withColumn("newest", F.max("last_date").over(everything))
        .withColumn("start", F.greatest("first_date", F.date_sub("newest", window_days - 1)))
    )
    expected = spans.filter(F.col("start") <= F.col("last_date")).select(
        "source", F.explode(F.sequence("start", "last_date")).alias("date"))
    gaps = expected.join(days, ["source", "date"], "left_anti").groupBy("source").agg(
        F.array_sort(F.collect_list("date")).alias("missing_dates"))  # at most window_days
    behind = F.coalesce(F.datediff("newest", "last_date"), F.lit(0))
    missing = F.coalesce("missing_dates", F.array().cast("array<date>"))
    status = (
        F.when(F.col("last_date").isNull(), "broken")
        .when((behind > 0) | (F.size(missing) > 0), "warning").otherwise("ok"))
    return spans.join(gaps, "source", "left").select(
        "source", "last_date", behind.alias("days_behind"), missing.alias("missing_dates"),
        status.alias("status"))


def conversions_vs_orders(ads: DataFrame, store: DataFrame) -> DataFrame:
    """Reported conversions of every channel beside the store's orders, per day."""
    daily = ads.groupBy("channel_id", "date").agg(
        F.sum("platform_conversions").alias("conversions"))
    orders = store.select("date", F.col("orders").alias("orders"))
    return daily.join(orders, "date", "left")


def _median(values: Column) -> Column:
    """Middle of an array of numbers (mean of the two middle ones when even)."""
    ordered, n = F.array_sort(values), F.size(values)
    low = F.try_element_at(ordered, F.greatest(F.floor((n + 1) / 2), F.lit(1)).cast("int"))
    high = F.try_element_at(ordered, F.floor(n / 2).cast("int") + 1)
    return low + (high - low) / 2


def tracking_checks(
    ads: DataFrame, store: DataFrame, start: dt.date, end: dt.date,
    min_orders: float = C.MIN_WINDOW_ORDERS,
) -> DataFrame:
    """The tracking verdict of every channel on every as-of date of a range.

    One window pass per channel over a calendar spine: recent sums, the 28 baseline ratios and
    the last 28 ratios are frames of at most 28 days, so nothing grows with the facts.
    """
    now, base = C.TRACKING_WINDOW_DAYS, C.TRACKING_BASELINE_DAYS
    first = start - dt.timedelta(days=now + base - 1)
    conversions = M.in_period(ads, first, end).groupBy("channel_id", "date").agg(
        F.sum("platform_conversions").alias("conversions"))
    orders = M.in_period(store, first, end).select("date", "orders")
    # Every row also stands for the empty days up to the channel's next one, so the calendar is
    # filled without a second scan or a join.
    following = F.lead("date").over(Window.partitionBy("channel_id").orderBy("date"))
    until = F.coalesce(F.date_sub(following, 1), F.lit(end))
    filled = conversions.withColumn("until", until).select(
        "channel_id", F.explode(F.sequence("date", "until")).alias("day"), "date", "conversions"
    ).select("channel_id", F.col("day").alias("date"), F.when(
        F.col("day") == F.col("date"), F.col("conversions")).alias("conversions"))
    series = filled.join(orders, "date", "left").withColumn(
        "ratio", K.ratio("conversions", "orders"))
    by_day = Window.partitionBy("channel_id").orderBy("date")
    recent, history = by_day.rowsBetween(1 - now, 0), by_day.rowsBetween(1 - now - base, -now)
    month = by_day.rowsBetween(1 - base, 0)

    def mean(column: str, frame) -> Column:
        return K.ratio(F.sum(column).over(frame), F.count(column).over(frame))

    seen = series.select(
        "channel_id", F.col("date").alias("as_of"),
        F.coalesce(F.sum("conversions").over(recent), F.lit(0)).cast("double").alias("conv_now"),
        F.sum("orders").over(recent).cast("double").alias("orders_now"),
        F.collect_list("ratio").over(history).alias("ratios"),
        F.collect_list(F.struct("date", "ratio")).over(month).alias("last_days"),
        mean("conversions", history).alias("conv_base_mean"),
        mean("conversions", recent).alias("conv_now_mean"),
        mean("orders", history).alias("orders_base_mean"),
        mean("orders", recent).alias("orders_now_mean"),
    ).filter(F.col("as_of").between(F.lit(start), F.lit(end)))
    judged = seen.filter(
        (F.size("ratios") >= C.MIN_BASELINE_DAYS) & (F.col("orders_now") >= min_orders)
    ).withColumn("typical", _median(F.col("ratios"))).filter(F.col("typical") > 0)
    change = K.ratio(K.ratio("conv_now", "orders_now"), "typical")
    status = (
        F.when(F.col("ratio_change") <= C.TRACKING_BROKEN, "broken")
        .when(F.col("ratio_change") <= C.TRACKING_WARNING, "warning").otherwise("ok"))
    return judged.withColumn("ratio_change", change).withColumn("status", status).select(
        "as_of", "channel_id", "status", "ratio_change", "typical",
        F.when(F.col("status") != "ok", low_run_since("as_of", "last_days", "typical"))
        .alias("since"),
        K.change_pct("conv_base_mean", "conv_now_mean").alias("conversions_change_pct"),
        K.change_pct("orders_base_mean", "orders_now_mean").alias("orders_change_pct"))


def low_run_since(as_of: K.ColumnLike, days: K.ColumnLike, typical: K.ColumnLike) -> Column:
    """First day of the latest run of low days in an array of (date, ratio) up to ``as_of``.

    The run has to reach the recent window (or end the day before it); without one, the start of
    the recent window stands in.
    """
    day, usual = K.col(as_of), K.col(typical)
    window_start = F.date_sub(day, C.TRACKING_WINDOW_DAYS - 1)
    low = lambda d: F.coalesce(d["ratio"] / usual <= C.TRACKING_WARNING, F.lit(False))
    latest = F.array_max(F.transform(
        F.filter(K.col(days), lambda d: low(d) & (d["date"] >= F.date_sub(window_start, 1))),
        lambda d: d["date"]))
    broken_by = F.array_max(F.transform(
        F.filter(K.col(days), lambda d: ~low(d) & (d["date"] < latest)), lambda d: d["date"]))
    earliest = F.array_min(F.transform(K.col(days), lambda d: d["date"]))
    return F.when(latest.isNull(), window_start).otherwise(
        F.coalesce(F.date_add(broken_by, 1), earliest))


def tracking_check(
    ads: DataFrame, store: DataFrame, as_of: dt.date, min_orders: float = C.MIN_WINDOW_ORDERS
) -> DataFrame:
    return tracking_checks(ads, store, as_of, as_of, min_orders)


def source_trust(fresh: DataFrame, tracking: DataFrame) -> DataFrame:
    """The worse of freshness and tracking per source."""
    order = {s: i for i, s in enumerate(STATUSES)}
    checks = tracking.select(
        F.col("channel_id").alias("source"), F.col("status").alias("tracking_status"),
        "ratio_change", "since")
    worst = F.greatest(K.lookup(order, "status"), K.lookup(order, "tracking_status"))
    return fresh.withColumnRenamed("status", "freshness_status").join(
        checks, "source", "left"
    ).withColumn("status", F.col("freshness_status")).select(
        "source", "last_date", "days_behind", "missing_dates", "freshness_status",
        "tracking_status", "ratio_change", "since",
        F.element_at(F.array(*[F.lit(s) for s in STATUSES]), worst + 1).alias("status"))


def unreliable_metrics(tracking: DataFrame) -> DataFrame:
    """Per as-of date, the metrics that rest on a broken platform count."""
    return tracking.groupBy("as_of").agg(
        F.max((F.col("status") == "broken").cast("int")).alias("broken")
    ).filter("broken = 1").select(
        "as_of", F.explode(F.array(*[F.lit(m) for m in C.PLATFORM_METRICS])).alias("metric"))
