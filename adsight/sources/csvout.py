"""Writes canonical facts in the export layouts, for round trips and tests."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

DEVICES = {"google_ads": ("Mobile phones", "Computers"), "meta_ads": ("Mobile app", "Desktop")}


def export_ads(ads: DataFrame, source: str) -> DataFrame:
    """Named ad facts of one channel in that platform's columns, all text."""
    mobile, desktop = DEVICES[source]
    rows = ads.filter(F.col("channel_id") == source).withColumn(
        "shown_device", F.when(F.col("device") == "mobile", mobile).otherwise(desktop))
    text = lambda c: F.col(c).cast("string")
    money = lambda c: F.col(c).cast("decimal(14,2)").cast("string")
    if source == "google_ads":
        cols = {
            "Day": text("date"), "Campaign": F.col("campaign_name"),
            "Campaign ID": text("campaign_id"), "Ad group": F.col("ad_set_name"),
            "Ad group ID": text("ad_set_id"), "Ad ID": text("creative_id"),
            "Ad name": F.col("creative_name"), "Age": F.col("age_group"),
            "Device": F.col("shown_device"), "Region": F.col("region"),
            "Currency code": F.lit("INR"), "Cost": money("spend"), "Impr.": text("impressions"),
            "Clicks": text("clicks"),
            "Conversions": money("platform_conversions"), "Conv. value": money("platform_revenue"),
        }
    else:
        cols = {
            "Reporting starts": text("date"), "Reporting ends": text("date"),
            "Campaign name": F.col("campaign_name"), "Campaign ID": text("campaign_id"),
            "Ad set name": F.col("ad_set_name"), "Ad set ID": text("ad_set_id"),
            "Ad name": F.col("creative_name"), "Ad ID": text("creative_id"),
            "Platform": F.lit("facebook"), "Age": F.col("age_group"),
            "Device platform": F.col("shown_device"), "Region": F.col("region"),
            "Amount spent (INR)": money("spend"), "Impressions": text("impressions"),
            "Reach": text("reach"), "Link clicks": text("clicks"),
            "Purchases": money("platform_conversions"),
            "Purchases conversion value": money("platform_revenue"),
        }
    return rows.select(*[c.alias(f"`{n}`".strip("`")) for n, c in cols.items()])


def export_web(web: DataFrame) -> DataFrame:
    return web.select(
        F.date_format("date", "yyyyMMdd").alias("Date"),
        F.col("source").alias("Session source / medium"), F.col("device").alias("Device category"),
        F.col("sessions").alias("Sessions"),
        (F.col("sessions") - F.col("bounces")).alias("Engaged sessions"),
        F.col("add_to_cart").alias("Add to carts"), F.col("checkout").alias("Checkouts"),
        F.col("purchases").alias("Ecommerce purchases"),
        F.col("revenue").cast("decimal(14,2)").alias("Purchase revenue"))


def export_store(store: DataFrame) -> DataFrame:
    money = lambda c: c.cast("decimal(14,2)")
    gross = F.col("revenue") + F.col("discounts") + F.col("refunds")
    return store.select(
        F.col("date").alias("Day"), F.col("orders").alias("Orders"),
        money(gross).alias("Gross sales"), money(-F.col("discounts")).alias("Discounts"),
        money(-F.col("refunds")).alias("Returns"), money(F.col("revenue")).alias("Net sales"),
        F.col("new_customers").alias("New customers"))


def write_csv(frame: DataFrame, path: str) -> None:
    frame.write.mode("append").option("header", True).option("escape", '"').csv(path)
