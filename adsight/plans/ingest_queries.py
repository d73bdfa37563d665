"""Queries of ingestion, stored tables and streaming."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Window
from pyspark.sql import functions as F

from adsight.functions import catalogue as C
from adsight.operators import metrics as M
from adsight.plans.queries import query
from adsight.plans.session import scratch
from adsight.plans.stages import staged
from adsight.sources import csvout as O
from adsight.sources import exports as X
from adsight.sources import templates as TP
from adsight.sources import testtables as T
from adsight.sources import warehouse as WH
from adsight.streaming.ingest import stream_ingest

GOOGLE = TP.TEMPLATES["google_ads"]
STORE = TP.TEMPLATES["store_orders"]


def line_numbers():
    """Lines per daily file in a fixed order, so that SQL can count them the same way."""
    return F.row_number().over(Window.partitionBy("file").orderBy(
        "date", "creative_id", "age_group", "device", "region")).cast("bigint") + 1


def laid_out(template):
    """The header columns of rows whose cells stand in template order."""
    return [F.array(*[F.lit(f.header) for f in template.fields]).alias("headers"),
            F.array(*[F.lit(i + 1) for i in range(len(template.fields))]).alias("positions"),
            F.lit(len(template.fields)).alias("width")]


def raw_google(spark, sf):
    """Google rows as export cells, one file per day, with faults planted by line and day."""
    ads = T.named_ad_facts(spark, sf).filter("channel_id = 'google_ads'").withColumn(
        "file", F.concat(F.lit("google-"), F.col("date").cast("string")))
    rows = ads.withColumn("line", line_numbers()).withColumn(
        "n", F.col("line") + F.dayofyear("date") * 13)
    n = F.col("n")
    text = lambda c: F.col(c).cast("string")
    cells = F.array(
        F.when(n % 89 == 4, "2001-02-30").otherwise(text("date")), F.col("campaign_name"),
        text("campaign_id"), F.col("ad_set_name"),
        F.when(n % 101 == 6, "1.2E+17").otherwise(text("ad_set_id")), text("creative_id"),
        F.col("creative_name"), F.col("age_group"),
        F.when(F.col("device") == "mobile", "mobile PHONES").otherwise("Computers"),
        F.col("region"), F.when(n % 61 == 5, "USD").otherwise("INR"),
        F.when(n % 97 == 3, "").otherwise(
            F.format_number(F.col("spend").cast("decimal(14,2)"), 2)),
        text("impressions"),
        F.when(n % 53 == 7, "lots").when(n % 83 == 3, (F.col("impressions") + 1).cast("string"))
        .otherwise(text("clicks")),
        F.col("platform_conversions").cast("decimal(12,2)").cast("string"),
        F.col("platform_revenue").cast("decimal(14,2)").cast("string"))
    shaped = rows.select(
        "file", F.lit("google_ads").alias("source"), "line", *laid_out(GOOGLE),
        F.array_join(cells, ",").alias("value"), cells.alias("cells"), "n")
    again = shaped.filter(n % 71 == 9).withColumn("line", F.col("line") + 1_000_000)
    return shaped.unionByName(again).drop("n")


def validated_google(spark, sf):
    return X.validate_rows(raw_google(spark, sf), GOOGLE)


@query("parse_cells")
def _(spark, sf):
    v = validated_google(spark, sf)
    return v.select("file", "line", "date", "ad_set_external_id", "device", "currency", "spend",
                    "impressions", "clicks")


@query("validate_rows")
def _(spark, sf):
    return validated_google(spark, sf).select(
        "file", "line", F.array_join("errors", "; ").alias("errors"), "accepted")


@query("check_at_most")
def _(spark, sf):
    return validated_google(spark, sf).filter(
        F.exists("errors", lambda e: e.startswith("clicks ("))).select(
        "file", "line", F.element_at("errors", 1).alias("error"))


@query("reject_duplicates")
def _(spark, sf):
    return validated_google(spark, sf).filter(
        F.exists("errors", lambda e: e.startswith("duplicate"))).select(
        "file", "line", F.element_at("errors", 1).alias("error"))


@query("derive_and_project")
def _(spark, sf):
    return X.derive_and_project(validated_google(spark, sf), GOOGLE).select(
        "file", "line", "date", "channel_id", "platform", "reach", "clicks", "spend")


@query("ingestion_run_log")
def _(spark, sf):
    return X.run_log(validated_google(spark, sf))


@query("recent_runs")
def _(spark, sf):
    """The newest runs after two imports, the second of which was tried twice."""
    log = staged(X.run_log(validated_google(spark, sf)), "run_log")
    path = scratch(spark, "runs")
    again = log.filter("rows_total % 2 = 0")
    for batch, rows in ((1, log), (2, log.limit(1)), (2, again)):
        WH.append_runs(spark, path, batch, rows)
    return WH.recent_runs(spark, path, 30)


@query("rejected_report")
def _(spark, sf):
    return X.rejected_report(staged(validated_google(spark, sf), "validated"), 20).select(
        "file", "line", F.array_join("errors", "; ").alias("errors"), "refused",
        F.filter("cells", lambda c: c["headers"] == "Currency code")[0]["cells"].alias("currency"))


@query("check_net_sales")
def _(spark, sf):
    store = O.export_store(T.store_facts(spark, sf))
    faulty = F.when(F.dayofmonth("Day") == 13, F.col("Net sales") + 1).otherwise(F.col("Net sales"))
    order = [f.header for f in STORE.fields]
    rows = store.withColumn("Net sales", faulty.cast("decimal(14,2)"))
    raw = rows.select(
        F.lit("store").alias("file"), F.lit("store_orders").alias("source"),
        F.datediff("Day", F.lit(dt.date(1990, 1, 1))).cast("bigint").alias("line"),
        *laid_out(STORE), F.lit("").alias("value"),
        F.array(*[F.col(f"`{h}`").cast("string") for h in order]).alias("cells"))
    return X.validate_rows(raw, STORE).select(
        "date", "accepted", F.array_join("errors", "; ").alias("errors"))


@query("template_catalogue")
def _(spark, sf):
    """Template columns with the rows the facts would export under each template."""
    ads = T.ad_facts(spark, sf).groupBy(F.col("channel_id").alias("source")).agg(
        F.count(F.lit(1)).alias("rows"))
    web = T.web_facts(spark, sf).agg(F.count(F.lit(1)).alias("rows")).withColumn(
        "source", F.lit("web_analytics"))
    store = T.store_facts(spark, sf).agg(F.count(F.lit(1)).alias("rows")).withColumn(
        "source", F.lit("store_orders"))
    counts = ads.unionByName(web).unionByName(store)
    return TP.catalogue(spark).join(counts, "source")


def exported(spark, sf):
    """All mapped facts written as export files of the four sources, and a file of no template."""
    path = scratch(spark, "exports")
    ads = T.named_ad_facts(spark, sf)
    for source in C.CHANNELS:
        O.write_csv(O.export_ads(ads, source), path)
    O.write_csv(O.export_web(T.web_facts(spark, sf)), path)
    O.write_csv(O.export_store(T.store_facts(spark, sf)), path)
    O.write_csv(T.table(spark, sf, "region").coalesce(1), path)
    return path


@query("read_export")
def _(spark, sf):
    rows, _ = X.read_export(spark, exported(spark, sf))
    return rows.groupBy("source").agg(
        F.count(F.lit(1)).alias("rows"), F.min("line").alias("first_line"),
        F.count_if(F.size("cells") == F.col("width")).alias("well_formed"))


@query("detect_source")
def _(spark, sf):
    _, files = X.read_export(spark, exported(spark, sf))
    return files.select("source", "error").distinct()


@query("check_daily_breakdown")
def _(spark, sf):
    """Every tenth ad's rows cover more than a day."""
    rows, _ = X.read_export(spark, exported(spark, sf))
    meta = rows.filter("source = 'meta_ads'").withColumn("cells", F.transform(
        "cells", lambda c, i: F.when(
            (i == 1) & (F.col("cells")[7].cast("int") % 10 == 3), "2031-12-31").otherwise(c)))
    found = X.validate_rows(meta, TP.TEMPLATES["meta_ads"])
    return found.groupBy(F.array_join("errors", "; ").alias("errors")).agg(
        F.count(F.lit(1)).alias("rows"))


@query("ingest_files")
def _(spark, sf):
    _, log = X.ingest_files(spark, exported(spark, sf))
    return log.groupBy("source", "status").agg(
        F.sum("rows_accepted").alias("rows_accepted"),
        F.sum("rows_rejected").alias("rows_rejected"), F.min("date_from").alias("date_from"),
        F.max("date_to").alias("date_to"))


def detector_facts(spark, sf):
    return X.load_detector_facts(X.ingest_files(spark, exported(spark, sf))[0])


def as_doubles(frame):
    """Decimals as doubles, to be compared with SQL."""
    return frame.select(*[
        F.col(c).cast("double").alias(c) if "decimal" in t else c for c, t in frame.dtypes])


@query("load_detector_facts")
def _(spark, sf):
    return as_doubles(M.entity_daily(detector_facts(spark, sf)["ads"]).drop("rows", "reach_rows"))


@query("load_ad_facts")
def _(spark, sf):
    ads = detector_facts(spark, sf)["ads"].withColumnsRenamed({
        "campaign_id": "campaign_external_id", "ad_set_id": "ad_set_external_id",
        "creative_id": "creative_external_id"})
    path = scratch(spark, "fact_ad_daily")
    WH.upsert(spark, path, WH.ad_fact_rows(ads), WH.AD_FACT_KEY, "date")
    stored = WH.read(spark, path)
    return as_doubles(stored.drop(*[c for c in stored.columns if c.endswith("_sk")]))


@query("load_web_facts")
def _(spark, sf):
    path = scratch(spark, "fact_web_daily")
    web = detector_facts(spark, sf)["web"].drop("file", "line")
    WH.upsert(spark, path, web, ["date", "source", "device"], "date")
    return as_doubles(WH.read(spark, path))


@query("load_store_facts")
def _(spark, sf):
    path = scratch(spark, "fact_store_daily")
    store = detector_facts(spark, sf)["store"].drop("file", "line")
    WH.upsert(spark, path, store, ["date"], "date")
    return as_doubles(WH.read(spark, path))


@query("upsert")
def _(spark, sf):
    """The store facts, corrected from June on and extended by one future copy of July."""
    path = scratch(spark, "upsert_target")
    store = T.store_facts(spark, sf)
    fixed = store.filter(F.col("date") >= F.lit(dt.date(2001, 6, 1))).withColumn(
        "orders", F.col("orders") + 100)
    later = store.filter(F.col("date").between(
        F.lit(dt.date(2001, 7, 1)), F.lit(T.AS_OF))).withColumn("date", F.date_add("date", 365))
    WH.upsert(spark, path, store, ["date"], "date")
    batch = staged(fixed.unionByName(later), "batch")
    WH.upsert(spark, path, batch, ["date"], "date")
    WH.upsert(spark, path, batch, ["date"], "date")
    return WH.read(spark, path).select("date", "orders", "revenue", "refunds", "new_customers")


@query("load_dimensions")
def _(spark, sf):
    ads = T.named_ad_facts(spark, sf).withColumnsRenamed({
        "campaign_id": "campaign_external_id", "ad_set_id": "ad_set_external_id",
        "creative_id": "creative_external_id"})
    # Campaigns were renamed over time: the newest name has to win.
    named = ads.withColumn("campaign_name", F.concat_ws("-", "campaign_name", F.year("date")))
    found = WH.load_dimensions(named.withColumn("line", F.lit(1)))
    return found.select("level", "external_id", "name")


@query("ad_facts_with_names")
def _(spark, sf):
    """Facts joined to their dimensions on surrogate ids; sizes decide how each join runs."""
    ads = T.named_ad_facts(spark, sf).withColumnsRenamed({
        "campaign_id": "campaign_external_id", "ad_set_id": "ad_set_external_id",
        "creative_id": "creative_external_id"})
    dims = staged(WH.load_dimensions(ads.withColumn("line", F.lit(1))), "dimensions")
    facts = WH.ad_fact_rows(ads)
    for level in ("campaign", "ad_set", "creative"):
        own = dims.filter(F.col("level") == level).select(
            F.col("id").alias(f"{level}_sk"), F.col("name").alias(f"{level}_name"))
        facts = facts.join(own, f"{level}_sk")
    return facts.select("date", "channel_id", "campaign_name", "ad_set_name", "creative_name",
                        "age_group", "device", "region", *[
                            F.col(m).cast("double").alias(m) for m in C.AD_MEASURES])


@query("stream_ingest")
def _(spark, sf):
    """Two runs over the same folder: the second one finds nothing new."""
    folder, tables = exported(spark, sf), scratch(spark, "tables")
    checkpoint = scratch(spark, "stream")
    stream_ingest(spark, folder, tables, checkpoint)
    stream_ingest(spark, folder, tables, checkpoint)
    return WH.read(spark, f"{tables}/ads").groupBy("date", "channel_id").agg(
        F.count(F.lit(1)).alias("rows"), F.sum("spend").cast("double").alias("spend"))
