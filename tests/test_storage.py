"""Ingestion, upserts and streaming on small files."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from adsight.operators import experiments as E
from adsight.operators import report as RP
from adsight.sources import exports as X
from adsight.sources import templates as TP
from adsight.sources import warehouse as WH
from adsight.streaming.ingest import stream_ingest

GOOGLE = [f.header for f in TP.TEMPLATES["google_ads"].fields]
GOOD = ["2026-04-18", "Brand, India", "11", "Set", "22", "33", "Ad", "18-24", "Mobile phones",
        "Delhi", "INR", "1,200.50", "5000", "100", "3.5", "9000"]


def csv(rows, header=GOOGLE):
    quote = lambda c: f'"{c}"' if "," in c else c
    return "\n".join(",".join(quote(c) for c in r) for r in [header, *rows]) + "\n"


def google(**changes):
    by_header = dict(zip(GOOGLE, GOOD, strict=True))
    by_header.update(changes)
    return [by_header[h] for h in GOOGLE]


@pytest.fixture
def folder(tmp_path):
    rows = [google(**{"Ad ID": str(i)}) for i in range(8)]
    rows[1] = google(**{"Ad ID": "1", "Currency code": "USD"})
    rows[4] = google(**{"Ad ID": "4", "Clicks": "lots"})
    (tmp_path / "google.csv").write_text("﻿" + csv([*rows, rows[0]]) + "\n,,,\n", "utf-8")
    store = ["Day", "Orders", "Gross sales", "Discounts", "Returns", "Net sales", "Shipping"]
    (tmp_path / "store.csv").write_text(csv([["2026-04-18"] + ["1"] * 6], store))
    (tmp_path / "other.csv").write_text("a,b\n1,2\n")
    return tmp_path


def test_rejections_carry_line_and_reason(spark, folder):
    validated, log = X.ingest_files(spark, str(folder))
    rows = validated["google_ads"].collect()
    refused = {r["line"]: list(r["errors"]) for r in rows if not r["accepted"]}
    assert refused == {
        3: ["Currency code: expected one of: INR (got 'USD')"],
        6: ["Clicks: expected a number (got 'lots')"],
        10: ["duplicate of line 2"]}
    assert {r["campaign_name"] for r in rows} == {"Brand, India"}
    runs = {r["file"].rsplit("/", 1)[1]: r for r in log.collect()}
    assert (runs["google.csv"]["status"], runs["google.csv"]["rows_accepted"]) == ("partial", 6)
    assert runs["store.csv"]["status"] == "failed"
    assert "Store orders" in runs["store.csv"]["error"]
    assert "New customers" in runs["store.csv"]["error"]
    assert runs["other.csv"]["error"].startswith("Headers don't match")


def test_wrong_cell_count(spark, tmp_path):
    (tmp_path / "g.csv").write_text(csv([GOOD, GOOD[:-1]]))
    validated, _ = X.ingest_files(spark, str(tmp_path))
    errors = {r["line"]: list(r["errors"]) for r in validated["google_ads"].collect()}
    assert errors == {2: [], 3: ["expected 16 columns, found 15"]}


def test_line_numbers_over_file_blocks(spark, tmp_path):
    rows = [google(**{"Ad ID": str(i)}) for i in range(500)]
    (tmp_path / "g.csv").write_text(csv(rows))
    spark.conf.set("spark.sql.files.maxPartitionBytes", "5000")
    try:
        validated, _ = X.ingest_files(spark, str(tmp_path))
        found = {(r["creative_external_id"], r["line"]) for r in validated["google_ads"].collect()}
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert found == {(str(i), i + 2) for i in range(500)}


def accepted(spark, path):
    validated, log = X.ingest_files(spark, str(path))
    rows = {r["line"]: r for r in validated["google_ads"].collect()}
    return rows, {r["file"].rsplit("/", 1)[1]: r for r in log.collect()}


def test_rows_survive_a_change_of_splits_between_scan_and_action(spark, tmp_path):
    rows = [google(**{"Ad ID": str(i)}) for i in range(800)]
    (tmp_path / "g.csv").write_text(csv(rows))
    spark.conf.set("spark.sql.files.maxPartitionBytes", "5000")
    try:
        found, _ = X.read_export(spark, str(tmp_path))
        spark.conf.set("spark.sql.files.maxPartitionBytes", "7000")
        assert found.count() == 800
        validated = X.validate_rows(found, TP.TEMPLATES["google_ads"])
        spark.conf.set("spark.sql.files.maxPartitionBytes", "3000")
        assert validated.filter("accepted").count() == 800
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")


@pytest.mark.parametrize("block", [None, "90"])
def test_quoted_cells_may_hold_newlines(spark, tmp_path, block):
    quoted = google(**{"Campaign": "two, \nlines \"\"quoted\"\"", "Ad ID": "2"})
    text = "\n".join([",".join(GOOGLE), *(
        ",".join(f'"{c}"' for c in r) for r in (google(**{"Ad ID": "1"}), quoted, quoted, GOOD))])
    (tmp_path / "g.csv").write_text(text)
    if block:
        spark.conf.set("spark.sql.files.maxPartitionBytes", block)
    try:
        rows, log = accepted(spark, tmp_path)
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert sorted(rows) == [2, 4, 6, 7]
    assert rows[4]["campaign_name"] == 'two, \nlines "quoted"'
    assert list(rows[6]["errors"]) == ["duplicate of line 4"]
    assert (log["g.csv"]["rows_accepted"], log["g.csv"]["rows_rejected"]) == (3, 1)


def test_an_open_quote_does_not_swallow_a_file(spark, tmp_path):
    rows = [google(**{"Ad ID": str(i)}) for i in range(300)]
    lines = csv(rows).splitlines()
    lines[150] = lines[150].replace("Set", '"Set')
    (tmp_path / "g.csv").write_text("\n".join(lines) + "\n")
    found, _ = accepted(spark, tmp_path)
    assert len(found) == 300 and sum(not r["accepted"] for r in found.values()) == 1


def test_every_file_has_a_log_row(spark, tmp_path):
    (tmp_path / "empty.csv").write_bytes(b"")
    (tmp_path / "latin.csv").write_bytes(csv([google(Campaign="Caf\xe9")]).encode("latin-1"))
    (tmp_path / "blank.csv").write_text("\n,,\n")
    (tmp_path / "header.csv").write_text(csv([]))
    (tmp_path / "good.csv").write_text(csv([GOOD]))
    _, log = accepted(spark, tmp_path)
    assert {name: r["error"] for name, r in log.items()} == {
        "empty.csv": "The file is empty or has no header row.",
        "latin.csv": "The file is not UTF-8 encoded CSV text.",
        "blank.csv": "The file is empty or has no header row.",
        "header.csv": "The file has no data rows.", "good.csv": None}
    assert {name for name, r in log.items() if r["status"] == "failed"} == set(log) - {"good.csv"}


def test_columns_may_stand_in_any_order(spark, tmp_path):
    turned = list(reversed(GOOGLE))
    (tmp_path / "a.csv").write_text(csv([GOOD]))
    (tmp_path / "b.csv").write_text(csv([["x", *reversed(GOOD)]], ["Extra", *turned]))
    validated, _ = X.ingest_files(spark, str(tmp_path))
    rows = [r.asDict() for r in validated["google_ads"].collect()]
    for r in rows:
        for own in ("file", "headers", "positions", "width", "value", "cells"):
            r.pop(own)
    assert len(rows) == 2 and rows[0] == rows[1] and rows[0]["accepted"]


def test_refused_rows_are_all_there(spark, tmp_path):
    rows = [google(**{"Ad ID": str(i), "Clicks": "lots"}) for i in range(250)]
    (tmp_path / "g.csv").write_text(csv(rows))
    validated, _ = X.ingest_files(spark, str(tmp_path))
    refused = X.rejected_rows(validated["google_ads"]).collect()
    assert len(refused) == 250
    assert {c["headers"]: c["cells"] for c in refused[0]["cells"]}["Clicks"] == "lots"
    sample = X.rejected_report(validated["google_ads"], 3).collect()
    assert [(r["line"], r["refused"]) for r in sample] == [(2, 250), (3, 250), (4, 250)]


def test_same_ad_id_on_two_platforms(spark, tmp_path_factory):
    source, out = tmp_path_factory.mktemp("in"), tmp_path_factory.mktemp("out")
    meta = [f.header for f in TP.TEMPLATES["meta_ads"].fields]
    row = ["2026-04-18", "2026-04-18", "Brand", "11", "Set", "22", "Ad", "33", "facebook", "18-24",
           "Mobile app", "Delhi", "10", "5000", "400", "100", "3", "90"]
    (source / "google.csv").write_text(csv([GOOD, google(**{"Ad group ID": "23"})]))
    (source / "meta.csv").write_text(csv([row], meta))
    stream_ingest(spark, str(source), str(out / "tables"), str(out / "check"))
    found = WH.read(spark, str(out / "tables/ads")).select("channel_id", "ad_set_id", "creative_id")
    assert sorted(map(tuple, found.collect())) == [
        ("google_ads", "22", "33"), ("google_ads", "23", "33"), ("meta_ads", "22", "33")]


def test_upsert_writes_few_files_per_month(spark, tmp_path):
    path = tmp_path / "t"
    rows = [(dt.date(2026, 1 + i % 3, 1 + i % 28), i) for i in range(3000)]
    for part in (rows[:2000], rows[1000:]):
        WH.upsert(spark, str(path), facts(spark, part).repartition(16), ["date", "orders"], "date")
    assert WH.read(spark, str(path)).count() == 3000
    files = list(path.glob("month=*/*.parquet"))
    assert len(files) == 3


def test_a_cluster_needs_a_shared_folder():
    from adsight.plans.session import scratch

    class Conf:
        def __init__(self, master):
            self.held = {"spark.master": master}

        def get(self, name, default=None):
            return self.held.get(name, default)

        def set(self, name, value):
            self.held[name] = value

    class Session:
        def __init__(self, master):
            self.conf = Conf(master)

    assert scratch(Session("local[4]"), "x")
    for master in ("yarn", "spark://host:7077", "local-cluster[3,2,1000]"):
        with pytest.raises(ValueError):
            scratch(Session(master), "x")


def test_pacing_of_a_silent_channel_and_of_one_channel(spark):
    ads = spark.createDataFrame(
        [(dt.date(2026, 4, 10), "google_ads", 100.0)], "date date, channel_id string, spend double")
    weeks = spark.createDataFrame([(dt.date(2026, 4, 14),)], "week_end date")
    lines = lambda rows, kind="channel_id string, budget double": [
        (p["label"], p["budget"], p["spent"]) for r in RP.weekly_pacing(
            ads, spark.createDataFrame(rows, kind), weeks).collect() for p in r["pacing"]]
    assert lines([("google_ads", 1000.0), ("meta_ads", 1000.0)]) == [
        ("Google Ads", 1000.0, 100.0), ("Meta Ads", 1000.0, 0.0), ("All channels", 2000.0, 100.0)]
    assert lines([("meta_ads", 500.0)]) == [("Meta Ads", 500.0, 0.0)]
    assert lines([("google_ads", 700.0, "2026-04"), ("google_ads", 900.0, "2026-05")],
                 "channel_id string, budget double, month string") == [("Google Ads", 700.0, 100.0)]


def test_experiments_of_a_week(spark):
    day = lambda n: dt.date(2026, 4, 1) + dt.timedelta(days=n)
    rows = [(1, day(0), day(7), day(7), "worked"), (2, day(5), day(12), None, None),
            (3, None, None, None, None)]
    rows += [(10 + i, day(1), day(8), day(8), "worked") for i in range(150)]
    table = spark.createDataFrame(rows, "id int, started_on date, ends_on date, evaluated_on date,"
                                        "verdict string").withColumn("after_value", F.lit(1.0))
    found = RP.weekly_experiments(table, day(13))
    got = {(r["week_end"], r["id"], r["verdict"]) for r in found.filter("id < 10").collect()}
    assert got == {(day(6), 1, None), (day(13), 1, "worked"), (day(6), 2, None)}
    assert found.filter("verdict = 'worked'").count() == 151


def facts(spark, rows):
    return spark.createDataFrame(rows, "date date, orders int")


def test_upsert_is_idempotent_and_corrects(spark, tmp_path):
    path = str(tmp_path / "t")
    first = [(dt.date(2026, 4, 18), 99), (dt.date(2026, 5, 1), 10)]
    for _ in range(2):
        WH.upsert(spark, path, facts(spark, first), ["date"], "date")
    WH.upsert(spark, path, facts(spark, [(dt.date(2026, 4, 18), 123)]), ["date"], "date")
    found = sorted((str(r["date"]), r["orders"]) for r in WH.read(spark, path).collect())
    assert found == [("2026-04-18", 123), ("2026-05-01", 10)]


def test_stream_reads_each_file_once(spark, folder, tmp_path_factory):
    out = tmp_path_factory.mktemp("out")
    run = lambda: stream_ingest(
        spark, str(folder), str(out / "tables"), str(out / "check"))
    run()
    run()
    assert WH.read(spark, str(out / "tables/ads")).count() == 6
    extra = [google(**{"Ad ID": "0", "Cost": "5"}), google(**{"Ad ID": "99"})]
    (folder / "zz.csv").write_text(csv(extra))
    run()
    ads = WH.read(spark, str(out / "tables/ads"))
    assert ads.count() == 7
    assert ads.filter("creative_id = '0'").first()["spend"] == 5


def test_status_transitions(spark):
    schema = ("key string, status string, first_seen_date date, last_seen_date date,"
              "window_start date, score double")
    d = dt.date(2026, 10, 1)
    old = [(k, k, d, d, d, 1.0) for k in ("open", "resolved", "dismissed", "experimenting")]
    gone = {r["key"]: r["status"] for r in RP.save_opportunities(
        spark.createDataFrame(old, schema), spark.createDataFrame([], schema)).collect()}
    assert gone == {"open": "resolved", "resolved": "resolved", "dismissed": "dismissed",
                    "experimenting": "experimenting"}
    again = {r["key"]: r["status"] for r in RP.save_opportunities(
        spark.createDataFrame(old, schema),
        spark.createDataFrame([*old, ("new", None, d, d, d, 2.0)], schema)).collect()}
    assert again == {"open": "open", "resolved": "open", "dismissed": "dismissed",
                     "experimenting": "experimenting", "new": "open"}


def test_experiment_closes_the_loop(spark):
    start = dt.date(2026, 10, 7)
    days = [start + dt.timedelta(days=i) for i in range(-6, 8)]
    ads = spark.createDataFrame(
        [(d, "meta_ads", "7", "31", "42", "25-34", 1000, None, 100,
          6100.0 if d <= start else 4200.0, 10.0, 9000.0) for d in days],
        "date date, channel_id string, campaign_id string, ad_set_id string, creative_id string,"
        "age_group string, impressions bigint, reach bigint, clicks bigint, spend double,"
        "platform_conversions double, platform_revenue double")
    web = spark.createDataFrame([], "date date, source string, sessions bigint, bounces bigint,"
                                    "add_to_cart bigint, checkout bigint, purchases bigint")
    store = spark.createDataFrame([], "date date, orders bigint, revenue double")
    experiments = spark.createDataFrame(
        [(1, 5, "running", "cpa", start, start + dt.timedelta(days=7), 7)],
        "id int, opportunity_id int, status string, metric string, started_on date, ends_on date,"
        "duration_days int")
    opportunities = spark.createDataFrame(
        [(5, "creative", "42", "Ad", "issue", "experimenting", "cpa")],
        "id int, entity_level string, entity_key string, entity_name string, kind string,"
        "status string, primary_metric string")
    again = opportunities.select(F.col("id").alias("opportunity_id"))
    row = E.evaluate(experiments, opportunities, ads, web, store,
                     start + dt.timedelta(days=7), again).first()
    assert (row["before_value"], row["after_value"], row["sample_days"]) == (610.0, 420.0, 7)
    assert (row["verdict"], row["opportunity_status"]) == ("worked", "resolved")
