"""Stored opportunities read back, and the numbers their texts may quote."""

import datetime as dt

from pyspark.sql import functions as F

from adsight.operators import explain as X
from adsight.operators import report as R
from adsight.operators import textcheck as TX
from adsight.plans import sweep
from adsight.plans.stages import staged
from test_sweep import tired


def investigated(spark):
    case = tired(spark)
    names = spark.createDataFrame(
        [("creative:meta_ads/7/31/42", "Summer ad")], "entity_id string, name string")
    return staged(sweep.investigate(case.analyse(), case.tracking, names, []), "found")


def test_detail_is_what_was_stored(spark):
    found = investigated(spark)
    detail = R.opportunity_detail(staged(R.opportunity_rows(found), "rows"))
    row, source = detail.first(), found.first()
    assert row["title"] == "Summer ad is earning less per rupee"
    assert (row["trust"], row["protected"], row["cause_label"]) == ("ok", False, "Creative fatigue")
    nodes = {n["path"]: n for n in row["tree"]}
    assert nodes["roas"]["higher_is_better"] and nodes["roas/cpc"]["higher_is_better"] is False
    want = X.evidence_tree(found, ["opportunity"]).collect()
    assert [(n["path"], n["depth"], n["before"], n["after"], n["share_pct"]) for n in row["tree"]] == [
        (n["path"], n["depth"], n["before"], n["after"], n["share_pct"]) for n in want]
    assert [h["cause"] for h in row["hypotheses"]] == [h["cause"] for h in source["hypotheses"]]
    assert [h["cause_label"] for h in row["hypotheses"]][0] == "Creative fatigue"
    assert row["hypotheses"][0]["signal_ids"] == source["hypotheses"][0]["signal_ids"]
    assert row["alternatives"] == source["alternatives"]
    assert row["recommendation"]["action"] == "rotate_creative"
    assert row["recommendation"]["params"]["creative_id"] == "42"
    assert [s["id"] for s in row["signals"]] == [s["id"] for s in source["signals"]]
    assert row["signals"][0]["measures"]["spend"] == source["signals"][0]["measures"]["spend"]


def test_missing_parts_have_defaults(spark):
    rows = R.opportunity_rows(investigated(spark)).withColumns({
        "evidence": F.lit("{}"), "diagnosis": F.lit(None).cast("string"),
        "recommendation": F.lit(None).cast("string"), "signals": F.lit("[]")})
    row = R.opportunity_detail(rows).first()
    assert (row["tree"], row["hypotheses"], row["recommendation"]) == (None, None, None)
    assert (row["alternatives"], row["trust"], row["protected"]) == ([], "ok", False)
    numbers = {r["value"] for r in R.evidence_numbers(R.opportunity_detail(rows)).collect()}
    assert numbers == {7.0, row["impact"], 30.0, 10.0, 2026.0, 0.0}


def test_texts_quote_only_permitted_numbers(spark):
    found = investigated(spark)
    detail = staged(R.opportunity_detail(R.opportunity_rows(found)), "detail")
    numbers = {r["value"] for r in R.evidence_numbers(detail).collect()}
    signal = found.first()["signals"][0]
    assert {signal["current"], abs(signal["change_pct"]), 0.0, 4.0, 7.0} <= numbers
    assert 5.0 not in numbers or len(found.first()["signals"]) > 4
    told = detail.select("row_key", F.col("observation").alias("text"))
    quoted = TX.numbers_in_text(told, "row_key", "text")
    assert quoted.count() and TX.ungrounded_numbers(
        quoted, R.evidence_numbers(detail), "row_key").count() == 0


def test_report_numbers(spark):
    week = dt.date(2026, 3, 29)
    kpis = "array(named_struct('metric', 'ctr', 'value', 0.05, 'previous', null, 'target', 0.06, " \
           "'change_pct', -12.5))"
    payload = spark.range(1).selectExpr(
        f"date'{week}' as week_end", f"date'{week - dt.timedelta(6)}' as week_start",
        f"{kpis} as kpis", "2500000D as issue_cost", "0D as win_upside", "2L as judged",
        "1L as worked", "3L as running", "cast(null as array<struct<budget: double, spent: double, "
        "spent_pct: double, remaining_budget: double, month_elapsed_pct: double, projected: double, "
        "daily_run_rate: double, suggested_daily: double>>) as pacing",
        "array(named_struct('metric', 'roas', 'current', 2D, 'baseline', 4D, 'impact', -300D, "
        "'change_pct', -50D, 'confidence', 0.8D)) as opportunities",
        "array('a', 'b', 'c', 'd') as decisions",
        "cast(null as array<struct<metric: string, before_value: double, after_value: double, "
        "sample_days: int>>) as experiments")
    got = {round(r["value"], 6) for r in R.report_numbers(payload).collect()}
    assert got == {7, 2500000, 0, 2, 1, 3, 23, 29, 2026, 4, 0.05, 5, 0.06, 6, 12.5, 300, 50, 0.8, 80,
                   25}


def test_history_and_report_of_a_day(spark):
    weeks = [dt.date(2026, 3, 1) + dt.timedelta(7 * i) for i in range(5)]
    reports = spark.createDataFrame(
        [(w - dt.timedelta(6), w) for w in weeks], "week_start date, week_end date")
    rows = R.report_history(reports, weeks[-1] + dt.timedelta(2), 3).collect()
    assert [r["week_end"] for r in rows] == weeks[:1:-1]
    assert not rows[0]["covered"] and rows[0]["next_week_end"] == dt.date(2026, 3, 31)
    assert R.report_history(reports, weeks[-1]).first()["covered"]
    assert R.report_of(reports, dt.date(2026, 3, 5)).first()["week_end"] == weeks[1]
