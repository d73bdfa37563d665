"""Queries of opportunity lists, the weekly report and the text checks."""

from __future__ import annotations

from pyspark.sql import functions as F

from adsight.functions import wording as WD
from adsight.operators import experiments as E
from adsight.operators import pacing as PC
from adsight.operators import report as R
from adsight.operators import textcheck as TX
from adsight.operators import trust as TR
from adsight.plans.detect_queries import whole_tracking
from adsight.plans.explain_queries import explained, share_of, stored
from adsight.plans.queries import query
from adsight.plans.stages import distinct_rows, staged
from adsight.sources import testtables as T
from adsight.sources import warehouse as WH


@query("opportunity_list")
def _(spark, sf):
    rows = R.opportunity_list(T.opportunities(spark, sf), ["open", "experimenting"], "issue", 50)
    return rows.select("id", "status", "kind", "priority", "score")


@query("opportunity_summary")
def _(spark, sf):
    return R.opportunity_summary(T.opportunities(spark, sf)).select(
        "id", "title", "band", "age_days", "cause_label", "signal_count", "current", "baseline",
        "change_pct")


@query("opportunity_headlines")
def _(spark, sf):
    rows = T.opportunities(spark, sf)
    return rows.select(
        "id", WD.title("entity_name", "primary_metric", "kind").alias("title"),
        WD.moved("change_pct").alias("moved"),
        WD.value_text("primary_metric", "current").alias("current_text"),
        WD.value_text("primary_metric", "baseline").alias("baseline_text"))


def found_again(spark, sf):
    """This run's opportunities: every second stored one, with the newest window."""
    return T.opportunities(spark, sf).filter("id % 2 = 0").select(
        "key", F.lit(T.AS_OF).alias("last_seen_date"),
        F.date_sub(F.lit(T.AS_OF), 6).alias("window_start"), (F.col("score") * 2).alias("score"))


@query("seen_dates")
def _(spark, sf):
    return R.seen_dates(found_again(spark, sf).select("key", "window_start"),
                        T.opportunities(spark, sf))


@query("first_seen")
def _(spark, sf):
    seen = R.seen_dates(found_again(spark, sf).select("key", "window_start"),
                        T.opportunities(spark, sf))
    return seen.select("key", R.first_seen(
        "window_start", "first_seen_date", "last_seen_date").alias("first_seen"))


@query("save_opportunities")
def _(spark, sf):
    new = found_again(spark, sf).unionByName(
        found_again(spark, sf).withColumn("key", F.concat(F.col("key"), F.lit("-new"))))
    return R.save_opportunities(T.opportunities(spark, sf).filter("id % 5 <> 0"), new)


@query("weekly_issue_win_totals")
def _(spark, sf):
    return R.issue_win_totals(T.opportunities(spark, sf), T.AS_OF)


def weekly(spark, sf):
    ads, store = T.ad_facts(spark, sf), T.store_facts(spark, sf)
    broken = TR.unreliable_metrics(whole_tracking(spark, sf)).select("as_of")
    return R.weekly_payload(
        ads, store, T.SETTINGS, PC.budgets_frame(spark, T.BUDGETS), T.opportunities(spark, sf),
        T.decisions(spark, sf), T.experiments(spark, sf), broken, T.AS_OF)


@query("weekly_payload")
def _(spark, sf):
    return weekly(spark, sf)


@query("report_lines")
def _(spark, sf):
    return R.report_lines(weekly(spark, sf)).select("week_end", "summary", "detail")


@query("report_markdown")
def _(spark, sf):
    return R.report_markdown(staged(R.report_lines(weekly(spark, sf)), "reports"))


def stored_reports(spark, sf):
    """Stores every week and regenerates the newest ones; the table as it is then."""
    rows = staged(R.report_rows(R.report_lines(weekly(spark, sf))), "report_rows")
    path = WH.scratch(spark, "reports")
    WH.upsert(spark, path, rows, ["week_end"], "week_end")
    WH.upsert(spark, path, rows.filter(F.col("week_end") >= F.date_sub(F.lit(T.AS_OF), 30))
              .withColumn("source", F.lit("regenerated")), ["week_end"], "week_end")
    return WH.read(spark, path)


@query("save_report")
def _(spark, sf):
    return stored_reports(spark, sf).select(
        "week_end", "week_start", "source", "grounded", "narrative")


@query("report_history")
def _(spark, sf):
    """The newest stored reports with the revenue their payload holds."""
    payload = F.from_json("payload", "kpis array<struct<metric: string, value: double>>")
    return R.report_history(stored_reports(spark, sf), T.AS_OF).select(
        "week_end", "week_start", "source", "next_week_end", "covered",
        F.filter(payload["kpis"], lambda k: k["metric"] == "store_revenue")[0]["value"].alias(
            "store_revenue"))


@query("report_numbers")
def _(spark, sf):
    return R.report_numbers(weekly(spark, sf)).select(
        "week_end", F.round("value", 6).alias("value")).distinct()


@query("ungrounded_report_numbers")
def _(spark, sf):
    """Numbers in the report texts that their payload does not permit: none."""
    reports = staged(R.report_lines(weekly(spark, sf)), "reports")
    # Digits of a name are no number that the text quotes.
    told = reports.select("week_end", F.regexp_replace(F.array_join(
        F.concat("summary", "detail"), " "), "Customer#[0-9]+", "it").alias("text"))
    numbers = TX.numbers_in_text(told, "week_end", "text")
    return TX.ungrounded_numbers(numbers, R.report_numbers(reports), "week_end").groupBy(
        "week_end", "value").agg(F.count(F.lit(1)).alias("times"))


def details(spark, sf):
    """Stored rows of every as-of date, read back."""
    return R.opportunity_detail(staged(R.opportunity_rows(explained(spark, sf)), "opportunities"))


@query("opportunity_detail")
def _(spark, sf):
    return details(spark, sf).select(
        "row_key", "kind", "title", "band", "cause_label", "trust", "protected", "observation",
        F.transform("hypotheses", lambda h: h["cause_label"]).alias("causes"), "alternatives",
        "recommendation.action", F.transform("signals", lambda s: s["id"]).alias("signal_ids"))


@query("opportunity_tree")
def _(spark, sf):
    return details(spark, sf).select("row_key", F.inline("tree")).withColumns({
        "change_pct": F.round("change_pct", 6), "share_pct": share_of("share_pct")})


@query("evidence_numbers")
def _(spark, sf):
    return R.evidence_numbers(details(spark, sf))


@query("opportunity_rows")
def _(spark, sf):
    return R.opportunity_rows(explained(spark, sf))


@query("quotable_numbers")
def _(spark, sf):
    opportunities = T.opportunities(spark, sf)
    numbers = R.quotable_numbers(opportunities).select("id", F.round("value", 6).alias("value"))
    return distinct_rows(numbers, opportunities.count() * R.QUOTED)


# --- text checks --------------------------------------------------------------------------
def document_numbers(spark, sf):
    return TX.numbers_in_text(T.table(spark, sf, "documents"), "doc_id", "text")


@query("numbers_in_text")
def _(spark, sf):
    return document_numbers(spark, sf).groupBy("doc_id", "value").agg(
        F.count(F.lit(1)).alias("times"))


@query("ungrounded_numbers")
def _(spark, sf):
    documents = T.table(spark, sf, "documents")
    words = F.size(F.split("text", " ")).cast("double")
    permitted = documents.select("doc_id", F.explode(F.array(
        F.col("n_chars").cast("double"), words, F.lit(100.0))).alias("value"))
    return TX.ungrounded_numbers(document_numbers(spark, sf), permitted, "doc_id").groupBy(
        "doc_id", "value").agg(F.count(F.lit(1)).alias("times"))


@query("ungrounded_references")
def _(spark, sf):
    """Cited ids outside the evidence, and proposed actions that are not available."""
    rows = stored(spark, sf).withColumn(
        "key", F.concat("entity_level", F.lit(":"), "entity_key", F.lit("#"), "id"))
    known = rows.select("id", F.explode(F.array("key", "entity_name")).alias("signal_id"))
    cited = rows.select("id", F.explode(F.array(
        F.when(F.col("id") % 3 == 0, F.concat(F.col("key"), F.lit("?"))).otherwise(F.col("key")),
        F.col("entity_name"))).alias("signal_id"))
    bad_ids = TX.ungrounded_references(cited, known, "id").select(
        "id", F.concat(F.lit("unknown id "), F.col("signal_id")).alias("problem"))
    proposed = rows.withColumn("action", T.pick(
        ("pause_creative", "rotate_creative", "refine_audience", "investigate_landing_page",
         "fix_tracking", "shift_budget", "adjust_pacing", "raise_bids"), F.col("id") % 8))
    bad_actions = TX.invalid_actions(proposed).select(
        "id", F.concat_ws(": ", "action", "reason").alias("problem"))
    return bad_ids.unionByName(bad_actions)


@query("grounding_score")
def _(spark, sf):
    from pyspark.sql import Window

    turns = T.table(spark, sf, "conversations")
    last = F.max("turn").over(Window.partitionBy("conv_id"))
    return TX.grounding_score(turns.select(
        F.col("role").alias("purpose"), (F.col("turn") + 1).alias("attempt"),
        (F.col("turn") % 2 == 0).alias("grounded"), (F.col("turn") == last).alias("fallback"),
        F.when(F.length("text") < 200, "too short").alias("error")))
