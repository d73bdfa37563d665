"""Opportunity lists, the weekly report and its sentences."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from adsight.functions import catalogue as C
from adsight.functions import kpi as K
from adsight.functions import wording as WD
from adsight.operators import metrics as M
from adsight.operators import explain as X
from adsight.operators import pacing as PC
from adsight.operators.recommend import band

TOP_OPPORTUNITIES = 5
MAX_DECISIONS = 8
LISTED_EXPERIMENTS = 100    # newest of a week that its report names; counts cover all


# --- lists ----------------------------------------------------------------------------------
def opportunity_list(
    opportunities: DataFrame, status: list[str] | None = None, kind: str | None = None,
    limit: int = 50,
) -> DataFrame:
    """Most urgent first; rows without a priority come last."""
    rows = opportunities
    if status:
        rows = rows.filter(F.col("status").isin(*status))
    if kind:
        rows = rows.filter(F.col("kind") == kind)
    return rows.orderBy(F.desc_nulls_last("priority"), F.desc("score"), "id").limit(limit)


def opportunity_summary(opportunities: DataFrame) -> DataFrame:
    """List rows: title, band, age and cause label from the stored columns."""
    return opportunities.withColumns({
        "title": WD.title("entity_name", "primary_metric", "kind"),
        "band": band("priority"),
        "age_days": F.datediff("last_seen_date", "first_seen_date"),
        "cause_label": K.lookup(C.CAUSE_LABELS, "cause"),
    })


def first_seen(window_start: K.ColumnLike, first: K.ColumnLike, last: K.ColumnLike) -> Column:
    """When a problem started: the earlier date, restarted after a gap of over a window."""
    start, gone = K.col(window_start), F.datediff(K.col(window_start), K.col(last))
    return F.when(gone > C.WINDOW_DAYS, start).otherwise(
        F.least(F.coalesce(K.col(first), start), start))


def seen_dates(current: DataFrame, stored: DataFrame) -> DataFrame:
    """The current run's keys with the dates their stored row was first and last seen."""
    return current.join(
        stored.select("key", "first_seen_date", "last_seen_date"), "key", "left")


def save_opportunities(stored: DataFrame, current: DataFrame) -> DataFrame:
    """The stored table after a run, in one full join on the key.

    Both frames: (key, status, first_seen_date, last_seen_date, window_start, score); the current
    rows win, statuses survive, resolved rows found again reopen, open ones not found resolve.
    """
    old, new = stored.alias("old"), current.alias("new")
    both = old.join(new, F.col("old.key") == F.col("new.key"), "full_outer")
    found, status = F.col("new.key").isNotNull(), F.col("old.status")
    taken = lambda c: F.when(found, F.col(f"new.{c}")).otherwise(F.col(f"old.{c}"))
    return both.select(
        F.coalesce("old.key", "new.key").alias("key"),
        F.when(found, F.when(status.isNull() | (status == "resolved"), "open").otherwise(status))
        .when(status == "open", "resolved").otherwise(status).alias("status"),
        F.when(found, first_seen(
            "new.window_start", "old.first_seen_date", "old.last_seen_date"))
        .otherwise(F.col("old.first_seen_date")).alias("first_seen_date"),
        taken("last_seen_date").alias("last_seen_date"),
        taken("score").alias("score"))


def carry_status(found: DataFrame, runs: DataFrame) -> DataFrame:
    """What repeated runs make of every sighting: the stored state of all dates in one pass.

    ``found``: (key, as_of, window_start, last_seen_date, score), a key at most once a run;
    ``runs``: (as_of), one row per run, also those that found nothing. Adds first_seen_date (of the
    session: a gap of over a window starts a new one), reopened (a run in between missed it) and
    resolved_on (the next run, if that misses it; null while it is open). A window over one key has
    no more rows than there are runs.
    """
    ordered = Window.orderBy("as_of")   # one row per run
    dates = runs.select("as_of").distinct().select(
        "as_of", F.lag("as_of").over(ordered).alias("run_before"),
        F.lead("as_of").over(ordered).alias("run_after"))
    one = Window.partitionBy("key").orderBy("as_of")
    gone = F.datediff("window_start", F.lag("last_seen_date").over(one))
    marked = found.join(F.broadcast(dates), "as_of").withColumns({
        "seen_before": F.lag("as_of").over(one), "seen_after": F.lead("as_of").over(one),
        "starts": F.coalesce(gone > C.WINDOW_DAYS, F.lit(True)).cast("int")})
    session = marked.withColumn("session", F.sum("starts").over(one))
    inside = Window.partitionBy("key", "session").orderBy("as_of")
    return session.select(
        "key", "as_of", F.min("window_start").over(inside).alias("first_seen_date"),
        "last_seen_date", "score",
        F.coalesce(F.col("seen_before") < F.col("run_before"), F.lit(False)).alias("reopened"),
        F.when(~F.col("seen_after").eqNullSafe(F.col("run_after")), F.col("run_after")).alias(
            "resolved_on"))


def stored_at(carried: DataFrame, as_of: K.ColumnLike | dt.date) -> DataFrame:
    """The stored table after the run of a date, from the carried sightings."""
    day = F.lit(as_of) if isinstance(as_of, dt.date) else K.col(as_of)
    last = carried.filter(F.col("as_of") <= day).groupBy("key").agg(F.max_by(
        F.struct("first_seen_date", "last_seen_date", "score", "resolved_on"), "as_of").alias("s"))
    over = F.coalesce(F.col("s.resolved_on") <= day, F.lit(False))
    return last.select(
        "key", F.when(over, "resolved").otherwise("open").alias("status"), "s.first_seen_date",
        "s.last_seen_date", "s.score")


def week_of(day: K.ColumnLike, last: dt.date) -> Column:
    """End of the seven-day week a day belongs to, weeks counted back from ``last``."""
    back = F.floor(F.datediff(F.lit(last), K.col(day)) / C.WINDOW_DAYS).cast("int")
    return F.date_sub(F.lit(last), back * C.WINDOW_DAYS)


def issue_win_totals(opportunities: DataFrame, last: dt.date) -> DataFrame:
    """Rupees at stake and counts by kind, per week of the window end."""
    amount = F.abs("impact")
    money = lambda c: F.sum(c.cast("decimal(24,6)")).cast("double")
    return opportunities.groupBy(week_of("window_end", last).alias("week_end")).agg(
        F.coalesce(money(F.when(F.col("kind") == "issue", amount)), F.lit(0.0)).alias(
            "issue_cost"),
        F.coalesce(money(F.when(F.col("kind") == "win", amount)), F.lit(0.0)).alias("win_upside"),
        F.count_if(F.col("kind") == "issue").alias("issues"),
        F.count_if(F.col("kind") == "win").alias("wins"))


def report_history(reports: DataFrame, as_of: K.ColumnLike | dt.date, limit: int = 52) -> DataFrame:
    """The newest stored reports and, in every row, the week a fresh report would cover.

    ``covered``: that week has a report already, which a fresh one would replace.
    """
    day = F.lit(as_of) if isinstance(as_of, dt.date) else K.col(as_of)
    newest = reports.orderBy(F.desc("week_end")).limit(limit)
    everything = Window.partitionBy(F.lit(1))   # at most ``limit`` rows
    return newest.withColumn("next_week_end", day).withColumn(
        "covered", F.max(F.col("week_end") == day).over(everything))


def report_of(reports: DataFrame, day: dt.date) -> DataFrame:
    """The stored report of the week that holds a day."""
    return reports.filter((F.col("week_start") <= F.lit(day)) & (F.col("week_end") >= F.lit(day)))


# --- weekly payload ---------------------------------------------------------------------------
def weekly_kpis(ads: DataFrame, store: DataFrame, settings: M.Settings, last: dt.date):
    """The headline metrics of every week against the week before."""
    daily = M.ad_daily(ads).unionByName(M.store_daily(store), allowMissingColumns=True)
    week = week_of("date", last)
    # A day counts as "now" for its own week and as "before" for the next one.
    tagged = daily.filter(F.col("date") <= F.lit(last)).withColumn("roles", F.array(
        F.struct(week.alias("week_end"), F.lit("now").alias("role")),
        F.struct(F.date_add(week, C.WINDOW_DAYS).alias("week_end"), F.lit("before").alias("role")),
    )).select("*", F.inline("roles")).filter(F.col("week_end") <= F.lit(last))
    measures = (*C.AD_MEASURES, *C.STORE_MEASURES)
    sums = tagged.groupBy("week_end").agg(*[
        F.expr(f"sum(if(role = '{r}', {m}, null)) as {r}_{m}")
        for r in ("now", "before") for m in measures])
    targets = M.account_targets(settings, F.col("week_end"))

    def line(metric: str) -> Column:
        now = K.metric_value(metric, lambda m: F.col("now_" + m))
        before = K.metric_value(metric, lambda m: F.col("before_" + m))
        target = M.target_of(targets, metric)
        status = K.goal_status(now, target, C.direction(metric) is not False)
        return F.struct(
            F.lit(metric).alias("metric"), now.alias("value"), before.alias("previous"),
            K.change_pct(before, now).alias("change_pct"),
            F.when(now.isNotNull(), target).alias("target"), status.alias("goal_status"))

    return sums.select("week_end", F.array(*[line(m) for m in C.TODAY_METRICS]).alias("kpis"))


def pacing_lines(ads: DataFrame, budgets: DataFrame, weeks: DataFrame) -> DataFrame:
    """(week_end, place, line): pacing of every budgeted channel at each week's end, spent or not.

    ``budgets``: (channel_id, budget), with a ``month`` (yyyy-MM) where budgets change. The total
    comes last, and only where more than one channel has a budget.
    """
    known = budgets.filter("budget > 0")
    dated = [c for c in ("month",) if c in known.columns]
    listed = weeks.select("week_end", F.date_format("week_end", "yyyy-MM").alias("month"), F.explode(
        F.array(*[F.lit(c) for c in C.CHANNELS])).alias("channel_id"))
    wanted = listed.join(known, ["channel_id", *dated]).select("week_end", "channel_id", "budget")
    daily = ads.groupBy("channel_id", "date").agg(F.sum("spend").alias("spend"))
    days = weeks.select("week_end", F.explode(
        F.sequence(F.trunc("week_end", "MM"), F.col("week_end"))).alias("date"))
    spent = days.join(daily, "date").groupBy("week_end", "channel_id").agg(
        F.sum("spend").alias("spent"))
    both = wanted.join(spent, ["week_end", "channel_id"], "left").withColumn(
        "labels", F.array("channel_id", F.lit("all"))).select(
        "week_end", F.explode("labels").alias("label"), F.coalesce(
            F.col("spent").cast("decimal(38,4)"), F.lit(0)).alias("spent"), "budget").groupBy(
        "week_end", "label").agg(F.sum("spent").alias("spent"), F.sum("budget").alias("budget"),
                                 F.count(F.lit(1)).alias("channels"))
    place = F.array_position(F.lit([*C.CHANNELS, "all"]), F.col("label"))
    return both.filter((F.col("label") != "all") | (F.col("channels") > 1)).select(
        "week_end", place.alias("place"), F.struct(
            F.when(F.col("label") == "all", C.ALL_CHANNELS).otherwise(
                K.lookup(C.SOURCE_LABELS, "label")).alias("label"),
            *[c.alias(n) for n, c in PC.pace("budget", "spent", F.col("week_end")).items()]
        ).alias("line"))


def weekly_pacing(ads: DataFrame, budgets: DataFrame, weeks: DataFrame) -> DataFrame:
    """The pacing lines of each week in order; at most one per channel and the total."""
    listed = F.array_sort(F.collect_list(F.struct("place", "line")))
    return pacing_lines(ads, budgets, weeks).groupBy("week_end").agg(
        F.transform(listed, lambda p: p["line"]).alias("pacing"))


def weekly_experiments(experiments: DataFrame, last: dt.date) -> DataFrame:
    """(week_end, experiment): the ones judged in a week, and those under test at its end.

    An experiment is under test from its start to the day before it is judged, or else before it is
    due, so it belongs to a bounded number of weeks whatever the table holds.
    """
    judged = experiments.filter("evaluated_on is not null").withColumn(
        "week_end", week_of("evaluated_on", last))
    until = F.coalesce("evaluated_on", "ends_on")
    first = week_of("started_on", last)
    running = experiments.filter(
        F.col("started_on").isNotNull() & (F.col("started_on") < until)).withColumn(
        "week_end", F.explode(F.sequence(first, F.greatest(
            first, week_of(F.date_sub(until, 1), last)), F.expr("interval 7 days")))).filter(
        F.col("week_end") < until).withColumns({
            "verdict": F.lit(None).cast("string"), "after_value": F.lit(None).cast("double")})
    return judged.unionByName(running).filter(F.col("week_end") <= F.lit(last))


def weekly_payload(
    ads: DataFrame, store: DataFrame, settings: M.Settings, budgets: DataFrame,
    opportunities: DataFrame, decisions: DataFrame, experiments: DataFrame,
    unreliable: DataFrame, last: dt.date,
) -> DataFrame:
    """One nested row per week with every number a report may contain.

    ``unreliable``: (as_of) dates with broken tracking. Lists are cut to their report length
    before they are collected, so no week gathers an unbounded group.
    """
    kpis = weekly_kpis(ads, store, settings, last)
    pacing = weekly_pacing(ads, budgets, kpis.select("week_end"))
    order = Window.partitionBy("week_end", "kind").orderBy(
        F.desc_nulls_last("priority"), F.desc("score"), "id")
    summaries = opportunity_summary(opportunities).withColumn(
        "week_end", week_of("window_end", last))
    top = summaries.withColumn("place", F.row_number().over(order)).filter(
        F.col("place") <= TOP_OPPORTUNITIES).groupBy("week_end").agg(F.sort_array(F.collect_list(
            F.struct("kind", "place", "id", "band", "title", F.col("primary_metric").alias(
                "metric"), "current", "baseline", "change_pct", "impact", "confidence"))).alias(
            "opportunities"))
    newest = Window.partitionBy("week_end").orderBy(F.desc("created_on"), F.desc("id"))
    titles = summaries.select(F.col("id").alias("opportunity_id"), "title")
    decided = decisions.withColumn("week_end", week_of("created_on", last)).withColumn(
        "place", F.row_number().over(newest)).filter(F.col("place") <= MAX_DECISIONS).join(
        titles, "opportunity_id").groupBy("week_end").agg(F.sort_array(F.collect_list(
            F.struct("place", "kind", "title", "reason"))).alias("decisions"))
    tested = weekly_experiments(experiments, last)
    newest_tested = Window.partitionBy("week_end", "group").orderBy(F.desc("id"))
    listed = tested.withColumn("group", F.col("verdict").isNotNull()).withColumn(
        "place", F.row_number().over(newest_tested)).filter(
        F.col("place") <= LISTED_EXPERIMENTS).join(titles, "opportunity_id").groupBy(
        "week_end").agg(F.sort_array(F.collect_list(F.struct(
            "group", "id", "title", "action", "metric", "verdict", "before_value", "after_value",
            "sample_days")), asc=False).alias("experiments"))
    counts = tested.groupBy("week_end").agg(
        F.count("verdict").alias("judged"), F.count_if(F.col("verdict").isNull()).alias("running"),
        F.count_if(F.col("verdict") == "worked").alias("worked"))
    doubtful = unreliable.select(F.col("as_of").alias("week_end")).distinct().withColumn(
        "trust_warning", F.lit(True))
    payload = kpis
    for part in (pacing, top, decided, listed, counts, issue_win_totals(opportunities, last),
                 doubtful):
        payload = payload.join(part, "week_end", "left")
    zero = F.lit(0).cast("bigint")
    return payload.withColumns({
        "week_start": F.date_sub("week_end", C.WINDOW_DAYS - 1),
        "trust_warning": F.coalesce("trust_warning", F.lit(False)),
        "issue_cost": F.coalesce("issue_cost", F.lit(0.0)),
        "win_upside": F.coalesce("win_upside", F.lit(0.0)),
        **{n: F.coalesce(n, zero) for n in ("judged", "running", "worked")},
    })


# --- sentences --------------------------------------------------------------------------------
def says(name: str, *values: Column) -> Column:
    """A fixed sentence of the report with its values."""
    return WD.filled(C.REPORT[name], *values)


def _or_nothing(text: Column) -> Column:
    return F.coalesce(text, F.lit(""))


def kpi_line(k: Column, unreliable: Column) -> Column:
    value = lambda v: WD.value_or_na(k["metric"], v)
    goal = F.when(k["target"].isNotNull() & k["goal_status"].isNotNull(), F.concat_ws(
        " ", K.lookup(C.GOAL_WORDS, k["goal_status"]), value(k["target"])))
    doubt = F.when(unreliable & k["metric"].isin(*C.PLATFORM_METRICS), says("doubtful"))
    return F.concat_ws(
        ", ", F.concat_ws(" ", WD.capitalised(WD.label(k["metric"])), value(k["value"])),
        F.when(k["change_pct"].isNotNull(), says("on_last_week", WD.moved(k["change_pct"]))),
        goal, doubt)


def pacing_line(p: Column) -> Column:
    daily = F.when(p["suggested_daily"].isNotNull(), says(
        "suggested", WD.rupees(p["suggested_daily"])))
    return says(
        "pacing", p["label"], WD.plain(p["spent_pct"]), WD.rupees(p["budget"]),
        WD.plain(p["month_elapsed_pct"]), K.lookup(C.PACE_WORDS, p["status"]), _or_nothing(daily))


def opportunity_line(o: Column) -> Column:
    value = lambda v: WD.value_or_na(o["metric"], v)
    against = F.when(o["baseline"].isNotNull(), says("against", value(o["baseline"])))
    change = F.when(o["change_pct"].isNotNull(), says("change", WD.moved(o["change_pct"])))
    return says(
        "opportunity", F.upper(o["band"]), o["title"], WD.label(o["metric"]), value(o["current"]),
        _or_nothing(against), _or_nothing(change), WD.rupees(F.abs(o["impact"])))


def experiment_line(e: Column) -> Column:
    value = lambda v: WD.value_or_na(e["metric"], v)
    days = _or_nothing(says("over_days", e["sample_days"].cast("string")))
    told = says(
        "experiment", e["title"], WD.label(e["metric"]), value(e["before_value"]),
        value(e["after_value"]), days, K.lookup(C.VERDICT_WORDS, e["verdict"]))
    return F.when(e["verdict"].isNull(), says("measuring", e["title"])).otherwise(told)


def decision_line(d: Column) -> Column:
    word = F.coalesce(K.lookup(C.DECISION_WORDS, d["kind"]), d["kind"])
    return says("decision", word, d["title"], _or_nothing(says("reason", d["reason"])))


def report_lines(payload: DataFrame) -> DataFrame:
    """Adds ``summary`` and ``detail``: the report in words, from the payload alone."""
    lists = {c: F.coalesce(c, F.array()) for c in (
        "pacing", "opportunities", "experiments", "decisions")}
    base = payload.withColumns(lists)
    kpi = lambda m: F.try_element_at(
        F.filter("kpis", lambda k: k["metric"] == m), F.lit(1))
    revenue = kpi("store_revenue")
    week = says("week", F.date_format("week_end", "dd MMM yyyy"))
    amount = WD.rupees(revenue["value"])
    headline = (
        F.when(revenue["value"].isNull(), says("no_revenue", week))
        .when(revenue["change_pct"].isNull(), says("revenue", amount, week))
        .otherwise(says("revenue_moved", amount, week, WD.moved(revenue["change_pct"]))))
    behind = F.filter("kpis", lambda k: k["goal_status"] == "behind")
    goals = F.when(F.size(behind) == 0, says("goals_met")).otherwise(
        says("behind", F.array_join(F.transform(behind, lambda k: F.concat(
            WD.label(k["metric"]), F.lit(" "), WD.value_or_na(k["metric"], k["value"]))), ", ")))
    count = lambda kind: F.size(
        F.filter("opportunities", lambda o: o["kind"] == kind))
    issues, wins, decided = count("issue"), count("win"), F.size("decisions")
    number = lambda n, one, many: (n.cast("string"), WD.plural(n, one, many))
    cost = (*number(issues, "issue", "issues"), WD.rupees("issue_cost"))
    issue_text = F.when(F.col("issue_cost") != 0, F.when(
        issues > 1, says("issues", *cost)).otherwise(says("issue", *cost)))
    win_text = F.when(F.col("win_upside") != 0, says(
        "wins", *number(wins, "opportunity", "opportunities"), WD.rupees("win_upside")))
    judged = F.col("judged")
    recorded = number(decided, "decision", "decisions")
    changes = (
        F.when(decided == 0, says("no_decisions"))
        .when(judged == 0, says("decisions", *recorded))
        .otherwise(says("judged", *recorded, judged.cast("string"),
                        F.col("worked").cast("string"))))
    doubt = F.col("trust_warning")
    lines = {
        "kpis": lambda k: kpi_line(k, doubt), "pacing": pacing_line,
        "opportunities": opportunity_line, "experiments": experiment_line,
        "decisions": decision_line}
    sections = [(C.SECTIONS[name], F.transform(name, line)) for name, line in lines.items()]
    detail = F.array_compact(F.array(*[
        F.when(F.size(told) > 0, F.concat(F.lit(heading + ". "), F.array_join(told, " ")))
        for heading, told in sections]))
    return base.withColumns({
        "summary": F.array_compact(F.array(headline, goals, issue_text, win_text, changes)),
        "detail": detail})


def report_markdown(reports: DataFrame) -> DataFrame:
    """Reports with lines as one Markdown text per week."""
    weeks = says("title", F.date_format("week_start", "d MMM"),
                 F.date_format("week_end", "d MMM yyyy"))
    founder = F.transform("summary", lambda line: F.concat(F.lit("- "), line))

    def section(paragraph: Column) -> Column:
        at = F.instr(paragraph, ". ")
        split = (at > 0) & (at <= 41)
        heading = F.when(split, F.substring(paragraph, F.lit(1), at - 1)).otherwise("Detail")
        body = F.when(split, F.substring(paragraph, at + 2, F.length(paragraph))).otherwise(
            paragraph)
        return F.concat(F.lit("## "), heading, F.lit("\n\n"), body, F.lit("\n"))

    note = says("template_note")
    return reports.select("week_end", F.concat_ws(
        "\n", weeks, F.lit(""), says("founder"), F.lit(""),
        F.array_join(founder, "\n"), F.lit(""),
        F.array_join(F.transform("detail", section), "\n"), note).alias("markdown"))


def report_rows(reports: DataFrame) -> DataFrame:
    """Stored form, keyed on the week: payload as JSON, narrative, source."""
    numbers = [c for c in reports.columns if c not in ("summary", "detail")]
    return reports.select(
        "week_end", "week_start", F.to_json(F.struct(*numbers)).alias("payload"),
        F.struct("summary", "detail").alias("narrative"), F.lit("template").alias("source"),
        F.lit(True).alias("grounded"))


def opportunity_rows(investigated: DataFrame) -> DataFrame:
    """One nested, storable row per opportunity; dates in the JSON columns read ISO."""
    return investigated.select(
        F.concat_ws("@", "opportunity", "as_of").alias("row_key"), F.col("opportunity").alias("key"),
        "as_of", "kind", F.col("level").alias("entity_level"), F.col("key").alias("entity_key"),
        F.col("name").alias("entity_name"), "channel_id", "window_start", "window_end",
        F.col("primary.metric").alias("primary_metric"),
        F.col("primary.detector").alias("primary_detector"), "impact", "score",
        F.to_json("signals").alias("signals"),
        F.to_json(F.struct("root", "drivers", "cpc_drivers", "trust", "protected")).alias(
            "evidence"),
        F.to_json(F.struct("observation", "hypotheses", "alternatives")).alias("diagnosis"),
        F.to_json("recommendation").alias("recommendation"), "confidence", "priority")


# --- stored rows read back -------------------------------------------------------------------
def _json_types() -> dict[str, str]:
    """Types of the JSON columns of a stored opportunity."""
    measures = "struct<" + ", ".join(f"{m}: double" for m in C.ALL_MEASURES) + ">"
    signal = (
        "struct<id: string, detector: string, metric: string, current: double, baseline: double, "
        f"change_pct: double, impact: double, score: double, measures: {measures}, "
        f"baseline_measures: {measures}>")
    drivers = ("array<struct<ord: int, driver: string, before: double, after: double, "
               "change_pct: double, share_pct: double>>")
    params = ", ".join(f"{name}: string" for name in (
        "target_level", "target_key", "channel", "creative_id", "ad_set_id", "campaign_id",
        "direction"))
    return {
        "signals": f"array<{signal}>",
        "evidence": (f"struct<root: {signal}, drivers: {drivers}, cpc_drivers: {drivers}, "
                     "trust: string, protected: boolean>"),
        "diagnosis": ("struct<observation: string, hypotheses: array<struct<cause: string, "
                      "statement: string, signal_ids: array<string>>>, alternatives: "
                      "array<string>>"),
        "recommendation": (
            "struct<action: string, rationale: string, impact_low: double, impact_high: double, "
            "confidence: double, risk: string, watch: string, stop_condition: string, "
            f"params: struct<{params}>>"),
    }


def opportunity_detail(rows: DataFrame) -> DataFrame:
    """Stored opportunities as the detail page has them: what happened, why, cause and action.

    ``rows``: the stored form (:func:`opportunity_rows`). JSON columns are read back by their types;
    the tree comes as an array of nodes from the root down, each with the good direction of its
    metric. A missing verdict reads as ok, missing protection as none. Nothing is shuffled.
    """
    read = rows.withColumns({
        name: F.from_json(name, kind) for name, kind in _json_types().items()})
    flat = read.select(
        "*", F.col("evidence.root").alias("root"), F.col("evidence.drivers").alias("drivers"),
        F.col("evidence.cpc_drivers").alias("cpc_drivers"))
    cause = F.try_element_at(F.col("diagnosis.hypotheses"), F.lit(1))["cause"]
    labels = lambda c: K.lookup(C.CAUSE_LABELS, c)
    better = {m: C.direction(m) for m in C.METRICS if C.direction(m) is not None}
    tree = F.transform(X.tree_nodes(), lambda n: n.withField(
        "higher_is_better", K.lookup(better, n["metric"])))
    return flat.select(
        "row_key", "key", "as_of", "kind", WD.title("entity_name", "primary_metric", "kind").alias(
            "title"), "window_start", "window_end", "impact", "confidence", "priority",
        band("priority").alias("band"), labels(cause).alias("cause_label"),
        F.col("diagnosis.observation").alias("observation"),
        F.when(F.col("root").isNotNull(), tree).alias("tree"),
        F.transform("diagnosis.hypotheses", lambda h: h.withField(
            "cause_label", labels(h["cause"]))).alias("hypotheses"),
        F.coalesce("diagnosis.alternatives", F.array().cast("array<string>")).alias("alternatives"),
        "recommendation", "signals", F.coalesce("evidence.trust", F.lit("ok")).alias("trust"),
        F.coalesce("evidence.protected", F.lit(False)).alias("protected"))


# --- numbers a text may quote ----------------------------------------------------------------
def _value_numbers(metric: Column, *values: Column) -> Column:
    """A value as it is and as a reader sees it (per cent)."""
    return F.flatten(F.array(*[F.array(v, WD.as_shown(metric, v)) for v in values]))


def _counts(*lists: Column) -> Column:
    """0 to the longest of some lists, as doubles."""
    most = F.greatest(*[F.coalesce(F.size(c), F.lit(0)) for c in (*lists, F.array())])
    return F.transform(F.sequence(F.lit(0), most), lambda n: n.cast("double"))


def _each(column: str, numbers) -> Column:
    """Numbers of every element of a list column."""
    return F.coalesce(F.flatten(F.transform(column, numbers)), F.array().cast("array<double>"))


def _absolute(*parts: Column) -> Column:
    doubles = F.concat(*[F.transform(p, lambda v: v.cast("double")) for p in parts])
    return F.array_distinct(F.transform(F.array_compact(doubles), lambda v: F.abs(v)))


def _date_numbers(end: str) -> Column:
    return F.array(F.dayofmonth(end), F.month(end), F.year(end)).cast("array<double>")


def report_numbers(payload: DataFrame) -> DataFrame:
    """(week_end, value): every number the report of a week may quote.

    Values and targets as they are and as shown, changes, pacing, impacts, confidence as a share
    and in per cent, counts of the report's own rows from 0 up, the dates, and, as a reader takes
    "16.4 L" for two numbers, everything scaled to lakhs and crores.
    """
    pacing = ("budget", "spent", "spent_pct", "remaining_budget", "month_elapsed_pct", "projected",
              "daily_run_rate", "suggested_daily")
    plain = _absolute(
        F.array(F.lit(float(C.WINDOW_DAYS)), F.col("issue_cost"), F.col("win_upside"),
                F.col("worked").cast("double"), F.col("judged").cast("double"),
                F.col("running").cast("double"), F.dayofmonth("week_start").cast("double"),
                F.month("week_start").cast("double")),
        _date_numbers("week_end"),
        _counts(*[F.col(c) for c in ("kpis", "opportunities", "decisions", "experiments")]),
        _each("kpis", lambda k: F.concat(
            _value_numbers(k["metric"], k["value"], k["previous"], k["target"]),
            F.array(k["change_pct"]))),
        _each("pacing", lambda p: F.array(*[p[c].cast("double") for c in pacing])),
        _each("opportunities", lambda o: F.concat(
            _value_numbers(o["metric"], o["current"], o["baseline"]),
            F.array(o["impact"], o["change_pct"], o["confidence"], o["confidence"] * 100))),
        _each("experiments", lambda e: F.concat(
            _value_numbers(e["metric"], e["before_value"], e["after_value"]),
            F.array(e["sample_days"].cast("double")))))
    scaled = lambda by: F.transform(
        F.filter("plain", lambda v: v >= by), lambda v: v / by)
    return payload.withColumn("plain", plain).select("week_end", F.explode(
        F.array_distinct(F.concat("plain", scaled(1e5), scaled(1e7)))).alias("value"))


def evidence_numbers(detail: DataFrame) -> DataFrame:
    """(row_key, value): every number a text about one opportunity may quote.

    ``detail``: :func:`opportunity_detail`. Signals with both measure sets, every node of the tree,
    counts of the signals from 0 up, the days and end of the window.
    """
    sets = [f"{name}.{m}" for name in ("measures", "baseline_measures") for m in C.ALL_MEASURES]

    def of_signal(s: Column) -> Column:
        measures = [s[a][b] for a, b in (c.split(".") for c in sets)]
        return F.concat(_value_numbers(s["metric"], s["current"], s["baseline"]), F.array(
            s["change_pct"], s["impact"], s["score"], *measures))

    numbers = _absolute(
        F.array(F.datediff("window_end", "window_start").cast("double") + 1, F.col("impact")),
        _date_numbers("window_end"), _counts(F.col("signals")), _each("signals", of_signal),
        _each("tree", lambda n: F.concat(
            _value_numbers(n["metric"], n["before"], n["after"]),
            F.array(n["change_pct"], n["share_pct"]))))
    return detail.select("row_key", F.explode(numbers).alias("value"))


QUOTED = 12     # numbers of an opportunity that are quotable unscaled


def quotable_numbers(opportunities: DataFrame) -> DataFrame:
    """Every number a text about an opportunity may quote: values, shown values, dates, scales."""
    shown = lambda c: WD.as_shown("primary_metric", c)
    base = F.array(
        "current", shown("current"), "baseline", shown("baseline"), "change_pct", "impact",
        "confidence", F.col("confidence") * 100,
        F.dayofmonth("window_end").cast("double"), F.month("window_end").cast("double"),
        F.year("window_end").cast("double"),
        (F.datediff("window_end", "window_start") + 1).cast("double"))
    scaled = lambda by: F.transform(
        F.filter(base, lambda v: F.abs(v) >= by), lambda v: v / by)
    numbers = F.concat(base, scaled(1e5), scaled(1e7))
    return opportunities.select("id", F.explode(F.array_distinct(F.transform(
        F.array_compact(numbers), lambda v: F.abs(v)))).alias("value"))
