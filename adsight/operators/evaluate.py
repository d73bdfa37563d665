"""Accuracy against labelled events: episodes, matching and scores."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from adsight.functions import catalogue as C
from adsight.functions import kpi as K
from adsight.functions import periods as P
from adsight.operators import group as G
from adsight.operators.windows import islands

BUCKET_DAYS = 28


def _strings(values) -> Column:
    return F.array(*[F.lit(v) for v in values]).cast("array<string>")


def _list_map(mapping: dict[str, tuple[str, ...]]) -> Column:
    return F.create_map(*[x for k, v in mapping.items() for x in (F.lit(k), _strings(v))])


# --- labelled events --------------------------------------------------------------------------
def read_events(spark, path: str, multi_line: bool = True) -> DataFrame:
    """The ``events`` array of labelled-event documents as rows; one document per file or line."""
    schema = (
        "events array<struct<id:string,type:string,start:date,end:date,onset:string,"
        "target:struct<level:string,platform_id:string,source:string,age_group:string>,"
        "affected_metrics:array<struct<metric:string>>,expected_signal_type:string,"
        "expected_action:string>>")
    documents = spark.read.schema(schema).option("multiLine", multi_line).json(path)
    return documents.select(F.inline("events"))


def labelled_events(raw: DataFrame, lineage: DataFrame) -> DataFrame:
    """Events with the entities, metrics and detectors an alert about them may carry."""
    kind, level = F.col("type"), F.col("target.level")
    target, source = F.col("target.platform_id"), F.col("target.source")
    channel = F.when(source.isNotNull(), F.concat(F.lit("channel:"), source))
    # An external id names an entity together with its platform.
    known = lineage.select(
        F.struct("channel_id", "level", "key").alias("named"), "entity_id", "ancestors").distinct()
    placed = raw.withColumn("named", F.when(target.isNotNull(), F.struct(
        source.alias("channel_id"), level.alias("level"), target.alias("key"))))
    joined = placed.join(known, "named", "left")
    entity = F.when(target.isNotNull(), F.coalesce("entity_id", F.concat_ws(":", level, target)))
    on_channel = F.array_compact(F.array(channel))
    segment = F.when((level == "ad_set") & F.col("target.age_group").isNotNull(), F.concat(
        F.lit("age_group:"), F.substring_index(entity, ":", -1), F.lit("|"), F.col("target.age_group")))
    near = F.filter(
        F.coalesce("ancestors", F.array().cast("array<string>")),
        lambda a: a.startswith("campaign:") | a.startswith("ad_set:"))
    own = F.array_compact(F.array(entity, segment))
    entities = (
        F.when(kind.isin(*C.WEB_ONLY_EVENTS), on_channel)
        .when(level == "account", F.array().cast("array<string>"))
        .when((level == "source") | target.isNull(), on_channel)
        .when(kind.isin(*C.ANCESTOR_EVENTS), F.concat(own, near))
        .otherwise(own))
    listed = F.array_except(
        F.transform("affected_metrics", lambda m: m["metric"]),
        _strings(C.UNTRACKED_EVENT_METRICS))
    none = _strings(())
    extra = F.coalesce(F.try_element_at(_list_map(C.EVENT_EXTRA_METRICS), kind), none)
    return joined.select(
        "id", F.col("type").alias("kind"), "start", "end", "onset",
        F.array_distinct(entities).alias("entities"),
        F.array_union(listed, extra).alias("metrics"),
        F.coalesce(F.try_element_at(_list_map(C.EVENT_DETECTORS), kind), none).alias("detectors"),
        F.coalesce(K.lookup(C.EVENT_KINDS, kind), F.lit("issue")).alias("kind_expected"),
        "expected_signal_type",
        F.coalesce(K.lookup(C.ACTION_ALIASES, "expected_action"), "expected_action").alias(
            "expected_action"),
        (kind != "no_issue").alias("injected"))


# --- episodes -----------------------------------------------------------------------------------
def sightings(opportunities: DataFrame) -> DataFrame:
    """Grouped opportunities of many as-of dates as sightings."""
    return opportunities.select(
        "as_of", F.col("opportunity").alias("key"), F.col("entity_id").alias("entity"), "kind",
        "window_start", "window_end", "score",
        F.transform("signals", lambda s: s["metric"]).alias("metrics"),
        F.transform("signals", lambda s: s["detector"]).alias("detectors"))


def _seen(column: str, values) -> dict[str, Column]:
    return {f"{column}_{v}": F.bool_or(F.array_contains(column, v)) for v in values}


def alert_episodes(seen: DataFrame, max_gap: int = C.MAX_GAP_DAYS) -> DataFrame:
    """Sightings of one key merged while at most ``max_gap`` days apart.

    Metric and detector sets are kept as flags of the fixed catalogues, so no list grows with an
    episode's length.
    """
    numbered = islands(seen, ["key"], "as_of", max_gap)
    flags = _seen("metrics", C.METRICS) | _seen("detectors", C.DETECTOR_TAGS)
    found = numbered.groupBy("key", "island").agg(
        F.min_by("entity", "as_of").alias("entity"), F.min_by("kind", "as_of").alias("kind"),
        F.min("as_of").alias("detected_on"), F.max("as_of").alias("closed_on"),
        F.min("window_start").alias("window_start"), F.max("window_end").alias("window_end"),
        F.max("score").alias("peak_score"), F.count(F.lit(1)).alias("days_open"),
        *[c.alias(n) for n, c in flags.items()])

    def named(column: str, values) -> Column:
        return F.sort_array(F.array_compact(F.array(*[
            F.when(F.col(f"{column}_{v}"), F.lit(v)) for v in values])))

    return found.select(
        "key", "entity", "kind", "detected_on", "closed_on", "window_start", "window_end",
        named("metrics", C.METRICS).alias("metrics"),
        named("detectors", C.DETECTOR_TAGS).alias("detectors"), "peak_score", "days_open")


def _buckets(start: str, end: str) -> Column:
    number = lambda d: F.floor(F.unix_date(F.col(d)) / BUCKET_DAYS)
    return F.sequence(number(start), number(end))


def match_episodes(events: DataFrame, episodes: DataFrame) -> DataFrame:
    """Pairs of injected events and the episodes that are about them.

    Events with entities meet episodes on (entity, kind). Account-wide ones meet them on kind,
    four-week bucket and a shared detector (or metric, if the event names no detector), so only
    pairs that agree on one meet; a pair counts once, in the bucket where both first overlap and at
    the first name they share.
    """
    e = events.filter("injected").select(
        F.col("id").alias("event_id"), F.col("kind").alias("event_kind"),
        F.col("start").alias("event_start"), F.col("end").alias("event_end"), "entities",
        F.col("metrics").alias("event_metrics"), F.col("detectors").alias("event_detectors"),
        F.col("kind_expected").alias("kind"))
    by_detector = F.size("event_detectors") > 0
    about = F.when(by_detector, F.arrays_overlap("detectors", "event_detectors")).otherwise(
        F.arrays_overlap("metrics", "event_metrics"))
    meets = P.overlaps("window_start", "window_end", "event_start", "event_end")
    narrow = e.filter(F.size("entities") > 0).withColumn("entity", F.explode("entities")).join(
        episodes, ["entity", "kind"]).filter(meets & about)
    named = lambda mark, names: F.transform(
        names, lambda n: F.concat(F.lit(mark), n))
    asked = F.array_distinct(F.when(by_detector, named("d:", "event_detectors")).otherwise(
        named("m:", "event_metrics")))
    shown = F.concat(named("d:", "detectors"), named("m:", "metrics"))
    wide = e.filter(F.size("entities") == 0).withColumn("asked", asked).withColumns({
        "bucket": F.explode(_buckets("event_start", "event_end"))}).withColumn(
        "name", F.explode("asked"))
    offered = episodes.withColumn("shown", shown).withColumn(
        "bucket", F.explode(_buckets("window_start", "window_end"))).withColumn(
        "name", F.explode(F.array_distinct("shown")))
    meeting = F.floor(F.unix_date(F.greatest("event_start", "window_start")) / BUCKET_DAYS)
    once = (F.col("bucket") == meeting) & (
        F.col("name") == F.element_at(F.array_intersect("asked", "shown"), 1))
    columns = ["event_id", "event_kind", "event_start", "event_end", "key", "detected_on",
               "closed_on", "kind", "peak_score"]
    return narrow.select(*columns).unionByName(wide.join(
        offered, ["kind", "bucket", "name"]).filter(meets & once).select(*columns))


def in_range(events: DataFrame, start: dt.date, end: dt.date) -> DataFrame:
    return events.filter(P.overlaps("start", "end", start, end))


def detected_events(events: DataFrame, matches: DataFrame) -> DataFrame:
    """Every injected event with its earliest episode (null when missed) and the lag in days."""
    first = matches.groupBy("event_id").agg(
        F.min(F.struct("detected_on", "key")).alias("first"))
    return events.filter("injected").join(
        first.withColumnRenamed("event_id", "id"), "id", "left").select(
        "id", "kind", "start", "end", F.col("first.detected_on").alias("detected_on"),
        F.col("first.key").alias("key"), "expected_action",
        F.datediff(F.col("first.detected_on"), F.col("start")).alias("lag"))


def unexplained(episodes: DataFrame, matches: DataFrame) -> DataFrame:
    return episodes.join(
        matches.select("key", "detected_on").distinct(), ["key", "detected_on"], "left_anti")


def _share(part: K.ColumnLike, whole: K.ColumnLike) -> Column:
    return F.coalesce(K.ratio(part, whole), F.lit(0.0))


def detection_score(
    events: DataFrame, episodes: DataFrame, start: dt.date, end: dt.date
) -> DataFrame:
    """Precision, recall, F1 and false-alarm rate over the span a replay could see."""
    visible = in_range(events, start, end)
    matches = match_episodes(visible, episodes)
    one = lambda frame: frame.withColumn("one", F.lit(1))
    hits = detected_events(visible, matches).agg(
        F.count(F.lit(1)).alias("injected"), F.count("detected_on").alias("detected"),
        F.count_if(F.col("lag") <= C.DAYS_TO_DETECT).alias("quick"))
    alerts = unexplained(episodes, matches)
    raised = episodes.agg(F.count(F.lit(1)).alias("episodes"))
    false = alerts.agg(F.count(F.lit(1)).alias("unexplained"))
    quiet = visible.filter("not injected")
    days = quiet.select("id", F.explode(F.sequence("start", "end")).alias("detected_on"))
    noisy = days.join(alerts.select("detected_on").distinct(), "detected_on", "left_semi").agg(
        F.count_distinct("id").alias("noisy_windows"))
    outside = events.filter("injected").filter(
        ~P.overlaps("start", "end", start, end)).agg(F.count(F.lit(1)).alias("out_of_range"))
    total = quiet.agg(F.count(F.lit(1)).alias("quiet_windows"))
    # Each part is a one-row aggregate.
    row = one(hits)
    for part in (raised, false, noisy, outside, total):
        row = row.join(F.broadcast(one(part)), "one")
    both = row.drop("one").withColumns({
        "missed": F.col("injected") - F.col("detected"),
        "precision": _share(F.col("episodes") - F.col("unexplained"), "episodes"),
        "recall": _share("detected", "injected"),
        "recall_within_3": _share("quick", "injected"),
        "false_alarm_rate": _share("noisy_windows", "quiet_windows")})
    return both.withColumn("f1", F.coalesce(F.try_divide(
        2 * F.col("precision") * F.col("recall"), F.col("precision") + F.col("recall")),
        F.lit(0.0))).drop("quick")


def recall_by_kind(detected: DataFrame) -> DataFrame:
    """Detected, detected in time and injected events per scenario type, with the median lag."""
    return detected.groupBy("kind").agg(
        F.count(F.lit(1)).alias("injected"), F.count("detected_on").alias("detected"),
        F.count_if(F.col("lag") <= C.DAYS_TO_DETECT).alias("in_time"),
        F.median("lag").alias("median_lag"), F.max("lag").alias("worst_lag"))


def split_suppressed(detected: DataFrame, festive: list[tuple]) -> DataFrame:
    """Outcome of every event: detected, missed, or quiet by design inside a sale window."""
    by_design = G.festive_overlap(festive, "start", "end")
    outcome = F.when(F.col("detected_on").isNotNull(), "detected").when(
        by_design, "suppressed").otherwise("missed")
    return detected.withColumn("outcome", outcome)


def false_positives(alerts: DataFrame, top: int = 15) -> DataFrame:
    return alerts.orderBy(F.desc("peak_score"), "key", "detected_on").limit(top)


def diagnosis_score(cases: DataFrame) -> DataFrame:
    """Top-1, top-3 and action accuracy by scenario type, with a total row (kind ``all``).

    ``cases``: (kind, causes array in rank order, action, expected_action).
    """
    first = F.coalesce(F.try_element_at("causes", F.lit(1)) == F.col("kind"), F.lit(False))
    three = F.array_contains(F.slice("causes", 1, 3), F.col("kind"))
    right = F.coalesce(F.col("action") == F.col("expected_action"), F.lit(False))
    judged = F.col("expected_action").isNotNull()
    flagged = cases.select(
        "kind", first.alias("top1_hit"), three.alias("top3_hit"),
        (judged & right).alias("action_hit"), judged.alias("judged"))
    counts = flagged.rollup("kind").agg(
        F.count(F.lit(1)).alias("cases"), F.count_if("top1_hit").alias("top1_hits"),
        F.count_if("top3_hit").alias("top3_hits"), F.count_if("action_hit").alias("action_hits"),
        F.count_if("judged").alias("action_cases"))
    return counts.withColumns({
        "kind": F.coalesce("kind", F.lit("all")), "top1": _share("top1_hits", "cases"),
        "top3": _share("top3_hits", "cases"),
        "action_accuracy": _share("action_hits", "action_cases")})


def breaks_of(events: DataFrame) -> DataFrame:
    """Injected tracking breaks with the channel they name, if any."""
    named = F.try_element_at(F.array_sort(F.filter(
        "entities", lambda e: e.startswith("channel:"))), F.lit(1))
    return events.filter(F.col("kind") == "tracking_break").select(
        "id", "start", "end", F.substring_index(named, "channel:", -1).alias("channel_id"))


def break_outcomes(breaks: DataFrame, tracking: DataFrame, shown: DataFrame) -> DataFrame:
    """What the daily verdicts did about every break: caught, lag, covered days and leaks.

    ``shown``: (as_of, key, channel_id, tracked), the alerts shown each day and whether they rest
    on platform conversions. Break days meet a channel's alerts on (day, channel), and the
    account-level alerts, a few keys a day, on the day.
    """
    days = breaks.select("*", F.explode(F.sequence("start", "end")).alias("as_of"))
    daily = tracking.groupBy("as_of").agg(
        F.collect_set(F.when(F.col("status") == "broken", F.col("channel_id"))).alias("broken"))
    called = F.when(F.col("channel_id").isNull(), F.size("broken") > 0).otherwise(
        F.array_contains("broken", F.col("channel_id")))
    judged = days.join(daily, "as_of").withColumn("called", called)
    # The account-level alerts and, for a named channel, that channel's.
    held = shown.filter("tracked").select(
        "as_of", "key", F.col("channel_id").alias("alert_channel"))
    hit = judged.filter("called")
    tainted = F.when(F.col("channel_id").isNull(), F.col("broken")).otherwise(F.array("channel_id"))
    by_channel = hit.select("id", "as_of", F.explode(tainted).alias("alert_channel")).join(
        held, ["as_of", "alert_channel"]).select("id", "key")
    everywhere = hit.select("id", "as_of").join(
        held.filter("alert_channel is null").select("as_of", "key").distinct(), "as_of").select(
        "id", "key")
    leaks = by_channel.union(everywhere).groupBy("id").agg(F.count_distinct("key").alias("leaked"))
    outcome = judged.groupBy("id", "channel_id", "start").agg(
        F.count(F.lit(1)).alias("window_days"), F.count_if("called").alias("caught_days"),
        F.min(F.when(F.col("called"), F.col("as_of"))).alias("caught_on"))
    return breaks.select("id", "channel_id", "start").join(
        outcome.drop("channel_id", "start"), "id", "left").join(leaks, "id", "left").select(
        "id", "channel_id", F.coalesce("window_days", F.lit(0)).alias("window_days"),
        F.coalesce("caught_days", F.lit(0)).alias("caught_days"), "caught_on",
        F.datediff("caught_on", "start").alias("lag_days"),
        F.coalesce("leaked", F.lit(0)).alias("leaked"))


def trust_score(breaks: DataFrame, tracking: DataFrame, outcomes: DataFrame) -> DataFrame:
    """Accuracy, suppression and false alarms over all breaks and judged channel-days."""
    inside = breaks.select(F.explode(F.sequence("start", "end")).alias("as_of")).distinct()
    false = tracking.filter(F.col("status") == "broken").join(
        inside, "as_of", "left_anti").agg(F.count(F.lit(1)).alias("false_days"))
    judged = tracking.agg(F.count(F.lit(1)).alias("judged_days"))
    caught = F.col("caught_on").isNotNull()
    counted = outcomes.agg(
        F.count_if(F.col("window_days") > 0).alias("breaks"),
        F.count_if(F.col("window_days") == 0).alias("uncovered"),
        F.count_if(caught).alias("caught"),
        F.count_if(caught & (F.col("leaked") == 0)).alias("held_back"))
    row = counted.withColumn("one", F.lit(1))
    for part in (false, judged):  # one-row aggregates
        row = row.join(F.broadcast(part.withColumn("one", F.lit(1))), "one")
    return row.drop("one").withColumns({
        "accuracy": _share("caught", "breaks"), "suppression": _share("held_back", "breaks"),
        "false_alarm_rate": _share("false_days", "judged_days")})


def scorecard(
    detection: DataFrame, diagnosis: DataFrame, trust: DataFrame, grounding: DataFrame
) -> DataFrame:
    """Every criterion with its target, the measured value and whether it passed."""
    t = C.TARGETS

    def line(criterion: str, value: str, target: float, passed: Column) -> Column:
        return F.struct(
            F.lit(criterion).alias("criterion"), F.lit(target).alias("target"),
            F.col(value).cast("double").alias("measured"), passed.alias("passed"))

    at_least = lambda c, key: F.col(c) >= t[key]
    total = diagnosis.filter("kind = 'all'")
    calls = grounding.filter("purpose = 'all'")
    # Every input has one row and is read once, whatever the number of its criteria.
    parts = [
        (detection, line("Detection within 3 days", "recall_within_3",
                         t["detection_within_3_days"],
                         at_least("recall_within_3", "detection_within_3_days")),
         line("False alarms", "false_alarm_rate", t["false_alarms"],
              F.col("false_alarm_rate") < t["false_alarms"])),
        (total, line("Cause in the top three", "top3", t["cause_in_top_three"],
                     at_least("top3", "cause_in_top_three"))),
        (trust, line("Tracking breaks caught", "accuracy", t["tracking_breaks_caught"],
                     at_least("accuracy", "tracking_breaks_caught")),
         line("Advice suppressed while broken", "suppression", t["advice_suppressed"],
              at_least("suppression", "advice_suppressed"))),
        (calls, line("Ungrounded numbers shown", "leaked", t["ungrounded_numbers"],
                     F.col("leaked") <= t["ungrounded_numbers"])),
    ]
    out = None
    for frame, *lines in parts:
        rows = frame.select(F.inline(F.array(*lines)))
        out = rows if out is None else out.unionByName(rows)
    return out
