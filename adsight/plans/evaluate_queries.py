"""Queries of the accuracy evaluation."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from adsight.functions import catalogue as C
from adsight.operators import evaluate as E
from adsight.operators import group as G
from adsight.operators import recommend as R
from adsight.operators import textcheck as TX
from adsight.plans.detect_queries import asked, replayed, whole_tracking
from adsight.plans.explain_queries import stored
from adsight.plans.queries import query
from adsight.plans.session import scratch
from adsight.plans.stages import staged
from adsight.sources import testtables as T


@query("read_labelled_events")
def _(spark, sf):
    """Round trip: the raw events as JSON documents, read back and widened by lineage."""
    path = scratch(spark, "events")
    raw = T.labelled_events(spark, sf)
    # One event per document: no document grows with the table.
    raw.select(F.array(F.struct(*raw.columns)).alias("events")).write.option(
        "ignoreNullFields", False).json(path)
    return E.labelled_events(E.read_events(spark, path, multi_line=False),
                             G.lineage(T.ad_facts(spark, sf)))


def events_of(spark, sf):
    return staged(E.labelled_events(
        T.labelled_events(spark, sf), G.lineage(T.ad_facts(spark, sf))), "events")


def episodes_of(spark, sf):
    return staged(E.alert_episodes(T.alert_sightings(spark, sf)), "episodes")


@query("alert_episodes")
def _(spark, sf):
    return E.alert_episodes(T.alert_sightings(spark, sf))


def replay_episodes(spark, sf):
    """Episodes of what the engine itself shows on every as-of date."""
    shown = E.sightings(replayed(spark, sf).withColumn("entity_id", F.col("opportunity")))
    return staged(E.alert_episodes(shown), "replay_episodes")


@query("replay_episodes")
def _(spark, sf):
    return replay_episodes(spark, sf)


@query("replay_score")
def _(spark, sf):
    """The accuracy of the replay: sightings, episodes, matches and scores."""
    return E.detection_score(
        events_of(spark, sf), replay_episodes(spark, sf), *asked(spark, sf))


@query("match_episodes")
def _(spark, sf):
    events = E.in_range(events_of(spark, sf), *asked(spark, sf))
    return E.match_episodes(events, episodes_of(spark, sf)).select("event_id", "key", "detected_on")


@query("detection_score")
def _(spark, sf):
    return E.detection_score(events_of(spark, sf), episodes_of(spark, sf), *asked(spark, sf))


def detected(spark, sf):
    events = E.in_range(events_of(spark, sf), *asked(spark, sf))
    return E.detected_events(events, E.match_episodes(events, episodes_of(spark, sf)))


@query("days_to_detect")
def _(spark, sf):
    return E.recall_by_kind(detected(spark, sf))


@query("split_suppressed")
def _(spark, sf):
    return E.split_suppressed(detected(spark, sf), T.FESTIVE).select(
        "id", "kind", "detected_on", "lag", "outcome")


@query("false_positives")
def _(spark, sf):
    events, episodes = E.in_range(events_of(spark, sf), *asked(spark, sf)), episodes_of(spark, sf)
    alerts = E.unexplained(episodes, E.match_episodes(events, episodes))
    return E.false_positives(alerts).select("key", "detected_on", "kind", "peak_score", "days_open")


def cases(spark, sf):
    """Diagnosed scenarios: every stored opportunity with its causes against a labelled kind."""
    causes = ("creative_fatigue", "landing_page_break", "cpc_spike", "audience_mismatch",
              "tracking_break", "budget_overpace", "channel_opportunity")
    rows = stored(spark, sf)
    ranked = F.array("cause", *[T.pick(causes, (F.col("id") + i) % 7) for i in (2, 3, 5)])
    return rows.select(
        "id", T.pick(causes, F.col("id") % 7).alias("kind"), ranked.alias("causes"),
        R.choose_action(F.array("cause"), "allowed").alias("action"),
        F.when(F.col("id") % 5 != 0, T.pick(
            ("rotate_creative", "refine_audience", "shift_budget"), F.col("id") % 3)).alias(
            "expected_action"))


@query("diagnosis_score")
def _(spark, sf):
    return E.diagnosis_score(cases(spark, sf))


def shown_alerts(spark, sf):
    tracked = F.arrays_overlap("metrics", F.array(*[
        F.lit(m) for m in C.METRICS if C.needs_tracking(m)]))
    return T.alert_sightings(spark, sf).select(
        "as_of", "key", "channel_id",
        (tracked & ~F.array_contains("detectors", "tracking_break")).alias("tracked"))


def trust_of(spark, sf):
    breaks = staged(E.breaks_of(E.labelled_events(
        T.labelled_events(spark, sf), G.lineage(T.ad_facts(spark, sf)))), "breaks")
    tracking = staged(whole_tracking(spark, sf), "tracking")
    outcomes = E.break_outcomes(breaks, tracking, shown_alerts(spark, sf))
    return breaks, tracking, outcomes


@query("break_outcomes")
def _(spark, sf):
    return trust_of(spark, sf)[2]


@query("trust_score")
def _(spark, sf):
    return E.trust_score(*trust_of(spark, sf))


@query("scorecard")
def _(spark, sf):
    last = F.max("turn").over(Window.partitionBy("conv_id"))
    calls = T.table(spark, sf, "conversations").select(
        F.col("role").alias("purpose"), (F.col("turn") + 1).alias("attempt"),
        (F.col("turn") % 2 == 0).alias("grounded"), (F.col("turn") == last).alias("fallback"),
        F.when(F.length("text") < 200, "too short").alias("error"))
    return E.scorecard(
        E.detection_score(events_of(spark, sf), episodes_of(spark, sf), *asked(spark, sf)),
        E.diagnosis_score(cases(spark, sf)), E.trust_score(*trust_of(spark, sf)),
        TX.grounding_score(calls))
