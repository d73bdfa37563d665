"""Scoring, suppression and roll-up: from raw signals to the one entity to act on."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from adsight.functions import catalogue as C
from adsight.functions import kpi as K
from adsight.functions import periods as P

MOVE = ["as_of", "detector", "metric", "adverse"]
PEER_DETECTOR = "segment_divergence"


# --- scoring ----------------------------------------------------------------------------
def needs_tracking(metric: K.ColumnLike = "metric") -> Column:
    return K.col(metric).isin(*[m for m in C.METRICS if C.needs_tracking(m)])


def rupee_impact() -> Column:
    """What a movement is worth over its window; spend at stake for a pure rate."""
    delta = F.abs(F.col("current") - F.col("baseline"))
    held = lambda m: F.coalesce(F.col("measures")[m], F.lit(0.0))
    impact = F.when(
        F.col("metric").isin(*C.MONEY_MEASURES),
        delta * (F.datediff("window_end", "window_start") + 1))
    for metric, (measure, scale) in C.MONEY_UNITS.items():
        impact = impact.when(F.col("metric") == metric, delta * held(measure) * scale)
    known = delta.isNotNull() & F.col("change_pct").isNotNull()
    return F.when(known, impact.otherwise(held("spend"))).otherwise(0.0)


def score(change_pct: K.ColumnLike, impact: K.ColumnLike) -> Column:
    share = F.least(F.abs(K.col(change_pct)), F.lit(C.MAX_CHANGE_PCT)) / 100
    return F.coalesce(share * K.col(impact), F.lit(0.0))


def festive_overlap(festive: list[tuple], start: P.Day, end: P.Day) -> Column:
    """Whether a window meets any of the settings' sale windows (name, start, end)."""
    hit = F.lit(False)
    for _, first, last in festive:
        hit = hit | P.overlaps(start, end, first, last)
    return hit


def broken_channels(tracking: DataFrame) -> DataFrame:
    """Channels called broken, per as-of date: one row per day, the channels being an enum."""
    return tracking.filter(F.col("status") == "broken").groupBy("as_of").agg(
        F.collect_set("channel_id").alias("broken"))


def suppressed(broken: K.ColumnLike, festive: list[tuple]) -> Column:
    """Signals never to be shown: untracked metrics of a broken channel, and sale windows."""
    channels = F.coalesce(K.col(broken), F.array().cast("array<string>"))
    tainted = F.when(F.col("channel_id").isNull(), F.size(channels) > 0).otherwise(
        F.array_contains(channels, F.col("channel_id")))
    hidden = (needs_tracking() & tainted) | festive_overlap(festive, "window_start", "window_end")
    return F.when(F.col("detector") == "tracking_break", False).otherwise(hidden)


def suppress(signals: DataFrame, tracking: DataFrame, festive: list[tuple]) -> DataFrame:
    # One row per calendar day, so broadcasting it is bounded whatever the facts hold.
    broken = F.broadcast(broken_channels(tracking))
    joined = signals.join(broken, "as_of", "left")
    return joined.filter(~suppressed("broken", festive)).drop("broken")


def rank_signals(
    signals: DataFrame, tracking: DataFrame, festive: list[tuple] = (),
    min_score: float = C.MIN_SCORE,
) -> DataFrame:
    """Suppress, value and score; small scores go, except for commitments and broken pixels."""
    scored = suppress(signals, tracking, festive).withColumn("impact", rupee_impact()).withColumn(
        "score", score("change_pct", "impact"))
    keep = F.col("detector").isin(*C.UNCONDITIONAL_DETECTORS) | (F.col("score") >= min_score)
    return scored.filter(keep)


# --- hierarchy --------------------------------------------------------------------------
def lineage(ads: DataFrame) -> DataFrame:
    """Every entity of the four levels with its channel and its ancestors, top down."""
    path = ads.select("channel_id", "campaign_id", "ad_set_id", "creative_id").distinct()
    levels = ("channel", "campaign", "ad_set", "creative")
    ids = [F.concat(F.lit(f"{level}:"), F.concat_ws("/", *[
        f"{above}_id" for above in levels[:depth + 1]])) for depth, level in enumerate(levels)]
    rows = F.array(*[
        F.struct(
            F.lit(level).alias("level"), F.col(f"{level}_id").alias("key"),
            ids[depth].alias("entity_id"),
            F.array(*ids[:depth]).cast("array<string>").alias("ancestors"))
        for depth, level in enumerate(levels)])
    return path.select("channel_id", F.inline(rows)).distinct()


def child_counts(ads: DataFrame) -> DataFrame:
    """How many children each entity has; age groups are slices, not children."""
    entities = lineage(ads)
    parent = F.coalesce(F.try_element_at("ancestors", F.lit(-1)), F.lit("account:all"))
    return entities.groupBy(parent.alias("entity_id")).agg(F.count(F.lit(1)).alias("children"))


def nodes_of(signals: DataFrame) -> DataFrame:
    """Every entity a move was seen at or under, with the parent it hangs from.

    ``move`` is a struct, so that a move and an entity are two keys wherever they meet.
    ``owned``: the entity reported the move itself; ``inner``: something under it did.
    """
    chain = F.concat("ancestors", F.array("entity_id"))
    seen = signals.filter(F.col("detector") != PEER_DETECTOR).select(
        F.struct(*MOVE).alias("move"), F.col("entity_id").alias("reporter"),
        F.posexplode_outer(chain).alias("depth", "node"), chain.alias("chain"))
    parent = F.when(F.col("depth") > 0, F.element_at("chain", F.greatest("depth", F.lit(1))))
    return seen.withColumn("parent", parent).groupBy("move", "depth", "node", "parent").agg(
        F.bool_or(F.col("node") == F.col("reporter")).alias("owned"),
        F.bool_or(F.col("node") != F.col("reporter")).alias("inner"))


def _broad_nodes(nodes: DataFrame, children: DataFrame) -> DataFrame:
    """(move, node) of every owned broad move.

    The hierarchy is four steps deep, so the recursion is four rounds, deepest first: a child
    carries a move when it reported it or when the move ran across its own children. Rounds hand
    their result on by union and aggregation, which needs no join between them.
    """
    sized = nodes.join(children.withColumnRenamed("entity_id", "node"), "node", "left").select(
        "move", "depth", "node", "parent", "owned", "children", F.lit(False).alias("across"))
    carried = None
    broad = None
    for depth in (3, 2, 1, 0):
        below = sized.filter(F.col("depth") == depth + 1).select("move", "node", "parent", F.col(
            "owned").alias("carries"))
        if carried is not None:
            below = below.unionByName(carried)
        once = below.groupBy("move", "node", "parent").agg(F.bool_or("carries").alias("carries"))
        counts = once.groupBy("move", F.col("parent").alias("node")).agg(
            F.count_if("carries").alias("carrying"), F.count(F.lit(1)).alias("branches"))
        here = sized.filter(F.col("depth") == depth).join(counts, ["move", "node"])
        known = F.coalesce("children", "branches")
        across = here.filter(
            (F.col("carrying") >= 2) & (F.col("carrying") >= C.BROAD_SHARE * known))
        carried = across.select("move", "node", "parent", F.lit(True).alias("carries"))
        owned = across.filter("owned").select("move", "node")
        broad = owned if broad is None else broad.unionByName(owned)
    return broad


def broad_moves(signals: DataFrame, children: DataFrame) -> DataFrame:
    """Moves carried by at least two and at least half of an entity's children.

    Only entities that reported the move themselves can own it.
    """
    found = _broad_nodes(nodes_of(signals), children)
    return found.select("move.*", F.col("node").alias("entity_id"))


def most_specific(signals: DataFrame, children: DataFrame) -> DataFrame:
    """Keeps a movement at the one level where it can be acted on.

    Reads its input several times: pass a stored signals frame when it comes from a long plan.
    """
    peers = signals.filter(F.col("detector") == PEER_DETECTOR)
    rolled = signals.filter(F.col("detector") != PEER_DETECTOR).withColumn("move", F.struct(*MOVE))
    nodes = nodes_of(signals)
    broad = _broad_nodes(nodes, children)
    flags = nodes.select("move", "node", "inner", F.lit(False).alias("broad")).unionByName(
        broad.select("move", "node", F.lit(False).alias("inner"), F.lit(True).alias("broad"))
    ).groupBy("move", "node").agg(
        F.bool_or("inner").alias("inner"), F.bool_or("broad").alias("broad"))
    # One row per signal and entity on its path; the own entity and each ancestor bring a flag.
    path = rolled.select(
        "move", "id", F.posexplode_outer(F.concat("ancestors", F.array("entity_id"))).alias(
            "depth", "node"), F.size("ancestors").alias("own_depth"))
    own = F.col("depth") == F.col("own_depth")
    verdicts = path.join(flags, ["move", "node"], "left").groupBy("move", "id").agg(
        F.bool_or(F.coalesce("broad", F.lit(False)) & ~own).alias("below_broad"),
        F.bool_or(F.coalesce("broad", F.lit(False)) & own).alias("broad"),
        F.bool_or(F.coalesce("inner", F.lit(False)) & own).alias("inner"))
    keep = verdicts.filter("not below_broad and (broad or not inner)").select("move", "id")
    kept = rolled.join(keep, ["move", "id"], "left_semi")
    return kept.select(*signals.columns).unionByName(peers)


def group_opportunities(signals: DataFrame) -> DataFrame:
    """One opportunity per as-of date and entity; its signals are sorted by score.

    An entity has at most a handful of metrics and detectors, so the collected list is bounded
    by the metric catalogue.
    """
    order = F.struct(
        F.col("score"), F.col("id"),
        *[F.col(c) for c in signals.columns if c not in ("score", "id", "as_of", "entity_id")])
    grouped = signals.groupBy("as_of", "entity_id").agg(
        F.sort_array(F.collect_list(order), asc=False).alias("signals"))
    primary = F.element_at("signals", 1)
    lifted = ("level", "key", "channel_id", "campaign_id", "ad_set_id", "ancestors",
              "window_start", "window_end")
    return grouped.withColumn("primary", primary).select(
        "as_of", F.col("entity_id").alias("opportunity"), "entity_id",
        *[F.col("primary")[c].alias(c) for c in lifted],
        F.when(F.col("primary.adverse"), "issue").otherwise("win").alias("kind"),
        "primary", "signals",
        F.array_max(F.transform("signals", lambda s: s["impact"])).alias("impact"),
        F.col("primary.score").alias("score"))


def with_names(frame: DataFrame, names: DataFrame, column: str = "entity_id") -> DataFrame:
    """Adds ``name`` from (entity_id, name); channels and the account have fixed labels."""
    fixed = {f"channel:{c}": C.SOURCE_LABELS[c] for c in C.CHANNELS} | {
        "account:all": C.ALL_CHANNELS}
    found = frame.join(names.withColumnRenamed("entity_id", column), column, "left")
    last = F.element_at(F.split(F.col(column), "[:|/]"), -1)
    return found.withColumn("name", F.coalesce(K.lookup(fixed, column), "name", last))


def rank_opportunities(opportunities: DataFrame, top: int) -> DataFrame:
    """The first few of each kind and as-of date, strongest first (column ``place``)."""
    order = Window.partitionBy("as_of", "kind").orderBy(F.desc("score"), "entity_id")
    return opportunities.withColumn("place", F.row_number().over(order)).filter(
        F.col("place") <= top)
