"""Checks on text: the numbers it quotes, the references it cites, and the call log's score."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from adsight.functions import catalogue as C
from adsight.functions import kpi as K

# --- fixed values: number grammar and tolerances -------------------------------------------
SCALES = {"l": 1e5, "lakh": 1e5, "lakhs": 1e5, "cr": 1e7, "crore": 1e7}
NUMBER = (
    r"(?i)(?<![\p{L}\p{N}_.])([0-9][0-9,]*(?:\.[0-9]+)?)"
    r"\s*(%|x|(?:l|lakhs?|cr|crore)(?![\p{L}\p{N}_]))?")
TOLERANCE_PCT = 2.0
TOLERANCE_ABS = 0.5


def numbers_in_text(texts: DataFrame, key: str, text: str, ignore: Column | None = None):
    """One row per number a reader takes from a text; scaled numbers count bare as well.

    ``ignore``: array of tokens (such as signal ids) blanked out first.
    """
    body = F.col(text)
    if ignore is not None:
        body = F.aggregate(
            ignore, body, lambda left, token: F.replace(left, token, F.lit(" ")))
    found = texts.select(F.col(key), body.alias("body")).select(
        key,
        F.explode(F.arrays_zip(
            F.regexp_extract_all("body", F.lit(NUMBER), F.lit(1)).alias("digits"),
            F.regexp_extract_all("body", F.lit(NUMBER), F.lit(2)).alias("unit"))).alias("n"))
    bare = F.regexp_replace("n.digits", ",", "").cast("double")
    scale = K.lookup(SCALES, F.lower("n.unit"))
    values = F.array_compact(F.array(bare, bare * scale))
    return found.select(key, F.explode(values).alias("value"))


def ungrounded_numbers(numbers: DataFrame, permitted: DataFrame, key: str) -> DataFrame:
    """Numbers no permitted number of the same text comes close to.

    Only the nearest permitted number on either side can be close enough, so two running windows
    per text replace the join of all pairs.
    """
    marked = numbers.select(
        key, F.abs("value").alias("value"), F.lit(0).alias("given")
    ).unionByName(permitted.select(
        key, F.abs("value").alias("value"), F.lit(1).alias("given")))
    known = F.when(F.col("given") == 1, F.col("value"))
    up = Window.partitionBy(key).orderBy("value", F.desc("given")).rowsBetween(
        Window.unboundedPreceding, 0)
    down = Window.partitionBy(key).orderBy(F.desc("value"), F.desc("given")).rowsBetween(
        Window.unboundedPreceding, 0)
    sides = marked.withColumns({
        "below": F.last(known, ignorenulls=True).over(up),
        "above": F.last(known, ignorenulls=True).over(down)})

    def close(other: str) -> Column:
        slack = F.greatest(
            F.greatest("value", other) * (TOLERANCE_PCT / 100), F.lit(TOLERANCE_ABS))
        return F.coalesce(F.abs(F.col("value") - F.col(other)) <= slack, F.lit(False))

    return sides.filter((F.col("given") == 0) & ~close("below") & ~close("above")).select(
        key, "value")


def ungrounded_references(cited: DataFrame, known: DataFrame, key: str) -> DataFrame:
    """Cited signal ids that are not in the evidence. Both frames: (key, signal_id)."""
    return cited.select(key, "signal_id").distinct().join(known, [key, "signal_id"], "left_anti")


def invalid_actions(proposed: DataFrame) -> DataFrame:
    """Proposed actions outside the catalogue or not allowed on the entity.

    Needs action, allowed (array) and protected.
    """
    unknown = ~F.col("action").isin(*C.ACTIONS)
    reason = (
        F.when(unknown, "not in the catalogue")
        .when(F.col("protected"), "campaign is protected")
        .otherwise(F.concat(F.lit("cannot be taken on a "), F.col("level"))))
    return proposed.filter(
        unknown | ~F.array_contains("allowed", F.col("action"))).withColumn("reason", reason)


def grounding_score(calls: DataFrame) -> DataFrame:
    """Rates over a call log by purpose, with a total row (purpose ``all``).

    ``calls``: (purpose, attempt, grounded, fallback, error).
    """
    first, clean = F.col("attempt") == 1, F.col("error").isNull()
    rows = calls.rollup("purpose").agg(
        F.count(F.lit(1)).alias("attempts"),
        F.count_if(first).alias("answers"),
        F.count_if(~F.col("grounded") & clean).alias("ungrounded"),
        F.count_if(~clean).alias("errors"),
        F.count_if(first & F.col("fallback")).alias("fell_back"),
        F.count_if((F.col("attempt") > 1) & F.col("grounded")).alias("recovered"),
        F.count_if(F.col("grounded") & F.col("fallback")).alias("leaked"),
        F.count_if(F.col("attempt") > 1).alias("retries"))
    return rows.withColumns({
        "purpose": F.coalesce("purpose", F.lit("all")),
        "violation_rate": F.coalesce(K.ratio("ungrounded", "attempts"), F.lit(0.0)),
        "fallback_rate": F.coalesce(K.ratio("fell_back", "answers"), F.lit(0.0))})
