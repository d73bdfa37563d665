"""Stored tables: month-partitioned Parquet with staged upserts, and the dimensions."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from adsight.plans.session import scratch
from adsight.plans.stages import staged

FILE_ROWS = 2_000_000    # rows of a month's file, about
__all__ = ["scratch", "merged", "upsert", "read", "load_dimensions", "surrogate", "ad_fact_rows"]

AD_FACT_KEY = ["date", "creative_sk", "age_group", "device", "region"]


def merged(target: DataFrame, batch: DataFrame, key: list[str]) -> DataFrame:
    """The target after inserting or overwriting the batch's rows by key."""
    kept = target.join(batch.select(*key), key, "left_anti")
    return kept.unionByName(batch)


def written(spark: SparkSession, path: str) -> bool:
    """Whether a table was ever written there."""
    try:
        spark.read.parquet(path)
    except AnalysisException as error:
        if error.getCondition() not in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
            raise
        return False
    return True


def stored(spark: SparkSession, path: str, batch: DataFrame) -> DataFrame | None:
    """The stored table, or None before the first write."""
    return spark.read.schema(batch.schema).parquet(path) if written(spark, path) else None


def _dealt(rows: DataFrame, key: list[str]) -> DataFrame:
    """Rows dealt by month and by a hash of the key: few files, and no month is one task's work."""
    spread = rows.count() // FILE_ROWS + 1
    return rows.repartition("month", F.pmod(F.xxhash64(*key), F.lit(spread)))


def upsert(spark: SparkSession, path: str, batch: DataFrame, key: list[str], day: str) -> None:
    """Rewrites only the month partitions a batch touches.

    The batch and the merged months are stored first, then the months are swapped in with dynamic
    partition overwrite. The same batch twice changes nothing; if the swap itself fails half way,
    running the upsert again completes it.
    """
    new = staged(batch.withColumn("month", F.date_format(day, "yyyy-MM")), "batch")
    target = stored(spark, path, new)
    if target is not None:
        # Distinct months of the batch: at most a few hundred rows whatever the batch holds.
        months = F.broadcast(new.select("month").distinct())
        touched = target.join(months, "month", "left_semi")
        new = staged(merged(touched.select(*new.columns), new, key), "merged")
    _dealt(new, key).write.mode("overwrite").option(
        "partitionOverwriteMode", "dynamic").partitionBy("month").parquet(path)


def read(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path).drop("month")


def append_runs(spark: SparkSession, path: str, batch: int, log: DataFrame) -> None:
    """Adds the run rows of one import to the log; the same batch again replaces its own rows.

    A batch is one partition, swapped in whole, so a retried import leaves one row per file.
    """
    log.withColumn("batch", F.lit(batch).cast("bigint")).write.mode("overwrite").option(
        "partitionOverwriteMode", "dynamic").partitionBy("batch").parquet(path)


def recent_runs(spark: SparkSession, path: str, limit: int = 20) -> DataFrame:
    """The newest runs of the log with their ids, newest import first, files in order."""
    rows = spark.read.parquet(path)
    return rows.orderBy(F.desc("batch"), "file").limit(limit).withColumn(
        "run_id", F.concat_ws("/", F.col("batch").cast("string"), "file"))


def surrogate(*path: str) -> Column:
    """Deterministic id of an entity from its path of external ids: no sequence, no look-up."""
    return F.xxhash64(*path)


LEVEL_PATHS = {
    "channel": ("channel_id",),
    "campaign": ("channel_id", "campaign_external_id"),
    "ad_set": ("channel_id", "campaign_external_id", "ad_set_external_id"),
    "creative": (
        "channel_id", "campaign_external_id", "ad_set_external_id", "creative_external_id"),
}


def load_dimensions(records: DataFrame) -> DataFrame:
    """Entities of all levels found in parsed ad rows; the last row's name wins.

    ``records`` carry the external ids, names and a ``line``. Rows are reduced per creative
    before they are spread over the four levels.
    """
    names = ("campaign_name", "ad_set_name", "creative_name")
    reduced = records.groupBy(*LEVEL_PATHS["creative"]).agg(
        F.max(F.struct("date", "line", *names)).alias("last"))
    def entity(level: str) -> Column:
        path = LEVEL_PATHS[level]
        name = F.col("channel_id") if level == "channel" else F.col(f"last.{level}_name")
        parent = surrogate(*path[:-1]) if len(path) > 1 else F.lit(None).cast("bigint")
        return F.struct(
            F.lit(level).alias("level"), surrogate(*path).alias("id"), parent.alias("parent_id"),
            F.col(path[-1]).alias("external_id"), name.alias("name"))
    spread = reduced.select(
        "last.date", "last.line", F.inline(F.array(*[entity(level) for level in LEVEL_PATHS])))
    return spread.groupBy("level", "id", "parent_id", "external_id").agg(
        F.max_by("name", F.struct("date", "line")).alias("name"))


def ad_fact_rows(records: DataFrame) -> DataFrame:
    """Parsed ad rows as fact rows: surrogate ids beside the external ones, six measures."""
    from adsight.functions.catalogue import AD_MEASURES

    ids = {f"{level}_sk": surrogate(*path) for level, path in LEVEL_PATHS.items()}
    return records.withColumns(ids).select(
        "date", "channel_id", *ids, F.col("campaign_external_id").alias("campaign_id"),
        F.col("ad_set_external_id").alias("ad_set_id"),
        F.col("creative_external_id").alias("creative_id"), "age_group", "device", "region",
        *AD_MEASURES)


def latest_per_key(rows: DataFrame, key: list[str], order: list[Column]) -> DataFrame:
    """One row per key, the last in the given order."""
    place = Window.partitionBy(*key).orderBy(*order)
    return rows.withColumn("place", F.row_number().over(place)).filter("place = 1").drop("place")
