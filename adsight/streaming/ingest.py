"""New export files in a folder, ingested and upserted exactly once."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from adsight.plans import sweep
from adsight.plans.stages import staged
from adsight.sources import exports as X
from adsight.sources import templates as TP
from adsight.sources import warehouse as WH

FILES = "path string, modificationTime timestamp, length bigint, content binary"
FACT_KEYS = {
    # External ids are unique under their parent only, so the whole path is the key.
    "ads": ["date", "channel_id", "campaign_id", "ad_set_id", "creative_id", "age_group", "device",
            "region"],
    "web": ["date", "source", "device"],
    "store": ["date"],
}


def load_batch(spark: SparkSession, files: list[str], tables: str) -> DataFrame:
    """Ingests a list of files and upserts their facts under ``tables``; returns the days."""
    validated, _ = X.ingest_files(spark, files)
    days = []
    for name, facts in X.load_detector_facts(validated).items():
        key = FACT_KEYS[name]
        # Files are ordered by name; a later file corrects an earlier one's rows.
        newest = WH.latest_per_key(facts, key, [F.desc("file"), F.desc("line")])
        WH.upsert(spark, f"{tables}/{name}", newest.drop("file", "line"), key, "date")
        days.append(facts.select("date").distinct())
    return reduce(DataFrame.unionByName, days).distinct()


def stream_ingest(
    spark: SparkSession, folder: str, tables: str, checkpoint: str,
    context: sweep.Context | None = None,
) -> None:
    """Processes every file that is new since the last call, then stops.

    With a context the stored replay (``tables``/analysis) follows: after each batch the as-of dates
    that its days reach are swept again, once all three kinds of facts are there.
    The stream lists files without reading their content; each micro-batch reads its files as one
    batch job, and the upsert makes a retried batch harmless.
    """
    names = spark.readStream.format("binaryFile").schema(FILES).option(
        "maxFilesPerTrigger", 1000).load(folder).select(F.col("path").alias("file"))

    def one(batch: DataFrame, _: int) -> None:
        # File names of one trigger (bounded by maxFilesPerTrigger).
        files = [r["file"] for r in batch.distinct().collect()]
        if not files:
            return
        session = batch.sparkSession
        days = staged(load_batch(session, files, tables), "days")
        facts = [f"{tables}/{name}" for name in ("ads", "web", "store")]
        if context is not None and all(WH.written(session, path) for path in facts):
            sweep.refresh(session, f"{tables}/analysis", *(WH.read(session, p) for p in facts),
                          context, days)

    query = names.writeStream.foreachBatch(one).option(
        "checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
