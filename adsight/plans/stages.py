"""Cutting long plans: a stage is written once and every later reader scans the result."""

from __future__ import annotations

from pyspark.sql import DataFrame

from adsight.plans.session import scratch

TASK_ROWS = 500_000     # rows that one task of distinct_rows holds, about


def staged(frame: DataFrame, name: str, group_rows: int | None = None) -> DataFrame:
    """Writes a frame to the shared scratch folder and returns a scan of it.

    The written table survives executor loss and keeps statistics, so later joins are planned on
    real sizes. ``group_rows``: rows of a row group, which readers hold at once, for large rows.
    """
    path = scratch(frame.sparkSession, name)
    limits = {"parquet.block.row.count.limit": group_rows} if group_rows else {}
    frame.write.options(**limits).parquet(path)
    return frame.sparkSession.read.schema(frame.schema).parquet(path)


def distinct_rows(frame: DataFrame, rows: int) -> DataFrame:
    """Distinct rows of a frame of about ``rows`` rows, few of which are equal.

    ``distinct`` first keeps the rows of every reading task in a hash table, all of a file that one
    task reads, and removes next to none there. Here they are dealt out before, to as many tasks
    as there are ``TASK_ROWS``.
    """
    return frame.repartition(-(-rows // TASK_ROWS) or 1, *frame.columns).distinct()
