"""Rows made distinct after they are dealt out."""

from adsight.plans import stages
from adsight.plans.all_queries import REGISTRY


def steps(frame):
    """Operators of the plan, the last one first."""
    plan = frame._jdf.queryExecution().executedPlan().toString().splitlines()
    return [line.split("- ")[-1] for line in plan]


def test_distinct_rows_are_those_of_distinct(spark, monkeypatch):
    monkeypatch.setattr(stages, "TASK_ROWS", 7)
    rows = [(i % 9 or None, float(i % 4)) for i in range(60)] + [
        (1, 0.0), (1, -0.0), (1, float("nan")), (1, float("nan")), (None, None), (None, None)]
    frame = spark.createDataFrame(rows, "id bigint, value double")
    found = stages.distinct_rows(frame, len(rows))
    shown = lambda f: sorted(map(repr, f.collect()))
    assert shown(found) == shown(frame.distinct())
    assert "10)" in next(s for s in steps(found) if s.startswith("Exchange"))
    assert stages.distinct_rows(frame.limit(0), 0).count() == 0


def test_quotable_numbers_hold_no_rows_before_they_are_dealt(spark, tmp_path):
    spark.createDataFrame(
        [(i, f"c{i}", 1, 12.5 * (i or 7), "BUILDING") for i in (1, 1, 2, 3, None)],
        "c_custkey bigint, c_name string, c_nationkey bigint, c_acctbal double, "
        "c_mktsegment string").write.parquet(f"{tmp_path}/customer.parquet")
    found = REGISTRY["quotable_numbers"](spark, str(tmp_path))
    plan = steps(found)
    last = max(i for i, s in enumerate(plan) if "Exchange" in s)
    assert not any("Aggregate" in s for s in plan[last:])
    assert found.count() == found.distinct().count() > 3
